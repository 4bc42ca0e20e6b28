"""Exact substring removal by suffix arrays.

Every byte that a string of ``length`` bytes covers which also starts anywhere else goes.

1.  Winnowing: each window of ``length`` bytes names the smallest hash of its ``GRAM``-byte
    grams as its anchor, so equal windows have equal anchors.  An anchor that stands at one
    place only can't belong to a repeat.
2.  Texts with shared anchors are cut into runs, the window starts that one anchor serves with
    the bytes that these windows cover.  Runs with the same anchor go to the same shard; tasks
    send equal runs once, with their places.
3.  A shard builds a suffix array (Larsson-Sadakane refinement in numpy) over its runs, with
    Kasai's common prefixes; neighbours that share ``length`` bytes repeat.  (A run whose
    anchor stands nowhere else repeats in its equal copies alone.)  Shards are bounded:
    an anchor with more bytes of runs is dealt over several shards, whose sorted windows are
    then merged by binary search.
4.  The repeated starts of each text become covered intervals, which are cut out.

Documents travel in packed chunks; equal texts of a chunk are treated once, and count as copies.

Defined results: null and empty texts have no bytes and keep none; texts shorter than
``length`` keep all; matches never cross documents; overlapping repeats inside one document
count; repeated rows are whole copies; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.llm.common import chunked, expand, lean, mix, small_batches, squeeze, task_width, total_bytes, unpack_rows, written

LENGTH, GRAM = 400, 32
#: Bytes of runs that one suffix array takes.
SHARD_BYTES, CHUNK_BYTES = 2 << 20, 2 << 20
BIG = np.uint64(0xFFFFFFFFFFFFFFFF)
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash for each ``gram`` bytes, by doubling: gram must be a power of two."""
    h = _BYTE[data]
    step, factor = 1, 0x9E3779B97F4A7C15
    while step < gram:
        h = h[:-step] * np.uint64(factor) + h[step:]
        h ^= h >> np.uint64(29)
        factor = factor * 0xD6E8FEB86659FD93 % 2**64 | 1
        step *= 2
    return mix(h)


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with the same smallest gram: (first window, hash, the gram stands at several places of the text)."""
    h = gram_hashes(data, gram)
    w = length - gram + 1  # grams of a window
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    # sliding minimum by blocks of w: suffix minima of a block, prefix minima of the next
    x = np.full(-(-len(h) // w) * w, BIG)
    x[: len(h)] = h
    rows = x.reshape(-1, w)
    left = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    right = np.minimum.accumulate(rows, 1).ravel()
    least = np.minimum(left[:n], right[w - 1 : w - 1 + n])
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    value = least[first]
    # how often each of these hashes stands in the text: a small table sorts out most places
    table = np.zeros(1 << 16, bool)
    table[value & np.uint64(0xFFFF)] = True
    near = np.sort(h[table[h & np.uint64(0xFFFF)]])
    several = np.searchsorted(near, value, "right") - np.searchsorted(near, value) > 1
    # minima are small numbers; mixed again they spread evenly over hash ranges
    return first, mix(value), several


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes by their first ``depth`` bytes or more.

    Larsson-Sadakane: suffixes are ranked by eight bytes at once, then only the unsorted groups
    are refined by the rank of what follows, the compared length doubling each time.
    """
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    # seven bytes of nine bits each: the end of the data sorts first
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = key << np.uint64(9) | padded[i : i + n]
    order = np.argsort(key)
    ranked = key[order]
    head = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    rank = np.empty(n, np.int64)
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = group
    h = 7
    open_ = unsorted_places(group)
    while len(open_) and h < depth:
        at = order[open_]
        follow = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        own = group[open_]
        by = np.argsort(own * (n + 1) + follow)
        at, follow = at[by], follow[by]
        order[open_] = at
        head = np.concatenate(([True], (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])))
        fresh = np.maximum.accumulate(np.where(head, open_, 0))
        group[open_] = fresh
        rank[at] = fresh
        h *= 2
        open_ = open_[unsorted_places(fresh)]
    return order, rank


def unsorted_places(group: np.ndarray) -> np.ndarray:
    """Places whose group has another member beside them."""
    same = group[1:] == group[:-1]
    return np.flatnonzero(np.concatenate(([False], same)) | np.concatenate((same, [False]))) if len(group) else np.zeros(0, np.int64)


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int, lanes: int = 16384) -> np.ndarray:
    """Kasai's common prefix of each suffix with the one before it in order, up to ``most`` bytes.

    The text is cut into lanes that run Kasai's scan side by side: a suffix shares at least one
    byte less with its neighbour than its predecessor in the text did.  A step of a lane compares
    eight bytes as one number; where they differ or the limit is reached, it moves on.  Suffixes
    that the array left in one group (equal ``rank``) share ``most`` bytes and more; as their order
    is open, nothing follows for the next.
    """
    n = len(data)
    if n < 2:
        return np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    alone = before < 0
    tied = ~alone & (rank == rank[before])
    room = np.where(alone | tied, 0, np.minimum(most, n - np.maximum(np.arange(n), before)))
    padded = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()
    known = np.where(tied, most, 0)
    width = max(1, -(-n // lanes))
    i = np.arange(0, n, width)
    stop = np.minimum(i + width, n)
    h = np.zeros(len(i), np.int64)
    while len(i):
        limit = room[i]
        x = words[i + h] ^ words[before[i] + h]
        same = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
        grown = np.minimum(h + same, limit)
        out = (same < 8) | (grown >= limit)
        measured = out & (limit > 0)
        known[i[measured]] = grown[measured]
        h = np.where(out, np.maximum(grown - 1, 0), grown)
        i = i + out
        ended = i >= stop
        if ended.any():
            i, stop, h = i[~ended], stop[~ended], h[~ended]
    return known[order]


def repeated_starts(runs: list[bytes], windows: list[int], many: list[bool], length: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each run, which of its window starts repeat in this shard; and the sorted distinct windows' places.

    ``windows``: starts of each run; ``many``: the run itself occurs more than once.
    """
    sizes = np.array([len(r) for r in runs], np.int64)
    data = np.frombuffer(b"".join(runs), np.uint8)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    # a separator isn't needed: a window lies inside its run by construction
    order, rank = suffix_array(data, length)
    lcp = common_prefixes(data, order, rank, length)
    start = np.zeros(len(data), bool)
    plenty = np.zeros(len(data), bool)
    for o, w, m in zip(offsets[:-1].tolist(), windows, many, strict=True):
        start[o : o + w] = True
        plenty[o : o + w] = m
    # only window starts count; classes are maximal stretches of common prefixes of the length
    klass = np.cumsum(lcp < length)  # the suffix that shares less with its predecessor opens a class
    valid = start[order]
    counts = np.bincount(klass[valid], minlength=klass[-1] + 1 if len(klass) else 1)
    copies = np.bincount(klass[valid], plenty[order][valid], minlength=len(counts))
    twice = (counts > 1) | (copies > 0)
    flag = np.zeros(len(data), bool)
    flag[order[valid]] = twice[klass[valid]]
    firsts = order[valid][np.concatenate(([True], np.diff(klass[valid]) > 0))] if valid.any() else np.zeros(0, np.int64)
    return [flag[o : o + w] for o, w in zip(offsets[:-1].tolist(), windows, strict=True)], firsts, offsets


def merge_shards(parts: list[tuple[bytes, np.ndarray]], length: int) -> list[np.ndarray]:
    """Which windows of each shard stand in another: each sorted list is searched for in the others by halving.

    ``parts``: a shard's bytes and the places of its distinct windows, in their order.
    """
    found = [np.zeros(len(places), bool) for _, places in parts]
    for i, (data_i, places_i) in enumerate(parts):
        for j in range(i + 1, len(parts)):
            data_j, places_j = parts[j]
            if not len(places_i) or not len(places_j):
                continue
            x, y = np.frombuffer(data_i, np.uint8), np.frombuffer(data_j, np.uint8)
            low, high = np.zeros(len(places_i), np.int64), np.full(len(places_i), len(places_j), np.int64)
            equal = np.zeros(len(places_i), bool)
            place = np.zeros(len(places_i), np.int64)
            while True:
                live = np.flatnonzero((low < high) & ~equal)
                if not len(live):
                    break
                mid = (low[live] + high[live]) // 2
                sign = compare(x, places_i[live], y, places_j[mid], length)
                equal[live[sign == 0]] = True
                place[live[sign == 0]] = mid[sign == 0]
                low[live[sign > 0]] = mid[sign > 0] + 1
                high[live[sign < 0]] = mid[sign < 0]
            found[i] |= equal
            found[j][place[equal]] = True
    return found


def compare(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """-1, 0 or 1 for windows x[a:a+length] against y[b:b+length]."""
    out = np.zeros(len(a), np.int8)
    live = np.arange(len(a))
    for at in range(0, length, 16):
        cols = np.arange(at, min(length, at + 16))
        p, q = x[a[live][:, None] + cols], y[b[live][:, None] + cols]
        differ = p != q
        some = differ.any(1)
        k = differ.argmax(1)[some]
        out[live[some]] = np.where(p[some, k] < q[some, k], -1, 1)
        live = live[~some]
        if not len(live):
            break
    return out


def intervals(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal covered runs of window starts (sorted)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), (starts[np.concatenate((cut, [len(starts) - 1]))] + length).tolist(), strict=True))


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays of integers as one compressed value."""
    return squeeze(b"".join(len(a).to_bytes(8, "little") + np.ascontiguousarray(a, "<i8").tobytes() for a in arrays), 1)


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    data, at, out = expand(data), 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(np.frombuffer(data, "<i8", n, at + 8))
        at += 8 + 8 * n
    return out


def chunk_texts(payload: bytes) -> tuple[pa.Table, list[bytes], list[list[int]]]:
    """The chunk's rows, its distinct texts, and the rows of each."""
    rows = unpack_rows(payload)
    place: dict[bytes, list[int]] = {}
    for i, x in enumerate(rows.column("body").to_pylist()):
        place.setdefault((x or "").encode(), []).append(i)
    return rows, list(place), list(place.values())


def wound(texts: list[bytes], many: list[list[int]], length: int):
    """Of all texts: (text, first window, windows, anchor hash, copies) for each run; several places count as copies."""
    parts = []
    for t, x in enumerate(texts):
        if len(x) < length:
            continue
        first, value, several = anchors(np.frombuffer(x, np.uint8), length)
        count = np.diff(np.append(first, len(x) - length + 1))
        parts.append(np.stack([np.full(len(first), t), first, count, value.view(np.int64), len(many[t]) + several], 1))
    rows = np.concatenate(parts) if parts else np.zeros((0, 5), np.int64)
    return rows[np.argsort(rows[:, 3].view(np.uint64) if len(rows) else rows[:, 3], kind="stable")]


def range_cuts(hashes: np.ndarray, n: int) -> np.ndarray:
    starts = np.array([(i << 64) // n for i in range(n)], np.uint64)
    return np.append(np.searchsorted(hashes.view(np.uint64), starts), len(hashes))


def removed_rows(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, keep_text: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256, spans, and with ``keep_text`` the kept bytes as text."""
    spark = docs.sparkSession
    small_batches(spark)
    size = total_bytes(docs, text)
    # a task sorts one range after another, so tasks needn't be as many as ranges
    n_ranges, width = max(64, math.ceil(size / shard_bytes)), task_width(spark, 2 * size)
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("body"))
    kind = source.schema["key"].dataType.simpleString()
    chunks, _ = chunked(source, CHUNK_BYTES, "sa-chunks")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, texts, many = chunk_texts(payload)
                rows = wound(texts, many, length)
                cuts = range_cuts(rows[:, 3], n_ranges)
                live = [(r, a, b) for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in live], pa.int32()), pa.array([chunk] * len(live), pa.int64()), pa.array([pack_arrays(rows[a:b, 3], rows[a:b, 4]) for _, a, b in live], pa.binary())], names=["part", "chunk_id", "hashes"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            arrays = [unpack_arrays(h["hashes"]) for h in held]
            every, place = np.unique(np.concatenate([a[0] for a in arrays]), return_inverse=True)
            shared = np.bincount(place, np.concatenate([a[1] for a in arrays]), len(every)) > 1
            bounds = np.cumsum([len(a[0]) for a in arrays])[:-1]
            flags = np.split(shared[place], bounds)
            return pa.RecordBatch.from_arrays([pa.array([h["chunk_id"] for h in held], pa.int64()), pa.array([h["part"] for h in held], pa.int32()), pa.array([squeeze(np.packbits(f).tobytes() + len(f).to_bytes(8, "little"), 1) for f in flags], pa.binary()), pa.array([None] * len(held), pa.binary())], names=["chunk_id", "part", "answer", "payload"])

        held = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["part"] != row["part"]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    tallies = chunks.mapInArrow(lean(send), "part int, chunk_id long, hashes binary").repartition(min(n_ranges, 2 * width), "part").sortWithinPartitions("part")
    answers = tallies.mapInArrow(lean(count), "chunk_id long, part int, answer binary, payload binary")
    last = F.lit(2**31 - 1)

    def with_chunks(rows: DataFrame) -> DataFrame:
        """Each chunk's answers, followed by its payload."""
        both = rows.unionByName(chunks.select("chunk_id", last.alias("part"), F.lit(None).cast("binary").alias("answer"), "payload"))
        return both.repartition(width, "chunk_id").sortWithinPartitions("chunk_id", "part")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags: list[np.ndarray] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["payload"] is None:
                    raw = expand(row["answer"])
                    flags.append(np.unpackbits(np.frombuffer(raw[:-8], np.uint8))[: int.from_bytes(raw[-8:], "little")].astype(bool))
                    continue
                _, texts, many = chunk_texts(row["payload"])
                rows = wound(texts, many, length)
                rows = rows[np.concatenate(flags)] if flags else rows[:0]
                flags = []
                cuts = range_cuts(rows[:, 3], n_ranges)
                live = [(r, a, b) for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
                out = []
                for part, a, b in live:
                    # equal runs of the chunk are sent once, with their places
                    held: dict[tuple[int, bytes], list] = {}
                    for t, s, n, h, m in rows[a:b].tolist():
                        entry = held.setdefault((h, texts[t][s : s + n - 1 + length]), [n, 0, [], 0])
                        entry[1] += len(many[t])
                        entry[3] |= m > len(many[t])
                        entry[2] += [t, s]
                    entries = list(held.items())
                    head = pack_arrays(np.array([k[0] for k, _ in entries]), np.array([len(k[1]) for k, _ in entries]), np.array([v[0] for _, v in entries]), np.array([v[1] for _, v in entries]), np.array([len(v[2]) for _, v in entries]), np.array([x for _, v in entries for x in v[2]]), np.array([v[3] for _, v in entries]))
                    data = b"".join(k[1] for k, _ in entries)
                    out.append((part, len(data), len(head).to_bytes(8, "little") + head + squeeze(data, 1)))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in out], pa.int32()), pa.array([row["chunk_id"]] * len(out), pa.int64()), pa.array([s for _, s, _ in out], pa.int32()), pa.array([x for _, _, x in out], pa.binary())], names=["part", "chunk_id", "size", "runs"])

    sent, _ = written(with_chunks(answers).mapInArrow(lean(runs), "part int, chunk_id long, size int, runs binary"), "sa-runs")
    # a range with more bytes than a shard may hold is dealt over several by chunk
    sizes = sent.groupBy("part").agg(F.ceil(F.sum("size") / shard_bytes).cast("int").alias("shards"))
    dealt = sent.join(sizes, "part").withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.greatest(F.lit(1), "shards")).cast("int"))
    dealt = dealt.repartition(min(n_ranges, 4 * width), "part", "salt").sortWithinPartitions("part", "salt")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[0]["part"], held[0]["salt"]) != (row["part"], row["salt"]):
                    yield sorted_shard(held, length)
                    held = []
                held.append(row)
        if held:
            yield sorted_shard(held, length)

    columns = "part int, salt int, shards int, bytes binary, first binary, back binary, answers binary, chunk_ids array<long>"
    shards, _ = written(dealt.mapInArrow(lean(shard), columns), "sa-shards")
    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, answers, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield answers_batch(part, ids, unpack_arrays(answers))

    found = shards.select("part", "answers", "chunk_ids").mapInArrow(lean(opened), "chunk_id long, part int, answer binary, payload binary")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for row in batch.to_pylist():
                if held is None:
                    held = row
                    continue
                if (held["part"], held["low"], held["high"]) != (row["part"], row["low"], row["high"]):
                    raise ValueError("a shard lacks its partner")
                yield from merged_pair(held, row, length)
                held = None

    # pairs of shards of one range: the sorted windows of one are searched for in the other
    split = shards.filter("shards > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).filter("other <> salt")
    split = split.join(shards.filter("shards > 1").select("part", F.col("salt").alias("other")), ["part", "other"], "left_semi")
    split = split.select("part", F.least("salt", "other").alias("low"), F.greatest("salt", "other").alias("high"), "bytes", "first", "back", "chunk_ids")
    pairs = split.repartition(width, "part", "low", "high").sortWithinPartitions("part", "low", "high")
    across = pairs.mapInArrow(lean(merge), "chunk_id long, part int, answer binary, payload binary")

    extra = ", kept string" if keep_text else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["payload"] is None:
                    found.append(unpack_arrays(row["answer"])[0].reshape(-1, 3))
                    continue
                rows, texts, many = chunk_texts(row["payload"])
                all_ = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
                found = []
                all_ = all_[np.lexsort((all_[:, 1], all_[:, 0]))]
                bounds = np.searchsorted(all_[:, 0], np.arange(len(texts) + 1))
                out = [None] * rows.num_rows
                for t, x in enumerate(texts):
                    if len(many[t]) > 1 and len(x) >= length:
                        spans = [(0, len(x))]
                    else:
                        spans = []
                        for _, a, b in all_[bounds[t] : bounds[t + 1]].tolist():
                            if spans and a <= spans[-1][1]:
                                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                            else:
                                spans.append((a, b))
                    kept, last_ = [], 0
                    for a, b in spans:
                        kept.append(x[last_:a])
                        last_ = b
                    rest = b"".join([*kept, x[last_:]])
                    value = (len(x), len(x) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), spans, rest.decode("utf-8", "ignore") if keep_text else None)
                    for i in many[t]:
                        out[i] = value
                arrays = [rows.column("key").combine_chunks(), *(pa.array([o[c] for o in out], k) for c, k in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.string()])), pa.array([[{"start": a, "end": b} for a, b in o[4]] for o in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
                if keep_text:
                    arrays.append(pa.array([o[5] for o in out], pa.string()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    out = with_chunks(found.unionByName(across)).mapInArrow(lean(cut), f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>" + extra)
    return out.withColumnRenamed("key", key)


def sorted_shard(held: list[dict], length: int) -> pa.RecordBatch:
    """A shard's repeats, and its distinct windows in order for the comparison with others."""
    runs: dict[tuple[int, bytes], int] = {}
    periodic: set[int] = set()  # runs whose anchor stands at several places of a text
    windows, copies, owners = [], [], []  # owners of a run: (chunk number, places)
    for c, row in enumerate(held):
        raw = row["runs"]
        size = int.from_bytes(raw[:8], "little")
        hashes, lengths, counts, many, n_places, places, inner = unpack_arrays(raw[8 : 8 + size])
        data, at, p = expand(raw[8 + size :]), 0, 0
        for h, n, w, m, k, r in zip(hashes.tolist(), lengths.tolist(), counts.tolist(), many.tolist(), n_places.tolist(), inner.tolist(), strict=True):
            i = runs.setdefault((h, data[at : at + n]), len(runs))
            if r:
                periodic.add(i)
            if i == len(windows):
                windows.append(w)
                copies.append(0)
                owners.append([])
            copies[i] += m
            owners[i].append((c, places[p : p + k]))
            at, p = at + n, p + k
    chunk_ids = [row["chunk_id"] for row in held]
    several = held[0]["shards"] > 1
    # the only run of its anchor has nothing to be compared with but its copies, which are equal
    per_anchor = Counter(h for h, _ in runs)
    rest = [i for i, (h, _) in enumerate(runs) if several or per_anchor[h] > 1 or i in periodic]
    keys = list(runs)
    texts = [keys[i][1] for i in rest]
    flags = [np.full(w, m > 1) for w, m in zip(windows, copies, strict=True)]
    compared, firsts, offsets = repeated_starts(texts, [windows[i] for i in rest], [copies[i] > 1 for i in rest], length) if rest else ([], np.zeros(0, np.int64), np.zeros(1, np.int64))
    for i, f in zip(rest, compared, strict=True):
        flags[i] = f
    back = [(i, c, t, s) for i, own in enumerate(owners) for c, places in own for t, s in places.reshape(-1, 2).tolist()] if several else []
    answers = spread(flags, owners, len(held), length)
    blob = b"".join(texts) if several else b""
    return pa.RecordBatch.from_arrays(
        [pa.array([held[0]["part"]], pa.int32()), pa.array([held[0]["salt"]], pa.int32()), pa.array([held[0]["shards"]], pa.int32()), pa.array([squeeze(blob, 1)], pa.binary()), pa.array([pack_arrays(firsts if several else firsts[:0], offsets, np.array(windows))], pa.binary()), pa.array([pack_arrays(np.array(back, np.int64).ravel())], pa.binary()), pa.array([pack_arrays(*answers)], pa.binary()), pa.array([chunk_ids], pa.list_(pa.int64()))],
        names=["part", "salt", "shards", "bytes", "first", "back", "answers", "chunk_ids"],
    )


def spread(flags: list[np.ndarray], owners: list, n_chunks: int, length: int) -> list[np.ndarray]:
    """Covered intervals of each chunk's texts: flattened (text, start, end)."""
    out: list[list[int]] = [[] for _ in range(n_chunks)]
    for flag, own in zip(flags, owners, strict=True):
        spans = intervals(np.flatnonzero(flag), length)
        if spans:
            for c, places in own:
                for t, s in places.reshape(-1, 2).tolist():
                    for a, b in spans:
                        out[c] += [t, s + a, s + b]
    return [np.array(x, np.int64) for x in out]


def answers_batch(part: int, chunk_ids: list[int], arrays: list[np.ndarray]) -> pa.RecordBatch:
    live = [(c, a) for c, a in zip(chunk_ids, arrays, strict=True) if len(a)]
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in live], pa.int64()), pa.array([part] * len(live), pa.int32()), pa.array([pack_arrays(a) for _, a in live], pa.binary()), pa.array([None] * len(live), pa.binary())], names=["chunk_id", "part", "answer", "payload"])


def merged_pair(x: dict, y: dict, length: int) -> Iterator[pa.RecordBatch]:
    """What two shards of a range share, as intervals of both."""
    sides = []
    for row in (x, y):
        first, offsets, windows = unpack_arrays(row["first"])
        sides.append((expand(row["bytes"]), first, offsets, windows, unpack_arrays(row["back"])[0].reshape(-1, 4), row["chunk_ids"]))
    found = merge_shards([(s[0], s[1]) for s in sides], length)
    for (data, first, offsets, _windows, back, chunk_ids), hit in zip(sides, found, strict=True):
        # a window class stands wherever its bytes do: mark every place of the shard that equals a hit
        places = same_windows(data, offsets, _windows, first[hit], length)
        run = np.searchsorted(offsets, places, "right") - 1
        out: list[list[int]] = [[] for _ in chunk_ids]
        order = np.argsort(run, kind="stable")
        run, places = run[order], places[order]
        begin = np.searchsorted(back[:, 0], run)
        end = np.searchsorted(back[:, 0], run, "right")
        for r, p, a, b in zip(run.tolist(), places.tolist(), begin.tolist(), end.tolist(), strict=True):
            for _, c, t, s in back[a:b].tolist():
                out[c] += [t, s + p - int(offsets[r]), s + p - int(offsets[r]) + length]
        yield answers_batch(x["part"], chunk_ids, [np.array(o, np.int64) for o in out])


def same_windows(data: bytes, offsets: np.ndarray, windows: np.ndarray, hits: np.ndarray, length: int) -> np.ndarray:
    """All window starts whose bytes equal those at a hit."""
    wanted = {data[h : h + length] for h in hits.tolist()}
    if not wanted:
        return np.zeros(0, np.int64)
    return np.array([p for o, w in zip(offsets[:-1].tolist(), windows.tolist(), strict=True) for p in range(o, o + w) if data[p : p + length] in wanted], np.int64)


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The digest columns: key, n_bytes, n_removed, n_spans, kept_sha256."""
    return removed_rows(docs, **options).drop("spans")


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Documents without their repeated bytes; a character cut in two goes entirely.

    All columns of ``docs`` are kept; ``text`` alone changes, and a null stays null.
    """
    others = [c for c in docs.columns if c != text]
    packed = docs.select(F.struct(F.struct(*[F.col(f"`{c}`") for c in others]).alias("own"), F.col(text).isNull().alias("none")).alias("key"), F.col(text).alias("body"))
    out = removed_rows(packed, key="key", text="body", length=length, keep_text=True)
    body = F.when(~F.col("key.none"), F.col("kept")).alias(text)
    return out.select(*[body if c == text else F.col(f"key.own.`{c}`").alias(c) for c in docs.columns])
