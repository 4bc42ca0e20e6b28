"""N-gram Jaccard self-join by token-combination prefixes.

A document's set holds its distinct shingles of ``WORDS`` words.  Two documents link when the
intersection is at least ``PERCENT`` percent of the union; the result is exact.

1.  Shingles fall into classes by how many sets hold them, counted over all documents: single
    (one set), rare (up to ``RARE``) and frequent.  A set with more singles than a link may miss
    can link with nothing and is left out before any candidate is made.
2.  A set's shingles are ordered singles, rare, frequent, each by hash.  Sets of ``n`` that link
    share a shingle among the first ``n - ceil(0.75 n) + 1``, and ``k`` among the first
    ``n - ceil(0.75 n) + k``.  Rare shingles of the prefix are indexed one by one.  If the first
    shared one is frequent, all shared ones are, so the frequent shingles of the prefix extended
    by ``k = 2`` are indexed in pairs; a set with more than ``COMBINED`` of them indexes them
    singly, and then the others' single ones only probe for such sets.
3.  Each list's first set is compared with the others (dense groups connect so).  What lists of up
    to ``SHORT`` sets still hold of different components is paired within the list, so pairs grow
    with the input; longer lists are joined to one for each smallest set, as near copies share
    hundreds, and compared in blocks.  Comparisons are exact.
4.  Components of the verified links are found on set keys; equal sets are one from the start.

Shingles and sets are known by 64-bit hashes throughout.

Defined results: null, empty and blank texts have no shingles and link with nothing, not even
with each other, so their component is their own id; texts of fewer words have one shingle;
repeated rows and equal sets are one component; rows with a null id take part, but a component's
name is the smallest non-null id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.llm.common import BLANK_WORDS, HOT_KEYS, byte_words, chunked, drop_path, expand, free_shuffles, lean, looked_up, mix, small_batches, squeeze, task_width, total_bytes, unpack_rows, written
from tsumugi.llm.urls import components

WORDS, PERCENT = 5, 75
RARE, COMBINED = 64, 40
#: Lists of so many sets are paired one by one, longer ones in blocks.
SHORT = 64
#: Sets of a block, and shingles counted at once.
BLOCK, COLUMNS = 256, 4096
#: From so many pairs a set on, a block pair is compared as a whole.
DENSE = 2
LIKELY = pa.schema([("block", pa.string()), ("block2", pa.string()), ("side", pa.int32()), ("c", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
CHUNK_BYTES, RANGE_BYTES, DEAL_BYTES = 2 << 20, 8 << 20, 16 << 20
#: Rows from which a text's copies may be dealt apart.
MANY_COPIES = 100
PAIR_SALT, SINGLE_SALT = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    split = [byte_words(x, BLANK_WORDS) for x in texts]
    known: set[bytes] = set()
    for w in split:
        known.update(w)
    hashes = {w: xxhash.xxh3_64_intdigest(w) for w in known}
    get, out = hashes.__getitem__, []
    for w in split:
        h = np.fromiter(map(get, w), np.uint64, len(w))
        if len(h) > words:
            s = h[: len(h) - words + 1].copy()
            for i in range(1, words):
                s = s * FACTOR + h[i : len(h) - words + 1 + i]
            out.append(np.unique(mix(s)))
        elif len(h):
            s = np.zeros(1, np.uint64)
            for x in h:
                s = s * FACTOR + x
            # fewer words are a sequence of their own kind
            out.append(mix(s if len(h) == words else s ^ np.uint64(len(h))))
        else:
            out.append(h)
    return out


def least_overlap(n: int) -> int:
    return -(-PERCENT * n // 100)


def linked(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (n_a + n_b - both)


def chunk_sets(payload: bytes):
    """The chunk's rows, its distinct sets, each row's set (-1: none), and all sets' hashes joined and sorted."""
    rows = unpack_rows(payload)
    texts = [(x or "").encode() for x in rows.column("body").to_pylist()]
    distinct = list(dict.fromkeys(texts))
    sets = shingle_sets(distinct)
    place: dict[int, int] = {}
    kept, of_text = [], {}
    for t, s in zip(distinct, sets, strict=True):
        if not len(s):
            of_text[t] = -1
            continue
        key = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
        if key not in place:
            place[key] = len(kept)
            kept.append(s)
        of_text[t] = place[key]
    joined = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
    order = np.argsort(joined)
    return rows, list(place), kept, [of_text[t] for t in texts], joined[order], order


def delta(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values.astype("<u4"), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def undelta(data: bytes) -> np.ndarray:
    raw = np.frombuffer(expand(data), np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(raw).view("<u4").ravel(), dtype=np.uint32)


def prefix_entries(hashes: np.ndarray, classes: np.ndarray, n: int) -> list[tuple[np.ndarray, int]]:
    """(tokens, role) to index for a set of ``n`` shingles of which ``hashes`` (shared ones) are given with their classes.

    Role 1 pairs with everything in its list, role 0 only with role 1.
    """
    singles = n - len(hashes)
    budget = n - least_overlap(n) + 1 - singles
    if budget <= 0:
        return []
    rare, frequent = hashes[classes == 1], hashes[classes == 2]
    out = [(rare[:budget], 1)]
    if len(rare) >= budget or not len(frequent):
        return out
    head = frequent[: budget - len(rare)]
    longer = frequent[: budget - len(rare) + 1]
    if least_overlap(n) < 2:
        out.append((mix(head ^ SINGLE_SALT), 1))
        return out
    if len(longer) > COMBINED:
        out.append((mix(head ^ SINGLE_SALT), 1))
        return out
    i, j = np.triu_indices(len(longer), 1)
    out.append((mix(longer[i] * FACTOR + longer[j] ^ PAIR_SALT), 1))
    out.append((mix(head ^ SINGLE_SALT), 0))
    return out


def by_text(rows: DataFrame, tasks: int) -> DataFrame:
    """``rows`` (key, body) with equal texts side by side, so that a chunk knows their set once.

    Else each chunk with a copy would count, send and keep it anew.  A text with more than a
    thousandth of all rows is dealt out by key and known once a task.
    """
    hashed = rows.withColumn("h", F.xxhash64("body"))
    many = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > max(rows.count() // HOT_KEYS, MANY_COPIES)).select(F.col("h").alias("many"))
    away = F.when(F.col("many").isNotNull(), F.xxhash64("key")).otherwise(F.lit(0).cast("long"))
    marked = hashed.join(F.broadcast(many), F.col("h") == F.col("many"), "left").withColumn("away", away)
    return marked.repartition(tasks, "h", "away").sortWithinPartitions("h").select("key", "body")


def components_of(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, one row per document."""
    spark = docs.sparkSession
    small_batches(spark)
    size = total_bytes(docs, text)
    bits, width = max(6, math.ceil(math.log2(max(1, size / RANGE_BYTES)))), task_width(spark, size)
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("body"))
    kind = source.schema["key"].dataType.simpleString()
    chunks, chunk_path = chunked(by_text(source, max(4, -(-size // DEAL_BYTES))), CHUNK_BYTES, "jaccard-chunks")
    free_shuffles(spark)

    def ranges(hashes: np.ndarray):
        starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        cuts = np.append(np.searchsorted(hashes, starts), len(hashes)).tolist()
        return [(r, a, b) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                *_, hashes, _ = chunk_sets(payload)
                marks = (hashes >> np.uint64(32 - bits)).astype(np.uint32)
                live = ranges(hashes)
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in live], pa.int32()), pa.array([chunk] * len(live), pa.int64()), pa.array([delta(marks[a:b]) for _, a, b in live], pa.binary())], names=["part", "chunk_id", "marks"])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            arrays = [undelta(h["marks"]) for h in held]
            _, place, counts = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
            codes = np.where(counts == 1, 0, np.where(counts <= RARE, 1, 2)).astype(np.uint8)[place]
            parts = np.split(codes, np.cumsum([len(a) for a in arrays])[:-1])
            return pa.RecordBatch.from_arrays([pa.array([h["chunk_id"] for h in held], pa.int64()), pa.array([h["part"] for h in held], pa.int32()), pa.array([squeeze(p.tobytes(), 1) for p in parts], pa.binary()), pa.array([None] * len(held), pa.binary())], names=["chunk_id", "part", "answer", "payload"])

        held = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["part"] != row["part"]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    counted = chunks.mapInArrow(lean(send), "part int, chunk_id long, marks binary").repartition(min(1 << bits, 2 * width), "part").sortWithinPartitions("part").mapInArrow(lean(classify), "chunk_id long, part int, answer binary, payload binary")
    both = counted.unionByName(chunks.select("chunk_id", F.lit(2**31 - 1).alias("part"), F.lit(None).cast("binary").alias("answer"), "payload"))
    both = both.repartition(width, "chunk_id").sortWithinPartitions("chunk_id", "part")

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: list[np.ndarray] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["payload"] is None:
                    codes.append(np.frombuffer(expand(row["answer"]), np.uint8))
                    continue
                rows, keys, sets, of_row, _, order = chunk_sets(row["payload"])
                classes = np.empty(len(order), np.uint8)
                classes[order] = np.concatenate(codes) if codes else np.zeros(0, np.uint8)
                codes, at, own = [], 0, []
                for k, s in zip(keys, sets, strict=True):
                    c = classes[at : at + len(s)]
                    at += len(s)
                    shared = c > 0
                    if shared.sum() >= least_overlap(len(s)):
                        own.append((k, len(s), s[shared].astype("<u8").tobytes(), c[shared].tobytes()))
                n = rows.num_rows
                names = ["kind", "key", "n", "set_key", "hashes", "classes"]
                yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), rows.column("key").combine_chunks(), pa.array([len(sets[i]) if i >= 0 else 0 for i in of_row], pa.int64()), pa.array([keys[i] if i >= 0 else None for i in of_row], pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.nulls(n, rows.column("key").type), pa.array([o[1] for o in own], pa.int64()), pa.array([o[0] for o in own], pa.int64()), pa.array([o[2] for o in own], pa.binary()), pa.array([o[3] for o in own], pa.binary())], names=names)

    found, found_path = written(both.mapInArrow(lean(survivors), f"kind int, key {kind}, n long, set_key long, hashes binary, classes binary"), "jaccard-sets")
    drop_path(spark, chunk_path)
    free_shuffles(spark)
    rows = found.filter("kind = 0").select("key", "n", "set_key")
    # a set of several chunks is the same in each, classes included
    sets = found.filter("kind = 1").select("set_key", "n", "hashes", "classes")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, owners, sizes, roles = [], [], [], []
            for k, n, h, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for t, role in prefix_entries(np.frombuffer(h, "<u8"), np.frombuffer(c, np.uint8), n):
                    tokens.append(t.view(np.int64))
                    owners += [k] * len(t)
                    sizes += [n] * len(t)
                    roles += [role] * len(t)
            if owners:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(owners, pa.int64()), pa.array(sizes, pa.int64()), pa.array(roles, pa.int32())], names=["token", "set_key", "n", "role"])

    posted, posted_path = written(sets.mapInArrow(lean(entries), "token long, set_key long, n long, role int").distinct(), "jaccard-lists")
    lists = posted.groupBy("token").agg(F.min(F.when(F.col("role") == 1, F.col("set_key"))).alias("lead"), F.max("set_key").alias("top"), F.min("set_key").alias("low")).filter("lead is not null and top <> low").select("token", "lead")
    sizes = posted.select("set_key", "n").distinct()
    led = posted.join(lists, "token").filter("set_key <> lead").select("lead", "set_key", "n").distinct()
    led = led.join(sizes.select(F.col("set_key").alias("lead"), F.col("n").alias("m")), "lead").filter(F.least("n", "m") * 100 >= F.greatest("n", "m") * PERCENT).select(F.col("lead").alias("a"), F.col("set_key").alias("b"))
    single, single_path = written(sets.select("set_key", "n", "hashes").dropDuplicates(["set_key"]), "jaccard-distinct")
    sketches, sketch_path = written(sketched(single), "jaccard-sketches")
    led, led_path = written(not_ruled_out(led, sketches), "jaccard-likely")
    first, first_path = written(verified(led, single), "jaccard-links")
    drop_path(spark, led_path)
    free_shuffles(spark)
    groups = components(first, src="a", dst="b")
    # lists without a role 1 pair nothing
    named = posted.join(lists, "token").join(groups, posted.set_key == groups.node, "left").select("token", "set_key", "n", "role", F.coalesce("component", "set_key").alias("c"))
    open_ = named.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("held"), F.min("set_key").alias("least")).filter("c0 <> c1").select("token", "held", "least")
    rest, rest_path = written(named.join(open_, "token"), "jaccard-open")
    drop_path(spark, posted_path)
    close, close_path = written(not_ruled_out(list_pairs(rest.filter(F.col("held") <= SHORT)), sketches), "jaccard-likely")
    across, across_path = written(verified(close, single), "jaccard-links")
    free_shuffles(spark)
    # a set has a row for each smallest set it shares a list with, not for each list
    long_, long_path = written(rest.filter(F.col("held") > SHORT).select(F.col("least").alias("token"), "set_key", "n", "c").distinct(), "jaccard-long")
    blocks, block_path = written(linked_blocks(long_, single, sketches, width), "jaccard-links")
    second = across.unionByName(blocks)
    groups = components(first.unionByName(second), src="a", dst="b") if not second.isEmpty() else groups
    groups, groups_path = written(groups, "jaccard-groups")
    joined = rows.join(groups, rows.set_key == groups.node, "left").select("key", "n", F.coalesce("component", "set_key").alias("g"))
    joined, _ = written(joined, "jaccard-rows")
    for path in (found_path, single_path, sketch_path, first_path, rest_path, close_path, across_path, long_path, block_path, groups_path):
        drop_path(spark, path)
    free_shuffles(spark)
    least, _ = written(joined.filter("g is not null").groupBy("g").agg(F.min("key").alias("component_id"), F.count(F.lit(1)).alias("members")), "jaccard-least")
    out = looked_up(joined, least, "g", "members", "key")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("g").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"))


def list_pairs(lists: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets of different components ``c`` that share a list and fit in size."""
    side = lambda x: lists.select("token", F.col("set_key").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "role", "c")])
    a, b = side("a"), side("b")
    fit = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT
    return a.join(b, (a["token"] == b["token"]) & (F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & (F.greatest("role_a", "role_b") == 1) & fit).select("a", "b").distinct()


def linked_blocks(lists: DataFrame, sets: DataFrame, sketches: DataFrame, width: int = 24) -> DataFrame:
    """Links (a, b) between sets of different components ``c`` that share a list.

    Sets that lists connect form groups, dealt over blocks of about ``BLOCK`` sets: a large
    component has blocks of its own, sets with the same first neighbour stay together.  Two blocks
    that share a list and hold several components are compared at once: first by bitmaps, which
    bound what two sets can share; then the few pairs left are compared one by one, or, where
    many are left, the blocks' sets together, by counting shared shingles.  A block holds sets of
    one band of sizes and meets those of its own and the next bands only: others can't link.
    """
    ends = lists.groupBy("token").agg(F.min("set_key").alias("lead"))
    stars = lists.join(ends, "token").select(F.col("lead").alias("a"), F.col("set_key").alias("b")).distinct()
    stars, _ = written(stars, "jaccard-stars")
    groups = components(stars, src="a", dst="b").select(F.col("node").alias("set_key"), F.col("component").alias("k"))
    near = stars.groupBy(F.col("b").alias("set_key")).agg(F.min("a").alias("lead"))
    band = F.floor(F.log("n") / math.log(100 / PERCENT)).alias("band")
    own = lists.select("set_key", "c", band).distinct().join(groups, "set_key").join(near, "set_key")
    sizes = own.groupBy("k", "band", "c").agg(F.count(F.lit(1)).alias("size"))
    small = F.col("size") < BLOCK // 2
    pools = sizes.groupBy("k", "band").agg(F.ceil(F.sum(F.when(small, F.col("size")).otherwise(0)) / BLOCK).cast("int").alias("pools"))
    placed = own.join(sizes, ["k", "band", "c"]).join(pools, ["k", "band"])
    pool = F.concat(F.col("k").cast("string"), F.lit(" "), F.col("band").cast("string"), F.lit(" "), F.pmod(F.xxhash64("lead"), F.greatest(F.lit(1), "pools")).cast("string"))
    part = F.concat(F.col("k").cast("string"), F.lit(" "), F.col("band").cast("string"), F.lit(" "), F.col("c").cast("string"), F.lit(" "), F.pmod(F.xxhash64("set_key"), F.ceil(F.col("size") / BLOCK)).cast("string"))
    placed, _ = written(placed.select("c", "set_key", "band", F.when(small, pool).otherwise(part).alias("own"), F.when(small, F.lit("")).otherwise(F.col("c").cast("string")).alias("whole")), "jaccard-blocks")
    met = lists.select("token", "set_key").join(placed, "set_key").groupBy("token").agg(F.array_sort(F.collect_set(F.struct("own", "whole", "band"))).alias("m")).select("m").distinct()
    # blocks of one large component need no comparison
    both = F.expr("flatten(transform(m, x -> transform(filter(m, y -> x.own <= y.own and abs(x.band - y.band) <= 1 and (x.whole <> y.whole or x.whole = '')), y -> struct(x.own as block, y.own as block2))))")
    pairs = met.select(F.explode(both).alias("p")).select("p.*").distinct()
    sides = pairs.select(F.col("block").alias("own"), "block", "block2", F.lit(0).alias("side")).unionByName(pairs.filter("block <> block2").select(F.col("block2").alias("own"), "block", "block2", F.lit(1).alias("side")))
    rows = placed.select("own", "c", "set_key").join(sketches, "set_key").join(sides, "own").select("block", "block2", "side", "c", "set_key", "n", "shared", "marks")
    rows = rows.repartition(width, "block", "block2").sortWithinPartitions("block", "block2")
    likely, _ = written(rows.mapInArrow(lean(lambda batches: by_block(batches, proposed)), "block string, block2 string, side int, c long, a long, b long"), "jaccard-likely")
    few = verified(likely.filter("b is not null").select("a", "b"), sets)
    many = likely.filter("b is null").select("block", "block2", "side", "c", F.col("a").alias("set_key")).join(sets, "set_key").select("block", "block2", "side", "c", "set_key", "n", "hashes")
    many = many.repartition(width, "block", "block2").sortWithinPartitions("block", "block2")
    return few.unionByName(many.mapInArrow(lean(lambda batches: by_block(batches, compared)), "a long, b long"))


def by_block(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """``work`` on the rows of each block pair, which come one after another."""
    held, at = [], None
    for batch in batches:
        for row in batch.to_pylist():
            now = (row["block"], row["block2"])
            if held and now != at:
                yield work(held)
                held = []
            at = now
            held.append(row)
    if held:
        yield work(held)


def sketched(sets: DataFrame) -> DataFrame:
    """set_key, n, shared (shingles that other sets have) and marks, the bitmap of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.frombuffer(h, "<u8") for h in batch.column(2).to_pylist()]
            marks = [bitmap(h, n) for n, h in zip(batch.column(1).to_pylist(), hashes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(h) for h in hashes], pa.int64()), pa.array(marks, pa.binary())], names=["set_key", "n", "shared", "marks"])

    return sets.select("set_key", "n", "hashes").mapInArrow(lean(run), "set_key long, n long, shared long, marks binary")


def not_ruled_out(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that may link by their bitmaps."""
    side = lambda x: sketches.select(F.col("set_key").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "shared", "marks")])
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "shared_a", "marks_a", "n_b", "shared_b", "marks_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, s, x, m, t, y in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                x, y = (np.unpackbits(np.frombuffer(b, np.uint8)) for b in (x, y))
                size = min(len(x), len(y))
                x, y = (b.reshape(-1, size).max(0) for b in (x, y))
                common = int((x & y).sum())
                most = min(s - int(x.sum()) + common, t - int(y.sum()) + common)
                keep.append(100 * most >= PERCENT * (n + m - most))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(lean(run), "a long, b long")


def bitmap(hashes: np.ndarray, n: int) -> bytes:
    """A bit for each shared shingle, in twice as many bits as the set has shingles or more."""
    size = 1 << max(6, (2 * n - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(hashes & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def proposed(rows: list[dict]) -> pa.RecordBatch:
    """Pairs of different components that their bitmaps don't rule out; of a dense block pair its sets.

    Bits of one set that the other lacks are shingles that it misses, at the least.
    """
    same = rows[0]["block"] == rows[0]["block2"]
    n = np.array([r["n"] for r in rows])
    side = np.array([r["side"] for r in rows])
    _, c = np.unique([r["c"] for r in rows], return_inverse=True)
    bits = [np.unpackbits(np.frombuffer(r["marks"], np.uint8)) for r in rows]
    size = np.array([len(b) for b in bits])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for p in np.unique(size).tolist():
        # bitmaps of this size, and the next ones folded to it; sets of other sizes can't link
        one, two = np.flatnonzero(size == p), np.flatnonzero(size == 2 * p)
        x = np.stack([bits[i] for i in one]).astype(np.float32)
        for other in (one, two):
            if not len(other):
                continue
            y = x if other is one else np.stack([bits[i].reshape(2, p).max(0) for i in other]).astype(np.float32)
            both = x @ y.T
            n_x, n_y = n[one][:, None], n[other][None, :]
            shared_x, shared_y = np.array([rows[i]["shared"] for i in one])[:, None], np.array([rows[i]["shared"] for i in other])[None, :]
            most = np.minimum(shared_x - (x.sum(1)[:, None] - both), shared_y - (y.sum(1)[None, :] - both))
            ok = (100 * most >= PERCENT * (n_x + n_y - most)) & (c[one][:, None] != c[other][None, :])
            if not same:
                ok &= side[one][:, None] != side[other][None, :]
            if other is one:
                ok = np.triu(ok, 1)
            i, j = np.nonzero(ok)
            found.append((one[i], other[j]))
    i = np.concatenate([f[0] for f in found])
    j = np.concatenate([f[1] for f in found])
    if len(i) > DENSE * len(rows):
        own = np.unique(np.concatenate([i, j])).tolist()
        return pa.RecordBatch.from_pylist([{"block": r["block"], "block2": r["block2"], "side": r["side"], "c": r["c"], "a": r["set_key"], "b": None} for r in (rows[k] for k in own)], schema=LIKELY)
    return pa.RecordBatch.from_pylist([{"a": rows[k]["set_key"], "b": rows[m]["set_key"]} for k, m in zip(i.tolist(), j.tolist(), strict=True)], schema=LIKELY)


def compared(rows: list[dict]) -> pa.RecordBatch:
    """A link for each two components of the block pair that have one."""
    now_self = rows[0]["block"] == rows[0]["block2"]
    tokens = [np.frombuffer(r["hashes"], "<u8") for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(t) for t in tokens])
    _, column, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    keep = counts[column] > 1
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner = owner[order]
    column = np.cumsum(np.diff(column[order], prepend=column[order][:1]) > 0)
    both = np.zeros((len(rows), len(rows)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        matrix = np.zeros((len(rows), COLUMNS), np.float32)
        matrix[owner[a:b], column[a:b] - at] = 1
        both += matrix @ matrix.T
    n = np.array([r["n"] for r in rows])
    _, c = np.unique([r["c"] for r in rows], return_inverse=True)
    side = np.array([r["side"] for r in rows])
    ok = (100 * both >= PERCENT * (n[:, None] + n[None, :] - both)) & (c[:, None] < c[None, :])
    if not now_self:
        ok &= side[:, None] != side[None, :]
    i, j = np.nonzero(ok)
    first = np.unique(c[i] * (c.max(initial=0) + 1) + c[j], return_index=True)[1]
    return pa.RecordBatch.from_arrays([pa.array([rows[x]["set_key"] for x in i[first]], pa.int64()), pa.array([rows[x]["set_key"] for x in j[first]], pa.int64())], names=["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set keys that link, compared shingle by shingle.

    Singles are in no other set, so the shared shingles and the sizes decide.
    """
    one = pairs.join(sets.select(F.col("set_key").alias("a"), F.col("n").alias("n_a"), F.col("hashes").alias("h_a")), "a")
    both = one.join(sets.select(F.col("set_key").alias("b"), F.col("n").alias("n_b"), F.col("hashes").alias("h_b")), "b").select("a", "b", "n_a", "h_a", "n_b", "h_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)
            keep = [linked(np.frombuffer(x, "<u8"), n, np.frombuffer(y, "<u8"), m) for n, x, m, y in rows]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(lean(run), "a long, b long")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without near copies: of each component the row with the smallest id stays.

    All columns are kept; rows are known by id and content, so an id that other texts share takes
    none of them along, and of rows that repeat both, one stays.  Rows with a null id, and those
    without shingles, stand for themselves and stay.
    """
    # a document's own columns travel in one, so their names clash with none used here
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(key).alias("id"), F.col(text).alias("body"))
    hashed = packed.withColumn("hash", F.xxhash64("body"))
    # null where the id is null; both fields nullable, as in the batches that come back
    held = F.col("id").isNotNull()
    named = hashed.select(F.when(held, F.struct("id", F.when(held, F.col("hash")).alias("hash"))).alias("row"), "body")
    found = components_of(named, key="row", text="body").filter((F.col("n_shingles") > 0) & F.col("row").isNotNull() & (F.col("row") != F.col("component_id"))).select(F.col("row.id").alias("gone"), F.col("row.hash").alias("copy")).distinct()
    kept = hashed.join(found, (hashed["id"] == found["gone"]) & (hashed["hash"] == found["copy"]), "left_anti")
    first = F.expr("row_number() over (partition by id, hash order by hash)")
    return kept.withColumn("n", first).filter((F.col("n") == 1) | F.col("id").isNull()).select("doc.*")
