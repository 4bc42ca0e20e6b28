"""Language-model scores by subword lattices.

The pieces of an existing vocabulary are the arcs of a word's lattice; a word's probability is
the sum over all its segmentations, by forward recursion in log space, and a document's is the
product over its words and one end.  A word is spelled with the vocabulary's leading mark, and
every byte can also be spelled by a fallback piece, so every text has a probability.  Piece
probabilities start from the vocabulary's own scores (its ranks, read as a Zipf law) and are
re-estimated by expectation-maximisation from all training words, every step taking all of them.

Counts are exact over all documents.  Tasks pack the distinct words of a chunk by hash range;
one task per range sums them, and sends each chunk the counts and probabilities of its words.

Defined results: null and empty texts have the end alone; repeated rows count as often as they
occur; without training documents N and V are 0 and the base score is finite all the same;
rows with a null id train (no remainder is 0) and are not held out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.llm.common import BLANK_WORDS, byte_words, chunked, drop_path, expand, small_batches, squeeze, task_width, total_bytes, unpack_rows, written

CHUNK_BYTES, RANGE_BYTES = 4 << 20, 8 << 20
MARK = "▁".encode()
#: Uses that each piece has besides those counted; steps of the re-estimation.
SMOOTH, STEPS = 0.1, 3
#: Words whose lattices are computed together.
BLOCK = 1 << 14
END = b"\n"  # no word holds a line feed
SHIFT = 2.7  # of the Zipf law


class Pieces:
    """The vocabulary as a byte trie in sorted arrays, and its initial log probabilities."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        usual = [i for i in range(n) if not (model.is_byte(i) or model.is_unknown(i) or model.is_control(i))]
        usual.sort(key=lambda i: (-model.get_score(i), i))
        lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
        ranks: dict[bytes, float] = {}
        for r, i in enumerate(usual):
            piece = lower(model.id_to_piece(i)).encode()
            ranks[piece] = ranks.get(piece, 0.0) + 1 / (r + SHIFT)
        for b in range(256):  # the fallback: any byte by itself, as rare as the last rank
            ranks[bytes([b])] = ranks.get(bytes([b]), 0.0) + 1 / (n + SHIFT)
        self.texts = list(ranks)
        self.longest = max(map(len, self.texts))
        weights = np.array(list(ranks.values()))
        self.logs = np.log(weights / weights.sum())
        children: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i, t in enumerate(self.texts):
            s = 0
            for b in t:
                s = children.setdefault((s, b), len(children) + 1)
            ends[s] = i
        keys = np.array([s << 8 | b for s, b in children], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(children.values()), np.int64)[order]
        self.piece = np.full(len(children) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())
        # the first byte is a table, and so are two bytes
        self.first = np.full(256, -1, np.int64)
        for (s, b), t in children.items():
            if s == 0:
                self.first[b] = t

    def step(self, states: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        keys = states << 8 | bytes_
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.next[at], -1)

    def arcs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(offsets of words, arc starts, arc ends, pieces) in the joined, marked words."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + len(MARK)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.frombuffer(MARK + MARK.join(words), np.uint8).astype(np.int64)
        stop = np.repeat(offsets[1:], sizes)
        at = np.arange(len(flat))
        state = self.first[flat]
        starts, ends, pieces = [], [], []
        depth = 1
        while len(at):
            own = self.piece[state]
            hit = own >= 0
            starts.append(at[hit])
            ends.append(at[hit] + depth)
            pieces.append(own[hit])
            more = at + depth < stop[at]
            at, state = at[more], state[more]
            state = self.step(state, flat[at + depth])
            alive = state >= 0
            at, state = at[alive], state[alive]
            depth += 1
        return offsets, np.concatenate(starts), np.concatenate(ends), np.concatenate(pieces)

    def forward(self, words: list[bytes], logs: np.ndarray, counts: np.ndarray | None = None):
        """Each word's marginal log probability; with ``counts`` also the expected uses of the pieces."""
        if not words:
            return np.zeros(0), np.zeros(len(self.texts))
        offsets, start, end, piece = self.arcs(words)
        base = np.repeat(offsets[:-1], np.diff(offsets))
        depth = end - base[start]  # place of the end in its word
        order = np.argsort(depth, kind="stable")
        start, end, piece, depth = start[order], end[order], piece[order], depth[order]
        cuts = np.flatnonzero(np.diff(depth)) + 1
        # a place's value: alpha of (word, place); place 0 of each word is 1
        n = len(words)
        slots = offsets[-1] + n
        word = np.repeat(np.arange(n), np.diff(offsets))
        slot = lambda pos, w: pos + w  # noqa: E731  words have one place more than bytes
        own = word[start]
        a, b = slot(start, own), slot(end, own)
        alpha = np.full(slots, -np.inf)
        alpha[offsets[:-1] + np.arange(n)] = 0.0
        weight = logs[piece]
        spans = [(int(x), int(y)) for x, y in zip([0, *cuts], [*cuts, len(start)], strict=True)]
        for x, y in spans:
            self.add_up(alpha, b[x:y], alpha[a[x:y]] + weight[x:y])
        total = alpha[offsets[1:] + np.arange(n)]
        if counts is None:
            return total, None
        beta = np.full(slots, -np.inf)
        beta[offsets[1:] + np.arange(n)] = 0.0
        back = np.argsort(-(start - base[start]), kind="stable")
        far = (start - base[start])[back]
        cuts = np.flatnonzero(np.diff(far)) + 1
        for x, y in zip([0, *cuts], [*cuts, len(back)], strict=True):
            rows = back[x:y]
            self.add_up(beta, a[rows], beta[b[rows]] + weight[rows])
        uses = np.exp(alpha[a] + weight + beta[b] - total[own]) * counts[own]
        return total, np.bincount(piece, uses, len(self.texts))

    @staticmethod
    def add_up(into: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        """into[at] = log(exp(into[at]) + sum of exp(values)), places repeated."""
        order = np.argsort(at, kind="stable")
        at, values = at[order], values[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        top = np.maximum.reduceat(values, first)
        safe = np.where(top > -np.inf, top, 0.0)
        lengths = np.diff(np.append(first, len(at)))
        sums = np.log(np.maximum(np.add.reduceat(np.exp(values - np.repeat(safe, lengths)), first), 1e-300)) + safe
        into[at[first]] = np.logaddexp(into[at[first]], np.where(top > -np.inf, sums, -np.inf))

    def all_forward(self, words: list[bytes], logs: np.ndarray, counts: np.ndarray | None = None):
        """The same, in blocks of words of alike length."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        total, uses = np.zeros(len(words)), np.zeros(len(self.texts))
        i = 0
        while i < len(order):
            held = order[i : i + BLOCK]
            limit = 4 << 20
            size = 0
            for j, k in enumerate(held):
                size += len(words[k]) + len(MARK)
                if size > limit and j:
                    held = held[:j]
                    break
            got, used = self.forward([words[k] for k in held], logs, None if counts is None else counts[held])
            total[held] = got
            if used is not None:
                uses += used
            i += len(held)
        return total, uses


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def train_flag(key) -> F.Column:
    return ~F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def chunk_words(payload: bytes):
    """The chunk's rows, each row's words, and the distinct words (sorted by hash) with their training counts."""
    rows = unpack_rows(payload)
    train = rows.column("train").to_pylist()
    texts = [byte_words((x or "").encode(), BLANK_WORDS) for x in rows.column("body").to_pylist()]
    counts: Counter = Counter()
    other: set = set()
    for w, t in zip(texts, train, strict=True):
        if t:
            counts.update(w)
        else:
            other.update(w)
    words = [END, *(counts.keys() | other)]
    hashes = word_hashes(words)
    order = np.argsort(hashes, kind="stable")
    words = [words[i] for i in order.tolist()]
    tally = np.fromiter((counts.get(w, 0) for w in words), np.int64, len(words))
    tally[words.index(END)] = sum(train)
    return rows, texts, words, hashes[order], tally


def scores(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", steps: int = STEPS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    small_batches(spark)
    size = total_bytes(docs, text)
    n_ranges, width = max(64, math.ceil(size / RANGE_BYTES)), task_width(spark, size)
    source = docs.select(F.col(key).alias("key"), train_flag(key).alias("train"), F.col(text).alias("body"))
    kind = source.schema["key"].dataType.simpleString()
    chunks, chunk_path = chunked(source, CHUNK_BYTES, "lm-chunks")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, _, words, hashes, tally = chunk_words(payload)
                cuts = np.searchsorted(hashes, range_starts(n_ranges))
                bounds = np.append(cuts, len(words))
                rows = [(r, int(a), int(b)) for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([squeeze(b"\n".join(w if w != END else b"" for w in words[a:b]), 1) for _, a, b in rows], pa.binary()), pa.array([squeeze(tally[a:b].astype("<u4" if tally.max() < 2**32 else "<u8").tobytes(), 1) for _, a, b in rows], pa.binary()), pa.array([b - a for _, a, b in rows], pa.int32())],
                    names=["part", "chunk_id", "words", "tally", "n"],
                )

    sent, sent_path = written(chunks.mapInArrow(send, "part int, chunk_id long, words binary, tally binary, n int").repartition(min(n_ranges, 2 * width), "part").sortWithinPartitions("part", "chunk_id"), "lm-words")

    def gather(batches: Iterator[pa.RecordBatch]):
        """For each hash range: the parts of the chunks, and its distinct words with their counts."""
        held, at = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["part"] != at:
                    yield at, *merged(held)
                    held = []
                at = row["part"]
                held.append(row)
        if held:
            yield at, *merged(held)

    def merged(held: list[dict]):
        place: dict[bytes, int] = {}
        spots, sums = [], []
        for row in held:
            raw = expand(row["tally"])
            words = expand(row["words"]).split(b"\n")
            spots.append(np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words)))
            sums.append(np.frombuffer(raw, "<u4" if len(raw) == 4 * len(words) else "<u8").astype(np.int64))
        total = np.bincount(np.concatenate(spots), np.concatenate(sums), len(place)).astype(np.int64)
        return held, spots, list(place), total

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held, spots, words, total in gather(batches):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([squeeze(b"\n".join(words), 1)], pa.binary()), pa.array([squeeze(total.astype("<i8").tobytes(), 1)], pa.binary()), pa.array([int(total.sum())], pa.int64()), pa.array([int((total > 0).sum())], pa.int64()), pa.array([squeeze(b"".join(np.append(s, -1).astype("<i4").tobytes() for s in spots), 1)], pa.binary()), pa.array([[h["chunk_id"] for h in held]], pa.list_(pa.int64()))], names=["part", "words", "total", "n", "v", "spots", "chunks"])

    # each range's distinct words, once over all documents
    vocab, vocab_path = written(sent.mapInArrow(reduce, "part int, words binary, total binary, n long, v long, spots binary, chunks array<long>"), "lm-vocab")
    n, v = (int(x or 0) for x in vocab.agg(F.sum("n"), F.sum("v")).first())
    drop_path(spark, sent_path)
    logs = pieces(vocabulary).logs
    for _ in range(steps if n else 0):
        logs = re_estimated(vocab, vocabulary, logs)
    model = spark.sparkContext.broadcast(logs)  # one number for each piece of the vocabulary

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = pieces(vocabulary)
        for batch in batches:
            for row in batch.to_pylist():
                words, total = expand(row["words"]).split(b"\n"), np.frombuffer(expand(row["total"]), "<i8")
                log = lattice.all_forward(words, model.value)[0]
                spots = np.frombuffer(expand(row["spots"]), "<i4")
                ends = np.flatnonzero(spots < 0)
                begin = 0
                out = []
                for end in ends.tolist():
                    s = spots[begin:end]
                    out.append(squeeze(total[s].astype("<i8").tobytes() + log[s].astype("<f8").tobytes(), 1))
                    begin = end + 1
                yield pa.RecordBatch.from_arrays([pa.array(row["chunks"], pa.int64()), pa.array([row["part"]] * len(out), pa.int32()), pa.array(out, pa.binary()), pa.array([None] * len(out), pa.binary())], names=["chunk_id", "part", "answer", "payload"])

    answers = vocab.repartition(min(n_ranges, width), "part").mapInArrow(answer, "chunk_id long, part int, answer binary, payload binary")
    both = answers.unionByName(chunks.select("chunk_id", F.lit(n_ranges).alias("part"), F.lit(None).cast("binary").alias("answer"), "payload"))
    both = both.repartition(width, "chunk_id").sortWithinPartitions("chunk_id", "part")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["payload"] is None:
                    held.append(expand(row["answer"]))
                    continue
                rows, texts, words, _, _ = chunk_words(row["payload"])
                counts = np.concatenate([np.frombuffer(x, "<i8", len(x) // 16) for x in held])
                logs_ = np.concatenate([np.frombuffer(x, "<f8", len(x) // 16, len(x) // 2) for x in held])
                held = []
                yield result(rows, texts, words, counts, logs_)

    def result(rows, texts, words, counts, lattice):
        end = words.index(END)
        base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
        pure = lattice / math.log(10)
        place = {w: i for i, w in enumerate(words)}
        get = place.__getitem__
        at = [np.fromiter((get(w) for w in t), np.int64, len(t)) for t in texts]
        at = [np.append(a, end) for a in at]
        train = np.array(rows.column("train").to_pylist(), bool)
        return pa.RecordBatch.from_arrays(
            [rows.column("key").combine_chunks(), pa.array(~train, pa.bool_()), pa.array([len(a) for a in at], pa.int64()), pa.array([int((counts[a] > 0).sum()) for a in at], pa.int64()), pa.array([n] * len(at), pa.int64()), pa.array([math.fsum(base[a].tolist()) for a in at], pa.float64()), pa.array([math.fsum(pure[a].tolist()) for a in at], pa.float64())],
            names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    out = both.mapInArrow(finish, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)


def range_starts(n: int) -> np.ndarray:
    return np.array([(i << 64) // n for i in range(n)], np.uint64)


def re_estimated(vocab: DataFrame, vocabulary: str, logs: np.ndarray) -> np.ndarray:
    """One step of expectation-maximisation over all training words; the driver gets one number for each piece."""
    held = vocab.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, uses = pieces(vocabulary), 0.0
        for batch in batches:
            for row in batch.to_pylist():
                words, total = expand(row["words"]).split(b"\n"), np.frombuffer(expand(row["total"]), "<i8")
                seen = np.flatnonzero(total > 0)
                uses = uses + lattice.all_forward([words[i] for i in seen.tolist()], held.value, total[seen].astype(np.float64))[1]
        if not np.isscalar(uses):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(uses)), pa.int32()), pa.array(uses, pa.float64())], names=["piece", "uses"])

    width = max(24, int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = vocab.repartition(width, "part").mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
    uses = np.zeros(len(logs))
    for r in rows:
        uses[r["piece"]] = r["uses"]
    uses += SMOOTH
    return np.log(uses / uses.sum())
