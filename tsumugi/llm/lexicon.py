"""Byte-level BPE encoding and decoding through a minimal acyclic transducer.

Frequent words are compiled into an automaton that shares prefixes and suffixes; each arc
carries a number and the sum along an accepted word is the place of its ids in one flat
table (the outputs).  The automaton is three flat arrays in a file that Spark ships to every
executor and that workers map into memory, so all workers of an executor share its pages.
Words that it lacks are merged exactly, by the merge ranks of the vocabulary.

Defined results: null and empty texts have no ids and decode to the empty text; special
strings inside a text become their id, as the library does by default; repeated rows are
encoded each; texts of any length are encoded whole; a vocabulary file with a normaliser, another
split or other merging rules is refused with a ValueError.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import struct
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.llm.common import as_bytes, lean, small_batches

#: The split of the byte-level vocabularies (a fixed, published pattern).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blocks in which the regex module and the library class every character alike; a text with others is split by the library itself.
ALIKE = regex.compile(r"[\u0000-՗ऀ-ॣ฀-๛Ḁ-ἕ -⁣₠-₿←-⏿─-⯿、-ゖ゙-ヿ一-鿯가-힣！-ﾾ\U0001F300-\U0001F64F]*+")
#: Words kept in the lexicon at most, and the smallest share of a task's words that survives its lossy count.
LEXICON_WORDS, SHARE = 1 << 16, 2e-6
MAGIC = b"MASTv1\0\0"


class Automaton:
    """A minimal acyclic transducer over bytes, read from flat arrays."""

    def __init__(self, data):
        magic, n_states, n_arcs, n_words, n_ids = struct.unpack_from("<8s4Q", data, 0)
        if magic != MAGIC:
            raise ValueError("not a lexicon file")
        at = 40

        def take(n, kind):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes + (-out.nbytes) % 8
            return out

        self.keys, self.targets, self.outputs = take(n_arcs, "<u8"), take(n_arcs, "<u4"), take(n_arcs, "<u4")
        self.final = take(n_states, "u1")
        self.starts, self.ids = take(n_words + 1, "<u4"), take(n_ids, "<u4")

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's place, -1 where the automaton doesn't accept it; all words step together."""
        n = len(words)
        if not n:
            return np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, n)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.frombuffer(b"".join(words), np.uint8)
        state, place, alive = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.arange(n)
        alive = alive[sizes > 0]
        found = np.full(n, -1, np.int64)
        step = 0
        while len(alive):
            keys = (state[alive] << np.uint64(8)) | flat[offsets[alive] + step].astype(np.uint64)
            arc = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            ok = self.keys[arc] == keys
            alive, arc = alive[ok], arc[ok]
            state[alive] = self.targets[arc]
            place[alive] += self.outputs[arc]
            step += 1
            ends = sizes[alive] == step
            done = alive[ends]
            done = done[self.final[state[done].astype(np.int64)] == 1]
            found[done] = place[done]
            alive = alive[~ends]
        return found


def compile_words(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The file of a lexicon: sorted words are added one by one, each finished suffix being merged with an equal one."""
    entries = sorted((w, ids) for w, ids in dict(entries).items() if w)
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if (held := register.get(key)) is None:
            held = register[key] = len(frozen)
            frozen.append(key)
        return held

    # path[i]: the open state after i bytes of the last word: [final, finished arcs]
    path: list[list] = [[False, []]]
    last = b""
    for word, _ in entries:
        common = len(os.path.commonprefix([last, word]))
        for i in range(len(last), common, -1):
            done = path.pop()
            path[i - 1][1].append((last[i - 1], freeze(done[0], done[1])))
        path.extend([False, []] for _ in range(len(word) - common))
        path[-1][0] = True
        last = word
    for i in range(len(last), 0, -1):
        done = path.pop()
        path[i - 1][1].append((last[i - 1], freeze(done[0], done[1])))
    root = freeze(path[0][0], path[0][1])
    # words below each state; states freeze children first
    below = [0] * len(frozen)
    for s, (final, arcs) in enumerate(frozen):
        below[s] = final + sum(below[t] for _, t in arcs)
    number = {root: 0} | {s: i + 1 for i, s in enumerate(x for x in range(len(frozen)) if x != root)}
    keys, targets, outputs, final = [], [], [], bytearray(len(frozen))
    for s, (ends, arcs) in enumerate(frozen):
        final[number[s]] = ends
        before = int(ends)
        for byte, t in arcs:
            keys.append(number[s] << 8 | byte)
            targets.append(number[t])
            outputs.append(before)
            before += below[t]
    order = np.argsort(np.array(keys, "<u8")) if keys else np.zeros(0, np.int64)
    sizes = [len(ids) for _, ids in entries]
    parts = [np.array(keys, "<u8")[order], np.array(targets, "<u4")[order], np.array(outputs, "<u4")[order], np.frombuffer(bytes(final), "u1"), np.concatenate(([0], np.cumsum(sizes))).astype("<u4"), np.array([i for _, ids in entries for i in ids], "<u4")]
    out = bytearray(struct.pack("<8s4Q", MAGIC, len(frozen), len(keys), len(entries), len(parts[-1])))
    for x in parts:
        raw = x.tobytes()
        out += raw + bytes(-len(raw) % 8)
    return bytes(out)


@lru_cache(maxsize=8)
def mapped(path: str) -> Automaton:
    with open(path, "rb") as f:
        return Automaton(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def refuse_others(path: str, spec: dict) -> None:
    """Raise for a file whose rules this module doesn't follow, instead of answering wrongly."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    split = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not (plain and split and not spec.get("normalizer")) or any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens") or []):
        raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library, with exact merging and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse_others(path, spec)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.path = path
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(self.ids[raw(a)], self.ids[raw(b)]): (r, self.ids[raw(a + b)]) for r, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.pieces = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for b, i in self.ids.items():
            self.pieces[i] = b
        for s, i in self.special.items():
            self.pieces[i] = s.encode()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        # ids in the order of the merges are ranks, by which the compiled merger gives the same result
        self.fast = None
        if all(i == self.ids[raw(a + b)] for i, (a, b) in enumerate(merges, 256)) and len(self.ids) == 256 + len(merges):
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=self.ids, special_tokens={})._core_bpe.encode_single_piece

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word, by repeatedly merging its lowest-ranked pair."""
        if self.fast:
            return self.fast(word)
        return self.merge_slowly(word)

    def merge_slowly(self, word: bytes) -> list[int]:
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            best = min((self.ranks[p] for p in zip(ids, ids[1:], strict=False) if p in self.ranks), default=None)
            if best is None:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.ranks.get((ids[i], ids[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    @property
    def library(self):
        if not hasattr(self, "_library"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def words(self, text: str) -> list[str]:
        """The text's words; special strings must have been cut out."""
        if ALIKE.fullmatch(text):
            return self.split.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pieces_of(self, text: str) -> list[tuple[bool, str]]:
        """The text in parts: (special, part)."""
        if self.cut is None or not self.cut.search(text):
            return [(False, text)] if text else []
        return [(i % 2 == 1, x) for i, x in enumerate(self.cut.split(text)) if x]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def count_words(docs: DataFrame, tokenizer: str, *, text: str = "text", share: float = SHARE) -> DataFrame:
    """(word binary, n long) of words that make up at least ``share`` of some task's words.

    Every text is read.  A task counts lossily: after each ``1 / share`` words it drops those
    seen less often than that share allows, so its memory is bounded and a word of share
    ``share`` is never lost.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, counts, fresh, seen, rounds = vocabulary(tokenizer), Counter(), 0, 0, 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                for special, part in vocab.pieces_of(x or ""):
                    if not special:
                        words = vocab.words(part)
                        counts.update(words)
                        fresh += len(words)
            if fresh * share >= 1:
                seen, fresh, rounds = seen + fresh, 0, rounds + 1
                floor = seen * share
                counts = Counter({w: n for w, n in counts.items() if n > floor})
        floor = max(1, (seen + fresh) * share)
        kept = [(w.encode(), n) for w, n in counts.items() if n > floor]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    return docs.select(F.col(text)).mapInArrow(lean(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, *, text: str = "text", size: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words and ship the file to every executor; returns its name."""
    top = count_words(docs, tokenizer, text=text).orderBy(F.desc("n"), "word").limit(size).collect()
    vocab = vocabulary(tokenizer)
    data = compile_words((bytes(r["word"]), vocab.merge(bytes(r["word"]))) for r in top)
    name = f"lexicon-{uuid.uuid4().hex}.mast"  # a session takes no second file of a name
    place = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)
    with open(place, "wb") as f:
        f.write(data)
    docs.sparkSession.sparkContext.addFile(place)
    return name


class Encoder:
    def __init__(self, tokenizer: str, lexicon: str):
        self.vocab, self.lexicon = vocabulary(tokenizer), mapped(SparkFiles.get(lexicon))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        The distinct words of a batch walk the automaton together; what it lacks is merged.
        """
        vocab, parts = self.vocab, []
        distinct: set[str] = set()
        for x in texts:
            own = []
            for special, part in vocab.pieces_of(x):
                words = part if special else vocab.words(part)
                if not special:
                    distinct.update(words)
                own.append((special, words))
            parts.append(own)
        listed = list(distinct)
        raw = [w.encode() for w in listed]
        place = self.lexicon.find(raw)
        held, starts, ids = {}, self.lexicon.starts, self.lexicon.ids.tobytes()
        known = np.flatnonzero(place >= 0)
        for i, a, b in zip(known.tolist(), (starts[place[known]].astype(np.int64) * 4).tolist(), (starts[place[known] + 1].astype(np.int64) * 4).tolist(), strict=True):
            held[listed[i]] = ids[a:b]
        for i in np.flatnonzero(place < 0).tolist():
            got = vocab.merge(raw[i])
            held[listed[i]] = struct.pack(f"<{len(got)}I", *got)
        get = held.__getitem__
        return [b"".join(struct.pack("<I", vocab.special[w]) if special else b"".join(map(get, w)) for special, w in own) for own in parts]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that form no UTF-8 become U+FFFD."""
        return b"".join(map(self.vocab.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encoded(docs: DataFrame, tokenizer: str, lexicon: str, *, keys: list[str], text: str = "text", decode: bool = True, raw_ids: bool = False) -> DataFrame:
    """keys, n_tokens, ids_sha256, decoded_sha256 (the ids decoded again), and with ``raw_ids`` ids and decoded."""
    small_batches(docs.sparkSession)
    source = docs.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))
    extra = ", ids array<int>, decoded string" if raw_ids else ""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + extra

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(tokenizer, lexicon)
        for batch in batches:
            ids = coder.encode([x or "" for x in batch.column(batch.num_columns - 1).to_pylist()])
            texts = [coder.decode(x) for x in ids] if decode else [None] * len(ids)
            columns = [*batch.columns[:-1], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([None if x is None else hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string())]
            names = [*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"]
            if raw_ids:
                columns += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(lean(run), schema)
