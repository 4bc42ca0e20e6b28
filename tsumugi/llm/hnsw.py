"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Equal vectors are indexed once and keep the smallest of their ids, as many as an answer could
need.  A shard's graph is a flat array of neighbours per level (-1 where empty).  Vectors are
inserted in blocks: a block's beam searches run together in numpy over the graph so far, and
its members also see each other.  Shards are rows of a Parquet table in the shared folder;
every query is sent to every shard, in blocks, and the shards' answers are merged with cosines
computed again in double precision on the original vectors.

Defined results: vectors that are null, empty, zero or hold null or non-finite components are
neither indexed nor queries; vectors of another length are no candidates; rows with a null id
take no part; fewer candidates than ``k`` are all returned; ties go to the smaller id.  Of rows
that repeat an id every vector is indexed; an answer names the id once, by its best vector, and
as a query it asks with its smallest vector.

Tables below ``SHARD_ROWS * LEAST_TASKS`` rows are cut into smaller shards to keep so many tasks
busy; as every shard is searched with the same beam, recall only rises by that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.llm.common import small_batches, written

#: Links of a node (twice as many at level 0), beam while building and searching, vectors inserted together.
LINKS, BUILD_BEAM, SEARCH_BEAM, BLOCK = 12, 64, 96, 256
#: Distinct vectors of a shard at most, about.
SHARD_ROWS = 1 << 14
#: Below that, rows that a shard has at least while there are fewer shards than this many tasks.
LEAST_ROWS, LEAST_TASKS = 2048, 12


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors divided by powers of two (exactly, so cosines stay and no square overflows), and unit vectors in single precision."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])
    return x, (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)


def level_of(seeds: np.ndarray, links: int) -> np.ndarray:
    """Levels fall geometrically, fixed by the vector's own hash."""
    u = ((seeds.astype(np.uint64) >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.minimum(np.floor(-np.log(u) / math.log(links)), 12).astype(np.int64)


class Graph:
    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray] | None = None, entry: int = 0):
        self.x, self.levels, self.entry = vectors, levels, entry
        top = int(levels.max(initial=0))
        self.links = links or [np.full((len(vectors), LINKS * (2 if level == 0 else 1)), -1, np.int32) for level in range(top + 1)]

    def beam(self, queries: np.ndarray, start: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the best ``width`` nodes found from its start: (nodes, similarities), -1 where fewer."""
        n, rows = len(queries), np.arange(len(queries))
        links, x = self.links[level], self.x
        seen = np.zeros((n, len(x)), bool)
        seen[rows, start] = True
        nodes = np.full((n, width), -1, np.int64)
        sims = np.full((n, width), -np.inf, np.float32)
        open_ = np.zeros((n, width), bool)
        nodes[:, 0], sims[:, 0], open_[:, 0] = start, np.einsum("ij,ij->i", queries, x[start]), True
        live = rows
        while len(live):
            best = np.where(open_[live], sims[live], -np.inf)
            pick = best.argmax(1)
            ok = best[np.arange(len(live)), pick] > -np.inf
            live, pick = live[ok], pick[ok]
            if not len(live):
                break
            open_[live, pick] = False
            near = links[nodes[live, pick]].astype(np.int64)
            fresh = (near >= 0) & ~seen[live[:, None], near]
            seen[np.repeat(live, near.shape[1])[fresh.ravel()], near[fresh]] = True
            got = (x[near] @ queries[live][:, :, None])[:, :, 0]
            got[~fresh] = -np.inf
            all_nodes = np.concatenate([nodes[live], near], 1)
            all_sims = np.concatenate([sims[live], got.astype(np.float32)], 1)
            all_open = np.concatenate([open_[live], fresh], 1)
            keep = np.argpartition(-all_sims, width - 1, 1)[:, :width]
            sims[live] = np.take_along_axis(all_sims, keep, 1)
            nodes[live] = np.where(sims[live] > -np.inf, np.take_along_axis(all_nodes, keep, 1), -1)
            open_[live] = np.take_along_axis(all_open, keep, 1) & (sims[live] > -np.inf)
        order = np.argsort(-sims, 1, kind="stable")
        return np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        """The ``width`` best nodes of each query, nearest first, -1 where fewer."""
        out = []
        for i in range(0, len(queries), BLOCK):
            q = queries[i : i + BLOCK]
            at = np.full(len(q), self.entry, np.int64)
            for level in range(int(self.levels[self.entry]), 0, -1):
                at = self.beam(q, at, level, 1)[0][:, 0]
            out.append(self.beam(q, at, 0, width)[0])
        return np.concatenate(out) if out else np.zeros((0, width), np.int64)


def chosen(x: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """The diversity rule: a candidate is linked if no linked one is nearer to it than the new node; the rest fill up.

    ``near``/``sims``: (rows, candidates), best first, -1 where empty.  All rows step together.
    """
    n, c = near.shape
    v = x[near]
    pick = np.full((n, c), False)
    count = np.zeros(n, np.int64)
    cross = v @ v.transpose(0, 2, 1)
    for j in range(c):
        rival = np.where(pick, cross[:, j, :], -np.inf).max(1)
        ok = (near[:, j] >= 0) & (rival < sims[:, j]) & (count < most)
        pick[:, j] = ok
        count += ok
    # the picked first, then the other candidates in order
    rank = np.argsort(np.where(near < 0, 2, np.where(pick, 0, 1)), 1, kind="stable")[:, :most]
    return np.take_along_axis(near, rank, 1)


def build(vectors: np.ndarray, seeds: np.ndarray) -> Graph:
    """The graph of unit vectors; seeds (hashes) fix the levels."""
    n = len(vectors)
    g = Graph(vectors, level_of(seeds, LINKS))
    if not n:
        return g
    done = 0
    while done < n:
        block = np.arange(done, min(n, done + min(BLOCK, max(8, done))))
        among = vectors[block] @ vectors[block].T
        np.fill_diagonal(among, -np.inf)
        top = int(g.levels[g.entry]) if done else -1
        at = np.full(len(block), g.entry, np.int64)
        for level in range(max(top, int(g.levels[block].max())), -1, -1):
            rows = np.arange(len(block))
            here = rows[g.levels[block] >= level]
            near, sims = np.full((len(block), 1), -1, np.int64), np.full((len(block), 1), -np.inf, np.float32)
            if done and level <= top:
                if len(here) < len(block):
                    at = g.beam(vectors[block], at, level, 1)[0][:, 0]
                if len(here):
                    near, sims = g.beam(vectors[block[here]], at[here], level, BUILD_BEAM)
                    at[here] = near[:, 0]
            else:
                near, sims = near[here], sims[here]
            if not len(here):
                continue
            most = g.links[level].shape[1]
            # other members of the block that stand on this level
            peers = np.where(g.levels[block][None, :] >= level, among[here], -np.inf)
            width = min(most, peers.shape[1])
            best = np.argpartition(-peers, width - 1, 1)[:, :width]
            near = np.concatenate([near, block[best]], 1)
            sims = np.concatenate([sims, np.take_along_axis(peers, best, 1).astype(np.float32)], 1)
            order = np.argsort(-sims, 1, kind="stable")[:, : 2 * most]
            near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
            near = np.where(sims > -np.inf, near, -1)
            link(g, level, block[here], chosen(vectors, near, sims, most))
        high = block[g.levels[block].argmax()]
        if not done or g.levels[high] > g.levels[g.entry]:
            g.entry = int(high)
        done = block[-1] + 1
    return g


def link(g: Graph, level: int, nodes: np.ndarray, near: np.ndarray) -> None:
    """Link nodes to their neighbours, and those back; overfull neighbours choose anew."""
    links, x = g.links[level], g.x
    most = links.shape[1]
    links[nodes, : near.shape[1]] = near
    src = np.repeat(nodes, near.shape[1])
    dst = near.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    targets, first, counts = np.unique(dst, return_index=True, return_counts=True)
    width = int(counts.max(initial=0))
    if not width:
        return
    for i in range(0, len(targets), 512):
        t, f, c = targets[i : i + 512], first[i : i + 512], counts[i : i + 512]
        cols = np.arange(int(c.max()))
        inside = cols[None, :] < c[:, None]
        extra = np.where(inside, src[np.minimum(f[:, None] + cols, len(src) - 1)], -1)
        near = np.concatenate([links[t].astype(np.int64), extra], 1)
        sims = np.where(near >= 0, (x[near] @ x[t][:, :, None])[:, :, 0], -np.inf)
        # a neighbour may stand there already
        order = np.argsort(near, 1, kind="stable")
        ranked = np.take_along_axis(near, order, 1)
        twice = np.concatenate([np.zeros((len(t), 1), bool), ranked[:, 1:] == ranked[:, :-1]], 1)
        np.put_along_axis(sims, order, np.where(twice, -np.inf, np.take_along_axis(sims, order, 1)), 1)
        order = np.argsort(-sims, 1, kind="stable")[:, : 3 * most]
        sims, near = np.take_along_axis(sims, order, 1), np.take_along_axis(near, order, 1)
        near = np.where(sims > -np.inf, near, -1)
        got = near[:, :most].copy()
        full = (near >= 0).sum(1) > most
        if full.any():
            got[full] = chosen(x, near[full], sims[full], most)
        links[t] = -1
        links[t[:, None], np.arange(got.shape[1])[None, :]] = got


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = F.transform(F.col(vector), lambda e: e.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    return rows.filter(fine)


def index(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 5, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame, int]:
    """(shards, members, number of shards).

    shards: shard, dim, n, vectors, ids, links, levels, entry, one row each.  members: the
    distinct vectors with up to ``k + 1`` smallest ids, which no answer can exceed.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors, key, vector).select("id", "v", F.xxhash64("v").alias("h"))
    # a partial limit per task runs before the shuffle, so a vector of very many rows stays small
    ranked = rows.withColumn("r", F.expr("row_number() over (partition by h, v order by id)")).filter(F.col("r") <= k + 1)
    distinct = ranked.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    members, _ = written(distinct, "vectors")
    n = members.count()
    n_shards = max(1, math.ceil(n / shard_rows), min(n // LEAST_ROWS, LEAST_TASKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for shard, h, v, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault((shard, len(v)), []).append((h, np.array(v, np.float64), ids))
        for (shard, dim), rows in sorted(held.items()):
            rows.sort(key=lambda r: (r[0], r[2]))
            raw = np.stack([r[1] for r in rows])
            g = build(scaled(raw)[1], np.array([r[0] for r in rows], np.int64).view(np.uint64))
            width = k + 1
            ids = np.array([r[2] + [-1] * (width - len(r[2])) for r in rows], np.int64)
            counts = np.array([len(r[2]) for r in rows], np.int32)
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "dim": pa.array([dim], pa.int32()), "n": pa.array([len(rows)], pa.int32()), "vectors": [raw.tobytes()], "ids": [ids.tobytes()], "counts": [counts.tobytes()], "links": [b"".join(a.tobytes() for a in g.links)], "levels": [g.levels.tobytes()], "entry": pa.array([g.entry], pa.int32())},
                schema=pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("n", pa.int32()), ("vectors", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("links", pa.binary()), ("levels", pa.binary()), ("entry", pa.int32())]),
            )

    dealt = members.select(F.pmod("h", F.lit(n_shards)).cast("int").alias("shard"), "h", "v", "ids").repartition(n_shards, "shard")
    shards, _ = written(dealt.mapInArrow(run, "shard int, dim int, n int, vectors binary, ids binary, counts binary, links binary, levels binary, entry int"), "hnsw")
    return shards, members, n_shards


class Shard:
    def __init__(self, row: dict, k: int):
        n, dim = row["n"], row["dim"]
        self.raw, unit = scaled(np.frombuffer(row["vectors"], np.float64).reshape(n, dim))
        self.norm = np.sqrt((self.raw * self.raw).sum(1))
        self.ids = np.frombuffer(row["ids"], np.int64).reshape(n, k + 1)
        self.counts = np.frombuffer(row["counts"], np.int32)
        levels = np.frombuffer(row["levels"], np.int64)
        links, at = [], 0
        for level in range(int(levels.max(initial=0)) + 1):
            width = LINKS * (2 if level == 0 else 1)
            links.append(np.frombuffer(row["links"], np.int32, n * width, at).reshape(n, width))
            at += n * width * 4
        self.graph = Graph(unit, levels, links, row["entry"])

    def answer(self, ids: np.ndarray, queries: np.ndarray, k: int, width: int) -> list[tuple[int, int, float]]:
        """(query, found, exact cosine), at most k for each query."""
        q, unit = scaled(queries)
        norm = np.sqrt((q * q).sum(1))
        nodes = self.graph.search(unit, max(width, k + 1))
        out = []
        for i in range(len(ids)):
            at = nodes[i][nodes[i] >= 0]
            score = (self.raw[at] @ q[i]) / (self.norm[at] * norm[i])
            keep = np.repeat(np.arange(len(at)), self.counts[at])
            found = self.ids[at][np.arange(self.ids.shape[1])[None, :] < self.counts[at][:, None]]
            other = found != ids[i]
            found, s = found[other], score[keep][other]
            order = np.lexsort((found, -s))
            order = order[np.sort(np.unique(found[order], return_index=True)[1])][:k]  # an id once, by its best vector
            out += [(int(ids[i]), int(found[j]), float(s[j])) for j in order]
        return out


def search(vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 5, width: int = SEARCH_BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query."""
    shards, _, n_shards = index(vectors, key=key, vector=vector, k=k, shard_rows=shard_rows)
    asked = usable(queries, key, vector).groupBy("id").agg(F.min("v").alias("v")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    none = lambda *names: [F.lit(None).cast("binary").alias(x) for x in names]
    rows = shards.select("shard", F.lit(0).alias("kind"), "dim", "n", "vectors", "ids", "counts", "links", "levels", "entry", F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"))
    rows = rows.unionByName(asked.select("shard", F.lit(1).alias("kind"), F.size("v").alias("dim"), F.lit(0).alias("n"), *none("vectors", "ids", "counts", "links", "levels"), F.lit(0).alias("entry"), "id", "v"))
    # a shard's graphs come first, then the queries pass by in blocks
    rows = rows.repartition(n_shards, "shard").sortWithinPartitions("shard", "kind", "dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            found, asked = [], {}

            def flush(found=found):
                for dim, block in asked.items():
                    if dim in held:
                        found += held[dim].answer(np.array([b[0] for b in block], np.int64), np.array([b[1] for b in block], np.float64), k, width)
                asked.clear()

            for row in batch.to_pylist():
                if row["shard"] != at:
                    flush()
                    at, held = row["shard"], {}
                if row["kind"] == 0:
                    held[row["dim"]] = Shard(row, k)
                else:
                    asked.setdefault(row["dim"], []).append((row["id"], row["v"]))
            flush()
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], names=["query_id", "vec_id", "score"])

    merged = rows.mapInArrow(run, "query_id long, vec_id long, score double")
    ranked = merged.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
