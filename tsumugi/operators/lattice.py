"""Segmentation: substring join with a lexicon, scores, and the k best paths of a sentence."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cost of a character that no segment covers.
GAP = -500
# Length coefficients of the score by class and length.
STRONG, WEAK = (0, 1, 8, 24, 40, 60), (0, 1, 4, 9, 16, 25, 36)


def substrings(texts: DataFrame, longest: int, *, key: str = "sent_id", text: str = "text") -> DataFrame:
    """(key, start, end, part) of all substrings up to ``longest`` characters."""
    starts = texts.filter(F.length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(0), F.length(text) - 1)).alias("start"))
    ends = starts.withColumn("end", F.explode(F.sequence(F.col("start") + 1, F.least(F.length(text), F.col("start") + longest))))
    return ends.select(key, "start", "end", F.col(text).substr(F.col("start") + 1, F.col("end") - F.col("start")).alias("part"))


def lexicon_hits(texts: DataFrame, lexicon: DataFrame, *, key: str = "sent_id", text: str = "text", longest: int = 50) -> DataFrame:
    """Substrings that the lexicon (text, seq, ord, common, script) has, with scores.

    The lexicon is broadcast only where Spark's own size threshold allows it.  Substrings are cut at
    the longest entry, and at ``longest`` characters: longer entries aren't found.
    """
    most = min(longest, lexicon.agg(F.max(F.length("text"))).first()[0] or 1)
    parts = substrings(texts, most, key=key, text=text)
    hits = parts.join(lexicon.withColumnRenamed("text", "part"), "part")
    return hits.select(key, "start", "end", "part", "seq", score(F.col("part"), F.col("common"), F.col("script"), F.col("ord")).alias("score"))


def coefficient(n, table: tuple[int, ...]):
    """The table's value at length ``n``; beyond it its last value grows with the length."""
    listed = F.get(F.array(*[F.lit(v) for v in table]), n)
    return F.coalesce(listed, F.floor(n * F.lit(table[-1] / (len(table) - 1))))


def score(part, common, script, order):
    """Length coefficient times a base of commonness and rank among the readings."""
    n = F.length(part)
    length = F.when(script.isin("kanji", "katakana"), coefficient(n, STRONG)).otherwise(coefficient(n, WEAK))
    base = F.when(common.isNotNull(), F.greatest(F.lit(5), 20 - F.coalesce(common, F.lit(0)).cast("int"))).otherwise(2) - F.least(order, F.lit(3))
    return (length * base).cast("long")


def neighbours(rules: list[dict], left: dict, right: dict) -> list[int] | None:
    """What two adjacent segments gain: 0 or the first fitting penalty, and each fitting synergy.

    None where a must-follow rule forbids the pair.  A rule: {"kind": synergy, penalty or follow,
    "left": tags, "right": tags, "score", "by_left", "by_right": score per character}.  A follow
    rule lets a right segment of its tags stand only after a left one of its tags, and with ``free``
    where nothing stands before it.
    """
    fits = lambda rule, side, tags: not rule.get(side) or bool(tags & set(rule[side]))
    gains, penalty = [], 0
    for rule in rules:
        here, before = fits(rule, "right", right["tags"]), fits(rule, "left", left["tags"])
        if rule["kind"] == "follow":
            if here and not before:
                return None
        elif here and before:
            gain = rule["score"] + rule.get("by_left", 0) * (left["end"] - left["start"]) + rule.get("by_right", 0) * (right["end"] - right["start"])
            if rule["kind"] == "synergy":
                gains.append(gain)
            elif not penalty:
                penalty = gain
    return [penalty, *gains]


def paths_of(n: int, segments: list[dict], rules: list[dict], k: int) -> list[tuple[int, tuple]]:
    """The k best paths over ``n`` characters, as (score, ((start, end, seq), ...)).

    The best k are kept for each last segment, as what follows depends on it.  A pair counts for
    at least one more than its better half.
    """
    top = lambda found: sorted(found, key=lambda x: (-x[0], x[1]))[:k]
    by_start: dict[int, list[dict]] = {}
    for x in segments:
        by_start.setdefault(x["start"], []).append(x)
    ended: list[list[tuple[dict, list]]] = [[] for _ in range(n + 1)]
    gaps: list[list] = [[(0, ())]] + [[] for _ in range(n)]
    for at in range(n + 1):
        if at:
            before = gaps[at - 1] + [p for _, ps in ended[at - 1] for p in ps]
            gaps[at] = top([(value + GAP, path) for value, path in before])
        for x in by_start.get(at, []):
            step, alone = (x["start"], x["end"], x["seq"]), {"start": at, "end": at, "tags": set()}
            first = neighbours([r for r in rules if r["kind"] == "follow" and not r.get("free")], alone, x)
            found = [(value + x["score"], (*path, step)) for value, path in gaps[at]] if first is not None else []
            for last, paths in ended[at]:
                for gain in neighbours(rules, last, x) or []:
                    pair = max(last["score"] + x["score"] + gain, last["score"] + 1, x["score"] + 1)
                    found += [(value - last["score"] + pair, (*path, step)) for value, path in paths]
            if found:
                unique: dict[tuple, int] = {}
                for value, path in found:
                    unique[path] = max(value, unique.get(path, value))
                ended[x["end"]].append((x, top([(v, p) for p, v in unique.items()])))
    return top(gaps[n] + [p for _, ps in ended[n] for p in ps])


def best_paths(hits: DataFrame, lengths: DataFrame, *, key: str = "sent_id", k: int = 3, rules: list[dict] | None = None) -> DataFrame:
    """(key, rank, score, path array<struct<start, end, seq>>): k best non-overlapping paths.

    A sentence's candidates, bounded by its length, are one row on their way to Python.  Ties go to
    the path that sorts first.  ``rules`` (see ``neighbours``) read the hits' ``tags``, an array.  A
    sentence without hits is one gap; a null length counts as 0.
    """
    tags = F.col("tags") if "tags" in hits.columns else F.array().cast("array<string>")
    packed = hits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("end", "start", "seq", "score", tags.alias("tags")))).alias("hits"))
    joined = lengths.select(key, "n").join(packed, key, "left")
    kind, text = lengths.schema[key].dataType.simpleString(), json.dumps(rules or [])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = json.loads(text)
        for batch in batches:
            rows = []
            for name, n, found in zip(batch[key], batch["n"], batch["hits"], strict=True):
                segments = [dict(h) | {"tags": set(h["tags"] if h["tags"] is not None else ())} for h in (found if found is not None else ())]
                for i, (value, path) in enumerate(paths_of(0 if pd.isna(n) else int(n), segments, own, k)):
                    rows.append((name, i + 1, value, [{"start": a, "end": b, "seq": q} for a, b, q in path]))
            yield pd.DataFrame(rows, columns=[key, "rank", "score", "path"])

    return joined.mapInPandas(solve, f"`{key}` {kind}, rank int, score long, path array<struct<start: int, end: int, seq: int>>")


def segment(texts: DataFrame, lexicon: DataFrame, *, key: str = "sent_id", text: str = "text", k: int = 3) -> DataFrame:
    hits = lexicon_hits(texts, lexicon, key=key, text=text)
    return best_paths(hits, texts.select(key, F.length(text).alias("n")), key=key, k=k)
