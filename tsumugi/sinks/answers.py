"""What a caller gets: JSON answers for requests, and the command's text."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsumugi.functions import kana
from tsumugi.operators import analysis, counters, lookup, presentation
from tsumugi.sources import tables

Tables = dict[str, DataFrame]

#: Requests by path: method, and the fields that the body must have.
PATHS = {"/health": ("GET", ()), "/health/db": ("GET", ()), "/api": ("GET", ()), "/api/romanize": ("POST", ("text",)), "/api/romanize/info": ("POST", ("text",)), "/api/segment": ("POST", ("text",)), "/api/analyze": ("POST", ("text",))}
HEADERS = {"Access-Control-Allow-Origin": "*", "Access-Control-Allow-Methods": "GET, POST, OPTIONS", "Access-Control-Allow-Headers": "Content-Type", "Content-Type": "application/json"}
#: Characters of a text that one request may hold.
LONGEST = 100_000


def word_json(found: DataFrame, own: Tables) -> DataFrame:
    """Adds ``json`` to tokens of ``analysis.segmented`` with kana."""
    glossed = presentation.senses_json(presentation.senses(own["glosses"], own["sense_props"]))
    data = lookup.conjugation_data(own["readings"].select("seq", "text"), own["conjugations"], own["conj_props"], own["conj_sources"])
    forms = presentation.conjugation_json(data, presentation.entry_readings(own["readings"]), glossed)
    rooted = found.join(own["entry"].select("seq", F.col("root_p").alias("root")), "seq", "left").withColumns({"score": F.lit(None).cast("int"), "counter": F.lit(None).cast("string")})
    return presentation.token_json(rooted, glossed, forms)


def quoted(column: str) -> F.Column:
    """A text as JSON."""
    return F.expr(f"substring(to_json(array({column})), 2, length(to_json(array({column}))) - 2)")


def segments(texts: DataFrame, own: Tables, *, key: str = "sent_id", text: str = "text", k: int = 1, method: str = "traditional", particles: dict | None = None) -> DataFrame:
    """(key, json): each text's word stretches with their ``k`` best readings, tokens as [romaji, word], and what is between as text."""
    chunks = analysis.stretches(texts, key=key, text=text)
    parts = chunks.filter("type = 'word'").select(F.struct(key, "chunk").alias("__id"), F.col("text").alias("part"))
    counted = counters.counter_table(own["readings"], own["sense_props"])
    best = analysis.with_kana(analysis.segmented(parts, analysis.features(own, particles), counted, key="__id", text="part", k=k), own)
    shown = word_json(best, own).withColumn("romaji", F.when(F.col("type") == "gap", F.col("text")).otherwise(kana.romaniser(method)(F.coalesce(F.get("kana", 0), F.col("text")))))
    tuples = shown.withColumn("t", F.concat(F.lit("["), quoted("romaji"), F.lit(","), "json", F.lit("]")))
    readings = tuples.groupBy("__id", "rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), ",").alias("ts"))
    ranked = readings.groupBy("__id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ts"))), lambda x: F.concat(F.lit("["), x["ts"], F.lit("]"))), ",").alias("rs"))
    rows = chunks.join(ranked.select(F.col(f"__id.{key}").alias(key), F.col("__id.chunk").alias("chunk"), "rs"), [key, "chunk"], "left")
    piece = F.when(F.col("rs").isNotNull(), F.concat(F.lit("["), "rs", F.lit("]"))).otherwise(quoted("text"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("p")))), lambda x: x["p"])
    return rows.groupBy(key).agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("json"))


def infos(texts: DataFrame, own: Tables, *, key: str = "sent_id", text: str = "text", particles: dict | None = None) -> DataFrame:
    """(key, info): the words of each text with their senses, the last first."""
    lines = presentation.senses_text(presentation.senses(own["glosses"], own["sense_props"]))
    chunks = analysis.stretches(texts, key=key, text=text).filter("type = 'word'").select(F.struct(key, "chunk").alias("__id"), F.col("text").alias("part"))
    best = analysis.segmented(chunks, analysis.features(own, particles), key="__id", text="part", k=1)
    rows = best.select(F.col(f"__id.{key}").alias(key), F.struct("__id.chunk", "i").alias("place"), "text", "seq")
    return presentation.token_infos(rows, lines, key=key, order="place")


def answer(spark: SparkSession, own: Tables, method: str, path: str, body: str = "", rules: list[dict] | None = None) -> tuple[int, dict]:
    """(status, JSON) of one request; what a server would send, without the server."""
    if method == "OPTIONS":
        return 204, {}
    if path not in PATHS or PATHS[path][0] != method:
        return 404, {"error": f"Not found: {method} {path}"}
    if path == "/health":
        return 200, {"status": "ok", "timestamp": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
    if path == "/health/db":
        return 200, {"status": "ok", "entries": own["entry"].count()}
    if path == "/api":
        return 200, {"endpoints": [{"method": m, "path": p} for p, (m, _) in PATHS.items()]}
    try:
        given = json.loads(body)
    except ValueError:
        return 400, {"error": "The body is no JSON"}
    if not isinstance(given, dict) or not isinstance(given.get("text"), str) or not given["text"]:
        return 400, {"error": "text is missing"}
    if len(given["text"]) > LONGEST:
        return 413, {"error": f"text has more than {LONGEST} characters"}
    limit = given.get("limit", 1)
    if not isinstance(limit, int) or limit < 1:
        return 400, {"error": "limit must be a positive number"}
    texts = spark.createDataFrame([(1, given["text"])], "sent_id int, text string")
    if path == "/api/segment":
        return 200, {"text": given["text"], "segments": json.loads(segments(texts, own, k=limit).first()["json"]), "limit": limit}
    if path == "/api/analyze":
        found = analysis.analysed(texts.withColumnRenamed("sent_id", "doc_id"), own, rules or [])
        hits = [r.asDict(recursive=True) for r in found.orderBy("sent_no", "pattern", "start").limit(given.get("maxMatches") or 1 << 30).collect()]
        grouped: dict[str, list] = {}
        for h in hits:
            grouped.setdefault(h["pattern"], []).append({"level": h["level"], "sentence": h["sent_no"], "captures": h["captures"]})
        return 200, {"segments": json.loads(segments(texts, own, k=1).first()["json"]), "grammars": {p: {"matchedSentences": m} for p, m in grouped.items()}}
    out = {"text": given["text"], "romanized": analysis.romanised(texts, own).first()["romaji"]}
    if path == "/api/romanize/info":
        row = infos(texts, own).first()
        out["info"] = row["info"] if row else ""
    return 200, out


def answers(spark: SparkSession, own: Tables, requests: list[tuple[str, str, str]], rules: list[dict] | None = None) -> list[tuple[int, dict]]:
    """Requests (method, path, body) one by one; an error inside becomes a 500."""
    out = []
    for method, path, body in requests:
        try:
            out.append(answer(spark, own, method, path, body, rules))
        except Exception as error:  # a server's last line
            out.append((500, {"error": str(error).split("\n")[0]}))
    return out


def command(spark: SparkSession, own: Tables, text: str, *, info: bool = False, full: bool = False, limit: int = 1) -> str:
    """The command's text: romaji, with ``info`` the words' senses below, with ``full`` the segments' JSON."""
    texts = spark.createDataFrame([(1, text)], "sent_id int, text string")
    if full:
        return segments(texts, own, k=limit).first()["json"]
    out = analysis.romanised(texts, own).first()["romaji"]
    if info:
        row = infos(texts, own).first()
        out += "\n\n" + row["info"] if row else ""
    return out.strip()


def main(arguments: list[str] | None = None) -> int:
    """``python -m tsumugi.sinks.answers FOLDER [-i] [-f [-l N]] TEXT``: the folder holds a dictionary's tables."""
    parser = argparse.ArgumentParser(prog="tsumugi")
    parser.add_argument("folder")
    parser.add_argument("text", nargs="+")
    parser.add_argument("-i", "--with-info", action="store_true")
    parser.add_argument("-f", "--full", action="store_true")
    parser.add_argument("-l", "--limit", type=int, default=1)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    print(command(spark, tables.load(spark, given.folder), " ".join(given.text), info=given.with_info, full=given.full, limit=given.limit))
    return 0


if __name__ == "__main__":
    sys.exit(main())
