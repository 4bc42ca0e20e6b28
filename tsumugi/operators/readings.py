"""Kana for conjugated spellings in kanji, and kanji for conjugated kana."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.functions.chars import kanji_match
from tsumugi.functions.spelling import best_form
from tsumugi.operators.lookup import best_readings

Tables = dict[str, DataFrame]


def edges(tables: Tables) -> DataFrame:
    """(conj_id, seq, parent): each form with the entry it is made from directly."""
    return tables["conjugations"].select(F.col("id").alias("conj_id"), "seq", F.coalesce("via", "from").alias("parent"))


def best_kana(tables: Tables, rounds: int = 2) -> DataFrame:
    """(seq, text, best) for every spelling in kanji: a root's first kana that goes with it, a form's by way of its parent.

    A form's kana come from the parent's best kana; ``rounds`` is how deep forms are made of forms.
    """
    known = best_readings(tables["readings"], tables["restricted"]).filter("script = 'kanji'").select("seq", "text", "best")
    roots = known.join(tables["entry"].filter("root_p").select("seq"), "seq", "left_semi")
    spelled = tables["readings"].filter("script = 'kanji'").select("seq", "text")
    links = edges(tables)
    sources = tables["conj_sources"].select("conj_id", "text", "source_text")
    found = roots
    for _ in range(rounds):
        open_ = spelled.join(found, ["seq", "text"], "left_anti").join(links, "seq")
        pairs = open_.join(sources, ["conj_id", "text"]).withColumnRenamed("source_text", "p_text")
        pairs = pairs.join(found.select(F.col("seq").alias("parent"), F.col("text").alias("p_text"), F.col("best").alias("p_best")), ["parent", "p_text"])
        forms = sources.groupBy("conj_id", F.col("source_text").alias("p_best")).agg(F.array_sort(F.collect_set("text")).alias("forms"))
        chosen = pairs.join(forms, ["conj_id", "p_best"]).withColumn("best", best_form(F.col("forms"), F.col("text"), F.col("p_text"), F.col("p_best")))
        found = found.unionByName(chosen.groupBy("seq", "text").agg(F.min_by("best", F.struct("parent", "conj_id", "p_text")).alias("best")))
    return found


def best_kanji(tables: Tables, rounds: int = 2) -> DataFrame:
    """(seq, text, best) for every kana that is written in kanji: a root's first kanji, a form's that fits its kana."""
    known = best_readings(tables["readings"], tables["restricted"]).filter("script = 'kana'").select("seq", "text", "best")
    roots = known.join(tables["entry"].filter("root_p").select("seq"), "seq", "left_semi")
    spelled = tables["readings"].filter("script = 'kana' and not coalesce(nokanji, false)").select("seq", "text").join(tables["entry"].filter("n_kanji > 0").select("seq"), "seq", "left_semi")
    links = edges(tables)
    sources = tables["conj_sources"].select("conj_id", "text", "source_text")
    found = roots
    for _ in range(rounds):
        open_ = spelled.join(found, ["seq", "text"], "left_anti").join(links, "seq")
        pairs = open_.join(sources, ["conj_id", "text"]).withColumnRenamed("source_text", "p_text")
        pairs = pairs.join(found.select(F.col("seq").alias("parent"), F.col("text").alias("p_text"), F.col("best").alias("p_best")), ["parent", "p_text"])
        forms = sources.select("conj_id", F.col("source_text").alias("p_best"), F.col("text").alias("form"))
        chosen = pairs.join(forms, ["conj_id", "p_best"]).filter(kanji_match(F.col("form"), F.col("text")))
        found = found.unionByName(chosen.groupBy("seq", "text").agg(F.min_by("form", F.struct("parent", "conj_id", "form")).alias("best")))
    return found
