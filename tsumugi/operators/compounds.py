"""Words with suffixes: compounds and abbreviations, found by joins over a table of rules.

A suffix surface (text, keyword, seq, kana) ends a compound; what stands before it must, with
``add`` behind, be a word that the rule of its keyword accepts.  ``cut`` characters of that
word's kana give way to the suffix.  Compounds are roots of further compounds, so the join runs
in rounds until a round finds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.operators.lookup import suffix_hits

RULES = "keyword string, surface string, add string, cut int, conj array<int>, pos array<string>, ends array<string>, other_than string, connector string, mod double, fixed int, kind string, alone boolean"
SUFFIX = "text string, keyword string, seq int, kana string"
#: Rounds of suffixes behind suffixes, and the longest root.
ROUNDS, LONGEST = 4, 50
TE = ("て", "で")


def rule(keyword: str, *, surface: str = "", add: str = "", cut: int = 0, conj: tuple = (), pos: tuple = (), ends: tuple = (), other_than: str = "", connector: str = "", mod: float = 0, fixed: int | None = None, kind: str = "compound", alone: bool = False) -> tuple:
    """One row of ``RULES``.  ``fixed`` is a score of its own, ``alone`` drops compounds that are words by themselves."""
    return keyword, surface, add, cut, list(conj), list(pos), list(ends), other_than, connector, float(mod), fixed, kind, alone


def abbreviation(keyword: str, add: str, cut: int, *, conj: tuple = (), alone: bool = False) -> tuple:
    return rule(keyword, add=add, cut=cut, conj=conj, kind="abbreviation", alone=alone)


# What each suffix follows, and its score for each character.
DEFAULT_RULES = (
    rule("tai", conj=(13,), mod=5),
    rule("ren", conj=(13,), mod=5),
    rule("ren-", conj=(13,)),
    rule("neg", conj=(13, 52), mod=5),
    rule("te", conj=(3,), ends=TE, other_than="で"),
    rule("teiru", conj=(3,), ends=TE, other_than="いて", mod=3),
    rule("teiru+", conj=(3,), ends=TE, other_than="いて", mod=6),
    rule("te+space", conj=(3,), ends=TE, other_than="で", connector=" ", mod=3),
    rule("kudasai", conj=(3,), ends=TE, other_than="で", connector=" ", fixed=360),
    rule("teren", conj=(3, 13), mod=4),
    rule("teii", conj=(3,), connector=" ", mod=1),
    rule("chau", surface="ち", add="て", cut=1, conj=(3,), mod=5),
    rule("chau", surface="じ", add="で", cut=1, conj=(3,), mod=5),
    rule("to", surface="と", add="て", cut=1, conj=(3,)),
    rule("to", surface="ど", add="で", cut=1, conj=(3,)),
    rule("suru", pos=("vs",), connector=" ", mod=5),
    rule("sou", conj=(13, 51), mod=1),
    rule("sou+", conj=(13, 51), mod=1),
    rule("rou", conj=(2,), mod=1),
    rule("adv", conj=(50,), mod=1),
    rule("sugiru", conj=(13, 51), mod=5),
    rule("sugiru", add="い", cut=1, pos=("adj-i",), mod=5),
    rule("sa", conj=(51,), pos=("adj-na",), mod=2, alone=True),
    rule("iadj", conj=(51,), mod=1),
    rule("garu", conj=(51,)),
    rule("ra", pos=("pn",), mod=1, alone=True),
    rule("rashii", conj=(2,), mod=3),
    rule("desu", conj=(1, 2), ends=("ない", "なかった"), connector=" ", fixed=200, alone=True),
    rule("desho", conj=(1, 2), ends=("ない", "なかった"), connector=" ", fixed=300),
    rule("tosuru", conj=(9,), connector=" ", mod=3),
    rule("kurai", conj=(2,), connector=" ", mod=3),
    abbreviation("nai", "ない", 2, conj=(1,)),
    abbreviation("nai-x", "ない", 2, conj=(1,)),
    abbreviation("nai-n", "ない", 2, conj=(1,), alone=True),
    abbreviation("nakereba", "なければ", 4),
    abbreviation("shimashou", "しましょう", 5),
    abbreviation("dewanai", "ではない", 4, alone=True),
    abbreviation("teba", "てば", 2, alone=True),
    abbreviation("reba", "れば", 2, alone=True),
    abbreviation("keba", "けば", 2, alone=True),
    abbreviation("geba", "げば", 2, alone=True),
    abbreviation("neba", "ねば", 2, alone=True),
    abbreviation("beba", "べば", 2, alone=True),
    abbreviation("meba", "めば", 2, alone=True),
    abbreviation("seba", "せば", 2, alone=True),
    abbreviation("ii", "いい", 2, alone=True),
)


def te_form(text: str = "text", *, besides: str = "で"):
    """A て form: ends so, and isn't the particle (or ``besides``) itself."""
    return (F.col(text).endswith("て") | F.col(text).endswith("で")) & (F.col(text) != besides)


def suffix_surfaces(keywords: DataFrame, forms: DataFrame, written: DataFrame) -> DataFrame:
    """(text, keyword, seq, kana): every kana form (root, seq, text) of the suffix entries (root, keyword), and surfaces written out.

    A text of two keywords keeps both, unless the written row says ``replace``.
    """
    made = keywords.join(forms, "root").select("text", "keyword", "seq", F.col("text").alias("kana"))
    replaced = made.join(written.filter("replace").select("text"), "text", "left_anti")
    return replaced.unionByName(written.select("text", "keyword", "seq", F.col("text").alias("kana"))).distinct()


def described(surfaces: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Adds ``about``, what a suffix of the keyword says."""
    table = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
    return surfaces.withColumn("about", F.element_at(table, F.col("keyword")))


def compounds(texts: DataFrame, suffixes: DataFrame, words: DataFrame, rules: DataFrame, *, key: str = "sent_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(key, start, end, part, kana, seqs, parts, keyword, mod, fixed, kind) of all compounds in ``texts``.

    ``words``: text, seq, kana, conj (array of types), pos (array).  Suffixes of suffixes follow in
    up to ``rounds`` rounds; each round joins only what the one before found.
    """
    longest = suffixes.agg(F.max(F.length("text"))).first()[0] or 1  # of some thousand surfaces
    starts = texts.filter(F.length(text) > 1).select(F.col(key).alias("sent_id"), F.col(text).alias("__t"), F.explode(F.sequence(F.lit(1), F.length(text) - 1)).alias("start"))
    tails = starts.withColumn("end", F.explode(F.sequence(F.col("start") + 1, F.least(F.length("__t"), F.col("start") + longest))))
    hits = suffix_hits(tails.withColumn("part", F.substring("__t", F.col("start") + 1, F.col("end") - F.col("start"))), suffixes).join(texts.select(F.col(key).alias("sent_id"), F.col(text).alias("__t")), "sent_id")
    hits = hits.join(suffixes.select(F.col("text").alias("part"), "keyword", "seq", "kana"), ["part", "keyword", "seq"]).join(F.broadcast(rules), "keyword").filter(F.col("part").startswith(F.col("surface")))
    hits = hits.select("sent_id", F.col("start").alias("mid"), "end", "__t", F.col("part").alias("suffix"), F.col("seq").alias("suffix_seq"), F.col("kana").alias("suffix_kana"), *[c.split(" ")[0] for c in RULES.split(", ")])
    fits = (
        ((F.size("conj") == 0) & (F.size("pos") == 0) | F.arrays_overlap(F.col("conj"), F.coalesce(F.col("w_conj"), F.array().cast("array<int>"))) | F.arrays_overlap(F.col("pos"), F.coalesce(F.col("w_pos"), F.array().cast("array<string>"))))
        & ((F.size("ends") == 0) | F.exists("ends", lambda e: F.col("lookup").endswith(e)))
        & (F.col("lookup") != F.col("other_than"))
    )
    roots = hits.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("mid") - LONGEST), F.col("mid") - 1)))
    roots = roots.withColumn("lookup", F.concat(F.substring("__t", F.col("start") + 1, F.col("mid") - F.col("start")), "add"))
    known = words.select(F.col("text").alias("lookup"), F.col("seq").alias("w_seq"), F.col("kana").alias("w_kana"), F.col("conj").alias("w_conj"), F.col("pos").alias("w_pos"))
    plain = roots.join(known, "lookup").filter(fits).withColumns({"w_seqs": F.array("w_seq"), "w_parts": F.array("lookup")})
    whole = words.select(F.col("text").alias("part")).distinct()
    out = found = made(plain, whole)
    for _ in range(rounds - 1):
        # a compound conjugates as its last part does
        last = words.select(F.col("seq").alias("l_seq"), F.col("text").alias("l_text"), F.col("conj").alias("w_conj"), F.col("pos").alias("w_pos"))
        inner = found.filter("kind = 'compound'").select("sent_id", "start", F.col("end").alias("mid"), F.col("kana").alias("w_kana"), F.col("seqs").alias("w_seqs"), F.col("parts").alias("w_parts"), F.element_at("seqs", -1).alias("l_seq"), F.element_at("parts", -1).alias("l_text"))
        inner = inner.join(last, ["l_seq", "l_text"], "left")
        again = hits.filter("add = ''").join(inner, ["sent_id", "mid"]).withColumn("lookup", F.substring("__t", F.col("start") + 1, F.col("mid") - F.col("start")))
        found = made(again.filter(fits), whole)
        out = out.unionByName(found)
    return out.distinct().withColumnRenamed("sent_id", key)


def made(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """The compounds of accepted roots; those that are words by themselves go where the rule says so."""
    kana = F.concat(F.substring("w_kana", F.lit(1), F.length("w_kana") - F.col("cut")), "connector", "suffix_kana")
    both = F.col("kind") == "compound"
    rows = rows.select("sent_id", "start", "end", F.substring("__t", F.col("start") + 1, F.col("end") - F.col("start")).alias("part"), kana.alias("kana"), F.when(both, F.concat("w_seqs", F.array("suffix_seq"))).otherwise(F.col("w_seqs")).alias("seqs"), F.when(both, F.concat("w_parts", F.array("suffix"))).otherwise(F.col("w_parts")).alias("parts"), "keyword", "mod", "fixed", "kind", "alone")
    free = rows.filter(~F.col("alone")).drop("alone")
    return free.unionByName(rows.filter("alone").drop("alone").join(whole, "part", "left_anti").select(free.columns)).distinct()
