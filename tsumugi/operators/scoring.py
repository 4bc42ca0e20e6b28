"""Scores of dictionary words, their filters, and what neighbours add, as Column expressions.

``scored`` takes rows of ``FEATURES``, one a candidate word, and returns its score without any
Python: features are joined once from the dictionary, and the score is arithmetic on them.
Splits and rules are tables: the caller's, by seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.functions.chars import CLASSES, mora_length

#: What a candidate is scored by.  ``conj``: how it is conjugated; ``uk_first``: its first sense is usually written in kana.
FEATURES = {
    "text": "string",
    "seq": "int",
    "ord": "int",
    "common": "int",
    "root": "boolean",
    "pos": "array<string>",
    "archaic": "boolean",
    "prefer_kana": "boolean",
    "uk_first": "boolean",
    "n_kanji": "int",
    "primary_nokanji": "boolean",
    "nokanji": "boolean",
    "counter": "boolean",
    "conj": "array<struct<from: int, via: int, conj_type: int, pos: string, neg: boolean, fml: boolean>>",
    "source_common": "int",
    "source_ord": "int",
    "copula": "boolean",
    "semi_final": "boolean",
    "non_final": "boolean",
    "only_final": "boolean",
    "skip": "boolean",
    "final": "boolean",
    "use_length": "int",
    "score_mod": "double",
}
# Length coefficients by class and length, the least score, and weak conjugations.
COEFFICIENTS = {"strong": (1, 8, 24, 40, 60), "weak": (1, 4, 9, 16, 25, 36), "tail": (4, 9, 16, 24), "ltail": (4, 12, 18, 24)}
CUTOFF = 5
# Forms are (pos, type, neg, fml), None for any.
WEAK_FORMS = ((None, 51, None, None), (None, 52, None, None), (None, 53, None, None), (None, 54, None, None), (None, 9, True, None))
SKIPPED_FORMS = ((None, 10, True, None), (None, 3, True, True), ("vs-s", 5, None, None))
# Seqs of words that are never looked for, of particles by where they stand, and of words that may cut a run of kanji.
SKIPPED = (2458040, 2822120, 2013800, 2108590, 2029040, 2428180, 2654250, 2561100, 2210270, 2210710, 2257550, 2210320, 2017560, 2394890, 2194000, 2568000, 2537250, 2760890, 2831062, 2831063, 2029030, 2568020, 900000)
FINAL = (2017770, 2425930, 2130430, 2029130, 2834812, 2718360, 2201380, 2722170, 2751630)
PARTICLES = {"semi_final": (*FINAL, 2029120, 2086640, 2029110, 2029080, 2029100), "non_final": (2139720,), "copula": (2089020,), "only_final": FINAL, "skip": SKIPPED}
UNBROKEN = (1169870, 1198360, 1277450, 2028980, 1423000, 1164690, 1587040, 2827864)
NOUNS = ("n", "n-adv", "n-t", "adj-na", "n-suf", "pn")
RARERU = ("られる", "られます", "られない", "られません")


def coefficient(n: Column, kind: str) -> Column:
    """The table's value at length ``n`` from 1; beyond it the last value grows with the length, and below it is 0."""
    table = COEFFICIENTS[kind]
    listed = F.get(F.array(*map(F.lit, table)), n - 1)
    return F.when(n < 1, 0).when(n <= len(table), listed).otherwise(F.floor(n * table[-1] / len(table)))


def power(n: Column, exponent: float, limit: int) -> Column:
    """n to a power up to ``limit``; from there the last value grows with the length."""
    return F.when(n <= limit, F.pow(n, F.lit(exponent))).otherwise(n * F.lit(float(limit) ** (exponent - 1)))


def modified(mod: Column, score: Column, n: Column) -> Column:
    """A factor on score and length; an array's factors add up."""
    return F.coalesce(mod, F.lit(0)) * score * n


def is_form(c: Column, forms: tuple) -> Column:
    """A conjugation (pos, conj_type, neg, fml) of ``forms``; None stands for any value, a null flag fits none other."""
    same = lambda flag, wanted: F.lit(True) if wanted is None else F.coalesce(flag == F.lit(wanted), F.lit(False))
    out = F.lit(False)
    for pos, kind, neg, fml in forms:
        out = out | (same(c["pos"], pos) & (c["conj_type"] == kind) & same(c["neg"], neg) & same(c["fml"], fml))
    return out


def skipped(conj: Column) -> Column:
    """All of a word's conjugations are forms that nobody looks for; words without any aren't skipped."""
    return (F.size(conj) > 0) & F.forall(conj, lambda c: is_form(c, SKIPPED_FORMS))


def direct(conj: Column) -> Column:
    """The direct conjugations where there are any, else all."""
    own = F.filter(conj, lambda c: c["via"].isNull())
    return F.when(F.size(own) > 0, own).otherwise(conj)


def with_score(rows: DataFrame) -> DataFrame:
    """Adds ``score`` and its parts ``prop``, ``kanji``, ``primary``, ``is_common``, ``long``; missing features are null.

    A word that is skipped, or a sentence-final particle elsewhere, scores 0.
    """
    missing = {c: F.lit(None).cast(t) for c, t in FEATURES.items() if c not in rows.columns}
    given = rows.columns
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    conj = F.coalesce("conj", F.array().cast(FEATURES["conj"]))
    rows = rows.withColumns(missing).withColumns({"__conj": direct(conj), "__second": (F.size(conj) > 0) & F.forall(conj, lambda c: c["via"].isNotNull())})
    text, types, used = F.col("text"), F.transform("__conj", lambda c: c["conj_type"]), F.col("use_length").isNotNull() & (F.col("use_length") > 0)
    rows = rows.withColumns({
        "__kanji": ~text.rlike(f"^[{CLASSES['kana']}]*$"),
        "__n": F.greatest(F.lit(1), mora_length(text)),
        "__signs": F.regexp_count(text, F.lit(f"[{CLASSES['kanji']}]")),
        "__root": yes("counter") | (yes("root") & (F.size("__conj") == 0)),
    })
    rows = rows.withColumns({
        "__kata": ~F.col("__kanji") & text.rlike(f"[{CLASSES['katakana-uniq']}]"),
        "__strong": F.col("__root") | used | F.exists("__conj", lambda c: ~is_form(c, WEAK_FORMS)),
    })
    own_common = F.when(F.col("__root") | (F.size("__conj") == 0), F.col("common"))
    inherited = (F.size("__conj") > 0) & own_common.isNull() & F.col("source_common").isNotNull()
    common = F.when(inherited, 0).otherwise(own_common)
    order = F.least(F.coalesce("ord", F.lit(0)), F.when(F.size("__conj") > 0, F.col("source_ord")))
    rows = rows.withColumns({"__common": common, "__ord": order})
    is_common, pos = F.col("__common").isNotNull(), F.coalesce("pos", F.array().cast("array<string>"))
    bound = (
        F.when(F.col("__kanji") & ~yes("prefer_kana") & ((F.col("__root") & (F.size("__conj") == 0)) | (used & F.array_contains(types, 13))), 2)
        .when(own_common.isNotNull() & (own_common > 0) & (own_common < 10), 2)
        .when(F.arrays_overlap(types, F.array(F.lit(3), F.lit(9))) & ~used, 4)
        .otherwise(3)
    )
    rows = rows.withColumn("__long", F.col("__n") > bound)
    no_entry, no_kanji = F.col("n_kanji").isNull(), F.coalesce(F.col("n_kanji") == 0, F.lit(False))
    particle = F.array_contains(pos, "prt")
    primary = ~yes("archaic") & (
        no_entry
        | (yes("prefer_kana") & F.col("__strong") & ~F.col("__kanji") & (~yes("primary_nokanji") | yes("nokanji")))
        | (((F.col("__ord") == 0) | yes("copula")) & (F.col("__kanji") | F.col("__strong")) & ((F.col("__kanji") & ~yes("prefer_kana")) | (is_common & F.array_contains(pos, "pn")) | no_kanji))
        | (yes("prefer_kana") & F.col("__kanji") & (F.col("__ord") == 0) & ~yes("uk_first"))
    )
    # each step is a column of its own: later ones name it several times
    rows = rows.withColumn("__primary", primary)
    gain = F.when(~F.col("__primary"), 0).when(F.col("__long"), 10).when(F.col("__second") & ~F.col("__kanji"), 2).when(is_common & F.col("__strong"), 5).when(yes("prefer_kana") | no_entry | no_kanji, 3).otherwise(2)
    ends = F.when(yes("final") & ~yes("non_final"), F.when(F.col("__primary"), 5).when(yes("semi_final"), 2).otherwise(0)).otherwise(0)
    of_particle = F.when(particle & (yes("final") | ~yes("semi_final")), 2 + F.when(is_common, 2 + F.col("__n")).otherwise(0) + ends).otherwise(0)
    large = F.when(F.col("__common") == 0, 10).when(~F.col("__primary"), F.greatest(15 - F.col("__common"), F.lit(10))).otherwise(F.greatest(20 - F.col("__common"), F.lit(10)))
    of_common = (
        F.when(F.col("__second") & ~used, F.when(F.col("__kanji") & F.col("__primary"), 4).otherwise(2))
        .when(F.col("__long") | yes("copula") | (F.col("__root") & (F.col("__kanji") | (F.col("__primary") & (F.col("__n") > 2)))), large)
        .when(F.col("__kanji"), 8)
        .when(F.col("__primary"), 4)
        .when((F.col("__n") > 2) | F.col("__common").between(1, 9), 3)
        .otherwise(2)
    )
    lone = particle | ~F.col("__strong") | (~F.col("__long") & (pos == F.array(F.lit("int"))))
    rows = rows.withColumns({"__gain": gain + of_particle, "__bonus": F.when(is_common & ~lone, of_common).otherwise(0)})
    rows = rows.withColumn("__prop", 1 + F.col("__gain") + F.col("__bonus") - F.when((F.col("__bonus") >= 10) & F.array_contains(types, 10), 4).otherwise(0))
    rows = rows.withColumn("__prop", F.when(F.col("__long"), F.greatest("__n", "__prop")).otherwise(F.col("__prop")))
    floor = F.when(yes("archaic"), 3).otherwise(5)
    of_kanji = F.greatest(floor, F.col("__prop")) + F.when(F.col("__long") & ((F.col("__signs") > 1) | (F.col("__n") > 4)), 2).otherwise(0)
    rows = rows.withColumn("__prop", F.when(F.col("__kanji"), of_kanji).otherwise(F.col("__prop")))
    rows = rows.withColumn("prop", F.when(yes("counter"), F.greatest(F.lit(5), F.col("__prop"))).otherwise(F.col("__prop")).cast("long"))
    heavy = F.col("__kanji") | F.col("__kata")
    score = F.col("prop") * (F.when(heavy, coefficient(F.col("__n"), "strong")).otherwise(coefficient(F.col("__n"), "weak")) + F.when(F.col("__signs") > 1, (F.col("__signs") - 1) * 5).otherwise(0))
    more = F.col("use_length") - F.col("__n")
    tail = F.when((F.col("__n") > 3) & heavy, coefficient(more, "ltail")).otherwise(coefficient(more, "tail"))
    score = score + F.when(used, F.col("prop") * tail + modified(F.col("score_mod"), F.col("prop"), more)).otherwise(0)
    gone = (skipped(F.col("__conj")) & ~F.col("__root")) | yes("skip") | (yes("only_final") & ~yes("final"))
    out = rows.withColumns({"score": F.when(gone, 0).otherwise(score).cast("long"), "kanji": heavy, "primary": F.col("__primary"), "is_common": is_common, "long": F.col("__long")})
    return out.select(*given, "prop", "score", "kanji", "primary", "is_common", "long")


def kanji_break(score: Column, pos: Column, text: Column, at: Column) -> Column:
    """Half the score, and a bonus, where a word cuts a run of kanji at its ``at``: beg, end or both; null: nowhere.

    Scores below the cutoff stay, and so do words that begin with す at such a place.
    """
    bonus = F.when((at == "beg") & F.array_contains(pos, "num"), 5).otherwise(0) + F.when((at == "beg") & F.arrays_overlap(pos, F.array(F.lit("suf"), F.lit("n-suf"))), 10).otherwise(0) + F.when((at == "end") & F.array_contains(pos, "pref"), 12).otherwise(0)
    free = at.isNull() | (score < CUTOFF) | ((at == "beg") & text.startswith("す"))
    return F.when(free, score).otherwise(F.greatest(F.lit(CUTOFF), F.ceil(score / 2) + bonus)).cast("long")


def culled(rows: DataFrame, span: list[str]) -> DataFrame:
    """Candidates of a span that score half of its best or more, and the cutoff at least; common ones and smaller seqs come first."""
    best = Window.partitionBy(*span)
    place = Window.partitionBy(*span).orderBy(F.desc("score"), F.col("common").isNull(), F.col("common") != 0, "common", "seq")
    # behind the window, where no filter is pushed into the score's expression
    kept = (F.col("score") >= CUTOFF) & (F.col("score") * 2 >= F.col("__best"))
    return rows.withColumn("__best", F.max("score").over(best)).filter(kept).withColumn("rank", F.row_number().over(place)).drop("__best")


def shown(rows: DataFrame, span: list[str]) -> DataFrame:
    """Candidates that a token shows as alternatives: two thirds of the best score or more."""
    return rows.withColumn("__best", F.max("score").over(Window.partitionBy(*span))).filter("score * 3 >= __best * 2").drop("__best")


def split_scores(rows: DataFrame, splits: DataFrame, parts: DataFrame) -> DataFrame:
    """Scores of words that a split (seq, kind, mod) takes apart.

    ``score`` adds ``mod``; ``pscore`` scales by the changed proportion; ``parts`` is ``mod`` and
    the sum of the parts' scores (seq, part, score).  A seq without a split keeps its score.
    """
    sums = parts.groupBy("seq").agg(F.sum("score").alias("__parts"))
    both = rows.join(splits.select("seq", F.col("kind").alias("__kind"), F.col("mod").alias("__mod")), "seq", "left").join(sums, "seq", "left")
    fresh = F.greatest(F.lit(1), F.col("prop") + F.col("__mod"))
    score = F.when(F.col("__kind") == "score", F.col("score") + F.col("__mod")).when(F.col("__kind") == "pscore", F.ceil(F.col("score") * fresh / F.col("prop"))).when((F.col("__kind") == "parts") & F.col("__parts").isNotNull(), F.col("__mod") + F.col("__parts")).otherwise(F.col("score"))
    return both.withColumns({"score": score.cast("long"), "prop": F.when(F.col("__kind") == "pscore", fresh).otherwise(F.col("prop")).cast("long")}).select(*rows.columns)


def split_parts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """(seq, part, text) of words cut by rules (seq, part, start, length): a negative start counts from the end, a null length goes on to it."""
    both = rows.select("seq", "text").join(cuts, "seq")
    begin = F.when(F.col("start") < 0, F.length("text") + F.col("start")).otherwise(F.col("start"))
    return both.withColumn("__b", begin).select("seq", "part", F.substring("text", F.col("__b") + 1, F.coalesce("length", F.length("text"))).alias("text"))


def prefixed_cuts(seqs: DataFrame, size: int, other: str = "rest") -> DataFrame:
    """Cut rules for words that begin with the same small word of ``size`` characters (で-, ど-, し-): that word and the rest."""
    rows = F.array(F.struct(F.lit("head").alias("part"), F.lit(0).alias("start"), F.lit(size).alias("length")), F.struct(F.lit(other).alias("part"), F.lit(size).alias("start"), F.lit(None).cast("int").alias("length")))
    return seqs.select("seq", F.explode(rows).alias("c")).select("seq", "c.*")


def with_prefix(text: Column, prefix: str) -> Column:
    """The text with the prefix that it may lack."""
    return F.when(text.startswith(prefix), text).otherwise(F.concat(F.lit(prefix), text))


def segment_splits(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Another candidate for each hit that a rule (seq, delta, parts array of seqs) takes apart: it scores ``delta`` more and names its parts."""
    made = hits.join(rules, "seq").withColumn("score", F.col("score") + F.col("delta")).drop("delta")
    return hits.withColumn("parts", F.lit(None).cast("array<int>")).unionByName(made)


def resorted(rows: DataFrame, span: list[str]) -> DataFrame:
    """``rank`` by score in each span, ties as they came."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*span).orderBy(F.desc("score"), F.col("parts").isNotNull(), "seq")))


# Filters of a segment: ``kanji``, ``primary``, ``is_common``, ``long`` and the arrays ``pos``, ``seq_set``, ``conj_types``.


def is_noun() -> Column:
    word = F.col("long") | F.col("kanji") | (F.col("primary") & F.col("is_common"))
    return F.coalesce((word & F.arrays_overlap("pos", F.array(*map(F.lit, NOUNS)))) | (F.array_contains("pos", "ctr") & (F.size("seq_set") > 0)), F.lit(False))


def is_pos(*tags: str, test: Column) -> Column:
    return F.coalesce(test & F.arrays_overlap("pos", F.array(*map(F.lit, tags))), F.lit(False))


def in_seqs(*seqs: int, simple: bool = False) -> Column:
    """One of the segment's seqs is listed; ``simple`` asks that the word isn't a compound."""
    found = F.arrays_overlap("seq_set", F.array(*map(F.lit, seqs)))
    return F.coalesce(found & ~F.coalesce(F.size("parts") > 1, F.lit(False)) if simple else found, F.lit(False))


def is_conjugation(kind: int) -> Column:
    return F.coalesce(F.array_contains("conj_types", kind), F.lit(False))


def ends_with_seq(*seqs: int) -> Column:
    """The last part of a compound is listed."""
    return F.coalesce((F.size("parts") > 1) & F.get("parts", F.size("parts") - 1).isin(*seqs), F.lit(False))


def ends_with_text(*texts: str) -> Column:
    return F.coalesce((F.size("part_texts") > 1) & F.get("part_texts", F.size("part_texts") - 1).isin(*texts), F.lit(False))


def short_kana(most: int, *besides: str) -> Column:
    return F.coalesce((F.col("end") - F.col("start") <= most) & ~F.col("kanji") & ~F.col("text").isin(*besides, ""), F.lit(False))


def rare_passive(prop: Column, text: Column) -> Column:
    """A passive of an ichidan verb whose text doesn't end like one: れる forms are potentials."""
    ends = F.lit(False)
    for e in RARERU:
        ends = ends | text.endswith(e)
    return (prop["conj_type"] == 6) & prop["pos"].isin("v1", "v1s", "vk") & ~ends


def ordered_conjugations(rows: DataFrame) -> DataFrame:
    """``rank`` of a word's conjugations (seq, id, via, types array): direct ones first, then by their least type, 10 and 13 changing places."""
    swap = F.transform("types", lambda t: F.when(t == 10, 13).when(t == 13, 10).otherwise(t))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("seq").orderBy(F.col("via").isNotNull(), F.array_min(swap), "id")))


def by_order(rows: DataFrame, group: list[str]) -> DataFrame:
    """``rank`` of conjugated readings by the source's order, then the ending's."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("ord", "onum", "text")))
