"""Dictionary look-ups as joins over the tables of a dictionary.

Tables (see ``tsumugi.sources.schema``):

* ``readings``: seq, script (kanji or kana), ord, text, common, nokanji
* ``entry``: seq, root_p, n_kanji, n_kana, primary_nokanji
* ``glosses``: seq, sense_ord, ord, text; ``sense_props``: seq, sense_ord, tag, ord, text
* ``restricted``: seq, reading, text
* ``conjugations``: id, seq, from, via; ``conj_props``: conj_id, conj_type, pos, neg, fml;
  ``conj_sources``: conj_id, text, source_text

A word to look up is a row with ``text``; all joins are on text or seq, so their sides are dealt
out by those keys, and the few rule tables (suffix classes) are small by nature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.functions.chars import CLASSES, as_hiragana

# Tags of words that are no longer in use.
ARCHAIC = ("arch", "obsc", "rare")


def script_of(text: Column) -> Column:
    return F.when(text.rlike(f"^[{CLASSES['kana']}]+$"), "kana").otherwise("kanji")


def words(texts: DataFrame, readings: DataFrame, entry: DataFrame | None = None) -> DataFrame:
    """Readings whose text is one of ``texts``, in the table of the word's script; with ``entry`` of root entries alone."""
    wanted = texts.select("text").distinct().withColumn("script", script_of(F.col("text")))
    found = readings.join(wanted, ["text", "script"], "left_semi")
    return found if entry is None else found.join(entry.filter("root_p").select("seq"), "seq", "left_semi")


def word_readings(texts: DataFrame, readings: DataFrame) -> DataFrame:
    """(text, readings): a word in kana reads as itself, one in kanji as the kana of its entries, by seq and order."""
    wanted = texts.select("text").distinct()
    own = wanted.filter(script_of(F.col("text")) == "kana").select("text", F.array("text").alias("readings"))
    of_kanji = wanted.filter(script_of(F.col("text")) == "kanji").join(readings.filter("script = 'kanji'").select("text", "seq"), "text")
    kana = readings.filter("script = 'kana'").select("seq", "ord", F.col("text").alias("kana"))
    rows = of_kanji.join(kana, "seq").groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ord", "kana"))), lambda r: r["kana"]).alias("readings"))
    return own.unionByName(rows)


def text_and_seq(pairs: DataFrame, readings: DataFrame) -> DataFrame:
    """Readings with a (text, seq) of ``pairs``."""
    return readings.join(pairs.select("text", "seq").distinct(), ["text", "seq"], "left_semi")


def conjugated_from(texts: DataFrame, seqs: DataFrame, readings: DataFrame, conjugations: DataFrame) -> DataFrame:
    """Readings of ``texts`` that belong to an entry of ``seqs`` or to one conjugated from it, each once."""
    found = words(texts, readings)
    wanted = seqs.select("seq").distinct()
    direct = found.join(wanted, "seq", "left_semi")
    forms = conjugations.join(wanted.withColumnRenamed("seq", "from"), "from", "left_semi").select("seq").distinct()
    return direct.unionByName(found.join(forms, "seq", "left_semi")).distinct()


def with_pos(texts: DataFrame, readings: DataFrame, sense_props: DataFrame, *pos: str) -> DataFrame:
    """Readings of entries that have a sense of such a word class."""
    tagged = sense_props.filter((F.col("tag") == "pos") & F.col("text").isin(*pos)).select("seq")
    return words(texts, readings).join(tagged, "seq", "left_semi")


def with_conjugation(texts: DataFrame, readings: DataFrame, conjugations: DataFrame, conj_props: DataFrame, fits: Column, *, allow_root: bool = False) -> DataFrame:
    """Readings with the ids of their conjugations that ``fits`` (on columns of ``conj_props``) holds for.

    ``allow_root`` keeps words that aren't conjugated at all, with no ids.
    """
    props = conj_props.groupBy(F.col("conj_id").alias("id")).agg(F.max(F.coalesce(fits, F.lit(False))).alias("ok"))
    per_seq = conjugations.join(props, "id").groupBy("seq").agg(F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("id")))).alias("conj_ids"))
    found = words(texts, readings).join(per_seq, "seq", "left")
    kept = F.size("conj_ids") > 0
    rows = found.filter(kept | F.col("conj_ids").isNull()) if allow_root else found.filter(kept)
    return rows.withColumn("conj_ids", F.coalesce("conj_ids", F.array().cast("array<long>")))


def with_suffix(compounds: DataFrame, suffix_classes: DataFrame, *classes: str) -> DataFrame:
    """Compounds (text, seqs array) whose last part is a suffix (seq, class) of one of the classes."""
    wanted = suffix_classes.filter(F.col("class").isin(*classes)).select(F.col("seq").alias("__last")).distinct()
    return compounds.withColumn("__last", F.get("seqs", F.size("seqs") - 1)).join(wanted, "__last", "left_semi").drop("__last")


def or_as_hiragana(texts: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``find`` has for a text, else what it has for the text in hiragana; ``word`` is the text asked for."""
    wanted = texts.select("text").distinct()
    found = find(wanted).withColumn("word", F.col("text"))
    rest = wanted.join(found.select("text"), "text", "left_anti").select(F.col("text").alias("word"), as_hiragana(F.col("text")).alias("text"))
    again = find(rest.select("text")).join(rest, "text")
    return found.unionByName(again)


def katakana_proxies(texts: DataFrame, readings: DataFrame, entry: DataFrame) -> DataFrame:
    """Root words that a text in katakana spells in hiragana, without the entries that the text finds itself."""
    wanted = texts.filter(F.col("text").rlike(f"^[{CLASSES['katakana']}]+$")).select(F.col("text").alias("word"), as_hiragana(F.col("text")).alias("text")).distinct()
    found = words(wanted.select(F.col("word").alias("text")), readings).select(F.col("text").alias("word"), "seq")
    roots = readings.filter("script = 'kana'").join(entry.filter("root_p").select("seq"), "seq", "left_semi")
    return roots.join(wanted, "text").filter("word <> text").join(found, ["word", "seq"], "left_anti")


def paired_by_conjugation(left: DataFrame, right: DataFrame, conjugations: DataFrame) -> DataFrame:
    """(key, left, right): words (text, seq) of two lists that are conjugated from the same entries, else null on one side.

    Of several words of a list with one key the last by seq counts.
    """
    keys = conjugations.groupBy("seq").agg(F.array_sort(F.collect_set(F.struct(F.col("from"), F.coalesce("via", F.lit(-1)).alias("via")))).alias("key"))
    side = lambda rows, name: rows.join(keys, "seq").groupBy("key").agg(F.max_by("text", F.struct("seq", "text")).alias(name))
    return side(left, "left").join(side(right, "right"), "key", "full")


def kana_forms(seqs: DataFrame, readings: DataFrame, conjugations: DataFrame, conj_props: DataFrame, skipped: Column) -> DataFrame:
    """(root, seq, text): kana of the entries and of what is conjugated from them; forms whose every property is ``skipped`` are left out."""
    kana = readings.filter("script = 'kana'").select("seq", "text")
    wanted = seqs.select(F.col("seq").alias("root")).distinct()
    direct = wanted.join(kana, wanted["root"] == kana["seq"]).select("root", "seq", "text")
    strong = conj_props.groupBy(F.col("conj_id").alias("id")).agg(F.min(F.coalesce(skipped, F.lit(False))).alias("weak")).filter("not weak").select("id")
    edges = conjugations.join(wanted, F.col("from") == F.col("root")).join(strong, "id", "left_semi").select("root", "seq").distinct()
    return direct.unionByName(edges.join(kana, "seq").select("root", "seq", "text")).distinct()


def parents(forms: DataFrame, conjugations: DataFrame, conj_sources: DataFrame, readings: DataFrame) -> DataFrame:
    """(seq, text, parent, source): the reading that a form (seq, text) comes from, of the intermediate entry where there is one."""
    edges = conjugations.select("id", "seq", F.coalesce("via", "from").alias("parent"))
    linked = forms.select("seq", "text").join(edges, "seq").join(conj_sources.select(F.col("conj_id").alias("id"), "text", F.col("source_text").alias("source")), ["id", "text"])
    return linked.join(readings.select(F.col("seq").alias("parent"), F.col("text").alias("source")), ["parent", "source"], "left_semi").select("seq", "text", "parent", "source").distinct()


def conjugation_data(forms: DataFrame, conjugations: DataFrame, conj_props: DataFrame, conj_sources: DataFrame) -> DataFrame:
    """(seq, text, from, via, props, sources): how each form (seq, text) is conjugated; forms without rows have none."""
    props = conj_props.groupBy(F.col("conj_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("conj_type", "pos", "neg", "fml"))).alias("props"))
    sources = conj_sources.groupBy(F.col("conj_id").alias("id"), "text").agg(F.array_sort(F.collect_set("source_text")).alias("sources"))
    return forms.select("seq", "text").join(conjugations, "seq").join(sources, ["id", "text"]).join(props, "id").select("seq", "text", "from", "via", "props", "sources")


def original_texts(forms: DataFrame, conjugations: DataFrame, conj_sources: DataFrame) -> DataFrame:
    """(seq, text, from, original): the spelling of the first entry that a form comes from, over one intermediate form at most."""
    edges = conjugations.select(F.col("id").alias("conj_id"), "seq", "from", "via")
    step = edges.join(conj_sources, "conj_id").select("seq", "from", "via", "text", "source_text")
    own = forms.select("seq", "text").join(step, ["seq", "text"])
    direct = own.filter("via is null").select("seq", "text", "from", F.col("source_text").alias("original"))
    back = step.filter("via is null").select(F.col("seq").alias("via"), "from", F.col("text").alias("source_text"), F.col("source_text").alias("original"))
    return direct.unionByName(own.filter("via is not null").join(back, ["via", "from", "source_text"]).select("seq", "text", "from", "original")).distinct()


def without_conjugation(entry: DataFrame, conjugations: DataFrame) -> DataFrame:
    return entry.join(conjugations.select("seq"), "seq", "left_anti")


def archaic_senses(sense_props: DataFrame) -> DataFrame:
    return sense_props.filter((F.col("tag") == "misc") & F.col("text").isin(*ARCHAIC)).select("seq", "sense_ord").distinct()


def current_pos(sense_props: DataFrame) -> DataFrame:
    """(seq, pos): the word classes of senses that are in use."""
    rows = sense_props.filter("tag = 'pos'").join(archaic_senses(sense_props), ["seq", "sense_ord"], "left_anti")
    return rows.groupBy("seq").agg(F.array_sort(F.collect_set("text")).alias("pos"))


def archaic(glosses: DataFrame, sense_props: DataFrame, conjugations: DataFrame) -> DataFrame:
    """(seq) of entries all of whose senses are archaic, and of everything conjugated from them."""
    old = archaic_senses(sense_props).withColumn("old", F.lit(True))
    every = glosses.select("seq", "sense_ord").distinct().join(old, ["seq", "sense_ord"], "left").groupBy("seq").agg(F.bool_and(F.coalesce("old", F.lit(False))).alias("all_old")).filter("all_old").select("seq")
    return every.unionByName(conjugations.join(every.withColumnRenamed("seq", "from"), "from", "left_semi").select("seq")).distinct()


def counter_restrictions(sense_props: DataFrame) -> DataFrame:
    """(seq, tag, text): the spellings that counter senses are limited to."""
    counters = sense_props.filter("tag = 'pos' and text = 'ctr'").select("seq", "sense_ord").distinct()
    return sense_props.filter("tag in ('stagk', 'stagr')").join(counters, ["seq", "sense_ord"], "left_semi").select("seq", "tag", "text").distinct()


def words_with_kanji(char: str, entry: DataFrame, readings: DataFrame, best: DataFrame) -> DataFrame:
    """(seq, text, reading, common): root words spelled with ``char``, with their best kana (seq, text, best)."""
    spelled = readings.filter((F.col("script") == "kanji") & F.col("text").contains(char)).join(entry.filter("root_p").select("seq"), "seq", "left_semi")
    return spelled.join(best.select("seq", "text", F.col("best").alias("reading")), ["seq", "text"]).select("seq", "text", "reading", "common")


def char_usage(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(c, n): the number of different ``key`` whose ``text`` has the character; a null key is none.

    A task holds what it has met of each key in memory.  So the rows are dealt out first, each by a number of its own:
    else one task would meet all of a large row group, or all rows of a frequent key.  And a character takes one bit of
    a key: its bytes are read as a number, and 64 numbers in a row share one word of bits.
    """
    dealt = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")).repartition("row")
    met = dealt.select("key", F.explode(F.split("text", "")).alias("c")).filter("c <> ''").select("key", F.conv(F.hex("c"), 16, 10).cast("long").alias("v"))
    held = met.groupBy("key", F.shiftright("v", 6).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(v % 64 as int))")).alias("bits"))
    each = held.select("key", "block", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)).alias("bit"))
    counts = each.groupBy("block", "bit").agg(F.count("key").alias("n"))
    return counts.select(F.unhex(F.hex(F.col("block") * 64 + F.col("bit"))).cast("string").alias("c"), "n")


def kanji_usage(readings: DataFrame) -> DataFrame:
    """(kanji, words): entries with a common spelling that has the character, each counted once."""
    used = char_usage(readings.filter("script = 'kanji' and common is not null"), "seq", "text")
    return used.filter(F.col("c").rlike(f"^[{CLASSES['kanji-char']}]$")).select(F.col("c").alias("kanji"), F.col("n").alias("words"))


def reading_usage(kanji_readings: DataFrame, usage: DataFrame) -> DataFrame:
    """(kanji, type, text, words): each reading with the number of common words of its character."""
    return kanji_readings.select("kanji", "type", "text").distinct().join(usage, "kanji", "left").select("kanji", "type", "text", F.coalesce("words", F.lit(0)).cast("long").alias("words"))


def greatest_common(readings: DataFrame) -> DataFrame:
    """(seq, common): the largest number over both scripts; null where no reading is common."""
    return readings.groupBy("seq").agg(F.max("common").alias("common"))


def best_readings(readings: DataFrame, restricted: DataFrame) -> DataFrame:
    """(seq, script, text, best): for a spelling in kanji its first kana, for a kana its first kanji.

    Partners that a restriction rules out don't count, nor do kana that go with no kanji.
    """
    kanji = readings.filter("script = 'kanji'").select("seq", F.col("text").alias("k"), F.col("ord").alias("k_ord"))
    kana = readings.filter("script = 'kana' and not coalesce(nokanji, false)").select("seq", F.col("text").alias("r"), F.col("ord").alias("r_ord"))
    limits = restricted.groupBy("seq", F.col("reading").alias("r")).agg(F.collect_set("text").alias("only"))
    pairs = kanji.join(kana, "seq").join(limits, ["seq", "r"], "left").filter(F.col("only").isNull() | F.array_contains("only", F.col("k")))
    side = lambda own, other, script: pairs.groupBy("seq", F.col(own).alias("text")).agg(F.min_by(F.col(other), F.struct(F.col(f"{other}_ord"), F.col(other))).alias("best")).select("seq", F.lit(script).alias("script"), "text", "best")
    return side("k", "r", "kanji").unionByName(side("r", "k", "kana"))


def reading_signatures(readings: DataFrame) -> DataFrame:
    """(seq, kanji, kana): the sorted distinct readings of each entry."""
    of = lambda script: F.array_sort(F.collect_set(F.when(F.col("script") == script, F.col("text"))))
    return readings.groupBy("seq").agg(of("kanji").alias("kanji"), of("kana").alias("kana"))


def entries_with_readings(wanted: DataFrame, readings: DataFrame) -> DataFrame:
    """(id, seq): entries that have all readings (script, text) which ``wanted`` (id, script, text) lists; others of theirs don't matter."""
    needed = wanted.select("id", "script", "text").distinct()
    size = needed.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    met = needed.join(readings.select("seq", "script", "text").distinct(), ["script", "text"]).groupBy("id", "seq").agg(F.count(F.lit(1)).alias("m"))
    return met.join(size, "id").filter("m = n").select("id", "seq")


def short_glosses(glosses: DataFrame, sense_props: DataFrame | None = None, *pos: str) -> DataFrame:
    """(seq, gloss): the first sense, its glosses joined in order; with ``pos`` the first sense of such a word class."""
    senses = glosses.groupBy("seq", "sense_ord").agg(joined_glosses().alias("gloss"))
    if pos:
        tagged = sense_props.filter((F.col("tag") == "pos") & F.col("text").isin(*pos)).select("seq", "sense_ord")
        senses = senses.join(tagged, ["seq", "sense_ord"], "left_semi")
    return senses.groupBy("seq").agg(F.min_by("gloss", "sense_ord").alias("gloss"))


def joined_glosses() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda g: g["text"]), "; ")


def gloss_matches(candidates: DataFrame, readings: DataFrame, glosses: DataFrame) -> DataFrame:
    """(id, seq, kind) for new entries (id, text, reading, glosses) that a known one spells and reads alike.

    ``full``: every gloss of the new entry stands in one of the known entry's; ``partial``: some does.
    Case doesn't count.  The rest has no row.
    """
    spelled = candidates.join(readings.select("seq", "text"), "text").join(readings.select("seq", F.col("text").alias("reading")), ["seq", "reading"], "left_semi")
    known = glosses.groupBy("seq").agg(F.collect_set(F.lower("text")).alias("known"))
    has = lambda g: F.exists("known", lambda k: k.contains(F.lower(g)))
    kind = F.when(F.forall("glosses", has), "full").when(F.exists("glosses", has), "partial")
    return spelled.join(known, "seq").withColumn("kind", kind).filter("kind is not null").select("id", "seq", "kind").distinct()


def suffix_hits(parts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Substrings (sent_id, start, end, part) that a suffix (text, keyword, seq) spells."""
    return parts.join(suffixes.withColumnRenamed("text", "part"), "part").select("sent_id", "start", "end", "part", "keyword", "seq")


def first_by_order(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """One row of each group, the first by ``order``; what a LIMIT 1 look-up gives, with the order stated."""
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter("__rank = 1").drop("__rank")


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the rows of each table, counted in one pass over each."""
    counts = [t.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, t in sorted(tables.items())]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
