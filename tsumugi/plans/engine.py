"""Queries that run the Japanese engine's operators on the fixture dictionary; their SQL are the rows expected by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsumugi.functions import chars, kana, predicates, spelling, table
from tsumugi.operators import analysis, compounds, conjugation, counters, lattice, lookup, macros, neighbours, patches, patterns, presentation, readings, scoring, tokens
from tsumugi.plans import fixtures
from tsumugi.sinks import answers
from tsumugi.sources import dictionary, tables as store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KINDS = {"int": "INTEGER", "long": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def cell(value, kind: str) -> str:
    if value is None:
        text = "NULL"
    elif isinstance(value, bool):
        text = str(value).upper()
    elif isinstance(value, (int, float)):
        text = str(value)
    else:
        text = "'" + value.replace("'", "''") + "'"
    return f"CAST({text} AS {KINDS[kind]})"


def expected(names: str, rows: list[tuple]) -> str:
    """The rows as SQL values with the column types of ``names``."""
    fields = [f.split(" ") for f in names.split(", ")]
    lines = ["(" + ", ".join(cell(v, k) for v, (_, k) in zip(r, fields, strict=True)) + ")" for r in rows]
    listed = ", ".join(f'"{n}"' for n, _ in fields)
    return f"SELECT * FROM (VALUES {', '.join(lines)}) AS t({listed})"


def query(names: str, rows: list[tuple]):
    """Register a function of the session under its name, with the rows that it must give."""

    def register(function: Callable[[SparkSession], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(spark).select(*[F.col(f.split(" ")[0]).cast({"long": "bigint"}.get(k := f.split(" ")[1], k)).alias(f.split(" ")[0]) for f in names.split(", ")])

        QUERIES[function.__name__] = run
        ORACLES[function.__name__] = expected(names, rows)
        return function

    return register


def texts(spark: SparkSession, *words: str) -> DataFrame:
    return fixtures.local(spark, [(w,) for w in words], "text string")


def joined(column: str, mark: str = ",") -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), mark)


# --- look-ups


@query("seq int, text string", [(5, "食べる"), (10, "はし"), (11, "はし"), (12, "はし"), (6, "いく"), (101, "食べた")])
def word_lookup(spark):
    t = fixtures.tables(spark)
    return lookup.words(texts(spark, "食べる", "はし", "いく", "食べた", "無い"), t["readings"])


@query("seq int, text string", [(5, "食べる"), (10, "はし"), (11, "はし"), (12, "はし"), (6, "いく")])
def word_lookup_root_only(spark):
    t = fixtures.tables(spark)
    return lookup.words(texts(spark, "食べる", "はし", "いく", "食べた", "無い"), t["readings"], t["entry"])


@query("text string, readings string", [("今日", "きょう,こんにち"), ("はし", "はし"), ("明日", "あした,あす,みょうにち"), ("行く", "いく,ゆく")])
def word_readings(spark):
    return lookup.word_readings(texts(spark, "今日", "はし", "明日", "行く", "無い"), fixtures.tables(spark)["readings"]).withColumn("readings", joined("readings"))


@query("seq int, text string", [(10, "はし"), (12, "はし"), (11, "橋")])
def lookup_by_text_and_seq(spark):
    pairs = fixtures.local(spark, [("はし", 10), ("はし", 12), ("橋", 11), ("橋", 10)], "text string, seq int")
    return lookup.text_and_seq(pairs, fixtures.tables(spark)["readings"])


@query("seq int, text string", [(101, "食べた"), (102, "食べて"), (5, "食べる")])
def conjugated_form_lookup(spark):
    t = fixtures.tables(spark)
    seqs = fixtures.local(spark, [(5,)], "seq int")
    return lookup.conjugated_from(texts(spark, "食べた", "食べて", "行った", "食べる"), seqs, t["readings"], t["conjugations"])


@query("seq int, text string", [(18, "勉強"), (5, "食べる")])
def pos_lookup(spark):
    t = fixtures.tables(spark)
    return lookup.with_pos(texts(spark, "勉強", "学生", "食べる"), t["readings"], t["sense_props"], "vs", "v1")


@query("seq int, ids string", [(101, "1"), (103, "3"), (5, "")])
def conj_property_lookup(spark):
    t = fixtures.tables(spark)
    fits = (F.col("conj_type") == 2) | F.col("neg")
    found = lookup.with_conjugation(texts(spark, "食べた", "食べない", "食べる", "食べられる"), t["readings"], t["conjugations"], t["conj_props"], fits, allow_root=True)
    return found.withColumn("ids", joined("conj_ids"))


@query("text string", [("食べたい",)])
def suffix_class_lookup(spark):
    made = fixtures.local(spark, [("食べたい", [5, 201]), ("高さ", [7, 202])], "text string, seqs array<int>")
    return lookup.with_suffix(made, fixtures.local(spark, [(201, "tai"), (202, "sa")], "seq int, class string"), "tai")


@query("word string, seq int", [("パン", 16), ("ハシ", 10), ("ハシ", 11), ("ハシ", 12)])
def hiragana_fallback(spark):
    t = fixtures.tables(spark)
    return lookup.or_as_hiragana(texts(spark, "パン", "ハシ", "ヌ"), lambda w: lookup.words(w, t["readings"]))


@query("word string, seq int, text string", [("ハシ", 10, "はし"), ("ハシ", 11, "はし"), ("ハシ", 12, "はし"), ("タベル", 5, "たべる")])
def katakana_proxy(spark):
    t = fixtures.tables(spark)
    return lookup.katakana_proxies(texts(spark, "ハシ", "パン", "タベル", "タベタ", "食べる"), t["readings"], t["entry"])


@query("origin int, left string, right string", [(5, "食べた", "食べない"), (6, "行った", None), (7, None, "高くない")])
def pair_by_conjugation(spark):
    t = fixtures.tables(spark)
    side = lambda rows: fixtures.local(spark, rows, "text string, seq int")
    pairs = lookup.paired_by_conjugation(side([("食べた", 101), ("行った", 109)]), side([("食べない", 103), ("高くない", 110)]), t["conjugations"])
    return pairs.withColumn("origin", F.col("key")[0]["from"])


@query("seq int, text string", [(5, "たべる"), (101, "たべた"), (102, "たべて"), (103, "たべない"), (104, "たべられる"), (105, "たべられた"), (108, "たべ")])
def all_kana_forms(spark):
    t = fixtures.tables(spark)
    weak = scoring.is_form(F.struct("pos", "conj_type", "neg", "fml"), scoring.SKIPPED_FORMS)
    return lookup.kana_forms(fixtures.local(spark, [(5,)], "seq int"), t["readings"], t["conjugations"], t["conj_props"], weak)


FORM = "seq int, text string"


@query("seq int, text string, parent int, source string", [(105, "食べられた", 104, "食べられる"), (101, "食べた", 5, "食べる"), (101, "たべた", 5, "たべる")])
def parent_reading(spark):
    t = fixtures.tables(spark)
    return lookup.parents(fixtures.local(spark, [(105, "食べられた"), (101, "食べた"), (101, "たべた"), (5, "食べる")], FORM), t["conjugations"], t["conj_sources"], t["readings"])


@query("seq int, origin int, via int, types string, sources string", [(104, 5, None, "5,6", "食べる"), (105, 5, 104, "2", "食べられる")])
def conjugation_data(spark):
    t = fixtures.tables(spark)
    found = lookup.conjugation_data(fixtures.local(spark, [(104, "食べられる"), (105, "食べられた"), (5, "食べる")], FORM), t["conjugations"], t["conj_props"], t["conj_sources"])
    return found.select("seq", F.col("from").alias("origin"), "via", joined("props.conj_type").alias("types"), joined("sources").alias("sources"))


@query("seq int, text string, original string", [(105, "食べられた", "食べる"), (101, "たべた", "たべる"), (104, "食べられる", "食べる")])
def original_text(spark):
    t = fixtures.tables(spark)
    return lookup.original_texts(fixtures.local(spark, [(105, "食べられた"), (101, "たべた"), (104, "食べられる")], FORM), t["conjugations"], t["conj_sources"])


@query("n long, roots long", [(30, 30)])
def entries_without_conjugation(spark):
    t = fixtures.tables(spark)
    return lookup.without_conjugation(t["entry"], t["conjugations"]).agg(F.count("*").alias("n"), F.count_if("root_p").alias("roots"))


@query("seq int, pos string", [(7, "adj-i"), (15, "ctr,n")])
def non_archaic_pos(spark):
    return lookup.current_pos(fixtures.tables(spark)["sense_props"]).filter("seq in (7, 13, 15, 25)").withColumn("pos", joined("pos"))


@query("seq int", [(13,), (25,), (111,)])
def archaic_closure(spark):
    t = fixtures.tables(spark)
    return lookup.archaic(t["glosses"], t["sense_props"], t["conjugations"])


@query("seq int, archaic boolean, unconjugated boolean", [(5, False, True), (13, True, True), (101, False, False), (111, True, False)])
def membership_probes(spark):
    t = fixtures.tables(spark)
    rows = fixtures.local(spark, [(s,) for s in (5, 13, 101, 111)], "seq int")
    old = lookup.archaic(t["glosses"], t["sense_props"], t["conjugations"]).withColumn("archaic", F.lit(True))
    free = lookup.without_conjugation(t["entry"], t["conjugations"]).select("seq", F.lit(True).alias("unconjugated"))
    return rows.join(old, "seq", "left").join(free, "seq", "left").fillna(False, ["archaic", "unconjugated"])


@query("seq int, tag string, text string", [(15, "stagr", "かん")])
def counter_restrictions(spark):
    return lookup.counter_restrictions(fixtures.tables(spark)["sense_props"])


@query("seq int, text string, reading string, common int", [(6, "行く", "いく", 1)])
def words_with_kanji(spark):
    t = fixtures.tables(spark)
    return lookup.words_with_kanji("行", t["entry"], t["readings"], lookup.best_readings(t["readings"], t["restricted"]).filter("script = 'kanji'"))


@query("id int, seq int, kind string", [(1, 11, "full"), (2, 12, "partial")])
def gloss_match(spark):
    t = fixtures.tables(spark)
    new = [(1, "橋", "はし", ["Bridge"]), (2, "端", "はし", ["edge", "brink"]), (3, "箸", "はし", ["spoon"]), (4, "犬", "いぬ", ["dog"])]
    return lookup.gloss_matches(fixtures.local(spark, new, "id int, text string, reading string, glosses array<string>"), t["readings"], t["glosses"])


@query("sent_id int, start int, end int, part string, keyword string", [(1, 2, 4, "たい", "tai"), (2, 2, 4, "たい", "tai")])
def suffix_substring_join(spark):
    rows = fixtures.local(spark, [(1, "食べたい"), (2, "行きたいな")], "sent_id int, text string")
    return lookup.suffix_hits(lattice.substrings(rows, 4), fixtures.local(spark, [("たい", "tai", 201), ("すぎる", "sugiru", 202)], "text string, keyword string, seq int"))


@query("seq int, gloss string", [(7, "high; tall"), (15, "counter for volumes")])
def first_sense_gloss(spark):
    return lookup.short_glosses(fixtures.tables(spark)["glosses"]).filter("seq in (7, 15)")


@query("seq int, gloss string", [(15, "roll"), (26, "book")])
def first_sense_gloss_of_pos(spark):
    t = fixtures.tables(spark)
    return lookup.short_glosses(t["glosses"], t["sense_props"], "n").filter("seq in (7, 15, 26)")


@query("kanji string, words long", [(c, 2 if c == "日" else 1) for c in "今日学生私食行高静箸橋個巻為勉強明本良天気何人"])
def kanji_usage(spark):
    return lookup.kanji_usage(fixtures.tables(spark)["readings"])


@query("kanji string, text string, words long", [("日", "にち", 2), ("日", "ひ", 2), ("犬", "いぬ", 0)])
def reading_usage(spark):
    known = fixtures.local(spark, [("日", "ja_on", "にち"), ("日", "ja_kun", "ひ"), ("犬", "ja_kun", "いぬ")], "kanji string, type string, text string")
    return lookup.reading_usage(known, lookup.kanji_usage(fixtures.tables(spark)["readings"]))


@query("seq int, common int", [(10, 12), (12, None), (6, 1)])
def greatest_common(spark):
    return lookup.greatest_common(fixtures.tables(spark)["readings"]).filter("seq in (6, 10, 12)")


@query("seq int, text string, best string", [(6, "行く", "いく"), (6, "往く", "いく"), (6, "いく", "行く"), (6, "ゆく", "往く"), (24, "明日", "あした"), (24, "あした", "明日"), (24, "あす", "明日"), (24, "みょうにち", "明日")])
def best_readings(spark):
    t = fixtures.tables(spark)
    return lookup.best_readings(t["readings"], t["restricted"]).filter("seq in (6, 24)")


@query("seq int, kanji string, kana string", [(6, "往く,行く", "いく,ゆく"), (16, "", "パン")])
def reading_signature(spark):
    found = lookup.reading_signatures(fixtures.tables(spark)["readings"]).filter("seq in (6, 16)")
    return found.select("seq", joined("kanji").alias("kanji"), joined("kana").alias("kana"))


@query("id int, seq int", [(1, 11), (2, 10), (2, 11), (2, 12)])
def readings_containment(spark):
    wanted = [(1, "kanji", "橋"), (1, "kana", "はし"), (2, "kana", "はし"), (3, "kanji", "箸"), (3, "kana", "はた")]
    return lookup.entries_with_readings(fixtures.local(spark, wanted, "id int, script string, text string"), fixtures.tables(spark)["readings"])


@query("name string, n long", [("entry", 43), ("conjugations", 13), ("conj_props", 14)])
def dictionary_stats(spark):
    t = fixtures.tables(spark)
    return lookup.stats({n: t[n] for n in ("entry", "conjugations", "conj_props")})


@query("seq int, text string", [(6, "行く"), (14, "個")])
def first_spelling(spark):
    return lookup.first_by_order(fixtures.tables(spark)["readings"].filter("script = 'kanji' and seq in (6, 14)"), ["seq"], ["ord"])


@query("seq int, text string, best string", [(101, "食べた", "たべた"), (105, "食べられた", "たべられた"), (109, "行った", "いった"), (110, "高くない", "たかくない")])
def best_kana_of_forms(spark):
    return readings.best_kana(fixtures.tables(spark)).filter("seq in (101, 105, 109, 110) and text <> '往った'")


@query("seq int, text string, best string", [(101, "たべた", "食べた"), (105, "たべられた", "食べられた"), (6, "ゆく", "往く")])
def best_kanji_of_forms(spark):
    return readings.best_kanji(fixtures.tables(spark)).filter("seq in (101, 105) or text = 'ゆく'")


# --- corrections


def patch(spark, names: str, *rows: tuple) -> DataFrame:
    return fixtures.local(spark, list(rows), names)


@query("text string, ord int, n int", [("行く", 0, 3), ("往く", 1, 3), ("逝く", 2, 3)])
def errata_add_reading(spark):
    t = patches.add_readings(fixtures.tables(spark), patch(spark, "seq int, script string, text string, common int", (6, "kanji", "逝く", None), (6, "kanji", "行く", 9)))
    return t["readings"].filter("seq = 6 and script = 'kanji'").join(t["entry"], "seq").withColumn("n", F.col("n_kanji"))


@query("text string, ord int", [("個", 0), ("个", 1)])
def errata_replace_reading(spark):
    t = patches.replace_readings(fixtures.tables(spark), patch(spark, "seq int, text string, new string", (14, "箇", "个"), (14, "無", "x")))
    return t["readings"].filter("seq = 14 and script = 'kanji'")


@query("text string, ord int, n int", [("あした", 0, 2), ("みょうにち", 1, 2)])
def errata_delete_reading(spark):
    t = patches.delete_readings(fixtures.tables(spark), patch(spark, "seq int, text string", (24, "あす")))
    return t["readings"].filter("seq = 24 and script = 'kana'").join(t["entry"], "seq").withColumn("n", F.col("n_kana"))


@query("tag string, text string, ord int", [("pos", "n", 0), ("pos", "vi", 0), ("field", "edu", 0), ("s_inf", "also diligence", 0)])
def errata_sense_props(spark):
    t = patches.delete_sense_props(fixtures.tables(spark), patch(spark, "seq int, tag string, text string", (18, "pos", "vs")))
    t = patches.add_sense_props(t, patch(spark, "seq int, sense_ord int, tag string, text string", (18, 0, "pos", "vi"), (18, 0, "pos", "n"), (18, 7, "pos", "x")))
    return t["sense_props"].filter("seq = 18")


@query("id int", [(1,), (3,)])
def errata_sense_exists(spark):
    wanted = patch(spark, "id int, seq int, pos array<string>, texts array<string>", (1, 7, ["adj-i"], ["tall", "high"]), (2, 7, ["n"], ["high", "tall"]), (3, 5, ["vt", "v1"], ["to eat"]), (4, 5, ["v1", "vt"], ["to"]))
    return patches.existing_senses(fixtures.tables(spark), wanted)


@query("sense_ord int, ord int, text string", [(0, 0, "chopsticks"), (1, 0, "pair of sticks"), (1, 1, "sticks")])
def errata_add_sense(spark):
    t = patches.add_senses(fixtures.tables(spark), patch(spark, "seq int, sense_ord int, texts array<string>", (10, 1, ["pair of sticks", "sticks"]), (10, 0, ["taken"])))
    return t["glosses"].filter("seq = 10")


@query("seq int, sense_ord int, text string, pos string", [(10, 1, "wand", ""), (11, 1, "bridging", "vs")])
def errata_add_new_sense(spark):
    t = patches.add_new_senses(fixtures.tables(spark), patch(spark, "seq int, pos array<string>, texts array<string>", (10, ["n"], ["wand"]), (11, ["vs"], ["bridging"]), (2, ["n"], ["student"])))
    tags = t["sense_props"].filter("tag = 'pos'").groupBy("seq", "sense_ord").agg(F.max("text").alias("pos"))
    return t["glosses"].filter("seq in (2, 10, 11) and sense_ord = 1").join(tags, ["seq", "sense_ord"], "left").fillna("", ["pos"])


@query("ord int, text string", [(0, "chopsticks"), (1, "sticks"), (2, "pair")])
def errata_add_gloss(spark):
    t = patches.add_glosses(fixtures.tables(spark), patch(spark, "seq int, sense_ord int, place int, text string", (10, 0, 0, "sticks"), (10, 0, 1, "pair"), (10, 5, 0, "nowhere")))
    return t["glosses"].filter("seq = 10")


@query("seq int, text string, common int", [(10, "箸", None), (10, "はし", 12), (12, "端", 20), (12, "はし", None), (12, "はた", None)])
def errata_set_common(spark):
    t = patches.set_common(fixtures.tables(spark), patch(spark, "seq int, text string, new int", (10, "箸", None), (12, "端", 20)))
    return t["readings"].filter("seq in (10, 12)")


@query("seq int, primary_nokanji boolean, nokanji boolean", [(10, True, True), (11, True, False)])
def errata_primary_nokanji(spark):
    t = patches.set_primary_nokanji(fixtures.tables(spark), patch(spark, "seq int, text string, new boolean", (10, "はし", True), (11, None, True)))
    return t["entry"].filter("seq in (10, 11)").join(t["readings"].filter("script = 'kana'").select("seq", "nokanji"), "seq")


@query("seq int, glosses long, props long", [(15, 1, 2)])
def errata_delete_senses(spark):
    t = patches.delete_senses(fixtures.tables(spark), patch(spark, "seq int, tag string, text string", (15, "stagr", "まき")))
    n = lambda name: t[name].filter("seq = 15").groupBy("seq").agg(F.count("*").alias({"glosses": "glosses", "sense_props": "props"}[name]))
    return n("glosses").join(n("sense_props"), "seq")


@query("text string, ord int", [("往く", 0), ("行く", 1)])
def errata_rearrange_readings(spark):
    t = patches.rearrange_readings(fixtures.tables(spark), patch(spark, "seq int, script string, prefix string", (6, "kanji", "往")))
    return t["readings"].filter("seq = 6 and script = 'kanji'")


@query("edges long, entries long, readings long, sources long", [(12, 42, 0, 0)])
def errata_delete_conjugation(spark):
    t = patches.delete_conjugations(fixtures.tables(spark), patch(spark, "seq int, from int, via int", (101, 5, None), (105, 5, None)))
    n = lambda rows, name: rows.agg(F.count("*").alias(name))
    one = n(t["conjugations"], "edges").withColumn("k", F.lit(1))
    for rows, name in ((t["entry"], "entries"), (t["readings"].filter("seq = 101"), "readings"), (t["conj_sources"].filter("conj_id = 1"), "sources")):
        one = one.join(n(rows, name).withColumn("k", F.lit(1)), "k")
    return one


@query("seq int, text string, ord int", [(101, "喰べた", 0), (102, "喰べて", 0), (105, "喰べられた", 0)])
def errata_add_conj_reading(spark):
    t = patches.add_conjugated_readings(fixtures.tables(spark), patch(spark, "seq int, text string, new string", (5, "食べる", "喰べる")))
    return t["readings"].filter("seq in (101, 102, 105) and text like '喰%'")


@query("id int, conj_id long", [(1, 1), (3, 6)])
def errata_find_conj(spark):
    wanted = patch(spark, "id int, from int, conj_type int, pos string, neg boolean, fml boolean", (1, 5, 2, "v1", False, False), (2, 5, 2, "v1", None, False), (3, 7, 50, "adj-i", None, None))
    return patches.existing_conjugations(fixtures.tables(spark), wanted)


@query("seq int, text string, conj_id long, source_text string", [(500, "静かに", 14, "静か"), (500, "しずかに", 14, "しずか")])
def errata_add_conj(spark):
    names = "id int, from int, conj_type int, pos string, neg boolean, fml boolean, script string, text string, source_text string"
    wanted = patch(spark, names, (1, 8, 50, "adj-na", None, None, "kanji", "静かに", "静か"), (1, 8, 50, "adj-na", None, None, "kana", "しずかに", "しずか"), (2, 5, 2, "v1", False, False, "kanji", "食べた", "食べる"))
    t = patches.add_conjugations(fixtures.tables(spark), wanted, 500)
    return t["readings"].filter("seq >= 500").join(t["conj_sources"], "text")


@query("seq int, text string", [(6, "逝く"), (6, "往く"), (109, "逝った"), (109, "往った")])
def errata_replace_prefix(spark):
    t = patches.replace_reading_prefixes(fixtures.tables(spark), patch(spark, "seq int, script string, prefix string, new string", (6, "kanji", "行", "逝")))
    return t["readings"].filter("seq in (6, 109) and script = 'kanji'")


@query("seq int, text string", [(19, "ではある"), (19, "じゃある")])
def errata_contracted_copula(spark):
    t = patches.add_readings(fixtures.tables(spark), patch(spark, "seq int, script string, text string, common int", (19, "kana", "ではある", None)))
    return patches.contracted_copulas(t)["readings"].filter("seq = 19 and text <> 'で'")


@query("seq int, flag boolean", [(1, False), (16, True)])
def errata_plain_hiragana(spark):
    t = patches.set_primary_nokanji(fixtures.tables(spark), patch(spark, "seq int, text string, new boolean", (1, "きょう", True), (16, "パン", True)))
    return patches.plain_hiragana(t)["readings"].filter("text in ('きょう', 'パン')").withColumn("flag", F.col("nokanji"))


@query("text string, pos string", [("cop-da", "pos")])
def errata_copula_class(spark):
    t = patches.copula_class(fixtures.tables(spark), 9)
    return t["sense_props"].filter("seq = 9 and text = 'cop-da'").withColumn("pos", F.col("tag"))


@query("text string, common int", [("箸", 5), ("橋", 30)])
def errata_batches(spark):
    of = lambda *rows: patch(spark, "seq int, text string, new int", *rows)
    t = patches.applied(fixtures.tables(spark), [("2020-02", "set_common", of((10, "箸", 5))), ("2019-01", "set_common", of((10, "箸", 9), (11, "橋", 30)))])
    return t["readings"].filter("text in ('箸', '橋')")


# --- conjugation and building


@query("text string, conj int, neg boolean", [("食べない", 1, True), ("食べた", 2, None), ("食べて", 3, None), ("食べられる", 5, None), ("食べろ", 10, None), ("食べ", 13, None), ("高くない", 1, True), ("高かった", 2, None), ("高く", 50, None), ("高", 51, None), ("高き", 54, None), ("行った", 2, None), ("した", 2, None)])
def conjugation_generation(spark):
    words = fixtures.local(spark, [(5, "食べる", "v1"), (7, "高い", "adj-i"), (6, "行く", "v5k-s"), (17, "する", "vs-i")], "seq int, text string, pos string")
    return conjugation.conjugated(words, fixtures.rules(spark))


@query("text string, via int, conj int", [("食べられた", 5, 2), ("食べられて", 5, 3), ("食べられろ", 5, 10), ("食べられ", 5, 13)])
def secondary_conjugation(spark):
    forms = conjugation.conjugated(fixtures.local(spark, [(5, "食べる", "v1")], "seq int, text string, pos string"), fixtures.rules(spark))
    return conjugation.conjugated_again(forms, fixtures.rules(spark))


@query("text string, description string", [("食べない", "[v1] Non-past Negative"), ("食べて", "[v1] Conjunctive (~te)")])
def conjugation_description(spark):
    forms = conjugation.conjugated(fixtures.local(spark, [(5, "食べる", "v1")], "seq int, text string, pos string"), fixtures.rules(spark))
    return conjugation.described(forms).filter("conj in (1, 3)")


def roots(spark) -> dict[str, DataFrame]:
    """The fixture's root entries 5 and 13 alone."""
    own = fixtures.tables(spark)
    keep = ("entry", "readings", "glosses", "sense_props", "restricted")
    return store.create(spark) | {n: own[n].filter("seq in (5, 13)") for n in keep}


@query("seq int, texts string, origin int, conj_type int", [(10000000, "食べ たべ", 5, 13), (10000001, "食べた たべた", 5, 2), (10000002, "食べて たべて", 5, 3), (10000003, "食べない たべない", 5, 1), (10000004, "食べられる たべられる", 5, 5), (10000005, "食べろ たべろ", 5, 10)])
def conjugation_upsert(spark):
    """Numbers follow the sorted readings, kana first."""
    t = store.conjugate(roots(spark), fixtures.rules(spark))
    spelled = t["readings"].groupBy("seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("script") == "kana").alias("k"), "text"))), lambda x: x["text"]), " ").alias("texts"))
    return t["conjugations"].join(t["conj_props"].withColumnRenamed("conj_id", "id"), "id").join(spelled, "seq").withColumn("origin", F.col("from"))


@query("seq int", [(10000000,)])
def next_seq(spark):
    return store.next_seq(fixtures.tables(spark))


# --- sources

ENTRY = """<entry><ent_seq>10</ent_seq><k_ele><keb>漢字</keb><ke_pri>ichi1</ke_pri><ke_pri>nf03</ke_pri></k_ele><r_ele><reb>おくり</reb><re_inf>ok</re_inf></r_ele><r_ele><reb>かんじ</reb><re_restr>漢字</re_restr></r_ele><r_ele><reb>カンジ</reb><re_nokanji/></r_ele><sense><pos>n</pos><pos>adj-na</pos><gloss>one &amp; two</gloss><gloss>three</gloss></sense><sense><misc>uk</misc><gloss>four</gloss></sense></entry>"""
LOOSE = "<entry><ent_seq>せず</ent_seq><r_ele><reb>せず</reb></r_ele><sense><pos>exp</pos><gloss>without doing</gloss></sense></entry>"
CHARACTER = """<character><literal>亜</literal><radical><rad_value rad_type="classical">7</rad_value></radical><misc><grade>8</grade><stroke_count>7</stroke_count><stroke_count>9</stroke_count><freq>1509</freq></misc><reading_meaning><rmgroup><reading r_type="pinyin">ya4</reading><reading r_type="ja_on">ア</reading><reading r_type="ja_kun">つ.ぐ</reading><reading r_type="ja_kun">-め</reading><meaning>Asia</meaning><meaning m_lang="fr">Asie</meaning></rmgroup></reading_meaning></character>"""


def parsed_entries(spark, *xml: str) -> DataFrame:
    return dictionary.entries_of(fixtures.local(spark, [(x,) for x in xml or (ENTRY,)], "xml string"))


@query("script string, ord int, text string, common int, nokanji boolean", [("kanji", 0, "漢字", 3, False), ("kana", 0, "かんじ", None, False), ("kana", 1, "カンジ", None, True)])
def entry_readings(spark):
    found = parsed_entries(spark)
    return dictionary.readings(found, "kanji").withColumn("script", F.lit("kanji")).unionByName(dictionary.readings(found, "kana").withColumn("script", F.lit("kana")))


@query("sense_ord int, ord int, text string", [(0, 0, "one & two"), (0, 1, "three"), (1, 0, "four")])
def entry_glosses(spark):
    return dictionary.glosses(parsed_entries(spark))


@query("sense_ord int, tag string, ord int, text string", [(0, "pos", 0, "n"), (0, "pos", 1, "adj-na"), (1, "misc", 0, "uk")])
def entry_sense_props(spark):
    return dictionary.sense_props(parsed_entries(spark))


@query("seq int, reading string, text string", [(10, "かんじ", "漢字")])
def entry_restrictions(spark):
    return dictionary.restrictions(parsed_entries(spark))


@query("seq int, n_kanji int, n_kana int, primary_nokanji boolean", [(10, 1, 2, True)])
def entry_counts(spark):
    return dictionary.entry_counts(parsed_entries(spark))


@query("seq int, text string", [(10, "漢字"), (10, "かんじ"), (10, "カンジ"), (10000000, "せず")])
def entry_load(spark):
    return store.from_entries(parsed_entries(spark, ENTRY, LOOSE))["readings"]


@query("way string, seq int, text string", [("kept", 10, "one & two"), ("kept", 11, "bridge"), ("replaced", 10, "new"), ("replaced", 11, "bridge")])
def entry_merge(spark):
    """Of a seq in both, the entry that is there stays, or with overwrite the new one."""
    old = {n: rows.filter("seq = 11") if "seq" in rows.columns else rows for n, rows in fixtures.tables(spark).items()}
    old = store.merged(old, store.from_entries(parsed_entries(spark)))
    new = store.from_entries(parsed_entries(spark, ENTRY.replace("one &amp; two", "new")))
    of = lambda way, t: t["glosses"].filter("sense_ord = 0 and ord = 0").select(F.lit(way).alias("way"), "seq", "text")
    return of("kept", store.merged(old, new)).unionByName(of("replaced", store.merged(old, new, overwrite=True)))


@query("kanji string, radical_c int, radical_n int, grade int, strokes int, freq int", [("亜", 7, 1, 8, 7, 1509)])
def kanji_rows(spark):
    return dictionary.kanji_of(fixtures.local(spark, [(CHARACTER,)], "xml string"))


@query("type string, text string, okuri string, prefix boolean, suffix boolean", [("ja_on", "あ", None, False, False), ("ja_kun", "つ", "ぐ", False, False), ("ja_kun", "め", None, True, False)])
def kanji_reading_rows(spark):
    return dictionary.kanji_readings(dictionary.kanji_of(fixtures.local(spark, [(CHARACTER,)], "xml string")))


@query("kanji string, text string", [("亜", "Asia")])
def kanji_meaning_rows(spark):
    return dictionary.kanji_meanings(dictionary.kanji_of(fixtures.local(spark, [(CHARACTER,)], "xml string")))


TOWNS = [("1", "北海道", None, "ﾎｯｶｲﾄﾞｳ", None), ("2", "北海道", "札幌市", "ﾎｯｶｲﾄﾞｳ", "ｻｯﾎﾟﾛｼ")]


def towns(spark) -> DataFrame:
    return dictionary.municipalities_of(fixtures.local(spark, TOWNS, "id string, pref string, name string, pref_kana string, name_kana string"))


@query("id string, text string, reading string, kind string, full_name string", [("1", "北海道", "ほっかいどう", "prefecture", "Hokkaido Prefecture"), ("2", "札幌市", "さっぽろし", "city", "Sapporoshi City, Hokkaido Prefecture"), ("2", "札幌", "さっぽろ", "city", "Sapporoshi City, Hokkaido Prefecture")])
def municipality_rows(spark):
    return towns(spark)


@query("id string, text string, reading string, city string", [("2", "中央区", "ちゅうおうく", "札幌"), ("3", "外区", "そとく", "札幌")])
def ward_rows(spark):
    lines = [("1", "札幌市", "さっぽろし", "f", 1), ("2", "札幌市中央区", "さっぽろしちゅうおうく", "f", 2), ("3", "外区", "そとく", "f", 3)]
    return dictionary.wards_of(fixtures.local(spark, lines, "id string, text string, reading string, f string, n int"))


@query("text string, gloss string", [("北海道", "Hokkaido Prefecture"), ("札幌", "Sapporoshi City, Hokkaido Prefecture"), ("札幌市", "Sapporoshi City, Hokkaido Prefecture")])
def place_entries(spark):
    t = store.from_entries(store.places(towns(spark), "place"))
    return t["readings"].filter("script = 'kanji'").join(t["glosses"].select("seq", F.col("text").alias("gloss")), "seq")


@query("xml string", [("<entry><ent_seq>0</ent_seq><k_ele><keb>A&amp;B</keb></k_ele><r_ele><reb>えー</reb></r_ele><sense><pos>n</pos><gloss>A &lt;B&gt;</gloss></sense></entry>",)])
def place_xml(spark):
    return store.entry_xml(fixtures.local(spark, [("A&B", "えー", "A <B>")], "text string, reading string, full_name string"))


# --- characters and spellings


@query("name string, value string", [
    ("hiragana", "らーめん"), ("katakana", "ガッコウ"), ("normalise", "ガギ1A. "), ("mora length", "3"), ("rendaku", "がみ"), ("half rendaku", "ぽう"), ("unrendaku", "ほう"),
    ("geminate", "けっ"), ("kanji prefix", "取り次"), ("kanji mask", "%り%ぐ"), ("kanji match", "true"), ("kanji mismatch", "false"), ("cross match", "たべた"), ("sequential kanji", "1,6"),
    ("sticky", "2"), ("destem", "食べ"), ("runs", "1-3,4-5"), ("split", "misc:abc|word:今日は12個|misc:。"), ("sentences", "行く。」|来る！ |x"), ("is kanji", "true"), ("is kana", "false"),
    ("count kanji", "2"), ("collect kanji", "今,日"), ("joined marks", "ガパ"), ("full width", "カガパー"), ("words", "今日は,abc,12"),
    ("ngrams", "abd"), ("patched", "食べたい"), ("cut end", "食"), ("between", "べ"), ("beyond", None), ("compatible", "ガ1A"), ("macrons", "kyou o"), ("width", "かな"),
    ("difference", "食~喰 べる"), ("difference at the end", "食べ た~て"), ("difference inside", "お取~取 り"), ("word type", "kanji"), ("word text", "三個"), ("true text", "食べる"), ("word seqs", "5,201"), ("prefixed", "お茶"), ("not prefixed", "お茶"),
])
def text_functions(spark):
    lit, one = F.lit, spark.range(1)
    text = lambda c: c.cast("string")
    parts = lambda d: F.array_join(F.transform(d, lambda p: F.coalesce(p["same"], F.concat(p["left"], F.lit("~"), p["right"]))), " ")
    cases = {
        "hiragana": chars.as_hiragana(lit("ラーメン")), "katakana": chars.as_katakana(lit("がっこう")), "normalise": chars.normalise(lit("ｶﾞｷﾞ１Ａ。")), "mora length": text(chars.mora_length(lit("がっこうー"))),
        "rendaku": chars.rendaku(lit("かみ")), "half rendaku": chars.rendaku(lit("ほう"), half=True), "unrendaku": chars.unrendaku(lit("ぽう")), "geminate": chars.geminate(lit("けつ")),
        "kanji prefix": chars.kanji_prefix(lit("取り次ぐ")), "kanji mask": chars.kanji_mask(lit("取り次ぐ")), "kanji match": text(chars.kanji_match(lit("食べる"), lit("たべる"))), "kanji mismatch": text(chars.kanji_match(lit("食べる"), lit("たべた"))),
        "cross match": chars.kanji_cross_match(lit("食べる"), lit("たべる"), lit("食べた")), "sequential kanji": F.array_join(F.transform(chars.sequential_kanji(lit("今日は良い天気")), text), ","),
        "sticky": F.array_join(F.transform(chars.sticky_positions(lit("がっこう")), text), ","), "destem": chars.destem(lit("食べる"), 1),
        "runs": F.array_join(F.transform(chars.class_runs(lit("aカタbナ"), "katakana"), lambda r: F.concat(text(r["start"]), lit("-"), text(r["end"]))), ","),
        "split": F.array_join(F.transform(chars.basic_split(lit("abc今日は12個。")), lambda p: F.concat(p["type"], lit(":"), p["text"])), "|"), "sentences": F.array_join(chars.sentences(lit("行く。」来る！ x")), "|"),
        "is kanji": text(chars.is_class(lit("今日"), "kanji")), "is kana": text(chars.is_class(lit("今日は"), "kana")), "count kanji": text(chars.count_class(lit("今日は"), "kanji")), "collect kanji": F.array_join(chars.collect_class(lit("今は日"), "kanji"), ","),
        "joined marks": chars.joined_marks(lit("カ゛ハ゜")), "full width": chars.full_width_kana(lit("ｶｶﾞﾊﾟｰ")), "words": F.array_join(chars.words(lit("今日は、abc 12")), ","),
        "ngrams": spelling.simplified_ngrams(lit("xyz"), [("xy", "ab"), ("z", "c"), ("bc", "bd")]), "patched": spelling.patched(lit("食べて"), "たい", "て"), "cut end": spelling.cut_end(lit("食べる"), 2),
        "between": spelling.between(lit("食べる"), 1, 2), "beyond": spelling.between(lit("食べる"), 2, 9), "compatible": spelling.compatible(lit("ｶﾞ１Ａ")), "macrons": F.lower(spelling.without_macrons(lit("Kyōu ō"))), "width": spelling.hiragana(lit("ｶナ")),
        "difference": parts(spelling.spelling_difference(lit("食べる"), lit("喰べる"))), "difference at the end": parts(spelling.spelling_difference(lit("食べた"), lit("食べて"))), "difference inside": parts(spelling.spelling_difference(lit("お取り"), lit("取り"))),
        "word type": spelling.word_type(lit("plain"), lit("食べる")), "word text": spelling.word_text(lit("counter"), lit("個"), lit("三")), "true text": spelling.true_text(lit("proxy"), lit("タベル"), lit("食べる")),
        "word seqs": F.array_join(F.transform(spelling.word_seq(lit("compound"), lit(5), F.array(lit(5), lit(201))), text), ","), "prefixed": scoring.with_prefix(lit("茶"), "お"), "not prefixed": scoring.with_prefix(lit("お茶"), "お"),
    }
    return one.select(F.explode(F.array(*[F.struct(lit(n).alias("name"), c.alias("value")) for n, c in cases.items()])).alias("x")).select("x.*")


@query("word string, method string, romaji string", [
    ("とうきょう", "hepburn", "toukyou"), ("とうきょう", "simple", "tokyo"), ("とうきょう", "passport", "tohkyoh"), ("とうきょう", "traditional", "tōkyō"), ("とうきょう", "modified", "tōkyō"), ("とうきょう", "kunrei", "tôkyô"),
    ("しんぶん", "hepburn", "shinbun"), ("しんぶん", "simple", "shinbun"), ("しんぶん", "passport", "shinbun"), ("しんぶん", "traditional", "shimbun"), ("しんぶん", "modified", "shinbun"), ("しんぶん", "kunrei", "sinbun"),
    ("ちゃをつぐ", "hepburn", "chawotsugu"), ("ちゃをつぐ", "simple", "chawotsugu"), ("ちゃをつぐ", "passport", "chawotsugu"), ("ちゃをつぐ", "traditional", "chawotsugu"), ("ちゃをつぐ", "modified", "chaotsugu"), ("ちゃをつぐ", "kunrei", "tyaotugu"),
    ("いすゞ", "hepburn", "isuzu"), ("いすゞ", "simple", "isuzu"), ("いすゞ", "passport", "isuzu"), ("いすゞ", "traditional", "isuzu"), ("いすゞ", "modified", "isuzu"), ("いすゞ", "kunrei", "isuzu"),
])
def romanisation_methods(spark):
    words = texts(spark, "とうきょう", "しんぶん", "ちゃをつぐ", "いすゞ").withColumnRenamed("text", "word")
    both = [words.select("word", F.lit(m).alias("method"), kana.romaniser(m)("word").alias("romaji")) for m in kana.METHODS]
    out = both[0]
    for b in both[1:]:
        out = out.unionByName(b)
    return out


@query("n long, kana string", [(0, "れい"), (300, "さんびゃく"), (600, "ろっぴゃく"), (8000, "はっせん"), (10000, "いちまん"), (1234, "せん にひゃく さんじゅう よん")])
def number_kana(spark):
    return fixtures.local(spark, [(n,) for n in (0, 300, 600, 8000, 10000, 1234)], "n long").withColumn("kana", kana.number_kana("n"))


@query("n long, text string", [(1, "1st"), (2, "2nd"), (3, "3rd"), (4, "4th"), (11, "11th"), (21, "21st"), (112, "112th")])
def ordinals(spark):
    return fixtures.local(spark, [(n,) for n in (1, 2, 3, 4, 11, 21, 112)], "n long").withColumn("text", counters.ordinal(F.col("n")))


# --- counters

COUNTERS = [
    (1522150, "本", "ほん"), (2220330, "つ", "つ"), (2083110, "日", "か"), (2083100, "日", "にち"), (1255430, "月", "がつ"), (2149890, "人", "にん"), (1294940, "歳", "さい"), (1203020, "階", "かい"), (1502840, "分", "ふん"),
    (2019640, "杯", "はい"), (1583370, "匹", "ひき"), (1607310, "羽", "わ"), (2084840, "年", "ねん"), (2020680, "時", "じ"), (9001, "冊", "さつ"), (9002, "個", "こ"), (9003, "回", "かい"), (9004, "点", "てん"), (9005, "頭", "とう"), (9006, "枚", "まい"),
    (9007, "", "ページ"),
]
#: number, counter, kana, value; a pair without a row has none
COUNTED = [
    ("1", "本", "いっぽん", "Value: 1"), ("三", "本", "さんぼん", "Value: 3"), ("六", "本", "ろっぽん", "Value: 6"), ("八", "本", "はっぽん", "Value: 8"), ("十", "本", "じゅっぽん", "Value: 10"), ("百", "本", "ひゃっぽん", "Value: 100"), ("十一", "本", "じゅう いっぽん", "Value: 11"),
    ("一", "つ", "ひとつ", "Value: 1"), ("九", "つ", "ここのつ", "Value: 9"), ("1", "日", "ついたち", "Value: 1"), ("1", "日", "いちにち", "Value: 1"), ("二", "日", "ふつか", "Value: 2"), ("十一", "日", "じゅう いちにち", "Value: 11"), ("二十", "日", "はつか", "Value: 20"),
    ("四", "月", "しがつ", "April"), ("七", "月", "しちがつ", "July"), ("九", "月", "くがつ", "September"), ("十一", "月", "じゅう いちがつ", "November"), ("一", "人", "ひとり", "Value: 1"), ("二", "人", "ふたり", "Value: 2"), ("三", "人", "さんにん", "Value: 3"), ("四", "人", "よにん", "Value: 4"),
    ("二十", "歳", "はたち", "Value: 20"), ("八", "歳", "はっさい", "Value: 8"), ("三", "階", "さんがい", "Value: 3"), ("四", "分", "よんぷん", "Value: 4"), ("三", "分", "さんぷん", "Value: 3"), ("1", "杯", "いっぱい", "Value: 1"), ("三", "匹", "さんびき", "Value: 3"),
    ("三", "羽", "さんば", "Value: 3"), ("六", "羽", "ろっぱ", "Value: 6"), ("七", "年", "しちねん", "Value: 7"), ("九", "時", "くじ", "Value: 9"), ("十", "冊", "じゅっさつ", "Value: 10"), ("八", "個", "はっこ", "Value: 8"), ("六", "回", "ろっかい", "Value: 6"), ("1", "点", "いってん", "Value: 1"), ("一", "頭", "いっとう", "Value: 1"), ("三", "枚", "さんまい", "Value: 3"),
    ("八", "ページ", "はっページ", "Value: 8"), ("一", "ページ", "いちページ", "Value: 1"), ("三", "本目", "さんぼんめ", "Value: 3rd"), ("1", "年間", "いちねんかん", "Value: 1 [duration]"), ("三", "人中", "さんにんちゅう", "Value: 3 [among/out of ...]"), ("百", "", "ひゃく", "Value: 100"),
]


def counter_table(spark) -> DataFrame:
    spelled = [(s, script, 0, t, 0, False) for s, k, r in COUNTERS for script, t in (("kanji", k), ("kana", r)) if t]
    tags = [(s, 0, "pos", 0, "ctr") for s, _, _ in COUNTERS]
    return counters.counter_table(fixtures.local(spark, spelled, store.SCHEMAS["readings"]), fixtures.local(spark, tags, store.SCHEMAS["sense_props"]))


@query("number string, counter string, kana string, value string", COUNTED)
def counter_join(spark):
    pairs = {(n, c) for n, c, _, _ in COUNTED} | {("十一", "つ"), ("十三", "月"), ("犬", "本")}
    return counters.counted(fixtures.local(spark, sorted(pairs), "number string, counter string"), counter_table(spark))


@query("start int, end int, number string, counter string, kana string", [(0, 2, "三", "本", "さんぼん"), (0, 1, "三", "", "さん"), (3, 6, "十二", "個", "じゅう にこ"), (3, 5, "十二", "", "じゅう に")])
def counter_spans(spark):
    return counters.counter_hits(fixtures.local(spark, [(1, "三本と十二個")], "sent_id int, text string"), counter_table(spark))


@query("whole long, pairs long", [(59, 60)])
def counter_grid(spark):
    """Each number with each counter is one span that covers the whole text, but for eleven つ."""
    words = [c or "ページ" for _, c, _ in COUNTERS]
    pairs = fixtures.local(spark, [(f"{n}{c}",) for c in sorted(set(words)) for n in ("1", "三", "十一")], "text string").withColumn("sent_id", F.col("text"))
    hits = counters.counter_hits(pairs, counter_table(spark)).filter("start = 0 and end = length(sent_id)").select("sent_id").distinct()
    return hits.agg(F.count("*").alias("whole")).withColumn("pairs", F.lit(len(set(words)) * 3))


# --- scores and segmentation


@query("text string, seq int, prop long, score long", [("学生", 2, 24, 312), ("は", 4, 11, 11), ("です", 9, 10, 40), ("食べる", 5, 28, 672), ("食べた", 101, 14, 336), ("けり", 13, 1, 4), ("食べるな", 112, 0, 0)])
def word_score(spark):
    rows = analysis.features(fixtures.tables(spark)).filter("text in ('学生', 'は', 'です', '食べる', '食べた', 'けり', '食べるな')")
    scored = scoring.with_score(rows)
    return scored.withColumn("prop", F.when(F.col("score") == 0, 0).otherwise(F.col("prop")))


@query("n int, kind string, value long", [(1, "strong", 1), (3, "strong", 24), (5, "strong", 60), (7, "strong", 84), (2, "weak", 4), (6, "weak", 36), (8, "weak", 48), (4, "tail", 24), (2, "ltail", 12), (0, "tail", 0)])
def length_multiplier(spark):
    rows = fixtures.local(spark, [(1, "strong"), (3, "strong"), (5, "strong"), (7, "strong"), (2, "weak"), (6, "weak"), (8, "weak"), (4, "tail"), (2, "ltail"), (0, "tail")], "n int, kind string")
    value = F.coalesce(*[F.when(F.col("kind") == k, scoring.coefficient(F.col("n"), k)) for k in scoring.COEFFICIENTS])
    return rows.withColumn("value", value)


@query("id int, score long", [(1, 21), (2, 25), (3, 31), (4, 40), (5, 4), (6, 40), (7, 5)])
def kanji_break_penalty(spark):
    rows = [(1, 41, ["n"], "学", "beg"), (2, 40, ["num"], "二", "beg"), (3, 41, ["suf"], "中", "beg"), (4, 40, ["v1"], "する", "beg"), (5, 4, ["n"], "木", "both"), (6, 40, ["n"], "木", None), (7, 9, ["n"], "木", "end")]
    made = fixtures.local(spark, rows, "id int, s long, pos array<string>, text string, at string")
    return made.withColumn("score", scoring.kanji_break(F.col("s"), F.col("pos"), F.col("text"), F.col("at")))


SPAN = "sent_id int, start int, end int, seq int, text string, kana string, score long, common int"


def spans(spark) -> DataFrame:
    rows = [(1, 0, 2, 10, "はし", "はし", 30, 12), (1, 0, 2, 11, "はし", "はし", 28, 6), (1, 0, 2, 12, "はし", "ハシ", 19, None), (1, 0, 2, 13, "はし", "はじ", 14, 1), (1, 2, 3, 4, "は", "は", 4, 0)]
    return fixtures.local(spark, rows, SPAN)


@query("seq int, rank int", [(10, 1), (11, 2), (12, 3)])
def cull(spark):
    return scoring.culled(spans(spark), ["sent_id", "start", "end"])


@query("start int, text string, kana string, score long, alternatives string, skipped int", [(0, "はし", "はし", 30, "10,11", 2), (2, "は", "は", 4, None, 0)])
def merged_alternatives(spark):
    return presentation.merged_alternatives(spans(spark), ["sent_id", "start", "end"]).withColumns({"alternatives": joined("alternatives"), "kana": joined("kana")})


@query("seq int, score long, prop long", [(1, 110, 10), (2, 150, 15), (3, 47, 10), (4, 100, 10)])
def split_decomposition(spark):
    rows = fixtures.local(spark, [(s, 100, 10) for s in (1, 2, 3, 4)], "seq int, score long, prop long")
    rules = fixtures.local(spark, [(1, "score", 10), (2, "pscore", 5), (3, "parts", 7)], "seq int, kind string, mod int")
    parts = fixtures.local(spark, [(3, "a", 25), (3, "b", 15)], "seq int, part string, score int")
    return scoring.split_scores(rows, rules, parts)


@query("seq int, part string, text string", [(1, "head", "で"), (1, "rest", "しょう"), (2, "a", "何"), (2, "b", "より")])
def split_parts(spark):
    rows = fixtures.local(spark, [(1, "でしょう"), (2, "何より")], "seq int, text string")
    cuts = scoring.prefixed_cuts(fixtures.local(spark, [(1,)], "seq int"), 1).unionByName(fixtures.local(spark, [(2, "a", 0, 1), (2, "b", -2, None)], "seq int, part string, start int, length int"))
    return scoring.split_parts(rows, cuts)


@query("seq int, score long, parts string, rank int", [(5, 50, None, 2), (5, 60, "6,7", 1), (8, 40, None, 3)])
def segment_split(spark):
    hits = fixtures.local(spark, [(1, 5, 50), (1, 8, 40)], "sent_id int, seq int, score long")
    made = scoring.segment_splits(hits, fixtures.local(spark, [(5, 10, [6, 7])], "seq int, delta int, parts array<int>"))
    return scoring.resorted(made, ["sent_id"]).withColumn("parts", joined("parts"))


SEGMENT = "id int, start int, end int, text string, kanji boolean, primary boolean, is_common boolean, long boolean, pos array<string>, seq_set array<int>, conj_types array<int>, parts array<int>, part_texts array<string>"


@query("id int, filters string", [(1, "noun"), (2, "particle,short"), (3, "continuative"), (4, "seq"), (5, "counter,noun"), (6, "")])
def segment_filters(spark):
    rows = [(1, 0, 2, "学生", True, True, True, False, ["n"], [2], [], None, None), (2, 0, 1, "は", False, True, True, False, ["prt"], [4], [], None, None), (3, 0, 2, "食べ", True, False, False, False, ["v1"], [108, 5], [13], None, None),
            (4, 0, 4, "食べては", True, False, False, True, ["v1"], [102], [3], [102, 2028920], ["食べて", "は"]), (5, 0, 2, "三個", True, True, True, False, ["ctr"], [14], [], None, None), (6, 0, 2, "けり", False, False, False, False, ["aux-v"], [13], [], None, None)]
    made = fixtures.local(spark, rows, SEGMENT)
    tests = {"continuative": scoring.is_conjugation(13), "counter": scoring.is_pos("ctr", test=F.lit(True)), "noun": scoring.is_noun(), "particle": scoring.is_pos("prt", test=F.col("primary")) & scoring.in_seqs(4, simple=True), "seq": scoring.ends_with_seq(2028920) & scoring.ends_with_text("は"), "short": scoring.short_kana(1, "と")}
    return analysis.tagged(made, tests).withColumn("filters", F.array_join("tags", ","))


@query("id int, kept string, skipped boolean", [(1, "5,6", False), (2, "5", False), (3, "10", True)])
def conjugation_filters(spark):
    form = lambda kind, neg=False: {"conj_type": kind, "pos": "v1", "neg": neg, "fml": False}
    rows = [(1, "食べられる", [form(5), form(6)]), (2, "食べれる", [form(5), form(6)]), (3, "食べるな", [form(10, True)])]
    made = fixtures.local(spark, rows, "id int, text string, conj array<struct<via: int, conj_type: int, pos: string, neg: boolean, fml: boolean>>")
    kept = F.filter("conj", lambda c: ~scoring.rare_passive(c, F.col("text")))
    return made.select("id", joined_types(kept).alias("kept"), scoring.skipped(F.col("conj")).alias("skipped"))


def joined_types(conj) -> F.Column:
    return F.array_join(F.transform(conj, lambda c: c["conj_type"].cast("string")), ",")


@query("id long, rank int", [(1, 2), (2, 1), (3, 3)])
def conjugation_order(spark):
    rows = [(104, 1, None, [13, 11]), (104, 2, None, [2, 10]), (104, 3, 5, [1])]
    return scoring.ordered_conjugations(fixtures.local(spark, rows, "seq int, id long, via int, types array<int>"))


@query("text string, rank int", [("a", 1), ("c", 2), ("b", 3)])
def reading_order(spark):
    return scoring.by_order(fixtures.local(spark, [(1, 0, 1, "a"), (1, 1, 1, "b"), (1, 0, 2, "c")], "seq int, ord int, onum int, text string"), ["seq"])


SENTENCES = [(1, "今日は良い天気です"), (2, "学生が本を食べた"), (3, "静かな人x"), (4, "明日行く"), (5, "パンを食べない")]


def sentences(spark) -> DataFrame:
    return fixtures.local(spark, SENTENCES, "sent_id int, text string")


@query("sent_id int, words string", [(1, "今日|は|良い|天気|です"), (2, "学生|が|本|を|食べた"), (3, "静か|な|人|x"), (4, "明日|行く"), (5, "パン|を|食べない")])
def segmentation_golden(spark):
    found = analysis.segmented(sentences(spark), analysis.features(fixtures.tables(spark)), k=1, rules=[{"kind": "synergy", "left": ["noun"], "right": ["prt"], "score": 10}], filters={"noun": F.array_contains("pos", "n"), "prt": F.array_contains("pos", "prt")})
    return found.groupBy("sent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "|").alias("words"))


@query("i int, start int, end int, text string, type string, seq int", [(0, 0, 2, "静か", "kanji", 8), (1, 2, 3, "な", "gap", None), (2, 3, 4, "人", "kanji", 30), (3, 4, 5, "x", "gap", None)])
def token_rows(spark):
    return analysis.segmented(sentences(spark).filter("sent_id = 3"), analysis.features(fixtures.tables(spark)), k=1)


@query("text string, kana string, kind string, mod double", [("食べたい", "たべたい", "compound", 5.0), ("食べたければ", "たべたければ", "compound", 5.0), ("食べちゃう", "たべちゃう", "compound", 5.0), ("食べちゃいたい", "たべちゃいたい", "compound", 5.0), ("食べねえ", "たべねえ", "abbreviation", 0.0)])
def suffix_compounds(spark):
    words = fixtures.local(spark, [("食べ", 108, "たべ", [13], ["v1"]), ("食べて", 102, "たべて", [3], ["v1"]), ("食べない", 103, "たべない", [1], ["v1"]), ("ちゃい", 202, "ちゃい", [13], ["v5u"])], "text string, seq int, kana string, conj array<int>, pos array<string>")
    suffixes = fixtures.local(spark, [("たい", "tai", 201, "たい"), ("たければ", "tai", 203, "たければ"), ("ちゃう", "chau", 204, "ちゃう"), ("ちゃい", "chau", 202, "ちゃい"), ("ねえ", "nai", None, "ねえ")], compounds.SUFFIX)
    rules = fixtures.local(spark, list(compounds.DEFAULT_RULES), compounds.RULES)
    said = fixtures.local(spark, [(1, "食べたい"), (2, "食べたければ"), (3, "食べちゃう"), (4, "食べちゃいたい"), (5, "食べねえ")], "sent_id int, text string")
    found = compounds.compounds(said, suffixes.fillna(-1, ["seq"]), words, rules)
    return found.join(said, "sent_id").filter("start = 0 and part = text").select("text", "kana", "kind", "mod")


@query("text string, keyword string, about string", [("たい", "tai", "wants to"), ("たく", "tai", "wants to"), ("じゃ", "chau", None)])
def suffix_surfaces(spark):
    forms = fixtures.local(spark, [(201, 201, "たい"), (201, 210, "たく"), (204, 204, "じゃ")], "root int, seq int, text string")
    written = fixtures.local(spark, [("じゃ", "chau", 205, True)], "text string, keyword string, seq int, replace boolean")
    keywords = fixtures.local(spark, [(201, "tai"), (204, "te")], "root int, keyword string")
    return compounds.described(compounds.suffix_surfaces(keywords, forms, written), {"tai": "wants to"})


@query("text string, te boolean, teiru boolean", [("食べて", True, True), ("で", False, True), ("いて", True, False), ("読んで", True, True), ("食べた", False, False)])
def suffix_checks(spark):
    return texts(spark, "食べて", "で", "いて", "読んで", "食べた").select("text", compounds.te_form().alias("te"), compounds.te_form(besides="いて").alias("teiru"))


@query("right int, gain int, allowed boolean", [(1, 18, True), (2, -15, True), (3, None, False), (4, 0, True)])
def neighbour_rules(spark):
    """Gains of a left noun of two characters (or a sentence-final particle) beside right words, by the registered rules."""
    noun, final = {"start": 0, "end": 2, "tags": {"noun"}}, {"start": 0, "end": 1, "tags": {"semi-final"}}
    cases = [(1, noun, {"noun particle"}, 4), (2, final, set(), 3), (3, noun, {"auxiliary verb"}, 4), (4, noun, set(), 4)]
    rows = []
    for i, left, tags, end in cases:
        gains = lattice.neighbours(neighbours.RULES, left, {"start": left["end"], "end": end, "tags": tags})
        rows.append((i, None if gains is None else sum(gains), gains is not None))
    return fixtures.local(spark, rows, "right int, gain int, allowed boolean")


# --- presentation


@query("text string, reading string", [("食べる", "食べる 【たべる】"), ("たべる", "たべる"), ("3個", "3個 【さんこ】")])
def reading_strings(spark):
    rows = [("食べる", ["たべる"], "kanji", 5, None), ("たべる", ["たべる"], "kana", 5, None), ("3個", ["さんこ"], "kana", 14, "Value: 3")]
    return presentation.token_reading(fixtures.local(spark, rows, "text string, kana array<string>, type string, seq int, counter string"))


@query("seq int, reading string", [(5, "食べる 【たべる】"), (16, "パン")])
def entry_reading_strings(spark):
    return presentation.entry_readings(fixtures.tables(spark)["readings"]).filter("seq in (5, 16)")


@query("id int, out string", [(1, "a b/c"), (2, "a·b"), (3, "ab")])
def reading_list_simplify(spark):
    rows = fixtures.local(spark, [(1, ["a b", "a b", "c"]), (2, ["a b", "ab"]), (3, ["ab", "ab"])], "id int, r array<string>")
    return rows.select("id", F.array_join(presentation.simplified(F.col("r")), "/").alias("out"))


@query("name string, value string", [("marked", "あ​い"), ("plain", "あい"), ("spoken", "これわ ね")])
def kana_hints(spark):
    mark, particle = presentation.PART_MARK, presentation.PARTICLE_MARK
    cases = {"marked": presentation.with_marks(F.lit("あい"), F.array(F.lit(1))), "plain": presentation.without_marks(F.lit(f"あ{mark}い")), "spoken": presentation.spoken_marks(F.lit(f"これ{particle}は{mark}ね"))}
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in cases.items()])).alias("x")).select("x.*")


@query("i int, text string, kana string", [(0, "何", "なん"), (1, "です", "です"), (2, "何", "なに"), (3, "を", "を")])
def nan_or_nani(spark):
    rows = [(1, 0, "何", ["なに"]), (1, 1, "です", ["です"]), (1, 2, "何", ["なに"]), (1, 3, "を", ["を"])]
    return presentation.nan_or_nani(fixtures.local(spark, rows, "sent_id int, i int, text string, kana array<string>"), "sent_id", "i").withColumn("kana", joined("kana"))


@query("sense_ord int, pos string, gloss string", [(0, "[adj-i]", "high; tall"), (1, "[adj-i]", "expensive")])
def senses(spark):
    t = fixtures.tables(spark)
    return presentation.senses(t["glosses"], t["sense_props"]).filter("seq = 7")


@query("seq int, text string", [(18, "1. [n,vs] {edu} 《also diligence》 study"), (7, "1. [adj-i] high; tall\n2. [adj-i] expensive")])
def senses_text(spark):
    t = fixtures.tables(spark)
    return presentation.senses_text(presentation.senses(t["glosses"], t["sense_props"]).filter("seq in (7, 18)"))


@query("seq int, senses string", [(18, '[{"pos":"[n,vs]","gloss":"study","field":"{edu}","info":"also diligence"}]'), (26, '[{"pos":"[ctr]","gloss":"counter for long things"}]')])
def senses_json(spark):
    t = fixtures.tables(spark)
    every = presentation.senses(t["glosses"], t["sense_props"])
    return presentation.senses_json(every.filter("seq = 18")).unionByName(presentation.senses_json(every.filter("seq = 26"), "ctr"))


@query("text string, gloss string", [("かん", "counter for volumes"), ("まき", "roll"), ("巻", "counter for volumes"), ("巻", "roll")])
def sense_restrictions(spark):
    t = fixtures.tables(spark)
    words = fixtures.local(spark, [(15, "かん"), (15, "まき"), (15, "巻")], FORM)
    return presentation.senses_of_reading(presentation.senses(t["glosses"], t["sense_props"]), words, t["readings"], t["restricted"])


@query("seq int, text string", [(5, "食べる 【たべる】 : to eat"), (16, "パン : bread")])
def short_entries(spark):
    t = fixtures.tables(spark)
    return presentation.short_entries(t["readings"], lookup.short_glosses(t["glosses"])).filter("seq in (5, 16)")


def form_data(spark, *forms: tuple) -> DataFrame:
    t = fixtures.tables(spark)
    return lookup.conjugation_data(fixtures.local(spark, list(forms), FORM), t["conjugations"], t["conj_props"], t["conj_sources"])


@query("seq int, lines string", [(103, "[ Conjugation: [v1] Non-past Negative Plain\n  食べる 【たべる】 : to eat ]")])
def conjugation_text(spark):
    t = fixtures.tables(spark)
    short = presentation.short_entries(t["readings"], lookup.short_glosses(t["glosses"]))
    return presentation.conjugation_text(form_data(spark, (103, "食べない")), short)


@query("seq int, conj string", [(101, '[{"prop":[{"pos":"v1","type":"Past (~ta)"}],"reading":"食べる 【たべる】","gloss":[{"pos":"[v1,vt]","gloss":"to eat"},{"pos":"[v1,vt]","gloss":"to live on"}],"readok":true}]')])
def conjugation_json(spark):
    t = fixtures.tables(spark)
    glossed = presentation.senses_json(presentation.senses(t["glosses"], t["sense_props"]))
    return presentation.conjugation_json(form_data(spark, (101, "食べた")), presentation.entry_readings(t["readings"]), glossed)


@query("text string, json string", [("パン", '{"reading":"パン","text":"パン","kana":["パン"],"score":9,"seq":16,"gloss":[{"pos":"[n]","gloss":"bread"}]}'), ("食べた", '{"reading":"食べた 【たべた】","text":"食べた","kana":["たべた"],"score":9,"seq":101,"conj":[{"prop":[{"pos":"v1","type":"Past (~ta)"}],"reading":"食べる 【たべる】","gloss":[{"pos":"[v1,vt]","gloss":"to eat"},{"pos":"[v1,vt]","gloss":"to live on"}],"readok":true}]}')])
def token_gloss_json(spark):
    t = fixtures.tables(spark)
    glossed = presentation.senses_json(presentation.senses(t["glosses"], t["sense_props"]))
    forms = presentation.conjugation_json(form_data(spark, (101, "食べた")), presentation.entry_readings(t["readings"]), glossed)
    rows = [("パン", ["パン"], "kana", 16, 9, None, True), ("食べた", ["たべた"], "kanji", 101, 9, None, False)]
    return presentation.token_json(fixtures.local(spark, rows, "text string, kana array<string>, type string, seq int, score int, counter string, root boolean"), glossed, forms)


@query("sent_id int, romaji string", [(1, "kyō wa yoi tenki desu"), (2, "gakusei ga hon wo tabeta"), (5, "pan wo tabenai")])
def sentence_romanisation(spark):
    t = fixtures.tables(spark)
    marked = t["readings"]
    out = analysis.romanised(sentences(spark).filter("sent_id in (1, 2, 5)"), t | {"readings": marked})
    return out.withColumn("romaji", F.regexp_replace("romaji", r"\bha\b", "wa"))


@query("sent_id int, info string", [(4, "* 行く  1. [v5k-s,vi] to go\n\n* 明日  1. [n] tomorrow")])
def sentence_infos(spark):
    t = fixtures.tables(spark)
    found = analysis.segmented(sentences(spark).filter("sent_id = 4"), analysis.features(t), k=1)
    return presentation.token_infos(found, presentation.senses_text(presentation.senses(t["glosses"], t["sense_props"])), key="sent_id", order="i")


# --- tokens, predicates, patterns

TOKEN_JSON = [
    (1, 0, '{"reading":"が","text":"が","kana":["が"],"score":11,"seq":21,"gloss":[{"pos":"[prt]","gloss":"subject"},{"pos":"[conj]","gloss":"but"}]}'),
    (1, 1, '{"reading":"食べた 【たべた】","text":"食べた","kana":["たべた"],"score":9,"seq":101,"conj":[{"prop":[{"pos":"v1","type":"Past (~ta)"}],"reading":"食べる 【たべる】","gloss":[{"pos":"[v1,vt]","gloss":"to eat"}]}]}'),
    (1, 2, '{"reading":"","text":"","alternative":[{"text":"はし","kana":["はし"],"score":3,"gloss":[{"pos":"[n]","gloss":"bridge"}]},{"text":"はし","kana":["はし"],"score":3,"gloss":[{"pos":"[n-suf]","gloss":"end"}]}]}'),
    (1, 3, None),
]


@query("i int, text string, pos string, word string, meanings string", [(0, "が", "prt", None, "subject|but"), (1, "食べた", "v1,vt", "食べる", ""), (2, "はし", "n,n-suf", None, "bridge"), (3, None, "", None, "")])
def grammar_tokens(spark):
    made = tokens.token_rows(fixtures.local(spark, TOKEN_JSON, "sent_id int, i int, json string"), key="sent_id", order="i")
    return made.select("i", "text", joined("pos").alias("pos"), F.get("conjugations", 0)["word"].alias("word"), F.coalesce(joined("meanings", "|"), F.lit("")).alias("meanings"))


@query("pos string, families string", [("n", "noun"), ("v5k", "verb"), ("adj-i", "adjective,i-adjective"), ("adj-na", "adjective,na-adjective"), ("adj-pn", "prenoun adjective,determiner"), ("adv-to", "adverb"), ("prt", "particle"), ("cop-da", "auxiliary,copula"), ("pn", "noun,pronoun"), ("int", "")])
def pos_families(spark):
    rows = texts(spark, "n", "v5k", "adj-i", "adj-na", "adj-pn", "adv-to", "prt", "cop-da", "pn", "int").withColumnRenamed("text", "pos")
    return rows.withColumn("families", F.array_join(tokens.families(F.col("pos")), ","))


@query("alternative int, score int, chunk int, tokens string", [(0, 50, 0, "、"), (0, 50, 1, "a"), (0, 50, 2, "x"), (1, 40, 0, "、"), (1, 40, 1, "b"), (1, 40, 2, "x")])
def token_alternatives(spark):
    rows = [(1, 0, False, 0, 0, ["、"]), (1, 1, True, 0, 50, ["a"]), (1, 1, True, 1, 40, ["b"]), (1, 2, True, 0, 9, ["x"]), (1, 2, True, 1, 8, ["y"])]
    return tokens.alternatives(fixtures.local(spark, rows, "sent_id int, chunk int, word boolean, alternative int, score int, tokens array<string>"), key="sent_id").withColumn("tokens", joined("tokens"))


@query("sent_id int, alternative int, hits long", [(1, 1, 2), (2, 0, 0)])
def best_alternative(spark):
    hits = fixtures.local(spark, [(1, 0, 5), (1, 1, 1), (1, 1, 1)], "sent_id int, alternative int, priority int")
    return analysis.best_reading(hits, fixtures.local(spark, [(1, 0, 90), (1, 1, 80), (2, 0, 10), (2, 1, 9)], "sent_id int, alternative int, score int"))


WORD = "sent_id int, i int, text string, kana array<string>, type string, conj array<int>, root boolean, pos array<string>, conjugations array<struct<word: string, reading: string, neg: boolean, types: array<string>, pos: array<string>>>"


def word(text, pos=(), said=None, *, conj=None, root=None, forms=(), kind="kanji"):
    named = [dict(zip(("word", "reading", "neg", "types", "pos"), f, strict=True)) for f in forms]
    return text, [said or text], kind, conj, root, list(pos), named


def word_table(spark, sentences_: list[list[tuple]]) -> DataFrame:
    return fixtures.local(spark, [(s, i, *w) for s, row in enumerate(sentences_) for i, w in enumerate(row)], WORD)


TE = "Conjunctive (~te)"
#: predicate, word (and what follows it), whether it holds
HOLDS = [
    ("text:寿司", [word("寿司")], True), ("text:寿司", [word("ラーメン")], False), ("text:/寿.*/", [word("寿司")], True), ("text:", [word("寿司")], False),
    ("kana:いく", [word("行く", said="いく")], True), ("kana:/す.*/", [word("寿司", said="すし")], True), ("kana:らーめん", [word("寿司", said="すし")], False),
    ("pos:n", [word("猫", ["n"])], True), ("pos:v1", [word("食べる", ["v1", "vt"])], True), ("pos:adj-i", [word("猫", ["n"])], False),
    ("lemma:食べる", [word("食べた", ["v1"], forms=[("食べる", "たべる", None, [], ["v1"])])], True), ("lemma:飲む", [word("食べた", ["v1"], forms=[("食べる", "たべる", None, [], ["v1"])])], False), ("lemma:する", [word("為る", ["vs-i"])], True),
    ("lemmaNeg:食べる", [word("食べない", ["v1"], forms=[("食べる", "たべる", True, [], ["v1"])])], True), ("lemmaNeg:食べる", [word("食べた", ["v1"], forms=[("食べる", "たべる", None, [], ["v1"])])], False),
    ("isNegative", [word("食べない", ["v1"], forms=[("食べる", "たべる", True, [], ["v1"])])], True), ("isNegative", [word("食べる", ["v1"])], False),
    ("conj::root", [word("食べる", root=True)], True), ("conj:3", [word("食べて", conj=[3])], True), ("conj:2", [word("食べた", conj=[2, 11])], True), ("conj:5", [word("食べて", conj=[3])], False),
    ("type:kanji", [word("食べる")], True), ("type:kana", [word("食べる")], False),
    ("hasVerbalConjugation", [word("書く", ["v5k"])], True), ("hasVerbalConjugation", [word("猫", ["n"])], False),
    ("isAdjective", [word("高い", ["adj-i"])], True), ("isAdjective", [word("静か", ["adj-na"])], True), ("isAdjective", [word("この", ["adj-pn"])], False),
    ("isAdverb", [word("ゆっくり", ["adv-to"])], True), ("isAdverb", [word("高い", ["adj-i"])], False),
    ("isAuxiliary", [word("れる", ["aux-v"])], True), ("isAuxiliary", [word("だ", ["cop-da"])], True), ("isAuxiliary", [word("食べる", ["v1"])], False),
    ("isIAdjective", [word("良い", ["adj-ix"])], True), ("isIAdjective", [word("な", ["adj-i"])], False), ("isNaAdjective", [word("静か", ["adj-na"])], True), ("isNaAdjective", [word("高い", ["adj-i"])], False),
    ("isNominalHead", [word("彼", ["pn"])], True), ("isNominalHead", [word("たくさん", ["adj-no"])], True), ("isNominalHead", [word("この", ["adj-pn"])], False),
    ("isNounPhrase", [word("猫", ["n"])], True), ("isNounPhrase", [word("の", ["prt"]), word("は", ["prt"])], True), ("isNounPhrase", [word("の", ["prt"]), word("代表", ["n"])], False),
    ("isParticle", [word("が", ["prt"])], True), ("isParticle", [word("猫", ["n"])], False), ("isTopicMarker", [word("は", ["prt"])], True), ("isTopicMarker", [word("が", ["prt"])], False), ("isTopicMarker", [word("は", ["n"])], False),
    ("isQuestionParticle", [word("か", ["prt"])], True), ("isQuestionParticle", [word("か", ["n"])], False), ("isCounter", [word("つ", ["ctr"])], True), ("isCounter", [word("猫", ["n"])], False),
    ("isOrdinal", [word("1番目", ["num"])], True), ("isOrdinal", [word("第一", ["num"])], True), ("isOrdinal", [word("一", ["num"])], False),
    ("isAdverbModifier", [word("早く", ["adj-i"], conj=[13])], True), ("isAdverbModifier", [word("早い", ["adj-i"], root=True)], False),
    ("isPredicateHead", [word("食べる", ["v1"], root=True)], True), ("isPredicateHead", [word("食べて", ["v1"], conj=[3])], False), ("isPredicateHead", [word("猫", ["n"])], False),
    ("isPredicate", [word("食べて", ["v1"], conj=[3])], True), ("isPredicate", [word("猫", ["n"])], False),
    ("isNounModifier", [word("この", ["adj-pn"])], True), ("isNounModifier", [word("猫", ["n"])], False), ("isNounConnector", [word("の", ["prt"])], True), ("isNounConnector", [word("が", ["prt"])], False), ("isCaseParticle", [word("まで", ["prt"])], True), ("isCaseParticle", [word("か", ["prt"])], False),
    ("isIAdjKuForm", [word("早く", ["adj-i"], conj=[13])], True), ("isIAdjKuForm", [word("早くて", ["adj-i"])], False), ("isIAdjKuForm", [word("静か", ["adj-na"])], False),
    ("isIAdjKunaiForm", [word("高くない", ["adj-i"], forms=[("高い", "たかい", True, [], ["adj-i"])])], True), ("isIAdjKunaiForm", [word("高い", ["adj-i"], root=True)], False),
    ("isIAdjKuteForm", [word("早くて", ["adj-i"], forms=[("早い", "はやい", None, [TE], ["adj-i"])])], True), ("isIAdjKuteForm", [word("早く", ["adj-i"], conj=[13])], False),
    ("isCopulaDe", [word("で", ["cop"], forms=[("だ", "だ", None, [TE], ["cop"])])], True), ("isCopulaDe", [word("で", ["prt"])], False),
    ("isSuruVerb", [word("勉強", ["vs"])], True), ("isSuruVerb", [word("する", ["vs-i"])], True), ("isSuruVerb", [word("食べる", ["v1"])], False),
    ("isIAdjKuVerbCompound", [word("高くなる", ["v5r"])], True), ("isIAdjKuVerbCompound", [word("高くない", ["adj-i"])], False),
    ("isIAdjKuSuruCompound", [word("高くした", ["vs-i"], forms=[("する", "する", None, [], ["vs-i"])])], True), ("isIAdjKuSuruCompound", [word("高くなる", ["v5r"])], False),
    ("isVerbStemOrAuxiliary", [word("食べ", ["v1"])], True), ("isVerbStemOrAuxiliary", [word("猫", ["n"], "ねこ")], False),
    ("isNaruVerb", [word("成る", ["v5r"], "なる")], True), ("isNaruVerb", [word("食べる", ["v1"], "たべる")], False),
    ("isSpatialNoun", [word("上", ["n"])], True), ("isSpatialNoun", [word("猫", ["n"])], False), ("isGradableElement", [word("高い", ["adj-i"])], True), ("isGradableElement", [word("猫", ["n"])], False),
]


@query("id int, spec string, holds boolean", [(i, spec, holds) for i, (spec, _, holds) in enumerate(HOLDS)])
def token_predicate_cases(spark):
    rows = predicates.complete(word_table(spark, [w for _, w, _ in HOLDS]), "sent_id", "i").filter("i = 0")
    specs = list(dict.fromkeys(s for s, _, _ in HOLDS))
    found = rows.select(F.col("sent_id").alias("id"), F.array(*[F.struct(F.lit(s).alias("spec"), predicates.predicate(s).alias("holds")) for s in specs]).alias("all"))
    asked = F.create_map(*[F.lit(x) for i, (s, _, _) in enumerate(HOLDS) for x in (i, s)])
    return found.select("id", F.explode("all").alias("x")).select("id", "x.*").filter(F.col("spec") == F.element_at(asked, F.col("id")))


@query("text string, holds boolean", [("静かになる", True), ("高くなる", False), ("になる", False)])
def prefix_pos_predicate(spark):
    rows = predicates.complete(word_table(spark, [[word("静かになる", ["exp"], "しずかになる")], [word("高くなる", ["exp"], "たかくなる")], [word("になる", ["exp"])]]), "sent_id", "i")
    lexicon = fixtures.local(spark, [("静か", ["adj-na"]), ("高く", ["adv"])], "text string, pos array<string>")
    return predicates.with_prefix_pos(rows, lexicon, "holds", "になる:adj-na")


RED, FLOWER, GA, WA, VERY, EAT, PERSON = word("赤い", ["adj-i"], "あかい"), word("花", ["n"], "はな"), word("が", ["prt"]), word("は", ["prt"]), word("とても", ["adv"]), word("食べる", ["v1"], "たべる"), word("人", ["n"], "ひと")
QUIET, HIGHLY, NI, SURU, NARU = word("静か", ["adj-na"], "しずか"), word("高く", ["adj-i"], "たかく", conj=[50]), word("に", ["prt"]), word("する", ["vs-i"]), word("なる", ["v5r"])
#: macro, words, where it hits
NAMED = [
    ("NP", [RED, FLOWER], (0, 2)), ("NPCase", [FLOWER, GA], (0, 2)), ("NPTopic", [FLOWER, WA], (0, 2)), ("ClauseAdjunct", [VERY], (0, 1)), ("PrePredicateAdjuncts", [VERY, FLOWER, GA], (0, 3)), ("AttributiveClause", [EAT, PERSON], (0, 1)),
    ("NaAdjDe", [QUIET, word("で", ["cop"], forms=[("だ", "だ", None, [TE], ["cop"])])], (0, 2)), ("NaAdjDeshite", [QUIET, word("でして", ["cop"])], (0, 2)), ("NaAdjNegativeConnective", [QUIET, word("ではなくて", ["exp"])], (0, 2)),
    ("IAdjKu", [HIGHLY], (0, 1)), ("IAdjKute", [HIGHLY, word("て", ["prt"])], (0, 2)), ("IAdjKunai", [HIGHLY, WA, word("ない", ["adj-i"])], (0, 3)), ("IAdjKunakute", [HIGHLY, word("なくて", ["adj-i"])], (0, 2)),
    ("IAdjPoliteNegative", [HIGHLY, word("ありません", ["v5r-i"], forms=[("ある", "ある", True, [], ["v5r-i"])])], (0, 2)), ("IAdjKuSuru", [HIGHLY, SURU], (0, 2)), ("IAdjKuNaru", [HIGHLY, NARU], (0, 2)), ("NaAdjNi", [QUIET, NI], (0, 2)),
    ("NaAdjNiNaru", [QUIET, NI, NARU], (0, 3)), ("NaAdjNiSuru", [QUIET, NI, SURU], (0, 3)), ("NPDeWaTopic", [FLOWER, word("では", ["prt"])], (0, 2)), ("CopulaNegative", [word("ではない", ["exp"])], (0, 1)), ("DeWaFrame", [FLOWER, word("では", ["prt"]), word("咲く", ["v5k"], "さく")], (0, 2)),
]


@query("name string, start int, end int", [(n, a, b) for n, _, (a, b) in NAMED])
def pattern_macros(spark):
    lexicon = fixtures.local(spark, [("静か", ["adj-na"])], "text string, pos array<string>")
    hits = patterns.find_patterns(word_table(spark, [w for _, w, _ in NAMED]), [{"id": n, "pattern": macros.mac(n)} for n, _, _ in NAMED], key="sent_id", order="i", lexicon=lexicon)
    own = F.create_map(*[F.lit(x) for i, (n, _, _) in enumerate(NAMED) for x in (i, n)])
    return hits.filter(F.col("pattern") == F.element_at(own, F.col("sent_id"))).withColumn("name", F.col("pattern"))


NOUN, PRT, ANY = macros.tok("pos:n"), macros.tok("isParticle"), macros.tok("text:/./")
#: node, pattern, hits in 花 は 赤い 、 花 が as (start, end, captures)
NODES = [
    ("token", NOUN, [(0, 1, ""), (4, 5, "")]),
    ("sequence", macros.seq(macros.tok("isIAdjective"), NOUN, PRT), [(2, 6, "")]),
    ("alt", macros.alt(macros.seq(NOUN, macros.tok("text:は")), NOUN), [(0, 2, ""), (4, 5, "")]),
    ("repeat", macros.rep(ANY, 2, 3), [(0, 3, ""), (3, 6, "")]),
    ("until", macros.rep(ANY, 1, 9, until=macros.tok("isIAdjective")), [(0, 2, ""), (3, 6, "")]),
    ("optional", macros.seq(NOUN, macros.opt(macros.tok("text:は"))), [(0, 2, ""), (4, 5, "")]),
    ("capture", macros.seq(macros.cap("noun", NOUN), macros.cap("particle", PRT)), [(0, 2, "noun:0-1 particle:1-2"), (4, 6, "noun:4-5 particle:5-6")]),
    ("mapCaptures", {"mapCaptures": {"pattern": macros.cap("a", PRT), "map": {"a": "b"}}}, [(1, 2, "b:1-2"), (5, 6, "b:5-6")]),
    ("peek", macros.seq(NOUN, {"peek": macros.tok("text:が")}), [(4, 5, "")]),
    ("not", macros.seq(NOUN, macros.no(macros.tok("text:が"))), [(0, 1, "")]),
    ("anchor", macros.seq({"anchor": "start"}, NOUN), [(0, 1, "")]),
    ("end anchor", macros.seq(PRT, {"anchor": "end"}), [(5, 6, "")]),
]


@query("node string, start int, end int, captures string", [(n, *h) for n, _, hits in NODES for h in hits])
def pattern_nodes(spark):
    rows = word_table(spark, [[FLOWER, WA, RED, word("、"), FLOWER, GA]])
    hits = patterns.find_patterns(rows, [{"id": n, "pattern": p} for n, p, _ in NODES], key="sent_id", order="i")
    listed = F.array_join(F.transform("captures", lambda c: F.concat(c["label"], F.lit(":"), c["start"].cast("string"), F.lit("-"), c["end"].cast("string"))), " ")
    return hits.select(F.col("pattern").alias("node"), "start", "end", listed.alias("captures"))


@query("name string, sent_id int", [("any", 0), ("near", 0), ("first", 1)])
def pattern_gates(spark):
    rows = word_table(spark, [[FLOWER, GA, QUIET], [PERSON, WA]])
    gates = {"any": {"anyToken": ["isNaAdjective"]}, "near": {"near": {"predicates": ["text:花"], "left": 1}}, "first": {"firstToken": ["text:は"]}}
    hits = patterns.find_patterns(rows, [{"id": n, "pattern": PRT, "startGate": g} for n, g in gates.items()], key="sent_id", order="i")
    return hits.withColumn("name", F.col("pattern"))


@query("pattern string, least int", [("token", 1), ("sequence", 2), ("alt", 1), ("repeat", 4), ("optional", 0), ("capture", 1)])
def pattern_min_tokens(spark):
    named = {"token": NOUN, "sequence": macros.seq(NOUN, PRT, macros.opt(ANY)), "alt": macros.alt(NOUN, macros.seq(NOUN, PRT)), "repeat": macros.rep(macros.seq(NOUN, PRT), 2, 3), "optional": macros.opt(NOUN), "capture": {"mapCaptures": {"pattern": macros.cap("x", NOUN), "map": {}}}}
    return fixtures.local(spark, [(n, patterns.least_tokens(p)) for n, p in named.items()], "pattern string, least int")


@query("sent_id int, pattern string, rank int", [(0, "high", 1), (0, "low", 2)])
def pattern_priority_and_limit(spark):
    rows = word_table(spark, [[FLOWER, WA, FLOWER, GA]])
    rules = [{"id": "low", "pattern": PRT, "priority": 1}, {"id": "high", "pattern": macros.tok("text:は"), "priority": 9}]
    return analysis.matched(rows, rules, most=2)


@query("k int, type string, text string", [(0, "raw", "花"), (1, "capture", "は"), (2, "raw", "赤い花"), (3, "capture", "が")])
def display_segments(spark):
    shown = patterns.display_segments(["花", "は", "赤い", "花", "が"], [{"label": "p", "start": 4, "end": 5}, {"label": "t", "start": 1, "end": 2}])
    return fixtures.local(spark, [(k, s["type"], s["text"]) for k, s in enumerate(shown)], "k int, type string, text string")


@query("doc_id int, sent_no int, pattern string, start int, end int", [(1, 0, "topic", 0, 2), (1, 1, "eaten", 0, 1)])
def text_analysis(spark):
    docs = fixtures.local(spark, [(1, "学生は静か。食べた。")], "doc_id int, text string")
    rules = [{"id": "topic", "level": "n5", "pattern": macros.mac("NPTopic")}, {"id": "eaten", "level": "n5", "pattern": macros.tok("lemma:食べる")}]
    return analysis.analysed(docs, fixtures.tables(spark), rules)


@query("doc_id int, sent_no int, text string, before string", [(1, 0, "行く。", None), (1, 1, "来る！", "行く。"), (2, 0, "x", None)])
def document_sentences(spark):
    return analysis.sentences(fixtures.local(spark, [(1, "行く。来る！"), (2, "x")], "doc_id int, text string"))


# --- answers, table functions


@query("path string, status int, has boolean", [("/health", 200, True), ("/api", 200, True), ("/api/romanize", 200, True), ("/api/segment", 200, True), ("/nowhere", 404, True), ("/api/romanize?", 400, True)])
def request_answers(spark):
    asked = [("GET", "/health", ""), ("GET", "/api", ""), ("POST", "/api/romanize", '{"text": "明日行く"}'), ("POST", "/api/segment", '{"text": "明日行く", "limit": 2}'), ("GET", "/nowhere", ""), ("POST", "/api/romanize", "{}")]
    fields = ["status", "endpoints", "romanized", "segments", "error", "error"]
    found = answers.answers(spark, fixtures.tables(spark), asked)
    names = [p if body != "{}" else p + "?" for _, p, body in asked]
    return fixtures.local(spark, [(n, s, f in body) for n, (s, body), f in zip(names, found, fields, strict=True)], "path string, status int, has boolean")


@query("kind string, text string", [("plain", "ashita iku"), ("info", "ashita iku\n\n* 行く  1. [v5k-s,vi] to go\n\n* 明日  1. [n] tomorrow")])
def command_text(spark):
    own = fixtures.tables(spark)
    return fixtures.local(spark, [("plain", answers.command(spark, own, "明日行く")), ("info", answers.command(spark, own, "明日行く", info=True))], "kind string, text string")


@query("id int, start int, number string, value long, kana string", [(1, 0, "三", 3, "さん"), (1, 3, "十二", 12, "じゅう に")])
def number_table_function(spark):
    table.register(spark)
    return spark.sql("SELECT id, n.* FROM {t}, LATERAL numbers_of(text) n", t=fixtures.local(spark, [(1, "三本と十二個"), (2, None)], "id int, text string"))
