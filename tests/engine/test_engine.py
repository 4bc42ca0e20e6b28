"""Building, storing, streams and edges of the Japanese engine."""

import json

import pytest
from pyspark.sql import functions as F

from tsumugi.operators import analysis, counters, lattice, lookup, neighbours, patches, scoring
from tsumugi.plans import engine, fixtures
from tsumugi.sinks import answers
from tsumugi.sources import grammars, tables
from tsumugi.streaming import texts

HEAD = "pos\tconj\tneg\tfml\tonum\tstem\tokuri\teuphr\teuphk\n"


def test_build(spark, tmp_path):
    """Entries to conjugated and corrected tables, each step written; places with numbers after the others."""
    (tmp_path / "dict.xml").write_text("<JMdict>" + engine.ENTRY + engine.LOOSE + "<entry><ent_seq>5</ent_seq><k_ele><keb>食べる</keb></k_ele><r_ele><reb>たべる</reb></r_ele><sense><pos>v1</pos><gloss>to eat</gloss></sense></entry></JMdict>")
    (tmp_path / "rules.csv").write_text(HEAD + "v1\t5\tfalse\tfalse\t1\t1\tられる\t\t\nv1\t2\tfalse\tfalse\t1\t1\tた\t\t\n")
    (tmp_path / "towns.csv").write_text("2,北海道,札幌市,ﾎｯｶｲﾄﾞｳ,ｻｯﾎﾟﾛｼ\n")
    rules = str(tmp_path / "rules.csv")
    common = lambda t: patches.set_common(t, spark.createDataFrame([(5, "食べる", 7)], "seq int, text string, new int"))
    t = tables.build(spark, str(tmp_path / "dict.xml"), rules, str(tmp_path / "out"), custom={"municipality": str(tmp_path / "towns.csv")}, errata=common)
    spelled = {r["text"]: r["seq"] for r in t["readings"].filter("script = 'kanji'").collect()}
    assert {"漢字", "食べる", "食べた", "食べられる", "食べられた", "札幌市", "札幌"} == set(spelled)
    via = {(r["seq"], r["from"], r["via"]) for r in t["conjugations"].collect()}
    assert (spelled["食べられた"], 5, spelled["食べられる"]) in via and (spelled["食べた"], 5, None) in via
    assert t["readings"].filter("text = '食べる'").first()["common"] == 7
    assert t["entry"].count() == t["entry"].select("seq").distinct().count() == 8
    assert tables.rules_of(spark, rules) is tables.rules_of(spark, rules)
    tables.forget_rules()
    tables.drop(spark, str(tmp_path / "out" / "errata"))
    assert tables.load(spark, str(tmp_path / "out" / "errata"))["entry"].count() == 0
    with pytest.raises(ValueError):
        tables.load_custom(spark, t, {"nothing": "x"})
    (tmp_path / "bad.xml").write_text("<JMdict>" + "<entry><r_ele><reb>x</reb></r_ele></entry>" * 3 + "</JMdict>")
    with pytest.raises(ValueError):
        tables.load_entries(spark, str(tmp_path / "bad.xml"), most_broken=2)


def test_grammars(spark, tmp_path):
    (tmp_path / "n5").mkdir()
    one = {"id": "n5.wa", "level": "n5", "priority": 3, "pattern": {"sequence": [{"token": ["isTopicMarker"]}]}, "examples": [{"jp": "私は", "en": "I"}]}
    (tmp_path / "n5" / "a.json").write_text(json.dumps(one, ensure_ascii=False, indent=1))
    (tmp_path / "n5" / "b.json").write_text(json.dumps({"id": "n5.none", "level": "n5", "pattern": {"sequence": []}}))
    found = grammars.grammars(spark, str(tmp_path))
    assert found.count() == 2 and grammars.grammars(spark, str(tmp_path), "n1").count() == 0
    assert grammars.rules(found) == [{"id": "n5.wa", "level": "n5", "priority": 3, "pattern": one["pattern"], "startGate": None}]


def test_streams(spark, tmp_path):
    """A stream's batches give what the table gives, and a batch that is done again replaces itself."""
    spark.createDataFrame([(1, "とうきょう"), (2, None)], "doc_id int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id int, text string").parquet(str(tmp_path / "in"))
    for _ in range(2):
        texts.written(stream, texts.romanised, str(tmp_path / "out"), str(tmp_path / "mark"), once=True).awaitTermination()
    got = {r["doc_id"]: r["romaji"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "tōkyō", 2: None}
    said = texts.sentences(spark.createDataFrame([(1, "行く。来る"), (2, "")], "doc_id int, text string"))
    assert [tuple(r) for r in said.orderBy("sent_no").collect()] == [(1, 0, "行く。"), (1, 1, "来る")]


def test_counter_grid_sounds():
    """Every number from 1 to 10 with a counter of each row of kana."""
    of = lambda kana: [counters.joined(n, kana, {}, False) for n in range(1, 11)]
    assert of("かい") == ["いっかい", "にかい", "さんかい", "よんかい", "ごかい", "ろっかい", "ななかい", "はっかい", "きゅうかい", "じゅっかい"]
    assert of("ほん")[:3] == ["いっぽん", "にほん", "さんぽん"] and of("ばん")[0] == "いちばん"
    assert counters.last_unit(1000) == 1000 and counters.last_unit(120) == 10 and counters.last_unit(0) == 0


def test_empty_and_null(spark):
    t = fixtures.tables(spark)
    none = spark.createDataFrame([], "text string")
    assert lookup.words(none, t["readings"]).count() == lookup.word_readings(none, t["readings"]).count() == 0
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "犬"), (3, "犬")], "sent_id int, text string")
    found = analysis.segmented(rows, analysis.features(t), k=1)
    assert {(r["sent_id"], r["text"], r["type"]) for r in found.collect()} == {(3, "犬", "gap")}
    empty = tables.create(spark)
    assert analysis.features(empty).count() == 0 and lookup.best_readings(empty["readings"], empty["restricted"]).count() == 0
    scored = scoring.with_score(spark.createDataFrame([(None, 1), ("犬", None)], "text string, seq int"))
    assert scored.count() == 2
    assert patches.counted(empty)["entry"].count() == 0


def test_neighbour_rules_name_filters():
    names = {x for r in neighbours.RULES for side in ("left", "right") for x in r.get(side, [])}
    assert names - {"nothing"} <= set(neighbours.FILTERS)
    free = {"kind": "follow", "left": ["a"], "right": ["b"], "free": True}
    seg = lambda a, b, *tags: {"start": a, "end": b, "seq": a, "score": 10, "tags": set(tags)}
    # a free rule lets its word begin a sentence, but not stand behind another one
    assert [p for _, p in lattice.paths_of(1, [seg(0, 1, "b")], [free], 1)] == [((0, 1, 0),)]
    assert lattice.paths_of(2, [seg(0, 1), seg(1, 2, "b")], [free], 1)[0][1] != ((0, 1, 0), (1, 2, 1))


def test_filters_as_columns(spark):
    rows = spark.createDataFrame([("学生", 0, 2, True, True, True, False, ["n"], [2], [], [], None, None), ("は", 2, 3, False, True, True, False, ["prt"], [2028920], [], [], None, None)], "text string, start int, end int, kanji boolean, primary boolean, is_common boolean, long boolean, pos array<string>, seq_set array<int>, conj_types array<int>, conj array<struct<neg: boolean>>, parts array<int>, part_texts array<string>")
    tags = {r["text"]: set(r["tags"]) for r in analysis.tagged(rows, neighbours.filters()).collect()}
    assert "noun" in tags["学生"] and "noun particle" in tags["は"] and "noun" not in tags["は"]


def test_answers(spark):
    own = fixtures.tables(spark)
    assert answers.answer(spark, own, "OPTIONS", "/api/segment") == (204, {})
    assert answers.answer(spark, own, "POST", "/api/romanize", "no json")[0] == 400
    assert answers.answer(spark, own, "POST", "/api/segment", '{"text": "x", "limit": 0}')[0] == 400
    assert answers.answer(spark, own, "POST", "/api/romanize", json.dumps({"text": "あ" * (answers.LONGEST + 1)}))[0] == 413
    (status, body), = answers.answers(spark, {}, [("GET", "/health/db", "")])
    assert status == 500 and "error" in body


def test_numbering(spark):
    rows = tables.with_seqs(spark.createDataFrame([(f"k{i:03}",) for i in range(100)], "k string").repartition(7), ["k"], 50)
    got = [(r["k"], r["seq"]) for r in rows.orderBy("k").collect()]
    assert got == [(f"k{i:03}", 50 + i) for i in range(100)]
    assert tables.next_seq(tables.create(spark)).first()["seq"] == tables.FIRST_SEQ
    assert rows.select(F.min("seq")).first()[0] == 50
