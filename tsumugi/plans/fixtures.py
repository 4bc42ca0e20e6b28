"""A small dictionary, written by hand, on which the queries of the Japanese engine run."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tsumugi.operators import conjugation
from tsumugi.sources.tables import SCHEMAS

#: seq, kanji spellings, kana, common number, word classes by sense, misc tags, glosses by sense
WORDS = [
    (1, "今日", "きょう こんにち", 1, ["n"], [], ["today; this day"]),
    (2, "学生", "がくせい", 2, ["n"], [], ["student"]),
    (3, "私", "わたし わたくし", 1, ["pn"], [], ["I; me"]),
    (4, "", "は", 0, ["prt"], [], ["indicates sentence topic"]),
    (5, "食べる", "たべる", 3, ["v1 vt"], [], ["to eat", "to live on"]),
    (6, "行く 往く", "いく ゆく", 1, ["v5k-s vi"], [], ["to go"]),
    (7, "高い", "たかい", 4, ["adj-i", ""], [], ["high; tall", "expensive"]),
    (8, "静か", "しずか", 5, ["adj-na"], [], ["quiet"]),
    (9, "", "です", 0, ["cop"], [], ["be; is"]),
    (10, "箸", "はし", 12, ["n"], [], ["chopsticks"]),
    (11, "橋", "はし", 6, ["n"], [], ["bridge"]),
    (12, "端", "はし はた", None, ["n"], [], ["end; edge"]),
    (13, "", "けり", None, ["aux-v"], ["arch"], ["indicates recollection"]),
    (14, "個 箇", "こ", 8, ["ctr"], [], ["counter for articles"]),
    (15, "巻", "かん まき", 9, ["ctr", "n"], [], ["counter for volumes", "roll"]),
    (16, "", "パン", 0, ["n"], ["uk"], ["bread"]),
    (17, "為る", "する", 0, ["vs-i"], ["uk"], ["to do"]),
    (18, "勉強", "べんきょう", 7, ["n vs"], [], ["study"]),
    (19, "", "で", 0, ["prt"], [], ["at; in"]),
    (20, "", "に", 0, ["prt"], [], ["at; to"]),
    (21, "", "が", 0, ["prt"], [], ["indicates sentence subject"]),
    (22, "", "を", 0, ["prt"], [], ["indicates direct object"]),
    (23, "", "の", 0, ["prt"], [], ["of"]),
    (24, "明日", "あした あす みょうにち", 1, ["n"], [], ["tomorrow"]),
    (25, "候", "そうろう", None, ["v4r"], ["arch"], ["to be"]),
    (26, "本", "ほん", 1, ["n", "ctr"], [], ["book", "counter for long things"]),
    (27, "良い", "よい いい", 2, ["adj-ix"], [], ["good"]),
    (28, "天気", "てんき", 3, ["n"], [], ["weather"]),
    (29, "何", "なに なん", 1, ["pn"], [], ["what"]),
    (30, "人", "ひと", 1, ["n"], [], ["person"]),
]
#: sense properties besides word classes and misc: seq, sense, tag, text
PROPS = [(15, 0, "stagr", "かん"), (15, 1, "stagr", "まき"), (18, 0, "field", "edu"), (18, 0, "s_inf", "also diligence")]
RESTRICTED = [(24, "みょうにち", "明日"), (6, "ゆく", "往く")]
#: id, seq, from, via, (type, pos, neg, fml)..., (spelling, source)...
FORMS = [
    (1, 101, 5, None, [(2, "v1", False, False)], [("食べた", "食べる"), ("たべた", "たべる")]),
    (2, 102, 5, None, [(3, "v1", False, False)], [("食べて", "食べる"), ("たべて", "たべる")]),
    (3, 103, 5, None, [(1, "v1", True, False)], [("食べない", "食べる"), ("たべない", "たべる")]),
    (4, 104, 5, None, [(5, "v1", False, False), (6, "v1", False, False)], [("食べられる", "食べる"), ("たべられる", "たべる")]),
    (5, 105, 5, 104, [(2, "v1", False, False)], [("食べられた", "食べられる"), ("たべられた", "たべられる")]),
    (6, 106, 7, None, [(50, "adj-i", None, None)], [("高く", "高い"), ("たかく", "たかい")]),
    (7, 107, 7, None, [(51, "adj-i", None, None)], [("高", "高い"), ("たか", "たかい")]),
    (8, 108, 5, None, [(13, "v1", None, None)], [("食べ", "食べる"), ("たべ", "たべる")]),
    (9, 109, 6, None, [(2, "v5k-s", False, False)], [("行った", "行く"), ("いった", "いく"), ("往った", "往く"), ("ゆった", "ゆく")]),
    (10, 110, 7, None, [(1, "adj-i", True, False)], [("高くない", "高い"), ("たかくない", "たかい")]),
    (11, 111, 25, None, [(2, "v4r", False, False)], [("候った", "候"), ("そうろった", "そうろう")]),
    (12, 112, 5, None, [(10, "v1", True, False)], [("食べるな", "食べる"), ("たべるな", "たべる")]),
    (13, 113, 9, None, [(2, "cop", False, True)], [("でした", "です")]),
]
# pos, conj, neg, fml, onum, stem, okuri, euphr, euphk
RULES = [
    ("v1", 1, True, False, 1, 1, "ない", "", ""), ("v1", 2, False, False, 1, 1, "た", "", ""), ("v1", 3, False, False, 1, 1, "て", "", ""),
    ("v1", 5, False, False, 1, 1, "られる", "", ""), ("v1", 10, False, False, 1, 1, "ろ", "", ""), ("v1", 13, False, False, 1, 1, "", "", ""),
    ("adj-i", 1, True, False, 1, 1, "くない", "", ""), ("adj-i", 2, False, False, 1, 1, "かった", "", ""),
    ("v5k-s", 2, False, False, 1, 1, "った", "", ""), ("vs-i", 2, False, False, 1, 1, "た", "し", ""),
]


def rows() -> dict[str, list[tuple]]:
    """All tables as rows."""
    out: dict[str, list[tuple]] = {n: [] for n in SCHEMAS}
    for seq, kanji, kana, common, senses, misc, glosses in WORDS:
        k, r = kanji.split(), kana.split()
        out["entry"].append((seq, True, len(k), len(r), not k))
        # the first spelling of each script is the common one
        out["readings"] += [(seq, s, i, t, common if i == 0 else None, False) for s, many in (("kanji", k), ("kana", r)) for i, t in enumerate(many)]
        for i, (pos, gloss) in enumerate(zip(senses + [""] * (len(glosses) - len(senses)), glosses, strict=True)):
            out["glosses"] += [(seq, i, j, g) for j, g in enumerate(gloss.split("; "))]
            out["sense_props"] += [(seq, i, "pos", j, p) for j, p in enumerate(pos.split())] + ([(seq, i, "misc", j, m) for j, m in enumerate(misc)] if i == 0 else [])
    out["sense_props"] += [(s, o, t, 0, x) for s, o, t, x in PROPS]
    out["restricted"] = list(RESTRICTED)
    for i, seq, source, via, props, texts in FORMS:
        kana = [t for t, _ in texts if all("ぁ" <= c <= "ー" for c in t)]
        kanji = [t for t, _ in texts if t not in kana]
        out["entry"].append((seq, False, len(kanji), len(kana), False))
        out["readings"] += [(seq, s, j, t, None, False) for s, many in (("kanji", kanji), ("kana", kana)) for j, t in enumerate(many)]
        out["conjugations"].append((i, seq, source, via))
        out["conj_props"] += [(i, *p) for p in props]
        out["conj_sources"] += [(i, t, s) for t, s in texts]
    return out


def local(spark: SparkSession, found: list[tuple], schema: str) -> DataFrame:
    """Rows as a table that is part of the plan, so that the planner knows how small it is."""
    names = StructType.fromDDL(schema).fieldNames()
    if not found:
        return spark.createDataFrame([], schema)
    quoted = [json.dumps(dict(zip(names, r, strict=True))).replace("\\", "\\\\").replace("'", "\\'") for r in found]
    return spark.sql(f"SELECT x.* FROM (SELECT from_json(j, '{schema}') AS x FROM VALUES {', '.join(f"('{q}')" for q in quoted)} AS t(j))")


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: local(spark, found, SCHEMAS[name]) for name, found in rows().items()}


def rules(spark: SparkSession) -> DataFrame:
    return conjugation.with_adjective_forms(local(spark, RULES, conjugation.RULES))
