"""Predicates, nodes, macros and gates on hand-written tokens."""

import pytest

from tsumugi.functions import predicates
from tsumugi.operators import macros, patterns

SCHEMA = "sent_id int, i int, text string, kana array<string>, type string, conj array<int>, root boolean, pos array<string>, conjugations array<struct<word: string, reading: string, neg: boolean, types: array<string>, pos: array<string>>>"


def token(text, pos=(), kana=None, conj=None, root=None, forms=(), type_="kanji"):
    return text, [kana or text], type_, conj, root, list(pos), [dict(zip(("word", "reading", "neg", "types", "pos"), f, strict=True)) for f in forms]


SENTENCES = {
    1: [token("私", ["pn"], "わたし"), token("は", ["prt"]), token("静か", ["adj-na"], "しずか"), token("で", ["cop"], forms=[("だ", "だ", False, ["Conjunctive (~te)"], ["cop"])]), token("良い", ["adj-i"], "よい", root=True), token("学生", ["n"], "がくせい"), token("です", ["cop"], root=True)],
    2: [token("早く", ["adv"], "はやく"), token("なる", ["v5r"], root=True)],
    3: [token("高く", ["adj-i"], "たかく"), token("、"), token("ない", ["adj-i"])],
    4: [token("好きになる", ["exp", "v5r"], "すきになる", forms=[("好きになる", "すきになる", None, [], ["v5r"])])],
    5: [token("弟", ["n"], "おとうと"), token("の", ["prt"])],
    6: [token("高くない", ["adj-i"], "たかくない", forms=[("高い", "たかい", True, ["Non-past"], ["adj-i"])]), token("です", ["cop"])],
    7: [(None, None, None, None, None, None, None)],
}


@pytest.fixture(scope="module")
def tokens(spark):
    return spark.createDataFrame([(s, i, *t) for s, row in SENTENCES.items() for i, t in enumerate(row)], SCHEMA)


def found(tokens, *rules, **options):
    hits = patterns.find_patterns(tokens, [{"id": str(i), "pattern": p} if "pattern" not in p else p for i, p in enumerate(rules)], key="sent_id", order="i", **options)
    return sorted((h.sent_id, h.pattern, h.start, h.end, tuple((c.label, c.start, c.end) for c in h.captures)) for h in hits.collect())


def test_macros(spark, tokens):
    lexicon = spark.createDataFrame([("好き", ["adj-na"]), ("好き", None)], "text string, pos array<string>")
    names = list(macros.MACROS)
    hits = found(tokens, *[{"id": n, "pattern": macros.mac(n)} for n in names], lexicon=lexicon)
    spans = {(s, n, a, b) for s, n, a, b, _ in hits}
    assert {(1, "NPTopic", 0, 2), (1, "NaAdjDe", 2, 4), (2, "IAdjKuNaru", 0, 2), (4, "NaAdjNiNaru", 0, 1), (5, "NP", 0, 2), (6, "IAdjPoliteNegative", 0, 2)} <= spans
    # commas are passed over inside a sequence; a noun phrase takes the predicates before its noun
    assert (3, "IAdjKunai", 0, 3) in spans and (1, "NP", 2, 6) in spans
    assert not [x for x in spans if x[0] == 7]


def test_nodes(tokens):
    prt = macros.tok("isParticle")
    any_ = macros.tok("text:/./")
    assert found(tokens, {"mapCaptures": {"pattern": macros.cap("a", prt), "map": {"a": "b"}}}) == [(1, "0", 1, 2, (("b", 1, 2),)), (5, "0", 1, 2, (("b", 1, 2),))]
    # repeats stop at four by default, and hits of a rule don't overlap
    assert [h[2:4] for h in found(tokens, {"repeat": {"pattern": any_}}) if h[0] == 1] == [(0, 4), (4, 7)]
    assert [h[2:4] for h in found(tokens, macros.rep(any_, 1, 10, until=macros.tok("isNaAdjective"))) if h[0] == 1] == [(0, 2), (3, 7)]
    assert found(tokens, macros.seq({"anchor": "start"}, any_, {"anchor": "end"})) == [(4, "0", 0, 1, ())]
    assert [h[:4] for h in found(tokens, macros.seq(macros.tok("isAdverb"), {"peek": macros.tok("isNaruVerb")}))] == [(2, "0", 0, 1)]
    assert found(tokens, {"sequence": []}) == []
    with pytest.raises(ValueError):
        found(tokens, macros.mac("nothing"))


def test_gates(tokens):
    rule = {"id": "g", "pattern": macros.tok("isParticle")}
    assert [h[0] for h in found(tokens, rule | {"startGate": {"anyToken": ["isNaAdjective"]}})] == [1]
    assert [h[0] for h in found(tokens, rule | {"startGate": {"near": {"predicates": ["text:弟"], "left": 1}}})] == [5]
    assert found(tokens, rule | {"startGate": {"firstToken": ["text:が"]}}) == []


def test_ranking():
    best = patterns.best_outcome
    assert best([(2, (), 10), (4, (("x", 0, 1),), 1), (4, (), 3)], 0) == (4, (), 3)
    assert best([(3, (), 0), (3, (("a", 0, 1),), 0)], 0)[1] and best([(0, (), 0)], 0) is None


def test_predicates(spark, tokens):
    rows = predicates.complete(tokens, "sent_id", "i")
    specs = [*predicates.PLAIN, "text:の", "kana:/く$/", "pos:n", "lemma:高い", "lemmaNeg:高い", "conj::root", "conj:13", "type:kanji", "lemma"]
    got = {(r[0], r[1]): {s for s, v in zip(specs, r[2:], strict=True) if v} for r in rows.select("sent_id", "i", *[predicates.predicate(s).alias(f"c{k}") for k, s in enumerate(specs)]).collect()}
    assert not got[7, 0]
    assert {"isNounPhrase", "isNounConnector", "text:の"} <= got[5, 1]
    assert {"lemma:高い", "lemmaNeg:高い", "isIAdjKunaiForm"} <= got[6, 0]
    assert "isCopulaDe" in got[1, 3] and "conj::root" in got[1, 4] and "isIAdjKuForm" in got[2, 0]
    with pytest.raises(ValueError):
        predicates.predicate("isNothing")


def test_display_segments():
    assert patterns.display_segments(["a", "b", "c"], [{"label": "x", "start": 1, "end": 2}]) == [{"type": "raw", "text": "a"}, {"type": "capture", "label": "x", "text": "b"}, {"type": "raw", "text": "c"}]
