"""Conjugation and path search on small tables, against fixed cases and brute force."""

import itertools
import random

from tsumugi.operators import conjugation, lattice

RULES = [
    ("adj-i", 2, False, False, 1, 1, "かった", "", ""), ("adj-i", 1, True, False, 1, 1, "くない", "", ""), ("adj-i", 1, False, False, 1, 1, "い", "", ""),
    ("v5r", 3, False, False, 1, 1, "って", "", ""), ("v1", 3, False, False, 1, 1, "て", "", ""), ("v1", 5, False, False, 1, 1, "られる", "", ""),
    ("v1", 2, False, False, 1, 1, "た", "", ""), ("v5r-i", 52, True, False, 1, 1, "ら", "", ""), ("vs-i", 2, False, False, 1, 1, "た", "し", ""),
]


def test_forms(spark):
    rules = conjugation.with_adjective_forms(spark.createDataFrame(RULES, conjugation.RULES))
    words = spark.createDataFrame([(1, "高い", "adj-i"), (1, "たかい", "adj-i"), (2, "走る", "v5r"), (3, "食べる", "v1"), (3, "食べる", "v1"), (4, "ある", "v5r-i"), (5, "する", "vs-i"), (5, "為る", "vs-i"), (6, "いい", "adj-ix"), (7, None, "v1"), (8, "犬", None)], "seq int, text string, pos string")
    forms = conjugation.conjugated(words, rules)
    got = {(r.seq, r.conj, r.neg, r.text) for r in forms.collect()}
    assert {(1, 2, None, "高かった"), (1, 2, None, "たかかった"), (1, 1, True, "高くない"), (1, 50, None, "高く"), (1, 51, None, "高"), (2, 3, None, "走って"), (3, 3, None, "食べて"), (5, 2, None, "した"), (5, 2, None, "為た"), (6, 50, None, "よく")} <= got
    assert not {s for s, *_ in got} & {4, 7, 8} and forms.count() == len(got)
    assert (1, 1, False, "高い") not in got
    again = {(r.seq, r.via, r.conj, r.text) for r in conjugation.conjugated_again(forms, rules).collect()}
    assert again == {(3, 5, 2, "食べられた"), (3, 5, 3, "食べられて")}
    text = {r.text: r.description for r in conjugation.described(forms).collect()}
    assert text["高くない"] == "[adj-i] Non-past Negative" and text["走って"] == "[v5r] Conjunctive (~te)"


def brute(n, segments, rules, k):
    """All paths by choice of segments."""
    found = {}
    for size in range(len(segments) + 1):
        for path in itertools.combinations(sorted(segments, key=lambda x: x["start"]), size):
            if any(a["end"] > b["start"] for a, b in itertools.pairwise(path)):
                continue
            values, last = {0}, None
            for x in path:
                if last and last["end"] == x["start"]:
                    gains = lattice.neighbours(rules, last, x)
                    values = {v - last["score"] + max(last["score"] + x["score"] + g, last["score"] + 1, x["score"] + 1) for v in values for g in gains or []}
                else:
                    free = lattice.neighbours([r for r in rules if r["kind"] == "follow"], {"start": 0, "end": 0, "tags": set()}, x)
                    values = {v + x["score"] for v in values} if free is not None else set()
                last = x
            if values:
                covered = sum(x["end"] - x["start"] for x in path)
                key = tuple((x["start"], x["end"], x["seq"]) for x in path)
                found[key] = max(values) + lattice.GAP * (n - covered)
    return sorted(((v, p) for p, v in found.items()), key=lambda x: (-x[0], x[1]))[:k]


def test_paths():
    rules = [{"kind": "synergy", "left": ["n"], "right": ["prt"], "score": 10, "by_right": 4}, {"kind": "penalty", "left": ["prt"], "right": ["prt"], "score": -9}, {"kind": "penalty", "right": ["prt"], "left": ["x"], "score": -3}, {"kind": "follow", "left": ["n"], "right": ["aux"]}]
    pick = random.Random(7)
    for _ in range(60):
        n = pick.randint(1, 6)
        segments = []
        for seq in range(pick.randint(0, 7)):
            start = pick.randrange(n)
            segments.append({"start": start, "end": pick.randint(start + 1, n), "seq": seq, "score": pick.randint(1, 40), "tags": set(pick.sample(["n", "prt", "aux", "x"], 2))})
        for k in (1, 3):
            got = lattice.paths_of(n, segments, rules, k)
            want = brute(n, segments, rules, k)
            assert [g[0] for g in got] == [w[0] for w in want] and (k > 1 or got == want)


def test_path_rows(spark):
    lengths = spark.createDataFrame([(1, 2), (2, 0), (3, None)], "sent_id int, n int")
    hits = spark.createDataFrame([(1, 0, 2, 5, 7, ["n"])], "sent_id int, start int, end int, seq int, score long, tags array<string>")
    got = sorted((r.sent_id, r.rank, r.score, len(r.path)) for r in lattice.best_paths(hits, lengths, k=2).collect())
    assert got == [(1, 1, 7, 1), (1, 2, -1000, 0), (2, 1, 0, 0), (3, 1, 0, 0)]
