"""What words gain or lose beside each other: named filters, and rules between their names.

``FILTERS`` are Column tests of a candidate (see ``scoring``); ``analysis.tagged`` turns them into
tags and ``lattice.best_paths`` reads ``RULES``.  Rules of one's own are added in the same form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsumugi.operators.scoring import PARTICLES, ends_with_seq, ends_with_text, in_seqs, is_conjugation, is_noun, is_pos, short_kana

# Seqs of particles that follow nouns.
NOUN_PARTICLES = (2028920, 2028930, 2028990, 2028980, 2029000, 1007340, 1579080, 1525680, 2028940, 1582300, 2215430, 1469800, 1009990, 2029010, 1005120, 2034520, 1008490, 1008530, 1008590, 2028950, 2028960, 1009600)


def word() -> Column:
    return F.col("kanji") | F.col("long") | (F.col("primary") & F.col("is_common"))


# Which words a rule is about, by seq, word class or ending.
FILTERS: dict[str, Callable[[], Column]] = {
    "noun": is_noun,
    "noun particle": lambda: in_seqs(*NOUN_PARTICLES),
    "da": lambda: in_seqs(2089020),
    "no": lambda: in_seqs(1469800, 2139720),
    "copula": lambda: in_seqs(2089020, 1007370, 1928670),
    "sou na": lambda: in_seqs(2137720),
    "n da": lambda: in_seqs(2140410),
    "adj-no": lambda: is_pos("adj-no", test=word()),
    "no particle": lambda: in_seqs(1469800),
    "adj-na": lambda: is_pos("adj-na", test=word()),
    "na or ni": lambda: in_seqs(2029110, 2028990),
    "adv-to": lambda: is_pos("adv-to", test=F.col("kanji") | F.col("long") | F.col("primary")),
    "to": lambda: in_seqs(1008490),
    "chuu": lambda: in_seqs(1620400, 2083570),
    "tachi": lambda: in_seqs(1416220),
    "buri": lambda: in_seqs(1361140),
    "sei": lambda: in_seqs(1375260),
    "o": lambda: in_seqs(1270190),
    "plain noun": lambda: is_pos("n", test=F.col("kanji") | F.col("long")),
    "kanji prefix": lambda: in_seqs(2242840, 1922780, 2423740),
    "kanji noun": lambda: is_pos("n", test=F.col("kanji")),
    "ends in wa": lambda: ends_with_seq(2028920),
    "not done": lambda: in_seqs(1000730, 1612750, 1409110, 2829697, 1587610),
    "shika": lambda: in_seqs(1005460),
    "negative": lambda: F.coalesce(F.exists("conj", lambda c: ~c["neg"].eqNullSafe(F.lit(False))), F.lit(False)),
    "toori": lambda: in_seqs(1432920),
    "counter": lambda: is_pos("ctr", test=F.lit(True)),
    "oki": lambda: in_seqs(2854117, 2084550),
    "short": lambda: short_kana(1),
    "short but to": lambda: short_kana(1, "と"),
    "semi-final": lambda: in_seqs(*PARTICLES["semi_final"]),
    "continuative": lambda: is_conjugation(13),
    "auxiliary verb": lambda: in_seqs(1342560),
    "not tsu": lambda: ~in_seqs(2221640),
    "iru": lambda: in_seqs(1577980),
    "no lone particle": lambda: ~in_seqs(*NOUN_PARTICLES, simple=True),
    "n": lambda: in_seqs(2139720, 2849370, 2849387),
    "wo": lambda: in_seqs(2029010),
    "karasu": lambda: in_seqs(2087020),
    "bad end": lambda: ends_with_text("ちゃい", "いか", "とか", "とき", "い"),
    "literary suki": lambda: is_conjugation(54) & F.col("text").endswith("好き"),
    "not iro": lambda: ~ends_with_text("いろ"),
    "begins with ku": lambda: F.col("text").startswith("く"),
    "not sa": lambda: ~ends_with_seq(2029120),
    "begins with e": lambda: F.col("text").startswith("え"),
    "not wa": lambda: ~ends_with_seq(2028920),
    "nai": lambda: in_seqs(1529520, 1296400, 2139720),
    "not no": lambda: ~in_seqs(1469800),
    "hayameru": lambda: in_seqs(1601080),
    "not nan da to": lambda: ~in_seqs(2837117),
    "omou": lambda: in_seqs(1589350, 1587040),
    "not to": lambda: ~in_seqs(1008490),
    "totte": lambda: in_seqs(2086960),
    "not da": lambda: ~in_seqs(2089020) | in_seqs(2028980),
    "suru": lambda: in_seqs(1157170, 2424740, 1305070),
    "not ni": lambda: ~in_seqs(1896380, 2422860),
    "dekiru": lambda: in_seqs(2830009, 1547720),
    "honorific": lambda: in_seqs(1247260),
}


def synergy(left: str, right: str, score: int, **more: int) -> dict:
    return {"kind": "synergy", "left": [left], "right": [right], "score": score} | more


def follows(left: str, right: str, *, free: bool = False) -> dict:
    """Right words stand only behind left ones; ``free`` ones also where nothing is before them."""
    return {"kind": "follow", "left": [left], "right": [right]} | ({"free": True} if free else {})


RULES = [
    synergy("noun", "noun particle", 10, by_right=4),
    synergy("noun", "da", 10),
    synergy("no", "copula", 15),
    synergy("sou na", "n da", 50),
    synergy("adj-no", "no particle", 15),
    synergy("adj-na", "na or ni", 15),
    synergy("adv-to", "to", 10, by_left=10),
    synergy("noun", "chuu", 12),
    synergy("noun", "tachi", 10),
    synergy("noun", "buri", 40),
    synergy("noun", "sei", 12),
    synergy("o", "plain noun", 10),
    synergy("kanji prefix", "kanji noun", 15),
    synergy("ends in wa", "not done", 50),
    synergy("shika", "negative", 50),
    synergy("no particle", "toori", 50),
    synergy("counter", "oki", 20),
    {"kind": "penalty", "left": ["semi-final"], "score": -15},
    {"kind": "penalty", "left": ["short"], "right": ["short but to"], "score": -9},
    follows("continuative", "auxiliary verb"),
    follows("not tsu", "iru", free=True),
    follows("no lone particle", "n", free=True),
    follows("wo", "karasu"),
    follows("nothing", "bad end"),
    follows("nothing", "literary suki"),
    follows("not iro", "begins with ku", free=True),
    follows("not sa", "begins with e", free=True),
    follows("not wa", "nai", free=True),
    follows("not no", "hayameru", free=True),
    follows("not nan da to", "omou", free=True),
    follows("not to", "totte", free=True),
    follows("not da", "suru", free=True),
    follows("not ni", "dekiru", free=True),
    follows("no lone particle", "honorific"),
]


def filters() -> dict[str, Column]:
    """The tests as columns, for ``analysis.tagged``."""
    return {name: test() for name, test in FILTERS.items()}
