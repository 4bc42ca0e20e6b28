"""Romanisation and numbers: small kernels and their Arrow-batched column functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsumugi.functions.chars import HALF_VOICED, HIRA, KATA, VOICED

# The syllabary by rows, and where the systems differ.
VOWELS = "aiueo"
ROWS = {"": "あいうえお", "k": "かきくけこ", "g": "がぎぐげご", "s": "さしすせそ", "z": "ざじずぜぞ", "t": "たちつてと", "d": "だぢづでど", "n": "なにぬねの", "h": "はひふへほ", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ", "m": "まみむめも", "r": "らりるれろ"}
ODD = {"や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "ゐ": "wi", "ゑ": "we", "を": "wo", "ん": "n'", "ゔ": "vu"}
SMALL = {"ぁ": "a", "ぃ": "i", "ぅ": "u", "ぇ": "e", "ぉ": "o", "ゃ": "ya", "ゅ": "yu", "ょ": "yo", "ゎ": "wa"}
HEPBURN = {"し": "shi", "じ": "ji", "ち": "chi", "ぢ": "ji", "つ": "tsu", "づ": "zu", "ふ": "fu"}
KUNREI = {"し": "si", "じ": "zi", "ち": "ti", "ぢ": "zi", "つ": "tu", "づ": "zu", "ふ": "hu", "ゐ": "i", "ゑ": "e", "を": "o"}
LONG = {
    "hepburn": (),
    "simple": (("oo", "o"), ("ou", "o"), ("uu", "u")),
    "passport": (("oo", "oh"), ("ou", "oh"), ("uu", "u")),
    "traditional": (("oo", "ō"), ("ou", "ō"), ("uu", "ū")),
    "modified": (("oo", "ō"), ("ou", "ō"), ("uu", "ū"), ("aa", "ā"), ("ee", "ē")),
    "kunrei": (("oo", "ô"), ("ou", "ô"), ("uu", "û")),
}
ALONE = {"っ": "!", "ー": "~"}
DIGITS = {c: i for i, signs in enumerate(("〇零", "一壱", "二弐", "三参", "四", "五", "六", "七", "八", "九")) for c in signs} | {c: i for i, c in enumerate("０１２３４５６７８９")} | {c: i for i, c in enumerate("0123456789")}
POWERS = {"十": 1, "拾": 1, "百": 2, "千": 3, "万": 4, "億": 8, "兆": 12, "京": 16}
DIGIT_KANA = ("れい", "いち", "に", "さん", "よん", "ご", "ろく", "なな", "はち", "きゅう")
POWER_KANA = {1: "じゅう", 2: "ひゃく", 3: "せん", 4: "まん", 8: "おく", 12: "ちょう", 16: "けい"}
#: (digit or power of ten before, power after): the first is doubled, the second voiced or half-voiced.
DOUBLED = {("d", 1): (3, 12, 16), ("d", 6): (2, 16), ("d", 8): (2, 3, 12, 16), ("p", 1): (12, 16), ("p", 2): (16,)}
SOFTENED = {("d", 3): ((2, 3), VOICED), ("d", 6): ((2,), HALF_VOICED), ("d", 8): ((2,), HALF_VOICED)}

BASE = {k: c + v for c, row in ROWS.items() for k, v in zip(row, VOWELS, strict=True)} | ODD
METHODS = {m: BASE | (KUNREI if m == "kunrei" else HEPBURN) | ({"を": "o"} if m == "modified" else {}) for m in LONG}
FLAT = dict(zip(map(ord, KATA), HIRA, strict=True)) | {ord("ヽ"): "ゝ", ord("ヾ"): "ゞ"}
MARKS = "ゝゞ"


def repeated_kana(kana: str) -> str:
    """Iteration marks become the kana that they repeat; a mark without one goes."""
    out, last = "", ""
    for c in kana:
        if c in MARKS:
            out += VOICED.get(last, last) if c == "ゞ" else last
        else:
            out, last = out + c, c
    return out


def with_small(piece: str, first: str, small: str) -> str:
    """A syllable's romaji with a small kana after it."""
    tail = SMALL[small]
    if first == "う":
        return "w" + tail
    if first and first in "あいえお":
        return piece + tail
    if piece in ("shi", "chi", "ji") and tail[0] == "y":
        return piece[:-1] + tail[1:]
    return piece[:-1] + tail


def romanise_word(text: str | None, method: str = "hepburn") -> str | None:
    """Romaji of kana by one of ``METHODS``; other characters stay, long-vowel marks go."""
    if text is None or text in ALONE:
        return ALONE.get(text)
    table = METHODS[method]
    pieces: list[tuple[str, str, int]] = []  # romaji, kana, doublings before it
    doublings = 0
    for c in repeated_kana(text.translate(FLAT)):
        if c == "っ":
            doublings += 1
        elif c == "ー":
            continue
        elif c in SMALL:
            piece, first, own = pieces.pop() if pieces and not doublings else ("", "", doublings)
            pieces.append((with_small(piece, first, c) if piece else SMALL[c], "", own))
            doublings = 0
        else:
            pieces.append((table.get(c, c), c, doublings))
            doublings = 0
    out = ""
    for piece, _, own in pieces:
        head = "t" if method != "kunrei" and piece.startswith("ch") else piece[:1]
        out += (head * own if head.isascii() else "") + piece
    out = re.sub(r"n'(?![aiueoy])", "n", out)
    for plain, long in LONG[method]:
        out = out.replace(plain, long)
    return re.sub(r"n(?=[mbp])", "m", re.sub(r"n'(?=[aiueoy])", "n-", out)) if method == "traditional" else out


def join_parts(parts: list[str]) -> str:
    """Parts in a row, with a space before a letter or digit unless one is there."""
    out, spaced = "", True
    for part in filter(None, parts):
        out += ("" if spaced or not re.match("[a-zA-Z0-9]", part) else " ") + part
        spaced = part[-1].isspace()
    return out


def number_of(text: str | None) -> int | None:
    """The value of kanji, full-width or mixed numerals; null where the text is no number.

    The first of the highest powers of ten parts the text; without any it is read by digits.
    """
    if text is None or any(c not in DIGITS and c not in POWERS for c in text):
        return None
    top = max((POWERS.get(c, 0) for c in text), default=0)
    if not top:
        value = 0
        for c in text:
            value = value * 10 + DIGITS[c]
        return value
    at = next(i for i, c in enumerate(text) if POWERS.get(c) == top)
    return (number_of(text[:at]) if at else 1) * 10**top + (number_of(text[at + 1 :]) or 0)


def kanji_number(n: int, one: bool = False) -> str:
    """A non-negative integer in kanji; before 十, 百 and 千 no one is written, but for 千 inside a larger unit."""
    if n < 10:
        return "〇一二三四五六七八九"[n]
    sign, power = max(((s, p) for s, p in POWERS.items() if s != "拾" and 10**p <= n), key=lambda x: x[1])
    count, rest = divmod(n, 10**power)
    silent = count == 1 and power <= (2 if one else 3)
    return ("" if silent else kanji_number(count, True)) + sign + (kanji_number(rest, one) if rest else "")


def kana_number(n: int, separator: str = " ") -> str:
    """A non-negative integer in kana, by groups, with doubled and voiced sounds where units meet."""
    groups: list[list[tuple[str, int]]] = []
    last: tuple[str, int] | None = None
    for c in kanji_number(n):
        item = ("p", POWERS[c]) if c in POWERS else ("d", DIGITS[c])
        if last and item[0] == "p" and (last[0] == "d" or item[1] > last[1]):
            groups[-1].append(item)
        else:
            groups.append([item])
        last = item
    return separator.join(map(group_kana, groups))


def group_kana(group: list[tuple[str, int]]) -> str:
    out, last = "", ("", 0)
    for kind, value in group:
        own = POWER_KANA[value] if kind == "p" else DIGIT_KANA[value]
        if kind == "p" and value in DOUBLED.get(last, ()):
            out = out[:-1] + "っ"
        powers, table = SOFTENED.get(last, ((), {}))
        if kind == "p" and value in powers:
            own = table.get(own[0], own[0]) + own[1:]
        out, last = out + own, (kind, value)
    return out


def romaniser(method: str):
    """The column function of one method."""

    @F.pandas_udf(T.StringType())
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: romanise_word(w, method), na_action="ignore")

    return run


romanise = romaniser("hepburn")
romanise_simple = romaniser("simple")


@F.pandas_udf(T.LongType())
def parse_number(words: pd.Series) -> pd.Series:
    """Null also where the value is beyond 64 bits."""
    values = words.map(number_of, na_action="ignore")
    return values.map(lambda v: v if v is not None and v < 1 << 63 else None, na_action="ignore").astype("Int64")


@F.pandas_udf(T.StringType())
def number_kana(values: pd.Series) -> pd.Series:
    return values.map(lambda v: kana_number(int(v)) if v >= 0 else None, na_action="ignore")
