"""Functions on words and their spellings that compare, cut, patch and name them."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsumugi.functions.chars import CLASSES, as_hiragana, full_width_kana, kanji_cross_match, kanji_match

DIFF = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("same", "left", "right")]))
#: Longer spellings are not compared place by place.
LONGEST = 40
MACRONS = dict(zip("āīūēōâîûêô", "aiueoaiueo", strict=True))


def simplified_ngrams(col: Column, table: list[tuple[str, str]]) -> Column:
    """The replacements of ``table`` one after the other, in order."""
    for old, new in table:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def patched(col: Column, add: str, cut: str) -> Column:
    """The word without as many characters as ``cut`` has at its end, and with ``add`` there."""
    return F.concat(F.substring(col, F.lit(1), F.length(col) - len(cut)), F.lit(add))


def cut_end(col: Column, n: int) -> Column:
    """The word without its last ``n`` characters; shorter words become empty."""
    return F.substring(col, F.lit(1), F.length(col) - n)


def between(col: Column, start: int, end: int | None = None) -> Column:
    """The characters from ``start`` up to ``end``; null where these aren't places of the word in order."""
    stop = F.length(col) if end is None else F.lit(end)
    fits = (F.lit(start) >= 0) & (F.lit(start) <= F.length(col)) & (stop >= start) & (stop <= F.length(col))
    return F.when(fits, F.substring(col, F.lit(start + 1), stop - start))


def difference(a: str | None, b: str | None) -> list[tuple] | None:
    """The parts of two spellings in order, shared ones and differing pairs, with as many shared characters as possible.

    A spelling's first characters differ as a pair only if later ones are shared again; spellings that
    can't be so parted have none.  Of equal partings the one with the shortest first pair counts.
    """
    if a is None or b is None or max(len(a), len(b)) > LONGEST:
        return None

    @cache
    def best(i: int, j: int) -> tuple[int, tuple] | None:
        x, y = a[i:], b[j:]
        if not x or not y:
            return None
        n = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        if x == y:
            return n, ((x, None, None),)
        if len(x) == 1 or len(y) == 1:
            return 0, ((None, x, y),)
        if n == min(len(x), len(y)):
            # one ends inside the other: its last character stands against the other's
            return n - 1, ((x[: n - 1], None, None), (None, x[n - 1], y[n - 1]))
        if n:
            rest = best(i + n, j + n)
            return rest and (rest[0] + n, ((x[:n], None, None), *rest[1]))
        tries = [(best(i + p, j + q), p, q) for p in range(1, len(x)) for q in range(1, len(y)) if x[p] == y[q]]
        found = max((t for t in tries if t[0]), key=lambda t: t[0][0], default=None)
        return found and (found[0][0], ((None, x[: found[1]], y[: found[2]]), *found[0][1]))

    whole = best(0, 0)
    return None if whole is None else list(whole[1])


@F.pandas_udf(DIFF)
def spelling_difference(left: pd.Series, right: pd.Series) -> pd.Series:
    """``difference`` as a column."""
    return pd.Series([None if (d := difference(a, b)) is None else [dict(zip(("same", "left", "right"), p, strict=True)) for p in d] for a, b in zip(left, right, strict=True)], dtype="object")


@F.pandas_udf(T.StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """Compatibility characters as their plain forms (NFKC)."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def without_macrons(col: Column) -> Column:
    return F.translate(F.lower(col), "".join(MACRONS), "".join(MACRONS.values()))


def hiragana(col: Column) -> Column:
    """Katakana of either width as hiragana."""
    return as_hiragana(full_width_kana(col))


def word_type(kind: Column, text: Column) -> Column:
    """kanji, kana or gap, of a word row of ``kind`` gap, counter or any other."""
    return F.when(kind == "gap", "gap").when(text.rlike(f"[{CLASSES['kanji-char']}]"), "kanji").otherwise("kana")


def word_text(kind: Column, text: Column, number: Column) -> Column:
    """What stands in the sentence: a counter's number and text."""
    return F.when(kind == "counter", F.concat(F.coalesce(number, F.lit("")), text)).otherwise(text)


def true_text(kind: Column, text: Column, source: Column) -> Column:
    """The dictionary's spelling behind a proxy, else the text."""
    return F.when(kind == "proxy", F.coalesce(source, text)).otherwise(text)


def word_seq(kind: Column, seq: Column, seqs: Column) -> Column:
    """The numbers of a word as an array: all parts of a compound, else its own."""
    return F.when(kind == "compound", seqs).when(seq.isNotNull(), F.array(seq))


def best_form(forms: Column, word: Column, parent: Column, parent_kana: Column) -> Column:
    """Of a conjugated word's kana forms (an array) the one for its spelling.

    The only one; else the one that the parent's kana gives by the shared head; else the first that
    fits the spelling, nearest in length to that; else the first.
    """
    cross = kanji_cross_match(parent, parent_kana, word)
    far = lambda f: F.abs(F.length(f) - F.length(cross))
    fitting = F.filter(forms, lambda f: cross.isNotNull() & kanji_match(word, f))
    least = F.array_min(F.transform(fitting, far))
    near = F.get(F.filter(fitting, lambda f: far(f) == least), 0)
    return F.when(F.size(forms) == 1, F.get(forms, 0)).when(F.array_contains(forms, cross), cross).otherwise(F.coalesce(near, F.get(forms, 0)))
