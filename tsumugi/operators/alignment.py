"""Which part of a word's reading belongs to which kanji."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.functions import chars
from tsumugi.functions.chars import HALF_VOICED, PLAIN, VOICED

# Endings that double, and the readings of the signs that stand for others.
DOUBLING = "つくきち"
KA_SIGN = [("か", "ja_on", False, None), ("が", "abbr", False, None)]
SHIME_SIGN = [("しめ", "ja_kun", False, None), ("じめ", "ja_kun", True, None)]
Reading = tuple[str, str, bool, str | None]
PART = "array<struct<literal: string, kanji: string, kana: string, type: string, rendaku: boolean, geminated: string>>"


def forms_of(text: str, kind: str, voiced: bool) -> list[Reading]:
    """A reading, its doubled form, and with ``voiced`` both of them with a voiced and half-voiced head."""
    plain: list[Reading] = [(text, kind, False, None)]
    if len(text) > 1 and kind == "ja_on" and text[-1] in DOUBLING:
        plain.append((text[:-1] + "っ", kind, False, text[-1]))
    softened = [(table.get(t[0], t[0]) + t[1:], k, True, g) for t, k, _, g in plain for table in (VOICED, HALF_VOICED)] if voiced else []
    return plain + softened


def choices(readings: list[tuple[str, str]], voiced: bool) -> list[Reading]:
    """The forms of all readings by text: the readings themselves first, of equal texts the first."""
    forms = [forms_of(text, kind, voiced) for text, kind in readings if text]
    kept: dict[str, Reading] = {}
    for form in [f[0] for f in forms] + [x for f in forms for x in f[1:]]:
        kept.setdefault(form[0], form)
    return list(kept.values())


def original_reading(text: str, voiced: bool, geminated: str | None) -> str:
    """The dictionary reading behind a form."""
    out = PLAIN.get(text[:1], text[:1]) + text[1:] if voiced else text
    return out[:-1] + geminated if geminated else out


def slots(word: str, known: dict[str, list[tuple[str, str]]]) -> list[str | dict[str, Reading]]:
    """Per character a literal, or the forms by text."""
    out: list[str | dict[str, Reading]] = []
    before = None
    for i, c in enumerate(word):
        if c == "々":
            forms, before = choices(known.get(before, []), True) if before else [], None
        elif c == "ヶ":
            forms, before = KA_SIGN, None
        elif c == "〆":
            forms, before = SHIME_SIGN, "締"
        elif "一" <= c <= "龯":
            forms, before = choices(known.get(c, []), i > 0), c
        else:
            out.append(c)
            continue
        out.append({f[0]: f for f in forms})
    return out


def aligned(word: str | None, reading: str | None, known: dict[str, list[tuple[str, str]]]) -> list[dict] | None:
    """The parts of the best alignment, null without one; kanji without a fitting reading cost its length.

    Of equal alignments the one whose earlier kanji take more kana is chosen.
    """
    if not word or not reading:
        return None
    parts = slots(word, known)

    @cache
    def best(k: int, at: int) -> tuple[int, tuple] | None:
        if k == len(parts):
            return (0, ()) if at >= len(reading) else None
        if at >= len(reading):
            return None
        slot = parts[k]
        if isinstance(slot, str):
            rest = best(k + 1, at + 1) if slot == reading[at] else None
            return rest and (rest[0], (slot, *rest[1]))
        found = None
        for end in range(len(reading), at, -1):
            if (rest := best(k + 1, end)) is None:
                continue
            text = reading[at:end]
            form = slot.get(text, (text, "irr", None, None))
            score = rest[0] - (end - at if form[1] == "irr" else 0)
            if found is None or score > found[0]:
                found = (score, (form, *rest[1]))
        return found

    whole = best(0, 0)
    if whole is None:
        return None
    out: list[dict] = []
    empty = dict.fromkeys(("literal", "kanji", "kana", "type", "rendaku", "geminated"))
    for c, part in zip(word, whole[1], strict=True):
        if not isinstance(part, str):
            out.append(empty | {"kanji": c} | dict(zip(("kana", "type", "rendaku", "geminated"), part, strict=True)))
        elif out and out[-1]["literal"] is not None:
            out[-1]["literal"] += part
        else:
            out.append(empty | {"literal": part})
    return out


def align_readings(words: DataFrame, readings: DataFrame, *, word: str = "word", reading: str = "reading") -> DataFrame:
    """``words`` with ``parts``; ``readings`` has (kanji, ord, type, text).

    Words meet the readings of their own kanji in a join, so the table of readings is not held by
    every task.  Repeated rows of words are aligned once.  Nulls and empty strings have no parts.
    """
    distinct = words.select(word, reading).distinct().filter(F.col(word).isNotNull() & F.col(reading).isNotNull())
    table = readings.groupBy("kanji").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text", "type"))), lambda r: F.struct(r["text"].alias("text"), r["type"].alias("type"))).alias("r"))
    signs = F.array_distinct(F.concat(chars.collect_class(F.col(word), "kanji-char"), F.when(F.col(word).contains("〆"), F.array(F.lit("締"))).otherwise(F.array().cast("array<string>"))))
    used = distinct.select(word, reading, F.explode_outer(signs).alias("kanji")).join(table, "kanji", "left")
    packed = used.groupBy(word, reading).agg(F.collect_list(F.struct("kanji", "r")).alias("known"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [aligned(w, r, {k["kanji"]: [(x["text"], x["type"]) for x in k["r"]] for k in known if k["r"] is not None}) for w, r, known in zip(batch[word], batch[reading], batch["known"], strict=True)]
            yield pd.DataFrame({word: batch[word], reading: batch[reading], "parts": parts})

    return words.join(packed.mapInPandas(run, f"`{word}` string, `{reading}` string, parts {PART}"), [word, reading], "left")
