"""Character classes, normalisation and spelling functions of Japanese text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode ranges of the classes, marks and their plain forms.
HIRAGANA, KATAKANA, KANJI = "ぁ-ゔゝゞー", "ァ-ヺヽヾー", "々ヶ〆一-龯"
WORD = KANJI + "ァ-ヺヽヾぁ-ゔゝゞー〇"
DIGIT = "0-9０-９〇"
NUMERAL = "0-9０-９〇一二三四五六七八九零壱弐参拾十百千万億兆京"
CLASSES = {
    "hiragana": HIRAGANA,
    "katakana": KATAKANA,
    "katakana-uniq": "ァ-ヺヽヾ",
    "kanji": KANJI,
    "kanji-char": "一-龯",
    "kana": KATAKANA + HIRAGANA,
    "traditional": HIRAGANA + KANJI,
    "nonword": "^" + WORD,
    "number": NUMERAL,
    "word": WORD,
    "digit": "0-9０-９",
    "letter": "A-Za-zＡ-Ｚａ-ｚ",
}
HALF_KANA = "･ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ"
FULL_KANA = "・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン゛゜"
WIDE_SIGNS = "＃＄％＆（）＊＋／〈＝〉？＠［］＾＿｛｜｝～"
NARROW_SIGNS = "#$%&()*+/<=>?@[]^_{|}~"
PUNCTUATION = (("【", " ["), ("】", "] "), ("、", ", "), ("，", ", "), ("。", ". "), ("・・・", "... "), ("・", " "), ("　", " "), ("「", ' "'), ("」", '" '), ("゛", '"'), ("『", " «"), ("』", "» "), ("〜", " - "), ("：", ": "), ("！", "! "), ("；", "; "))
SMALL = "っッぁァぃィぅゥぇェぉォゃャゅュょョー"

WIDE = "".join(chr(0xFEE0 + ord(c)) for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") + WIDE_SIGNS
NARROW = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + NARROW_SIGNS
#: Katakana stand at a constant distance from hiragana, voiced kana next to plain ones.
KATA = "".join(chr(c) for c in range(0x30A1, 0x30F5))
HIRA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F5))
VOICING = "かきくけこさしすせそたちつてとはひふへほ"
HALF_VOICING = "はひふへほ"
AS_KATA = dict(zip(map(ord, HIRA), KATA, strict=True))
VOICED = {c: chr(ord(c) + 1) for c in VOICING + VOICING.translate(AS_KATA)} | {"う": "ゔ", "ウ": "ヴ"}
HALF_VOICED = {c: chr(ord(c) + 2) for c in HALF_VOICING + HALF_VOICING.translate(AS_KATA)}
PLAIN = {v: k for table in (VOICED, HALF_VOICED) for k, v in table.items()}
#: Parts the runs of a split; no character of any text.
PART = "￾"


def swap(col: Column, table: dict[str, str]) -> Column:
    return F.translate(col, "".join(table), "".join(table.values()))


def is_class(col: Column, name: str) -> Column:
    """The whole string is of one class."""
    return col.rlike(f"^[{CLASSES[name]}]+$")


def count_class(col: Column, name: str) -> Column:
    return F.regexp_count(col, F.lit(f"[{CLASSES[name]}]"))


def collect_class(col: Column, name: str) -> Column:
    return F.regexp_extract_all(col, F.lit(f"([{CLASSES[name]}])"))


def class_runs(col: Column, name: str) -> Column:
    """The longest runs of a class in order, as array<struct<start, end>>."""
    pieces = F.split(F.regexp_replace(col, f"([{CLASSES[name]}]+)", f"{PART}$1{PART}"), PART)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("runs"), F.lit(False).alias("own"))
    step = lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.when(s["own"], F.concat(s["runs"], F.array(F.struct(s["at"].alias("start"), (s["at"] + F.length(p)).alias("end"))))).otherwise(s["runs"]).alias("runs"), (~s["own"]).alias("own"))
    return F.aggregate(pieces, zero, step)["runs"]


def as_hiragana(col: Column) -> Column:
    return F.translate(col, KATA, HIRA)


def as_katakana(col: Column) -> Column:
    return F.translate(col, HIRA, KATA)


def joined_marks(col: Column) -> Column:
    """Kana followed by a voicing mark become one character."""
    out = col
    for mark, table in (("゛", VOICED), ("゜", HALF_VOICED)):
        for plain, voiced in table.items():
            out = F.replace(out, F.lit(plain + mark), F.lit(voiced))
    return F.when(col.rlike("[゛゜]"), out).otherwise(col)


def full_width_kana(col: Column) -> Column:
    return joined_marks(F.translate(col, HALF_KANA, FULL_KANA))


def normalise(col: Column, *, punctuation: bool = True) -> Column:
    """Full-width letters, digits and signs become ASCII, half-width kana full, marks join their kana.

    With ``punctuation`` Japanese marks become ASCII ones with spaces.
    """
    out = full_width_kana(F.translate(col, WIDE, NARROW))
    for mark, plain in PUNCTUATION if punctuation else ():
        out = F.replace(out, F.lit(mark), F.lit(plain))
    return out


def mora_length(col: Column) -> Column:
    """Characters without small kana, doubling and long-vowel marks."""
    return F.length(F.translate(col, SMALL, ""))


def rendaku(col: Column, *, half: bool = False) -> Column:
    """The first kana voiced."""
    return F.concat(swap(F.left(col, F.lit(1)), HALF_VOICED if half else VOICED), F.substring(col, 2, 1 << 30))


def unrendaku(col: Column) -> Column:
    return F.concat(swap(F.left(col, F.lit(1)), PLAIN), F.substring(col, 2, 1 << 30))


def geminate(col: Column) -> Column:
    """The last kana doubled into the next; an empty string stays."""
    return F.when(F.length(col) > 0, F.concat(F.substring(col, F.lit(1), F.length(col) - 1), F.lit("っ"))).otherwise(col)


def kanji_prefix(col: Column) -> Column:
    return F.regexp_extract(col, f"(?s)^.*[{KANJI}]", 0)


def kanji_mask(col: Column) -> Column:
    return F.regexp_replace(col, f"[{KANJI}]+", "%")


def kanji_match(word: Column, reading: Column) -> Column:
    """The reading has the word's kana in order, with something for each run of kanji."""
    quoted = F.regexp_replace(kanji_mask(word), r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.rlike(reading, F.concat(F.lit("^"), F.replace(quoted, F.lit("%"), F.lit(".+")), F.lit("$")))


def kanji_cross_match(word: Column, reading: Column, other: Column) -> Column:
    """The reading of ``other``, which shares its head with ``word``; null without a shared head."""
    steps = F.sequence(F.lit(0), F.least(F.length(word), F.length(other)))
    shared = F.array_max(F.filter(steps, lambda n: F.substring(word, F.lit(1), n) == F.substring(other, F.lit(1), n)))
    cut = shared + F.length(reading) - F.length(word)
    return F.when((shared > 0) & cut.between(0, F.length(reading)), F.concat(F.substring(reading, F.lit(1), cut), F.substring(other, shared + 1, F.length(other))))


def sequential_kanji(col: Column, offset: int = 0) -> Column:
    """Places between two kanji."""
    places = F.sequence(F.lit(1), F.greatest(F.length(col) - 1, F.lit(1)))
    return F.transform(F.filter(places, lambda i: F.substring(col, i, F.lit(2)).rlike("^[々一-龯]{2}$")), lambda i: i + offset)


def sticky_positions(col: Column) -> Column:
    """Places where no word starts or ends: after a doubling before kana, before small kana and marks.

    At the end of the string a long vowel, or a small vowel after its own vowel, is no such place.
    """
    vowels = {"ぁ": "あかさたなはまやらわがざだばぱゃゎ", "ぃ": "いきしちにひみりぎじぢびぴゐ", "ぅ": "うくすつぬふむゆるぐずづぶぷゔゅ", "ぇ": "えけせてねへめれげぜでべぺゑ", "ぉ": "おこそとのほもよろをごぞどぼぽょ"}
    flat = as_hiragana(col)
    own = "|".join(f"[{before}{small}]{small}" for small, before in vowels.items())
    last = F.length(col) - 1

    def sticky(i: Column) -> Column:
        c, before = F.substring(flat, i + 1, F.lit(1)), F.substring(flat, i, F.lit(2))
        doubled = (i > 0) & before.rlike("^っ[あいうえおか-ぢつ-もやゆよら-ろわゐゑをんゔ]$")
        modifier = c.rlike("^[ぁぃぅぇぉゃゅょゎーゝゞヽヾ]$")
        free = (i == last) & ((c == "ー") | ((i > 0) & before.rlike(f"^({own})$")))
        return doubled | (modifier & ~free)

    return F.when(F.length(col) > 0, F.filter(F.sequence(F.lit(0), last), sticky)).otherwise(F.array().cast("array<int>"))


def destem(col: Column, stem: int, name: str = "kana") -> Column:
    """The string before its last ``stem`` characters of a class; empty where it has fewer."""
    c = CLASSES[name]
    return F.regexp_extract(col, f"(?s)^(.*)(?:[{c}][^{c}]*){{{stem}}}$", 1) if stem else col


def words(col: Column) -> Column:
    """Runs of Japanese letters, of Latin letters, and of digits."""
    return F.regexp_extract_all(col, F.lit(f"([{CLASSES['word']}]+|[{CLASSES['letter']}]+|[{CLASSES['digit']}]+)"))


def basic_split(col: Column) -> Column:
    """array<struct<type, text>>: stretches of Japanese words, with numbers before them, and what is between.

    The first stretch is misc if it has no word character; types alternate after it.
    """
    number = f"(?<![.,]|[{DIGIT}])[{DIGIT}]+"
    stretch = f"((?:{number}|[{WORD}])[0-9０-９{WORD}]*[{WORD}]|[{WORD}])"
    parts = F.filter(F.split(F.regexp_replace(col, stretch, f"{PART}$1{PART}"), PART), lambda p: p != "")
    first = F.get(parts, 0).rlike(f"^[^{WORD}]+$").cast("int")
    return F.transform(parts, lambda p, i: F.struct(F.when((i + first) % 2 == 1, "misc").otherwise("word").alias("type"), p.alias("text")))


def sentences(col: Column) -> Column:
    """Sentences with their end marks and closing signs; a blank rest is left out."""
    pieces = F.regexp_extract_all(col, F.lit("((?:[^。.！!？?\\n]*[。.！!？?\\n][\\s」』）】］\"')]*)|[^。.！!？?\\n]+)"))
    return F.filter(pieces, lambda s: s.rlike("[。.！!？?\\n]") | (F.trim(s) != ""))
