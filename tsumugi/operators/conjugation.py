"""Conjugated forms: words joined to a table of rules, no loop over either."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.functions.chars import CLASSES

RULES = "pos string, conj int, neg boolean, fml boolean, onum int, stem int, okuri string, euphr string, euphk string"
# Conjugation types that are added to every rule table, and those that conjugate again.
NAMES = {1: "Non-past", 2: "Past (~ta)", 3: "Conjunctive (~te)", 4: "Provisional (~eba)", 5: "Potential", 6: "Passive", 7: "Causative", 8: "Causative-Passive", 9: "Volitional", 10: "Imperative", 11: "Conditional (~tara)", 12: "Alternative (~tari)", 13: "Continuative (~i)", 50: "Adverbial", 51: "Adjective Stem", 52: "Negative Stem", 53: "Causative (~su)", 54: "Old/literary form"}
ADJECTIVE_FORMS = ((50, "く"), (51, ""), (54, "き"))
AGAIN_FROM, AGAIN_TO = (5, 6, 7, 8, 53), (2, 3, 4, 9, 10, 11, 12, 13)


def with_adjective_forms(rules: DataFrame) -> DataFrame:
    """Adds the adverbial, stem and literary form of both classes of i-adjectives."""
    rows = [(pos, conj, False, False, 1, 1, okuri, euphr, "") for pos, euphr in (("adj-i", ""), ("adj-ix", "よ")) for conj, okuri in ADJECTIVE_FORMS]
    return rules.unionByName(rules.sparkSession.createDataFrame(rows, RULES))


def form():
    """The word without its stem, with the rule's sound change and ending; a change takes one more character."""
    is_kana = F.right("text", F.lit(2)).rlike(f"^[{CLASSES['kana']}]+$")
    change = F.coalesce(F.when(is_kana, F.col("euphr")).otherwise(F.col("euphk")), F.lit(""))
    keep = F.length("text") - F.col("stem") - (change != "").cast("int")
    return F.concat(F.substring(F.col("text"), F.lit(1), F.greatest(keep, F.lit(0))), change, F.coalesce("okuri", F.lit("")))


def conjugated(words: DataFrame, rules: DataFrame) -> DataFrame:
    """(seq, pos, conj, neg, fml, onum, source, text) of all forms of ``words`` (seq, text, pos).

    ``neg`` is null where the word's conjugation has no negative form at all, ``fml`` likewise.
    Forms equal to one of the word's own readings are left out, and so is the negative stem of
    v5r-i.  Rows with a null text or word class have no forms; repeated rows count once.
    """
    words = words.select("seq", "text", "pos").distinct()
    made = words.join(rules.select(*[c.split()[0] for c in RULES.split(", ")]), "pos").filter("text is not null").select("seq", "pos", "conj", "neg", "fml", "onum", F.col("text").alias("source"), form().alias("text"))
    cell = Window.partitionBy("seq", "pos", "conj")
    flags = {c: F.when(F.max(c).over(cell), F.col(c)) for c in ("neg", "fml")}
    own = words.select("seq", "text").distinct()
    return made.withColumns(flags).filter("not (conj = 52 and pos = 'v5r-i')").join(own, ["seq", "text"], "left_anti").select("seq", "pos", "conj", "neg", "fml", "onum", "source", "text").distinct()


def conjugated_again(forms: DataFrame, rules: DataFrame) -> DataFrame:
    """(seq, via, conj, neg, fml, onum, source, text): affirmative plain forms of verbs that are verbs again.

    Potential, passive and causative forms go on as v1, the short causative as v5s; ``via`` is the
    conjugation between.
    """
    bases = forms.filter(F.col("conj").isin(*AGAIN_FROM) & ~F.coalesce("neg", F.lit(False)) & ~F.coalesce("fml", F.lit(False)))
    words = bases.select(F.struct("seq", "conj").alias("seq"), "text", F.when(F.col("conj") == 53, "v5s").otherwise("v1").alias("pos"))
    made = conjugated(words, rules.filter(F.col("conj").isin(*AGAIN_TO)))
    return made.select(F.col("seq.seq").alias("seq"), F.col("seq.conj").alias("via"), "conj", "neg", "fml", "onum", "source", "text")


def described(forms: DataFrame) -> DataFrame:
    """Adds ``description``: [pos] type, polarity and politeness."""
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    polarity = F.when(F.col("neg"), "Negative").when(~F.col("neg"), "Affirmative")
    style = F.when(F.col("fml"), "Formal").when(~F.col("fml"), "Plain")
    return forms.withColumn("description", F.concat_ws(" ", F.concat(F.lit("["), "pos", F.lit("]")), F.element_at(names, F.col("conj")), polarity, style))
