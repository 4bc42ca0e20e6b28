"""Row-level corrections of dictionary tables as patch joins.

``replaced``, ``deleted``, ``added`` and ``renumbered`` are the four moves; the named corrections
below are made of them.  Each takes whole tables and a table of patches, so many patches of one
kind are one join; an errata file is a list of batches that ``applied`` folds in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.functions.chars import CLASSES

Tables = dict[str, DataFrame]


def replaced(rows: DataFrame, patch: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``column`` takes the patch's ``new`` value where its keys match."""
    return rows.join(patch.select(*keys, F.col("new").alias("__new")), keys, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def deleted(rows: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(patch.select(*keys).distinct(), keys, "left_anti")


def added(rows: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Patch rows whose keys are new."""
    return rows.unionByName(patch.join(rows.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def renumbered(rows: DataFrame, group: list[str], order: list[str | Column], column: str = "ord") -> DataFrame:
    """``column`` counts 0, 1, ... inside each group."""
    return rows.withColumn(column, F.row_number().over(Window.partitionBy(*group).orderBy(*[F.expr(o) if isinstance(o, str) else o for o in order])) - 1)


def appended(rows: DataFrame, patch: DataFrame, group: list[str], *, start: int = 1, column: str = "ord") -> DataFrame:
    """Patch rows with ``column`` counted on from the group's largest; an empty group begins at 0."""
    last = rows.groupBy(*group).agg(F.max(column).alias("__last"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("__place"))
    numbered = patch.join(last, group, "left").withColumn(column, F.coalesce("__last", F.lit(-start)) + place - 1 + start).drop("__last", "__place")
    return rows.unionByName(numbered, allowMissingColumns=True)


def counted(tables: Tables) -> Tables:
    """``entry`` with its numbers of readings counted anew."""
    n = tables["readings"].groupBy("seq").agg(F.count_if(F.col("script") == "kanji").cast("int").alias("__kanji"), F.count_if(F.col("script") == "kana").cast("int").alias("__kana"))
    fresh = tables["entry"].join(n, "seq", "left").withColumn("n_kanji", F.coalesce("__kanji", F.lit(0))).withColumn("n_kana", F.coalesce("__kana", F.lit(0))).drop("__kanji", "__kana")
    return tables | {"entry": fresh.select(tables["entry"].columns)}


def add_readings(tables: Tables, patch: DataFrame) -> Tables:
    """New readings (seq, script, text, common) go behind the others of their script; those present stay as they are."""
    fresh = patch.dropDuplicates(["seq", "script", "text"]).join(tables["readings"].select("seq", "script", "text"), ["seq", "script", "text"], "left_anti")
    rows = appended(tables["readings"], fresh.withColumn("__place", F.col("text")), ["seq", "script"])
    return counted(tables | {"readings": rows.select(tables["readings"].columns)})


def delete_readings(tables: Tables, patch: DataFrame) -> Tables:
    """Readings (seq, text) go; the others are numbered anew."""
    columns = tables["readings"].columns
    kept = deleted(tables["readings"], patch, ["seq", "text"])
    return counted(tables | {"readings": renumbered(kept, ["seq", "script"], ["ord", "text"]).select(columns)})


def replace_readings(tables: Tables, patch: DataFrame) -> Tables:
    """Readings (seq, text) are spelled ``new``."""
    columns = tables["readings"].columns
    return tables | {"readings": replaced(tables["readings"], patch, ["seq", "text"], "text").select(columns)}


def set_common(tables: Tables, patch: DataFrame) -> Tables:
    """``common`` of readings (seq, text) becomes ``new``, null included."""
    columns = tables["readings"].columns
    hit = patch.select("seq", "text", F.col("new").alias("__new"), F.lit(True).alias("__hit"))
    rows = tables["readings"].join(hit, ["seq", "text"], "left").withColumn("common", F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("common")))
    return tables | {"readings": rows.select(columns)}


def set_primary_nokanji(tables: Tables, patch: DataFrame) -> Tables:
    """The flag of entries (seq) becomes ``new``; a patch row with a ``text`` also marks that kana reading."""
    entry = replaced(tables["entry"], patch.select("seq", "new").distinct(), ["seq"], "primary_nokanji").select(tables["entry"].columns)
    marked = patch.filter("text is not null").select("seq", "text", "new")
    readings = replaced(tables["readings"], marked, ["seq", "text"], "nokanji").select(tables["readings"].columns)
    return tables | {"entry": entry, "readings": readings}


def rearrange_readings(tables: Tables, patch: DataFrame) -> Tables:
    """Readings that start with ``prefix`` come first, in their order (seq, script, prefix)."""
    columns = tables["readings"].columns
    rows = tables["readings"].join(patch.select("seq", "script", F.col("prefix").alias("__prefix")), ["seq", "script"], "left")
    return tables | {"readings": renumbered(rows, ["seq", "script"], [~F.coalesce(F.col("text").startswith(F.col("__prefix")), F.lit(False)), "ord", "text"]).select(columns)}


def delete_sense_props(tables: Tables, patch: DataFrame) -> Tables:
    return tables | {"sense_props": deleted(tables["sense_props"], patch, ["seq", "tag", "text"]).select(tables["sense_props"].columns)}


def add_sense_props(tables: Tables, patch: DataFrame) -> Tables:
    """Properties (seq, sense_ord, tag, text) of senses that exist, where they lack them, as number 0."""
    known = tables["glosses"].select("seq", "sense_ord").distinct()
    fresh = patch.select("seq", "sense_ord", "tag", F.lit(0).alias("ord"), "text").distinct().join(known, ["seq", "sense_ord"], "left_semi")
    return tables | {"sense_props": added(tables["sense_props"], fresh, ["seq", "sense_ord", "tag", "text"]).select(tables["sense_props"].columns)}


def sense_keys(glosses: DataFrame, sense_props: DataFrame) -> DataFrame:
    """(seq, sense_ord, pos, texts): the sorted word classes and glosses by which senses are the same."""
    pos = sense_props.filter("tag = 'pos'").groupBy("seq", "sense_ord").agg(F.array_sort(F.collect_set("text")).alias("pos"))
    texts = glosses.groupBy("seq", "sense_ord").agg(F.array_sort(F.collect_set("text")).alias("texts"))
    return texts.join(pos, ["seq", "sense_ord"], "left").withColumn("pos", F.coalesce("pos", F.array().cast("array<string>")))


def existing_senses(tables: Tables, wanted: DataFrame) -> DataFrame:
    """(id) of the wanted senses (id, seq, pos array, texts array) that an entry has already."""
    keys = sense_keys(tables["glosses"], tables["sense_props"])
    sides = wanted.withColumn("pos", F.array_sort(F.array_distinct("pos"))).withColumn("texts", F.array_sort(F.array_distinct("texts")))
    return sides.join(keys, ["seq", "pos", "texts"], "left_semi").select("id")


def add_senses(tables: Tables, patch: DataFrame) -> Tables:
    """Senses (seq, sense_ord, texts array) at places that are free."""
    fresh = patch.join(tables["glosses"].select("seq", "sense_ord"), ["seq", "sense_ord"], "left_anti")
    rows = fresh.select("seq", "sense_ord", F.posexplode("texts").alias("ord", "text"))
    return tables | {"glosses": tables["glosses"].unionByName(rows.select(tables["glosses"].columns))}


def add_new_senses(tables: Tables, patch: DataFrame) -> Tables:
    """Senses (seq, pos array, texts array), one an entry, behind its last; word classes only where they differ from the last sense's."""
    keys = sense_keys(tables["glosses"], tables["sense_props"])
    same = patch.select("seq", F.array_sort(F.array_distinct("pos")).alias("pos"), F.array_sort(F.array_distinct("texts")).alias("texts")).join(keys, ["seq", "pos", "texts"], "left_semi").select("seq")
    last = tables["glosses"].groupBy("seq").agg(F.max("sense_ord").alias("__last"))
    tagged = tables["sense_props"].filter("tag = 'pos'").groupBy("seq", "sense_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda p: p["text"]).alias("__pos"))
    before = tagged.groupBy("seq").agg(F.max_by("__pos", "sense_ord").alias("__pos"))
    fresh = patch.join(same, "seq", "left_anti").join(last, "seq", "left").join(before, "seq", "left").withColumn("sense_ord", F.coalesce(F.col("__last") + 1, F.lit(0)))
    glosses = fresh.select("seq", "sense_ord", F.posexplode("texts").alias("ord", "text"))
    props = fresh.filter(~F.col("pos").eqNullSafe(F.col("__pos"))).select("seq", "sense_ord", F.lit("pos").alias("tag"), F.posexplode("pos").alias("ord", "text"))
    return tables | {"glosses": tables["glosses"].unionByName(glosses.select(tables["glosses"].columns)), "sense_props": tables["sense_props"].unionByName(props.select(tables["sense_props"].columns))}


def add_glosses(tables: Tables, patch: DataFrame) -> Tables:
    """Glosses (seq, sense_ord, place, text) behind those that the sense has."""
    known = tables["glosses"].select("seq", "sense_ord").distinct()
    fresh = patch.join(known, ["seq", "sense_ord"], "left_semi").withColumn("__place", F.col("place")).drop("place")
    return tables | {"glosses": appended(tables["glosses"], fresh, ["seq", "sense_ord"]).select(tables["glosses"].columns)}


def delete_senses(tables: Tables, patch: DataFrame) -> Tables:
    """Senses with a property (seq, tag, text) go, with their glosses and properties; their numbers stay open."""
    gone = tables["sense_props"].join(patch.select("seq", "tag", "text"), ["seq", "tag", "text"], "left_semi").select("seq", "sense_ord")
    return tables | {name: deleted(tables[name], gone, ["seq", "sense_ord"]).select(tables[name].columns) for name in ("glosses", "sense_props")}


def same_edge(a: DataFrame, b: DataFrame) -> Column:
    return (a["seq"] == b["seq"]) & (a["from"] == b["from"]) & a["via"].eqNullSafe(b["via"])


def delete_conjugations(tables: Tables, patch: DataFrame) -> Tables:
    """Edges (seq, from, via) go with their properties and sources; so does an entry that is no root and has no other edge."""
    edges, wanted = tables["conjugations"], patch.select("seq", "from", "via").alias("p")
    kept = edges.join(wanted, same_edge(edges, wanted), "left_anti")
    gone = edges.select("id", "seq").join(kept.select("id"), "id", "left_anti")
    orphans = gone.select("seq").distinct().join(kept.select("seq"), "seq", "left_anti").join(tables["entry"].filter("not root_p").select("seq"), "seq", "left_semi")
    ids = gone.select(F.col("id").alias("conj_id"))
    out = {"conjugations": kept.select(edges.columns)}
    out |= {n: deleted(tables[n], ids, ["conj_id"]).select(tables[n].columns) for n in ("conj_props", "conj_sources")}
    out |= {n: deleted(tables[n], orphans, ["seq"]).select(tables[n].columns) for n in ("entry", "readings")}
    return tables | out


def add_conjugated_readings(tables: Tables, patch: DataFrame) -> Tables:
    """A new spelling (seq, text, new) of an entry's reading goes through all its forms, as far as they share the stem.

    The stem is what the old and the new spelling don't share at their ends; a form takes the new
    stem where it begins with the old one.  As in the published behaviour, the forms' new readings
    carry the largest number of their script again.
    """
    size = F.least(F.length("text"), F.length("new"))
    tails = F.filter(F.sequence(F.lit(0), size), lambda n: F.right(F.col("text"), n) == F.right(F.col("new"), n))
    cut = F.array_max(tails)
    stems = patch.select(F.col("seq").alias("from"), F.col("text").alias("__text"), F.expr("text").alias("text"), "new")
    stems = stems.select("from", F.substring("text", F.lit(1), F.length("text") - cut).alias("__old"), F.substring("new", F.lit(1), F.length("new") - cut).alias("__new"))
    forms = tables["conjugations"].select("seq", "from").distinct().join(stems, "from").join(tables["readings"], "seq").filter(F.col("text").startswith(F.col("__old")))
    fresh = forms.withColumn("text", F.concat("__new", F.substring("text", F.length("__old") + 1, F.length("text")))).select(tables["readings"].columns).dropDuplicates(["seq", "script", "text"])
    last = tables["readings"].groupBy("seq", "script").agg(F.max("ord").alias("__last"))
    fresh = fresh.join(last, ["seq", "script"]).withColumn("ord", F.col("__last")).select(tables["readings"].columns)
    return counted(tables | {"readings": added(tables["readings"], fresh, ["seq", "script", "text"]).select(tables["readings"].columns)})


def replace_reading_prefixes(tables: Tables, patch: DataFrame) -> Tables:
    """Readings of an entry (seq, script, prefix, new) and of all that is conjugated from it begin with ``new`` instead."""
    own = patch.select("seq", "script", F.col("prefix").alias("__prefix"), F.col("new").alias("__new"))
    forms = tables["conjugations"].select(F.col("from").alias("__from"), "seq").distinct().join(own.withColumnRenamed("seq", "__from"), "__from").drop("__from")
    rules = own.unionByName(forms.select(own.columns)).distinct()
    rows = tables["readings"].join(rules, ["seq", "script"], "left")
    text = F.when(F.col("text").startswith(F.col("__prefix")), F.concat("__new", F.substring("text", F.length("__prefix") + 1, F.length("text")))).otherwise(F.col("text"))
    return tables | {"readings": rows.withColumn("text", text).select(tables["readings"].columns)}


def existing_conjugations(tables: Tables, wanted: DataFrame) -> DataFrame:
    """(id, conj_id) of wanted forms (id, from, conj_type, pos, neg, fml) that exist directly; null flags are equal to null alone."""
    held = tables["conjugations"].filter("via is null").select(F.col("id").alias("conj_id"), F.col("from").alias("__from")).join(tables["conj_props"].select("conj_id", *[F.col(c).alias(f"__{c}") for c in ("conj_type", "pos", "neg", "fml")]), "conj_id")
    same = (wanted["from"] == held["__from"]) & (wanted["conj_type"] == held["__conj_type"]) & (wanted["pos"] == held["__pos"]) & wanted["neg"].eqNullSafe(held["__neg"]) & wanted["fml"].eqNullSafe(held["__fml"])
    return wanted.join(held, same).select("id", "conj_id").distinct()


def add_conjugations(tables: Tables, wanted: DataFrame, base: int) -> Tables:
    """Forms (id, from, conj_type, pos, neg, fml, script, text, source_text) that don't exist yet become entries from seq ``base`` on.

    Rows of one id are one form with several readings; new seqs and edges are numbered by id.
    """
    fresh = wanted.join(existing_conjugations(tables, wanted).select("id"), "id", "left_anti")
    ids = fresh.select("id").distinct()
    first = int(tables["conjugations"].agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]) + 1
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id")) - 1
    numbered = fresh.join(ids.select("id", (place + base).cast("int").alias("seq"), (place + first).cast("long").alias("conj_id")), "id")
    head = numbered.dropDuplicates(["id"])
    readings = numbered.select("seq", "script", (F.row_number().over(Window.partitionBy("seq", "script").orderBy("text")) - 1).alias("ord"), "text", F.lit(None).cast("int").alias("common"), F.lit(False).alias("nokanji"))
    put = lambda name, rows: tables[name].unionByName(rows, allowMissingColumns=True).select(tables[name].columns)
    return counted(tables | {
        "entry": put("entry", head.select("seq", F.lit(False).alias("root_p"), F.lit(0).alias("n_kanji"), F.lit(0).alias("n_kana"), F.lit(False).alias("primary_nokanji"))),
        "readings": put("readings", readings),
        "conjugations": put("conjugations", head.select(F.col("conj_id").alias("id"), "seq", "from", F.lit(None).cast("int").alias("via"))),
        "conj_props": put("conj_props", head.select("conj_id", "conj_type", "pos", "neg", "fml")),
        "conj_sources": put("conj_sources", numbered.select("conj_id", "text", "source_text")),
    })


def contracted_copulas(tables: Tables) -> Tables:
    """Kana that begin with では also read じゃ, with their sources; an entry that has the reading already keeps it."""
    short = lambda c: F.concat(F.lit("じゃ"), F.substring(c, F.lit(3), F.length(c)))
    own = tables["readings"].filter(F.col("text").startswith("では") & (F.col("script") == "kana"))
    fresh = own.select("seq", "script", short("text").alias("text"), "common")
    edges = tables["conjugations"].select(F.col("id").alias("conj_id"), "seq").join(own.select("seq", "text"), "seq")
    sources = tables["conj_sources"].join(edges.select("conj_id", "text"), ["conj_id", "text"], "left_semi")
    long_ = F.col("source_text").startswith("では")
    sources = sources.select("conj_id", short("text").alias("text"), F.when(long_, short("source_text")).otherwise(F.col("source_text")).alias("source_text"))
    return add_readings(tables, fresh) | {"conj_sources": added(tables["conj_sources"], sources, ["conj_id", "text", "source_text"]).select(tables["conj_sources"].columns)}


def plain_hiragana(tables: Tables) -> Tables:
    """The flag that a kana goes with no kanji is taken from entries all of whose such kana are in hiragana, and from these kana."""
    flagged = tables["readings"].filter("script = 'kana' and nokanji").groupBy("seq").agg(F.bool_and(F.col("text").rlike(f"^[{CLASSES['hiragana']}]+$")).alias("plain")).filter("plain").select("seq")
    off = flagged.withColumn("__off", F.lit(True))
    flip = lambda rows, c: rows.join(off, "seq", "left").withColumn(c, F.when(F.col("__off"), F.lit(False)).otherwise(F.col(c))).select(rows.columns)
    return tables | {"entry": flip(tables["entry"], "primary_nokanji"), "readings": flip(tables["readings"], "nokanji")}


def copula_class(tables: Tables, seq: int, pos: str = "cop-da") -> Tables:
    """The first sense of ``seq`` gets the class by whose rules it conjugates."""
    spark = tables["glosses"].sparkSession
    return add_sense_props(tables, spark.createDataFrame([(seq, 0, "pos", pos)], "seq int, sense_ord int, tag string, text string"))


CORRECTIONS: dict[str, Callable[[Tables, DataFrame], Tables]] = {
    "add_readings": add_readings,
    "replace_readings": replace_readings,
    "delete_readings": delete_readings,
    "delete_sense_props": delete_sense_props,
    "add_sense_props": add_sense_props,
    "add_senses": add_senses,
    "add_new_senses": add_new_senses,
    "add_glosses": add_glosses,
    "set_common": set_common,
    "set_primary_nokanji": set_primary_nokanji,
    "delete_senses": delete_senses,
    "rearrange_readings": rearrange_readings,
    "delete_conjugations": delete_conjugations,
    "add_conjugated_readings": add_conjugated_readings,
    "replace_reading_prefixes": replace_reading_prefixes,
}


def applied(tables: Tables, batches: list[tuple[str, str, DataFrame]]) -> Tables:
    """Corrections in order: (batch name, correction, patch); batches are taken by name, so dated names go by date, and in the given order inside one."""
    for _, kind, patch in sorted(batches, key=lambda b: b[0]):
        if kind not in CORRECTIONS:
            raise ValueError(f"no such correction: {kind}")
        tables = CORRECTIONS[kind](tables, patch)
    return tables
