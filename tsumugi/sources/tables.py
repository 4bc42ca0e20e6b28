"""The tables of a dictionary in a folder of Parquet files, and what fills them.

A ``Tables`` is a dict of DataFrames by name.  ``create`` makes them empty, ``save`` and ``load``
write and read a folder, and the drivers at the end read one source after the other.
"""

from __future__ import annotations

import gzip
import os
import shutil
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsumugi.operators import conjugation, patches
from tsumugi.sources import dictionary

Tables = dict[str, DataFrame]

SCHEMAS = {
    "entry": "seq int, root_p boolean, n_kanji int, n_kana int, primary_nokanji boolean",
    "readings": "seq int, script string, ord int, text string, common int, nokanji boolean",
    "glosses": "seq int, sense_ord int, ord int, text string",
    "sense_props": "seq int, sense_ord int, tag string, ord int, text string",
    "restricted": "seq int, reading string, text string",
    "conjugations": "id long, seq int, from int, via int",
    "conj_props": "conj_id long, conj_type int, pos string, neg boolean, fml boolean",
    "conj_sources": "conj_id long, text string, source_text string",
    "kanji": "kanji string, radical_c int, radical_n int, grade int, strokes int, freq int",
    "kanji_readings": "kanji string, ord int, type string, text string, okuri string, prefix boolean, suffix boolean",
    "kanji_meanings": "kanji string, ord int, text string",
}
#: Where seqs of entries begin that no source numbers.
FIRST_SEQ = 10_000_000
#: Sources that a dictionary is downloaded from, by file name (public addresses; the caller may name others).
ADDRESSES = {"JMdict_e.gz": "http://ftp.edrdg.org/pub/Nihongo/JMdict_e.gz", "kanjidic2.xml.gz": "http://www.edrdg.org/kanjidic/kanjidic2.xml.gz"}


def create(spark: SparkSession) -> Tables:
    """All tables, empty."""
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def columns(name: str) -> list[str]:
    return [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]


def save(tables: Tables, folder: str) -> None:
    """Write every table under ``folder``, replacing what is there.  A table must not be read from the folder it is written to."""
    for name, rows in tables.items():
        rows.select(*columns(name)).write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> Tables:
    """The tables of a folder; those that it lacks are empty."""
    jvm = spark.sparkContext._jvm
    out = {}
    for name, schema in SCHEMAS.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        out[name] = spark.read.schema(schema).parquet(f"{folder}/{name}") if there else spark.createDataFrame([], schema)
    return out


def drop(spark: SparkSession, folder: str) -> None:
    """Remove the tables of a folder; other files in it stay."""
    jvm = spark.sparkContext._jvm
    for name in SCHEMAS:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table_over(spark: SparkSession, url: str, name: str, *, key: str, low: int, high: int, parts: int = 16, options: dict[str, str] | None = None) -> DataFrame:
    """A table of a relational database over JDBC, read in ``parts`` ranges of ``key``; its driver must be on the class path."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options or {})


def next_seq(tables: Tables) -> DataFrame:
    """(seq): one more than the largest; ``FIRST_SEQ`` where no entry is beyond it."""
    return tables["entry"].agg(F.greatest(F.coalesce(F.max("seq") + 1, F.lit(0)), F.lit(FIRST_SEQ)).alias("seq"))


def with_seqs(rows: DataFrame, order: list[str], first: int) -> DataFrame:
    """Adds ``seq`` from ``first`` on, by ``order``: the same rows get the same numbers each time.

    Numbers are counted inside ranges of the first column and shifted by the rows before, so no
    task takes all rows.
    """
    ranged = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    inside = ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__size")
    return inside.join(F.broadcast(before), "__part").withColumn("seq", (F.col("__n") + F.col("__before") - 1 + first).cast("int")).drop("__part", "__n", "__before")


def from_entries(found: DataFrame) -> Tables:
    """The tables of parsed entries (see ``dictionary.entries``); entries without a number get one by their first reading."""
    spark = found.sparkSession
    named = found.filter("seq is not null")
    first = F.coalesce(F.get("k_ele", 0)["keb"], F.get("r_ele", 0)["reb"])
    loose = with_seqs(found.filter("seq is null").drop("seq").withColumn("__first", first), ["__first"], FIRST_SEQ).drop("__first")
    every = named.unionByName(loose.select(named.columns))
    both = [dictionary.readings(every, s).withColumn("script", F.lit(s)) for s in ("kanji", "kana")]
    counts = dictionary.entry_counts(every)
    own = {
        "entry": counts.withColumn("root_p", F.lit(True)),
        "readings": both[0].unionByName(both[1]),
        "glosses": dictionary.glosses(every),
        "sense_props": dictionary.sense_props(every),
        "restricted": dictionary.restrictions(every),
    }
    return create(spark) | {name: rows.select(*[F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in SCHEMAS[name].split(", ")]) for name, rows in own.items()}


def merged(tables: Tables, more: Tables, *, overwrite: bool = False) -> Tables:
    """``tables`` with the entries of ``more``; of a seq in both, ``overwrite`` says which entry stays, with all its rows."""
    first, second = (more, tables) if overwrite else (tables, more)
    seqs = first["entry"].select("seq")
    out = dict(tables)
    for name in ("entry", "readings", "glosses", "sense_props", "restricted"):
        out[name] = first[name].unionByName(second[name].join(seqs, "seq", "left_anti").select(first[name].columns))
    return out


def load_entries(spark: SparkSession, path: str, tables: Tables | None = None, *, most: int | None = None, most_broken: int = 100, overwrite: bool = False) -> Tables:
    """The entries of a dictionary file added to ``tables``; more than ``most_broken`` unreadable ones are an error.

    ``most`` reads that many entries by number, for a try.
    """
    bad = dictionary.broken(spark, path).limit(most_broken + 1).count()
    if bad > most_broken:
        raise ValueError(f"more than {most_broken} entries of {path} can't be read")
    found = dictionary.entries(spark, path)
    own = from_entries(found.orderBy("seq").limit(most) if most else found)
    return merged(tables, own, overwrite=overwrite) if tables else own


def load_kanji(spark: SparkSession, path: str, tables: Tables) -> Tables:
    found = dictionary.kanji(spark, path)
    return tables | {"kanji": found.select(*columns("kanji")), "kanji_readings": dictionary.kanji_readings(found).select(*columns("kanji_readings")), "kanji_meanings": dictionary.kanji_meanings(found).select(*columns("kanji_meanings"))}


def places(rows: DataFrame, about: str) -> DataFrame:
    """Place rows (text, reading, and a name or city) as entries without a number, ready for ``from_entries``."""
    gloss = F.col("full_name") if "full_name" in rows.columns else F.concat(F.col("text"), F.lit(", ward of "), F.col("city"))
    no = F.array().cast("array<string>")
    sense = F.struct(F.array(F.lit("n")).alias("pos"), F.array(F.lit(about)).alias("misc"), *[no.alias(t) for t in dictionary.SENSE_TAGS[2:]], F.array(gloss).alias("gloss"))
    return rows.select(F.lit(None).cast("int").alias("seq"), F.array(F.struct(F.col("text").alias("keb"), no.alias("ke_pri"))).alias("k_ele"), F.array(F.struct(F.col("reading").alias("reb"), F.lit(None).cast("string").alias("re_nokanji"), no.alias("re_restr"), no.alias("re_inf"), no.alias("re_pri"))).alias("r_ele"), F.array(sense).alias("sense")).distinct()


def entry_xml(rows: DataFrame) -> DataFrame:
    """(xml) of place rows (text, reading, full_name), as an entry of the dictionary's format."""
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return rows.select(F.concat(F.lit("<entry><ent_seq>0</ent_seq><k_ele><keb>"), safe("text"), F.lit("</keb></k_ele><r_ele><reb>"), safe("reading"), F.lit("</reb></r_ele><sense><pos>n</pos><gloss>"), safe("full_name"), F.lit("</gloss></sense></entry>")).alias("xml"))


#: Readers of sources of one's own by kind: (spark, path) to entries without numbers.
SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "extra": lambda spark, path: dictionary.entries(spark, path),
    "municipality": lambda spark, path: places(dictionary.municipalities(spark, path), "place"),
    "ward": lambda spark, path: places(dictionary.wards(spark, path), "place"),
}


def load_custom(spark: SparkSession, tables: Tables, paths: dict[str, str]) -> Tables:
    """The sources named by kind, one after the other; words whose spelling and reading an entry has already are left out."""
    for kind, path in paths.items():
        if kind not in SOURCES:
            raise ValueError(f"no such source: {kind}")
        found = SOURCES[kind](spark, path)
        if kind != "extra":
            known = tables["readings"].filter("script = 'kanji'").select("seq", F.col("text").alias("__k")).join(tables["readings"].filter("script = 'kana'").select("seq", F.col("text").alias("__r")), "seq")
            found = found.withColumn("__k", F.get("k_ele", 0)["keb"]).withColumn("__r", F.get("r_ele", 0)["reb"]).join(known.select("__k", "__r"), ["__k", "__r"], "left_anti").drop("__k", "__r")
        own = from_entries(found)
        taken = tables["entry"].agg(F.max("seq")).first()[0] or 0
        shift = max(0, taken + 1 - FIRST_SEQ)
        if shift:  # numbers that were given here follow those of sources before
            move = F.when(F.col("seq") >= FIRST_SEQ, F.col("seq") + shift).otherwise(F.col("seq"))
            own = own | {n: own[n].withColumn("seq", move) for n in ("entry", "readings", "glosses", "sense_props", "restricted")}
        tables = merged(tables, own)
    return tables


def store_conjugations(tables: Tables, forms: DataFrame, *, first: int | None = None) -> Tables:
    """Conjugated forms (from, via, conj_type, pos, neg, fml, script, ord, text, source_text) as entries, edges, properties and sources.

    Forms of one (from, via, conj_type, pos, neg, fml) are one entry.  An entry that has all of a
    form's readings serves for it, the least seq first, but never the form's own source; the others
    get new numbers by their key.  Repeated forms and edges that exist are left out.
    """
    key = ["from", "via", "conj_type", "pos", "neg", "fml"]
    rows = forms.dropDuplicates([*key, "script", "text", "source_text"]).withColumn("k", F.struct(*key))
    shapes = rows.groupBy("k").agg(F.array_sort(F.collect_set(F.struct("script", "text"))).alias("shape")).persist()
    wanted = shapes.select("shape", F.explode("shape").alias("x")).select("shape", "x.script", "x.text").distinct()
    have = wanted.join(tables["readings"].select("seq", "script", "text").distinct(), ["script", "text"]).groupBy("shape", "seq").agg(F.count(F.lit(1)).alias("n")).filter("n = size(shape)").select("shape", "seq")
    usable = shapes.join(have, "shape").filter("seq <> k.from and not (seq <=> k.via)").groupBy("k").agg(F.min("seq").alias("seq"))
    old = shapes.join(usable, "k", "left").persist()
    base = first if first is not None else next_seq(tables).first()[0]
    # forms that are spelled alike become one new entry
    fresh = with_seqs(old.filter("seq is null").select("shape").distinct(), ["shape"], base)
    placed = old.filter("seq is not null").select("k", "seq", F.lit(False).alias("new")).unionByName(old.filter("seq is null").drop("seq").join(fresh, "shape").select("k", "seq", F.lit(True).alias("new")))
    full = rows.join(placed, "k").persist()  # read for each table; the session lets go of it with the tables
    heads = full.select("seq", *key).distinct()
    have_edge = tables["conjugations"].select("seq", "from", "via", "id")
    edges = heads.select("seq", "from", "via").distinct()
    same = (edges["seq"] == have_edge["seq"]) & (edges["from"] == have_edge["from"]) & edges["via"].eqNullSafe(have_edge["via"])
    lacking = edges.join(have_edge, same, "left_anti")
    top = int(tables["conjugations"].agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]) + 1
    added = with_seqs(lacking.withColumnRenamed("seq", "form"), ["form", "from", "via"], top).select(F.col("seq").cast("long").alias("id"), F.col("form").alias("seq"), "from", "via")
    edge_rows = tables["conjugations"].unionByName(added)
    ids = edge_rows.select(F.col("id").alias("conj_id"), F.col("seq").alias("__s"), F.col("from").alias("__f"), F.col("via").alias("__v"))
    tied = lambda r: r.join(ids, (r["seq"] == ids["__s"]) & (r["from"] == ids["__f"]) & r["via"].eqNullSafe(ids["__v"]))
    props = tied(heads).select("conj_id", "conj_type", "pos", "neg", "fml").distinct()
    sources = tied(full).select("conj_id", "text", "source_text").distinct()
    newborn = full.filter("new").groupBy("seq", "script", "text").agg(F.min("ord").alias("__o"))
    readings = newborn.select("seq", "script", (F.row_number().over(Window.partitionBy("seq", "script").orderBy("__o", "text")) - 1).alias("ord"), "text", F.lit(None).cast("int").alias("common"), F.lit(False).alias("nokanji"))
    entry = newborn.select("seq").distinct().select("seq", F.lit(False).alias("root_p"), F.lit(0).alias("n_kanji"), F.lit(0).alias("n_kana"), F.lit(False).alias("primary_nokanji"))
    out = tables | {
        "entry": tables["entry"].unionByName(entry),
        "readings": tables["readings"].unionByName(readings),
        "conjugations": edge_rows,
        "conj_props": tables["conj_props"].unionByName(props).distinct(),
        "conj_sources": tables["conj_sources"].unionByName(sources).distinct(),
    }
    return patches.counted(out)


def conjugate(tables: Tables, rules: DataFrame, *, again: bool = False) -> Tables:
    """Every conjugated form of the root entries, or with ``again`` of the forms that conjugate once more."""
    spell = tables["readings"].select("seq", "text", "script", "ord")
    if not again:
        pos = tables["sense_props"].filter("tag = 'pos'").select("seq", F.col("text").alias("pos")).distinct()
        words = spell.join(pos, "seq").join(tables["entry"].filter("root_p").select("seq"), "seq", "left_semi")
        made = conjugation.conjugated(words.select("seq", "text", "pos"), rules)
        rows = made.join(spell.select("seq", F.col("text").alias("source"), "script", "ord"), ["seq", "source"])
        return store_conjugations(tables, rows.select(F.col("seq").alias("from"), F.lit(None).cast("int").alias("via"), F.col("conj").alias("conj_type"), "pos", "neg", "fml", "script", "ord", "text", F.col("source").alias("source_text")))
    plain = tables["conj_props"].filter(F.col("conj_type").isin(*conjugation.AGAIN_FROM) & ~F.coalesce("neg", F.lit(False)) & ~F.coalesce("fml", F.lit(False)))
    bases = tables["conjugations"].filter("via is null").join(plain.select(F.col("conj_id").alias("id"), "conj_type"), "id").groupBy("from", "seq").agg(F.min("conj_type").alias("t"))
    words = bases.join(spell, "seq").select(F.struct("from", "seq").alias("seq"), "text", F.when(F.col("t") == 53, "v5s").otherwise("v1").alias("pos"), "script", "ord")
    made = conjugation.conjugated(words.select("seq", "text", "pos"), rules.filter(F.col("conj").isin(*conjugation.AGAIN_TO)))
    rows = made.join(words.select("seq", F.col("text").alias("source"), "script", "ord"), ["seq", "source"])
    return store_conjugations(tables, rows.select(F.col("seq.from").alias("from"), F.col("seq.seq").alias("via"), F.col("conj").alias("conj_type"), "pos", "neg", "fml", "script", "ord", "text", F.col("source").alias("source_text")))


_RULES: dict[tuple, DataFrame] = {}


def rules_of(spark: SparkSession, path: str) -> DataFrame:
    """The rule table of a file with the adjective forms added, read once a session."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _RULES:
        _RULES[key] = conjugation.with_adjective_forms(dictionary.tab_table(spark, path, conjugation.RULES)).cache()
    return _RULES[key]


def forget_rules() -> None:
    """Let go of the rule tables that are kept."""
    while _RULES:
        _RULES.popitem()[1].unpersist()


def build(spark: SparkSession, entries: str, rules: str, folder: str, *, custom: dict[str, str] | None = None, errata: Callable[[Tables], Tables] | None = None) -> Tables:
    """All steps in order, each written under ``folder`` before the next reads it: entries, conjugations, again, sources of one's own, corrections."""
    steps: list[tuple[str, Callable[[Tables], Tables]]] = [
        ("entries", lambda t: load_entries(spark, entries, t)),
        ("conjugated", lambda t: conjugate(t, rules_of(spark, rules))),
        ("again", lambda t: conjugate(t, rules_of(spark, rules), again=True)),
        ("custom", lambda t: load_custom(spark, t, custom or {})),
        ("errata", lambda t: errata(t) if errata else t),
    ]
    tables = create(spark)
    for name, step in steps:
        save(patches.counted(step(tables)), f"{folder}/{name}")
        tables = load(spark, f"{folder}/{name}")
    return tables


def fetch(folder: str, name: str, *, address: str | None = None, force: bool = False) -> str:
    """The path of a source file, downloaded into ``folder`` where it isn't there or ``force`` asks for it."""
    path = os.path.join(folder, name)
    if force or not os.path.exists(path):
        os.makedirs(folder, exist_ok=True)
        with urllib.request.urlopen(address or ADDRESSES[name], timeout=60) as answer, open(path + ".part", "wb") as out:
            shutil.copyfileobj(answer, out)
        os.replace(path + ".part", path)
    return path


def unpacked(path: str) -> str:
    """The text of a file, gzipped or not; for small sources."""
    with (gzip.open if path.endswith(".gz") else open)(path, "rt", encoding="utf-8") as f:
        return f.read()


def pos_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, pos) of the word-class table; the copula's old name stands for its new one too."""
    rows = dictionary.tab_table(spark, path, "id int, kw string, descr string, ents string").select("id", F.col("kw").alias("pos"))
    return rows.unionByName(rows.filter("pos = 'cop-da'").select("id", F.lit("cop").alias("pos"))).distinct()
