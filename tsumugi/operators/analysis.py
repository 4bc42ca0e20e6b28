"""From texts to words, romaji, tokens and pattern hits: the operators in a row.

A text is cut into word stretches and what is between; each stretch is a row that is segmented
on its own, so documents of any length are dealt out by stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.functions import chars, kana
from tsumugi.operators import counters, lattice, lookup, patterns, presentation, scoring, tokens

Tables = dict[str, DataFrame]
LONGEST = 50


def stretches(texts: DataFrame, *, key: str = "sent_id", text: str = "text", punctuation: bool = True) -> DataFrame:
    """(key, chunk, type, text) of the normalised text: words, and what is between them."""
    split = chars.basic_split(chars.normalise(F.col(text), punctuation=punctuation))
    return texts.select(key, F.posexplode(split).alias("chunk", "x")).select(key, "chunk", "x.type", "x.text")


def features(tables: Tables, particles: dict[str, tuple[int, ...]] | None = None) -> DataFrame:
    """A row for each reading with what ``scoring.with_score`` reads; ``particles``: seqs by semi_final, non_final, copula, only_final and skip."""
    named = scoring.PARTICLES if particles is None else particles
    pos = lookup.current_pos(tables["sense_props"])
    old = lookup.archaic(tables["glosses"], tables["sense_props"], tables["conjugations"]).withColumn("archaic", F.lit(True))
    uk = tables["sense_props"].filter("tag = 'misc' and text = 'uk'").groupBy("seq").agg(F.lit(True).alias("prefer_kana"), (F.min("sense_ord") == 0).alias("uk_first"))
    conj = tables["conjugations"].join(tables["conj_props"].withColumnRenamed("conj_id", "id"), "id")
    forms = conj.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("from", "via", "conj_type", "pos", "neg", "fml"))).alias("conj"))
    # what a form takes over from its sources
    source = tables["conj_sources"].withColumnRenamed("conj_id", "id").join(tables["conjugations"], "id").select("seq", "text", F.col("from").alias("__f"), "source_text")
    of = source.join(tables["readings"].select(F.col("seq").alias("__f"), F.col("text").alias("source_text"), F.col("common").alias("__c"), F.col("ord").alias("__o")), ["__f", "source_text"])
    inherited = of.groupBy("seq", "text").agg(F.min("__c").alias("source_common"), F.min("__o").alias("source_ord"))
    own_pos = conj.select("seq", F.col("from").alias("__f")).distinct().join(pos.select(F.col("seq").alias("__f"), F.col("pos").alias("__p")), "__f").groupBy("seq").agg(F.array_distinct(F.flatten(F.collect_list("__p"))).alias("from_pos"))
    rows = tables["readings"].join(tables["entry"].select("seq", F.col("root_p").alias("root"), "n_kanji", "primary_nokanji"), "seq", "left")
    for more, on in ((pos, "seq"), (old, "seq"), (uk, "seq"), (forms, "seq"), (own_pos, "seq"), (inherited, ["seq", "text"])):
        rows = rows.join(more, on, "left")
    rows = rows.withColumn("pos", F.array_distinct(F.concat(F.coalesce("pos", F.array().cast("array<string>")), F.coalesce("from_pos", F.array().cast("array<string>")))))
    flags = {name: F.col("seq").isin(*seqs) if (seqs := named.get(name)) else F.lit(False) for name in ("semi_final", "non_final", "copula", "only_final", "skip")}
    return rows.withColumns(flags).drop("from_pos")


def candidates(texts: DataFrame, words: DataFrame, counted: DataFrame | None = None, *, key: str = "sent_id", text: str = "text") -> DataFrame:
    """(key, start, end, text, seq, score, ...) of every word in the texts: dictionary words, words in katakana, and counters.

    ``words``: the rows of ``features``.  No word starts or ends at a sticky place, and every span
    keeps the candidates that score half of its best.
    """
    parts = lattice.substrings(texts.withColumn("__s", chars.sticky_positions(F.col(text))), LONGEST, key=key, text=text)
    sticky = texts.select(key, chars.sticky_positions(F.col(text)).alias("__s"), F.length(text).alias("__n"))
    parts = parts.join(sticky, key).filter(~F.array_contains("__s", F.col("start")) & ~F.array_contains("__s", F.col("end")))
    spans = parts.withColumn("final", F.col("end") == F.col("__n")).select(key, "start", "end", "part", "final")
    # the lexicon is the large side where texts are few, and the other way round: the planner chooses
    hits = spans.join(words.withColumnRenamed("text", "part"), "part").withColumnRenamed("part", "text").withColumn("counter", F.lit(False)).withColumn("number", F.lit(None).cast("string"))
    kata = spans.filter(F.col("part").rlike(f"^[{chars.CLASSES['katakana']}]+$")).withColumn("__h", chars.as_hiragana(F.col("part")))
    roots = words.filter("script = 'kana' and root").withColumnRenamed("text", "__h")
    proxies = kata.join(roots, "__h").filter("__h <> part").drop("__h").withColumnRenamed("part", "text").withColumn("counter", F.lit(False)).withColumn("number", F.lit(None).cast("string"))
    both = hits.unionByName(proxies.join(hits.select(key, "start", "end", "seq"), [key, "start", "end", "seq"], "left_anti").select(hits.columns))
    if counted is not None:
        said = counters.counter_hits(texts, counted, key=key, text=text)
        spelled = said.select(key, "start", "end", F.concat("number", F.col("counter")).alias("text"), "seq", F.lit("kana").alias("script"), F.lit(True).alias("counter"), "number", F.array(F.lit("ctr")).alias("pos"), F.lit(0).alias("ord"), F.lit(True).alias("root"))
        both = both.unionByName(spelled, allowMissingColumns=True)
    scored = scoring.with_score(both)
    return scoring.culled(scored, [key, "start", "end"])


def tagged(hits: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``tags``, the names of the filters that hold for a hit, for rules between neighbours."""
    return hits.withColumn("tags", F.array_compact(F.array(*[F.when(test, name) for name, test in rules.items()])) if rules else F.array().cast("array<string>"))


def segmented(texts: DataFrame, words: DataFrame, counted: DataFrame | None = None, *, key: str = "sent_id", text: str = "text", k: int = 5, rules: list[dict] | None = None, filters: dict[str, Column] | None = None) -> DataFrame:
    """(key, rank, i, start, end, text, seq, type): the tokens of the ``k`` best paths."""
    hits = tagged(candidates(texts, words, counted, key=key, text=text), filters or {}).select(key, "start", "end", F.coalesce("seq", F.lit(0)).alias("seq"), "score", "tags")
    paths = lattice.best_paths(hits, texts.select(key, F.length(text).alias("n")), key=key, k=k, rules=rules)
    return presentation.path_tokens(paths, texts, key=key, text=text)


def with_kana(found: DataFrame, tables: Tables) -> DataFrame:
    """Adds ``kana``: of a kana token itself, of a kanji token the best kana of its entry's spelling."""
    best = lookup.best_readings(tables["readings"], tables["restricted"]).filter("script = 'kanji'").select("seq", "text", F.col("best").alias("__k"))
    return found.join(best, ["seq", "text"], "left").withColumn("kana", F.when(F.col("type") == "kana", F.array("text")).when(F.col("__k").isNotNull(), F.array("__k")).otherwise(F.array().cast("array<string>"))).drop("__k")


def romanised(texts: DataFrame, tables: Tables, *, key: str = "sent_id", text: str = "text", method: str = "traditional", particles: dict | None = None) -> DataFrame:
    """(key, romaji) of whole texts: each word stretch's best path in romaji, what is between stays."""
    chunks = stretches(texts, key=key, text=text).withColumn("__id", F.struct(key, "chunk"))
    words = chunks.filter("type = 'word'").select("__id", F.col("text").alias("part"))
    best = segmented(words, features(tables, particles), key="__id", text="part", k=1)
    said = presentation.romanised(presentation.nan_or_nani(with_kana(best, tables), "__id", "i"), kana.romaniser(method), key="__id", order="i")
    rows = chunks.join(said, "__id", "left").select(key, "chunk", F.coalesce("romaji", "text").alias("r"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "r"))), lambda x: x["r"])
    joined = F.aggregate(parts, F.lit(""), lambda out, w: F.concat(out, F.when((out == "") | out.rlike(r"\s$") | ~w.rlike("^[a-zA-Z0-9]"), "").otherwise(" "), w))
    return rows.groupBy(key).agg(F.trim(joined).alias("romaji"))


def sentences(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sent_no, text, before): a document's sentences, each with the one before it."""
    rows = documents.select(key, F.posexplode(chars.sentences(F.col(text))).alias("sent_no", "text"))
    return rows.withColumn("before", F.lag("text").over(Window.partitionBy(key).orderBy("sent_no")))


def matched(rows: DataFrame, rules: list[dict], *, key: str = "sent_id", order: str = "i", most: int | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """Pattern hits of token rows, the highest priority first; ``most`` keeps that many of each sentence, as the caller asked."""
    ranked = patterns.find_patterns(rows, sorted(rules, key=lambda r: -(r.get("priority") or 0)), key=key, order=order, lexicon=lexicon)
    place = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("priority"), "pattern", "start", "end")))
    return place if most is None else place.filter(F.col("rank") <= most)


def best_reading(hits: DataFrame, alternatives: DataFrame, *, key: str = "sent_id") -> DataFrame:
    """(key, alternative, hits, priority, score): of a sentence's readings the one with the most hits, then the largest sum of priorities, then the best score, then the first.

    ``hits``: key, alternative, priority; ``alternatives``: key, alternative, score.
    """
    counts = hits.groupBy(key, "alternative").agg(F.count(F.lit(1)).alias("hits"), F.sum(F.coalesce("priority", F.lit(0))).alias("priority"))
    rows = alternatives.select(key, "alternative", "score").join(counts, [key, "alternative"], "left").fillna(0, ["hits", "priority"])
    return lookup.first_by_order(rows, [key], [F.desc("hits"), F.desc("priority"), F.desc("score"), "alternative"])


def analysed(documents: DataFrame, tables: Tables, rules: list[dict], *, key: str = "doc_id", text: str = "text", particles: dict | None = None) -> DataFrame:
    """(key, sent_no, pattern, level, start, end, captures): pattern hits in whole documents, over the best path of each sentence."""
    rows = sentences(documents, key=key, text=text).select(F.struct(key, "sent_no").alias("sent_id"), "text")
    best = with_kana(segmented(rows, features(tables, particles), k=1), tables)
    glossed = presentation.senses_json(presentation.senses(tables["glosses"], tables["sense_props"]))
    data = lookup.conjugation_data(tables["readings"].select("seq", "text"), tables["conjugations"], tables["conj_props"], tables["conj_sources"])
    forms = presentation.conjugation_json(data, presentation.entry_readings(tables["readings"]), glossed)
    rooted = best.join(tables["entry"].select("seq", F.col("root_p").alias("root")), "seq", "left").withColumns({"score": F.lit(1), "counter": F.lit(None).cast("string")})
    shown = presentation.token_json(rooted.filter("seq is not null"), glossed, forms)
    gaps = rooted.filter("seq is null").withColumn("json", F.lit(None).cast("string"))
    every = tokens.token_rows(shown.unionByName(gaps.select(shown.columns)).select("sent_id", "i", "json", "text", "type"), key="sent_id", order="i")
    found = patterns.find_patterns(every, rules, key="sent_id", order="i")
    return found.select(F.col(f"sent_id.{key}").alias(key), F.col("sent_id.sent_no").alias("sent_no"), "pattern", "level", "start", "end", "captures")
