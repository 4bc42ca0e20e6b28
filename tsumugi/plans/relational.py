"""Relational operators on the driver tables: one text for Spark, and for DuckDB where it differs.

``{table}`` stands for a table; numbers are cast where the engines' result types differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tsumugi.operators import lookup

SHARED = {
    # joins
    "text_seq_lookup": "SELECT o_orderkey, o_orderstatus, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'",
    "lexicon_rootonly": "SELECT p_partkey, p_name, count(l_orderkey) AS uses FROM {part} JOIN {lineitem} ON p_partkey = l_partkey WHERE p_size < 10 GROUP BY p_partkey, p_name",
    "no_conj_anti": "SELECT c_custkey, c_name FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "non_arch_anti": "SELECT d.lang, count(*) AS n FROM {documents} d LEFT ANTI JOIN (SELECT doc_id FROM {labels} WHERE quality = 0) l ON d.doc_id = l.doc_id GROUP BY d.lang",
    "arch_semi_every": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING bool_and(l_quantity > 20))",
    "parent_case_key": "SELECT n_name, count(*) AS n FROM {customer} JOIN {nation} ON n_nationkey = CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_nationkey END GROUP BY n_name",
    "self_join_tags": "SELECT a.l_orderkey, a.l_linenumber AS x, b.l_linenumber AS y FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber < b.l_linenumber",
    "pair_full_outer": "SELECT coalesce(s.k, c.k) AS nation, coalesce(s.n, 0) AS suppliers, coalesce(c.n, 0) AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} WHERE s_acctbal > 9000 GROUP BY s_nationkey) s FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM {customer} WHERE c_acctbal > 9900 GROUP BY c_nationkey) c ON s.k = c.k",
    "conj_cross_matrix": "SELECT w.word, r.neg, r.fml, concat(substring(w.word, 1, length(w.word) - r.stem), r.okuri) AS form FROM (VALUES ('高い', 'adj-i'), ('白い', 'adj-i'), ('食べる', 'v1'), ('見る', 'v1')) AS w(word, pos) JOIN (VALUES ('adj-i', false, false, 1, 'かった'), ('adj-i', true, false, 1, 'くなかった'), ('v1', false, false, 1, 'た'), ('v1', true, false, 1, 'なかった'), ('v1', false, true, 1, 'ました'), ('v1', true, true, 1, 'ませんでした')) AS r(pos, neg, fml, stem, okuri) ON w.pos = r.pos",
    "adjacency_equi": "SELECT a.event_id AS left_id, b.event_id AS right_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM {events}) a JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM {events}) b ON a.user_id = b.user_id AND b.i = a.i + 1 WHERE a.event_type <> b.event_type",
    "range_path_pairs": "SELECT a.conv_id, a.turn AS x, b.turn AS y FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.turn <= a.turn + 3 WHERE a.role = 'user' AND b.role <> 'user'",
    "null_safe_join": "SELECT coalesce(a.x, -1) AS x, count(*) AS n FROM (SELECT CASE WHEN n_nationkey > 20 THEN NULL ELSE n_regionkey END AS x FROM {nation}) a JOIN (SELECT DISTINCT CASE WHEN n_nationkey > 20 THEN NULL ELSE n_regionkey END AS y FROM {nation}) b ON a.x IS NOT DISTINCT FROM b.y GROUP BY coalesce(a.x, -1)",
    # aggregations
    "union_max_common": "SELECT max(v) AS v FROM (SELECT max(c_acctbal) AS v FROM {customer} UNION ALL SELECT max(s_acctbal) AS v FROM {supplier}) t",
    "having_count_contains": "SELECT l_orderkey, count(*) AS n FROM {lineitem} WHERE l_shipmode_ok GROUP BY l_orderkey HAVING count(*) = 3".replace("l_shipmode_ok", "l_returnflag IN ('A', 'R')"),
    "best_alt_argmax": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {orders}) t WHERE r = 1",
    "database_stats": "SELECT (SELECT count(*) FROM {orders}) AS orders, (SELECT count(*) FROM {lineitem}) AS lineitems, (SELECT count(*) FROM {part}) AS parts, (SELECT count(*) FROM {events}) AS events",
    "call_log_dedupe": "SELECT event_type, props, count(*) AS n FROM {events} GROUP BY event_type, props HAVING count(*) > 1 ORDER BY n DESC, event_type, props LIMIT 10",
    # windows
    "first_by_ord": "SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM {lineitem}) t WHERE r = 1",
    "distinct_on": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM {events}) t WHERE r = 1",
    "renumber": "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS ord FROM {lineitem} WHERE l_discount > 0.02",
    "near_window_gate": "SELECT event_id, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) AS near FROM {events}",
    "any_token_gate": "SELECT conv_id, turn, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS has_system FROM {conversations}",
    "prev_next_context": "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM {events}",
    "prev_turn_context": "SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM {conversations}",
    # top-k
    "topk_per_group": "SELECT o_custkey, o_orderkey, r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {orders}) t WHERE r <= 3",
    "cull_half_max": "SELECT user_id, event_id FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM {events}) t WHERE value * 2 >= m",
    # set operations
    "set_union": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}",
    "set_union_all": "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey AS k FROM {supplier}) t GROUP BY k",
    "set_except": "SELECT p_partkey AS k FROM {part} EXCEPT SELECT l_partkey AS k FROM {lineitem} WHERE l_quantity > 45 AND l_returnflag = 'R'",
    "intersect_match": "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F'",
    # corrections
    "errata_patch_update": "SELECT p_partkey, coalesce(x.new_name, p_name) AS p_name FROM {part} LEFT JOIN (VALUES (1, 'renamed one'), (7, 'renamed seven')) AS x(k, new_name) ON p_partkey = x.k",
    "errata_delete": "SELECT p_partkey, p_name FROM {part} WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('Brand#11'), ('Brand#12')) AS x(b) WHERE b = p_brand)",
    "errata_renumber": "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size < 10 THEN 0 ELSE 1 END, p_partkey) - 1 AS ord FROM {part}",
    # adjacency rules
    "synergy_bonus": "SELECT a.conv_id, a.turn, r.bonus FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 JOIN (VALUES ('user', 'assistant', 10), ('system', 'user', 5)) AS r(l, rr, bonus) ON a.role = r.l AND b.role = r.rr",
    "penalty_first": "SELECT conv_id, turn, CASE WHEN length(text) < 20 AND role <> 'system' THEN -9 WHEN length(text) < 40 THEN -5 ELSE 0 END AS penalty FROM {conversations}",
    "segfilter_mask": "SELECT conv_id, turn FROM {conversations} a WHERE NOT (role = 'assistant' AND EXISTS (SELECT 1 FROM {conversations} b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 1 AND b.role = 'assistant'))",
    # text
    "length_coeff_score": "SELECT n, CASE WHEN n >= 6 THEN n * n WHEN n = 5 THEN 40 WHEN n = 4 THEN 24 WHEN n = 3 THEN 8 ELSE n - 1 END AS score, words FROM (SELECT length(p_type) AS n, count(*) AS words FROM {part} GROUP BY length(p_type)) t",
    "mora_like_length": "SELECT doc_id, length(text) - length(translate(text, 'aeiou', '')) AS vowels FROM {documents}",
    "normalize_translate": "SELECT doc_id, sha2(translate(text, 'ÄÖÜäöüéèàñ', 'AOUaoueean'), 256) AS digest FROM {documents}",
    # token patterns by lead
    "sequence_match": "SELECT conv_id, turn FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r1, lead(role, 2) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r2 FROM {conversations}) t WHERE role = 'user' AND r1 = 'assistant' AND r2 = 'user'",
    "optional_alt_match": "SELECT conv_id, turn, CASE WHEN r1 = 'assistant' THEN 2 ELSE 1 END AS width FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r1 FROM {conversations}) t WHERE role IN ('user', 'system')",
    "not_peek_match": "SELECT conv_id, turn FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r1 FROM {conversations}) t WHERE role = 'user' AND coalesce(r1, '') <> 'assistant'",
    "repeat_run_match": "SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_event FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM {events}) t GROUP BY user_id, event_type, g HAVING count(*) >= 2",
    "token_predicates": "SELECT conv_id, turn, role = 'user' AS is_user, text LIKE 'T%' AS starts_t, length(text) <= 60 AS is_short FROM {conversations}",
    "like_prefix_contains": "SELECT p_partkey FROM {part} WHERE p_name LIKE 'cold%' AND p_type LIKE '%E%'",
}


def char_usage_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.char_usage(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey", "p_name")


#: The same operator in two dialects: Spark (or the operator itself), DuckDB.
PAIRS = {
    "non_arch_anti": (SHARED.pop("non_arch_anti"), "SELECT d.lang, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 0) GROUP BY d.lang"),
    "normalize_translate": (SHARED["normalize_translate"], re.sub(r"sha2\((.*), 256\)", r"sha256(\1)", SHARED.pop("normalize_translate"))),
    "ordered_gloss_agg": ("SELECT r_name, listagg(n_name, '; ') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name", "SELECT r_name, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "signature_agg": ("SELECT l_orderkey, array_join(sort_array(collect_set(concat(l_returnflag, l_linestatus))), ',') AS sig FROM {lineitem} GROUP BY l_orderkey", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus))), ',') AS sig FROM lineitem GROUP BY l_orderkey"),
    "char_usage_distinct": (char_usage_distinct, "SELECT c, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, '')) AS c FROM part) t WHERE c <> '' GROUP BY c"),
    "carry_forward": ("SELECT event_id, coalesce(last(CASE WHEN event_type = 'purchase' THEN event_id END, true) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS parent FROM {events}", "SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS parent FROM events"),
    "basic_split_words": ("SELECT w, count(*) AS n FROM (SELECT explode(regexp_extract_all(text, '([a-z]+)')) AS w FROM {documents}) t GROUP BY w", "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM documents) t GROUP BY w"),
    "sentence_split": ("SELECT doc_id, i, s FROM (SELECT doc_id, posexplode(regexp_extract_all(text, '([^.!?]+[.!?]?)')) AS (i, s) FROM {documents}) t", "SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, s FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]+[.!?]?')) AS s, generate_subscripts(regexp_extract_all(text, '[^.!?]+[.!?]?'), 1) AS i FROM documents) t"),
    "consecutive_runs": ("SELECT doc_id, size(regexp_extract_all(text, '([0-9]+)')) AS digits, size(regexp_extract_all(text, '([A-Z]+)')) AS capitals FROM {documents}", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+')) AS INTEGER) AS digits, CAST(len(regexp_extract_all(text, '[A-Z]+')) AS INTEGER) AS capitals FROM documents"),
    "substring_lexicon_join": ("SELECT u.w, x.k, u.i, length(x.k) AS n FROM (SELECT w, i, explode(sequence(1, least(4, length(w) - i + 1))) AS l FROM (SELECT w, explode(sequence(1, length(w))) AS i FROM (SELECT DISTINCT explode(regexp_extract_all(text, '([a-z]+)')) AS w FROM {documents}) t) v) u JOIN (VALUES ('the'), ('tion'), ('er'), ('ing')) AS x(k) ON substring(u.w, u.i, u.l) = x.k", "SELECT t.w, x.k, CAST(s.i AS INTEGER) AS i, length(x.k) AS n FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM documents) t, unnest(generate_series(1, length(t.w))) AS s(i), (VALUES ('the'), ('tion'), ('er'), ('ing')) AS x(k) WHERE substring(t.w, s.i, length(x.k)) = x.k"),
    "gap_penalty": ("SELECT user_id, sum(cast(least(gap, 1000) AS bigint)) AS penalty FROM (SELECT user_id, (unix_seconds(cast(ts AS timestamp)) - unix_seconds(lag(cast(ts AS timestamp)) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS gap FROM {events}) t WHERE gap IS NOT NULL GROUP BY user_id", "SELECT user_id, CAST(sum(least(gap, 1000)) AS BIGINT) AS penalty FROM (SELECT user_id, (CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS BIGINT)) AS gap FROM events) t WHERE gap IS NOT NULL GROUP BY user_id"),
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def runner(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
        return spark.sql(text, **used)

    return run


def plain(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


QUERIES = {name: runner(text) for name, text in SHARED.items()} | {name: pair[0] if callable(pair[0]) else runner(pair[0]) for name, pair in PAIRS.items()}
ORACLES = {name: plain(text) for name, text in SHARED.items()} | {name: plain(pair[1]) for name, pair in PAIRS.items()}
