"""Registered queries: each applies one operator, with production settings, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm import (
    byte_bpe,
    conversation_trie,
    decontaminate,
    filter_audit,
    html_extract,
    jaccard_join,
    lm_score,
    quality_rules,
    secret_scan,
    simhash_dedup,
    substring_dedup,
    token_counts,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "format")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("secrets")).alias("spans"))


def ranks_path() -> str:
    return public_tokenizers.path(byte_bpe.RANKS)


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), ranks_path())


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = byte_bpe.encode(docs, ranks_path(), ["doc_id"]).withColumn("ids_sha256", F.sha2("token_ids", 256))
    back = byte_bpe.decode(tokens, ranks_path(), ["doc_id", "n_tokens", "ids_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", "n_chars")


#: Every pair with a common shingle counted, links closed by recursion; for small tables only.
SQL["op9_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, s.b FROM reach r JOIN steps s ON s.a = r.other)
SELECT r.doc_id, coalesce(any_value(n), 0)::bigint AS n_shingles, min(other) AS component_id
FROM reach r LEFT JOIN sizes z ON z.doc_id = r.doc_id GROUP BY 1"""


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"))


@query
def op5_context_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


@query
def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


@query
def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels")).drop("text", "lang")


#: Each document against each order, one by one; for small tables only.
SQL["op11_filter_audit"] = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
tested AS (
  SELECT doc_id, part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x
    WHEN 'A' THEN len(w) < 100
    WHEN 'B' THEN 100 * len(list_distinct(w)) < 80 * len(w)
    WHEN 'C' THEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t)
    WHEN 'D' THEN regexp_matches(t, '[#$%&*|]')
    ELSE coalesce(doc_id > first_id, false) END) AS fails
  FROM (SELECT *, min(doc_id) OVER (PARTITION BY t) AS first_id FROM words)),
says AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
met AS (
  SELECT part, filter_order, fails, list_min(list_transform(fails, lambda x: strpos(filter_order, x))) AS hit,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM tested LEFT JOIN says USING (doc_id), orders),
steps AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS f,
    count(*) FILTER (hit IS NULL OR hit > step) AS kept,
    count(*) FILTER (hit = step) AS removed,
    count(*) FILTER (hit < step AND list_contains(fails, substr(filter_order, step, 1))) AS redundant,
    count(*) FILTER (fails = [substr(filter_order, step, 1)]) AS unique_fails,
    count(*) FILTER (hit = step AND good) AS good_lost,
    count(*) FILTER (hit = step AND toxic) AS toxic_lost
  FROM met, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM steps"""


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.link_documents(table(spark, sf_dir, "documents"))


#: Prefixes as lists of turns, each node met with all its ancestors; for small tables only.
SQL["op13_conversation_trie"] = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said
  FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT conv_id, list(said ORDER BY i) AS own FROM turns GROUP BY 1),
heads AS (
  SELECT conv_id, own, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h FROM whole),
built AS (
  SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS said
  FROM heads c LEFT JOIN whole b ON b.conv_id = c.base),
steps AS (SELECT conv_id, said, unnest(range(0, len(said) + 1)) AS depth FROM built),
nodes AS (
  SELECT depth, said[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(said) = depth), '') AS ends
  FROM steps GROUP BY 1, 2),
named AS (
  SELECT *, md5(path::VARCHAR) AS id, CASE WHEN depth > 0 THEN md5(path[1:depth - 1]::VARCHAR) END AS parent,
    CASE WHEN depth = 0 THEN 0 ELSE len(list_filter(string_split_regex(path[depth].text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) END AS words
  FROM nodes),
kids AS (SELECT parent AS id, count(*) AS n_children FROM named WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT named.*, coalesce(n_children, 0) AS n_children FROM named LEFT JOIN kids USING (id)),
above AS (SELECT md5(path[1:d]::VARCHAR) AS id, n_children, n_convs, words
          FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_nodes)),
totals AS (SELECT id, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens FROM above GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN totals USING (id) LEFT JOIN full_nodes p ON p.id = n.parent"""


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))
