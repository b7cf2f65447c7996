"""The queries of the operators in this package, and the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunegauge.llm import (
    audit, decontaminate, licences, maxent, packing, pii, ranked, shards, simhash, superminhash, topk, toxicity, warc,
)
from tunegauge.llm.tables import share_code, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        share_code(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, pii.fit(docs))
    counted = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", *[counted(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )


@query
def op3_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    return shards.uniform_shuffle(rows, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op4_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


ORACLES["op4_positional_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s : s + 12], ' ') AS k
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM b WHERE len(w) > 0)
), occ AS (
  SELECT r, s, l.n, k FROM (
    SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS k
    FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
  ) l SEMI JOIN win ON l.k = win.k AND l.n = win.n
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM occ) GROUP BY r
), item AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l
  FROM (SELECT DISTINCT occ.r, win.item_id FROM occ JOIN win ON occ.k = win.k AND occ.n = win.n) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN item USING (r)
"""


@query
def op5_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to",
        F.octet_length("payload").cast("long").alias("stored_bytes"), F.sha1("payload").alias("stored_sha1"),
    )


ORACLES["op5_warc_source"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(p.h, CAST(5 * (k // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN strlen(html) END AS stored_bytes,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN p.h END AS stored_sha1
FROM p JOIN g ON p.h = g.h
"""


@query
def op6_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    found = maxent.scores(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.classified(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query
def op8_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", 10)


ORACLES["op9_ball_tree_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scanned(table(spark, sf_dir, "documents"))
    base = F.filter("finds", lambda f: f["kind"] == "base")
    labels = F.transform(base, lambda f: f["label"])
    more = F.transform(F.filter("finds", lambda f: f["kind"] == "notice"), lambda f: f["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda f: f["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda f: f["word"])).alias("last_word"),
        joined(labels).alias("base_labels"), joined(F.concat(labels, more, "licences")).alias("labels"), "score",
    )


@query
def op11_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op11_superminhash_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) <= 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS g
  FROM d WHERE len(w) > 0
), sets AS (
  SELECT r, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS node FROM s GROUP BY r
), nodes AS (
  SELECT node, n, min(r) AS r FROM sets GROUP BY node, n
), held AS (
  SELECT node, n, g FROM s JOIN nodes USING (r)
), linked AS (
  SELECT a.node AS a, b.node AS b FROM held a JOIN held b ON a.g = b.g AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT node, node AS other FROM nodes
  UNION SELECT reach.node, linked.b FROM reach JOIN linked ON reach.other = linked.a
), least AS (
  SELECT reach.node, min(doc_id) AS id FROM reach JOIN sets ON reach.other = sets.node JOIN d USING (r) GROUP BY reach.node
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE id END AS component_id,
  doc_id IS NOT DISTINCT FROM CASE WHEN n IS NULL THEN doc_id ELSE id END AS kept
FROM d LEFT JOIN sets USING (r) LEFT JOIN least USING (node)
"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), least AS (
  SELECT x, min(doc_id) AS first FROM t GROUP BY x
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n,
    concat(CASE WHEN len(w) < 50 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END,
      CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x) THEN 'C' ELSE '' END,
      CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails
  FROM t JOIN least USING (x) LEFT JOIN l USING (doc_id) GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k
), orders AS (
  SELECT concat(a.k, b.k, c.k, d.k, e.k) AS filter_order
  FROM letters a JOIN letters b ON b.k <> a.k JOIN letters c ON c.k NOT IN (a.k, b.k) JOIN letters d ON d.k NOT IN (a.k, b.k, c.k)
    JOIN letters e ON e.k NOT IN (a.k, b.k, c.k, d.k)
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
  FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders)
), marked AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) AS own, translate(fails, before, '') <> fails AS gone FROM cells, steps
), counted AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (own AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
    coalesce(sum(n) FILTER (own AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (own AND NOT gone AND toxic), 0) AS toxic_lost
  FROM marked GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""


@query
def op13_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


ORACLES["op13_hybrid_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT q, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS term
  FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark)
), whole AS (
  SELECT CAST(count(*) AS BIGINT) AS N, CAST(sum(len(w)) AS BIGINT) AS L FROM d WHERE len(w) > 0
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) SEMI JOIN b USING (term) GROUP BY r, term
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * N + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, whole GROUP BY term, N
), lengths AS (
  SELECT r, doc_id, 50 + (50 * len(w) * N) // L AS m FROM d, whole WHERE len(w) > 0
), scored AS (
  SELECT q, item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM b JOIN tf USING (term) JOIN weight USING (term) JOIN lengths USING (r) GROUP BY q, item_id, r, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
) WHERE rank <= 50
"""
