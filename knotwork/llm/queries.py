"""The ten operators as registered queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from knotwork.llm.common import small_batches, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from knotwork.llm.toxicity import report

    small_batches(spark)
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from knotwork.llm.decontaminate import report

    small_batches(spark)
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from knotwork.llm.imatch import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from knotwork.llm.quality import report

    small_batches(spark)
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from knotwork.llm.sentencepiece_codec import model_path, token_digests

    small_batches(spark)
    return token_digests(table(spark, sf_dir, "documents"), model_path())


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from knotwork.llm.langid import report

    small_batches(spark)
    return report(table(spark, sf_dir, "documents"))


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from knotwork.llm.kd_shards import shard

    return shard(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from knotwork.llm.pii import report

    small_batches(spark)
    return report(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from knotwork.llm.jaccard_join import components

    small_batches(spark)
    return components(table(spark, sf_dir, "documents"))


def op10_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from knotwork.llm.htmlcrf import extract

    small_batches(spark)
    return extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_toxicity, op2_decontaminate, op3_imatch, op4_byte_cnn, op5_sentencepiece_codec, op6_langid, op7_kd_shards, op8_pii, op9_jaccard_join, op10_html_crf)
    return {f.__name__: f for f in every}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

OP2 = f"""WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 ip AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM iw WHERE len(w) > 0),
 win AS (SELECT item_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM ip), lens AS (SELECT DISTINCT n FROM win),
 dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS q FROM dw, lens WHERE len(w) >= n), dk AS (SELECT doc_id, n, q, array_to_string(w[q:q + n - 1], ' ') AS k FROM dp),
 hits AS (SELECT doc_id, q, n, item_id, p FROM dk JOIN win USING (n, k)),
 nh AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(q, q + n)) AS x FROM hits) GROUP BY 1),
 ni AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY 1),
 it AS (SELECT i, item_id, n, unnest(w) AS x, unnest(range(1, n + 1)) AS p FROM (SELECT row_number() OVER () AS i, item_id, w, len(w) AS n FROM iw WHERE len(w) > 0)),
 one AS (SELECT doc_id, q, i, item_id, n, p FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM dw) JOIN it USING (x)),
 runs AS (SELECT doc_id, i, coalesce(CAST(item_id AS VARCHAR), '') AS item_id, n, p, q, q - row_number() OVER (PARTITION BY doc_id, i, q - p ORDER BY q) AS g FROM one),
 mm AS (SELECT doc_id, item_id, n, min(q) - 1 AS b, min(p) - 1 AS s, count(*) AS m FROM runs GROUP BY doc_id, i, item_id, n, q - p, g),
 lm AS (SELECT doc_id, max(m) AS longest, string_agg(concat_ws(':', b, b + m, item_id, s), ',' ORDER BY b, b + m, item_id, s) FILTER (m >= least(8, n)) AS places FROM mm GROUP BY 1)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20*coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match, coalesce(places, '') AS locations
 FROM dw LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id) LEFT JOIN lm USING (doc_id)"""

OP9 = rf"""WITH RECURSIVE dw AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
 sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM dw),
 long AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
 o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o FROM long a JOIN long b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM o WHERE 100*o >= 75*(na + nb - o)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 reach AS (SELECT DISTINCT a AS x, a AS y FROM e UNION SELECT x, b FROM reach JOIN e ON y = a)
 SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id FROM sets LEFT JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) ON x = doc_id"""


def oracle_sql() -> dict[str, str]:
    """The other operators hash, learn or draw in ways that SQL cannot repeat; their tests compare them with brute force."""
    return {"op2_decontaminate": OP2, "op9_jaccard_join": OP9}
