"""The numbered queries over the driver's tables, each through its operator, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm.ann import nearest
from strata.llm.decontaminate import contamination_digest
from strata.llm.hmm import sequence_scores
from strata.llm.jaccard import jaccard_groups
from strata.llm.language import language_digest
from strata.llm.licenses import digest_sql, license_digest
from strata.llm.linkrank import url_verdicts, verdict_sql
from strata.llm.mixing import mixing_digest
from strata.llm.negatives import hard_negatives
from strata.llm.quality import quality_digest
from strata.llm.substring import removal_digest
from strata.llm.suffix import suffix_digest
from strata.llm.treap import ranked_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_hmm_scoring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_scores(table(spark, sf_dir, "documents"))


@query("op2_language_mixture")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_digest(table(spark, sf_dir, "documents"))


@query("op3_ngram_jaccard", rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM met JOIN size s ON s.doc_id = x JOIN size t ON t.doc_id = y WHERE 100 * c >= 75 * (s.n + t.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(c AS BIGINT) AS component_id
FROM documents d LEFT JOIN size USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) USING (doc_id)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


@query("op4_substring_dedup", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
least_doc AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
hit AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM win JOIN least_doc USING (g) WHERE m < doc_id)),
one AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) FILTER (WHERE h.p IS NULL) AS t, count(h.p) AS n
         FROM one LEFT JOIN hit h USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(table(spark, sf_dir, "documents"))


@query("op5_nn_descent")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


@query("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digest(table(spark, sf_dir, "documents"))


@query("op7_decontamination", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
item AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + 9], ' ') AS g
         FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)),
place AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g
          FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM item))),
found AS (SELECT doc_id, k, i, item_id FROM place JOIN item USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_license_scan", digest_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(table(spark, sf_dir, "documents"))


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_source_mixing", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS o FROM documents),
per AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM per),
r AS (SELECT *, source_size * 3 / weight AS level FROM w),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS fill FROM r),
t AS (SELECT *, max(CASE WHEN level >= fill THEN fill END) OVER () AS open FROM f),
goal AS (SELECT source, source_size, CASE WHEN level <= open THEN source_size * CAST(3 AS DOUBLE) ELSE open * weight END AS target FROM t),
p AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
      FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
       CAST(greatest(least(floor(target) - b, size), 0) + greatest(least(floor(target) - b - source_size, size), 0) + greatest(least(floor(target) - b - 2 * source_size, size), 0) AS BIGINT) AS taken
FROM p""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_digest(table(spark, sf_dir, "documents"))


@query("op11_hard_negatives", """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS p
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.p, b.p), lambda x: x[1] * x[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.r <> b.r AND len(a.p) = len(b.p) WHERE a.vec_id % 50 = 0),
pos AS (SELECT a, b, anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id, b) <= 5),
neg AS (SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
               CAST(row_number() OVER (PARTITION BY a, pos.b ORDER BY score DESC, id, s.b) AS INTEGER) AS rank
        FROM pos JOIN (SELECT a, b, id, score FROM s WHERE NOT same) s USING (a) WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


@query("op12_link_graph", verdict_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


@query("op13_lexical_search", rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
size AS (SELECT count(*) AS n_docs, sum(len(ws)) AS n_terms FROM d WHERE len(ws) > 0),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
tf AS (SELECT r, doc_id, n, w, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM asked) GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
part AS (SELECT r, doc_id, w, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT)
                * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS s FROM tf JOIN df USING (w), size),
total AS (SELECT item_id, r, doc_id, CAST(sum(s) AS BIGINT) AS score FROM part JOIN asked USING (w) GROUP BY ALL HAVING sum(s) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score
FROM total QUALIFY rank <= 50""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
