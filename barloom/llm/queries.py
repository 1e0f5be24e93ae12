"""One registered query for each training-data operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import byte_bpe, collocations, decontamination, hard_negatives, hidden_markov, language, licences, near_duplicates, packing, token_counts, token_records, topk, toxicity
from barloom.llm.registry import query


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


@query("op1_token_records")
def op1(spark, root):
    return token_records.digest(table(spark, root, "documents"))


@query("op7_token_counts")
def op7(spark, root):
    return token_counts.token_counts(table(spark, root, "documents"))


@query("op3_best_fit_packing")
def op3(spark, root):
    return packing.packed(table(spark, root, "documents"))


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len(embedding) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op2_exact_top_k", TOP_K_SQL)
def op2(spark, root):
    return topk.top_k(table(spark, root, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op6_language_id")
def op6(spark, root):
    return language.digest(table(spark, root, "documents"))


@query("op8_toxicity")
def op8(spark, root):
    return toxicity.digest(table(spark, root, "documents"), table(spark, root, "labels"))


@query("op9_near_duplicates")
def op9(spark, root):
    return near_duplicates.joined(table(spark, root, "documents"))


@query("op5_hidden_markov")
def op5(spark, root):
    return hidden_markov.digest(table(spark, root, "documents"))


@query("op4_decontamination")
def op4(spark, root):
    return decontamination.found(table(spark, root, "documents"), table(spark, root, "benchmark"))


@query("op10_licences")
def op10(spark, root):
    docs = table(spark, root, "documents")
    return licences.licences(docs, F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


@query("op13_byte_bpe")
def op13(spark, root):
    return byte_bpe.digest(table(spark, root, "documents"))


PHRASES_SQL = """
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, [w for w in string_split_regex(piece, '[ \\t]+') if w <> ''] AS w FROM piece
), places AS (
  SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM words WHERE len(w) > 0
), gram AS (
  SELECT lang, 1 AS size, w[i] AS phrase FROM places
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM places WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM places WHERE i + 2 <= len(w)
), f AS MATERIALIZED (
  SELECT lang, size, phrase, count(*) AS n FROM gram GROUP BY ALL
), total AS (
  SELECT lang, sum(n) AS n FROM f WHERE size = 1 GROUP BY lang
), often AS MATERIALIZED (
  SELECT lang, size, phrase, n, string_split(phrase, ' ') AS w FROM f WHERE n >= 10
), part AS (
  SELECT lang, w[1] || ' ' || w[2] AS phrase, n FROM often WHERE size = 3
  UNION ALL SELECT lang, w[2] || ' ' || w[3], n FROM often WHERE size = 3
), above AS (
  SELECT lang, phrase, max(n) AS m FROM part GROUP BY ALL
), kept AS (
  SELECT o.* FROM often o LEFT JOIN above b ON o.lang = b.lang AND o.phrase = b.phrase AND o.size = 2
  WHERE o.size >= 2 AND (b.m IS NULL OR 100 * b.m < 50 * o.n)
), cut AS (
  SELECT lang, phrase, n AS a, 1 AS k, w[1] AS p, CASE size WHEN 2 THEN w[2] ELSE w[2] || ' ' || w[3] END AS q FROM kept
  UNION ALL SELECT lang, phrase, n, 2, w[1] || ' ' || w[2], w[3] FROM kept WHERE size = 3
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.n AS l, y.n AS r,
    (1000000 * c.a::HUGEINT * c.a::HUGEINT) // (x.n::HUGEINT * y.n::HUGEINT) AS score
  FROM cut c JOIN often x ON c.lang = x.lang AND c.p = x.phrase JOIN often y ON c.lang = y.lang AND c.q = y.phrase
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT r.lang, CAST(r.rank AS BIGINT) AS rank, r.phrase, CAST(r.a AS BIGINT) AS a, CAST(r.l AS BIGINT) AS l, CAST(r.r AS BIGINT) AS r,
  CAST(t.n AS BIGINT) AS n, CAST(r.score AS BIGINT) AS score
FROM ranked r JOIN total t ON r.lang = t.lang WHERE rank <= 2000
"""


@query("op12_collocations", PHRASES_SQL)
def op12(spark, root):
    return collocations.collocations(table(spark, root, "documents"))


NEGATIVES_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len(embedding) > 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), r AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
  WHERE 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11(spark, root):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, root, "embeddings"), F.col("vec_id") % 100 == 0, label)
