"""Queries of this package, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from passgrid.llm.bpe_codec import round_trip
from passgrid.llm.collocations import collocations
from passgrid.llm.common import documents
from passgrid.llm.hard_negatives import hard_negatives
from passgrid.llm.jaccard_join import jaccard_join
from passgrid.llm.license_scan import scan_licenses
from passgrid.llm.materialise import materialise
from passgrid.llm.media import media_columns
from passgrid.llm.mixing import sample_mixture
from passgrid.llm.packing import pack
from passgrid.llm.pii import find_pii
from passgrid.llm.quality import score_quality, train
from passgrid.llm.token_counts import count_tokens
from passgrid.llm.topk_search import top_k

Query = Callable[[SparkSession, str], DataFrame]


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_quality(docs, train(docs, documents(spark, sf_dir, "labels")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the id is divisible by 7 the label is the next one."""
    vectors = documents(spark, sf_dir, "embeddings")
    return hard_negatives(vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


QUERIES: dict[str, Query] = {
    "op1_token_counts": lambda spark, sf_dir: count_tokens(documents(spark, sf_dir)),
    "op2_ngram_jaccard_join": lambda spark, sf_dir: jaccard_join(documents(spark, sf_dir)),
    "op3_exact_top_k": lambda spark, sf_dir: top_k(documents(spark, sf_dir, "embeddings")),
    "op4_license_scan": lambda spark, sf_dir: scan_licenses(documents(spark, sf_dir)),
    "op5_quality_classifier": op5_quality_classifier,
    "op6_best_fit_packing": lambda spark, sf_dir: pack(documents(spark, sf_dir)),
    "op7_token_id_output": lambda spark, sf_dir: materialise(documents(spark, sf_dir)),
    "op8_source_mixing": lambda spark, sf_dir: sample_mixture(documents(spark, sf_dir)),
    "op9_pii": lambda spark, sf_dir: find_pii(documents(spark, sf_dir)),
    "op10_media_columns": lambda spark, sf_dir: media_columns(documents(spark, sf_dir)),
    "op11_collocations": lambda spark, sf_dir: collocations(documents(spark, sf_dir)),
    "op12_hard_negatives": op12_hard_negatives,
    "op13_bpe_codec": lambda spark, sf_dir: round_trip(documents(spark, sf_dir)),
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS c FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.c, d.c) AS BIGINT) AS score
            FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents
        ), split AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces
        ), totals AS (
            SELECT lang, sum(len(w)) AS n FROM split GROUP BY lang
        ), f AS (
            SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS n FROM split, range(1, 6) ks(k), unnest(range(1, len(w) - k + 2)) AS starts(i) GROUP BY ALL HAVING count(*) >= 100
        ), c AS (
            SELECT lang, k, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE k > 1
        ), longer AS (
            SELECT DISTINCT x.lang, x.part FROM (
                SELECT lang, a, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS part FROM c
            ) x JOIN f ON f.lang = x.lang AND f.phrase = x.part AND 100 * x.a >= 100 * f.n
        ), cuts AS (
            SELECT c.lang, c.phrase, c.a, js.j, l.n AS l, r.n AS r, CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score, t.n AS n
            FROM c JOIN range(1, 5) js(j) ON js.j < c.k JOIN totals t ON t.lang = c.lang
            JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:js.j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[js.j + 1:c.k], ' ')
        ), best AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
        ), kept AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best b
            WHERE NOT EXISTS (SELECT 1 FROM longer g WHERE g.lang = b.lang AND g.part = b.phrase)
        )
        SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score FROM kept WHERE rank <= 2000
    """,
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, d.vec_id AS vec_id, a.label = d.label AS same, CAST(list_inner_product(a.c, d.c) AS BIGINT) AS score FROM v a JOIN v d ON a.vec_id <> d.vec_id WHERE a.vec_id % 100 = 0
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
    """,
}
