"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import exact_dedup, language, licenses, media, mixing, ngram_join, packing, suffix_tree, token_files, toxicity
from orrery.llm._text import documents, remainder


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(toxicity.sample(docs.where(remainder(4) != 2), documents(spark, sf_dir, "labels")))
    scores = toxicity.score(docs, model)
    return scores.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_windows")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), with_ids=False)


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = suffix_tree.score(documents(spark, sf_dir), remainder(7) != 2)
    return scores.select("doc_id", (remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("detections")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.encode_media(documents(spark, sf_dir))).drop("payload")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify(docs, docs.where(remainder(5) != 0)).select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(documents(spark, sf_dir))
    return token_files.read_token_files(manifest, with_ids=False)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(documents(spark, sf_dir)).drop("copies")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_groups(documents(spark, sf_dir), n=4, percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {f.__name__: f for f in (op1_toxicity, op2_packing, op3_suffix_tree, op4_license_scan, op5_exact_dedup, op6_media_columns, op7_language_id, op8_token_files, op9_mixing, op10_ngram_join)} | {"pipeline": corpus_pipeline.run}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = f"""
WITH d AS (SELECT doc_id, sha256({_LOW}) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d"""


OP10 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(LOW, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) END AS g FROM w),
k AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM k a JOIN k b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.c)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(c) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, g""".replace("LOW", _LOW)


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5, "op10_ngram_join": OP10}
