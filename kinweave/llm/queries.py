"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, licenses, lm, omh, packing, pieces, pii, topk, urls, vectors
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("matches", "expressions")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op4_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    index = ann.build(rows)
    queries = vectors.picked(rows.filter(F.col("vec_id") % 100 == 0), "vec_id", "embedding", nonzero=True)
    if index is None:
        return queries.selectExpr("__id AS query_id", "1 AS rank", "__id AS vec_id", "0D AS score")
    return ann.search(index, queries, 10)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.train(docs.filter(~held_out))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.filter_urls(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target are the documents labelled as of good quality."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return lm.score(docs, labels.filter("quality = 1").select("doc_id"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.sanitise(table(spark, sf_dir, "documents")))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number and checksum of each text's ids, and whether they decode to it."""
    import public_tokenizers

    return pieces.encode_and_check(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (
        op1_license_scan, op2_best_fit_packing, op3_exact_topk, op4_ann_search, op5_language_id, op6_url_filter,
        op7_lm_score, op8_pii, op9_sentencepiece, op10_near_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_topk": topk.oracle(), "op6_url_filter": urls.oracle()}
