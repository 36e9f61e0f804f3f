"""The operators as named queries over the given tables, and SQL to check them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talusgrid.llm import languages, mixing, ngram_join, pieces, pii, quality, ranking, secrets, sql, substrings, tokens, variants, vectors, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(F.col(spans), lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.detected(_table(spark, sf, "documents"))
    counts = [_count("spans", kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("spans")), 256).alias("base_sha256"), _listed(F.col("all_spans")).alias("spans"))


def op2_warc(spark: SparkSession, sf: str) -> DataFrame:
    found = warc.archived(_table(spark, sf, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.repeat_counts(_table(spark, sf, "documents"))


def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    plan = mixing.mix_plan(_table(spark, sf, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.detected(_table(spark, sf, "documents"))
    counts = [_count("spans", kind) for kind in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("spans")), 256).alias("base_sha256"), _listed(F.col("all_spans")).alias("spans"))


def op6_languages(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = languages.learn(docs.where(rest != 0))
    found = languages.predict(docs, model)
    return found.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(_table(spark, sf, "documents"))


def op8_vectors(spark: SparkSession, sf: str) -> DataFrame:
    found = vectors.near_duplicates(_table(spark, sf, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op9_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.ngram_classes(_table(spark, sf, "documents"), n=3, percent=90)


def op10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The encodings themselves, their digests, and whether decoding gives back the text."""
    found = pieces.encoded(_table(spark, sf, "documents"), digests=True)
    return found.select("doc_id", "rank", "n_pieces", "log_prob", "perturbed", "inclusion", "pieces_sha256", "round_trip", "pieces")


#: One run in so many loses a code point before its spelling is looked at.
SLIP = 199


def _slipped(runs: DataFrame) -> DataFrame:
    """Words of which some, by a checksum of document and word, lack one code point; a null doc_id leaves them as they are."""
    check = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")).cast("binary"))
    at = (check % F.length("word")).cast("int")
    short = F.concat(F.left("word", at), F.right("word", F.length("word") - at - 1))
    return runs.select(F.when(check % SLIP == 0, short).otherwise(F.col("word")).alias("word"))


def op11_variants(spark: SparkSession, sf: str) -> DataFrame:
    return variants.spelling_forms(variants.word_counts(_slipped(variants.runs(_table(spark, sf, "documents")))))


def op12_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.ranked(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op13_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf, "documents"), tokenizer_path())


def llm_queries() -> dict[str, Query]:
    return {
        "op1_pii": op1_pii,
        "op2_warc": op2_warc,
        "op3_substrings": op3_substrings,
        "op4_mixing": op4_mixing,
        "op5_secrets": op5_secrets,
        "op6_languages": op6_languages,
        "op7_quality": op7_quality,
        "op8_vectors": op8_vectors,
        "op9_ngram_join": op9_ngram_join,
        "op10_pieces": op10_pieces,
        "op11_variants": op11_variants,
        "op12_search": op12_search,
        "op13_token_counts": op13_token_counts,
    }


def llm_sql() -> dict[str, str]:
    return {"op2_warc": sql.WARC, "op3_substrings": sql.SUBSTRINGS, "op4_mixing": sql.MIXING, "op7_quality": sql.QUALITY, "op8_vectors": sql.VECTORS, "op9_ngram_join": sql.NGRAM_JOIN, "op11_variants": sql.VARIANTS, "op12_search": sql.SEARCH}
