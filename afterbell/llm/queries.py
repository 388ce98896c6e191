"""The registered queries of this subpackage: thin calls of the operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from afterbell.llm.common import table
from afterbell.llm.decontaminate import find_contamination
from afterbell.llm.divergence import source_divergence
from afterbell.llm.html import extract_pages
from afterbell.llm.language import learn_languages, predict_languages
from afterbell.llm.mixing import mix_documents
from afterbell.llm.neighbours import nearest_neighbours
from afterbell.llm.repeats import remove_repeats
from afterbell.llm.secrets import scan_secrets, secret_digest
from afterbell.llm.sharding import shard_by_bytes
from afterbell.llm.simhash import near_duplicates
from afterbell.llm.tokens import tokens_round_trip
from afterbell.llm.variants import group_variants
from afterbell.llm.warc import warc_round_trip


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7 under the law ``bytes``."""
    return shard_by_bytes(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of documents; a document is a repository, its source the owner."""
    return secret_digest(scan_secrets(table(spark, sf_dir, "documents")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from documents that aren't held out."""
    documents = table(spark, sf_dir, "documents")
    return predict_languages(documents, learn_languages(documents))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated sampling of all documents, raked to tempered source, language and topic shares."""
    out = mix_documents(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("factor", "probability")})


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and its distance."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 200-byte strings that repeat anywhere."""
    return remove_repeats(table(spark, sf_dir, "documents"), 200).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at up to three differing fingerprint bits."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, max_distance=3)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed token files, read back."""
    return tokens_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of every hundredth vector among all vectors."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), k=10, factor=1.0)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents with the form each is a variant of."""
    return group_variants(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records with revisits, written and read back by the salvage reader."""
    return warc_round_trip(table(spark, sf_dir, "pages")).drop("target_uri")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of each language in all their words."""
    return source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_secret_scan": op2_secret_scan,
        "op3_language_id": op3_language_id,
        "op4_source_mixing": op4_source_mixing,
        "op5_decontamination": op5_decontamination,
        "op6_repeated_bytes": op6_repeated_bytes,
        "op7_simhash": op7_simhash,
        "op8_token_files": op8_token_files,
        "op9_html_text": op9_html_text,
        "op10_neighbours": op10_neighbours,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_warc": op12_warc,
        "op13_source_divergence": op13_source_divergence,
    }
