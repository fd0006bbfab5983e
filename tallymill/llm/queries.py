"""The thin ``opN_<name>`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_count, decontamination, filter_audit, jaccard_join, language_mix, language_model, lexicon_match, line_dedup, mixing, personal_data, quality, token_alignment, transport_stream
from .sql import AUDIT_SQL, LINES_SQL, MIX_SQL

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), table(spark, sf_dir, "pages"))


def op5_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.round_trip(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"), width=4, percent=85)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(table(spark, sf_dir, "documents"))


def op8_token_count(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = str(public_tokenizers.path("word_bpe_49k.json"))
    return bpe_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary)


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.train_and_score(table(spark, sf_dir, "documents"))


def op10_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, loglike = language_mix.train(docs.where(language_mix.remainder(4) != 2))
    held_out = docs.select("doc_id", (language_mix.remainder(4) == 2).alias("held_out"), "text")
    return language_mix.identify(held_out, langs, loglike, keep=["held_out"])


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lexicon_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_match.fingerprint_edits(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str, byte_ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """The vocabulary of bytes is read in its form as ranks; its JSON form gives the same tokens (tests)."""
    import public_tokenizers as public

    a, b, pattern = byte_ranks or str(public.path("byte_bpe_50k.tiktoken")), pieces or str(public.path("piece_bpe_32k.model")), public.PATTERN
    return token_alignment.align(table(spark, sf_dir, "documents"), lambda: token_alignment.byte_ranks(a, pattern), lambda: token_alignment.pieces(b))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_mix_sources": op2_mix_sources,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality": op4_quality,
    "op5_transport_stream": op5_transport_stream,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_personal_data": op7_personal_data,
    "op8_token_count": op8_token_count,
    "op9_language_model": op9_language_model,
    "op10_language_mix": op10_language_mix,
    "op11_filter_audit": op11_filter_audit,
    "op12_lexicon_match": op12_lexicon_match,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL: dict[str, str] = {"op2_mix_sources": MIX_SQL, "op3_line_dedup": LINES_SQL, "op11_filter_audit": AUDIT_SQL}
