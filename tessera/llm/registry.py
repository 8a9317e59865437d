"""The queries of this subpackage and, where SQL can express one, the DuckDB SQL for its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_sequences

    return pack_sequences(read(spark, sf_dir), _tokenizer("word_bpe_49k.json"), length=2048, end_id=0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(read(spark, sf_dir), _tokenizer("piece_bpe_32k.model"), limit=4096)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(read(spark, sf_dir), window=50)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import labelled_samples, ordinary_words, secret_digest

    docs = read(spark, sf_dir)
    return secret_digest(docs, labelled_samples() + ordinary_words(docs, read(spark, sf_dir, "labels")))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bytespans import remove_repeated_bytes

    return remove_repeated_bytes(read(spark, sf_dir), window=100)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated_pairs

    return contaminated_pairs(read(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(read(spark, sf_dir))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_digest

    return simhash_digest(read(spark, sf_dir))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_digest

    return media_digest(read(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(read(spark, sf_dir), read(spark, sf_dir, "labels"), threshold=0.3)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(read(spark, sf_dir), least_docs=30, top=50)


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tries import prefix_trie

    return prefix_trie(read(spark, sf_dir, "conversations"))


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip_digest

    return round_trip_digest(read(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_token_counts, op3_substring_dedup, op4_secret_scans, op5_suffix_array_dedup, op6_benchmark_decontamination, op7_license_scans, op8_simhash_near_dedup, op9_media_columns, op10_quality_classifier, op11_source_divergence, op12_conversation_prefix_trie, op13_bpe_round_trip)}


def oracle_sql() -> dict[str, str]:
    from . import divergence, licenses, substrings, tries

    return {"op3_substring_dedup": substrings.ORACLE_SQL, "op7_license_scans": licenses.oracle(), "op11_source_divergence": divergence.ORACLE_SQL, "op12_conversation_prefix_trie": tries.ORACLE_SQL}
