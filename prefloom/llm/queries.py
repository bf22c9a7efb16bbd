"""The corpus queries, op1 to op13, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import by_document

    return by_document(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "full", "part")


def op4_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sketch import compare_edited

    return compare_edited(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replace

    # a fixed key, so that reruns agree; whoever publishes surrogates keeps a key of their own
    return replace(table(spark, sf_dir, "documents"), key="key of this query").select("doc_id", "n_pii", "text")


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pitman_yor import score

    return score(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("text", "lang")


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import cut
    from .secrets import scan

    # the first pass fills the ledger; the second finds every blob in it and scans none
    docs = table(spark, sf_dir, "documents")
    ledger = cut(scan(docs)[1])
    return scan(docs, ledger)[0].drop("blob")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import round_trips

    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
