"""The registered queries of this subpackage: (spark, directory) -> DataFrame."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posevidence.llm import (
    decontamination,
    hard_negatives,
    ngram_join,
    pitman_yor,
    quality_cnn,
    quality_rules,
    recompression,
    secret_scan,
    sentencepiece_bpe,
    source_divergence,
    suffix_dedup,
    token_files,
    toxicity,
)
from posevidence.llm.common import fold, importable
from posevidence.materialize import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build):
    @functools.wraps(build)
    def run(spark, directory):
        importable(spark)
        return build(spark, directory)

    QUERIES[build.__name__] = run
    return run


def documents(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/documents.parquet")


def tokenizer_file(name: str) -> str:
    """A vocabulary file; ``TOKENIZER_DIR`` names their folder where set."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_sentencepiece(spark, directory):
    """Ids and decoded text of every document, as digests."""
    model = tokenizer_file("piece_bpe_32k.model")
    docs = documents(spark, directory).select("doc_id", "text")
    found = sentencepiece_bpe.decoded(sentencepiece_bpe.encoded(docs, model), model)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op10_token_files(spark, directory):
    """Ids of every document as read back from the written files."""
    folder = new_folder(spark, "token-files")
    token_files.write_ids(
        documents(spark, directory), folder, tokenizer_file("word_bpe_49k.json"), end_id=2
    )
    return token_files.read_checksums(spark, folder)


@query
def op3_suffix_dedup(spark, directory):
    """Bytes of every document outside strings of 100 bytes that stand earlier."""
    return suffix_dedup.without_repeats(documents(spark, directory), 100).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op5_recompression_dedup(spark, directory):
    """Words of every document outside 50-word windows of earlier documents."""
    return recompression.without_passages(documents(spark, directory), 50).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


@query
def op7_quality_rules(spark, directory):
    """Counts and verdict of every document."""
    return quality_rules.verdicts(documents(spark, directory))


@query
def op2_ngram_join(spark, directory):
    """Classes of documents linked by nine tenths of their 3-word shingles."""
    return ngram_join.near_duplicates(documents(spark, directory), width=3, percent=90)


@query
def op4_quality_cnn(spark, directory):
    """Quality scores of every document."""
    docs = documents(spark, directory).select("doc_id", "text")
    network = quality_cnn.fit(docs, spark.read.parquet(f"{directory}/labels.parquet"), "quality")
    return docs.select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), quality_cnn.score(F.col("text"), network).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op8_toxicity(spark, directory):
    """Toxicity scores of every document with their evidence."""
    docs = documents(spark, directory).select("doc_id", "text")
    examples = toxicity.fit(docs, spark.read.parquet(f"{directory}/labels.parquet"), "toxic")
    found = docs.select("doc_id", toxicity.judged(F.col("text"), examples).alias("found"))
    return found.select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        F.col("found.score").alias("score"),
        (F.col("found.score") >= 0.7).cast("int").alias("predicted"),
        F.col("found.nearest").alias("nearest"),
    )


@query
def op9_decontamination(spark, directory):
    """Benchmark questions that documents hold, re-parameterised ones included."""
    return decontamination.contaminated(
        documents(spark, directory), spark.read.parquet(f"{directory}/benchmark.parquet")
    )


@query
def op6_pitman_yor(spark, directory):
    """Log probabilities of every document under the model and its base."""
    return pitman_yor.scored(documents(spark, directory))


@query
def op11_secret_scan(spark, directory):
    """Spans of secrets of every document, and who else holds them."""
    found = secret_scan.secrets(documents(spark, directory))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    judged = lambda verdict: F.size(F.filter("spans", lambda s: s["verdict"] == verdict)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(secret_scan.named_spans(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.named_spans(F.col("spans")).alias("spans"),
        judged("live").alias("n_live"),
        judged("copied").alias("n_copied"),
    )


@query
def op12_source_divergence(spark, directory):
    """Distances of the sources of each language, and the terms that mark them."""
    return source_divergence.audit(documents(spark, directory))


@query
def op13_hard_negatives(spark, directory):
    """Hard negatives of every anchor and positive."""
    return hard_negatives.mined(spark.read.parquet(f"{directory}/embeddings.parquet"))
