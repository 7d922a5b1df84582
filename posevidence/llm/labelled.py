"""A bounded sample of labelled documents to fit a model on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posevidence.llm.common import fold


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, most_rows: int, most_bytes: int, folds: int = 3, left_out: int = 1
) -> DataFrame:
    """(doc_id, text, label) of ``most_rows`` labelled rows at most, chosen by a
    hash of their ids, none from the fold left out and none over ``most_bytes``.

    Ids are chosen before a text is read; only the chosen ids, bounded in
    number, are broadcast. A document labelled twice takes its highest label.
    """
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .filter(fold(F.col("doc_id"), folds) != left_out)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_rows)
    )
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .filter(F.octet_length("text") <= most_bytes)
    )
