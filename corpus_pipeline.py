"""Documents to token ids: rules, near copies, repeats, benchmark, encoding.

Every stage takes what the one before kept, as a written table, and returns the
columns of ``documents``; the last one returns ids and the text they stand for.
Rows without an id pass the stages that compare documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posevidence.llm import decontamination, ngram_join, quality_rules, sentencepiece_bpe, suffix_dedup
from posevidence.llm.common import importable, stored
from posevidence.llm.queries import tokenizer_file


def pass_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules of their language and source accept."""
    importable(spark)
    # Written with its texts, so the verdict's filter reads counts and does not
    # work them out again inside its condition. The row rides in one column, whose
    # name no count has, so that columns of the documents clash with none.
    rows = docs.select("text", "lang", "source", F.struct(*docs.columns).alias("_document"))
    counted = stored(quality_rules.measured(rows).drop("text"), "quality-counts")
    # Fences are written too: by their written size the join knows from the start
    # whether they can be handed to every task, and no text is moved to meet them.
    bounds = stored(quality_rules.fences(counted), "quality-fences")
    kept = quality_rules.judged(counted, bounds).filter("kept")
    return kept.select(*[F.col("_document").getField(c).alias(c) for c in docs.columns])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by four fifths of their 5-word shingles, the one with
    the smallest id; of rows with equal ids the one with the least text,
    then lang, source and n_chars."""
    importable(spark)
    found = ngram_join.near_duplicates(docs, width=5, percent=80)
    first = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    # Which of several rows stays must not hang on the order in which they come.
    place = F.struct("text", "lang", "source", "n_chars")
    row = F.struct(*docs.columns)
    one = docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, place).alias("_row"))
    one = one.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
    return one.unionByName(docs.filter(F.col("doc_id").isNull())).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the characters of strings of 100 bytes that stand earlier."""
    importable(spark)
    carried = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    found = suffix_dedup.without_repeats(docs, 100, whole_characters=True, carried=carried)
    text = F.col("kept").cast("string")
    return found.withColumns({"text": text, "n_chars": F.length(text).cast("long")}).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark question."""
    importable(spark)
    held = decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(held.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the text decoded from them."""
    importable(spark)
    model = tokenizer_file("piece_bpe_32k.model")
    found = sentencepiece_bpe.decoded(sentencepiece_bpe.encoded(docs, model), model, text="text")
    return found.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality rules", pass_quality_rules),
    ("n-gram Jaccard join", one_of_near_copies),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece encoding and decoding", encoded),
]

#: Near copies, byte strings and pieces are beyond SQL; tests compare the stages
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
