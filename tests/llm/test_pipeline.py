import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from posevidence.llm import decontamination, quality_rules
from posevidence.llm.queries import tokenizer_file
from tests_llm_reference import bytes_removed, linked

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after every stage."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, TABLES), "stage")
        seen.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return seen


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_rules_reject_and_keep_whole_rows(spark, stages):
    before, after = stages[0], stages[1]
    kept = {r["doc_id"] for r in quality_rules.verdicts(spark.read.parquet(f"{TABLES}/documents.parquet")).filter("kept").collect()}
    assert {r["doc_id"] for r in after} == kept and 0 < len(after) < len(before)
    assert all(texts(before)[d] == t for d, t in texts(after).items())


def test_one_document_of_each_group_stays(stages):
    before, after = stages[1], stages[2]
    root = linked([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert {r["doc_id"] for r in after} == {d for d, top in root.items() if d == top}


def test_repeated_strings_go(stages):
    before, after = stages[2], stages[3]
    expected = bytes_removed([(r["doc_id"], r["text"]) for r in before], 100)
    assert len(after) == len(before)
    changed = 0
    for row in after:
        raw, gone = expected[row["doc_id"]]
        kept, k = [], 0
        for c in raw.decode():
            size = len(c.encode())
            if not gone[k : k + size].all():
                kept.append(c)
            k += size
        assert row["text"] == "".join(kept) and row["n_chars"] == len(kept)
        changed += row["n_chars"] < len(raw.decode())
    assert changed


def test_benchmark_and_encoding(spark, stages):
    import sentencepiece

    before, after, last = stages[3], stages[4], stages[5]
    docs = spark.createDataFrame(before)
    held = {r["doc_id"] for r in decontamination.contaminated(docs, spark.read.parquet(f"{TABLES}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - held
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    assert len(last) == len(after)
    for row in last:
        assert row["ids"] == library.encode(texts(after)[row["doc_id"]])
        assert row["text"] == texts(after)[row["doc_id"]] and row["n_tokens"] == len(row["ids"])


def test_rows_without_ids_and_repeated_rows(spark, make_docs, hard_rows):
    docs = make_docs(hard_rows).select("doc_id", "text", "lang", "source", "n_chars")
    found = corpus_pipeline.one_of_near_copies(spark, docs, TABLES)
    ids = [r["doc_id"] for r in found.collect()]
    assert ids.count(7) == 1 and ids.count(None) == 1
    assert corpus_pipeline.without_benchmark(spark, docs, TABLES).count() == len(hard_rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), TABLES).count() == 0


def test_rules_leave_columns_of_any_name_alone(spark):
    names = ("kept", "base_failed", "n_lines", "n_words", "symbol_rate", "_words", "_lang", "_document", "most_symbol_rate")
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    wide = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    found = corpus_pipeline.pass_quality_rules(spark, wide, TABLES)
    assert found.columns == wide.columns
    plain = corpus_pipeline.pass_quality_rules(spark, docs, TABLES)
    expected = {r["doc_id"] for r in plain.collect()}
    rows = found.collect()
    assert {r["doc_id"] for r in rows} == expected and len(rows) == plain.count()
    assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)


def test_least_of_rows_with_one_id_stays(spark, make_docs, words):
    texts = [" ".join(words(k, 40)) for k in (11, 12, 13)]
    for order in (texts, texts[::-1]):
        docs = make_docs([(1, t) for t in order] + [(2, None), (2, texts[0])]).repartition(3)
        found = corpus_pipeline.one_of_near_copies(spark, docs, TABLES).filter("doc_id = 1").collect()
        assert [r["text"] for r in found] == [min(texts)] and set(found[0].asDict()) == set(docs.columns)


def test_run(spark, stages):
    found = corpus_pipeline.run(spark, TABLES)
    assert found.agg(F.sum("n_tokens")).first()[0] == sum(r["n_tokens"] for r in stages[5])


def test_fences_come_to_the_texts(spark, tmp_path):
    """Where fences are small and documents are not, no document is moved to meet them."""
    letters = F.concat_ws(" ", *[F.substring(F.sha2(F.concat("id", F.lit(f"/{k}")), 256), 1, 9) for k in range(12)])
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"), letters.alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"),
        F.length(letters).cast("long").alias("n_chars"),
    )
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    default = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "30000")
    try:
        kept = corpus_pipeline.pass_quality_rules(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert 0 < kept.count() <= 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", default)
