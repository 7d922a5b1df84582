from pyspark.sql import functions as F

from posevidence.operators.sequences import distinct_in_pieces


def test_one_key_with_very_many_values(spark):
    """A hundred thousand values twice over: no cell beyond the size, none lost."""
    many = spark.range(200_000).select(F.lit("hot").alias("k"), F.concat(F.lit("U "), (F.col("id") % 100_000).cast("string")).alias("v"))
    few = spark.createDataFrame([(None, "b"), (None, "a"), ("", "a"), ("", None), ("none", None)], "k string, v string")
    found = distinct_in_pieces(many.unionByName(few), ["k"], "v", 1000, "|").collect()
    hot = sorted((r for r in found if r.k == "hot"), key=lambda r: r.piece)
    assert [r.piece for r in hot] == list(range(1, 101)) and {r.n_values for r in hot} == {1000}
    values = [v for r in hot for v in r.seen.split("|")]
    assert values == sorted(f"U {i}" for i in range(100_000))
    assert all((r.first_value, r.last_value) == (r.seen.split("|")[0], r.seen.split("|")[-1]) for r in hot)
    rest = {r.k: (r.piece, r.n_values, r.seen) for r in found if r.k != "hot"}
    assert rest == {None: (1, 2, "a|b"), "": (1, 1, "a")}


def test_several_keys_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "x", "c"), (1, "x", "c"), (1, "y", "a"), (1, "x", "b"), (2, None, "d")], "n int, k string, v string")
    found = distinct_in_pieces(rows, ["n", "k"], "v", 1)
    assert found.dtypes[:3] == [("n", "int"), ("k", "string"), ("piece", "bigint")]
    assert sorted((r.n, r.k or "-", r.piece, r.seen) for r in found.collect()) == [(1, "x", 1, "b"), (1, "x", 2, "c"), (1, "y", 1, "a"), (2, "-", 1, "d")]
    assert distinct_in_pieces(rows.limit(0), ["k"], "v").count() == 0
