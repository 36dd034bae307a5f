"""Ledgers of chains of steps, counts from footers."""

from pyspark.sql import functions as F

from runlens.operators import chain, profile
from runlens.operators.chain import Step

STEPS = [
    Step("strict", keep=lambda: F.col("raw").rlike("^[0-9]+$")),
    # a strict cast: it must never see the rows dropped before
    Step("number", columns=lambda: {"n": F.col("raw").cast("int"), "twice": F.col("raw").cast("int") * 2}),
    Step("first", first=(["k", "n"], ["pos"])),
    Step("small", keep=lambda: F.col("twice") < 8),
    Step("per_key", first=(["k"], ["n", "pos"])),
    Step("positive", keep=lambda: F.col("n") > 0),
]


def rows(spark, n=3000):
    df = spark.range(n).select(
        F.col("id").alias("pos"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
        F.when(F.col("id") % 11 == 0, "bad").when(F.col("id") % 13 == 0, None).otherwise((F.col("id") % 7).cast("string")).alias("raw"),
    )
    return df.repartition(6)


def plainly(df, steps):
    out = [df.count()]
    for step in steps:
        df = step(df)
        out.append(df.count())
    return out


def test_one_pass_counts_what_the_steps_do(spark):
    df = rows(spark)
    want = plainly(df, STEPS)
    got = chain.ledger(df, STEPS).orderBy("seq").collect()
    assert [r["step"] for r in got] == [s.name for s in STEPS]
    assert [got[0]["rows_in"], *[r["rows_out"] for r in got]] == want and len(set(want)) > 4
    assert [r["cols_delta"] for r in got] == [0, 2, 0, 0, 0, 0] and all(r["pass_ms"] > 0 for r in got)
    assert chain.apply_steps(df, STEPS).count() == want[-1]
    empty = chain.ledger(df.limit(0), STEPS).collect()
    assert all(r["rows_in"] == r["rows_out"] == 0 for r in empty) and len(empty) == 6


def test_the_input_is_scanned_once(spark, tmp_path):
    rows(spark).write.parquet(str(tmp_path / "t"))
    plan = chain.follow(spark.read.parquet(str(tmp_path / "t")), STEPS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_staged_ledger_times_plain_functions(spark):
    def evens(df):
        return df.filter("pos % 2 = 0")

    def wide(df):
        return df.withColumns({"a": F.lit(1), "b": F.lit(2)}).drop("raw")

    result, ledger = chain.staged_ledger(rows(spark), [evens, wide, Step("last", first=(["k"], ["pos"]))])
    got = ledger.orderBy("seq").collect()
    assert [(r["step"], r["rows_in"], r["rows_out"], r["cols_delta"]) for r in got][:2] == [("evens", 3000, 1500, 0), ("wide", 1500, 1500, 1)]
    assert result.columns == ["pos", "k", "a", "b"] and all(r["ms"] > 0 for r in got)


def test_counts_come_from_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    rows(spark).withColumn("list", F.array("pos")).write.parquet(path)
    with profile.footers_only(spark):
        plan = profile.counts(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT" in plan
    got = {r["name"]: (r["rows"], r["filled"]) for r in profile.footer_counts(spark, path).collect()}
    table = spark.read.parquet(path)
    assert got == {c: (3000, table.filter(F.col(c).isNotNull()).count()) for c in ("pos", "k", "raw")}
    assert "BatchScan" not in spark.read.parquet(path)._jdf.queryExecution().executedPlan().toString()
