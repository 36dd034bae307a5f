"""Extra columns with clashing names, empty tables, what is left behind."""

import pytest
from llm_rows import docs, no_rows, odd  # noqa: F401
from pyspark.sql import functions as F

from runlens.llm import byte_bpe, lineruns, packing, queries, sharding
from runlens.llm.rows import ID, TIE, keyed, sifted


def test_pipeline_stages_keep_the_columns_of_the_user(spark, docs):
    """Names that the operators make themselves are other columns of the documents here."""
    import corpus_pipeline

    names = ["n_lines", "n_dropped", "kept", "n_words", "word_chars", "probability", "base_failed", "removed", "component_id", "size", "digest", "start"]
    text = " ".join(f"word{i} and more of it" for i in range(30))
    table = docs([(i, f"{text} {i}\nline {i} of this one\n{'x' * i}") for i in range(4)])
    own = {n: F.lit(f"own {n}") for n in names}
    out = table.select("doc_id", *[c.alias(n) for n, c in own.items()], "text")
    want = out.columns
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, out, "unused").cache()
        assert out.columns == want and out.count() > 0
        for n in names:
            assert {r[0] for r in out.select(n).distinct().collect()} == {f"own {n}"}


def test_clashing_columns_of_single_operators(docs):
    table = docs([(1, "a\nb"), (2, "a"), (None, None)])
    shards = sharding.shard(table.withColumns({"extra": F.lit("e"), "shard": F.lit(7), "slot": F.lit("s")}), "doc_id", "text")
    assert shards.count() == 3 and {r["extra"] for r in shards.collect()} == {"e"} and dict(shards.dtypes)["slot"] == "bigint"
    lines = lineruns.dedup(table.withColumns({"digest": F.lit("d"), "batch": F.lit("b"), "n_lines": F.lit("mine")}))
    assert {(r["digest"], r["batch"]) for r in lines.collect()} == {("d", "b")} and dict(lines.dtypes)["n_lines"] == "bigint"
    pieces = table.select("doc_id", F.lit("x").alias("room"), F.lit(b"\1\0\0\0\2\0\0\0").alias("ids"), F.lit("z").alias("start"))
    out = packing.cut(pieces, "ids").collect()
    assert [(r["room"], r["start"], r["length"], r["doc_tokens"]) for r in out] == [("x", 0, 2, 2)] * 3


def test_empty_tables(spark, no_rows, tmp_path):
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = no_rows.select("doc_id", byte_bpe.encode(F.col("text"), *vocabulary).alias("ids"))
    assert coded.withColumn("back", byte_bpe.decode(F.col("ids"), *vocabulary)).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    none.write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("op6_topk", "op11_centroids", "op12_hashing", "op13_whitening"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_line_runs_leave_no_tables(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    out = lineruns.dedup(docs([(i, "common\nown %d" % i) for i in range(40)]))
    assert out.agg(F.sum("n_dropped")).first()[0] == 40
    assert {t.name for t in spark.catalog.listTables()} == before


@pytest.mark.parametrize("wanted", ["false", "doc_id % 10 = 3 or doc_id is null", "true"])
def test_a_sieve_loses_nothing(spark, wanted):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    rows = keyed(rows.unionByName(spark.createDataFrame([(None, "x"), (7, None)], "doc_id long, text string")), "doc_id", "text")
    own = rows.where(wanted)
    kept = sifted(rows, own.select(ID, TIE))
    assert kept.columns == rows.columns and own.exceptAll(kept).count() == 0
    assert kept.count() <= own.count() + 40
