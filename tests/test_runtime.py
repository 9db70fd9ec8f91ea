"""Session helpers."""

from pyspark.sql import functions as F

from scriptoria import runtime as R


def test_hashed_sample(spark):
    df = spark.range(20_000).select("id", F.lit("same").alias("t"))
    rows = R.hashed_sample(df, 300)
    assert len(rows) == 300 and rows == R.hashed_sample(df.repartition(7), 300)
    assert len(R.hashed_sample(df.limit(10), 300)) == 10 and R.hashed_sample(df.limit(0), 5) == [] and R.hashed_sample(df, 0) == []


def test_salted_join_equals_plain_join(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}", None) for i in range(200)] + [(None, None, None)], "id int, k string, extra string")
    small = spark.createDataFrame([("hot", 1), ("k3", 2), (None, 3), ("zz", 4)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = big.join(small, "k", how)
        assert sorted(map(str, R.salted_join(big, small, ["k"], how).select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_first_delivery(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 3), (2, None, None), (None, "x", 1), (None, "x", 2)], "id int, t string, ingested_at int")
    assert sorted((str(r["id"]), r["ingested_at"]) for r in R.first_delivery(df, "id").collect()) == [("1", 3), ("2", None), ("None", 1)]


def test_lineage_is_cut_into_the_shared_folder(spark):
    cut = R.cut_lineage(spark.range(5).withColumn("x", F.rand()))
    assert "Scan ExistingRDD" in cut._jdf.queryExecution().toString() and cut.collect() == cut.collect()
    assert R.widen(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    class Frame:
        sparkSession = Session()

    import pytest

    with pytest.raises(ValueError):
        R.cut_lineage(Frame())
