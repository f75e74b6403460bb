import os

from pyspark.sql import functions as F

from sluicebed.plans.shared import broadcast_below, clear, few_files, join_hot, shared_dir, ship, written


def test_tables_in_the_shared_folder(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k long, v string")
    out = written(df)
    assert out.schema == df.schema and sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    place = out.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(place) and shared_dir(spark).removeprefix("file://") in place
    clear(spark)
    assert not os.path.exists(place)


def test_the_session_names_the_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == named.rstrip("/") if named else shared_dir(spark).startswith("file://")


def test_few_files(spark, tmp_path):
    spark.range(100).repartition(10).write.parquet(str(tmp_path / "t"))
    some = few_files(spark.read.parquet(str(tmp_path / "t")), ["id"], 3)
    assert len(some.inputFiles()) == 3 and 0 < some.count() < 100
    assert few_files(spark.range(5).toDF("id"), ["id"]).count() == 5


def test_code_is_shipped_once(spark):
    ship(spark)
    ship(spark)
    assert sum("sluicebed" in f for f in spark.sparkContext.listFiles) == 1


def test_hot_keys_are_joined_apart(spark):
    big = spark.range(6000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    small = spark.range(0, 6000, 7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    want = sorted(map(tuple, big.join(small, "k").collect()))
    for most in (1, 3, 10_000):
        assert sorted(map(tuple, join_hot(big, small, "k", 6000, most).collect())) == want
    hot = join_hot(big, small, "k", 6000, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in hot and "LeftAnti" in hot
    assert join_hot(big.limit(0), small, "k", 0).count() == 0


def test_small_tables_are_broadcast(spark):
    df = written(spark.range(10).toDF("k"))
    plan = lambda most: spark.range(5).toDF("k").join(broadcast_below(df, most), "k")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(10).lower() and "broadcast" not in plan(9).lower()
