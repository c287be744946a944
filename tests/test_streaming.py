from pyspark.sql import functions as F

from tessera.streaming import ops


def stream(spark, sf, tmp_path, files=3):
    """The events as a file stream of several files."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartitionByRange(files, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), e


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_count_trigger_equals_its_batch_twin(spark, sf, tmp_path):
    s, e = stream(spark, sf, tmp_path, 1)
    shape = lambda d: d.select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), "ts")
    ops.available_now(ops.count_trigger(shape(s)), "fired", str(tmp_path / "c"))
    assert rows(spark.table("fired")) == rows(ops.count_trigger_batch(shape(e)))


def test_latest_and_counts(spark, sf, tmp_path):
    s, e = stream(spark, sf, tmp_path)
    ops.available_now(ops.latest_by_key(s, ["user_id"], "event_type", "ts"), "latest", str(tmp_path / "c1"), "complete")
    assert rows(spark.table("latest")) == rows(ops.latest_by_key(e, ["user_id"], "event_type", "ts"))
    key = lambda d: d.select(F.col("event_type").alias("keyword"))
    ops.available_now(ops.keyword_counts(key(s)), "counts", str(tmp_path / "c2"), "complete")
    assert rows(spark.table("counts")) == rows(ops.keyword_counts(key(e)))


def test_once_within_a_watermark(spark, sf, tmp_path):
    s, e = stream(spark, sf, tmp_path, 1)
    ops.available_now(ops.once(s.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "365 days"), "once", str(tmp_path / "c"))
    assert spark.table("once").count() == e.select("user_id", "event_type").distinct().count()


def test_dispatch_by_threshold(spark):
    seen = []
    f = ops.upsert_each_batch(lambda b, i: seen.append((i, b.count())), ops.enough_pending(5))
    for i, n in enumerate((0, 4, 5, 9)):
        f(spark.range(n), i)
    assert seen == [(2, 5), (3, 9)]
