"""Stateful offsets over several micro-batches."""

from pyspark.sql import functions as F

from millrace.streaming.stateful import with_offsets


def test_dense_over_micro_batches(spark, tmp_path):
    for i in range(3):
        spark.range(i * 40, i * 40 + 40).select("id", F.when(F.col("id") % 10 != 9, F.concat(F.lit("t"), F.col("id") % 3)).alias("t"), F.encode(F.col("id").cast("string"), "UTF-8").alias("c")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, t string, c binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = with_offsets(stream, "t", "c", "id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault(r.topic, []).append((r.offset, int(bytes(r.content))))
    for t in range(3):
        assert sorted(got[f"t{t}"]) == list(enumerate(i for i in range(120) if i % 3 == t and i % 10 != 9))
