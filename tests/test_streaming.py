"""Failure counters of a stream: told at every multiple, over batches, with keys that are null or very frequent."""

from collections import Counter

from lucidtext.streaming import pipeline


def test_triggers_over_batches(spark, tmp_path):
    batches = [["a"] * 7 + ["b"] * 2, ["a"] * 3 + [None] * 5, ["b"] * 9, [None] * 6, []]
    for k, keys in enumerate(batches):
        spark.createDataFrame([(x,) for x in keys], "key string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("key string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    told = pipeline.failure_triggers(stream, every=5).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    told.awaitTermination()
    assert len(told.recentProgress) > 1
    total = Counter(x for keys in batches for x in keys)
    want = sorted((str(key), at) for key, n in total.items() for at in range(5, n + 1, 5))
    assert sorted((str(r.key), r.at) for r in spark.read.schema("key string, at bigint").parquet(f"{tmp_path}/out").collect()) == want
