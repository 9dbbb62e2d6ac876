"""The stream limiter against the limiter of a bounded table."""

import random

import pytest
from pyspark.sql import functions as F

from pairwright.streaming import rate_limit as rl


def _rows():
    draw = random.Random(2)
    hot = [(i, 1, draw.randint(0, 4000)) for i in range(400)]
    rest = [(400 + i, draw.choice([2, 3, 4, None]), draw.randint(0, 4000)) for i in range(150)]
    return [*hot, *rest, (600, 1, 4000), (601, 1, 4000), (602, 5, 4000)]


@pytest.mark.parametrize("slot_seconds", [7, 100_000])
def test_a_stream_out_of_order_decides_as_the_table(spark, tmp_path, slot_seconds):
    rows = _rows()
    events = spark.createDataFrame(rows, "id bigint, who bigint, s bigint").select(
        "id", "who", F.timestamp_seconds("s").alias("ts")
    )
    for k in (2, 0, 1):  # each batch spans all times
        events.where(f"id % 3 = {k}").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = rl.limit_to_the_end(
        stream, f"file://{tmp_path}/out", f"file://{tmp_path}/scratch", "who", "ts", "id", limit=3, window_seconds=60,
        lateness="2 hours", slot_seconds=slot_seconds,
    )
    want = rl.rate_limit_flags(events, "who", "ts", "id", limit=3, window_seconds=60)
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(got) == order(want) and got.count() == len(rows)
    assert 0 < got.where("allowed").count() < len(rows)


def test_an_empty_stream_closes(spark, tmp_path):
    spark.createDataFrame([], "id bigint, who bigint, ts timestamp").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("id bigint, who bigint, ts timestamp").parquet(f"file://{tmp_path}/in")
    got = rl.limit_to_the_end(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/scratch", "who", "ts", "id")
    assert got.count() == 0
