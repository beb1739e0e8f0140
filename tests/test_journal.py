"""The followed journal against the batch form, also after a stop in the middle of a batch."""

import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import assemble
from scoreloom.streaming import journal

KIND = "agent string, key string, seq long, value string"


def files(spark, folder, rows, parts):
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], KIND).coalesce(1).write.mode("append").parquet(str(folder))


def test_stream_equals_batch_after_a_stop_between_write_and_commit(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), f"k{rng.randrange(15)}", i, rng.choice(["x", "y", None])) for i in range(120)]
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    files(spark, source, rows, 6)
    stream = lambda: spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(source))
    done = []

    def stop(number):
        done.append(number)
        if number == 2:
            raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        journal.follow(stream(), out, state, ["agent", "key"], ["seq"], after=stop).awaitTermination()
    assert done == [0, 1, 2]
    again = []
    journal.follow(stream(), out, state, ["agent", "key"], ["seq"], after=again.append).awaitTermination()
    assert again[0] == 2 and again[-1] >= 5  # the batch that was not committed runs again
    expected = sorted(map(tuple, assemble.latest(spark.createDataFrame(rows, KIND), ["agent", "key"], [F.col("seq")]).collect()), key=str)
    got = sorted((tuple(r) for r in journal.snapshot(spark, out, ["agent", "key"], ["seq"]).collect()), key=str)
    assert got == expected

    more = [("a", "k1", 500, "late"), ("c", "new", 501, "first"), ("a", "k2", -5, "stale")]
    files(spark, source, more, 1)
    journal.follow(stream(), out, state, ["agent", "key"], ["seq"]).awaitTermination()
    latest = {(r.agent, r.key): r.value for r in journal.snapshot(spark, out, ["agent", "key"], ["seq"]).collect()}
    assert latest["a", "k1"] == "late" and latest["c", "new"] == "first" and latest["a", "k2"] != "stale"
    existing = spark.createDataFrame([("a", "k1", 0, "kept")], KIND)
    recovered = {(r.agent, r.key): r.value for r in journal.snapshot(spark, out, ["agent", "key"], ["seq"], existing).collect()}
    assert recovered == latest | {("a", "k1"): "kept"}
