"""Run by test_history in a process of its own: a wide cluster in small, where stages coalesce differently."""

import random
import sys

from pyspark.sql import SparkSession

from tests.test_history import brute_history
from tidemark.operators.history import build_history


def main(shared: str) -> None:
    conf = {
        "spark.default.parallelism": "100", "spark.sql.shuffle.partitions": "600", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b",
        "spark.ui.enabled": "false", "spark.checkpoint.dir": "file://" + shared, "spark.sql.session.timeZone": "UTC",
    }
    builder = SparkSession.builder.master("local[8]")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.34 else f"e{rng.randrange(400)}", k * 7 % 100_003, rng.choice("aab"), None) for k in range(20_000)]
    frames = [spark.createDataFrame([r for k, r in enumerate(rows) if k % 3 == s], "entity string, start bigint, payload string, stop bigint") for s in range(3)]
    got = build_history(frames, "entity", "start", ["payload"], "stop", block=16).collect()
    have = sorted(((r.entity, r.payload, r["from"], r.until) for r in got), key=str)
    want = brute_history(rows)
    print("missing", len(set(want) - set(have)), "extra", len(set(have) - set(want)), "rows", len(have), len(want))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1])
