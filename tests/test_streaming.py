from tidemark.streaming.ingest import gap_sessions, ingest, split_batch, payload_hash


def test_stream_appends_once_and_rejects_conflicts(spark, tmp_path):
    source, store, rejected = (str(tmp_path / x) for x in ("in", "store", "rejected"))
    schema = "event_id string, role string, content string"

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        ingest(spark, stream, "event_id", ["role", "content"], store, rejected, str(tmp_path / "cp")).awaitTermination()

    spark.createDataFrame([("1", "user", "a"), ("2", "user", None), ("2", "user", None), ("3", "user", "x"), ("3", "user", "y")], schema).write.mode("append").parquet(source)
    run()
    spark.createDataFrame([("1", "user", "a"), ("2", "user", "changed"), ("4", "user", "b")], schema).write.mode("append").parquet(source)
    run()
    run()  # nothing new
    assert sorted(r.event_id for r in spark.read.parquet(store).collect()) == ["1", "2", "4"]
    assert sorted((r.event_id, r.content) for r in spark.read.parquet(rejected).collect()) == [("2", "changed"), ("3", "x"), ("3", "y")]


def test_replays_are_told_from_conflicts(spark):
    schema = "event_id string, content string"
    old = payload_hash(spark.createDataFrame([("1", "a"), ("2", "b")], schema), ["content"])
    new = payload_hash(spark.createDataFrame([("1", "a"), ("2", "c"), ("3", None)], schema), ["content"])
    parts = [[r.event_id for r in p.collect()] for p in split_batch(old, new, "event_id")]
    assert parts == [["3"], ["1"], ["2"]]


def test_gap_sessions(spark):
    df = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 01:00:00"), ("u", "2024-01-01 05:00:00")], "u string, t string").selectExpr("u", "cast(t as timestamp) as t")
    assert sorted(r.n for r in gap_sessions(df, "t", "2 hours", "u").collect()) == [1, 2]


def test_hooks_get_their_events_and_may_fail(spark, tmp_path):
    from tidemark.streaming.ingest import hooked

    source, out = str(tmp_path / "in"), tmp_path / "out"
    out.mkdir()
    schema = "event string, id string, data string"
    spark.createDataFrame([("ADD", "1", "a"), ("DELETE", "2", "b"), ("ADD", "3", "c")], schema).write.parquet(source)
    folder = str(out)

    def write(rows):
        import os
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(",".join(r.id for r in rows))

    def fail(rows):
        raise ValueError("down")

    hooked(spark.readStream.schema(schema).parquet(source), [({"ADD"}, fail), ({"ADD"}, write)], str(tmp_path / "cp")).awaitTermination()
    assert sorted(x for p in out.iterdir() for x in p.read_text().split(",")) == ["1", "3"]
