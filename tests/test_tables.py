import pytest
from pyspark.sql import functions as F

from tidemark import tables as T


def test_written_tables_are_kept_until_forgotten(spark):
    T.forget_stages(spark)
    df = T.written(spark.range(5).withColumn("x", F.lit("a")))
    assert df.count() == 5 and [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in spark.range(1).withColumn("x", F.lit("a")).schema]
    assert T.forget_stages(spark) == 1 and T.forget_stages(spark) == 0


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()  # noqa: N815

    with pytest.raises(ValueError):
        T.shared_dir(Session())


def test_current_rows_are_those_of_the_largest_version(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z"), (None, 9, "n")]
    got = T.current_memories(spark.createDataFrame(rows, "id string, sync_version bigint, v string"), "v")
    assert sorted(tuple(r) for r in got.collect()) == [("a", "y"), ("b", "z")]
