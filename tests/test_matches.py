import numpy as np
import pytest

from tidemark.operators import retrieval as R


def test_every_query_is_answered_in_every_group(spark):
    v = np.random.default_rng(3).normal(size=(60, 4))
    df = spark.createDataFrame([(i, v[i].tolist(), i % 3) for i in range(60)], "id bigint, vector array<double>, label int").repartition(5)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    asked = [i for i in range(60) if i % 10 == 0]
    want = {(q, g): sorted(((-float(u[q] @ u[i]), i) for i in range(60) if i % 3 == g and i != q))[:4] for q in asked for g in range(3)}
    got = {}
    for r in R.best_matches(df.where("id % 10 = 0"), df, 4, "label", block=4).orderBy("score", ascending=False).collect():
        got.setdefault((r.query, r.label), []).append((-r.score, r.id))
    assert {k: [i for _, i in x] for k, x in got.items()} == {k: [i for _, i in x] for k, x in want.items()}
    assert got[0, 1][0][0] == pytest.approx(want[0, 1][0][0])
    assert R.best_matches(df.where("id < 0"), df, 4).count() == 0
