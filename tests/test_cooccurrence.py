from tidemark.operators import graph as G


def test_every_pair_of_a_row_counts_unless_capped(spark):
    links = spark.createDataFrame([(1, n) for n in range(8)] + [(2, 6), (2, 7)], "id int, name int")
    got = {(r.a, r.b): r.n for r in G.cooccurrence(links).collect()}
    assert got == {(a, b): 2 if (a, b) == (6, 7) else 1 for a in range(8) for b in range(a + 1, 8)}
    assert {(r.a, r.b): r.n for r in G.cooccurrence(links, cap=5).collect()} == {(a, b): 1 for a in range(5) for b in range(a + 1, 5)} | {(6, 7): 1}
