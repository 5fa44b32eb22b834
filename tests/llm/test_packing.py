import random
from collections import defaultdict

import pytest

from tidemark.llm.packing import encoding, pack, token_counts, usage


@pytest.mark.parametrize("seed, capacity, group", [(0, 100, 50_000), (1, 128, 30), (2, 1000, 200), (3, 7, 50_000)])
def test_packing_is_whole_and_fits(spark, seed, capacity, group):
    rng = random.Random(seed)
    sizes = [(k, rng.choice([0, 1, rng.randrange(1, 60), rng.randrange(1, 400), capacity, capacity * 3, None])) for k in range(900)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")
    rows = pack(df, [(1, capacity), (2, 10 * capacity)], group=group).collect()
    for budget, cap in ((1, capacity), (2, 10 * capacity)):
        bins, docs = defaultdict(int), defaultdict(list)
        for r in rows:
            if r.budget_id == budget:
                bins[r.bin_id] += r.n_tokens
                docs[r.doc_id].append((r.start_token, r.n_tokens))
        assert max(bins.values()) <= cap
        assert set(docs) == {k for k, n in sizes if n}
        for k, n in sizes:
            if n:
                at = 0
                for start, held in sorted(docs[k]):
                    assert start == at and held > 0
                    at += held
                assert at == n and len(docs[k]) == -(-n // cap)
        assert sum(bins.values()) / (len(bins) * cap) > 0.5


def test_usage_and_empty(spark):
    df = spark.createDataFrame([(1, 50), (2, 50), (3, 100), (4, 30)], "doc_id bigint, n_tokens bigint")
    row = usage(pack(df, [(9, 100)]), [(9, 100)]).first()
    assert (row.tokens, row.largest, row.bins) == (230, 100, 3)
    assert pack(df.where("false"), [(9, 100)]).count() == 0 and pack(df, []).count() == 0


def test_token_counts(spark):
    own = encoding("/opt/tokenizers", "byte_bpe_50k.tiktoken")
    texts = [(1, "Hello world, <|endoftext|>"), (2, ""), (3, None), (4, "日本語 " * 5000)]
    got = {r.doc_id: r.n_tokens for r in token_counts(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {k: len(own.encode_ordinary(t)) for k, t in texts if t is not None}
    assert own.decode(own.encode_ordinary(texts[3][1])) == texts[3][1]
