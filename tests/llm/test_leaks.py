import random

import numpy as np
import pytest

from tidemark.llm.leaks import WINDOW, Passages, fingerprints, leaks, run_hashes
from tidemark.llm.normal import characters, tokens


def brute(docs, items, share=0.5):
    out = set()
    for i, p in items:
        t = tokens(p or "")
        chinese = sum(len(w) == 1 and "㐀" <= w for w in t) * 2 > len(t)
        n = 4 if chinese else 3
        cut = lambda s: {tuple(s[k : k + n]) for k in range(len(s) - n + 1)}
        own = cut(characters(t) if chinese else t)
        for d, x in docs:
            w = tokens(x or "")
            if own and len(own & cut(characters(w) if chinese else w)) / len(own) >= share:
                out.add((i, d))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdegiklmnorstu") for _ in range(rng.randrange(2, 8)))
    han = [chr(0x4E00 + k) for k in range(400)]
    items = [(k, " ".join(word() for _ in range(rng.randrange(8, 60)))) for k in range(25)] + [(100 + k, "".join(rng.choice(han) for _ in range(80))) for k in range(10)]
    docs = []
    for k in range(300):
        i, p = rng.choice(items)
        w = list(p) if i >= 100 else p.split()
        kind = rng.randrange(6)
        if kind == 0:
            w = w[: int(len(w) * rng.uniform(0.3, 0.8))]
        elif kind == 1:
            w = [word() if rng.random() < 0.1 else x for x in w]
        elif kind == 2:
            rng.shuffle(w)
        elif kind == 3:
            w = [x.upper() + rng.choice(["", ",", "!", "​"]) for x in w]
        elif kind == 4:
            w = [word() for _ in range(40)]
        if kind == 5:  # put a word in after every fourth, or fewer
            step = rng.randrange(4, 7)
            w = [y for k, x in enumerate(w) for y in ([x, word() if i < 100 else rng.choice(han)] if k % step == step - 1 else [x])]
        sep = rng.choice(["", " "]) if i >= 100 else rng.choice([" ", "  ", "\n", " "])
        docs.append((k, " ".join(word() for _ in range(20)) + sep + sep.join(w) + " " + " ".join(word() for _ in range(20))))
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_leaks_match_brute_force(spark, seed):
    docs, items = corpus(seed)
    want = brute(docs, items)
    d = spark.createDataFrame(docs + docs[:5] + [(900, None), (901, ""), (902, "x" * 200_000)], "doc_id bigint, text string")
    i = spark.createDataFrame(items + items[:3] + [(950, None), (951, "two words")], "item_id bigint, passage string")
    got = {(r.item_id, r.doc_id) for r in leaks(d, i).collect()}
    assert len(want) > 50 and got == want
    assert {(r.item_id, r.doc_id) for r in leaks(d, i, passage_chars=1500).collect()} == want


def test_empty_inputs(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([], "item_id bigint, passage string")
    assert leaks(d, i).count() == 0
    assert leaks(d, spark.createDataFrame([(1, "one two three four five")], i.schema)).count() == 0


def test_spellings_do_not_matter():
    assert tokens("Тhe *Quick*­ b​rown-fox") == tokens("the quick brown fox")
    assert tokens("ＦＵＬＬ width") == ["full", "width"]
    assert characters(tokens("我有34只")) == ["我", "有", "3", "4", "只"]


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(0)
    p = Passages([(k, " ".join(f"w{rng.integers(500)}" for _ in range(40))) for k in range(20)], radius=2)
    values, owners, _ = p.index[False, WINDOW[False]]
    for flips in range(3):
        mask = np.zeros(len(values), np.uint64)
        for k in range(len(values)):
            for bit in rng.choice(64, flips, replace=False):
                mask[k] |= np.uint64(1) << np.uint64(bit)
        at, items = p.near(values ^ mask, (False, WINDOW[False]))
        assert set(zip(range(len(values)), owners.tolist(), strict=True)) <= set(zip(at.tolist(), items.tolist(), strict=True))


def test_fingerprint_is_the_majority():
    runs = run_hashes(np.arange(1, 30, dtype=np.uint64), 3)
    a, b, c = runs[:-2], runs[1:-1], runs[2:]
    assert (fingerprints(runs, 3) == ((a & b) | (b & c) | (a & c))).all()
    assert len(run_hashes(np.arange(2, dtype=np.uint64), 3)) == 0


def test_rarity_is_counted_over_all_items_whatever_the_passes(spark):
    docs, items = corpus(7)
    shared = " ".join(f"shared{k}" for k in range(12))
    items = [(k, f"{p} {shared}" if k < 100 and k % 2 else p) for k, p in items]
    d, i = spark.createDataFrame(docs + [(990, shared)], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")
    whole = {(r.item_id, r.doc_id): round(r.held, 9) for r in leaks(d, i, 0.3, rarity=True).collect()}
    assert len(whole) > 20 and {(r.item_id, r.doc_id): round(r.held, 9) for r in leaks(d, i, 0.3, rarity=True, passage_chars=700).collect()} == whole
    even = {(r.item_id, r.doc_id): round(r.held, 9) for r in leaks(d, i, 0.3).collect()}
    assert even != whole and not any(doc == 990 for _, doc in whole)


def test_an_item_may_have_several_passages(spark):
    i = spark.createDataFrame([(1, "one two three four five six seven"), (1, "red green blue cyan pink black white")], "item_id bigint, passage string")
    d = spark.createDataFrame([(1, "x one two three four five six seven"), (2, "red green blue cyan pink black white y"), (3, "none of them")], "doc_id bigint, text string")
    assert sorted((r.item_id, r.doc_id, r.held) for r in leaks(d, i).collect()) == [(1, 1, 1.0), (1, 2, 1.0)]
