import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.conversations import assemble, conversations, role_code, visible

SCHEMA = "session_id string, id string, user_id string, role string, content string, at bigint, junk string"
KNOWN = {"user": "u", "human": "u", "assistant": "a", "model": "a", "bot": "a", "system": "s", "tool": "t"}


def brute(rows):
    by = {}
    for s, i, u, r, c, at, _ in rows:
        if s and s.strip() and i:
            by.setdefault(s, {})[i] = (at, u, KNOWN.get((r or "").strip().lower()), bool(c and c.strip("​ \n　")))
    out = set()
    for s, ms in by.items():
        own = sorted((v[0] is None, v[0] or 0, i) for i, v in ms.items())
        talk = "".join(ms[i][2] for _, _, i in own if ms[i][2] in ("u", "a"))
        ok = all(v[0] is not None and v[1] and v[2] and v[3] for v in ms.values()) and len({v[1] for v in ms.values()}) == 1
        ok = ok and len({v[0] for v in ms.values()}) == len(ms) and talk and talk == "ua" * (len(talk) // 2)
        if ok:
            out |= {(s, k, i) for k, (_, _, i) in enumerate(own)}
    return out


def make(seed, n_sessions, length):
    rng, rows = random.Random(seed), []
    for s in range(n_sessions):
        n = rng.randrange(1, length)
        for k in range(2 * n):
            rows.append([f"s{s}", f"s{s}-{k}", "u1", ["user", "Bot"][k % 2], "hello", 1000 * k + rng.randrange(900), "x"])
            if rng.random() < 0.05:
                rows.append([f"s{s}", f"s{s}-{k}t", "u1", rng.choice(["tool", "System "]), "ok", 1000 * k + 950, "x"])
        if rng.random() < 0.4:
            bad = rng.choice(rows[-n:])
            at, value = rng.choice([(2, "u2"), (2, None), (3, "narrator"), (3, None), (4, " ​"), (4, None), (5, None), (5, rows[-n][5]), (3, "user"), (0, None)])
            bad[at] = value
    rows += [list(r) for r in rng.sample(rows, len(rows) // 4)]
    rng.shuffle(rows)
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("fragment", [64, 7, 2])
def test_whole_sessions_match_brute_force(spark, fragment):
    rows = make(3, 40, 25)
    got = {(r.session_id, r.turn_no, r.id) for r in conversations(spark.createDataFrame(rows, SCHEMA), fragment, min(4, fragment - 1)).collect()}
    want = brute(rows)
    assert len({s for s, _, _ in want}) > 10 and got == want


def test_a_hot_session_is_cut_up_and_put_together(spark):
    rows = [("hot", f"m{k:05}", "u", "user" if k % 2 == 0 else "assistant", "x", k * k if k else -(10**15), None) for k in range(3000)]  # the first one long before
    got = sorted((r.turn_no, r.id) for r in conversations(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(k, f"m{k:05}") for k in range(3000)]


def test_every_session_is_assembled_from_fragments(spark, monkeypatch):
    from tidemark.llm import conversations as module

    seen = []
    monkeypatch.setattr(module, "assemble", lambda f: seen.append(f.select("conv").distinct().count()) or assemble(f))
    rows = [(f"s{s}", f"s{s}-{k}", "u", ["user", "bot"][k % 2], "x", k, None) for s in range(20) for k in range(4)]
    assert module.conversations(spark.createDataFrame(rows, SCHEMA)).count() == 80 and seen == [20]


def test_silence_over_a_fragment_keeps_the_turns(spark):
    rows = [("s", f"m{k:03}", "u", "tool", "x", k, None) for k in range(100)]
    talk = [("s", "m000", "u", "user", "x", 0, None), ("s", "m050", "u", "assistant", "x", 50, None), ("s", "m070", "u", "user", "x", 70, None), ("s", "m099", "u", "assistant", "x", 99, None)]
    at = {r[1] for r in talk}
    whole = [r for r in rows if r[1] not in at] + talk
    assert conversations(spark.createDataFrame(whole, SCHEMA), 8, 2).count() == 100
    broken = [(*r[:3], "assistant", *r[4:]) if r[1] == "m070" else (*r[:3], "user", *r[4:]) if r[1] == "m050" else r for r in whole]
    assert conversations(spark.createDataFrame(broken, SCHEMA), 8, 2).count() == 0


def test_no_rows(spark):
    assert conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversations(spark.createDataFrame([(None, "a", "u", "user", "x", 1, None), (" ", "b", "u", "user", "x", 1, None)], SCHEMA)).count() == 0


def test_fragments_merge_by_overlap(spark):
    rows = [("c", "f1", [1, 2, 3, 4]), ("c", "f2", [3, 4, 5]), ("c", "f3", [5, 6]), ("c", "in", [4, 5]), ("gap", "a", [1, 2]), ("gap", "b", [3, 4]), ("amb", "x", [1, 2]), ("amb", "y", [2, 3]), ("amb", "z", [2, 4]), ("twin", "p", [7, 8]), ("twin", "q", [7, 8])]
    got = {(r.conv, r.frag): (r.offset, r.skip, r.whole) for r in assemble(spark.createDataFrame(rows, "conv string, frag string, hashes array<bigint>")).collect()}
    assert {k: v for k, v in got.items() if k[0] == "c"} == {("c", "f1"): (0, 0, True), ("c", "f2"): (4, 2, True), ("c", "f3"): (5, 1, True)}
    assert not any(v[2] for k, v in got.items() if k[0] in ("gap", "amb"))
    assert [v for k, v in got.items() if k[0] == "twin"] == [(0, 0, True)]


def test_roles_and_visibility(spark):
    df = spark.createDataFrame([(" Human ",), ("MODEL",), ("user/assistant",), ("",), (None,)], "r string")
    assert [r[0] for r in df.select(role_code(F.col("r"))).collect()] == ["u", "a", None, None, None]
    df = spark.createDataFrame([("x",), ("​ \n",), ("ㅤ",), ("。",), (None,)], "c string")
    assert [r[0] for r in df.select(visible(F.col("c"))).collect()] == [True, False, False, True, False]
