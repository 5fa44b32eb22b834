"""Episodes, context and episode search by the time of the messages, against brute force."""

import random
from datetime import datetime, timedelta, timezone

import pytest

import __spark_entry__ as entry

SCENARIOS = "id string, kind string, user_id string, session_id string, role string, content string, timestamp string"
START = datetime(2024, 3, 1, tzinfo=timezone.utc)


def spelled(t, how):
    """One instant as text: UTC, an offset, epoch seconds, or the wall clock of Tokyo."""
    if how == 0:
        return t.strftime("%Y-%m-%dT%H:%M:%SZ")
    if how == 1:
        return t.astimezone(timezone(timedelta(hours=-5))).strftime("%Y-%m-%dT%H:%M:%S-05:00")
    if how == 2:
        return str(int(t.timestamp()))
    return t.astimezone(timezone(timedelta(hours=9))).strftime("%Y-%m-%d %H:%M:%S")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(5)
    rows, kept = [], []
    for s in range(40):
        for k in range(r.randint(1, 12)):
            t = None if r.random() < 0.1 else START + timedelta(seconds=r.randint(0, 10**6))
            content = " ".join(r.choice(["bowl", "walk", "collar" if r.random() < 0.3 else "leash", "lighthouse" if r.random() < 0.1 else "harbour"]) for _ in range(r.randint(1, 30)))
            row = (f"e{s:02}-{k:02}", "event", "u", f"s{s:02}", r.choice(["user", " User ", "assistant"]), content, "soon" if t is None else spelled(t, r.randint(0, 3)))
            kept.append((row, None if t is None else int(t.timestamp()) * 1_000_000))
            rows += [row] * r.choice([1, 1, 2])
    rows += [("m", "memory", "u", "s00", "user", "collar", "2020-01-01T00:00:00Z"), ("n", "event", "u", None, "user", "collar", "2020-01-01T00:00:00Z"), ("o", "event", "u", "s00", "user", None, "2020-01-01T00:00:00Z")]
    r.shuffle(rows)
    d = str(tmp_path_factory.mktemp("timed"))
    spark.createDataFrame(rows, SCENARIOS).write.parquet(f"{d}/scenarios.parquet")
    spark.createDataFrame([("u", "Asia/Tokyo", "ja-JP")], "user_id string, home_zone string, locale string").write.parquet(f"{d}/owners.parquet")
    sessions = {}
    for row, at in kept:
        sessions.setdefault(row[3], []).append((at is None, at or 0, row[0], at, row[4], row[5]))
    return d, {s: sorted(m) for s, m in sessions.items()}


def summary(messages):
    return "\n".join(m[5] for m in messages[:5])[:2000]


def test_episodes_are_compacted_by_time(spark, tables):
    d, sessions = tables
    got = {r.session_id: r for r in entry.queries()["x6_compact_timed"](spark, d).collect()}
    assert got.keys() == sessions.keys()
    for s, messages in sessions.items():
        times = [m[3] for m in messages if m[3] is not None]
        title = next((m[5] for m in messages if m[4].strip().lower() == "user"), None)
        title = title if title is None or len(title) <= 60 else title[:60] + "..."
        assert (got[s].summary, got[s].title, got[s].n) == (summary(messages), title, len(messages))
        assert (got[s].start_at, got[s].end_at) == (min(times, default=None), max(times, default=None))


def test_context_is_the_newest_within_the_budget(spark, tables):
    d, sessions = tables
    want, used = [], 0
    # rows without an instant are the oldest here: nothing tells that they are new
    for m in sorted(sessions["s00"], key=lambda m: (m[3] is not None, m[1], m[2]), reverse=True):
        used += len(m[5]) // 4 + 10
        if used > 150:
            break
        want.insert(0, m[2])
    assert [r.id for r in entry.queries()["x13_session_context_timed"](spark, d).collect()] == want


def test_episode_search_reads_the_first_messages_by_time(spark, tables):
    import math

    d, sessions = tables
    words = {s: summary(m).split() for s, m in sessions.items()}
    average = sum(map(len, words.values())) / len(words)
    score = dict.fromkeys(words, 0.0)
    for term in ("collar", "lighthouse"):
        df = sum(term in w for w in words.values())
        for s, w in words.items():
            score[s] += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * w.count(term) * 2.2 / (w.count(term) + 1.2 * (0.25 + 0.75 * len(w) / average))
    want = sorted(((-round(x, 9), s) for s, x in score.items() if x > 0))[:10]
    got = entry.queries()["r22_episode_search_timed"](spark, d).collect()
    assert [r.id for r in got] == [s for _, s in want]
    assert [r.score for r in got] == pytest.approx([-x for x, _ in want], abs=1e-5)
