"""Hand-worked cases of the causal features, ties and late events, and batch against state."""

import math

import numpy as np
import pandas as pd
import pytest

from sluicegate.operators import features as f
from sluicegate.streaming import stateful
from sluicegate.streaming.stateful import AccountState, GlobalState

SCHEMA = "seq long, t double, account long, category string, amount double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def by_seq(df, name):
    return [r[name] for r in df.orderBy("seq").collect()]


def test_global_ewma(spark):
    df = frame(spark, [(k, float(k), 1, "a", x) for k, x in enumerate([10.0, 20.0, 30.0])])
    assert by_seq(f.ewma_global(df, decay=0.5), "ewma_global") == [10.0, 10.0, 15.0]


def test_count_window(spark):
    df = frame(spark, [(k, float(t), 1, "a", 1.0) for k, t in enumerate([0, 10, 30, 65, 70])])
    assert by_seq(f.count_window(df), "count_window") == [0, 1, 2, 2, 2]


def test_count_window_ties(spark):
    df = frame(spark, [(k, float(t), 1, "a", 1.0) for k, t in enumerate([0, 10, 30, 65, 70, 70, 70, 130])])
    assert by_seq(f.count_window(df), "count_window") == [0, 1, 2, 2, 2, 3, 4, 0]


def test_account_ewma(spark):
    rows = [(0, 0.0, 1, "a", 10.0), (1, 1.0, 2, "a", 100.0), (2, 2.0, 1, "a", 20.0), (3, 3.0, 1, "a", 30.0), (4, 4.0, 2, "a", 200.0)]
    got = by_seq(f.ewma_account(frame(spark, rows), decay=0.5), "ewma_account")
    assert [got[0], got[2], got[3]] == [10.0, 10.0, 15.0]
    assert got[4] == 100.0


def test_footprint(spark):
    prior = {"grocery": 0.3, "gas": 0.7}
    few = frame(spark, [(k, float(k), 1, c, 1.0) for k, c in enumerate(["grocery", "grocery", "gas"])])
    assert by_seq(f.footprint(few, prior), "footprint") == [0.3, 0.3, 0.7]
    many = frame(spark, [(k, float(k), 1, c, 1.0) for k, c in enumerate(["grocery"] * 4 + ["gas", "grocery"])])
    assert by_seq(f.footprint(many, prior), "footprint")[-1] == 0.8
    short = frame(spark, [(k, float(k), 1, c, 1.0) for k, c in enumerate(["gas", "gas", "grocery", "grocery"])])
    assert by_seq(f.footprint(short, prior, last=2, least=2), "footprint")[-1] == 0.5
    unknown = frame(spark, [(0, 0.0, 1, "toys", 1.0)])
    assert by_seq(f.footprint(unknown, prior), "footprint") == [0.0]


def test_expanding_frequency(spark):
    df = frame(spark, [(k, float(k), 1, c, 1.0) for k, c in enumerate(["grocery", "grocery", "gas", "grocery"])])
    assert by_seq(f.expanding_frequency(df, 2), "category_frequency") == pytest.approx([0.5, 2 / 3, 0.25, 0.6])


def test_category_prior(spark):
    df = frame(spark, [(k, 0.0, 1, c, 1.0) for k, c in enumerate(["grocery"] * 2 + ["gas"] * 4)])
    assert {r["category"]: r["prior"] for r in f.category_prior(df).collect()} == pytest.approx({"grocery": 2 / 6, "gas": 4 / 6})


def test_hour(spark):
    assert frame(spark, [(0, 1704122400.0, 1, "a", 1.0)]).select(f.hour_utc().alias("h")).first()["h"] == 15


@pytest.mark.parametrize("n, decay", [(500, 0.98), (300, 0.5)])
def test_global_parity_with_state(spark, n, decay):
    rng = np.random.default_rng(42)
    t, x = np.sort(rng.uniform(0, 10_000, n)), rng.exponential(50, n)
    t[50:60] = t[50]
    rows = [(k, float(t[k]), 1, "abcde"[k % 5], float(x[k])) for k in range(n)]
    df = f.expanding_frequency(f.count_window(f.ewma_global(frame(spark, rows), decay=decay)), 5)
    got = df.orderBy("seq").select("ewma_global", "count_window", "category_frequency").collect()
    state = GlobalState(5, decay=decay)
    for r, (_, when, _, category, amount) in zip(got, rows, strict=True):
        assert list(r) == pytest.approx(list(state.read(amount, category, when)), abs=1e-9)
        state.update(amount, category, when)


def test_account_parity_with_state(spark):
    rng = np.random.default_rng(7)
    rows = [(k, float(k), int(rng.integers(4)), "wxyz"[rng.integers(4)], float(rng.exponential(50))) for k in range(800)]
    prior = {"w": 0.4, "x": 0.3, "y": 0.3}
    got = f.footprint(f.ewma_account(frame(spark, rows)), prior).orderBy("seq").select("ewma_account", "footprint").collect()
    states = {a: AccountState(prior) for a in range(4)}
    for r, (_, when, account, category, amount) in zip(got, rows, strict=True):
        assert list(r) == pytest.approx(list(states[account].read(amount, category)), abs=1e-9)
        states[account].update(amount, category, when)


def test_long_history_keeps_precision(spark):
    rows = [(k, float(k), 1, "a", float(k % 97)) for k in range(12_000)]
    got = by_seq(f.ewma_global(frame(spark, rows)), "ewma_global")
    mean = rows[0][4]
    for k in range(1, len(rows)):
        assert math.isclose(got[k], mean, rel_tol=1e-10)
        mean = 0.98 * mean + 0.02 * rows[k][4]


def test_positions_across_blocks(spark):
    rows = [(k, float(k * 40_000 % 1_000_000), 1, "a", 1.0) for k in range(200)]
    got = {r["seq"]: r["position"] for r in f.with_position(frame(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert all(got[r[0]] == k for k, r in enumerate(order))


def test_history_across_blocks(spark, monkeypatch):
    """Blocks of a hot account see the last events of the block before them."""
    monkeypatch.setattr(f, "HISTORY_BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [(k, float(k // 2), int(k % 10 == 0), "xyz"[rng.integers(3)], 1.0) for k in range(300)]
    got = by_seq(f.footprint(frame(spark, rows), {"x": 0.2}, last=3, least=2), "footprint")
    past: dict = {0: [], 1: []}
    for r, value in zip(rows, got, strict=True):
        h = past[r[2]][-3:]
        assert value == pytest.approx({"x": 0.2}.get(r[3], 0.0) if len(h) < 2 else h.count(r[3]) / len(h))
        past[r[2]].append(r[3])


def test_null_keys_keep_their_rows(spark):
    """A null account and a null category are keys like any other, in every block."""
    rows = [(k, k * 500.0, None if k % 2 else 1, None if k % 3 else "a", float(k)) for k in range(30)]
    got = f.account_features(frame(spark, rows), {"a": 0.5}, decay=0.5).orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(30))
    states, seen = {None: AccountState({}, 0.5), 1: AccountState({}, 0.5)}, {None: 0, "a": 0}
    for k, (r, (_, t, account, category, amount)) in enumerate(zip(got, rows, strict=True)):
        assert r["ewma_account"] == pytest.approx(states[account].read(amount, category)[0])
        assert r["category_frequency"] == pytest.approx((seen[category] + 1) / (k + 1))
        states[account].update(amount, category, t)
        seen[category] += 1


def test_counts_and_positions_of_one_exchange(spark):
    """Counts and positions against brute force: ties, block edges, windows shorter and longer than a block."""
    rng = np.random.default_rng(9)
    t = np.sort(np.r_[rng.uniform(-3000, 3000, 300), np.repeat([-600.0, 0.0, 540.0, 600.0, 1200.0], 4), np.arange(0, 1500, 60.0)])
    df = frame(spark, [(k, float(x), 1, "a", 1.0) for k, x in enumerate(t)])
    for seconds in (60.0, 600.0, 1500.0):
        got = f._count_window(df, seconds=seconds, position="place").orderBy("seq").collect()
        assert [r["place"] for r in got] == list(range(len(t)))
        assert [r["count_window"] for r in got] == [int(((t[:k] > x - seconds)).sum()) for k, x in enumerate(t)]
        assert by_seq(f.count_window(df, seconds=seconds), "count_window") == [r["count_window"] for r in got]


def test_invalid_events_never_enter_state(spark):
    nan = float("nan")
    rows = [(0, 0.0, 1, "a", 10.0), (1, 1.0, 1, "a", nan), (2, 2.0, 1, "a", 10.0), (3, 3.0, 1, "b", None), (4, nan, 1, "a", 5.0), (5, 4.0, 1, "a", 20.0), (6, 5.0, 1, "a", 20.0)]
    got = f.account_features(frame(spark, rows), {"a": 0.5}, decay=0.5).orderBy("seq").collect()
    assert [r["invalid"] for r in got] == [False, True, False, True, True, False, False]
    assert [r["ewma_account"] for r in got] == [10.0, None, 10.0, None, None, 10.0, 15.0]
    assert [r["count_window"] for r in got] == [0, None, 1, None, None, 2, 3]
    state, want = AccountState({"a": 0.5}, 0.5), []
    for _, t, _, c, x in rows:
        if x is not None and math.isfinite(x) and math.isfinite(t):
            want.append(state.read(x, c))
            state.update(x, c, t)
    assert [(r["ewma_account"], r["footprint"]) for r in got if not r["invalid"]] == want
    for one in (f.ewma_account, f.ewma_global, f.count_window):
        assert one(frame(spark, rows)).count() == len(rows)


def test_state_of_a_crowded_stream(spark):
    """Many events at once give what they give one by one, over saved state as well; the cost does not grow with the window."""
    rng = np.random.default_rng(3)
    n = 40_000
    t, x = np.sort(np.round(rng.uniform(0, 5000, n), 1)), rng.exponential(50, n)
    c = [[None, "a", "b", "c"][k] for k in rng.integers(0, 4, n)]
    one, many, got = GlobalState(3, 3600.0), GlobalState(3, 3600.0), []
    for a, b in ((0, 0), (0, 1), (1, 25_000), (25_000, n)):
        many = GlobalState(3, 3600.0, saved=many.saved())
        got += zip(*(v.tolist() for v in many.run(x[a:b], pd.Series(c[a:b], dtype=object), t[a:b])), strict=True)
    for k in range(n):
        assert got[k] == one.read(x[k], c[k], t[k])
        one.update(x[k], c[k], t[k])
    assert (many.saved()[:4], many.counts, many.total) == (one.saved()[:4], one.counts, one.total)


def test_global_stream_in_two_batches(spark, tmp_path):
    rows = [(k, float(k // 3), 1, [None, "a", "b"][k % 3], float(k % 7)) for k in range(600)]
    bad = [(900, 0.0, 1, "a", 5.0), (901, 1e6, 1, "a", None), (902, 1.0, 1, "a", float("inf")), (903, None, 1, "a", 1.0)]
    df = frame(spark, rows)
    for k, part in enumerate((df.where("seq < 350"), df.where("seq >= 350").unionAll(frame(spark, bad)))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stateful.global_features(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 2, 50.0)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = {r["seq"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 604
    assert [(got[k]["late"], got[k]["invalid"], got[k]["count_window"]) for k in range(900, 904)] == [(True, False, None), (False, True, None), (True, True, None), (False, True, None)]
    state = GlobalState(2, 50.0)
    for k, t, _, c, x in rows:
        assert (got[k]["ewma_global"], got[k]["count_window"], got[k]["category_frequency"]) == state.read(x, c, t)
        state.update(x, c, t)
