"""Set-based lifecycle against an event-at-a-time replay over many seeds."""

import random

import pytest
from pyspark.sql import functions as F

from latewin import GuardConfig, LatenessConfig, Mechanism, WindowConfig
from latewin.operators import lateness, lifecycle as lc
from latewin.plans.run import Run
from tests.simulator import simulate

CFG = WindowConfig(60, 10)
SEEDS = range(6)
LAT = LatenessConfig(
    initial=6, minimum=2, maximum=30, history=20, min_observations=20, interval=20
)


def stream(seed, rows=500):
    """Irregular steps, jitter, a few very late events, sudden gaps."""
    rng = random.Random(seed)
    t, out = 1_000_000, []
    for i in range(rows):
        t += rng.choice([0, 1, 1, 2, 3]) + (rng.randint(100, 400) if rng.random() < 0.01 else 0)
        late = rng.choice([0, 0, 0, 1, 2, 5, 9])
        if rng.random() < 0.03:
            late = rng.randint(20, 30 + seed * 40)
        out.append(
            (t - late, f"dev{rng.randrange(3)}", f"s{rng.randrange(2)}", float(rng.randrange(100)))
        )
    return out


STREAMS = {s: stream(s) for s in SEEDS}

VARIANTS = {
    "fixed_budget": (Mechanism("m", "fixed", 5), None),
    "fixed_guard": (
        Mechanism("m", "adaptive", guard=GuardConfig("fixed", 4, 20), lateness=LAT), ("fixed", 4, 20)
    ),
    "fixed_guard_fixed_budget": (
        Mechanism("m", "fixed", 3, guard=GuardConfig("fixed", 0, 30)), ("fixed", 0, 30)
    ),
    "adaptive_guard": (
        Mechanism("m", "adaptive", guard=GuardConfig("adaptive", 4, 10), lateness=LAT),
        ("adaptive", 4, 10),
    ),
}


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    for module in (lateness, lc):
        monkeypatch.setattr(module, "POINT_BLOCK", 3)
        monkeypatch.setattr(module, "BLOCK_ROWS", 64)
    monkeypatch.setattr(lc, "VALUE_BLOCK", 128)
    monkeypatch.setattr(lc, "FANOUT", 4)


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (s, n, *e) for s, evs in STREAMS.items() for n, e in enumerate(evs, 1)
    ]
    df = spark.createDataFrame(
        rows, "seed int, n long, event_time long, device_id string, sensor string, value double"
    )
    return df.withColumn("block", F.floor((F.col("n") - 1) / 50)).repartition(5).cache()


@pytest.mark.parametrize("variant", VARIANTS)
def test_matches_replay(spark, events, variant):
    mech, guard = VARIANTS[variant]
    run = Run(events, mech, CFG, by=["seed"], horizon=40)
    adaptive = vars(mech.lateness) if mech.budget == "adaptive" else None
    cycle = guard[2] if guard else 25
    expect = {
        s: simulate(
            evs, 60, 10, mech.fixed_seconds if not adaptive else None, adaptive, guard,
            (cycle, 40, 3),
        )
        for s, evs in STREAMS.items()
    }
    assert any(e["pairs"]["B"] for e in expect.values())
    if guard:
        assert any(e["pairs"]["C"] for e in expect.values())

    per_event = {s: {} for s in SEEDS}
    for r in run.timed.select("seed", "n", "lateness", "budget", "watermark").collect():
        per_event[r.seed][r.n] = (r.lateness, r.budget, r.watermark)
    for s, e in expect.items():
        got = [per_event[s][n] for n in range(1, len(STREAMS[s]) + 1)]
        assert got == list(zip(e["lateness"], e["budget"], e["watermark"], strict=True))

    keys = {s: {} for s in SEEDS}
    for r in run.keys.collect():
        keys[r.seed][(r.start, r.device_id, r.sensor)] = (r.opened, r.archived, r.released)
    for s, e in expect.items():
        assert keys[s] == {
            k: (n, e["archived"].get(k), e["released"].get(k)) for k, n in e["opened"].items()
        }

    for r in run.late.collect():
        p = expect[r.seed]["pairs"]
        assert (r.reconciled_events, r.late_after_eviction) == (p["B"], p["C"])
        assert r.pairs == sum(p.values())

    for r in run.snapshot.collect():
        e = expect[r.seed]
        assert r.peak_active_state_entries == e["peak_hot"]
        assert r.peak_active_after_archiving == max(h for h, _, _ in e["sizes"])
        assert r.over_budget_events == e["over"]
        assert (
            r.active_state_entries, r.finalized_state_entries, r.frozen_emissions
        ) == e["final"]

    rows = {s: {} for s in SEEDS}
    for r in run.result.collect():
        rows[r.seed][(r.start, r.DeviceId, r.Sensor)] = (
            r["count"], r["sum"], r["min"], r["max"],
        )
    for s, e in expect.items():
        assert rows[s] == e["rows"]

    acc = lc.accounting_cycles(run.timed, run.keys, cycle, 0, 3, ["seed"])
    got = {s: [] for s in SEEDS}
    for r in acc.orderBy("seed", "ordinal").collect():
        got[r.seed].append(
            (r.position, r.events_seen, r.hot_entries, r.archive_entries, r.offloadable_entries)
        )
    for s, e in expect.items():
        assert got[s] == e["accounting"]

    if guard:
        cycles = {s: [] for s in SEEDS}
        for r in lc.eviction_cycles(run.keys, run.cycles, ["seed"]).orderBy("position").collect():
            cycles[r.seed].append((r.position, r.events_seen, r.guard_seconds, r.evicted))
        for s, e in expect.items():
            assert cycles[s] == e["cycles"]

    timeline = lc.tier_timeline(
        run.keys, events.select("seed", F.col("n").alias("position")), ["seed"]
    ).filter("asked")
    sizes = {s: {} for s in SEEDS}
    for r in timeline.collect():
        sizes[r.seed][r.position] = (r.hot, r.archive, r.frozen)
    for s, e in expect.items():
        assert [sizes[s][n] for n in range(1, len(e["sizes"]) + 1)] == e["sizes"]


def test_every_pair_is_classified_once(spark, events):
    run = Run(events, VARIANTS["fixed_guard"][0], CFG, by=["seed"])
    pairs = lc.classify_pairs(run.timed, run.keys, CFG, ["seed"])
    got = {
        (r.seed, r.category): r["count"] for r in pairs.groupBy("seed", "category").count().collect()
    }
    for s in SEEDS:
        assert sum(v for (k, _), v in got.items() if k == s) == 6 * len(STREAMS[s])
    for r in run.late.collect():
        assert got.get((r.seed, "C"), 0) == r.late_after_eviction


def test_drop_or_raise(spark, events):
    run = Run(events, VARIANTS["fixed_guard"][0], CFG, by=["seed"])
    with pytest.raises(RuntimeError, match="late events after eviction"):
        lc.enforce_no_late_after_eviction(run.late)


def test_guard_values(spark):
    rows = spark.createDataFrame([(5, 8, 3)], "budget long, max_lateness long, max_overflow long")
    fixed = rows.select(lc.guard_expression(GuardConfig("fixed", 15)).alias("g")).first().g
    adaptive = rows.select(lc.guard_expression(GuardConfig("adaptive")).alias("g")).first().g
    assert (fixed, adaptive) == (15, 9)
