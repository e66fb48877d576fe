import random

import pytest

from trackloom.operators import visits
from trackloom.operators.islands import islands, with_previous
from trackloom.operators.ranking import at_index, blocked_rank
from pyspark.sql import functions as F

SCHEMA = "clip_id string, global_id bigint, ms bigint, row_idx bigint, zone_key string"


def table(spark, rows):
    return spark.createDataFrame([(c, g, ms, i, z) for i, (c, g, ms, z) in enumerate(rows)], SCHEMA)


def got(df):
    return sorted((r.clip_id or "", r.global_id, r.zone_key, r.enter_ms, r.exit_ms) for r in df.collect())


def walk(rng, n):
    t, z, rows = 0, None, []
    for _ in range(n):
        t += rng.choice([0, 40, 80, 200, 700, 1500])
        if rng.random() < 0.3:
            z = rng.choice(["a", "b", None])
        rows.append((rng.choice(["k", "k", None]), rng.choice([1, 1, 2]), t, z))
    return rows


def people(rows):
    out = {}
    for i, (c, g, ms, z) in enumerate(rows):
        out.setdefault((c or "", g), []).append((ms, i, z))
    return {k: [(ms, z) for ms, _, z in sorted(v, key=lambda r: r[:2])] for k, v in out.items()}


def held(rows, hold):
    """The row-by-row state machine that the fold over runs must equal."""
    out = []
    for key, seen in people(rows).items():
        zone = since = None
        pending = False
        candidate = started = None

        def commit():
            nonlocal zone, since
            if zone is not None and started > since:
                out.append((*key, zone, since, started))
            zone, since = candidate, started

        for t, z in seen:
            if z == zone and zone is not None:
                pending = False
            elif not pending:
                pending, candidate, started = True, z, t
            elif z != candidate:
                if t - started >= hold:
                    commit()
                candidate, started = z, t
            elif t - started >= hold:
                commit()
                pending = False
        if zone is not None and seen[-1][0] > since:
            out.append((*key, zone, since, seen[-1][0]))
    return sorted(out)


def online(rows, hold):
    out = []
    last = {}
    for c, _, ms, _ in rows:
        last[c or ""] = max(ms, last.get(c or "", ms))
    for key, seen in people(rows).items():
        zone, since = seen[0][1], seen[0][0]
        candidate, started = zone, since
        for t, z in seen[1:]:
            if z == zone:
                candidate, started = zone, t
            elif z != candidate:
                candidate, started = z, t
            elif t - started >= hold:
                if zone is not None:
                    out.append((*key, zone, since, t))
                zone, since, candidate, started = z, t, z, t
        if zone is not None and last[key[0]] > since:
            out.append((*key, zone, since, last[key[0]]))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_hysteresis_and_online_equal_row_by_row(spark, seed):
    rows = walk(random.Random(seed), 400)
    assert got(visits.held_visits(table(spark, rows), 500)) == held(rows, 500)
    assert got(visits.online_visits(table(spark, rows), 500)) == online(rows, 500)


def test_change_visits_close_at_the_next_run(spark):
    rows = [("k", 1, 0, "a"), ("k", 1, 100, "a"), ("k", 1, 300, None), ("k", 1, 400, "a"), ("k", 1, 400, "b"), ("k", 1, 900, "b")]
    assert got(visits.change_visits(table(spark, rows))) == [("k", 1, "a", 0, 300), ("k", 1, "b", 400, 900)]


def test_sessions_and_capped_dwell(spark):
    rows = [("k", 1, t, "a") for t in (0, 100, 1100, 2101, 2201, 9000)]
    assert got(visits.zone_sessions(table(spark, rows), 1000)) == [("k", 1, "a", 0, 1100), ("k", 1, "a", 2101, 2201), ("k", 1, "a", 9000, 9000)]
    capped = visits.capped_visits(table(spark, rows), 1000, 200, 300).collect()
    assert [(r.enter_ms, r.exit_ms, r.dwell_ms) for r in capped] == [(0, 1100, 300)]


def test_nothing_in_nothing_out(spark):
    empty = table(spark, [])
    for f in (visits.zone_sessions, visits.capped_visits, visits.change_visits, visits.held_visits, visits.online_visits):
        assert f(empty).collect() == []


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_blocks_do_not_change_previous_rows_islands_or_ranks(spark, width):
    rng = random.Random(1)
    rows = [(rng.choice(["h", "h", None]), 1, rng.randint(0, 500), rng.choice("ab")) for _ in range(300)]
    df = table(spark, rows)
    block = F.floor(F.col("ms") / width)
    groups = {}
    for i, (c, _, ms, z) in enumerate(rows):
        groups.setdefault(c, []).append((ms, i, z))
    want_prev, want_island, want_rank = {}, {}, {}
    for g in groups.values():
        island, before = 0, None
        for k, (ms, i, z) in enumerate(sorted(g)):
            if before is None or ms - before[0] > 3:
                island += 1
            want_prev[i], want_island[i], want_rank[i] = before and before[1], island, k + 1
            before = (ms, i)
    keys, order = ["clip_id"], ["ms", "row_idx"]
    assert {r.row_idx: r.prev and r.prev.row_idx for r in with_previous(df, keys, order, block, ["row_idx"]).collect()} == want_prev
    assert {r.row_idx: r.island for r in islands(df, keys, order, block, ["ms"], lambda p: F.col("ms") - p["ms"] > 3).collect()} == want_island
    assert {r.row_idx: r.k for r in blocked_rank(df, keys, order, block, "k").collect()} == want_rank
    middle = {r.clip_id: r.m for r in at_index(df, keys, "ms", block, {"m": lambda n: F.floor(n / 2)}).collect()}
    assert middle == {c: sorted(x[0] for x in g)[len(g) // 2] for c, g in groups.items()}
