"""Visits of persons to zones from their boxes: five definitions that differ on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.islands import fold_sorted, islands

#: Width in milliseconds of the blocks into which a track's rows are cut.
BLOCK_MS = 600_000
_PERSON = ["clip_id", "global_id"]


def zone_sessions(rows: DataFrame, gap_ms: int = 1000) -> DataFrame:
    """Sessions of (clip_id, global_id, zone_key): a new one where the pause is longer than ``gap_ms``.

    ``rows``: clip_id, global_id, zone_key, ms, row_idx. Rows without zone or time are left out, unassigned ids stay.
    """
    keys = [*_PERSON, "zone_key"]
    inside = rows.where("zone_key IS NOT NULL AND ms IS NOT NULL")
    numbered = islands(inside, keys, ["ms", "row_idx"], F.floor(F.col("ms") / BLOCK_MS), ["ms"], lambda prev: F.col("ms") - prev["ms"] > gap_ms)
    return numbered.groupBy(*keys, F.col("island").alias("visit")).agg(F.min("ms").alias("enter_ms"), F.max("ms").alias("exit_ms"), F.count(F.lit(1)).alias("n_rows"))


def capped_visits(rows: DataFrame, gap_ms: int = 1000, cap_ms: int = 200, least_ms: int = 500) -> DataFrame:
    """Sessions as in ``zone_sessions`` whose dwell counts every pause with at most ``cap_ms``; of two rows and ``least_ms`` at least.

    The dwell differs from exit minus enter: it leaves out what the detector missed.
    """
    keys = [*_PERSON, "zone_key"]
    inside = rows.where("zone_key IS NOT NULL AND ms IS NOT NULL")
    block = F.floor(F.col("ms") / BLOCK_MS)
    numbered = islands(inside, keys, ["ms", "row_idx"], block, ["ms"], lambda prev: F.col("ms") - prev["ms"] > gap_ms)
    # Pauses within a session: its rows are few enough for a window of its own key.
    within = Window.partitionBy(*keys, "island").orderBy("ms", "row_idx")
    before = F.lag("ms").over(within)
    paused = numbered.withColumn("pause", F.when(before.isNotNull(), F.least(F.col("ms") - before, F.lit(cap_ms))))
    return (
        paused.groupBy(*keys, F.col("island").alias("visit"))
        .agg(F.min("ms").alias("enter_ms"), F.max("ms").alias("exit_ms"), F.coalesce(F.sum("pause"), F.lit(0)).alias("dwell_ms"), F.count(F.lit(1)).alias("n_rows"))
        .where((F.col("n_rows") >= 2) & (F.col("dwell_ms") >= least_ms))
    )


def zone_runs(rows: DataFrame) -> DataFrame:
    """Maximal runs of one zone (or none) along a person's rows: zone_key, first_ms, last_ms, next_ms (start of the next run), n_rows."""
    timed = rows.where("ms IS NOT NULL")
    numbered = islands(timed, _PERSON, ["ms", "row_idx"], F.floor(F.col("ms") / BLOCK_MS), ["zone_key"], lambda prev: ~prev["zone_key"].eqNullSafe(F.col("zone_key")))
    runs = numbered.groupBy(*_PERSON, F.col("island").alias("run")).agg(
        F.first("zone_key").alias("zone_key"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count(F.lit(1)).alias("n_rows")
    )
    following = Window.partitionBy(*_PERSON).orderBy("run")
    return runs.withColumn("next_ms", F.lead("first_ms").over(following))


def change_visits(rows: DataFrame) -> DataFrame:
    """Runs as visits: left when the next run begins, the last one at its own last row; those of no length are left out."""
    visits = zone_runs(rows).where("zone_key IS NOT NULL").withColumn("exit_ms", F.coalesce("next_ms", "last_ms"))
    return visits.where("exit_ms > first_ms").select(*_PERSON, "zone_key", F.col("first_ms").alias("enter_ms"), "exit_ms")


class _Held:
    """Hysteresis over runs: a zone holds once it was seen for ``hold`` milliseconds, counted back to its first row."""

    def __init__(self, key: tuple, hold: int) -> None:
        self.key, self.hold = key, hold
        self.zone, self.since = None, None
        self.candidate: tuple | None = None
        self.last = None

    def _commit(self):
        zone, start = self.candidate
        if self.zone is not None and start > self.since:
            yield (*self.key, self.zone, self.since, start)
        self.zone, self.since = zone, start if zone is not None else None

    def step(self, row):
        zone = None if row.zone_key is None or row.zone_key != row.zone_key else row.zone_key
        first, self.last = int(row.first_ms), int(row.last_ms)
        if zone is not None and zone == self.zone:
            self.candidate = None
            return
        if self.candidate is not None and first - self.candidate[1] >= self.hold:
            yield from self._commit()
        self.candidate = (zone, first)
        if self.last - first >= self.hold and row.n_rows > 1:
            yield from self._commit()
            self.candidate = None

    def end(self):
        if self.zone is not None and self.last > self.since:
            yield (*self.key, self.zone, self.since, self.last)


def held_visits(rows: DataFrame, hold_ms: int = 500) -> DataFrame:
    """Visits with hysteresis: a change of zone (leaving all zones too) counts once it has held for ``hold_ms``, from its first row on.

    A candidate that goes back to the held zone is forgotten. The last visit ends with the person's last row. The state depends on
    earlier decisions, so it is a fold; it runs over runs of equal zones, not over rows.
    """
    if hold_ms <= 0:
        return change_visits(rows)
    schema = "clip_id string, global_id bigint, zone_key string, enter_ms bigint, exit_ms bigint"
    return fold_sorted(zone_runs(rows).select(*_PERSON, "run", "zone_key", "first_ms", "last_ms", "n_rows"), _PERSON, ["run"], lambda key: _Held(key, hold_ms), schema)


def online_visits(rows: DataFrame, hold_ms: int = 1000) -> DataFrame:
    """Visits as an online engine reports them: a person's first zone holds at once; a change commits when its candidate has held for
    ``hold_ms``, at that row's time. Visits open at the end close at the last time of all persons of the clip.

    A candidate is always one run of a zone, so a change can only commit within its run, at the first row late enough. Runs that
    could commit, and the first one, are collapsed where successive ones name the same zone; that leaves the visits.
    """
    timed = rows.where("ms IS NOT NULL")
    numbered = islands(timed, _PERSON, ["ms", "row_idx"], F.floor(F.col("ms") / BLOCK_MS), ["zone_key"], lambda prev: ~prev["zone_key"].eqNullSafe(F.col("zone_key")))
    first = numbered.groupBy(*_PERSON, "island").agg(F.min("ms").alias("first_ms"), F.first("zone_key").alias("zone"))
    started = first.select(*[F.col(c).alias(f"f_{c}") for c in [*_PERSON, "island"]], "first_ms", "zone")
    on = F.col("clip_id").eqNullSafe(F.col("f_clip_id")) & F.col("global_id").eqNullSafe(F.col("f_global_id")) & (F.col("island") == F.col("f_island"))
    late = F.min(F.when((F.col("ms") - F.col("first_ms") >= hold_ms) & (F.col("ms") > F.col("first_ms")), F.col("ms")))
    runs = numbered.join(started, on).groupBy(*_PERSON, "island").agg(F.first("zone").alias("zone_key"), F.first("first_ms").alias("first_ms"), late.alias("commit_ms"))
    held = runs.withColumn("since", F.when(F.col("island") == 1, F.col("first_ms")).otherwise(F.col("commit_ms"))).where("since IS NOT NULL")
    person = Window.partitionBy(*_PERSON).orderBy("island")
    changes = held.withColumn("before", F.lag(F.struct("zone_key")).over(person)).where(F.col("before").isNull() | ~F.col("before.zone_key").eqNullSafe(F.col("zone_key")))
    last = timed.groupBy(F.col("clip_id").alias("l_clip")).agg(F.max("ms").alias("clip_end"))
    closed = changes.withColumn("left_ms", F.lead("since").over(person)).join(last, F.col("clip_id").eqNullSafe(F.col("l_clip")))
    visits = closed.where("zone_key IS NOT NULL").select(*_PERSON, "zone_key", F.col("since").alias("enter_ms"), F.coalesce("left_ms", "clip_end").alias("exit_ms"))
    return visits.where("exit_ms > enter_ms")
