"""Per-period aggregates by event time, corrected as records arrive late, closed at a cut-off.

A lambda view. The fast layer counts the records that arrived since the last batch run into provisional periods. The
batch run recomputes every period that was still open from the full log, replaces it, and freezes the periods whose
cut-off has passed. A frozen period never changes again: a record that first arrives after its period's cut-off is
rejected and listed.

Cut-off. The watermark at an arrival instant is the greatest event time of all records that arrived strictly earlier,
minus `delay`. A period ending at E is closed once the watermark reaches E + `lateness`, so the instant at which it closes
is the first arrival of any record with event time >= E + delay + lateness. That is a suffix minimum over event time, not
a running maximum over the log: one small aggregate by event-time cell, then a minimum over cells. No task sorts the log.

Runs. Kept holds the view in tables of the shared folder: the log once deduplicated, in a folder for each run that first meets the records; the periods that
each run counted; the ids that each run rejected. A run knows what had arrived by then and nothing else. Since a period closes no later than the next, the
open periods are those after one frontier, and a run reads their records only, and of the records that are new since the last run those of frozen periods:
they are rejected. Whatever the schedule, the runs together reject the same ids and end in the same state.

Cases. Records without event id are advanced through the watermark but counted nowhere; without readable arrival they
move no watermark and are ignored, or, if asked for, counted by the batch layer in their period and never rejected, provided that no delivery of
their id has one; without event time they belong to no period and are never rejected. Repeated deliveries of an id count by
their first arrival. Of deliveries that share the first instant, one past its period's cut-off makes the id a rejected
one. Empty logs give empty results. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import DAY, MINUTE, SECOND, arrival_us, floor_to, plain_key, wall_us
from tidemark.storage import folder, table_bytes, written

#: A closings table of at most so many bytes on disk is sent to every executor; a larger one is joined by shuffle.
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class CutOff:
    period_us: int = MINUTE
    delay_us: int = 10 * SECOND
    lateness_us: int = 10 * MINUTE
    slack_us: int = 0  # a period closes so much before its last instant is reached

    def period_end(self, event_us: Column) -> Column:
        return floor_to(event_us, self.period_us) + self.period_us

    def passed(self, period_end: Column, watermark_us: Column) -> Column:
        """Whether a record that meets this watermark comes too late for its period."""
        return watermark_us >= period_end + (self.lateness_us - self.slack_us)


def read_log(raw: DataFrame, undated: bool = False) -> DataFrame:
    """event_id, group, event_us, arrival_us of raw impression rows; with undated, also of those without readable arrival."""
    log = raw.select(
        "event_id", plain_key("campaign_id").alias("group"), wall_us("event_time").alias("event_us"), arrival_us("server_ts").alias("arrival_us")
    )
    return log if undated else log.filter(F.col("arrival_us").isNotNull())


class LambdaView:
    """log: event_id, group, event_us, arrival_us, as by read_log()."""

    def __init__(self, cut_off: CutOff = CutOff()):  # noqa: B008
        self.cut = cut_off

    def cells(self, log: DataFrame) -> DataFrame:
        """(at, ask, first_us, last_us): the arrivals of the records of a cell of event time, where `ask` is the end of its period. at is null for records without event time."""
        step = gcd(self.cut.period_us, self.cut.delay_us + self.cut.lateness_us)
        at, ask = floor_to(F.col("event_us") + self.cut.slack_us, step).alias("at"), self.cut.period_end(F.col("event_us")).alias("ask")
        return log.groupBy(at, ask).agg(F.min("arrival_us").alias("first_us"), F.max("arrival_us").alias("last_us"))

    def closings(self, log: DataFrame) -> DataFrame:
        return self.closed(self.cells(log))

    def closed(self, cells: DataFrame, as_of_us: int | None = None) -> DataFrame:
        """(period_end, closes_us) of each period in the cells, of what had arrived at as_of_us; closes_us is null while the period is open.

        Two levels: minima within a day of cells, then over days. A day has a fixed number of cells and a calendar a fixed
        number of days, so no window grows with the log."""
        cut, ask = self.cut, F.col("ask")
        cells = cells.filter("at is not null")
        if as_of_us is not None:
            cells = cells.filter(F.col("first_us").isNull() | (F.col("first_us") <= as_of_us))
        points = cells.select(
            F.explode(
                F.array(
                    F.struct(F.col("at"), F.col("first_us"), F.lit(None).cast("bigint").alias("period_end")),
                    F.struct((ask + cut.delay_us + cut.lateness_us).alias("at"), F.lit(None).cast("bigint").alias("first_us"), ask.alias("period_end")),
                )
            ).alias("p")
        ).select("p.*")
        points = points.groupBy("at", "period_end").agg(F.min("first_us").alias("first_us")).withColumn("day", F.floor(F.col("at") / DAY))
        within = Window.partitionBy("day").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, 0)
        days = points.groupBy("day").agg(F.min("first_us").alias("day_us"))
        later = days.select("day", F.min("day_us").over(Window.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("later_us"))
        return (
            points.withColumn("day_us", F.min("first_us").over(within))
            .filter("period_end is not null")
            .join(later, "day")
            .select("period_end", F.least("day_us", "later_us").alias("closes_us"))
        )

    def frontier(self, cells: DataFrame, as_of_us: int) -> int | None:
        """The periods up to here, and no others, were frozen at as_of_us."""
        at = cells.filter(F.col("first_us") <= as_of_us).agg(F.max("at")).first()[0]
        return None if at is None else at - self.cut.delay_us - self.cut.lateness_us

    def placed(self, log: DataFrame) -> DataFrame:
        return log.withColumn("period_end", self.cut.period_end(F.col("event_us")))

    def stamped(self, log: DataFrame, closings: DataFrame) -> DataFrame:
        """The log, or its first arrivals, with period_end and closes_us. closings: a written table, so that its size is known."""
        small = table_bytes(closings) <= BROADCAST_BYTES
        log = log if "period_end" in log.columns else self.placed(log)
        return log.join(F.broadcast(closings) if small else closings, "period_end", "left")

    def arrivals(self, placed: DataFrame, *more: str) -> DataFrame:
        """One row for each event id, at its first arrival: event_id, arrival_us, period_end, group, and columns that go by the period.

        Of rows that arrived at once, the one with the earliest period, which closes first. An id without any arrival has a null one."""
        first = F.struct(
            F.col("arrival_us").isNull().alias("undated"), "arrival_us", F.col("period_end").isNull().alias("nowhere"), "period_end", "group", *more
        )
        rows = placed.filter("event_id is not null").groupBy("event_id").agg(F.min(first).alias("f"))
        return rows.select("event_id", *[f"f.{c}" for c in ("arrival_us", "period_end", "group", *more)])

    def firsts(self, stamped: DataFrame) -> DataFrame:
        """arrivals() with closes_us and rejected."""
        return self.arrivals(stamped, "closes_us").withColumn("rejected", _rejected())

    def speed(self, firsts: DataFrame, after_us: int | Column) -> DataFrame:
        """Provisional increments (period_end, group, n) of the records that arrived after the last batch run."""
        new = firsts.filter((F.col("arrival_us") > after_us) & ~F.col("rejected") & F.col("period_end").isNotNull())
        return new.groupBy("period_end", "group").agg(F.count("*").alias("n"))

    def counted(self, firsts: DataFrame, as_of_us: int | Column) -> DataFrame:
        """(period_end, group, n, frozen) of the records known at as_of_us."""
        known = firsts.filter((F.col("arrival_us").isNull() | (F.col("arrival_us") <= as_of_us)) & F.col("period_end").isNotNull())
        return known.groupBy("period_end", "group").agg(
            F.count_if(~F.col("rejected")).alias("n"),
            F.coalesce(F.max(F.col("closes_us")) <= as_of_us, F.lit(False)).alias("frozen"),
        ).filter("n > 0")

    def refresh(self, state: DataFrame | None, firsts: DataFrame, as_of_us: int | Column) -> DataFrame:
        """A batch run: (period_end, group, n, frozen). Frozen rows of the last state stay as they are; every other period is
        counted again from the full log as it was at as_of_us, and frozen if its cut-off has passed by then. Ids without any arrival count in every run. Groups without a counted
        record have no row."""
        if state is None:
            return self.counted(firsts, as_of_us)
        done = state.filter("frozen").select("period_end").distinct()
        return state.filter("frozen").unionByName(self.counted(firsts.join(done, "period_end", "left_anti"), as_of_us))

    def view(self, state: DataFrame, speed: DataFrame) -> DataFrame:
        """What readers see: (period_end, group, n, provisional, frozen)."""
        rows = state.select("period_end", "group", "n", F.lit(0).cast("bigint").alias("provisional"), "frozen").unionByName(
            speed.select("period_end", "group", F.lit(0).cast("bigint").alias("n"), F.col("n").alias("provisional"), F.lit(False).alias("frozen"))
        )
        return rows.groupBy("period_end", "group").agg(
            F.sum(F.col("n") + F.col("provisional")).alias("n"), F.sum("provisional").alias("provisional"), F.bool_or("frozen").alias("frozen")
        )


def _rejected() -> Column:
    return F.coalesce(F.col("arrival_us") > F.col("closes_us"), F.lit(False))


class Kept:
    """A view of a log kept in tables, by batch runs at the instants `before_end_us` before the log's last arrival, and the fast layer after the last of them."""

    def __init__(self, view: LambdaView, log: DataFrame, before_end_us: Sequence[int]):
        self.view, spark = view, log.sparkSession
        self.cells = written(view.cells(log), "cells")
        begin, end = self.cells.agg(F.min("first_us"), F.max("last_us")).first()
        # runs before the first arrival would be empty but for records without arrival, which the last run has too
        self.instants = [] if end is None else sorted({end - us for us in before_end_us if end - us >= begin} | {end - min(before_end_us)})
        met = F.lit(len(self.instants))  # the first run that meets a record; those without arrival are known from the start
        for number in range(len(self.instants) - 1, -1, -1):
            met = F.when(F.col("arrival_us").isNull() | (F.col("arrival_us") <= self.instants[number]), number).otherwise(met)
        self.firsts = written(view.arrivals(view.placed(log)).withColumn("met", met), "firsts", "met")
        self._periods, self._rejected = folder(spark, "periods"), folder(spark, "rejected")
        self.spark, self.frontier = spark, None
        for number in range(len(self.instants)):
            self._run(number)

    def _run(self, number: int) -> None:
        as_of = self.instants[number]
        known, new = self.firsts.filter(F.col("met") <= number), self.firsts.filter(F.col("met") == number)
        if self.frontier is not None:  # frozen periods stay as they are: only records of later ones are read again
            known, new = known.filter(F.col("period_end") > self.frontier), new.filter(F.col("period_end") <= self.frontier).select("event_id")
        stamped = self.view.stamped(known, written(self.view.closed(self.cells, as_of), "closings")).withColumn("rejected", _rejected())
        self.view.counted(stamped, as_of).write.parquet(f"{self._periods}/run={number}")
        late = stamped.filter("rejected").select("event_id")
        (late if self.frontier is None else late.unionByName(new)).write.parquet(f"{self._rejected}/run={number}")
        self.frontier = self.view.frontier(self.cells, as_of)

    def state(self, number: int | None = None) -> DataFrame:
        """(period_end, group, n, frozen) as run `number` left it, the last run if None: what earlier runs froze, and all that it counted itself."""
        number = len(self.instants) - 1 if number is None else number
        rows = self.spark.read.schema("period_end bigint, group string, n bigint, frozen boolean, run int").option("basePath", self._periods)
        rows = rows.parquet(*[f"{self._periods}/run={i}" for i in range(number + 1)])
        return rows.filter(F.col("frozen") | (F.col("run") == number)).drop("run")

    def rejected(self) -> DataFrame:
        """event_id of each record that a run met after its period was frozen, by all runs."""
        return self.spark.read.schema("event_id string").parquet(*[f"{self._rejected}/run={i}" for i in range(len(self.instants))])

    def current(self) -> DataFrame:
        """What readers see at the log's end: the last run's state and the fast layer over it."""
        new = self.firsts.filter(F.col("met") >= len(self.instants))
        new = self.view.stamped(new, written(self.view.closed(self.cells), "closings")).withColumn("rejected", _rejected())
        return self.view.view(self.state(), self.view.speed(new, self.instants[-1]))


def late_firsts(raw: DataFrame, cut: CutOff = CutOff(), before_end_us: Sequence[int] = (2 * DAY, DAY, 0)) -> DataFrame:  # noqa: B008
    """The ids of raw deliveries that first arrived after the cut-off of their period: what the view's runs rejected, the last one at the log's end."""
    kept = Kept(LambdaView(cut), read_log(raw), before_end_us)
    return kept.rejected() if kept.instants else kept.firsts.select("event_id")


def late_recorded(dropped: DataFrame, cut: CutOff = CutOff()) -> DataFrame:  # noqa: B008
    """The same of a log that recorded the watermark each record met: by the smallest watermark of an id, and by the period of its
    event time, not the period recorded. Rows without event time or watermark say nothing."""
    seen = dropped.filter("event_id is not null and event_time is not null").select(
        "event_id", cut.period_end(wall_us("event_time")).alias("period_end"), wall_us("watermark_at").alias("watermark_us")
    )
    by_id = seen.groupBy("event_id").agg(F.min("period_end").alias("period_end"), F.min("watermark_us").alias("watermark_us"))
    return by_id.filter(cut.passed(F.col("period_end"), F.col("watermark_us"))).select("event_id")


def corrected_periods(raw: DataFrame, cut: CutOff = CutOff(), lag_us: int = 6 * 60 * MINUTE, undated: bool = False) -> DataFrame:  # noqa: B008
    """The view as of the log's end: a first batch run 2 * lag_us before the last arrival, a second lag_us before, and the fast layer on top.

    With undated, ids without any readable arrival count in their period, in the batch layer. Columns: period_end (us), group, n, provisional, frozen."""
    kept = Kept(LambdaView(cut), read_log(raw, undated), (2 * lag_us, lag_us))
    if kept.instants:
        return kept.current()
    # no record has an arrival: nothing closes a period
    state = kept.view.counted(kept.firsts.withColumn("closes_us", F.lit(None).cast("bigint")).withColumn("rejected", F.lit(False)), 0)
    return kept.view.view(state, state.select("period_end", "group", "n").limit(0))
