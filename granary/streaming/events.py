"""Event logs: windows between phases, late events, and state by key, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.stats import nearest_rank, rate


def phase_bounds(events: DataFrame, start: str, end: str) -> DataFrame:
    """One row (t0, t1): when the two phases are told; an error unless each is told once."""
    g = events.where(F.col("event") == "phase").agg(
        F.count_if(F.col("phase") == start).alias("a"), F.count_if(F.col("phase") == end).alias("b"), F.max(F.when(F.col("phase") == start, F.col("t"))).alias("t0"), F.max(F.when(F.col("phase") == end, F.col("t"))).alias("t1")
    )
    ok = (F.col("a") == 1) & (F.col("b") == 1)
    return g.select(F.when(ok, F.col("t0")).otherwise(F.raise_error(F.lit("a phase isn't told just once"))).alias("t0"), "t1")


def placed(events: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds ``place``: before, window or drain. Late events are counted by themselves, not dropped. The bounds are one row, so the join moves no event."""
    b = events.crossJoin(F.broadcast(bounds.limit(1)))
    place = F.when(F.col("t") < F.col("t0"), "before").when(F.col("t") <= F.col("t1"), "window").otherwise("drain")
    return b.withColumn("place", place).drop("t0", "t1")


def window_summary(placed_: DataFrame, seconds: Column | float) -> DataFrame:
    """One row of what happened in the window, rates by minute and the drained count beside it; zero where nothing was completed."""
    inside = F.col("place") == "window"
    done = inside & (F.col("event") == "completed")
    seconds = F.lit(seconds) if not isinstance(seconds, Column) else seconds
    return placed_.withColumn("__done", F.when(done, F.col("latency"))).agg(
        F.count_if(inside & (F.col("event") == "submitted")).alias("submitted"),
        F.count_if(done).alias("completed"),
        F.count_if((F.col("place") == "drain") & (F.col("event") == "completed")).alias("drain"),
        F.coalesce(F.sum(F.when(done, F.col("amount"))), F.lit(0)).alias("amount"),
        nearest_rank("__done", 0.5).alias("p50"),
        nearest_rank("__done", 0.95).alias("p95"),
    ).withColumn("per_minute", rate(F.col("completed") * 60, seconds))


def stream_of(spark: SparkSession, path: str, schema, fmt: str = "json", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def counted(events: DataFrame, time: str, every: str, late: str, *keys: str) -> DataFrame:
    """Counts by time window; events later than the watermark allows don't change a window that has been given out."""
    return events.withWatermark(time, late).groupBy(F.window(time, every), *keys).agg(F.count("*").alias("n"))


def replayed_once(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once while its watermark lasts."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


#: What becomes of a batch: queued, leased until a time, done, split after the third failure.
LEASE_STATE = "state string, token string, until double, tries int"
LEASE_OUT = "batch string, state string, token string, tries int"


def lease_step(state: tuple, event: dict, lease: float, most: int = 3) -> tuple:
    """State of a batch after an event. A claim takes a queued batch or one whose lease has run out; completion and release count only with the token of the claim; a failure leads back to the queue, or to ``split`` after ``most`` tries."""
    name, token, until, tries = state
    t, kind = event["t"], event["kind"]
    if name == "leased" and t >= until:
        name, token = "queued", None
    if kind == "claim" and name == "queued":
        return "leased", event["token"], t + lease, tries + 1
    if name == "leased" and event["token"] == token:
        if kind == "complete":
            return "done", None, 0.0, tries
        if kind == "release":
            return "queued", None, 0.0, tries - 1
        if kind == "fail":
            return ("split" if tries >= most else "queued"), None, 0.0, tries
    return name, token, until, tries


def leases(events: DataFrame, lease: float = 60.0, most: int = 3) -> DataFrame:
    """State of each batch after its events in order of time; works on a stream and on a table."""

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else ("queued", None, 0.0, 0)
        for f in frames:
            for e in f.sort_values(["t", "kind", "token"]).to_dict("records"):
                now = lease_step(now, e, lease, most)
        state.update(now)
        yield pd.DataFrame({"batch": [key[0]], "state": [now[0]], "token": [now[1]], "tries": [now[3]]})

    slim = events.select("batch", "kind", F.coalesce("token", F.lit("")).alias("token"), F.col("t").cast("double").alias("t"))
    if slim.isStreaming:
        return slim.groupBy("batch").applyInPandasWithState(update, LEASE_OUT, LEASE_STATE, "update", GroupStateTimeout.NoTimeout)

    # a table's events are folded by the same rules inside the JVM, with no Python call for each batch
    in_order = F.sort_array(F.collect_list(F.struct("t", "kind", "token")))
    start = F.struct(F.lit("queued").alias("state"), F.lit(None).cast("string").alias("token"), F.lit(0.0).alias("until"), F.lit(0).alias("tries"))

    def step(s: Column, e: Column) -> Column:
        over = (s["state"] == "leased") & (e["t"] >= s["until"])
        name, token = F.when(over, "queued").otherwise(s["state"]), F.when(~over, s["token"])
        claim = (e["kind"] == "claim") & (name == "queued")
        own = (name == "leased") & F.coalesce(e["token"] == token, F.lit(False)) & e["kind"].isin("complete", "release", "fail")
        after = F.when(e["kind"] == "complete", "done").when((e["kind"] == "fail") & (s["tries"] >= most), "split").otherwise("queued")
        return F.struct(
            F.when(claim, "leased").when(own, after).otherwise(name).alias("state"),
            F.when(claim, e["token"]).when(~own, token).alias("token"),
            F.when(claim, e["t"] + lease).when(own, 0.0).otherwise(s["until"]).alias("until"),
            (s["tries"] + F.when(claim, 1).when(own & (e["kind"] == "release"), -1).otherwise(0)).alias("tries"),
        )

    folded = slim.groupBy("batch").agg(F.aggregate(in_order, start, step).alias("s"))
    return folded.select("batch", "s.state", "s.token", "s.tries")


def deadline_action(now: float, stop_at: float, drain_at: float, stopping: bool, productive: bool) -> str | None:
    """What a worker's clock calls for: ``stop`` taking work, or ``interrupt`` what still runs; nothing while a drain brings results."""
    if now >= drain_at and not productive:
        return "interrupt"
    return "stop" if now >= stop_at and not stopping else None


def window_ids(placed_: DataFrame, id_col: str) -> DataFrame:
    """(n, digest) of the ids completed in the window, in order of id, each with its length before it."""
    from ..functions.text import framed

    ids = placed_.where("place = 'window' AND event = 'completed'").select(F.col(id_col).cast("string").alias("i"))
    return ids.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("i")), lambda i: framed(i)), ""), 256).alias("digest"))


class Phases:
    """Wall and CPU seconds of named phases of a job."""

    def __init__(self):
        self.rows: list[dict] = []

    def __call__(self, name: str, **counts):
        import time
        from contextlib import contextmanager

        @contextmanager
        def phase():
            row = {"phase": name, **counts}
            wall, cpu = time.perf_counter(), time.process_time()
            try:
                yield row
            finally:
                row |= {"wall": time.perf_counter() - wall, "cpu": time.process_time() - cpu}
                self.rows.append(row)

        return phase()


def backoff(attempt: int, base: float = 0.05, most: float = 2.0) -> float:
    """Seconds to wait before a further try, without the random part."""
    return min(base * 2**attempt, most)


def revision(scope: str, compiled) -> str:
    """Scope and minute of compilation."""
    return f"{scope}-{compiled:%Y%m%d.%H%M}"
