"""Event streams: windowed counters with late data, sliding-window rate limits, leased jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, at: str, keys: list[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of each window and key; rows later than ``late`` behind the newest are dropped by the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def admit(times: list[float], seen: list[float], window: float, limit: int) -> tuple[list[bool], list[float]]:
    """Sliding-window log: which of the new times are let in, and the log that remains.

    A time is let in if fewer than ``limit`` admitted ones lie in the ``window`` seconds up to it.
    """
    log, out = sorted(seen), []
    for t in times:
        log = [x for x in log if x > t - window]
        ok = len(log) < limit
        if ok:
            log.append(t)
        out.append(ok)
    return out, log


def rate_limited(events: DataFrame, key: str, at: str, window: float, limit: int) -> DataFrame:
    """Each event of a stream with ``admitted``, by a log of admitted times kept for each key.

    A key's log holds at most ``limit`` times, and a silent key's state is dropped after the window.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at", "id"], kind="stable")
        log = list(state.get[0]) if state.exists else []
        admitted, log = admit(rows["at"].tolist(), log, window, limit)
        state.update((log,))
        state.setTimeoutDuration(int(window * 1000) + 1)
        yield pd.DataFrame({"key": [k[0]] * len(rows), "id": rows["id"].to_numpy(), "admitted": admitted})

    read = events.select(F.col(key).cast("string").alias("key"), F.col("event_id").alias("id"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("at"))
    return read.groupBy("key").applyInPandasWithState(step, "key string, id bigint, admitted boolean", "log array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def next_status(status: str, attempts: int, event: str, most: int = 5) -> tuple[str, int]:
    """State machine of a job: events ``claim``, ``finish``, ``fail``, ``cancel``, ``expire``.

    Ended jobs never change; a claim needs a pending job; an expired lease goes back to pending, or fails
    once it was the last attempt.
    """
    if status in ("done", "failed", "cancelled"):
        return status, attempts
    if event == "cancel":
        return "cancelled", attempts
    if event == "claim":
        return ("claimed", attempts) if status == "pending" else (status, attempts)
    if status != "claimed":
        return status, attempts
    if event == "finish":
        return "done", attempts
    if event == "fail":
        return "failed", attempts
    if event == "expire":
        return ("failed" if attempts + 1 >= most else "pending"), attempts + 1
    return status, attempts


def job_states(changes: DataFrame, lease_seconds: float, most: int = 5) -> DataFrame:
    """Status of each job after each of its events; a lease not renewed in time expires by a timer.

    ``changes``: ``job_id``, ``at``, ``event``.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts = state.get if state.exists else ("pending", 0)
        events = ["expire"] if state.hasTimedOut else pd.concat(list(batches)).sort_values("at", kind="stable")["event"].tolist()
        for event in events:
            status, attempts = next_status(status, attempts, event, most)
        state.update((status, attempts))
        if status == "claimed":
            state.setTimeoutDuration(int(lease_seconds * 1000))
        yield pd.DataFrame({"job_id": [k[0]], "status": [status], "attempts": [attempts]})

    return changes.groupBy("job_id").applyInPandasWithState(step, "job_id string, status string, attempts int", "status string, attempts int", "update", GroupStateTimeout.ProcessingTimeTimeout)


def upsert_into(path: str, key: str, version: str, buckets: int = 64):  # noqa: ANN201
    """A ``foreachBatch`` function: each batch rewrites the buckets of keys it touches, as a new version of each.

    A bucket's version is its batch's number; ``read_upserted`` takes the newest complete one.  Buckets that a batch
    doesn't touch are neither read nor written; a repeated batch writes its own folders again; a batch may be the first one.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        split = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in split.select("bucket").distinct().collect()]
        before = _newest_buckets(spark, path, set(touched), number)
        merged = split if before is None else split.unionByName(before.select(*split.columns))
        rest = [c for c in batch.columns if c not in (key, version)]
        newest = merged.groupBy("bucket", key).agg(F.max(F.struct(version, *rest)).alias("r")).select("bucket", key, "r.*")
        newest.select("bucket", *batch.columns).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")

    return write


def _newest_buckets(spark: SparkSession, path: str, wanted: set[int] | None, before: int | None) -> DataFrame | None:
    """The newest complete folder of each bucket, of batches before a number."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    newest: dict[int, tuple[int, str]] = {}
    for batch in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")) or []:
        folder = batch.getPath().getParent()
        number = int(folder.getName().partition("=")[2])
        if before is not None and number >= before:
            continue
        for part in fs.listStatus(folder):
            name = part.getPath().getName()
            if name.startswith("bucket="):
                bucket = int(name.partition("=")[2])
                if wanted is None or bucket in wanted:
                    newest[bucket] = max(newest.get(bucket, (-1, "")), (number, part.getPath().toString()))
    if not newest:
        return None
    out = None
    for folder in {f.rpartition("/")[0] for _, f in newest.values()}:
        own = [f for _, f in newest.values() if f.rpartition("/")[0] == folder]
        one = spark.read.option("basePath", folder).parquet(*own)
        out = one if out is None else out.unionByName(one)
    return out


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``upsert_into`` keeps: the newest row of each key."""
    found = _newest_buckets(spark, path, None, None)
    if found is None:
        raise FileNotFoundError(f"nothing below {path}")
    return found.drop("bucket")


def admit_all(times: list[float], logs: dict[str, list[float]], keys: list[list[str]], window: float, limits: dict[str, int]) -> list[bool]:
    """Sliding-window logs over several keys: an event is let in if every one of its keys has room, and then counts for all of them."""
    out = []
    for t, own in zip(times, keys, strict=True):
        for k in own:
            logs[k] = [x for x in logs.get(k, []) if x > t - window]
        ok = all(len(logs[k]) < limits[k.partition(":")[0]] for k in own)
        for k in own if ok else ():
            logs[k].append(t)
        out.append(ok)
    return out


def refund(log: list[float]) -> list[float]:
    """A log without its newest admitted time: an attempt that turned out well doesn't count."""
    return sorted(log)[:-1]


def swept(jobs: DataFrame, now: Column, lease: int, running: int, most: int = 5) -> DataFrame:
    """Jobs after a sweep: claims past their lease and runs past their time go back to pending, or fail on the last attempt.

    ``jobs``: ``status``, ``at`` (of the last sign of life), ``attempts``.  Stale callback claims are ended jobs' business
    and stay.
    """
    age = F.unix_micros(now) - F.unix_micros(F.col("at").cast("timestamp"))
    stale = ((F.col("status") == "claimed") & (age > lease * 1_000_000)) | ((F.col("status") == "running") & (age > running * 1_000_000))
    last = F.col("attempts") + 1 >= most
    return jobs.withColumns({"status": F.when(stale & last, "failed").when(stale, "pending").otherwise(F.col("status")), "attempts": F.col("attempts") + stale.cast("int")})


def notify(path: str, most: int = 16):  # noqa: ANN201
    """A ``foreachBatch`` function: the newest ``most`` changes of each subscriber in a batch, older ones dropped, as JSON rows.

    ``most`` is the length of a subscriber's queue, which is the operator.
    """

    def write(batch: DataFrame, number: int) -> None:
        w = Window.partitionBy("subscriber").orderBy(F.desc("at"))
        batch.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r").write.mode("overwrite").json(f"{path}/batch={number}")

    return write


def drain(path: str, deliver):  # noqa: ANN001, ANN201
    """A ``foreachBatch`` function for an outbox: ``deliver`` (a pandas function of rows to success) is tried, failures are kept.

    Failed rows go to ``path`` with one more attempt, from where the next run reads them again.
    """

    def attempt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(delivered=deliver(b), attempts=b["attempts"] + 1)

    def write(batch: DataFrame, number: int) -> None:
        done = batch.mapInPandas(attempt, ", ".join(f"`{n}` {t}" for n, t in batch.dtypes) + ", delivered boolean")
        done.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def route_counters(requests: DataFrame, at: str, route: str, status: str, value: str, window: str = "1 day", late: str = "90 days") -> DataFrame:
    """Counts, failures, mean and greatest value of each route and day of a stream; state older than ``late`` is dropped."""
    w = requests.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), route)
    return w.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(status) >= 500).alias("failures"), F.avg(value).alias("mean"), F.max(value).alias("most")).select(F.col("w.start").alias("day"), route, "n", "failures", "mean", "most")


def age_seconds(now: Column, oldest: Column) -> Column:
    """Age floored at 0; null if there is none."""
    return F.when(oldest.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(oldest)) / 1e6))
