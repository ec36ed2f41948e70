"""Sliding-window request limits per user, streaming and batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators.skew import latest_by, spread_for_python
from furrow.session import ship_by_value

ship_by_value(__name__)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE_OUT = "user_id long, minute long, requests long, allowed long, rejected long"


def horizon(limits: dict[int, int]) -> int:
    """Whole hours that the longest window reaches back, its own hour included."""
    for length in limits:
        if length < 1 or (length >= 60 and length % 60):
            raise ValueError(f"a window of {length} minutes: below an hour, or whole hours")
    return max([1, *(length // 60 for length in limits)])


def admit(minutes: pd.DataFrame | dict[str, list[int]], counts: dict[int, int], limits: dict[int, int]) -> list[tuple]:
    """Allowed and rejected requests per minute, in minute order.

    ``counts`` maps minute → admitted requests and is updated in place. All
    requests of a minute see the same windows, so of n requests the first
    min(limit - count) pass: a window below an hour sums its last minutes, a
    longer one its last whole hours, and rejected requests never count.
    """
    out = []
    hours: dict[int, int] = {}
    for m, c in counts.items():
        hours[m // 60] = hours.get(m // 60, 0) + c
    for minute, n in zip(minutes["minute"], minutes["requests"]):
        minute, n = int(minute), int(n)
        hour, room = minute // 60, n
        for length, limit in limits.items():
            if length < 60:
                used = sum(counts.get(minute - i, 0) for i in range(length))
            else:
                used = sum(hours.get(hour - i, 0) for i in range(length // 60))
            room = min(room, max(limit - used, 0))
        if room:
            counts[minute] = counts.get(minute, 0) + room
            hours[hour] = hours.get(hour, 0) + room
        out.append((minute, n, room, n - room))
    if out:
        oldest = (out[-1][0] // 60 - horizon(limits)) * 60
        for m in [m for m in counts if m < oldest]:
            del counts[m]
    return out


def per_minute(log: DataFrame, user: str = "user_id", ts: str = "requested_at") -> DataFrame:
    minute = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / 60).cast("long")
    return log.groupBy(F.col(user).alias("user_id"), minute.alias("minute")).agg(
        F.count("*").alias("requests"))


def limit_batch(log: DataFrame, limits: dict[int, int]) -> DataFrame:
    """Admission of a whole log, one row per user and active minute.

    Requests are reduced to minute counts (with map-side combine) before a
    user's rows meet, so a user with a third of all requests brings at most
    1440 rows a day to a task.
    """
    horizon(limits)

    def one_user(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = admit(pdf.sort_values("minute"), {}, limits)
        return pd.DataFrame([(pdf["user_id"].iloc[0], *r) for r in rows],
                            columns=["user_id", "minute", "requests", "allowed", "rejected"])

    counted = spread_for_python(per_minute(log), "user_id")
    return counted.groupBy("user_id").applyInPandas(one_user, MINUTE_OUT)


KEEP_HOURS = 35 * 24


def limit_stream(log: DataFrame, limits: dict[int, int], keep_hours: int = KEEP_HOURS) -> DataFrame:
    """Decisions on a request stream, corrected as requests come in, in any order.

    State is a user's requested and admitted count per minute, packed in one value. A batch adds its
    requests, decides again from the first minute that changed, and gives the
    minutes whose decision is new or different, with ``seen``, the number of the
    user's requests so far. ``latest_decisions`` of these rows equals ``limit_batch`` of
    the same requests, as long as none comes more than ``keep_hours`` behind its user's
    newest one: minutes before that (and before what its windows reach back) leave the
    state, so a user holds a bounded number of minutes. A request that comes later
    still is rejected and told apart by ``late``, the user's count of such requests.
    Requests are counted per user and minute in the tasks that read them, so few rows
    of a hot user travel.
    """
    from pyspark.sql.streaming import StatefulProcessor

    hours = horizon(limits)
    # this kind of state needs the RocksDB store; sessions of build_session have it
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def count(batches):
        for batch in batches:
            counted = pa.table(batch).group_by(["user_id", "minute"]).aggregate([([], "count_all")])
            for part in counted.rename_columns(["user_id", "minute", "requests"]).to_batches():
                yield part

    class Limiter(StatefulProcessor):
        def init(self, handle) -> None:
            # one packed value a user: a call per minute costs more than the minutes themselves
            self.minutes = handle.getValueState("minutes", "packed binary")
            self.totals = handle.getValueState("totals", "seen long, late long, newest long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
            seen, late, newest = self.totals.get() if self.totals.exists() else (0, 0, -(1 << 62))
            arrived: dict[int, int] = {}
            for frame in rows:
                for minute, n in zip(frame["minute"].tolist(), frame["requests"].tolist()):
                    arrived[minute] = arrived.get(minute, 0) + n
            kept_from = (newest // 60 - keep_hours) * 60            # as the batch found it
            out, changed = [], {m: n for m, n in arrived.items() if m >= kept_from}
            for minute, n in sorted(arrived.items()):
                if minute < kept_from:
                    late += n
                    out.append((key[0], minute, n, 0, n, seen, late))
            if changed:
                held = np.frombuffer(self.minutes.get()[0], "<i8") if self.minutes.exists() else np.empty(0, "<i8")
                before = {m: (n, a) for m, n, a in held.reshape(-1, 3).tolist()}
                requests, first = {m: v[0] for m, v in before.items()}, min(changed)
                for minute, n in changed.items():
                    requests[minute] = requests.get(minute, 0) + n
                oldest = (first // 60 - hours) * 60
                counts = {m: v[1] for m, v in before.items() if oldest <= m < first and v[1]}
                again = sorted((m, n) for m, n in requests.items() if m >= first)
                seen += sum(changed.values())
                for minute, n, allowed, rejected in admit({"minute": [m for m, _ in again], "requests": [n for _, n in again]},
                                                          counts, limits):
                    if before.get(minute) != (n, allowed):
                        before[minute] = (n, allowed)
                        out.append((key[0], minute, n, allowed, rejected, seen, 0))
                newest = max(newest, max(changed))
                gone = (newest // 60 - keep_hours - hours) * 60
                kept = [(m, *v) for m, v in before.items() if m >= gone]
                self.minutes.update((np.array(kept, "<i8").tobytes(),))
            self.totals.update((seen, late, newest))
            yield pd.DataFrame(out, columns=["user_id", "minute", "requests", "allowed", "rejected", "seen", "late"])

        def close(self) -> None:
            pass

    minute = F.floor(F.unix_seconds(F.col("requested_at").cast("timestamp")) / 60).cast("long")
    counted = log.select("user_id", minute.alias("minute")).mapInArrow(
        count, "user_id long, minute long, requests long")
    return counted.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=Limiter(), outputStructType=f"{MINUTE_OUT}, seen long, late long", outputMode="append",
        timeMode="None")


def latest_decisions(decided: DataFrame) -> DataFrame:
    """The last decision on each user and minute of what ``limit_stream`` wrote, requests
    that came too late left out."""
    return latest_by(decided.where("late = 0"), ["user_id", "minute"], ["seen"]).select(
        "user_id", "minute", "requests", "allowed", "rejected")
