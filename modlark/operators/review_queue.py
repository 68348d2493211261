"""The bounded review queue over time, without ordering all events in one task.

An event enters the queue when it is logged and leaves it by its verdict; when
an event comes to a full queue, the oldest one is evicted.  Whether an event is
evicted depends on later events alone: it is, if at some arrival before its
verdict as many later events are waiting as the queue can hold.

Events are dealt into ranges of time, each small enough for a task.  Within its
range an event's fate is decided there (first pass).  At most ``keep`` events
of each range outlive it; for those the second pass sums up every later range
by the greatest number of its own events that wait at once, between the
verdicts that take older events out.  A last pass goes over these summaries,
some hundred numbers for each range, in order.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlark.operators.review import resolve
from modlark.sources.shared import written

#: Events of a range, about.
RANGE = 200_000
_SUMMARY = "range int, pieces array<struct<most:int,id:long>>, most int, left array<long>, evicted array<long>"


def _simulated(rows: pd.DataFrame, keep: int) -> tuple[list, int, list[int], list[int]]:
    """Verdicts on older events with the most own events waiting since the one
    before, the most after the last, who waits at the end, and who was evicted."""
    waiting: OrderedDict[int, None] = OrderedDict()
    pieces, most, evicted = [], 0, []
    for event, kind, own in zip(rows["id"].tolist(), rows["kind"].tolist(), rows["own"].tolist()):
        if kind == 0:
            waiting[event] = None
            if len(waiting) > keep:
                evicted.append(waiting.popitem(last=False)[0])
            most = max(most, len(waiting))
        elif own:
            waiting.pop(event, None)
        else:
            pieces.append((most, event))
            most = len(waiting)
    return pieces, most, list(waiting), evicted


def _ranges(events: DataFrame, verdicts: DataFrame, size: int) -> DataFrame:
    """Arrivals (kind 0) and verdicts (kind 1) with the range they fall in and
    whether that is the event's own; written once."""
    n = events.count()
    dealt = events.repartitionByRange(max(1, -(-n // size)), "at", "id").withColumn("range", F.spark_partition_id())
    dealt = written(dealt, "queue-events")
    first = dealt.groupBy("range").agg(F.min("at").alias("at")).orderBy("range").collect()  # a row for each range
    borders = {r["at"]: r["range"] for r in first}  # of ranges that begin at one time the last one
    at = sorted(borders)
    number = F.lit([borders[a] for a in at] or [0])
    took = verdicts.groupBy("id").agg(F.min("at").alias("at")).join(dealt.select("id", F.col("range").alias("of"), F.col("at").alias("since")), "id").withColumn("at", F.greatest("at", "since"))
    bucket = Bucketizer(splits=[float("-inf"), *map(float, at[1:] or [0]), float("inf")], inputCol="_at", outputCol="_in")  # microseconds are exact doubles
    placed = bucket.transform(took.withColumn("_at", F.col("at").cast("double"))).withColumn("_in", F.least("_in", F.lit(max(0, len(at) - 1))))
    gone = placed.withColumn("range", F.greatest("of", number[F.col("_in").cast("int")]))
    return dealt.select("range", "id", "at", F.lit(0).alias("kind"), F.lit(True).alias("own")).unionByName(gone.select("range", "id", "at", F.lit(1).alias("kind"), (F.col("of") == F.col("range")).alias("own")))


def _passed(rows: DataFrame, keep: int) -> DataFrame:
    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        pieces, most, left, evicted = _simulated(part.sort_values(["at", "kind", "id"]), keep)
        return pd.DataFrame({"range": [key[0]], "pieces": [[{"most": m, "id": i} for m, i in pieces]], "most": [most], "left": [left], "evicted": [evicted]})

    return rows.groupBy("range").applyInPandas(one, _SUMMARY)


def evicted(events: DataFrame, verdicts: DataFrame, keep: int = 200, size: int = RANGE) -> DataFrame:
    """``id`` of the events that are evicted from a queue of ``keep`` before their verdict.

    ``events`` has (id, created_at), ``verdicts`` (event_id, performed_at); the
    first verdict counts.  What arrives at one time does so in order of the
    ids, and before verdicts of that time.  An empty table gives no rows; null
    ids and times are left out.  ``size`` events are a task's, about."""
    given = events.select(F.col("id").cast("long").alias("id"), F.unix_micros("created_at").alias("at")).where("id is not null and at is not null").groupBy("id").agg(F.min("at").alias("at"))
    told = verdicts.select(F.col("event_id").cast("long").alias("id"), F.unix_micros("performed_at").alias("at")).where("id is not null and at is not null")
    rows = written(_ranges(given, told, size), "queue-rows")
    inside = written(_passed(rows.where("own"), keep), "queue-inside")
    outlive = inside.select(F.explode("left").alias("id"))
    foreign = rows.where("not own").join(outlive, "id", "left_semi")
    summed = _passed(rows.where("own").unionByName(foreign), keep).select("range", "pieces", "most", "left")

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: OrderedDict[int, None] = OrderedDict()
        for batch in batches:
            out: list[int] = []

            def shrink(others: int, out: list[int] = out) -> None:
                while waiting and len(waiting) + others > keep:
                    out.append(waiting.popitem(last=False)[0])

            for pieces, most, left in zip(batch["pieces"], batch["most"], batch["left"]):
                for p in pieces:
                    shrink(p["most"])
                    waiting.pop(p["id"], None)
                shrink(most)
                waiting.update(dict.fromkeys(left))
            yield pd.DataFrame({"id": pd.Series(out, dtype="int64")})

    across = summed.repartition(1).sortWithinPartitions("range").mapInPandas(follow, "id long")  # a summary for each range
    return inside.select(F.explode("evicted").alias("id")).unionByName(across)


def pending_after(events: DataFrame, verdicts: DataFrame, keep: int = 200, size: int = RANGE) -> DataFrame:
    """``events`` that wait at the end: without a verdict, and not evicted."""
    gone = verdicts.select(F.col("event_id").alias("id")).unionByName(evicted(events, verdicts, keep, size)).distinct()
    return events.join(gone, "id", "left_anti")


def resolve_waiting(verdicts: DataFrame, events: DataFrame, actions: DataFrame, keep: int = 200, size: int = RANGE) -> DataFrame:
    """Verdicts (`review.parse_payload`) with ``event_id`` and ``took_ms`` as the
    queue knew them: null for an event that had been evicted, unless the payload
    names it."""
    waiting = events.join(evicted(events, actions, keep, size), "id", "left_anti")
    return resolve(verdicts, waiting)
