"""Sliding limits: how many events of a key may pass in any span of time, where events that didn't pass don't count."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.tables import materialised


def segments(events: DataFrame, span: int) -> DataFrame:
    """events (key, t, id) with segment, the t at which the event's run began: a run of a key ends where nothing comes for span or more. What happens in a run doesn't depend on other runs. Events of null t are runs of their own kind.

    Events are dealt by ranges of (key, t, id), so that a very busy key lies in many tasks. Within a range, an event looks at the one before; of each key and range only the last times go on to the next range."""
    spark = events.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = events.repartitionByRange(n, "key", "t", "id").withColumn("part", F.spark_partition_id())
    dealt = materialised(dealt, "ranges")
    own = Window.partitionBy("part", "key").orderBy("t", "id")
    before = Window.partitionBy("key").orderBy("part")
    ends = dealt.groupBy("part", "key").agg(F.max("t").alias("last")).withColumn("previous", F.lag("last").over(before)).select(F.col("part").alias("p"), F.col("key").alias("k"), "previous")
    same = (F.col("part") == F.col("p")) & F.col("key").eqNullSafe(F.col("k"))
    rows = dealt.withColumn("back", F.lag("t").over(own)).withColumn("i", F.row_number().over(own)).join(ends, same).drop("p", "k")
    previous = F.when(F.col("i") == 1, F.col("previous")).otherwise(F.col("back"))
    starts = F.when(previous.isNull() | (F.col("t") - previous >= span), F.col("t"))
    rows = rows.withColumn("start", starts).withColumn("here", F.last("start", True).over(own)).drop("back", "i", "previous", "start")
    carried = rows.groupBy("part", "key").agg(F.max("here").alias("newest")).withColumn("carried", F.last("newest", True).over(before.rowsBetween(Window.unboundedPreceding, -1))).select(F.col("part").alias("p"), F.col("key").alias("k"), "carried")
    return rows.join(carried, same).select("key", "t", "id", F.coalesce("here", "carried").alias("segment"))


def sliding_limit(events: DataFrame, most: int, span: int) -> DataFrame:
    """(key, id, accepted) of events (key, t, id), t a whole number: in order of t and id, an event is accepted if fewer than most accepted ones of its key came less than span before it. Events of null t are accepted and don't count; a null key is a key.

    Runs of events without a gap of span are folded apart, each in one pass over sorted rows that remembers the last most accepted times only."""
    kind, key = events.schema["id"].dataType.simpleString(), events.schema["key"].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, kept = None, deque(maxlen=most)
        for b in batches:
            accepted = []
            for of, t in zip(b["run"].to_numpy(), b["t"].to_numpy()):
                if of != run:
                    run = of
                    kept.clear()
                ok = len(kept) < most or t - kept[0] >= span
                accepted.append(ok)
                if ok:
                    kept.append(t)
            yield pd.DataFrame({"key": b["key"], "id": b["id"], "accepted": accepted})

    rows = segments(events, span)
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    timed = rows.where("t is not null").withColumn("run", F.to_json(F.struct("key", "segment"), {"ignoreNullFields": "false"})).select("run", F.col("key").cast("string").alias("key"), "t", F.col("id").cast("string").alias("id"), F.col("id").alias("order"))
    sorted_ = timed.repartition(n, "run").sortWithinPartitions("run", "t", "order").drop("order")
    folded = sorted_.mapInPandas(fold, "key string, id string, accepted boolean").select(F.col("key").cast(key).alias("key"), F.col("id").cast(kind).alias("id"), "accepted")
    return folded.unionByName(rows.where("t is null").select("key", "id", F.lit(True).alias("accepted")))
