"""Versioned and dated tables, and sliding limits over busy keys."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pageloom.operators import limits
from pageloom.sources import sinks


def test_a_crash_between_write_and_switch_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/table"
    sinks.publish(spark.range(3), path)
    with monkeypatch.context() as m:
        m.setattr(sinks, "switch", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            sinks.publish(spark.range(5), path)
    assert sinks.newest(spark, path).count() == 3
    reader = sinks.newest(spark, path)
    sinks.publish(spark.range(7), path)
    assert sinks.newest(spark, path).count() == 7 and reader.count() == 3
    assert sinks.drop_old_versions(spark, path, keep=1) == 2 and sinks.newest(spark, path).count() == 7
    assert len([f for f in os.listdir(tmp_path / "table") if f.startswith("version-")]) == 1


def test_only_touched_days_are_written_again_and_old_ones_go(spark, tmp_path):
    path = f"file://{tmp_path}/days"
    rows = spark.createDataFrame([(k, f"2024-01-0{d}", d) for k in range(4) for d in range(1, 6)] + [(9, None, 0)], "k int, day string, n int").withColumn("day", F.to_date("day"))
    sinks.write_days(rows, path)
    files = {d: sorted(os.listdir(tmp_path / "days" / d)) for d in os.listdir(tmp_path / "days") if d.startswith("day=")}
    new = spark.createDataFrame([(1, "2024-01-02", 20), (8, "2024-01-02", 80), (1, "2024-01-06", 60), (9, None, 1)], "k int, day string, n int").withColumn("day", F.to_date("day"))
    sinks.merge_days(new, path, ["k"])
    now = {d: sorted(os.listdir(tmp_path / "days" / d)) for d in os.listdir(tmp_path / "days") if d.startswith("day=")}
    assert {d for d in files if files[d] != now[d]} == {"day=2024-01-02", "day=__HIVE_DEFAULT_PARTITION__"} and set(now) - set(files) == {"day=2024-01-06"}
    got = {(r.k, str(r.day)): r.n for r in spark.read.parquet(path).collect()}
    assert got == {(k, f"2024-01-0{d}"): d for k in range(4) for d in range(1, 6)} | {(1, "2024-01-02"): 20, (8, "2024-01-02"): 80, (1, "2024-01-06"): 60, (9, "None"): 1}
    with pytest.raises(ValueError):
        sinks.merge_days(new, path, ["k"], most=1)
    assert sinks.expire_days(spark, path, "2024-01-06", 2) == ["day=2024-01-01", "day=2024-01-02", "day=2024-01-03"]
    assert {str(r.day) for r in spark.read.parquet(path).collect()} == {"2024-01-04", "2024-01-05", "2024-01-06", "None"}


def plain_limit(rows, most, span):
    out = []
    for key in {k for k, _, _ in rows}:
        kept = []
        for t, i in sorted((t, i) for k, t, i in rows if k == key and t is not None):
            kept = [x for x in kept if t - x < span]
            out.append((key, i, len(kept) < most))
            if out[-1][2]:
                kept.append(t)
        out += [(key, i, True) for k, t, i in rows if k == key and t is None]
    return sorted(map(repr, out))


@pytest.mark.parametrize(("most", "span"), [(1, 50), (3, 20), (5, 700)])
def test_limits_equal_the_fold_for_a_key_that_spans_all_partitions(spark, most, span):
    rng = random.Random(most)
    rows = [("busy", rng.randrange(20_000), i) for i in range(3_000)] + [(f"k{rng.randrange(40)}", rng.randrange(2_000), 10_000 + i) for i in range(1_000)]
    rows += [(None, 5, 20_000), (None, 6, 20_001), ("busy", None, 20_002), ("busy", 7, 20_003), ("busy", 7, 20_004)]
    events = spark.createDataFrame(rows, "key string, t long, id long")
    assert sorted(repr(tuple(r)) for r in limits.sliding_limit(events, most, span).collect()) == plain_limit(rows, most, span)
    if span == 20:  # pauses cut the busy key, so that it is folded in many tasks
        assert limits.segments(events, span).where("key = 'busy'").select("segment").distinct().count() > 20
    assert limits.sliding_limit(events.limit(0), most, span).collect() == []
