import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pageloom.operators import behaviour, links, moderation, votes
from pageloom.sources import views as v
from pageloom.streaming import jobs
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"


def streamed(spark, df, tmp_path, name):
    df.write.parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / name))


def drained(df, name, tmp_path, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(map(tuple, df.sparkSession.table(name).collect()), key=repr)


def test_message_limit_equals_its_fold(spark, tmp_path):
    rows = v.v_events(spark, SF).select((F.col("user_id") % 5).cast("string").alias("key"), F.col("event_id").alias("id"), "ts")
    stream = jobs.message_limit(streamed(spark, rows, tmp_path, "messages"), 2, 3600)
    want = sorted(map(tuple, jobs.message_limit_batch(rows, 2, 3600).collect()), key=repr)
    assert drained(stream, "limited", tmp_path) == want and {a for *_, a in want} == {True, False}


def test_windows_equal_batch(spark, tmp_path):
    log = v.v_query_log(spark, SF).select("query", "ts")
    stream = streamed(spark, log, tmp_path, "log")
    window = ("24 hours", "12 hours", 2)
    want = sorted(map(tuple, jobs.hot_queries(log, *window).collect()), key=repr)
    assert drained(jobs.hot_queries(stream, *window), "hot", tmp_path, "complete") == want and want
    history = log.groupBy("query").agg((F.count("*") / 30.0).alias("mean_day"))
    assert drained(jobs.trends(stream, history, 48, "24 hours", 2), "trending", tmp_path, "complete") == sorted(map(tuple, jobs.trends(log, history, 48, "24 hours", 2).collect()), key=repr)


def test_joins_equal_batch(spark, tmp_path):
    votes = v.v_vote_history(spark, SF)
    want = sorted(map(tuple, links.journey_pairs(votes).select("session_id", "source_url", "target_url").collect()), key=repr)
    assert drained(jobs.journeys(streamed(spark, votes, tmp_path, "votes")), "journeys", tmp_path) == want
    clicks = v.v_clicks(spark, SF)
    returns = clicks.where("id % 3 > 0").select(F.col("id").alias("click_id"), (F.col("clicked_at") + F.expr("interval 20 minutes")).alias("ts"), F.when(F.col("id") % 3 == 1, 5000).cast("long").alias("dwell_ms"))
    got = drained(jobs.close_clicks(streamed(spark, clicks, tmp_path, "clicks"), streamed(spark, returns, tmp_path, "returns")), "closed", tmp_path)
    assert got == sorted(((i, 5000, "pogo") if i % 3 == 1 else (i, 1_200_000, "good") for (i,) in clicks.where("id % 3 > 0").select("id").collect()), key=repr)


def test_rate_limits(spark):
    rows = spark.createDataFrame([("a", i) for i in range(61)] + [("b", i) for i in range(60)], "key string, n int").withColumn("ts", F.timestamp_seconds(F.col("n") % 60))
    assert [(r.key, r.n) for r in jobs.rate_limits(rows, "search").collect()] == [("a", 61)]


def test_vote_bursts_equal_the_batch_fold(spark, tmp_path):
    rows = v.v_user_votes(spark, SF).select((F.col("user_id") % 6).alias("user_id"), "id", "created_at")
    want = sorted(map(tuple, votes.accept_votes(rows, 2, 7200).collect()), key=repr)
    assert drained(jobs.vote_bursts(streamed(spark, rows, tmp_path, "ballots"), 2, 7200), "bursts", tmp_path) == want and {a for *_, a in want} == {True, False}


def test_ban_tiers_equal_the_batch_windows(spark, tmp_path):
    times = [0, 100, 200, 5000, 5100, 5200, 90_000, 200_000, 200_010, 200_020, 900_000, 1_900_000]
    rows = spark.createDataFrame([(ip, i, t + j) for j, ip in enumerate("ab") for i, t in enumerate(times[: 12 - 3 * j])], "ip string, id long, t long").select("ip", "id", F.timestamp_seconds("t").alias("ts"))
    want = sorted(map(tuple, votes.ban_tiers(rows).select("ip", "id", "tier", "until").collect()), key=repr)
    assert drained(jobs.ban_tiers(streamed(spark, rows, tmp_path, "violations")), "bans", tmp_path) == want and {r[2] for r in want} == {0, 1, 2, 3}


def test_moderation_stream_equals_batch(spark, tmp_path):
    posts = v.v_posts(spark, SF)
    columns = ("id", "insult_action", "insult_category", "spam_issues")
    want = sorted(map(tuple, moderation.insult_check(moderation.text_spam(posts)).select(*columns).collect()), key=repr)
    assert drained(jobs.moderate(streamed(spark, posts, tmp_path, "posts")).select(*columns), "moderated", tmp_path) == want


def fed(spark, df, tmp_path, name, batches=6):
    """The rows of df as a stream of micro-batches, dealt by chance."""
    folder = tmp_path / name
    for i in range(batches):
        df.where(F.pmod(F.xxhash64(*df.columns, F.lit(7)), F.lit(batches)) == i).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_sessions_close_like_the_batch_form_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    events = [(f"s{rng.randrange(6)}", start + timedelta(seconds=rng.randrange(20_000)), rng.random() < 0.55) for _ in range(400)]
    events += [("s0", start + timedelta(seconds=100), True), ("s0", start + timedelta(seconds=100), False), ("s0", start + timedelta(seconds=100), False)]
    clicks = spark.createDataFrame([(i, s, t) for i, (s, t, c) in enumerate(events) if c], "id long, session_id string, clicked_at timestamp")
    returns = spark.createDataFrame([(s, t, rng.choice([None, 0, 5000])) for s, t, c in events if not c], "session_id string, ts timestamp, dwell_ms long")
    closed = behaviour.close_clicks(clicks, returns).withColumn("quality", behaviour.dwell_label(F.col("dwell_ms"))).select("id", "dwell_ms", "returned_at", "quality")
    want = sorted(map(tuple, closed.collect()))
    assert {q for *_, q in want} == {"pogo", "neutral", "good", "open"}
    # A last click of another session moves the watermark on, beyond the last timer.
    last = spark.createDataFrame([(10_000, "end", start + timedelta(days=2))], clicks.schema)
    stream = jobs.close_sessions(fed(spark, clicks, tmp_path, "in-clicks"), fed(spark, returns, tmp_path, "in-returns"), "1 day")
    def run():
        stream.writeStream.format("parquet").option("path", str(tmp_path / "closed")).option("checkpointLocation", str(tmp_path / "sessions-state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "closed")).collect()))

    assert len(run()) < len(want)  # the watermark is a day behind
    last.write.mode("append").parquet(str(tmp_path / "in-clicks"))
    assert run() == want  # a restart goes on where the first run ended


def test_a_session_closes_older_clicks_once_newer_ones_are_closed(spark):
    at = lambda m: datetime(2024, 1, 1, 12) + timedelta(minutes=m)
    clicks = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(1)), (3, "a", at(50)), (4, "b", at(0))], "id long, session_id string, clicked_at timestamp")
    returns = spark.createDataFrame([("a", at(2), None), ("a", at(3), None), ("a", at(4), None), ("a", at(81), None), ("a", at(82), None), ("b", at(30), 7)], "session_id string, ts timestamp, dwell_ms long")
    got = {r.id: (r.dwell_ms, r.returned_at) for r in behaviour.close_clicks(clicks, returns).collect()}
    assert got == {1: (180_000, at(3)), 2: (60_000, at(2)), 3: (None, None), 4: (7, at(30))}


def test_the_verdict_log_holds_each_message_once_after_a_crash(spark, tmp_path, monkeypatch):
    rows = [(i, "item", "s", f"du bist ein idiot nummer {i // 2}" if i % 3 == 0 else f"ein ganz normaler satz {i // 2} über spam", datetime(2024, 1, 1) + timedelta(seconds=i)) for i in range(40)]
    messages = spark.createDataFrame(rows, "id long, kind string, scope string, body string, ts timestamp").coalesce(1)
    patterns = spark.createDataFrame([(1, "satz 7", "phrase", "ads", 5, "flag", True)], "id long, pattern string, kind string, category string, priority int, action string, active boolean")
    log, state, broken = str(tmp_path / "log"), str(tmp_path / "log-state"), []
    stream = fed(spark, messages, tmp_path, "in-messages")

    def failing(write, batch, number):
        write(batch, number)
        if number == 2 and not broken:
            broken.append(number)
            raise RuntimeError("lost")

    original = DataStreamWriter.foreachBatch
    with monkeypatch.context() as m:
        m.setattr(DataStreamWriter, "foreachBatch", lambda self, write: original(self, lambda batch, number: failing(write, batch, number)))
        writer = jobs.log_verdicts(stream, patterns, log)
    with pytest.raises(Exception, match="lost"):
        writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert broken == [2]
    jobs.log_verdicts(stream, patterns, log).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(log).collect()
    bodies = [r.text for r in found]
    assert len(bodies) == len(set(bodies)) == len({b for _, _, _, b, _ in rows})
    assert all(r.blocked == ("idiot" in r.text) and r.flagged == ("satz 7" in r.text) for r in found) and any(r.flagged for r in found)
