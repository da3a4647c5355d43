"""The time-dependent operators as Structured Streaming jobs; each has a batch form that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pageloom.functions.columns import tokens
from pageloom.operators import behaviour, moderation, votes
from pageloom.operators.limits import sliding_limit

# Requests of a key that a tumbling window allows, and its seconds.
LIMITS = {"search": (60, 60), "global": (1000, 900), "login": (5, 900), "vote": (20, 600)}
MESSAGES, MESSAGE_SECONDS = 5, 10


def hot_queries(log: DataFrame, window: str = "10 minutes", slide: str = "1 minute", least: int = 3, late: str = "10 minutes") -> DataFrame:
    """(start, query, n): queries with least searches in a sliding window."""
    counts = log.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w"), "query").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least).select(F.col("w.start").alias("start"), "query", "n")


def trends(log: DataFrame, history: DataFrame, hours: int = 2, slide: str = "15 minutes", least: int = 15) -> DataFrame:
    """(start, query, n, factor): searches of a sliding window against the mean day of the past; history (query, mean_day) is a static table."""
    counts = log.withWatermark("ts", f"{hours} hours").groupBy(F.window("ts", f"{hours} hours", slide).alias("w"), "query").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    expected = F.coalesce(F.col("mean_day") / 24.0 * hours, F.lit(1.0))
    return counts.join(history, "query", "left").select(F.col("w.start").alias("start"), "query", "n", F.round(F.try_divide(F.col("n"), expected), 2).alias("factor"))


def rate_limits(events: DataFrame, kind: str, key: str = "key", late: str = "1 minute") -> DataFrame:
    """(start, key, n) of tumbling windows in which a key passes the limit of its kind."""
    most, seconds = LIMITS[kind]
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds").alias("w"), key).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > most).select(F.col("w.start").alias("start"), key, "n")


def _sliding_log(most: int, seconds: int):
    """State of a key: times of the messages that were let through lately. Rejected ones leave no trace."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        accepted = []
        for t in rows["ts"].astype("datetime64[us]").astype("int64"):
            kept = [k for k in kept if k > t - seconds * 1_000_000]
            accepted.append(len(kept) < most)
            if accepted[-1]:
                kept.append(int(t))
        state.update((kept,))
        state.setTimeoutTimestamp(max(max(kept, default=0) // 1_000 + seconds * 1_000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"key": key[0], "id": rows["id"].to_numpy(), "accepted": accepted})

    return step


def message_limit(messages: DataFrame, most: int = MESSAGES, seconds: int = MESSAGE_SECONDS, late: str = "1 minute") -> DataFrame:
    """(key, id, accepted) of messages (key, id, ts): a key may send most messages in any so many seconds; rejected ones don't count. The state of a key goes once the watermark has passed its last message by that time."""
    return messages.select("key", "id", "ts").withWatermark("ts", late).groupBy("key").applyInPandasWithState(_sliding_log(most, seconds), "key string, id long, accepted boolean", "kept array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def message_limit_batch(messages: DataFrame, most: int = MESSAGES, seconds: int = MESSAGE_SECONDS) -> DataFrame:
    """The batch form, see limits.sliding_limit."""
    return sliding_limit(messages.select("key", F.unix_micros("ts").alias("t"), "id"), most, seconds * 1_000_000)


def _vote_bursts(most: int, seconds: int):
    """State of a user: times, in seconds, of the accepted votes of late."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches))
        rows = rows.assign(t=rows["created_at"].astype("datetime64[us]").astype("int64") // 1_000_000).sort_values(["t", "id"])
        accepted = []
        for t in rows["t"]:
            kept = [k for k in kept if k >= t - seconds]
            accepted.append(len(kept) < most)
            if accepted[-1]:
                kept.append(int(t))
        state.update((kept,))
        state.setTimeoutTimestamp(max(max(kept, default=0) * 1_000 + seconds * 1_000, state.getCurrentWatermarkMs()) + 1_000)
        yield pd.DataFrame({"user_id": key[0], "id": rows["id"].to_numpy(), "accepted": accepted})

    return step


def vote_bursts(ballots: DataFrame, most: int = votes.BURST_VOTES, seconds: int = votes.BURST_SECONDS, late: str = "1 minute") -> DataFrame:
    """(user_id, id, accepted) of votes (user_id, id, created_at): a vote is rejected when most accepted ones of its user lie in the seconds before. A user's state goes once the watermark has passed it. votes.accept_votes is the batch form; votes that come late within a user are judged after those of earlier batches."""
    rows = ballots.select("user_id", "id", "created_at").withWatermark("created_at", late)
    return rows.groupBy("user_id").applyInPandasWithState(_vote_bursts(most, seconds), "user_id long, id long, accepted boolean", "kept array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def _ban_tiers(limits: tuple):
    """State of an address: the times, in seconds, of its newest violations, no more than a limit asks for, and their number so far. The number has no end, so the state stays."""
    hour_limit, day_limit, all_limit = limits

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, so_far = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        tiers = []
        for t in rows["ts"].astype("datetime64[us]").astype("int64") // 1_000_000:
            newest, so_far = [*newest, int(t)][-max(hour_limit, day_limit) :], so_far + 1
            within = lambda n, s: len(newest) >= n and newest[-n] >= t - s  # noqa: B023, E731
            tiers.append(3 if so_far >= all_limit else 2 if within(day_limit, 86_400) else 1 if within(hour_limit, 3_600) else 0)
        state.update((newest, so_far))
        yield pd.DataFrame({"ip": key[0], "id": rows["id"].to_numpy(), "ts": rows["ts"].to_numpy(), "tier": tiers})

    return step


def ban_tiers(violations: DataFrame, limits: tuple = (3, 5, 10)) -> DataFrame:
    """(ip, id, tier, until) of violations (ip, id, ts) as votes.ban_tiers has them, but violations of the same second count from the one before on."""
    out = violations.select("ip", "id", "ts").groupBy("ip").applyInPandasWithState(_ban_tiers(limits), "ip string, id long, ts timestamp, tier int", "newest array<long>, so_far long", "append", GroupStateTimeout.NoTimeout)
    hours = F.element_at(F.array(*map(F.lit, (1, 24, 168))), F.col("tier"))
    return out.select("ip", "id", "tier", F.when(F.col("tier") > 0, F.timestamp_add("HOUR", hours, F.col("ts"))).alias("until"))


def close_clicks(clicks: DataFrame, returns: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(id, dwell_ms, quality): clicks closed by a return that names them within half an hour; returns has click_id, ts and dwell_ms."""
    c = clicks.select("id", F.col("clicked_at").alias("at")).withWatermark("at", late)
    r = returns.select("click_id", F.col("ts").alias("then"), "dwell_ms").withWatermark("then", late)
    near = (F.col("id") == F.col("click_id")) & (F.col("then") >= F.col("at")) & (F.col("then") <= F.col("at") + F.expr(f"interval {behaviour.SESSION_MINUTES} minutes"))
    return c.join(r, near).select("id", F.coalesce("dwell_ms", F.unix_millis("then") - F.unix_millis("at")).alias("dwell_ms")).withColumn("quality", behaviour.dwell_label(F.col("dwell_ms")))


def _sessions(span_ms: int):
    """State of a session: events that the watermark hasn't passed yet, and the open clicks, oldest first. Times are in microseconds; a return has no click id (-1), and -1 says that it brings no dwell time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, opened = [], []
        if state.exists:
            t, kind, ids, own, open_t, open_id = state.get
            waiting, opened = list(zip(t, kind, ids, own)), list(zip(open_t, open_id))
        if not state.hasTimedOut:
            for b in batches:
                waiting += zip(b["ts"].astype("datetime64[us]").astype("int64").tolist(), b["kind"].tolist(), b["id"].tolist(), b["own"].tolist())
        passed = state.getCurrentWatermarkMs() * 1_000
        now, out = sorted(e for e in waiting if e[0] <= passed), []
        waiting = [e for e in waiting if e[0] > passed]
        for t, kind, id_, own in now:
            if kind == 0:
                opened.append((t, id_))
            elif opened and t // 1_000 - opened[-1][0] // 1_000 <= span_ms:
                start, click = opened.pop()
                out.append((click, own if own >= 0 else t // 1_000 - start // 1_000, t))
        # A return that is still to come is later than the watermark and than all events so far.
        gone = [c for c in opened if passed // 1_000 - c[0] // 1_000 > span_ms]
        out += [(click, None, None) for _, click in gone]
        opened = opened[len(gone) :]
        if waiting or opened:
            state.update((*([e[i] for e in waiting] for i in range(4)), [c[0] for c in opened], [c[1] for c in opened]))
            next_ = min([e[0] // 1_000 + 1 for e in waiting] + [c[0] // 1_000 + span_ms + 1 for c in opened])
            state.setTimeoutTimestamp(max(next_, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"id": pd.Series([c for c, _, _ in out], dtype="int64"), "dwell_ms": pd.array([d for _, d, _ in out], dtype="Int64"), "returned_at": pd.to_datetime(pd.Series([t for _, _, t in out], dtype="Int64"), unit="us")})

    return step


def close_sessions(clicks: DataFrame, returns: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(id, dwell_ms, returned_at, quality) of every click, once: when a return of its session (session_id, ts, dwell_ms) closes it, as behaviour.close_clicks has it, or half an hour later, still open. Clicks and returns may come in any order within the time that late allows; they are judged once the watermark has passed them. A timer lets open clicks go where nothing follows, so no session's state outlives its last click by more than half an hour and the delay.

    Ids are numbers of 0 and more, and so are dwell times; rows without session or time go."""
    c = clicks.select("session_id", F.col("clicked_at").alias("ts"), F.lit(0).alias("kind"), F.col("id").cast("long").alias("id"), F.lit(-1).cast("long").alias("own"))
    r = returns.select("session_id", "ts", F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("id"), F.coalesce(F.col("dwell_ms").cast("long"), F.lit(-1)).alias("own"))
    events = c.unionByName(r).where("session_id is not null and ts is not null").withWatermark("ts", late)
    state = "t array<long>, kind array<int>, id array<long>, own array<long>, open_t array<long>, open_id array<long>"
    out = events.groupBy("session_id").applyInPandasWithState(_sessions(behaviour.SESSION_MINUTES * 60_000), "id long, dwell_ms long, returned_at timestamp", state, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("quality", behaviour.dwell_label(F.col("dwell_ms")))


def journeys(votes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(session_id, source_url, target_url): up-votes of a session within an hour of each other, as a join of the stream with itself."""
    up = votes.where("vote_type = 'up'")
    a = up.select("session_id", F.col("url").alias("source_url"), F.col("created_at").alias("at")).withWatermark("at", late)
    b = up.select(F.col("session_id").alias("s"), F.col("url").alias("target_url"), F.col("created_at").alias("then")).withWatermark("then", late)
    near = (F.col("session_id") == F.col("s")) & (F.col("then") > F.col("at")) & (F.col("then") < F.col("at") + F.expr("interval 60 minutes")) & (F.col("source_url") != F.col("target_url"))
    return a.join(b, near).select("session_id", "source_url", "target_url")


def moderate(messages: DataFrame, text: str = "body") -> DataFrame:
    """Messages with their spam and insult verdicts; no state."""
    return moderation.insult_check(moderation.text_spam(messages, text), text)


def log_verdicts(messages: DataFrame, patterns: DataFrame, path: str, late: str = "1 hour", text: str = "body") -> DataStreamWriter:
    """A writer, to be given a checkpoint location and started, that appends a row of the verdict log for every message (id, kind, scope, body, ts) to the table at path. A message with the same words as another one of its scope within late is dropped. Rules come first, then the pattern table, which is read anew in every batch.

    Each batch is a folder of its own, batch=<number>, which a batch that is run again after a failure replaces. So the log holds each message once whatever happens between a write and the note that it is done. checked_at is the message's own time, which makes reruns equal."""
    words = F.sha2(F.array_join(tokens(F.col(text)), " "), 256)
    fresh = messages.withColumn("__words", words).withWatermark("ts", late).dropDuplicatesWithinWatermark(["scope", "__words"]).drop("__words")

    def write(batch: DataFrame, number: int) -> None:
        moderation.verdicts(moderation.first_verdict(batch, patterns, text), F.col("ts")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return fresh.writeStream.foreachBatch(write)
