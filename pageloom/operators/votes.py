"""Votes and the trust of voters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.columns import half_up, yes
from pageloom.operators.limits import sliding_limit

# Days, counts, points and deductions of the trust rules.
MIN_ACTIVE_DAYS, MAX_IDLE_DAYS, MIN_LOGINS, MIN_SEARCHES = 14, 14, 3, 5
WEIGHT_TIERS = [(81, 1.0), (66, 0.75), (51, 0.5), (31, 0.25), (15, 0.1)]
SUSPICIOUS_MAX = 0.25
POINTS = {"login": 1, "search": 2, "click": 1, "days_30": 10, "days_90": 20, "email": 10, "phone": 5}
DEDUCTIONS = {"contrarian": 2, "false_reports": 3, "idle_week": 2}
BURST_SECONDS, BURST_VOTES = 600, 5
CONSENSUS_VOTES, CONSENSUS_HOURS = 20, 48


def _days(since: str, as_of: str) -> Column:
    return F.floor((F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp(since)) / 86_400)


def visibility_reason(as_of: str, score: str = "trust_score") -> Column:
    """Why a user's votes are hidden, or 'active'; the first rule that applies."""
    idle = (F.coalesce("logins_week", F.lit(0)) < MIN_LOGINS) & (F.coalesce("searches_week", F.lit(0)) < MIN_SEARCHES) & (F.coalesce(score, F.lit(0)) < 30)
    return (
        F.when(~yes("email_verified"), "email not verified")
        .when(F.col("active_since").isNull(), "no activity")
        .when(_days("active_since", as_of) < MIN_ACTIVE_DAYS, "too new")
        .when(_days("last_active", as_of) > MAX_IDLE_DAYS, "inactive too long")
        .when(idle, "too little this week")
        .otherwise("active")
    )


def weight_tier(score: Column) -> Column:
    out = F.lit(0.0)
    for least, weight in reversed(WEIGHT_TIERS):
        out = F.when(score >= least, weight).otherwise(out)
    return out


def vote_weight(users: DataFrame, as_of: str) -> DataFrame:
    """users with reason, visible and weight of their votes."""
    weight = F.when(F.col("visible"), weight_tier(F.col("trust_score"))).otherwise(0.0)
    out = users.withColumn("reason", visibility_reason(as_of)).withColumn("visible", F.col("reason") == "active")
    return out.withColumn("weight", F.when(yes("suspicious_ip"), F.least(weight, F.lit(SUSPICIOUS_MAX))).otherwise(weight))


def contrarian_voters(votes: DataFrame, community: DataFrame, as_of: str) -> DataFrame:
    """(user_id, n_votes, against) of users whose votes of the last 30 days, ten at least, differ from the sign of the domain's score in more than four of five cases."""
    recent = votes.where(F.col("created_at") >= F.to_timestamp(F.lit(as_of)) - F.expr("interval 30 days"))
    joined = recent.join(community.select("domain", "community_score"), "domain")
    rate = F.avg((F.col("value") != F.signum("community_score")).cast("int"))
    return joined.groupBy("user_id").agg(F.count("*").alias("n_votes"), F.round(rate, 4).alias("against")).where("n_votes >= 10 and against > 0.8")


def recompute_user_trust(users: DataFrame, activity: DataFrame, contrarian: DataFrame, as_of: str) -> DataFrame:
    """(id, trust_score, weight, visible, bonus flags) after one nightly pass: points for today's activity (activity has user_id, logins, searches, clicks and reports of the day), once-only bonuses, deductions, and decay for every full week without activity after the first."""
    a = activity.select(F.col("user_id").alias("id"), "logins", "searches", "clicks", "reports")
    u = users.join(a, "id", "left").join(contrarian.select(F.col("user_id").alias("id"), F.lit(True).alias("contrarian")), "id", "left")
    idle = F.coalesce((F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp("last_active")) / 86_400.0, F.lit(999.0))
    age = (F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp("created_at")) / 86_400.0
    earned = {
        "bonus_30": (age >= 30) & ~yes("bonus_30"),
        "bonus_90": (age >= 90) & ~yes("bonus_90"),
        "bonus_email": yes("email_verified") & ~yes("bonus_email"),
        "bonus_phone": yes("phone_verified") & ~yes("bonus_phone"),
    }
    points = (
        F.coalesce("trust_score", F.lit(0))
        + F.when(F.col("logins") > 0, POINTS["login"]).otherwise(0)
        + F.when(F.col("searches") > 0, POINTS["search"]).otherwise(0)
        + F.when(F.col("clicks") > 0, POINTS["click"]).otherwise(0)
        + sum((F.when(test, POINTS[p]).otherwise(0) for test, p in zip(earned.values(), ("days_30", "days_90", "email", "phone"))), F.lit(0))
        - F.when(yes("contrarian"), DEDUCTIONS["contrarian"]).otherwise(0)
        - F.when(F.col("reports") > 3, DEDUCTIONS["false_reports"]).otherwise(0)
        - F.when(idle > 7, F.floor(idle / 7) * DEDUCTIONS["idle_week"]).otherwise(0)
    )
    out = u.withColumn("trust_score", F.greatest(F.lit(0), F.least(F.lit(100), points)).cast("int")).withColumns({k: yes(k) | F.coalesce(t, F.lit(False)) for k, t in earned.items()})
    return vote_weight(out, as_of).select("id", "trust_score", "weight", "visible", *earned)


def domain_votes_weighted(votes: DataFrame) -> DataFrame:
    """Weighted sums by sign, count and score of each domain's visible votes."""
    part = lambda v: F.sum(F.when(F.col("value") == v, F.col("weight")).otherwise(0.0))
    score = F.round(F.try_divide(F.sum(F.col("value") * F.col("weight")), F.sum("weight")), 4)
    return votes.where("visible").groupBy("domain").agg(part(1).alias("positive_weight"), part(0).alias("neutral_weight"), part(-1).alias("negative_weight"), F.count("*").alias("visible_votes"), score.alias("community_score"))


def trust_status(users: DataFrame, as_of: str) -> DataFrame:
    """(id, status, progress) as shown to the user; the first rule that applies."""
    days = F.coalesce(_days("active_since", as_of), F.lit(0))
    u = vote_weight(users, as_of)
    status = F.when(~yes("email_verified"), "verify email").when(~F.col("visible"), "stay active")
    progress = F.when(~yes("email_verified"), 5).when(~F.col("visible"), F.least(F.lit(95), half_up(days / MIN_ACTIVE_DAYS * 100)))
    for least, name, done in ((81, "full member", 100), (66, "trusted", 80), (51, "established", 60), (31, "growing", 35)):
        status, progress = status.when(F.col("trust_score") >= least, name), progress.when(F.col("trust_score") >= least, done)
    return u.select("id", status.otherwise("building up").alias("status"), progress.otherwise(15).cast("long").alias("progress"))


def vote_bursts(votes: DataFrame) -> DataFrame:
    """votes with earlier, the user's votes in the ten minutes before, and rejected when these are five or more."""
    before = Window.partitionBy("user_id").orderBy(F.unix_timestamp("created_at")).rangeBetween(-BURST_SECONDS, 0)
    return votes.withColumn("earlier", F.count("*").over(before) - 1).withColumn("rejected", F.col("earlier") >= BURST_VOTES)


def accept_votes(votes: DataFrame, least: int = BURST_VOTES, seconds: int = BURST_SECONDS) -> DataFrame:
    """(user_id, id, accepted): like vote_bursts, but only accepted votes count as earlier ones. Busy users are cut at pauses, see limits.sliding_limit."""
    events = votes.select(F.col("user_id").alias("key"), F.unix_timestamp("created_at").alias("t"), "id")
    return sliding_limit(events, least, seconds + 1).withColumnRenamed("key", "user_id")


def fold_votes(votes: DataFrame) -> DataFrame:
    """(domain, positive, neutral, negative): a user's same vote twice takes it back, another one moves it. The last run of equal votes of a user on a domain decides: an odd number of them stands, an even number cancels out."""
    newest = Window.partitionBy("user_id", "domain").orderBy(F.desc("created_at"), F.desc("id"))
    rows = votes.withColumns({"__i": F.row_number().over(newest), "__last": F.first("value").over(newest)})
    runs = rows.groupBy("user_id", "domain").agg(F.first("__last").alias("v"), F.coalesce(F.min(F.when(F.col("value") != F.col("__last"), F.col("__i"))) - 1, F.count("*")).alias("run"))
    stands = lambda v: F.count_if((F.col("v") == v) & (F.col("run") % 2 == 1))
    return runs.groupBy("domain").agg(stands(1).alias("positive"), stands(0).alias("neutral"), stands(-1).alias("negative"))


def consensus(votes: DataFrame, as_of: str) -> DataFrame:
    """(domain, n_visible, oldest, has_consensus): twenty visible votes, the first two days old or more."""
    old = F.col("oldest") <= F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {CONSENSUS_HOURS} hours")
    return votes.where("visible").groupBy("domain").agg(F.count("*").alias("n_visible"), F.min("created_at").alias("oldest")).withColumn("has_consensus", (F.col("n_visible") >= CONSENSUS_VOTES) & old)


def evaluate_votes(votes: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """Each vote with its verdict: rejected in a burst of accepted votes, else the weight and visibility of its user, and whether its domain has consensus."""
    who = vote_weight(users, as_of).select(F.col("id").alias("user_id"), F.col("weight").alias("user_weight"), F.col("visible").alias("user_visible"))
    what = consensus(votes, as_of).select("domain", "has_consensus")
    out = votes.join(accept_votes(votes).select("id", (~F.col("accepted")).alias("rejected")), "id").join(who, "user_id", "left").join(what, "domain", "left")
    verdict = F.when(F.col("rejected"), "rejected").when(yes("user_visible"), "counted").otherwise("hidden")
    return out.select("id", "user_id", "domain", "value", verdict.alias("verdict"), F.when(F.col("rejected"), 0.0).otherwise(F.coalesce("user_weight", F.lit(0.0))).alias("vote_weight"), yes("has_consensus").alias("has_consensus"))


def approval(votes: DataFrame) -> DataFrame:
    """domain and approval in percent, null without votes for or against."""
    total = F.col("positive") + F.col("negative")
    return votes.select("domain", F.when(total > 0, half_up(F.try_divide(F.col("positive"), total) * 100)).alias("approval"))


def vote_leaderboard(votes: DataFrame, n: int = 500) -> DataFrame:
    total = F.col("positive") + F.col("neutral") + F.col("negative")
    return votes.withColumn("total", total).orderBy(F.desc("total"), "domain").limit(n).select("domain", "positive", "neutral", "negative", "total")


def vote_totals(votes: DataFrame) -> DataFrame:
    return votes.agg(F.count("*").alias("n_domains"), F.sum("positive").alias("positive"), F.sum("neutral").alias("neutral"), F.sum("negative").alias("negative"))


def user_interests(votes: DataFrame, n: int = 100) -> DataFrame:
    """(user_id, domain, times) over each user's n newest positive votes; by category too where votes have it."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    liked = votes.where("value = 1").withColumn("i", F.row_number().over(newest)).where(F.col("i") <= n)
    return liked.groupBy("user_id", "domain", *(c for c in ("category",) if c in votes.columns)).agg(F.count("*").alias("times"))


def ban_tiers(violations: DataFrame, limits: tuple = (3, 5, 10)) -> DataFrame:
    """violations (ip, ts, id) with the counts of the last hour, day and of all so far, the tier they lead to (3: seven days, 2: a day, 1: an hour) and its end. limits are the counts for tiers 1, 2 and 3."""
    t = F.unix_timestamp("ts")
    hour, day = (Window.partitionBy("ip").orderBy(t).rangeBetween(-s, 0) for s in (3600, 86_400))
    so_far = Window.partitionBy("ip").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    out = violations.withColumns({"last_hour": F.count("*").over(hour), "last_day": F.count("*").over(day), "so_far": F.count("*").over(so_far)})
    tier = F.when(F.col("so_far") >= limits[2], 3).when(F.col("last_day") >= limits[1], 2).when(F.col("last_hour") >= limits[0], 1).otherwise(0)
    hours = F.element_at(F.array(*map(F.lit, (1, 24, 168))), F.col("tier"))
    return out.withColumn("tier", tier).withColumn("until", F.when(F.col("tier") > 0, F.timestamp_add("HOUR", hours, F.col("ts"))))


def active_bans(bans: DataFrame, as_of: str) -> DataFrame:
    """The newest ban of each ip that still holds."""
    live = bans.where(F.coalesce(F.col("permanent"), F.lit(False)) | (F.col("until") > F.to_timestamp(F.lit(as_of))))
    newest = Window.partitionBy("ip").orderBy(F.desc("banned_at"), F.desc("id"))
    return live.withColumn("i", F.row_number().over(newest)).where("i = 1").drop("i")
