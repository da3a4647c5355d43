"""Moderation of user-written posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.columns import tokens, yes
from pageloom.operators.vectors import dots, near

# Least and greatest length of a text by field, and the other limits.
LENGTHS = {"title": (5, 200), "description": (20, 2000), "item": (10, 1000), "comment": (5, 500)}
OTHER_LENGTHS = (5, 2000)
MIN_SEMANTIC = 10
MAX_URLS, MAX_EMOJIS, MAX_UPPER, MAX_SPECIAL, MAX_REPEAT = 2, 8, 0.6, 0.35, 4
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
SPAM_PHRASES = ["jetzt kaufen", "klick hier", "geld verdienen", "kostenlos gewinnen", "casino", "viagra", "click here", "buy now", "free money"]

#: Patterns that are tried on every post at a time, and pattern vectors that tasks hold at a time.
SHORT_PATTERNS, PATTERN_VECTORS = 1_000, 5_000

# Words that address someone, speak of oneself, attack, or belong to games or hyperbole.
ADDRESSED = "du|dich|dir|dein|deine|deinen|deinem|euch|ihr|euer|eure"
ABOUT_SELF = "ich (bin|fühle|finde|glaube|denke|mache|hab|habe)"
ATTACK = "du (bist|eine?|so eine?|wirkst wie eine?)"
GAMING = "game|level|boss|match|run|quest|raid|pvp|clan|server|runde|spieler|team|map|skillz?"
HYPERBOLE = "vor (lachen|freude|aufregung|müdigkeit)|tot lachen|umhauen|umwerfend"
#: Begins a context that must hold after the first of a rule's words.
AFTER = "after:"
# Words near a political name that make it an attack, before it and after it.
NAME_CALLING = ATTACK + "|(du|ihr) [^ ]* ?(nazi|faschist)[^ ]*"
CALLED = "du|dich|dir|euch"
# Ordered rules (words, action, category, context that must hold, contexts that must not).
INSULT_RULES = [
    ("dumm|doof|bescheuert|blöd|bloed", "block", "insult", ADDRESSED, (ABOUT_SELF,)),
    ("idiot|vollidiot|trottel|depp|volldepp|dämlack|blödmann|hohlkopf|dummkopf", "block", "insult", None, ()),
    ("behindert", "block", "insult", ADDRESSED, ()),
    ("verrückt|wahnsinnig|irre|durchgeknallt", "flag", "insult", ATTACK, ()),
    ("arschloch|wichser|hurensohn|bastard", "block", "insult", None, ()),
    ("hure|schlampe|nutte|miststück", "block", "insult", None, ()),
    ("ich (schlag|haue?|treffe?|finde?|kenne?) (dich|deine?n?|euch)", "block", "threat", None, ()),
    ("wirst das bereuen|pass auf dich auf|ich wei[sß] wo du|ich finde? dich", "block", "threat", None, ()),
    ("töten|umbringen|abstechen|erschießen|killen|ermorden", "block", "threat", ADDRESSED, (GAMING, HYPERBOLE)),
    ("ich hasse? (dich|euch)", "block", "hostility", None, ()),
    ("nazi|faschist|faschistin", "block", "hate", NAME_CALLING, ()),
    ("nazi|faschist", "block", "hate", AFTER + CALLED, ()),
    ("halts? (mal )?(die )?(fresse|schnauze|klappe|maul)|verpiss dich|fick dich|leck mich", "block", "insult", None, ()),
    ("scheiß(kerl|typ|mensch|frau|kind)?|dreckig(er?)?", "flag", "borderline", ADDRESSED, ()),
    ("loser|versager|nichtsnutz|taugenichts", "flag", "insult", ADDRESSED, ()),
    ("bring dich um|erhäng dich|schneid dich|töte? dich selbst", "block", "self-harm", None, ()),
]


def spoken(text: Column) -> Column:
    """The words of a text between single spaces, with digits inside read as letters and runs of one letter cut to two."""
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), "0134578", "oieastb")
    low = F.regexp_replace(F.regexp_replace(low, r"[*!@#$%^&_+.]", ""), r"([a-zäöüß])\1{2,}", "$1$1")
    return F.concat(F.lit(" "), F.array_join(tokens(low), " "), F.lit(" "))


def says(words: Column, pattern: str) -> Column:
    return words.rlike(f" ({pattern}) ")


def text_spam(posts: DataFrame, text: str = "body", field: str = "kind") -> DataFrame:
    """posts with spam_issues, an array of all rules that the text breaks, and spam_ok."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    limit = lambda i: F.coalesce(*(F.when(F.col(field) == k, v[i]) for k, v in LENGTHS.items()), F.lit(OTHER_LENGTHS[i]))
    n, letters = F.length(t), F.regexp_count(t, F.lit("[a-zA-ZäöüÄÖÜ]"))
    issues = {
        "empty": n == 0,
        "too_short": (n > 0) & (n < limit(0)),
        "too_long": n > limit(1),
        "too_many_urls": F.regexp_count(t, F.lit(r"https?://\S+|www\.\S+")) > MAX_URLS,
        "too_many_emojis": F.regexp_count(t, F.lit(EMOJI)) > MAX_EMOJIS,
        "excessive_caps": (n > 10) & (letters > 0) & (F.regexp_count(t, F.lit("[A-ZÄÖÜ]")) > letters * MAX_UPPER),
        "repeating_chars": t.rlike(r"(.)\1{%d,}" % MAX_REPEAT),
        "too_many_special_chars": (n > 10) & (F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s]")) > n * MAX_SPECIAL),
        "spam_phrase": F.coalesce(*(F.when(F.contains(F.lower(t), F.lit(p)), True) for p in SPAM_PHRASES), F.lit(False)),
    }
    found = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in issues.items())))
    return posts.withColumn("spam_issues", found).withColumn("spam_ok", F.size("spam_issues") == 0)


def insult_check(posts: DataFrame, text: str = "body") -> DataFrame:
    """posts with insult_action (block, flag or null) and insult_category of the first rule that applies."""
    out = posts.withColumn("__w", spoken(F.col(text)))
    hit = None
    for words, action, category, needs, excludes in INSULT_RULES:
        test = says(F.col("__w"), words)
        if needs and needs.startswith(AFTER):
            test &= says(F.substr("__w", F.regexp_instr("__w", F.lit(f" ({words}) ")) + 1), needs.removeprefix(AFTER))
        elif needs:
            test &= says(F.col("__w"), needs)
        for e in excludes:
            test &= ~says(F.col("__w"), e)
        verdict = F.struct(F.lit(action).alias("action"), F.lit(category).alias("category"))
        hit = F.when(test, verdict) if hit is None else hit.when(test, verdict)
    return out.withColumn("__h", hit).withColumn("insult_action", F.col("__h.action")).withColumn("insult_category", F.col("__h.category")).drop("__w", "__h")


def pattern_check(posts: DataFrame, patterns: DataFrame, text: str = "body", id_col: str = "id") -> DataFrame:
    """(id, pattern_id, action, category): the active pattern of most priority that each post matches, posts without one left out. Phrases match anywhere in the text in any case; regex patterns are tried as such.

    A phrase of three words and more holds its second word whole, so posts are joined to such phrases by that word. Shorter phrases and regular expressions are tried on every post: in turns of SHORT_PATTERNS, which tasks hold.
    """
    p = patterns.where("active").select(F.col("id").alias("pattern_id"), "pattern", F.col("kind").alias("pattern_kind"), "category", "priority", "action")
    p = p.withColumn("__words", F.split(F.lower("pattern"), " ")).withColumn("__key", F.when((F.col("pattern_kind") == "phrase") & (F.size("__words") > 2), F.element_at("__words", 2)))
    own = posts.select(id_col, F.col(text).alias("__text"), F.lower(text).alias("__low"))
    keyed = p.where("__key is not null")
    words = own.select(F.col(id_col).alias("__post"), F.explode(F.array_distinct(F.split("__low", " "))).alias("__key"))
    verdict = F.struct(-F.col("priority"), F.col("pattern_id"), F.col("action"), F.col("category"))
    maybe = words.join(keyed, "__key").drop("__key", "__words")  # texts come in afterwards, so that no word carries its text
    found = own.join(maybe, F.col(id_col) == F.col("__post")).where(F.contains("__low", F.lower("pattern"))).select(id_col, verdict.alias("v"))
    rest = p.where("__key is null").select("pattern_id", "pattern", "pattern_kind", "category", "priority", "action")
    blocks = -(-rest.count() // SHORT_PATTERNS)
    hit = F.when(F.col("pattern_kind") == "phrase", F.contains("__low", F.lower("pattern"))).otherwise(F.rlike("__text", F.col("pattern")))
    for i in range(blocks):
        found = found.unionByName(own.join(F.broadcast(rest.where(F.pmod(F.xxhash64("pattern_id"), F.lit(blocks)) == i)), hit).select(id_col, verdict.alias("v")))
    best = found.groupBy(id_col).agg(F.min("v").alias("v"))
    return best.select(id_col, "v.pattern_id", "v.action", "v.category")


def moderate(posts: DataFrame, patterns: DataFrame, duplicates: DataFrame, text: str = "body") -> DataFrame:
    """(id, ok, step, detail): the first of the checks that a post fails: required, spam, insult, pattern, duplicate. duplicates has the ids of posts that repeat an earlier one."""
    checked = insult_check(text_spam(posts, text), text)
    checked = checked.join(pattern_check(posts, patterns, text), "id", "left").join(duplicates.select("id", F.lit(True).alias("repeat")).distinct(), "id", "left")
    step = (
        F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", "required")
        .when(~F.col("spam_ok"), "spam")
        .when(F.col("insult_action") == "block", "insult")
        .when(F.col("action") == "block", "pattern")
        .when(yes("repeat"), "duplicate")
    )
    detail = F.when(F.col("step") == "spam", F.array_join("spam_issues", ",")).when(F.col("step") == "insult", F.col("insult_category")).when(F.col("step") == "pattern", F.col("category"))
    return checked.withColumn("step", step).select("id", F.col("step").isNull().alias("ok"), "step", detail.alias("detail"))


def combined_verdict(posts: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """posts (with verdicts title_action and body_action) with the graver of the two."""
    worse = F.when((F.col("title_action") == "block") | (F.col("body_action") == "block"), "block").when((F.col("title_action") == "flag") | (F.col("body_action") == "flag"), "flag").otherwise("allow")
    return posts.withColumn("verdict", worse)


def first_verdict(posts: DataFrame, patterns: DataFrame, text: str = "body") -> DataFrame:
    """posts as insult_check leaves them, where those that no rule hits have the action and category of the pattern that they match."""
    hit = pattern_check(posts, patterns, text).select(F.col("id").alias("__id"), F.col("action").alias("__action"), F.col("category").alias("__category"))
    out = insult_check(posts, text).join(hit, F.col("id") == F.col("__id"), "left")
    free = F.col("insult_action").isNull()
    return out.withColumns({"insult_category": F.when(free, F.col("__category")).otherwise(F.col("insult_category")), "insult_action": F.when(free, F.col("__action")).otherwise(F.col("insult_action"))}).drop("__id", "__action", "__category")


def verdicts(posts: DataFrame, checked_at: str | Column) -> DataFrame:
    """Rows of the verdict log for checked posts (id, kind, body, insult_action, insult_category), checked at a stated time or at that of a column."""
    at = F.to_timestamp(F.lit(checked_at)) if isinstance(checked_at, str) else checked_at
    blocked, flagged = F.coalesce(F.col("insult_action") == "block", F.lit(False)), F.coalesce(F.col("insult_action") == "flag", F.lit(False))
    score = F.when(blocked, 1.0).when(flagged, 0.5).otherwise(0.0).cast("decimal(5,3)")
    return posts.select(F.col("id").alias("post_id"), "kind", F.left("body", F.lit(500)).alias("text"), score.alias("score"), F.coalesce("insult_action", F.lit("allow")).alias("action"), F.col("insult_category").alias("category"), blocked.alias("blocked"), flagged.alias("flagged"), at.alias("checked_at"))


def moderation_stats(log: DataFrame, as_of: str) -> DataFrame:
    """Verdicts of the last seven days by category."""
    return log.where(F.col("checked_at") >= F.to_timestamp(F.lit(as_of)) - F.expr("interval 7 days")).groupBy("category").agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked"), F.count_if("flagged").alias("flagged"), F.round(F.avg(F.col("score").cast("double")), 4).alias("mean_score"))


def pattern_stats(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("category").agg(F.count("*").alias("n"), F.count_if("active").alias("active"), F.round(F.avg("priority"), 4).alias("mean_priority"), F.array_join(F.array_sort(F.collect_set("action")), ",").alias("actions"))


def moderation_queue(log: DataFrame, n: int = 100) -> DataFrame:
    """The newest n verdicts that block or flag, with a status and a preview of 200 characters."""
    status = F.when(F.col("blocked"), "blocked").otherwise("flagged")
    return log.where("blocked or flagged").orderBy(F.desc("checked_at"), F.desc("post_id")).limit(n).select("post_id", "kind", status.alias("status"), F.left("text", F.lit(200)).alias("preview"), "category")


def apply_actions(content: DataFrame, actions: DataFrame) -> DataFrame:
    """content (id, hidden) after its newest review action: release and ignore show it, hide hides it, delete drops it. actions has id, action, ts and action_id."""
    newest = Window.partitionBy("id").orderBy(F.desc("ts"), F.desc("action_id"))
    last = actions.withColumn("i", F.row_number().over(newest)).where("i = 1").select("id", "action")
    out = content.join(last, "id", "left").where(~F.coalesce(F.col("action") == "delete", F.lit(False)))
    return out.withColumn("hidden", F.when(F.col("action").isin("release", "ignore", "approve"), False).when(F.col("action").isin("hide", "reject"), True).otherwise(yes("hidden"))).drop("action")


def ingest_reports(raw: DataFrame, targets: DataFrame) -> DataFrame:
    """Reports (report_id, kind, target_id, reason, created_at) with a known kind and reason whose target exists, with the deadline of the reporter's address a year on."""
    valid = F.col("kind").isin("list", "item", "comment") & F.col("reason").isin("spam", "insult", "illegal", "wrong", "other")
    return raw.where(valid).join(targets.select(F.col("id").alias("target_id"), "kind"), ["target_id", "kind"], "left_semi").withColumn("ip_deadline", F.col("created_at") + F.expr("interval 1 year"))


def auto_hide(content: DataFrame, reports: DataFrame, least: int = 3) -> DataFrame:
    """content with report_count, and hidden where it has least reports or more."""
    n = reports.groupBy(F.col("target_id").alias("id"), "kind").agg(F.count("*").alias("report_count"))
    out = content.join(n, ["id", "kind"], "left").withColumn("report_count", F.coalesce("report_count", F.lit(0)))
    return out.withColumn("hidden", F.col("report_count") >= least)


def anonymise_ips(posts: DataFrame, as_of: str) -> DataFrame:
    """posts with author_ip taken out once its deadline has passed."""
    return posts.withColumn("author_ip", F.when(F.col("ip_deadline") <= F.to_timestamp(F.lit(as_of)), F.lit(None)).otherwise(F.col("author_ip")))


def visible_only(posts: DataFrame) -> DataFrame:
    return posts.where(~yes("hidden"))


def flag_injection(log: DataFrame, text: str = "query") -> DataFrame:
    """log with suspicious: text that looks like SQL or script."""
    return log.withColumn("suspicious", F.coalesce(F.col(text).rlike(r"(?i)(union\s+select|drop\s+table|insert\s+into|delete\s+from|;\s*--|<script|javascript:|onerror\s*=)"), F.lit(False)))


def semantic_check(vectors: DataFrame, patterns: DataFrame, least: float = 0.82) -> DataFrame:
    """(id, pattern_id, cosine) of the nearest pattern vector where its cosine passes the limit. A vector is not compared with the pattern of its own id."""
    best = semantic_matches(vectors, patterns, least).where(F.col("cosine") > least).groupBy("id").agg(F.max_by("pattern_id", F.struct(F.col("cosine"), -F.col("pattern_id"))).alias("pattern_id"), F.max("cosine").alias("cosine"))
    return best


def nearest_phrase(posts: DataFrame, vectors: DataFrame, patterns: DataFrame, pattern_vectors: DataFrame, least: float = 0.82, text: str = "body") -> DataFrame:
    """(id, pattern_id, similarity): 1.0 for the first pattern (id, pattern) whose phrase a post has, in any case, else the nearest pattern vector above the limit. Phrases are matched as pattern_check does it, by priority and id."""
    held = pattern_check(posts, patterns, text).select("id", "pattern_id", F.lit(1.0).alias("similarity"))
    near = semantic_check(vectors, pattern_vectors, least).join(held, "id", "left_anti")
    return held.unionByName(near.select("id", "pattern_id", F.col("cosine").alias("similarity")))


def semantic_matches(vectors: DataFrame, patterns: DataFrame, least: float = 0.85, itself: bool = False) -> DataFrame:
    """(id, pattern_id, cosine) of all pattern vectors whose cosine reaches the limit; patterns are held by tasks in turns of PATTERN_VECTORS. Matrix products leave out what is far; the rest is added up exactly as a fold does it. Vectors of equal id are compared only with itself."""
    pairs = dots(vectors.select("id", F.col("embedding").alias("v")), patterns.select(F.col("id").alias("other_id"), F.col("embedding").alias("o")), PATTERN_VECTORS, near(least), itself)
    return pairs.select("id", F.col("other_id").alias("pattern_id"), F.round(F.try_divide("dot", "norms"), 6).alias("cosine")).where(F.col("cosine") >= least)


def sentence_verdicts(texts: DataFrame, sentences: DataFrame, least: float = 0.85, first: int = 100) -> DataFrame:
    """(id, verdict, sentence_id, category, similarity, n_matches): texts (id, text, embedding) held against the first active sentences (id, embedding, category, priority, action, active) by priority, ties by id.

    A text goes down the list until a sentence that blocks is as near as the limit; n_matches are the sentences it came near so far. The verdict is block,
    else flag if one of these flags, else allow, with the sentence that decided it: the one that blocks, the first that flags, or the first. Texts of fewer
    than ten characters, without a vector, or near to no sentence have no row.
    """
    listed = sentences.where("active").orderBy(F.desc("priority"), "id").limit(first)
    held = listed.select(F.col("id").alias("pattern_id"), "category", "priority", "action")
    long_ = texts.where((F.length(F.trim("text")) >= MIN_SEMANTIC) & F.col("embedding").isNotNull())
    near = semantic_matches(long_, listed, least, itself=True).join(F.broadcast(held), "pattern_id")
    before = Window.partitionBy("id").orderBy(F.desc("priority"), "pattern_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = near.withColumn("over", F.coalesce(F.max(F.col("action") == "block").over(before), F.lit(False))).where("not over")
    grade = F.when(F.col("action") == "block", 0).when(F.col("action") == "flag", 1).otherwise(2)
    decided = seen.groupBy("id").agg(F.min_by(F.struct(grade.alias("grade"), F.col("pattern_id").alias("sentence_id"), "category", "cosine"), F.struct(grade, -F.col("priority"), "pattern_id")).alias("d"), F.count("*").alias("n_matches"))
    verdict = F.element_at(F.array(*map(F.lit, ("block", "flag", "allow"))), F.col("d.grade") + 1)
    return decided.select("id", verdict.alias("verdict"), "d.sentence_id", "d.category", F.col("d.cosine").alias("similarity"), "n_matches")


def validate_fields(fields: DataFrame, patterns: DataFrame, duplicates: DataFrame, nearest: DataFrame) -> DataFrame:
    """(id, ok, field, step, detail): the first field of an entry, by place, that fails a check, and the first check that it fails: required, spam, insult, pattern, semantic, duplicate.

    fields has id, field, place, required, kind and body, a row for each field; spaces around a text don't count, and an empty one fails only where it is
    required. duplicates (id, field) count for required fields. nearest (id, field, action, category) is the nearest sentence of a text's vector and
    counts where no pattern is found in it. Patterns and sentences that flag stop an entry as those that block do.
    """
    text = F.trim(F.coalesce("body", F.lit("")))
    key = F.struct("id", "field").alias("id")
    asked = fields.where(F.col("required") | (text != "")).select(key, "place", "required", "kind", text.alias("body"))
    hits = pattern_check(asked, patterns).select("id", "action", "category")
    near = nearest.select(key, F.col("action").alias("near_action"), F.col("category").alias("near_category"))
    checked = insult_check(text_spam(asked)).join(hits, "id", "left").join(near, "id", "left").join(duplicates.select(key, F.lit(True).alias("repeat")).distinct(), "id", "left")
    stops = lambda c: F.coalesce(F.col(c).isin("block", "flag"), F.lit(False))
    step = (
        F.when(F.col("body") == "", "required")
        .when(~F.col("spam_ok"), "spam")
        .when(F.col("insult_action") == "block", "insult")
        .when(stops("action"), "pattern")
        .when(F.col("action").isNull() & stops("near_action"), "semantic")
        .when(F.col("required") & yes("repeat"), "duplicate")
    )
    detail = F.element_at(F.create_map(F.lit("spam"), F.array_join("spam_issues", ","), F.lit("insult"), F.col("insult_category"), F.lit("pattern"), F.col("category"), F.lit("semantic"), F.col("near_category")), F.col("step"))
    failed = checked.withColumn("step", step).where("step is not null").withColumn("detail", detail)
    worst = failed.groupBy(F.col("id.id").alias("id")).agg(F.min_by(F.struct(F.col("id.field").alias("field"), "step", "detail"), F.struct("place", "id.field")).alias("w"))
    return fields.select("id").distinct().join(worst, "id", "left").select("id", F.col("w").isNull().alias("ok"), "w.field", "w.step", "w.detail")
