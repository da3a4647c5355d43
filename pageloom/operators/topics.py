"""Pages of another topic than the query's."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points that a mismatch costs by its level.
PENALTIES = {"strong": 15, "medium": 8, "weak": 3}


@dataclass(frozen=True)
class Topic:
    """What tells a topic in a query (terms, anywhere in it), the page categories that suit it, and those that don't by level."""

    name: str
    terms: list[str]
    allowed: list[str]
    strong: list[str]
    medium: list[str]
    weak: list[str]


def _list(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def score_category_mismatch(pairs: DataFrame, topics: list[Topic]) -> DataFrame:
    """pairs (with query, category and tags) with topic, the first one of which the query holds a term, mismatch_penalty and mismatch_reason.

    A category or tag that suits the topic costs nothing. Else the category's level counts, or that of a tag if it is lower; categories in no list cost nothing whatever the tags. Null queries have no topic, null tags are none.
    """
    q, tags = F.trim(F.lower("query")), F.coalesce("tags", F.array().cast("array<string>"))
    topic = penalty = reason = None
    for t in topics:
        test = F.exists(_list(t.terms), lambda x: F.contains(q, x))
        levels = [(level, points, getattr(t, level)) for level, points in PENALTIES.items()]
        own = F.coalesce(*(F.when(F.col("category").isin(names), points) for _, points, names in levels))
        tag = F.least(*(F.when(F.arrays_overlap(tags, _list(names)), points) for _, points, names in levels), F.lit(None))
        suits = F.col("category").isin(t.allowed) | F.arrays_overlap(tags, _list(t.allowed))
        cost = F.when(suits, 0).otherwise(F.coalesce(F.least(own, F.when(own.isNotNull(), tag)), F.lit(0)))
        why = F.when(F.col("category").isin(t.allowed), "category allowed").when(F.arrays_overlap(tags, _list(t.allowed)), "tag allowed").when(own.isNull(), "category in no list").when(tag < own, "mismatch eased by tag").otherwise("mismatch")
        topic = F.when(test, t.name) if topic is None else topic.when(test, t.name)
        penalty = F.when(test, cost) if penalty is None else penalty.when(test, cost)
        reason = F.when(test, why) if reason is None else reason.when(test, why)
    return pairs.withColumns({"topic": topic, "mismatch_penalty": penalty.otherwise(0), "mismatch_reason": reason.otherwise("no topic")})
