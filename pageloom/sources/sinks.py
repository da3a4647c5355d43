"""Tables that jobs write: appended, published whole, brought up to date by key, and exported."""

from __future__ import annotations

import re
import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.functions.tables import materialised

#: The file that names the newest version of a published table.
POINTER = "newest"

# Greatest lengths of an answer's texts.
ANSWER_LENGTHS = {"question": 500, "answer": 5000, "source": 50}


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a table of Parquet files. A write that fails leaves no rows: they count once the job commits."""
    rows.write.mode("append").parquet(path)


def publish(rows: DataFrame, path: str) -> str:
    """Writes rows as a new version below path, makes it the newest and gives its folder. Readers of older versions aren't disturbed; should the job end before the switch, the version before stays the newest."""
    version = f"version-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path.rstrip('/')}/{version}")
    switch(rows.sparkSession, path, version)
    return f"{path.rstrip('/')}/{version}"


def switch(spark: SparkSession, path: str, version: str) -> None:
    """Makes a version the newest, in one step: the name is written to a file of its own, which then takes the pointer's place."""
    folder, new = _place(spark, path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written = new(folder, f"_newest-{uuid.uuid4().hex}")
    stream = fs.create(written, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(written, new(folder, POINTER), options)


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The newest published version."""
    version = spark.read.text(f"{path.rstrip('/')}/{POINTER}").first()[0]
    return spark.read.parquet(f"{path.rstrip('/')}/{version}")


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes all versions but the newest and those written last before it, keep in all, and gives their number. Versions that were written but never switched to count by their time."""
    folder, new = _place(spark, path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    current = spark.read.text(f"{path.rstrip('/')}/{POINTER}").first()[0]
    found = sorted(((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("version-")), reverse=True)
    old = [name for _, name in found if name != current][keep - 1 :]
    for name in old:
        fs.delete(new(folder, name), True)
    return len(old)


def _place(spark: SparkSession, path: str):
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return new(path), new


def write_days(rows: DataFrame, path: str, day: str = "day") -> None:
    """Puts rows in a folder for each day; days that have rows are replaced, others stay untouched."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def merge_days(new: DataFrame, path: str, keys: list[str], day: str = "day", most: int = 10_000) -> None:
    """Brings a table of days up to date by key and day: only the days that new has rows of are read and written again. No more than most days may be touched at a time, as their names are listed; more raise an error before anything is written."""
    spark = new.sparkSession
    new = materialised(new, "new-rows")
    days = [r[0] for r in new.select(day).distinct().limit(most + 1).collect()]
    if len(days) > most:
        raise ValueError(f"more than {most} days")
    old = spark.read.parquet(path)
    touched = old.where(F.col(day).isin([d for d in days if d is not None]) | (F.col(day).isNull() & F.lit(None in days))).select(*new.columns)
    write_days(materialised(upsert(touched, new, [*keys, day]), "merged-days"), path, day)


def expire_days(spark: SparkSession, path: str, as_of: str, keep: int, day: str = "day") -> list[str]:
    """Removes the folders of days older than keep days before as_of (a date) and gives their names. Nothing is read or written anew; rows without a day stay."""
    folder, _ = _place(spark, path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    first = (date.fromisoformat(as_of[:10]) - timedelta(days=keep)).isoformat()
    gone = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if re.fullmatch(rf"{re.escape(day)}=\d{{4}}-\d\d-\d\d", name) and name.split("=")[1] < first:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of equal keys, and the rest of new. Both have the same columns; of new rows with equal keys any one stays, so give one a key. Null keys are equal."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.desc("__new"))
    return both.withColumn("__i", F.row_number().over(newest)).where("__i = 1").drop("__new", "__i")


def export_events(events: DataFrame, path: str) -> None:
    """Events as lines of JSON, nulls included, in a folder for each event_type."""
    events.write.partitionBy("event_type").option("ignoreNullFields", "false").json(path)


def enrich_domains(pages: DataFrame, votes: DataFrame, paywalls: DataFrame, trust: DataFrame) -> DataFrame:
    """pages with positive, neutral, negative, n_reports (zero where the domain has none) and known_trust (null there). Each table has one row a domain; Spark broadcasts those whose size it knows to be small."""
    out = pages.join(votes.select("domain", "positive", "neutral", "negative"), "domain", "left").join(paywalls.select("domain", "n_reports"), "domain", "left").join(trust.select("domain", F.col("trust").alias("known_trust")), "domain", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("positive", "neutral", "negative", "n_reports")})


def ingest_votes(raw: DataFrame) -> DataFrame:
    """Rows of the vote history from raw ones (session_id, url, vote_type, ts): up or down only, with a session and a url."""
    named = (F.coalesce(F.trim("session_id"), F.lit("")) != "") & (F.coalesce(F.trim("url"), F.lit("")) != "")
    return raw.where(named & F.col("vote_type").isin("up", "down")).select("session_id", "url", "vote_type", F.col("ts").alias("created_at"))


def ingest_answers(raw: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (question, answer, source, created_at) of raw answers (question, answer, source, ts, id) whose question, in any case, is neither known nor asked by an earlier one; texts are cut to their lengths. Rows without question or answer go."""
    cut = lambda c: F.left(F.trim(c), F.lit(ANSWER_LENGTHS[c])).alias(c)
    rows = raw.where("question is not null and answer is not null").select(cut("question"), cut("answer"), F.left("source", F.lit(ANSWER_LENGTHS["source"])).alias("source"), "ts", "id").withColumn("__q", F.lower("question"))
    new = rows.join(known.select(F.lower("question").alias("__q")).distinct(), "__q", "left_anti")
    first = new.withColumn("__i", F.row_number().over(Window.partitionBy("__q").orderBy("ts", "id"))).where("__i = 1")
    return first.select("question", "answer", "source", F.col("ts").alias("created_at"))
