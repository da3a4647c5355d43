"""Mixing sources to target weights by hash order and distributed prefix sums."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.common import WORD, partitions, stored

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is repeated so many times at most.
MAX_EPOCHS = 3
#: Source tables of up to so many rows are broadcast.
BROADCAST_ROWS = 100_000


def hash_key(id_col: str, seed: int) -> Column:
    """60 random bits of the id as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def words_in(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(docs: DataFrame) -> Column:
    """A long that rows of one id and size share only if all their columns are equal, nulls apart from other values."""
    odd = {f.name for f in docs.schema if any(t in f.dataType.simpleString() for t in ("map<", "variant"))}
    values = [F.to_json(F.struct(F.col(c))) if c in odd else F.col(c) for c in docs.columns]
    return F.xxhash64(*values, *(F.isnull(F.col(c)) for c in docs.columns))


def source_targets(sizes: DataFrame, share: float = 1.0, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, epochs, rest): sizes has source and source_size. Sources by code point, null last, weigh weights in turn and share the given part of all sizes; a target stops at max_epochs times its source's size and the excess goes to the others by weight.

    Sources stop in the order of size over weight, so the level is found with running sums over the sources, one row each: it is the first, and so the largest, level that the next source to stop wouldn't pass. epochs whole passes and rest more words make the whole part of the target.
    """
    n = len(weights)
    ranked = sizes.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % n + 1).cast("int"))).withColumn("most", F.col("source_size") * max_epochs)
    everything = Window.orderBy(F.col("most") / F.col("w"), "i")
    after = everything.rowsBetween(1, Window.unboundedFollowing)
    upto = everything.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    stops = ranked.withColumns({"total": F.sum("source_size").over(whole) * share, "stopped": F.sum("most").over(upto), "open_w": F.sum("w").over(after), "next": F.lead(F.col("most") / F.col("w")).over(everything), "all_w": F.sum("w").over(whole), "first": F.min(F.col("most") / F.col("w")).over(whole)})
    level = F.when(F.col("total") / F.col("all_w") <= F.col("first"), F.col("total") / F.col("all_w")).otherwise(F.max(F.when((F.col("total") - F.col("stopped")) / F.col("open_w") <= F.col("next"), (F.col("total") - F.col("stopped")) / F.col("open_w"))).over(whole))
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("most").cast("double")))
    out = stops.withColumn("level", level).select("source", "source_size", target.alias("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    return out.withColumn("epochs", epochs).withColumn("rest", F.floor("target") - F.col("epochs") * F.col("source_size"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.0, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 1, tie: Column | None = None) -> DataFrame:
    """(id, size, source, key, source_size, target, epochs, start, taken, rest, tie) for every row: size is its words (null text: 0), taken how many of them the mix takes.

    Each source's rows are put in the order of a hash of the id (ties by id, size and tie), every whole epoch takes all of them, and the last one is cut at the exact word of the source's budget. Rows that repeat are rows of their own, a null source is a source, an empty table gives an empty one and other columns are ignored.

    Rows are range-partitioned by (source, key), so a source with a third of all rows lies in a third of the partitions. Each partition sums its own rows, and the sums of partitions, one row for each partition and source in it, are accumulated and joined back.
    """
    spark = docs.sparkSession
    tie = F.lit(0).cast("long") if tie is None else tie
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(text_col).alias("size"), hash_key(id_col, seed).alias("key"), tie.alias("tie")), "sizes")
    order = ["source", "key", "id", "size", "tie"]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, sizes = pd.factorize(batch["source"].to_pandas())[0], batch["size"].to_pandas()
            start = (sizes.groupby(codes).cumsum() - sizes).to_numpy()
            if batch["source"][0].as_py() == last:
                start[codes == codes[0]] += total
            last, total = batch["source"][-1].as_py(), int(start[-1] + sizes.iloc[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(start), pa.int32()), pa.array(start, pa.int64())], [*batch.schema.names, "part", "before"])

    near = rows.repartitionByRange(max(2 * partitions(spark), 2), *order).sortWithinPartitions(*order)
    near = stored(near.mapInArrow(add_up, T.StructType([*near.schema, T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType())])), "partition-sums")
    parts = near.groupBy("part", "source").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    targets = source_targets(parts.groupBy("source").agg(F.sum("n").alias("source_size")), share, weights, max_epochs)
    parts = stored(parts.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "n"), "part-targets")
    found = near.join(parts.withColumnsRenamed({"part": "p", "source": "s"}), (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    start = F.col("before") + F.col("base")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    return found.select("id", "size", "source", "key", "source_size", "target", "epochs", start.alias("start"), taken.cast("long").alias("taken"), "rest", "tie")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mix itself, with the columns of docs: rows of every whole epoch, those of the last one before the cut, and the row at the cut with the words up to it. Rows of size 0 are as often there as the rows around them.

    The cut of a source is one place in the order (key, id, size, hash of the whole row) and the words up to it, so texts are not shuffled: the cuts, one for each source, are joined to them. Rows at that place are alike in all columns: one of them stands for as many copies as lie before the cut, and is cut itself. Columns of docs may have any names. Null ids, texts and sources, ties and repeated rows are treated as in mixed; an empty table gives an empty one.
    """
    seed, place = settings.get("seed", 1), ["key", "id", "size", "tie"]
    rows = mixed(docs, id_col, text_col, source_col, tie=row_hash(docs), **settings)
    at = (F.col("start") < F.col("rest")) & (F.col("start") + F.col("size") >= F.col("rest"))
    cuts = rows.groupBy("source", "epochs").agg(F.min(F.when(at, F.struct(*place, "start", (F.col("rest") - F.col("start")).alias("words")))).alias("cut"))
    cuts = stored(cuts.select(F.col("source").alias("of"), F.col("epochs").alias("whole"), "cut"), "cuts")
    near = F.broadcast if cuts.count() <= BROADCAST_ROWS else lambda df: df
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"cut.{c}")) for c in place))
    alike = rows.join(near(cuts.where("cut is not null")), F.col("source").eqNullSafe(F.col("of"))).where(same & (F.col("start") < F.col("cut.start")))
    alike = alike.groupBy(F.col("of").alias("s")).agg(F.count("*").alias("n"))
    cuts = stored(cuts.join(alike, F.col("of").eqNullSafe(F.col("s")), "left").select("of", "whole", "cut", F.coalesce("n", F.lit(0)).alias("earlier")), "cuts-of-rows")
    own = F.struct(hash_key(id_col, seed).alias("key"), F.col(id_col).alias("id"), words_in(text_col).alias("size"), row_hash(docs).alias("tie"))
    joined = docs.select(F.struct(*docs.columns).alias("row"), own.alias("own"), F.col(source_col).alias("src")).join(near(cuts), F.col("src").eqNullSafe(F.col("of")))
    cut = F.when(F.col("cut").isNotNull(), F.struct(*(F.col(f"cut.{c}").alias(c) for c in place)))
    before, here = F.coalesce(F.col("own") < cut, F.lit(False)), F.coalesce(F.col("own") == cut, F.lit(False))
    whole = joined.withColumn("n", F.explode(F.sequence(F.lit(0), F.col("whole") + F.when(before, 1).otherwise(0)))).where("n > 0").select("row.*")
    last = joined.where(here).groupBy("of").agg(F.first("row").alias("row"), F.first("earlier").alias("earlier"), F.first("cut.words").alias("words"))
    last = stored(last, "cut-rows")

    @F.pandas_udf("string")
    def head(texts: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([re.match(r"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){%d}" % n, t)[0] if n else "" for t, n in zip(texts, words)])

    # Copies of a row are made in blocks, so that no task makes all of very many.
    deal = last.where("earlier > 0").withColumn("b", F.explode(F.sequence(F.lit(0), F.expr("(earlier - 1) div 1000")))).repartition(partitions(docs.sparkSession))
    copies = deal.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(1000), F.col("earlier") - F.col("b") * 1000)))).select("row.*")
    field = F.col("row").getField
    some = last.select(*((head(field(c), F.col("words")) if c == text_col else field(c)).alias(c) for c in docs.columns))
    return whole.unionByName(copies).unionByName(some)
