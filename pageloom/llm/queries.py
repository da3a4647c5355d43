"""One query per operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import chat, decontaminate, embeddings, hard_negatives, mixing, pii, quality, simhash, substrings, token_count, token_store, toxicity, vector_codes
from pageloom.llm.common import small_batches, table

#: What both rows of conversation -1 say.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table that a query reads; queries hand fewer rows at once to Python than Spark would."""
    small_batches(spark)
    return table(spark, sf_dir, name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    score = toxicity.score_column(toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return _scored(docs, score, 0.7)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    score = quality.score_column(quality.train(docs, _table(spark, sf_dir, "labels")))
    return _scored(docs, score, 0.5)


def _scored(docs: DataFrame, score, threshold: float) -> DataFrame:
    return docs.select("doc_id", F.coalesce(~quality.learning(), F.lit(False)).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.shards_of(spark, _table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.with_surrogates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.size("entities").alias("n_entities"), "entities")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.with_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    matched = F.coalesce(F.array_max(F.transform("overlaps", lambda o: o["matched"])), F.lit(0))
    return out.select("doc_id", (F.size("overlaps") > 0).alias("contaminated"), F.transform("overlaps", lambda o: o["item"]).alias("item_ids"), matched.alias("matched_tokens"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", token_count.count_column().alias("n_tokens"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql(f"select -1L as conv_id, turn, role, '{CONTROL}' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    return chat.digests(chat.format_chats(rows.unionByName(own)))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_groups(_table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.without_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_toxicity, op3_quality, op4_token_shards, op5_pii, op6_decontamination, op7_token_counts, op8_mixing, op9_chat, op10_embeddings, op11_hard_negatives, op12_vector_codes, op13_substrings)
    return {f.__name__: f for f in own}


MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s),
w AS (SELECT *, [5, 2, 1][CAST(i % 3 + 1 AS INTEGER)] AS w, source_size * 3 AS most FROM r),
a AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total, CAST(sum(w) OVER () AS DOUBLE) AS all_w,
         min(CAST(most AS DOUBLE) / w) OVER () AS first,
         CAST(sum(most) OVER (ORDER BY CAST(most AS DOUBLE) / w, i ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS stopped,
         CAST(sum(w) OVER (ORDER BY CAST(most AS DOUBLE) / w, i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS DOUBLE) AS open_w,
         lead(CAST(most AS DOUBLE) / w) OVER (ORDER BY CAST(most AS DOUBLE) / w, i) AS next
  FROM w),
l AS (
  SELECT *, CASE WHEN total / all_w <= first THEN total / all_w
                 ELSE max(CASE WHEN (total - stopped) / open_w <= next THEN (total - stopped) / open_w END) OVER () END AS level
  FROM a),
t AS (SELECT source, source_size, least(CAST(most AS DOUBLE), coalesce(level * w, CAST(most AS DOUBLE))) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM d)
SELECT p.doc_id, p.size, e.source_size, e.target,
       CAST(e.epochs * p.size + greatest(0, least(p.size, CAST(floor(e.target) AS BIGINT) - e.epochs * e.source_size - p.start)) AS BIGINT) AS taken
FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
"""

CHAT_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 'user', '{CONTROL}'
  UNION ALL SELECT CAST(-1 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '{CONTROL}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + 1
                + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


NEGATIVES_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM r AS a JOIN r AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s AS n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) <= 3
"""


def _codes_sql() -> str:
    """Six rounds written out, each one table of codebooks after another."""
    steps = ["""
r AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = len(embedding)),
p AS MATERIALIZED (SELECT vec_id, label, j, q[CAST(j * len(q) // 8 + 1 AS BIGINT) : CAST((j + 1) * len(q) // 8 AS BIGINT)] AS v FROM r, range(8) AS t(j)),
b0 AS MATERIALIZED (SELECT j, i, v AS c FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM r ORDER BY vec_id LIMIT 16) USING (vec_id))"""]
    nearest = "SELECT p.vec_id, p.label, p.j, p.v, b.i, list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.c) + list_inner_product(b.c, b.c) AS e FROM p JOIN b{0} AS b USING (j) QUALIFY row_number() OVER (PARTITION BY p.vec_id, p.j ORDER BY e, b.i) = 1"
    for n in range(6):
        steps.append(f"""
a{n} AS MATERIALIZED ({nearest.format(n)}),
m{n} AS MATERIALIZED (
  SELECT j, i, list(c ORDER BY k) AS c FROM (SELECT j, i, k, floor(sum(x) / count(*)) AS c FROM (SELECT j, i, unnest(v) AS x, unnest(range(len(v))) AS k FROM a{n}) GROUP BY j, i, k) GROUP BY j, i),
b{n + 1} AS MATERIALIZED (SELECT b.j, b.i, coalesce(m.c, b.c) AS c FROM b{n} AS b LEFT JOIN m{n} AS m USING (j, i))""")
    return f"""
WITH {",".join(steps)},
f AS ({nearest.format(6)}),
v AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', i), '' ORDER BY j) AS code, CAST(sum(e) AS BIGINT) AS error FROM f GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY j, i)) FROM b6) AS codebooks_sha256
FROM v
"""


SUBSTRINGS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT doc_id, s, array_to_string(ws[s:s + 12], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM d)),
g AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY t) AS lo FROM w) WHERE lo < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM g),
o AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM d),
k AS (SELECT o.doc_id, count(c.i) AS n_removed, string_agg(o.x, ' ' ORDER BY o.i) FILTER (WHERE c.i IS NULL) AS kept FROM o LEFT JOIN c ON o.doc_id = c.doc_id AND o.i = c.i GROUP BY o.doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": MIXING_SQL, "op9_chat": CHAT_SQL, "op11_hard_negatives": NEGATIVES_SQL, "op12_vector_codes": _codes_sql(), "op13_substrings": SUBSTRINGS_SQL}
