"""Word fingerprints, shingle duplicates and spelling suggestions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions.columns import half_up, tokens
from pageloom.functions.tables import materialised

# Words that fingerprints leave out.
STOP_WORDS = "der die das ein eine und oder ist sind hat war für mit von auf bei den dem the a an and or is are was for with".split()
TOP_WORDS, MIN_TEXT, MAX_BITS, MAX_GROUP = 128, 200, 6, 5
MIN_EMBEDDED = 50
SHINGLE, MIN_SHINGLE_TEXT, MIN_JACCARD = 4, 40, 0.65


def word_simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, simhash, simhash_hex) over the 128 commonest words of three characters and more that aren't stop words (ties by word), each hashed to the first 64 bits of its md5; a bit is set if most words set it. Texts under 200 characters get 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-zäöüß0-9\s]", " "), r"\s+")
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS))
    each = docs.select(F.col(id_col).alias("id"), F.when(F.length(text) >= MIN_TEXT, kept).otherwise(F.array().cast("array<string>")).alias("ws"))
    counts = each.select("id", F.explode("ws").alias("w")).groupBy("id", "w").agg(F.count("*").alias("n"))
    top = counts.withColumn("i", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "w"))).where(F.col("i") <= TOP_WORDS)
    half = lambda k: F.conv(F.substring(F.md5("w"), 1 + 8 * k, 8), 16, 10).cast("long")
    sums = [F.sum(F.when(F.getbit(F.col(f"h{k}"), F.lit(31 - b)) == 1, 1).otherwise(-1)).alias(f"b{32 * k + b}") for k in (0, 1) for b in range(32)]
    bits = top.select("id", half(0).alias("h0"), half(1).alias("h1")).groupBy("id").agg(*sums)  # each word is hashed once, not for every bit
    part = lambda k: F.lpad(F.lower(F.hex(sum((F.when(F.col(f"b{32 * k + b}") > 0, 1 << (31 - b)).otherwise(0).cast("long") for b in range(32)), F.lit(0).cast("long")))), 8, "0")
    found = bits.select("id", F.concat(part(0), part(1)).alias("simhash_hex"))
    out = docs.select(F.col(id_col).alias("id")).join(found, "id", "left").withColumn("simhash_hex", F.coalesce("simhash_hex", F.lit("0" * 16)))
    signed = F.shiftleft(F.conv(F.substring("simhash_hex", 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring("simhash_hex", 9, 8), 16, 10).cast("long"))
    return out.select(F.col("id").alias(id_col), signed.alias("simhash"), "simhash_hex")


def near_hashes(hashes: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(hash_a, hash_b, distance) of distinct fingerprints within bits of each other; zero never matches. Of bits + 2 blocks at least two are equal, so pairs of blocks are joined, about 16 bits together; a pair of fingerprints is taken at its first two equal blocks only."""
    n = bits + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [F.shiftrightunsigned(F.col("simhash"), edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) for i in range(n)]
    h = hashes.where("simhash <> 0").select("simhash").distinct().withColumn("all", F.array(*blocks))
    keys = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("all")[i].alias("x"), F.col("all")[j].alias("y")) for i in range(n) for j in range(i + 1, n)))
    rows = materialised(h.select("simhash", F.explode(keys).alias("key")).select("simhash", "key.*"), "hash-blocks")
    left, right = (rows.withColumnRenamed("simhash", f"hash_{x}") for x in "ab")
    differ = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    same = F.filter(F.array(*(F.when(F.shiftrightunsigned(differ, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)) == 0, k) for k in range(n))), lambda k: k.isNotNull())
    near = left.join(right, ["i", "j", "x", "y"]).where((F.col("hash_a") < F.col("hash_b")) & (F.bit_count(differ) <= bits))
    first = (F.element_at(same, 1) == F.col("i")) & (F.element_at(same, 2) == F.col("j"))
    return near.where(first).select("hash_a", "hash_b", F.bit_count(differ).alias("distance"))


def near_duplicates(hashes: DataFrame, id_col: str = "doc_id", bits: int = MAX_BITS) -> DataFrame:
    """(id, duplicate_of): each row whose fingerprint is equal or near to that of a row with a smaller id, with the smallest such id."""
    firsts = hashes.where("simhash <> 0").groupBy("simhash").agg(F.min(id_col).alias("first"))
    near = materialised(near_hashes(hashes, bits), "near-hashes")
    both = near.select(F.col("hash_a").alias("h"), F.col("hash_b").alias("other")).unionByName(near.select(F.col("hash_b").alias("h"), F.col("hash_a").alias("other")))
    least = both.join(firsts.withColumnRenamed("simhash", "other"), "other").groupBy("h").agg(F.min("first").alias("near_first"))
    best = firsts.join(least, firsts.simhash == least.h, "left").select("simhash", F.least("first", "near_first").alias("duplicate_of"))
    return hashes.where("simhash <> 0").join(best, "simhash").where(F.col("duplicate_of") < F.col(id_col)).select(id_col, "duplicate_of")


def components(edges: DataFrame) -> DataFrame:
    """(scope, node, first) of edges (scope, a, b), nulls in none of them: each node with the smallest one that can be reached from it within its scope. A round takes the smallest label of all neighbours and then that label's own label, so labels travel ever further; each round is a stored table."""
    both = materialised(edges.select("scope", "a", "b").unionByName(edges.select("scope", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialised(both.groupBy("scope", F.col("a").alias("node")).agg(F.min("b").alias("first")).withColumn("first", F.least("node", "first")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), ["scope", "b"]).groupBy("scope", F.col("a").alias("node")).agg(F.min("first").alias("near"))
        least = labels.join(seen, ["scope", "node"]).select("scope", "node", F.col("first").alias("old"), F.least("first", "near").alias("first"))
        jump = labels.select("scope", F.col("node").alias("first"), F.col("first").alias("next"))
        moved = materialised(least.join(jump, ["scope", "first"]).select("scope", "node", "old", F.least("first", "next").alias("first")), "labels")
        labels = moved.drop("old")
        if moved.where("first <> old").isEmpty():
            return labels


def dedupe_results(ranking: DataFrame, hashes: DataFrame, bits: int = MAX_BITS, most: int = MAX_GROUP) -> DataFrame:
    """(query_id, rank, url, canonical_url, is_duplicate) of ranked lists: down each list a row goes to the best kept row before it whose fingerprint is near and that has fewer than most rows; else it is kept itself. ranking has query_id, rank and url, hashes has url and simhash, one row a url; rows with fingerprint zero or none are kept and take no others. Equal ranks are ordered by url; a null query_id is a list of its own.

    A row's fate hangs on rows of its list that a chain of near fingerprints ties to it, so a list is cut into these components, which are judged apart. A component isn't passed row by row but run by run: neighbours in rank of one fingerprint, cut where a partition of the sorted rows ends, are one row with a count. A run first fills the near kept rows that have room, best first; what is left over keeps every (most + 1)th of its rows. So the pass holds one kept row a fingerprint, and copies by the thousand cost it a few runs.
    """
    rows = ranking.join(hashes.select("url", "simhash"), "url", "left").select(F.struct("query_id").alias("scope"), "rank", "url", F.coalesce("simhash", F.lit(0)).alias("simhash"))
    rows = materialised(rows, "ranked-hashes")
    members = materialised(rows.where("simhash <> 0").select("scope", "simhash").distinct(), "list-hashes")
    near = near_hashes(members, bits)
    edges = near.join(members.withColumnRenamed("simhash", "hash_a"), "hash_a").join(members.withColumnRenamed("simhash", "hash_b"), ["scope", "hash_b"])
    tied = components(edges.select("scope", F.col("hash_a").alias("a"), F.col("hash_b").alias("b"))).select("scope", F.col("node").alias("simhash"), F.col("first").alias("part"))
    order = ["scope", "part", "rank", "url"]
    placed = rows.where("simhash <> 0").join(tied, ["scope", "simhash"], "left").withColumn("part", F.coalesce("part", "simhash"))
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    within = Window.partitionBy(F.shiftright("id", 33), "scope", "part").orderBy("id")  # ids number the rows of a partition upwards; their upper bits are the partition
    placed = placed.withColumn("before", F.lag("simhash").over(within)).withColumn("run", F.max(F.when(F.col("before").isNull() | (F.col("before") != F.col("simhash")), F.col("id"))).over(within))
    placed = materialised(placed.drop("before"), "ranked-runs")
    runs = placed.groupBy("scope", "part", "run", "simhash").agg(F.count("*").alias("n"))
    n = bits + 1
    edges_of = [64 * i // n for i in range(n + 1)]

    def blocks_of(h: int) -> list[tuple[int, int]]:
        return [(i, (h >> edges_of[i]) & ((1 << (edges_of[i + 1] - edges_of[i])) - 1)) for i in range(n)]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, room, blocks = None, {}, {}  # fingerprint -> (place among the kept, id, rows that still fit), and block -> fingerprints
        kept = 0
        for b in batches:
            out = []
            for scope, part, run, h, size in b[["scope_key", "part", "run", "simhash", "n"]].itertuples(index=False):
                if (scope, part) != at:
                    at, room, blocks, kept = (scope, part), {}, {}, 0
                h = int(h) & ((1 << 64) - 1)
                fills, used = [], 0
                for place, k in sorted((room[k][0], k) for k in {k for x in blocks_of(h) for k in blocks.get(x, ())} if (k ^ h).bit_count() <= bits):
                    if used == size:
                        break
                    _, owner, free = room[k]
                    took = min(free, size - used)
                    used += took
                    fills.append({"upto": used, "owner": owner})
                    if took < free:
                        room[k] = (place, owner, free - took)
                    else:  # full ones need no more looking at
                        del room[k]
                        for x in blocks_of(k):
                            blocks[x].discard(k)
                if used < size:
                    last = (size - used - 1) // (most + 1) * (most + 1)
                    kept += 1
                    free = most - (size - used - 1 - last)
                    if free:
                        room[h] = (kept, run + used + last, free)
                        for x in blocks_of(h):
                            blocks.setdefault(x, set()).add(h)
                if fills:
                    out.append((run, fills))
            yield pd.DataFrame(out, columns=["run", "fills"])

    keyed = runs.select(F.to_json("scope").alias("scope_key"), "part", "run", "simhash", "n")
    passed = keyed.repartition("scope_key", "part").sortWithinPartitions("scope_key", "part", "run").mapInPandas(work, "run long, fills array<struct<upto: long, owner: long>>")
    i, used = F.col("id") - F.col("run"), F.coalesce(F.element_at("fills", -1)["upto"], F.lit(0))
    filled = F.filter("fills", lambda f: i < f["upto"])[0]["owner"]
    owned = placed.join(passed, "run", "left").withColumn("owner", F.when(i < used, filled).otherwise(F.col("id") - (i - used) % (most + 1)))
    owners = placed.select(F.col("id").alias("owner"), F.col("url").alias("canonical_url"))
    others = owned.where("owner <> id").join(owners, "owner").select("scope", "rank", "url", "canonical_url", F.lit(True).alias("is_duplicate"))
    alone = owned.where("owner = id").select("scope", "rank", "url").unionByName(rows.where("simhash = 0").select("scope", "rank", "url"))
    out = others.unionByName(alone.select("*", F.lit(None).cast("string").alias("canonical_url"), F.lit(False).alias("is_duplicate")))
    return out.select("scope.query_id", "rank", "url", "canonical_url", "is_duplicate")


def shingle_sets(posts: DataFrame, text: str = "body") -> DataFrame:
    """posts with shingles: the distinct runs of four words, of texts of 40 characters and more that have four words."""
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("__words") - SHINGLE + 1), lambda i: F.array_join(F.slice("__words", i, SHINGLE), " ")))
    out = posts.withColumn("__words", tokens(F.col(text)))  # a column of its own, so that it is cut once and not for every run
    return out.withColumn("shingles", F.when((F.length(text) >= MIN_SHINGLE_TEXT) & (F.size("__words") >= SHINGLE), runs)).drop("__words")


def shingle_classes(posts: DataFrame, text: str = "body") -> DataFrame:
    """(scope, class_id, n_posts, id): posts of equal words in a scope; class_id is a hash of the words, id the smallest of the class. Shorter texts than 40 characters are left out."""
    long_ = posts.where(F.length(text) >= MIN_SHINGLE_TEXT)
    return long_.groupBy("scope", F.md5(F.array_join(tokens(F.col(text)), " ")).alias("class_id")).agg(F.count("*").alias("n_posts"), F.min("id").alias("id"), F.min_by(text, "id").alias(text))


def shingle_duplicates(posts: DataFrame, text: str = "body", least: float = MIN_JACCARD) -> DataFrame:
    """(scope, id_a, id_b, common, similarity): pairs of different texts of a scope whose four-word shingles have a Jaccard similarity of least. Copies are folded first; ids stand for their class.

    By the prefix rule two sets of that similarity share one of their rarest shingles: of n shingles, ordered by how many texts have them, the first n - ceil(least * n) + 1 are enough. Only these are joined, so common passages make no pairs by themselves; pairs are then compared in full.
    """
    classes = shingle_sets(shingle_classes(posts, text), text).where("shingles is not null")
    # A shingle's hash has its scope in it, and a class a number, so that shuffled rows are three numbers.
    classes = classes.select("scope", "id", F.monotonically_increasing_id().alias("c"), F.transform("shingles", lambda s: F.xxhash64("scope", s)).alias("shingles"))
    classes = materialised(classes, "shingles")
    each = classes.select("c", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("c")
    rare = each.join(often, "s").withColumn("k", F.row_number().over(own.orderBy("df", "s"))).withColumn("shared", F.count("*").over(own))
    # Shingles that no other text has come first in the order, n - shared of them.
    prefix = rare.where(F.col("k") <= F.col("shared") - F.ceil(F.col("n") * least) + 1).select("c", "n", "s")
    prefix = materialised(prefix, "shingle-prefixes")
    a, b = (prefix.select(F.col("c").alias(f"c_{x}"), F.col("n").alias(f"n_{x}"), "s") for x in "ab")
    fits = (F.col("c_a") < F.col("c_b")) & (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))
    pairs = a.join(b, "s").where(fits).select("c_a", "c_b").distinct()
    sets = lambda x: classes.select(*(F.col(n).alias(f"{n}_{x}") for n in ("c", "scope", "id")), F.col("shingles").alias(f"s_{x}"))
    full = pairs.join(sets("a"), "c_a").join(sets("b"), "c_b").where(F.col("scope_a") == F.col("scope_b")).withColumn("common", F.size(F.array_intersect("s_a", "s_b")))
    similarity = F.col("common") / (F.size("s_a") + F.size("s_b") - F.col("common"))
    ordered = full.withColumn("similarity", F.round(similarity, 4)).where(similarity >= least)
    return ordered.select(F.col("scope_a").alias("scope"), F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "common", "similarity")


def repeats(posts: DataFrame, text: str = "body") -> DataFrame:
    """(id, original_id): posts with the same words as an earlier one of their scope."""
    key = F.md5(F.array_join(tokens(F.col(text)), " "))
    first = posts.where(F.length(text) >= MIN_SHINGLE_TEXT).groupBy("scope", key.alias("k")).agg(F.min("id").alias("original_id"), F.count("*").alias("n")).where("n > 1")
    long_ = posts.where(F.length(text) >= MIN_SHINGLE_TEXT).select("id", "scope", key.alias("k"))
    return long_.join(first, ["scope", "k"]).where("id > original_id").select("id", "original_id")


def originality(pages: DataFrame, text: str = "title") -> DataFrame:
    """(page_id, originality_score): 1 for the page of the smallest id among those of equal words, a share of 1 / n for the other n - 1. Null counts as no words."""
    own = pages.select("page_id", F.md5(F.array_join(tokens(F.col(text)), " ")).alias("k"))
    classes = own.groupBy("k").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    return own.join(classes, "k").select("page_id", F.when(F.col("page_id") == F.col("first"), 1.0).otherwise(1.0 / F.col("n")).alias("originality_score"))


def vocabulary(pages: DataFrame) -> DataFrame:
    """(word): words longer than three characters of titles and of the first 100 characters of contents."""
    words = F.array_union(tokens(F.col("title")), tokens(F.left("content", F.lit(100))))
    return pages.select(F.explode(words).alias("word")).where(F.length("word") > 3).distinct()


def trigrams(word: Column) -> Column:
    padded = F.concat(F.lit("__"), F.lower(word), F.lit("__"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def spelling_pairs(q: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(query_id, q, word): each pair once whose score can reach least without the points for spelled-out umlauts. No word is a query.

    An edit touches three trigrams at most, so the trigrams that a pair shares bound its distance from below and its score from above. For each pair of shapes (trigrams, length) this tells how many must be shared, and by the prefix rule two words that share t of n have one of the first n - t + 1 in common, rarest first. Only these are joined, keyed by both lengths, so that a common trigram's words don't all meet in one task. Before a pair leaves the join, bitmaps bound the trigrams it shares, and its distance is taken.
    """
    percent = lambda part, whole: F.floor((200 * part + whole) / (2 * whole))  # noqa: E731  # rounded, halves upwards

    def reaches(common: Column, edits: Column, begin: Column) -> Column:
        longest, near = F.greatest("l_q", "l_w"), F.abs(F.col("l_q") - F.col("l_w")) <= 1
        sound = F.when(begin, 2).otherwise(0) + F.when(near, 1).otherwise(0)
        return 7 * percent(longest - edits, longest) + 3 * percent(2 * common, F.col("n_q") + F.col("n_w")) + 10 * sound >= 10 * least

    fewest = lambda common: F.greatest(F.lit(1), F.abs(F.col("l_q") - F.col("l_w")), F.ceil((F.greatest("n_q", "n_w") - common) / 3))
    bits = lambda half: F.expr(f"aggregate(grams, 0L, (s, g) -> s | if(pmod(xxhash64(g), 128) div 64 = {half}, shiftleft(1L, cast(pmod(xxhash64(g), 64) AS INT)), 0L))")
    sized = lambda df, c, x: materialised(df.withColumn("grams", trigrams(F.col(c))).select("*", F.size("grams").alias(f"n_{x}"), F.length(c).alias(f"l_{x}"), F.left(c, F.lit(2)).alias(f"begin_{x}"), *(bits(i).alias(f"bits{i}_{x}") for i in (0, 1))), "spelling")
    a, b = sized(q.select("query_id", "q").distinct(), "q", "q"), sized(words.select("word").distinct(), "word", "w")
    shapes = a.select("n_q", "l_q").distinct().crossJoin(b.select("n_w", "l_w").distinct())
    enough = F.filter(F.sequence(F.lit(1), F.least("n_q", "n_w")), lambda c: reaches(c, fewest(c), F.lit(True)))
    need = materialised(shapes.withColumn("need", F.get(enough, 0)).where("need is not null"), "spelling-shapes")
    parts, on = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["g", "l_q", "l_w"]
    often = materialised(b.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("df")), "spelling-grams")

    def firsts(df: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
        own = df.select(*df.drop("grams").columns, F.explode("grams").alias("g")).join(often, "g", "left")
        placed = own.withColumn("i", F.row_number().over(Window.partitionBy(*key).orderBy(F.coalesce("df", F.lit(0)), "g"))).where("df is not null").drop("df")
        by_length = need.groupBy(f"n_{x}", f"l_{x}", f"l_{y}").agg(F.min("need").alias("need"))
        kept = placed.join(F.broadcast(by_length), [f"n_{x}", f"l_{x}"]).where(F.col("i") <= F.col(f"n_{x}") - F.col("need") + 1)
        return materialised(kept.drop("i", "need"), "spelling-firsts").repartition(parts, *on)  # by number, as rows are small and their pairs many

    missing = lambda x, y: sum((F.bit_count(F.col(f"bits{i}_{x}").bitwiseAND(F.bitwise_not(f"bits{i}_{y}"))) for i in (0, 1)), F.lit(0))
    shared = F.least(F.col("n_q") - missing("q", "w"), F.col("n_w") - missing("w", "q"))
    begin = F.col("begin_q") == F.col("begin_w")
    joined = firsts(a, ["query_id", "q"], "q", "w").hint("merge").join(firsts(b, ["word"], "w", "q"), on)
    near = joined.where(reaches(shared, fewest(shared), begin)).where(reaches(shared, F.levenshtein("q", "word"), begin))
    return materialised(near.select("query_id", "q", "word"), "spelling-near").distinct()  # stored first, as join and grouping in one piece of code are too long to be compiled


def did_you_mean(queries: DataFrame, words: DataFrame, n: int = 5, least: int = 60) -> DataFrame:
    """(query_id, word, score, rank): the best n words for single-word queries that aren't words themselves. The score is 0.7 of the edit similarity plus 0.3 of the trigram overlap, both in percent, plus up to 8 for like sound; candidates share a trigram with the query. Pairs that spelled-out umlauts make equal have 5 of the 8, and are joined by that; other pairs have 3 at most."""
    q = queries.select("query_id", F.trim(F.lower("query")).alias("q")).where(~F.contains("q", F.lit(" ")) & (F.length("q") >= 2))
    q = q.join(words.select(F.col("word").alias("q")), "q", "left_anti")
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("ä"), F.lit("ae")), F.lit("ö"), F.lit("oe")), F.lit("ü"), F.lit("ue")), F.lit("ß"), F.lit("ss"))
    alike = q.withColumn("p", plain("q")).join(words.withColumn("p", plain("word")), "p").select("query_id", "q", "word")
    pairs = materialised(spelling_pairs(q, words, least).unionByName(alike).distinct(), "spelling-pairs")  # else what follows is worked out for every joined row
    pairs = pairs.repartition(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))).select("*", trigrams(F.col("q")).alias("g_q"), trigrams(F.col("word")).alias("g_w"))
    common = F.size(F.array_intersect("g_q", "g_w"))
    dice = half_up(F.round(common * 200.0 / (F.size("g_q") + F.size("g_w")), 6))
    longest = F.greatest(F.length("q"), F.length("word"))
    edit = half_up(F.round((1 - F.levenshtein("q", "word") / longest) * 100, 6))
    sound = F.when(plain("q") == plain("word"), 5).otherwise(0) + F.when(F.left("q", F.lit(2)) == F.left("word", F.lit(2)), 2).otherwise(0) + F.when(F.abs(F.length("q") - F.length("word")) <= 1, 1).otherwise(0)
    score = F.least(F.lit(100.0), edit * 0.7 + dice * 0.3 + sound)
    scored = pairs.withColumn("raw", F.when(common > 0, F.round(score, 6))).where(F.col("raw") >= least).withColumn("score", half_up(F.col("raw")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "word")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select("query_id", "word", "score", "rank")


def autocorrect(suggestions: DataFrame) -> DataFrame:
    """(query_id, word): the best suggestion where its score passes 90."""
    return suggestions.where("rank = 1 and score > 90").select("query_id", "word")


def match_score(query: Column, text: Column) -> Column:
    """100 equal, 90 prefix, 80 prefix of a word, 60 contained, 30 its letters in order, else 0."""
    q, t = F.lower(F.trim(query)), F.lower(F.trim(text))
    # From letter to letter, the place after its first occurrence behind the last one; 0 once there is none.
    after = lambda at, c: F.when(at == 0, 0).otherwise(F.coalesce(F.nullif(F.position(c, t, at), F.lit(0)) + 1, F.lit(0)))
    in_order = F.aggregate(F.filter(F.split(q, ""), lambda c: c != ""), F.lit(1), after) > 0
    return F.when(q == "", 0).when(t == q, 100).when(t.startswith(q), 90).when(F.exists(F.split(t, r"\s+"), lambda w: w.startswith(q)), 80).when(F.contains(t, q), 60).when(in_order, 30).otherwise(0)


def changed_documents(pages: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    """(url, text_hash) of pages whose text differs from the one that was embedded, or that have no embedding; known has text_hash and the key that tells pages apart. A row for each such page, also where pages or known repeat a key: a page is known if any row of its key has its hash."""
    now = pages.select(F.col(key).alias("__key"), "url", F.sha1(F.concat_ws(" ", "title", "title", "content")).alias("text_hash"))
    return now.join(known.select(F.col(key).alias("__key"), "text_hash"), ["__key", "text_hash"], "left_anti").select("url", "text_hash")


def missing_embeddings(pages: DataFrame, known: DataFrame, n: int = 200) -> DataFrame:
    """(url, crawled_at) of the n pages crawled last, ties by url and unknown times last, that have no embedding yet and more than 50 characters of title and content; known has url. The order of a nightly batch: each run takes the next n."""
    text = F.length(F.concat(F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    new = pages.where(text > MIN_EMBEDDED).join(known.select("url").distinct(), "url", "left_anti")
    return new.orderBy(F.desc_nulls_last("crawled_at"), "url").limit(n).select("url", "crawled_at")


def embed(pages: DataFrame, encode: Callable[[list[str]], list[list[float]]], id_col: str = "url", text: str = "content") -> DataFrame:
    """(id, embedding) of the texts of more than 50 characters: encode is the caller's model, called in tasks on a batch of texts at a time; it gives one vector a text. Null and shorter texts have no row."""
    rows = pages.where(F.length(text) > MIN_EMBEDDED).select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "embedding": encode(b["text"].tolist()) if len(b) else []})

    return rows.mapInPandas(work, T.StructType([rows.schema["id"], T.StructField("embedding", T.ArrayType(T.FloatType()))])).withColumnRenamed("id", id_col)


def url_key(url: Column) -> Column:
    """Host without www. and path, in lower case, without a slash at the end."""
    parts = F.regexp_replace(F.regexp_replace(F.lower(url), r"^https?://(www\.)?", ""), r"[?#].*$", "")
    return F.regexp_replace(parts, r"/+$", "")
