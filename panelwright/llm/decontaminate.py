"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations alone.

An item is cut into windows of 13 words (a shorter item is one window). A window's tokens
are its three-word shingles, ordered by how rare they are in the documents; a first pass
over the documents only counts them. As a document must hold all of a window, its rarest
shingle is the prefix that has to match, and a second pass joins the documents with prefix
tokens alone. A match fixes where windows would start (positional bound) and that they must
fit in the document (length bound). What the document says at each such place is then
joined with the windows word by word, so that however many windows share a token, a place
is tried once for each length. Beyond the bound of a broadcast, tokens reach the documents
as a blocked Bloom filter first, and only what passes is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import blocks_for, bloom_filter, may_hold
from .common import BROADCAST_ROWS, join_lists, small, stage, table, unused
from .url_filter import LOWER, UPPER

WINDOW = 13
SHINGLE = 3
#: A document is contaminated if one word in this many is hit.
HIT_SHARE = 20
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: F.Column) -> F.Column:
    """The words of a text: A-Z lowered, runs of what is neither an ASCII letter, digit nor beyond ASCII as gaps; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), GAPS), "")


def _shingle(at: str, size: int) -> F.Column:
    return F.expr(f"xxhash64({size}, " + ", ".join(f"get(words, {at} + {k})" for k in range(size)) + ")")


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """win(words array, key string, item): each window of each item."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("all")).where("size(all) > 0")
    starts = items.select("item", "all", F.explode(F.expr(f"sequence(0, greatest(size(all) - {WINDOW}, 0))")).alias("at"))
    return starts.select("item", F.expr(f"slice(all, at + 1, {WINDOW})").alias("words")).withColumn("key", F.array_join("words", " "))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and is clean; an item without words is left out, and
    a null item id hits but isn't counted as an item. Repeated items count once by id.
    Repeated rows each get their result. Empty tables give no rows or no hits; other
    columns are ignored. Texts are searched whole.
    """
    return _judged(docs, benchmark, id_col, text_col).drop("text_hash")


def _spots(worded: DataFrame, sizes: list[int], first: int) -> DataFrame:
    """(id, h, n_words, pos, token) for each position from first and shingle size of worded(id, h, words)."""
    places = F.expr(f"if(size(words) > {first}, sequence({first}, size(words) - 1), cast(array() as array<int>))")
    spots = worded.select("id", "h", "words", F.size("words").alias("n_words"), F.explode(places).alias("pos"))
    token = [_shingle("pos", k) for k in sizes]
    if len(token) > 1:  # with short items, a spot has tokens of several sizes; the document itself keeps one row
        spots = spots.select("*", F.posexplode(F.array(*token)).alias("which", "token")).where("pos >= 0 OR which = 0")
    else:
        spots = spots.withColumn("token", token[0] if token else F.lit(None).cast("long"))
    return spots.select("id", "h", "n_words", "pos", "token")


def _holding(spots: DataFrame, tokens: DataFrame, also: str = "false") -> DataFrame:
    """spots whose token is among the distinct tokens(token), and those that also speaks for."""
    n = tokens.count()
    if n > BROADCAST_ROWS:
        blocks = blocks_for(n)
        found = may_hold(spots.where("pos >= 0"), "token", stage(bloom_filter(tokens, "token", blocks), "bench-bloom"), blocks)
        return found.join(tokens, "token", "left_semi").unionByName(spots.where(also))
    met = spots.join(F.broadcast(tokens.withColumn("known", F.lit(True))), "token", "left")
    return met.where(f"(known AND pos >= 0) OR {also}").drop("known")


def _judged(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """contamination with text_hash, which with the id tells rows apart."""
    windows = stage(item_windows(benchmark), "bench-windows")
    listed = windows.groupBy("key").agg(F.first("words").alias("words")).withColumn("len", F.size("words"))
    listed = listed.withColumn("s", F.least(F.lit(SHINGLE), F.col("len")))
    tokens = listed.select("key", "words", "len", "s", F.explode(F.expr("sequence(0, len - s)")).alias("at"))
    by_size = F.coalesce(*[F.when(F.col("s") == k, _shingle("at", k)) for k in range(1, SHINGLE + 1)])
    tokens = stage(tokens.select("key", "len", "s", "at", by_size.alias("token")), "bench-tokens")
    sizes = sorted(r[0] for r in tokens.select("s").distinct().collect())  # 1 to 3

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    own = own.select("id", F.xxhash64("text").alias("h"), "text")
    worded = own.select("id", "h", words_of(F.col("text")).alias("words"))

    counts = _holding(_spots(worded, sizes, 0), stage(tokens.select("token").distinct(), "bench-known")).groupBy("token").agg(F.count("*").alias("n"))
    counts = stage(counts, "bench-counts")
    ranked = tokens.join(small(counts), "token")  # a token that no document has rules its windows out
    whole = tokens.groupBy("key").agg(F.count("*").alias("needed"))
    prefix = ranked.groupBy("key").agg(F.min(F.struct("n", "at", "token", "len")).alias("x"), F.count("*").alias("had")).join(whole, "key").where("had = needed")
    prefix = stage(prefix.select("x.at", "x.token", "x.len").distinct(), "bench-prefix")

    # position -1 stands for the document itself
    met = _holding(_spots(worded, sizes, -1), stage(prefix.select("token").distinct(), "bench-firsts"), "pos = -1")
    met = stage(met.select("id", "h", "n_words", "pos", "token"), "bench-met")
    starts = met.where("pos >= 0").join(small(prefix), "token").where("pos >= at AND pos - at + len <= n_words")
    starts = starts.select("id", "h", (F.col("pos") - F.col("at")).alias("start"), "len").distinct()
    wanted = starts.groupBy("id", "h").agg(F.collect_list(F.struct("start", "len")).alias("tries"))  # a few for each of the document's words
    wanted = stage(wanted, "bench-tries")
    texts = join_lists(own, wanted).select("id", "h", words_of(F.col("text")).alias("words"), "tries").dropDuplicates(["id", "h"])
    tried = texts.select("id", "h", "words", F.explode("tries").alias("x")).select("id", "h", "x.*", F.expr("array_join(slice(words, x.start + 1, x.len), ' ')").alias("key"))
    hits = stage(tried.join(small(listed.select("key")), "key"), "bench-hits")

    covered = hits.select("id", "h", "start", "len").distinct().groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "len"))).alias("spans"))
    covered = covered.select("id", "h", F.expr("aggregate(spans, struct(0 AS upto, 0L AS n), (a, x) -> struct(greatest(a.upto, x.start + x.len) AS upto, a.n + greatest(0, x.start + x.len - greatest(a.upto, x.start)) AS n)).n").alias("n_hit"))
    items = hits.select("id", "h", "key").distinct().join(small(windows.select("key", "item").distinct()), "key")
    items = items.groupBy("id", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = covered.alias("c").join(items.alias("t"), F.col("c.id").eqNullSafe(F.col("t.id")) & (F.col("c.h") == F.col("t.h")))
    found = stage(found.select(F.col("c.id").alias("i"), F.col("c.h").alias("g"), "n_hit", "items"), "bench-found")

    each = met.where("pos = -1").join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listing = F.coalesce("items", F.array().cast("array<string>"))
    return each.select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(listing).cast("long").alias("n_items"),
        F.sha2(F.array_join(listing, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * HIT_SHARE >= F.col("n_words"))).alias("contaminated"),
        F.col("h").alias("text_hash"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without contaminated rows, all columns as they were; a row is judged by its id and text."""
    bad = _judged(docs, benchmark, id_col, text_col).where("contaminated")
    i, of, h = (unused(docs, x) for x in ("bad_id", "bad_hash", "own_hash"))
    bad = small(stage(bad.select(F.col(id_col).alias(i), F.col("text_hash").alias(of)).distinct(), "bench-bad"))
    marked = docs.withColumn(h, F.xxhash64(F.col(text_col).cast("string")))
    return marked.join(bad, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(h) == F.col(of)), "left_anti").drop(h)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every item of the benchmark: n_words, n_hit, n_items, items_sha256, contaminated."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM wins
), spots AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)
), hits AS (SELECT DISTINCT doc_id, spots.k, i, win FROM spots SEMI JOIN wins ON spots.k = wins.k AND spots.win = wins.win
), words AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hits
), n AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id
), items AS (SELECT DISTINCT doc_id, item_id FROM hits JOIN wins ON hits.k = wins.k AND hits.win = wins.win
), its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM items GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {HIT_SHARE} * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN its USING (doc_id)
"""
