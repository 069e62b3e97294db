"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of WINDOW words. The tokens of the join are word
pairs (a one-word window has its word). Pairs are ordered by rarity: by their
count over all documents. For a document to hold a whole window it must hold
every pair of it, so the necessary prefix is the window's rarest pair alone;
only document places with that pair are candidates. A candidate's offset and
length bound where the window would begin and end; those inside the document
are compared word for word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace

WINDOW = 10
#: What stands between words. Splitting at it costs a tenth of extracting its complement.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of one block (about 200 bytes each, broadcast). More are looked for block by block, each
#: over all documents: texts and words never cross a shuffle.
BLOCK_WINDOWS = 200_000
#: Documents to drop are broadcast up to this many (about 60 bytes each); beyond it texts are shuffled.
MOST_BROADCAST = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for a null."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.array_remove(F.split(lowered, SEPARATOR), ""), F.array().cast("array<string>"))


def _pair_key(first: Column, second: Column) -> Column:
    """second null: the word alone."""
    return F.xxhash64(first, F.coalesce(second, F.lit("")))


def _windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, win array<string>): each item's windows."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return items.select("item", "words", F.explode(starts).alias("start")).select("item", F.slice("words", F.col("start"), window).alias("win"))


def _places(words: DataFrame, singles: bool) -> DataFrame:
    """Every place (from 0) of every document with its pair's key."""
    following = F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1)))
    pairs = words.select("*", F.posexplode(F.arrays_zip(F.col("words").alias("w"), following.alias("x"))).alias("at", "pair"))
    key = _pair_key(F.col("pair.w"), F.col("pair.x"))
    if not singles:
        return pairs.withColumn("key", key).drop("pair")
    return pairs.withColumn("key", F.explode(F.array(key, _pair_key(F.col("pair.w"), F.lit(None).cast("string"))))).drop("pair")


def _block_hits(work: Workspace, words: DataFrame, keyed: DataFrame, rows: int, singles: bool, block: int) -> DataFrame:
    """(id, digest, window, start, stop): where the block's windows stand."""
    tokens = F.broadcast(keyed.select("key").distinct())
    frequency = _places(words.select("words"), singles).select("key").join(tokens, "key").groupBy("key").agg(F.count("*").alias("n"))
    frequency = work.materialize(frequency, f"frequency-{block}", rows)
    ranked = keyed.join(frequency, "key", "left").groupBy("window", "win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "offset")).alias("rarest"))
    prefix = work.materialize(ranked.where("rarest.n > 0").select("window", "win", "rarest.key", "rarest.offset"), f"prefix-{block}", rows)
    start, size = F.col("at") - F.col("offset"), F.size("win")
    hits = _places(words, singles).join(F.broadcast(prefix), "key").where((start >= 0) & (start + size <= F.size("words")))
    hits = hits.where(F.slice("words", start + 1, size) == F.col("win"))
    return work.materialize(hits.select("id", "digest", "window", start.alias("start"), (start + size).alias("stop")), f"hits-{block}")


def _hit_documents(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(id, digest, n_hit, spans, items) of documents with hits, named by id and text."""
    work = Workspace(docs.sparkSession, "decontaminate")
    owned = _windows(benchmark, item_col, item_text_col, window).withColumn("window", F.sha2(F.array_join("win", " "), 256))
    owned = work.materialize(owned.distinct(), "windows")
    distinct = owned.groupBy("window").agg(F.first("win").alias("win"))
    inner = F.sequence(F.lit(0), F.greatest(F.size("win") - 2, F.lit(0)))
    keyed = distinct.select("window", "win", F.explode(inner).alias("offset"))
    element = lambda i: F.get("win", i)
    keyed = keyed.withColumn("key", _pair_key(element(F.col("offset")), element(F.col("offset") + 1)))

    n_places = distinct.count() * window
    n_blocks = max(1, -(-n_places // (BLOCK_WINDOWS * WINDOW)))
    singles = not owned.where(F.size("win") == 1).isEmpty()
    words = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).select("id", F.md5("text").alias("digest"), words_of(F.col("text")).alias("words"))
    found = [_block_hits(work, words, keyed.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == k), n_places, singles, k) for k in range(n_blocks)]
    hits = reduce(DataFrame.unionByName, found)

    document = ["id", "digest"]
    before = Window.partitionBy(*document).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select(*document, "start", "stop").distinct().withColumn("fresh", F.coalesce(F.max("stop").over(before) < F.col("start"), F.lit(True)))
    upto = Window.partitionBy(*document).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    runs = spans.withColumn("run", F.sum(F.col("fresh").cast("int")).over(upto)).groupBy(*document, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    found = runs.groupBy(*document).agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    items = hits.select(*document, "window").distinct().join(owned.where(F.col("item").isNotNull()).select("window", "item"), "window")
    items = items.groupBy(*document).agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = found.join(items, (found.id.eqNullSafe(items.id)) & (found.digest == items.digest), "left").select(found.id, found.digest, "n_hit", "spans", "items")
    return work.materialize(found, "found")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words long, n_hit long, n_items long, items array<string>,
    spans array<struct<start, stop>>), a row for each row of ``docs``.

    n_hit: words inside any occurrence of a window; spans: merged runs of hit
    words (from 0, stop excluded); items: ids of items with an occurring window,
    sorted as strings. Null, empty and wordless texts have no words and no hits;
    an item without words has no window. Items of a null id make hits but aren't
    counted or listed; rows that repeat an item id are one item. Rows that
    repeat both id and text get the same result each. An empty benchmark gives
    no hits. Other columns of either table are ignored."""
    found = _hit_documents(docs, benchmark, window, id_col, text_col, item_col, item_text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.md5(F.col(text_col)).alias("digest"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    joined = rows.join(found, (rows.digest == found.digest) & rows.id.eqNullSafe(found.id), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        rows.id.alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window; the cases are those of ``contamination``."""
    found = _hit_documents(docs, benchmark, window, id_col, text_col, item_col, item_text_col).select(F.col("id").alias("__id"), F.col("digest").alias("__digest"))
    if found.count() <= MOST_BROADCAST:
        found = F.broadcast(found)
    return docs.join(found, F.col(id_col).eqNullSafe(F.col("__id")) & (F.md5(F.col(text_col)) == F.col("__digest")), "left_anti")
