"""Line dedup over overlapping three-line windows.

A document's windows are its runs of WINDOW consecutive lines, blank ones left
out, each trimmed and hashed to 128 bits. A window met before, in this document
or another, is a later occurrence; the lines it covers, with blank ones between
them, are merged by document and removed. Order is by id, then by place; so the
first copy of every line in a repeated passage stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace

WINDOW = 3
#: Where lines end: patterns of one character.
LINES = r"\n"
CLAUSES = r"[\n ](?<=\n|[.,;:!?] )"
#: Characters of the shortest window that is compared where lines end with clauses.
LEAST_CLAUSES = 100
#: Documents to cut are broadcast up to this many, and bytes of their masks (a byte
#: a line, some 16 MB in all); beyond it they are joined by a shuffle of the texts.
MOST_DOCUMENTS = 100_000
MOST_LINES = 8_000_000


def _occurrences(docs: DataFrame, id_col: str, text_col: str, window: int, ends: str, least: int) -> DataFrame:
    """(id, digest, first, last, h1, h2): line numbers (from 0) and hash of each window.

    A document's windows are made as one array and only they are exploded, so a
    text's memory grows with its lines."""
    numbered = F.transform(F.split(F.col(text_col), ends), lambda line, i: F.struct(i.alias("i"), F.trim(line).alias("t")))
    lines = docs.select(F.col(id_col).alias("id"), F.md5(text_col).alias("digest"), F.filter(numbered, lambda x: x.t != "").alias("lines"))
    n = F.greatest(F.size("lines") - window + 1, F.lit(0))
    shifted = F.arrays_zip(*(F.slice("lines", F.lit(k + 1), n).alias(f"l{k}") for k in range(window)))

    def joined(x):
        return F.struct(x.l0.i.alias("first"), x[f"l{window - 1}"].i.alias("last"), F.concat_ws("\n", *(x[f"l{k}"].t for k in range(window))).alias("t"))

    def hashed(x):
        return F.struct(x.first, x.last, F.xxhash64(x.t, F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), x.t).alias("h2"))

    long = F.filter(F.transform(shifted, joined), lambda x: F.char_length(x.t) >= least)
    # Exploded as an expression: for a column Spark would add a filter that makes all windows again.
    return lines.select("id", "digest", F.inline(F.transform(long, hashed)))


def _masks(later: DataFrame) -> DataFrame:
    """(__id, __digest, __mask binary, __n): for each line to the last covered one, 0x31 if it goes."""
    document = ["id", "digest"]
    order = Window.partitionBy(*document).orderBy("first", "last")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.max("last").over(before) < F.col("first"), F.lit(True))
    spans = later.select(*document, "first", "last").distinct().withColumn("fresh", fresh)
    runs = spans.withColumn("run", F.sum(F.col("fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*document, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    gap = F.col("first") - F.coalesce(F.lag("last").over(Window.partitionBy(*document).orderBy("run")) + 1, F.lit(0))
    n = F.col("last") - F.col("first") + 1
    parts = runs.select(*document, "run", n.alias("n"), F.concat(F.repeat(F.lit("0"), gap), F.repeat(F.lit("1"), n)).alias("part"))
    whole = parts.groupBy(*document).agg(F.array_sort(F.collect_list(F.struct("run", "part"))).alias("parts"), F.sum("n").alias("__n"))
    return whole.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.array_join("parts.part", "").cast("binary").alias("__mask"), "__n")


def drop_repeated_lines(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", ends: str = LINES, least: int = 0) -> DataFrame:
    """``docs`` with the text left, n_lines long and n_removed long.

    Lines end at each match of ``ends``, a pattern of one character: LINES, or
    CLAUSES, which also ends them at a space behind a punctuation mark, so that a
    passage inside a longer line is found. Windows of fewer than ``least``
    characters (joined by a line feed each) are left alone. A line goes with the
    character before it, the first with the one behind it.

    A null text stays null with 0 lines; an empty one is one blank line. Texts of
    fewer than ``window`` lines that aren't blank are left as they are. Null ids
    come last in order. Rows that repeat both id and text are one document, and
    all end alike. Lines are compared without spaces at their ends; those kept
    are unchanged. A text may end empty. Columns of ``docs`` named n_lines or
    n_removed are replaced, others stay. Work and memory for a text grow with its
    length, whatever its lines."""
    work = Workspace(docs.sparkSession, "linededup")
    found = _occurrences(docs, id_col, text_col, window, ends, least)
    place = lambda: F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("digest").alias("digest"), F.col("first").alias("first"))
    # Hashes alone are counted over all windows; places are compared among those met twice.
    twice = work.materialize(found.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "twice")
    shared = work.materialize(found.join(twice, ["h1", "h2"]), "shared")
    repeated = shared.groupBy("h1", "h2").agg(F.min(place()).alias("earliest"), F.max(place()).alias("latest")).where(F.col("earliest") != F.col("latest"))
    # A written table: Spark splits a hot window's rows only if no aggregate stands between the shuffle and the join.
    repeated = work.materialize(repeated.select("h1", "h2", "earliest"), "repeated")
    covered = work.materialize(_masks(shared.join(repeated, ["h1", "h2"]).where(place() != F.col("earliest"))), "covered")
    n_documents, n_lines = covered.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("__mask")), F.lit(0))).first()
    if n_documents <= MOST_DOCUMENTS and n_lines <= MOST_LINES:
        covered = F.broadcast(covered)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    joined = docs.select(*kept).join(covered, F.col(id_col).eqNullSafe(F.col("__id")) & (F.md5(text_col) == F.col("__digest")), "left")
    lines = F.split(F.col(text_col), ends)
    before = F.concat(F.array(F.lit("")), F.regexp_extract_all(F.col(text_col), F.lit(f"({ends})"), 1))
    goes = lambda i: F.substring(F.col("__mask"), i + 1, 1) == F.lit("1").cast("binary")
    pieces = F.transform(F.arrays_zip(before.alias("end"), lines.alias("line")), lambda x, i: F.when(~goes(i), F.concat(x.end, x.line)))
    left = F.substring(F.array_join(pieces, ""), F.when(goes(F.lit(0)), 2).otherwise(1), F.lit(2**31 - 1))
    text = F.when(F.col("__mask").isNull(), F.col(text_col)).otherwise(left)
    return joined.select(
        *(text.alias(c) if c == text_col else F.col(c) for c in kept),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce("__n", F.lit(0)).cast("long").alias("n_removed"),
    )
