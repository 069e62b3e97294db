"""Mixing sources to target weights by hierarchical budgeting.

The token budget goes down a tree (by default domain, language, source). A node
shares its budget among its children by weight; a child that can't use its part
(its capacity is its tokens times the epochs allowed) is given what it can use
and the shortage goes to its siblings by weight. Since a node is never given
more than its subtree holds, a shortage reaches a parent's siblings only when
its own siblings are full. Budgets are whole tokens, rounded down.

A leaf then takes its budget as whole epochs and a token prefix of one more
epoch, each epoch being ordered by a seeded hash of its documents. Where the
prefix ends is found from sums over ranges of that hash and the one range that
holds the end, so a hot leaf's documents are never sorted in one place. This
works on a written table of counts and digests; texts are read once to make it
and, where the mix has them, once more to be filtered. They cross no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace

#: Documents in a hash range, about.
RANGE_ROWS = 4096
#: Tables of leaves are broadcast up to this many rows.
MOST_BROADCAST = 50_000
NONE = "(none)"
#: A word with the space about it, its first character apart; or space alone. White space is ASCII's.
_S = r"\x20\x09-\x0D"
HAS_WORD = rf"[^{_S}]"
WORD = rf"[{_S}]*+([^{_S}])[^{_S}]*+[{_S}]*+|[{_S}]++"


def count_words(text: Column) -> Column:
    """Words between ASCII white space; 0 for a null."""
    return F.coalesce(F.char_length(F.regexp_replace(text, WORD, "$1")), F.lit(0)).cast("long")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Column], budget: int) -> DataFrame:
    """``leaves`` (the levels, capacity long) with leaf_budget long.

    ``weights``: for each level the weight of a node among its siblings, a whole
    number from 1, of that level's columns and those above."""
    level_rows = leaves.select(*levels, "capacity")
    parent = level_rows.agg(F.least(F.coalesce(F.sum("capacity"), F.lit(0)), F.lit(budget)).cast("long").alias("given"))
    for depth, weight in enumerate(weights):
        above, names = list(levels[:depth]), list(levels[: depth + 1])
        nodes = level_rows.groupBy(*names).agg(F.sum("capacity").alias("c")).withColumn("w", weight.cast("long"))
        nodes = nodes.join(parent, above) if above else nodes.crossJoin(F.broadcast(parent))  # one row
        order = Window.partitionBy(*above).orderBy(F.col("c") / F.col("w"), levels[depth]).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*above)
        c_before, w_before = F.coalesce(F.sum("c").over(order), F.lit(0)), F.coalesce(F.sum("w").over(order), F.lit(0))
        nodes = nodes.withColumn("full", F.col("c") * (F.sum("w").over(whole) - w_before) <= F.col("w") * (F.col("given") - c_before))
        c_full, w_free = F.sum(F.when(F.col("full"), F.col("c")).otherwise(0)).over(whole), F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(whole)
        share = F.when(F.col("full"), F.col("c")).otherwise(F.floor(F.expr("w * (given - c_full) div nullif(w_free, 0)")))
        parent = nodes.withColumn("c_full", c_full).withColumn("w_free", w_free).select(*names, share.cast("long").alias("given"))
    return leaves.join(parent.withColumnRenamed("given", "leaf_budget"), list(levels))


def mix_sources(docs: DataFrame, levels: Sequence[tuple[str, Column]], weights: Sequence[Column], budget: int | None = None, budget_share: float = 0.5, epochs: int = 2, seed: int = 0, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` chosen for the mix, once for each epoch that takes them:
    its columns (or ``keep``), the levels, n_tokens long, epoch int (from 0) and
    leaf_budget long (the leaf's tokens).

    ``levels``: (name, value) from the root down; a null value is the branch
    "(none)". ``budget``: tokens; None: ``budget_share`` of all tokens, rounded
    down. ``tokens``: a document's tokens (default: its words). A document joins
    if it fits in its leaf's budget with all before it, so a leaf takes at most
    its budget and misses less than one document of it. Null, empty and blank
    texts have no tokens and are never chosen. Rows that repeat an id and text
    are taken in turn, as other rows are (at the prefix's end some of them). Columns of ``docs`` named as a level or
    output are replaced. An empty table gives an empty one."""
    work = Workspace(docs.sparkSession, "mixing")
    names = [name for name, _ in levels]
    made = [*names, "n_tokens", "epoch", "leaf_budget"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    with_text = text_col in kept
    keys = [*(F.coalesce(value, F.lit(NONE)).alias(name) for name, value in levels), F.col(id_col).cast("string").alias("__id"), F.md5(F.col(text_col)).alias("__digest")]
    count = (count_words(F.col(text_col)) if tokens is None else tokens).alias("n_tokens")
    counted = work.materialize(docs.select(*([] if with_text else kept), *keys, count).where("n_tokens > 0"), "counted")

    leaves = counted.groupBy(*names).agg(F.sum("n_tokens").alias("total"), F.count("*").alias("n")).withColumn("capacity", F.col("total") * epochs)
    leaves = work.materialize(leaves, "leaves")
    n_leaves = leaves.count()
    bounded = lambda table: F.broadcast(table) if n_leaves <= MOST_BROADCAST else table
    if budget is None:
        budget = int((leaves.agg(F.sum("total")).first()[0] or 0) * budget_share)
    digits = F.ceil(F.log(F.greatest(F.col("n") / RANGE_ROWS, F.lit(1.0))) / F.log(F.lit(16.0))).cast("int")
    plan = budgets(leaves, names, weights, budget).select(*names, "leaf_budget", F.expr("leaf_budget div total").cast("int").alias("__whole"), (F.col("leaf_budget") % F.col("total")).alias("__rest"), digits.alias("__digits"))
    plan = work.materialize(plan, "plan", n_leaves)
    rank = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__whole").cast("string"), F.coalesce("__id", F.lit("")), F.col("__digest")))
    cuts = work.materialize(_cuts(counted, plan, names, rank, bounded, work), "cuts", n_leaves)

    # Counts of texts are taken again of the chosen ones alone.
    late = with_text and tokens is None
    rows = docs.select(*kept, *keys, *([] if late else [count])) if with_text else counted
    rows = rows.where(F.col(text_col).rlike(HAS_WORD) if late else F.col("n_tokens") > 0)
    placed = rows.join(bounded(cuts), names).withColumn("__rank", rank)
    inside = F.coalesce((F.col("__rank") < F.col("__upto")) | (F.col("__all") & (F.col("__rank") == F.col("__upto"))), F.lit(False))
    n = F.col("__whole") + inside.cast("int")
    out = [*kept, *names, count if late else F.col("n_tokens")]
    chosen = placed.where(n > 0).select(*out, F.explode(F.sequence(F.lit(0), n - 1)).alias("epoch"), "leaf_budget")
    if cuts.where(~F.col("__all")).isEmpty():
        return chosen
    # Some rows of a text that is repeated where the prefix ends.
    tied = placed.where(~F.col("__all") & (F.col("__rank") == F.col("__upto"))).withColumn("__turn", F.row_number().over(Window.partitionBy(*names).orderBy("__digest")))
    return chosen.unionByName(tied.where("__turn <= __take").select(*out, F.col("__whole").alias("epoch"), "leaf_budget"))


def _cuts(counted: DataFrame, plan: DataFrame, names: list[str], rank: Column, bounded: Callable[[DataFrame], DataFrame], work: Workspace) -> DataFrame:
    """``plan`` with where each leaf's prefix ends: the ranks before __upto are in it, and of
    those equal to it all rows (__all) or __take. A null __upto: nothing is."""
    placed = counted.join(bounded(plan), names).withColumn("__rank", rank).withColumn("__range", F.substring("__rank", F.lit(1), F.col("__digits")))
    sums = placed.groupBy(*names, "__range").agg(F.sum("n_tokens").alias("size"), F.first("__rest").alias("rest"), F.max("__rank").alias("top"))
    upto = Window.partitionBy(*names).orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    sums = work.materialize(sums.withColumn("end", F.sum("size").over(upto)), "ranges")
    entire = sums.where("end <= rest").groupBy(*names).agg(F.max("top").alias("top"))
    edge = sums.where("end > rest and end - size < rest").select(*names, "__range", (F.col("end") - F.col("size")).alias("__begin"))
    within = Window.partitionBy(*names).orderBy("__rank").rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.join(bounded(edge), [*names, "__range"]).withColumn("taken", F.col("__begin") + F.sum("n_tokens").over(within) <= F.col("__rest"))
    last = ends.groupBy(*names, "__rank").agg(F.count("*").alias("m"), F.count_if("taken").alias("k")).where("k > 0")
    last = last.groupBy(*names).agg(F.max(F.struct("__rank", "m", "k")).alias("last"))
    found = plan.join(entire, names, "left").join(last, names, "left")
    everything = F.coalesce(F.col("last.k") == F.col("last.m"), F.lit(True))
    return found.select(*plan.columns, F.coalesce("last.__rank", "top").alias("__upto"), everything.alias("__all"), F.col("last.k").alias("__take"))
