"""Near-duplicates by SetSketch registers.

A document's set is that of its distinct word shingles. Its sketch has
REGISTERS registers K = clip(floor(1 - log_B(m)), 0, Q + 1), m being the least
of the set's exponential hash values under the register's own hash: truncated
minima on an exponential scale, which merge by maximum and agree with a
probability near the Jaccard similarity. Then:

1. equal sets are one class; only classes go on;
2. bands of ROWS registers make candidate buckets;
3. each class tries the centres of its buckets that the likelihood estimate
   rates highest; exact comparison of the full sets confirms links, and links
   make components;
4. components that still share a bucket are compared class by class, in blocks of
   at most BLOCK classes: registers rule pairs out, the rest is compared exactly.

Pairs within a component aren't compared again: they can't change it. No bucket
is capped, and no group's pairs are emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from . import textgrams as T
from .arrowmap import append_from_text, bound_batches
from .components import connected_components
from .store import Workspace

REGISTERS = 160
ROWS = 5
BASE = 1.001
RATE = 20.0
Q = 65534
#: A pair is compared exactly if its estimate is within this of the threshold
#: (five standard deviations of the estimate at 0.8).
MARGIN = 0.16
CENTRES = 2
#: A block's classes, and bytes of their sets, about.
BLOCK = 512
BLOCK_BYTES = 8 << 20
#: Active classes and dropped rows are looked up by a broadcast up to this many (some 100 bytes each in memory).
MOST_BROADCAST = 500_000

_draw = np.random.Generator(np.random.PCG64(977))
_MULTIPLIERS = _draw.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _draw.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def registers_of(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (uint16) of sets of 64-bit hashes; zeros for an empty set."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(full):
        return out
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    first = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])))[:-1]
    least, v = np.empty((len(full), REGISTERS), np.uint32), np.empty_like(x)
    for j in range(REGISTERS):
        np.multiply(x, _MULTIPLIERS[j], out=v)
        v += _SHIFTS[j]
        least[:, j] = np.minimum.reduceat(v, first)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    out[full] = np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, Q + 1)
    return out


def bands_of(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, distinct between bands."""
    n = REGISTERS // ROWS
    key = np.tile(np.arange(1, n + 1, dtype=np.uint64), (len(registers), 1))
    parts = registers.reshape(len(registers), n, ROWS).astype(np.uint64)
    for r in range(ROWS):
        key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r] + np.uint64(1))
    return key.view(np.int64)


def _probability(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)


def estimate_jaccard(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, steps: int = 50) -> np.ndarray:
    """The similarity of greatest likelihood given both sizes and how many
    registers of ``a`` are above, below and equal to those of ``b`` (row-wise)."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - above - below
    u = size_a / (size_a + size_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    best, value = np.zeros(len(a)), np.full(len(a), -np.inf)
    for s in range(steps + 1):
        j = top * s / steps
        more, less = _probability(u - v * j), _probability(v - u * j)
        with np.errstate(divide="ignore", invalid="ignore"):
            like = sum(np.where(n > 0, n * np.log(np.maximum(p, 1e-300)), 0.0) for n, p in ((above, more), (below, less), (equal, 1 - more - less)))
        better = like > value
        best[better], value[better] = j[better], like[better]
    return best


def _sets(texts: pa.Array, shingle: int) -> Iterator[list[np.ndarray]]:
    for _, _, data, offsets in T.blocks(texts, T.BLOCK_BYTES // 4):
        hashes, first = T.shingles(T.Tokens(data, offsets, T.WHITESPACE), shingle)
        yield [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def _set_id(s: np.ndarray) -> bytes | None:
    if not len(s):
        return None
    return int(s.sum(dtype=np.uint64)).to_bytes(8, "big") + int(T.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)).to_bytes(8, "big")


def _sketch_batch(texts: pa.Array, shingle: int) -> list[pa.Array]:
    count, ids, bands, registers = [], [], [], []
    for sets in _sets(texts, shingle):
        k = registers_of(sets)
        count += [len(s) for s in sets]
        own = [_set_id(s) for s in sets]
        ids += own
        keys = bands_of(k)
        bands += [row if i else None for row, i in zip(keys, own, strict=True)]
        registers += [row.tobytes() if i else None for row, i in zip(k, own, strict=True)]
    return [pa.array(count, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(registers, pa.binary())]


_SKETCH = [StructField("n_shingles", LongType()), StructField("sid", BinaryType()), StructField("bands", ArrayType(LongType())), StructField("registers", BinaryType())]


def _row_key(id_col: str, text_col: str) -> Column:
    """128 bits of a row's id and text."""
    own = F.coalesce(F.concat(F.lit("id "), F.col(id_col).cast("string")), F.lit("none"))
    return F.unhex(F.md5(F.concat(own, F.lit("|"), F.coalesce(F.md5(F.col(text_col)), F.lit("none")))))


def sketch_documents(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, row_key, n_shingles, sid, bands, registers): sid names the set."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _row_key(id_col, text_col).alias("row_key"))
    return append_from_text(rows, "text", _SKETCH, lambda texts: _sketch_batch(texts, shingle), ["id", "row_key"])


def _matrix(column: pa.Array) -> np.ndarray:
    data, at = column.buffers()[2], np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.uint16).reshape(len(column), REGISTERS)


def _estimated(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, estimate) of the pairs whose sizes allow the threshold and whose estimate doesn't exclude it."""
    bound_batches(pairs.sparkSession)
    for x in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("sid").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"registers_{x}")), x)
        if x == "b":
            pairs = pairs.where((F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b, na, nb, ra, rb = batch.columns
            j = estimate_jaccard(_matrix(ra), _matrix(rb), na.to_numpy(), nb.to_numpy())
            keep = pa.array(j >= threshold - MARGIN)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep), pa.array(j).filter(keep)], names=["a", "b", "estimate"])

    return pairs.select("a", "b", "n_a", "n_b", "registers_a", "registers_b").mapInArrow(run, "a binary, b binary, estimate double")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) after comparing the full sets."""
    both = pairs.select("a", "b")
    for x in ("a", "b"):
        both = both.join(sets.select(F.col("sid").alias(x), F.col("hashes").alias(f"set_{x}")), x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(s) + len(t) - len(np.union1d(s, t))
                linked.append(100 * common >= percent * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary, linked boolean")


def _across(members: DataFrame, work: Workspace, n_buckets: int, n_members: int) -> DataFrame:
    """(task, side, within, sid, component): what is compared between components
    that share a bucket.

    members: (key, sid, n_shingles, component), whole buckets of several components. A
    bucket's largest component is its hub. For each hub, its classes in such
    buckets and the others' (the minors) are dealt out in blocks; every minor is
    compared with the hub's classes and with the other minors, a task having two
    blocks at most. Registers that differ too much rule a pair out; the rest is
    compared exactly, likeliest first, until the two components are joined.

    Aggregates are written before they are joined, so that a hot key's rows can be split."""
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    hubs = work.materialize(sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("hub")), "hubs", n_buckets)
    rows = members.join(hubs, "key").select("hub", "sid", "n_shingles", "component").distinct().withColumn("minor", F.col("component") != F.col("hub"))
    rows = work.materialize(rows, "sides", n_members)
    size = lambda c: F.greatest(F.count_if(c) / BLOCK, F.sum(F.when(c, F.col("n_shingles"))) * 8 / BLOCK_BYTES, F.lit(1))
    blocks = lambda c: F.ceil(size(c)).cast("int")
    stats = work.materialize(rows.groupBy("hub").agg(blocks(~F.col("minor")).alias("majors"), blocks(F.col("minor")).alias("minors")), "blocks", n_buckets)
    block = F.pmod(F.xxhash64("sid"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int")
    rows = rows.join(stats, "hub").withColumn("block", block)
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    task = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    own = F.col("block")
    tasks = F.when(~F.col("minor"), F.transform(upto("minors"), lambda i: task(0, i, own))).otherwise(
        F.concat(F.transform(upto("majors"), lambda j: task(0, own, j)), F.transform(upto("minors"), lambda i: task(1, F.least(i, own), F.greatest(i, own))))
    )
    dealt = rows.withColumn("task", F.explode(tasks))
    side = F.when(F.col("task.kind") == 0, F.col("minor").cast("int")).otherwise((F.col("block") == F.col("task.i")).cast("int"))
    within = (F.col("task.kind") == 1) & (F.col("task.i") == F.col("task.j"))
    return dealt.select(F.xxhash64("hub", "task").alias("task"), side.alias("side"), within.alias("within"), "sid", "component")


def _joining(dealt: DataFrame, classes: DataFrame, threshold: float, percent: int) -> DataFrame:
    """The linked pairs of ``_across``'s tasks. classes: (sid, registers, hashes)."""
    least_equal = REGISTERS * (threshold - MARGIN - 0.01)

    def compare(batch: pa.RecordBatch) -> tuple[list[int], list[int]]:
        regs = _matrix(batch.column(5))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(6)]
        n = np.array([len(x) for x in sets])
        comp = np.unique(np.array(batch.column(4).to_pylist(), object), return_inverse=True)[1]
        side, within = batch.column(1).to_numpy(), batch.column(2)[0].as_py()
        out: tuple[list[int], list[int]] = ([], [])
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        for x in left:
            others = left[left > x] if within else right
            others = others[(comp[others] != comp[x]) & (np.minimum(n[others], n[x]) >= threshold * np.maximum(n[others], n[x]) - 1e-9)]
            if not len(others):
                continue
            equal = (regs[others] == regs[x]).sum(axis=1)
            for y in others[equal >= least_equal][np.argsort(-equal[equal >= least_equal], kind="stable")]:
                if comp[y] == comp[x]:
                    continue
                common = n[x] + n[y] - len(np.union1d(sets[x], sets[y]))
                if 100 * common >= percent * (n[x] + n[y] - common):
                    comp[comp == comp[y]] = comp[x]
                    out[0].append(x)
                    out[1].append(y)
        return out

    def linked(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(pieces).combine_chunks().to_batches()[0] if len(pieces) > 1 else pieces[0]
        if len(whole) < 2:
            return
        x, y = compare(whole)
        if x:
            pairs = list(zip(*(whole.column(3).take(pa.array(v)).to_pylist() for v in (x, y)), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([f(p) for p in pairs], pa.binary()) for f in (max, min)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by task; no more than one task's are held."""
        task, held = None, []
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1 if len(keys) else []
            for s, e in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if e > s and keys[s] != task:
                    if held:
                        yield from linked(held)
                    task, held = keys[s], []
                held += [batch.slice(s, e - s)] if e > s else []
        if held:
            yield from linked(held)

    bound_batches(dealt.sparkSession)
    whole = dealt.join(classes, "sid").select("task", "side", "within", "sid", "component", "registers", "hashes")
    return whole.repartition(F.col("task")).sortWithinPartitions("task").mapInArrow(run, "a binary, b binary").distinct()


def _classified(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(id, row_key, n_shingles, component, component_id, kept), and how many rows."""
    spark, threshold = docs.sparkSession, percent / 100
    work = Workspace(spark, "neardup")
    sketch = work.materialize(sketch_documents(docs, id_col, text_col, shingle), "sketch")
    n = sketch.count()
    classes = work.materialize(
        sketch.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.min("row_key").alias("row_key"), F.min("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("registers").alias("registers")), "classes", n, wide=True
    )
    banded = classes.select("sid", "n_shingles", F.explode("bands").alias("key"))
    # Aggregates are written before they are joined: else Spark can't split a hot key's rows.
    buckets = work.materialize(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets", n * REGISTERS // ROWS // 2)
    n_buckets, n_members = buckets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    members = work.materialize(banded.join(buckets.select("key"), "key"), "members", n_members)
    active = work.materialize(classes.join(members.select("sid").distinct(), "sid").select("sid", "row_key", "n_shingles", "registers"), "active", n, wide=True)
    n_active = active.count()

    wanted = active.select("sid", "row_key")
    if n_active <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(text_col).alias("text"), _row_key(id_col, text_col).alias("row_key")).join(wanted, "row_key").select("sid", "text")
    sets = append_from_text(texts, "text", [StructField("own", BinaryType()), StructField("hashes", BinaryType())], lambda c: _sets_batch(c, shingle), ["sid"])
    sets = work.materialize(sets.where("sid = own").select("sid", "hashes").dropDuplicates(["sid"]), "sets", n_active, wide=True)

    centres = members.groupBy("key").agg(F.min("sid").alias("b"), F.min(F.struct(F.xxhash64("sid").alias("h"), "sid")).alias("other"))
    stars = members.join(work.materialize(centres, "centres", n_buckets), "key")
    stars = stars.select(F.col("sid").alias("a"), "b").union(stars.select(F.col("sid").alias("a"), F.col("other.sid").alias("b"))).where("a != b").distinct()
    rated = _estimated(stars, active, threshold)
    best = rated.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("estimate", "b")), asc=False), 1, CENTRES).alias("best"))  # at most two centres a band
    tried = best.select("a", F.explode("best.b").alias("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tried = work.materialize(_confirmed(tried, sets, percent), "tried")
    found = connected_components(tried.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")), work, "first")

    labelled = members.join(found.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", "n_shingles", F.coalesce("component", "sid").alias("component"))
    labelled = work.materialize(labelled, "labelled", n_members)
    mixed = labelled.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
    mixed = work.materialize(mixed, "mixed", n_buckets)
    dealt = work.materialize(_across(labelled.join(mixed, "key"), work, n_buckets, n_members), "dealt")
    late = work.materialize(_joining(dealt, active.select("sid", "registers").join(sets, "sid"), threshold, percent), "late", dealt.count())
    if not late.isEmpty():
        named = found.withColumnRenamed("component", "c")
        ends = [named.select(F.col("node").alias(x), F.col("c").alias(c)) for x, c in (("a", "u"), ("b", "v"))]
        joins = late.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("u", "a").alias("u"), F.coalesce("v", "b").alias("v"))
        merged = connected_components(joins, work, "last")
        merged = work.materialize(merged.withColumnRenamed("component", "to"), "merged", n_active)
        old = found.union(merged.join(found.select(F.col("component").alias("node")), "node", "left_anti").select("node", F.col("node").alias("component")))
        found = old.join(merged.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))

    rows = sketch.select("id", "row_key", "n_shingles", "sid").join(found.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    rows = work.materialize(rows.select("id", "row_key", "n_shingles", "component"), "rows", n)
    names = work.materialize(rows.where("component is not null").groupBy("component").agg(F.min("id").alias("component_id")), "names", n)
    own = F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id"))
    named = rows.join(names, "component", "left").select("id", "row_key", "n_shingles", "component", own.alias("component_id"))
    work.drop("classes", "buckets", "members", "active", "sets", "centres", "labelled", "mixed", "hubs", "sides", "blocks", "dealt")
    return named.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())), n


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles long, component_id, kept boolean), a row for each row of ``docs``.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a
    text of fewer than ``shingle`` words, but not none, has its whole sequence as
    its one shingle. Texts are linked if 100 * intersection >= ``percent`` *
    union of their sets. component_id is the smallest id reachable; kept: it is
    the row's own. A null, empty or blank text has 0 shingles, no link, and is
    kept under its own id. A null id takes part through its text but names no
    component; a component of null ids alone has a null component_id and all its
    rows are kept. Rows that repeat an id are each linked by their own text;
    copies of a row are kept alike. Other columns of ``docs`` are ignored."""
    found, _ = _classified(docs, shingle, percent, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``near_duplicates`` doesn't keep."""
    found, n = _classified(docs, shingle, percent, id_col, text_col)
    gone = found.where("not kept").select(F.col("row_key").alias("__row_key")).distinct()
    gone = Workspace(docs.sparkSession, "neardup").materialize(gone, "gone", n)
    if gone.count() <= MOST_BROADCAST:  # else the texts are shuffled
        gone = F.broadcast(gone)
    return docs.join(gone, _row_key(id_col, text_col) == F.col("__row_key"), "left_anti")


def keep_one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group that ``near_duplicates`` links.

    It is the first by id (nulls last), then by digest of id and text; of rows
    that repeat both, the least by all columns, which must have an order. Null,
    empty and blank texts are in no group: all their rows stay."""
    work = Workspace(docs.sparkSession, "neardup")
    found, n = _classified(docs, shingle, percent, id_col, text_col)
    rows = found.where("component is not null")
    keyed = work.materialize(rows.groupBy("component", "row_key").agg(F.min("id").alias("id"), F.count("*").alias("n")), "keyed", n)
    first = work.materialize(keyed.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key")).alias("first")), "first", n)
    same = F.col("row_key") == F.col("first.row_key")
    other = keyed.join(first, "component").where(~same | (F.col("n") > 1)).select(F.col("row_key").alias("__row_key"), same.alias("__again"))
    other = work.materialize(other, "other", n)
    again = other.where("__again").select("__row_key")
    if other.count() <= MOST_BROADCAST:  # else the texts are shuffled
        other, again = F.broadcast(other), F.broadcast(again)
    key = _row_key(id_col, text_col) == F.col("__row_key")
    left = docs.join(other, key, "left_anti")
    if again.isEmpty():
        return left
    copied = docs.join(again, key).groupBy("__row_key").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return left.unionByName(copied.select("row.*"))


def _sets_batch(texts: pa.Array, shingle: int) -> list[pa.Array]:
    sets = [s for block in _sets(texts, shingle) for s in block]
    return [pa.array([_set_id(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
