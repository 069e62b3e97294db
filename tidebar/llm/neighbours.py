"""Approximate nearest neighbours over learned partitions.

Fitted on a bounded sample: its neighbour graph is divided into parts of equal
size (recursive halving along a principal direction, then moves to the part most
neighbours are in, as room allows); a small network learns which parts a
vector's neighbours are in. Where a part holds more than SPLIT_ROWS rows, it is
divided again in the same way, by a model of its own that a task fits on a
bounded sample of the part. Every row is indexed under its most probable part.
A query goes to as many of its most probable parts as reached ``recall`` on the
sample, and to more where those hold too few rows, and is compared there with
every row, in blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowmap import bound_batches
from .labelled import drawn_share
from .store import Workspace

#: Rows of a sample, about; they are drawn by a hash of id and vector.
SAMPLE_ROWS = 12_000
#: Rows of a part, about, and parts of one model at most.
PART_ROWS = 128
MOST_PARTS = 128
#: Parts of more rows are divided again. With two levels, parts of up to this many
#: rows suffice for MOST_PARTS * MOST_PARTS * SPLIT_ROWS (134 million) rows; in larger
#: tables the parts themselves grow, and are searched in more blocks.
SPLIT_ROWS = 8_192
GRAPH_NEIGHBOURS = 10
HIDDEN = 96
#: Rows compared in one task at most: smaller blocks share the work better, larger ones bring fewer lists back.
BLOCK_ROWS = 4_096


@dataclass
class PartitionModel:
    layers: list[np.ndarray]
    probes: int

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every part."""
        if not self.layers:
            return np.zeros((len(x), 1), np.float32)
        a, b, c, d = self.layers
        return np.maximum(_unit(x) @ a + b, 0) @ c + d


@dataclass
class PartitionTree:
    """A part's number is that of the root's part times MOST_PARTS, and the child's part."""

    root: PartitionModel
    children: dict[int, PartitionModel] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)

    def home(self, x: np.ndarray) -> np.ndarray:
        part = self.root.parts(x).argmax(axis=1)
        own = np.zeros_like(part)
        for p in self.children.keys() & set(part.tolist()):
            at = np.flatnonzero(part == p)
            own[at] = self.children[p].parts(x[at]).argmax(axis=1)
        return (part * MOST_PARTS + own).astype(np.int32)

    def searched(self, x: np.ndarray, need: np.ndarray) -> list[list[int]]:
        """The parts each query goes to: the most probable, and then whole parts
        of the root until those chosen hold ``need`` rows, or all."""
        order = np.argsort(-self.root.parts(x), axis=1, kind="stable")
        chosen: list[list[int]] = [[] for _ in x]
        for p in np.unique(order[:, : self.root.probes]).tolist():
            at = np.flatnonzero((order[:, : self.root.probes] == p).any(axis=1))
            child = self.children.get(p)
            best = np.argsort(-child.parts(x[at]), axis=1, kind="stable")[:, : child.probes] if child else np.zeros((len(at), 1), np.int64)
            for i, own in zip(at.tolist(), best.tolist(), strict=True):
                chosen[i] += [p * MOST_PARTS + c for c in own]
        for i, parts in enumerate(chosen):
            held, later = sum(self.rows.get(p, 0) for p in parts), iter(order[i].tolist())
            while held < need[i] and (p := next(later, None)) is not None:
                more = sorted({q for q in range(p * MOST_PARTS, (p + 1) * MOST_PARTS) if q in self.rows} - set(parts))
                parts += more
                held += sum(self.rows[q] for q in more)
        return [[p for p in parts if p in self.rows] for parts in chosen]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    for s in range(0, len(x), 1024):
        near = x[s : s + 1024] @ x.T
        near[np.arange(len(near)), np.arange(s, s + len(near))] = -np.inf
        out[s : s + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def _balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 8) -> np.ndarray:
    part = np.zeros(len(x), np.int64)
    rng = np.random.default_rng(0)

    def halve(rows: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            part[rows] = first
            return
        centred = x[rows] - x[rows].mean(axis=0)
        direction = rng.standard_normal(x.shape[1]).astype(np.float32)
        for _ in range(12):
            direction = centred.T @ (centred @ direction)
            direction /= max(float(np.linalg.norm(direction)), 1e-30)
        order = rows[np.argsort(centred @ direction, kind="stable")]
        cut = len(order) * (n // 2) // n
        halve(order[:cut], first, n // 2)
        halve(order[cut:], first + n // 2, n - n // 2)

    halve(np.arange(len(x)), 0, parts)
    room = int(np.ceil(1.1 * len(x) / parts))
    for _ in range(sweeps):
        size, moved = np.bincount(part, minlength=parts), 0
        votes = np.zeros((len(x), parts), np.int16)
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1)
        want = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), want] - votes[np.arange(len(x)), part]
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[want[i]] < room:
                size[part[i]] -= 1
                size[want[i]] += 1
                part[i] = want[i]
                moved += 1
        if moved < len(x) // 200:
            break
    return part


def fit_partitions(sample: np.ndarray, rows: int, k: int, recall: float, seed: int = 0) -> PartitionModel:
    """``rows``: of the whole table. Parts hold about PART_ROWS of them."""
    parts = int(min(MOST_PARTS, rows // PART_ROWS, len(sample) // 64))
    if parts < 2:
        return PartitionModel([], 1)
    x = _unit(sample)
    graph = _graph(x, GRAPH_NEIGHBOURS)
    part = _balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts), np.float32)
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0 / (graph.shape[1] + 2))
    target[np.arange(len(x)), part] += 2.0 / (graph.shape[1] + 2)
    rng = np.random.default_rng(seed)
    layers = [rng.standard_normal((x.shape[1], HIDDEN)).astype(np.float32) * np.float32(np.sqrt(2)), np.zeros(HIDDEN, np.float32), rng.standard_normal((HIDDEN, parts)).astype(np.float32) * np.float32(np.sqrt(1 / HIDDEN)), np.zeros(parts, np.float32)]
    moment, square, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for epoch in range(30):
        order = rng.permutation(len(x))
        for s in range(0, len(order), 256):
            rows_ = order[s : s + 256]
            hidden = np.maximum(x[rows_] @ layers[0] + layers[1], 0)
            z = hidden @ layers[2] + layers[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - target[rows_]) / len(rows_)
            back = (g @ layers[2].T) * (hidden > 0)
            grads = [x[rows_].T @ back, back.sum(axis=0), hidden.T @ g, g.sum(axis=0)]
            step += 1
            for q, (w, d) in enumerate(zip(layers, grads, strict=True)):
                moment[q] += 0.1 * (d - moment[q])
                square[q] += 0.001 * (d * d - square[q])
                w -= 0.003 * (0.93**epoch) * (moment[q] / (1 - 0.9**step)) / (np.sqrt(square[q] / (1 - 0.999**step)) + 1e-8)
    model = PartitionModel(layers, parts)
    # How many parts hold the wanted share of the sample's nearest rows. The
    # k nearest in the whole table are as near as the first few of the sample,
    # so the sample's own k nearest are the harder case.
    order = np.argsort(-model.parts(sample), axis=1, kind="stable")
    home = order[:, 0]
    asked = rng.permutation(len(x))[:1500]
    near = sample[asked].astype(np.float64) @ sample.T.astype(np.float64)
    near[np.arange(len(asked)), asked] = -np.inf
    truth = np.argpartition(-near, k - 1, axis=1)[:, :k]
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :], axis=1)
    reached = np.take_along_axis(rank[asked], home[truth], axis=1).ravel()
    model.probes = int(min(parts, np.sort(reached)[min(len(reached) - 1, int(np.ceil(recall * len(reached))))] + 1))
    return model


def _rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length, without nulls, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return rows.where(F.forall("v", good) & F.exists("v", lambda x: x != 0))


def deal_parts(counts: dict[int, int]) -> list[tuple[int, int, int]]:
    """(part, first task, blocks): small parts share a task of BLOCK_ROWS rows at
    most, so a query brings one list back from several parts; a part of more
    rows is split into blocks, a task each."""
    out, task, room = [], 0, BLOCK_ROWS
    for part, n in sorted(counts.items()):
        if n > BLOCK_ROWS:
            blocks = -(-n // BLOCK_ROWS)
            task += room < BLOCK_ROWS
            out.append((part, task, blocks))
            task, room = task + blocks, BLOCK_ROWS
            continue
        if n > room:
            task, room = task + 1, BLOCK_ROWS
        out.append((part, task, 1))
        room -= n
    return out


def _children(indexed: DataFrame, rows: dict[int, int], k: int, recall: float, sample_rows: int, split_rows: int) -> dict[int, PartitionModel]:
    """A model for each part of more than ``split_rows`` rows, fitted in tasks; MOST_PARTS models of some 100 kB at most."""
    shares = [(p, min(1.0, sample_rows / n), n) for p, n in rows.items() if n > split_rows]
    wide = F.broadcast(indexed.sparkSession.createDataFrame(shares, "part int, share double, n long"))
    drawn = F.pmod(F.xxhash64("id", "v", F.lit("children")), F.lit(1 << 40)) < F.col("share") * float(1 << 40) + 1
    samples = indexed.join(wide, "part").where(drawn).select("part", "n", "id", "v").distinct()

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = _rows(table["v"])
        model = fit_partitions(x, table["n"][0].as_py(), min(k, max(1, len(x) - 1)), recall)
        return pa.table({"part": [table["part"][0].as_py()], "model": [pickle.dumps(model)]}, schema=pa.schema([("part", pa.int32()), ("model", pa.binary())]))

    fitted = samples.groupBy("part").applyInArrow(fit, "part int, model binary").collect()
    return {r.part // MOST_PARTS: pickle.loads(bytes(r.model)) for r in fitted}


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): the ``k`` nearest
    found of each query among the other rows, by largest inner product, ties to
    the smaller id.

    ``is_query``: condition on ``vectors``' columns. Vectors that are null,
    empty, zero or hold null or non-finite components, and rows of a null id,
    take no part, nor do those of another length than most have (the least such
    length). Rows that repeat an id are candidates each (an id may be found once
    for each of its vectors, and a query never finds rows of its own id); queries
    that repeat an id are one query, of the vector that sorts first. A query finds
    ``k`` rows, or all if there are fewer candidates. An empty table gives an empty
    one. Models are fitted on about ``sample_rows`` rows each; every row is indexed."""
    spark = vectors.sparkSession
    bound_batches(spark)
    work = Workspace(spark, "neighbours")
    flagged = vectors.withColumn("__query", F.coalesce(is_query, F.lit(False)))
    rows = _usable(flagged, id_col, vector_col)
    total, length = rows.agg(F.count("*"), F.mode(F.size("v"), True)).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == length)
    drawn = drawn_share(min(1.0, sample_rows / total), "neighbours", "id", "v")
    sample = _rows(rows.where(drawn).select("id", "v").distinct().orderBy("id", "v").select("v").toArrow()["v"])
    most = min(k, max(1, len(sample) - 1))
    tree = PartitionTree(fit_partitions(sample, total, most, recall))

    def indexed_by(tree: PartitionTree, name: str) -> DataFrame:
        model = spark.sparkContext.broadcast(tree)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.value.home(_rows(batch.column(1))))], names=["id", "v", "part"])

        table = work.materialize(rows.mapInArrow(run, "id long, v array<double>, part int"), name)
        tree.rows = {r.part: r["count"] for r in table.groupBy("part").count().collect()}  # at most MOST_PARTS squared
        return table

    indexed = indexed_by(tree, "index")
    if max(tree.rows.values()) > split_rows:
        tree.children = _children(indexed, tree.rows, most, recall, sample_rows, split_rows)
        indexed = indexed_by(tree, "index-2")
    dealt = F.broadcast(spark.createDataFrame(deal_parts(tree.rows), "part int, task int, blocks int"))
    repeated = work.materialize(indexed.groupBy("id").agg(F.count("*").alias("own")).where("own > 1"), "repeated")
    queries = _usable(flagged.where("__query"), id_col, vector_col).where(F.size("v") == length).groupBy("id").agg(F.min("v").alias("v"))
    queries = queries.join(repeated, "id", "left").select("id", "v", (F.coalesce("own", F.lit(1)) + k).alias("need"))
    model = spark.sparkContext.broadcast(tree)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                parts = model.value.searched(_rows(batch.column(1)), batch.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.list_(pa.int32()))], names=["id", "v", "parts"])

    asked = queries.mapInArrow(route, "id long, v array<double>, parts array<int>").select("id", "v", F.explode("parts").alias("part")).join(dealt, "part")
    asked = asked.select(F.explode(F.sequence(F.col("task"), F.col("task") + F.col("blocks") - 1)).alias("task"), F.lit(0).alias("kind"), "part", "id", "v")
    held = indexed.join(dealt, "part").select((F.col("task") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int").alias("task"), F.lit(1).alias("kind"), "part", "id", "v")
    both = asked.unionByName(held).repartition(F.col("task")).sortWithinPartitions("task", "kind", "part")

    def best_of(ids: np.ndarray, q: np.ndarray, keys: np.ndarray, x: np.ndarray):
        near = q @ x.T
        out = []
        for i, row in enumerate(near):
            row[keys == ids[i]] = -np.inf
            edge = np.partition(row, -k)[-k] if len(row) > k else -np.inf
            at = np.flatnonzero((row >= edge - 1e-9 * (1 + abs(edge)) if np.isfinite(edge) else True) & (row > -np.inf))
            exact = (x[at] * q[i]).sum(axis=1)
            order = np.lexsort((keys[at], -exact))[:k]
            out.append((ids[i], keys[at][order], exact[order]))
        return out

    def best_in_task(pool: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if pool:
            ids, keys, scores = (np.concatenate(c) for c in zip(*pool, strict=True))
            order = np.lexsort((keys, -scores, ids))
            ids = ids[order]
            first = np.maximum.accumulate(np.where(np.concatenate(([True], ids[1:] != ids[:-1])), np.arange(len(ids)), 0))
            kept = order[np.arange(len(ids)) - first < k]
            yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (np.concatenate([p[0] for p in pool]), keys, scores)], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by task, queries first, then by part."""
        task, held, pool = None, {}, []
        for batch in batches:
            if not len(batch):
                continue
            tasks, kinds, parts, ids = (batch.column(c).to_numpy() for c in range(4))
            v = _rows(batch.column(4))
            change = (tasks[1:] != tasks[:-1]) | (kinds[1:] != kinds[:-1]) | (parts[1:] != parts[:-1])
            cuts = np.concatenate(([0], np.flatnonzero(change) + 1, [len(tasks)]))
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if tasks[s] != task:
                    yield from best_in_task(pool)
                    task, held, pool = tasks[s], {}, []
                if kinds[s] == 0:
                    held.setdefault(parts[s], []).append((ids[s:e], v[s:e]))
                elif parts[s] in held:
                    qi, qv = (np.concatenate(c) for c in zip(*held[parts[s]], strict=True))
                    for c in range(0, len(qi), 1024):
                        found = best_of(qi[c : c + 1024], qv[c : c + 1024], ids[s:e], v[s:e])
                        pool.append((np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64), np.concatenate([f[1] for f in found]).astype(np.int64), np.concatenate([f[2] for f in found])))
        yield from best_in_task(pool)

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
