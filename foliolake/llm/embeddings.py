"""Embedding near-dedup by PCA-ordered tiled comparison.

Unit vectors are turned into the order of their principal components. A tree of
cuts at medians of a bounded sample, in the leading components, deals vectors to
leaves; a vector also visits every leaf that is near enough to hold a partner,
so no link is lost whatever the sample. Within a leaf, blocks of vectors are
compared tile by tile: products of the leading components first, the rest
bounded by the product of suffix norms, and only pairs that can still reach the
threshold go on to further components and to the exact cosine.

Vectors that all lie within half the threshold's angle of a common pivot link
with each other without being compared, so a large group of near copies costs
as much as its size. Equal vectors are compared once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays, graph
from .scratch import Scratch

#: Vectors whose cuts and pivots are fitted; all vectors are dealt out and compared.
SAMPLE = 20_000
LEAF, BLOCK, LEADING = 8192, 4096, 8
LEAVES = 4096
STEPS = (16, 32)
#: A pivot stands for at least this share of the sample.
DENSE = 0.005
TILE = 512


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that takes its largest component to 0.5 .. 1, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _moments(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                u = unit(matrix(batch.column("v")))
                sums += u.T @ u
        rows = list(arrays.blocks_of(sums, 1 << 15))
        if rows:
            yield arrays.record(rows)

    return run


class Plan:
    """Leaves (boxes of the leading components) and pivots (balls); both only by the sample."""

    def __init__(self, turn: np.ndarray, sample: np.ndarray, n: int, least: float):
        self.turn, self.least = turn, least
        self.angle = math.acos(min(1.0, least))
        self.reach = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
        y = unit(sample) @ turn
        self.pivots = self._dense(y)
        free = self.pivot_of(y) < 0
        self.cuts: list[tuple[int, float, int, int]] = []
        self.boxes: list[np.ndarray] = []
        wanted = min(LEAVES, max(1, -(-n // LEAF)))
        lead = y[free][:, :LEADING]
        box = np.array([[-np.inf, np.inf]] * min(LEADING, turn.shape[1]))
        self.root = self._grow(lead, box, math.ceil(math.log2(wanted)) if wanted > 1 else 0)

    def _dense(self, y: np.ndarray) -> np.ndarray:
        """Greedy pivots with at least DENSE of the sample in their ball."""
        found, left = [], np.ones(len(y), bool)
        cos = math.cos(self.angle / 2 - 1e-6) if self.angle > 2e-6 else 2.0
        for i in range(0, len(y), max(1, len(y) // 400)):
            if left[i]:
                near = left & (y @ y[i] >= cos)
                if near.sum() >= max(2, DENSE * len(y)):
                    centre = y[near].mean(axis=0)
                    centre /= np.linalg.norm(centre)
                    own = left & (y @ centre >= cos)
                    pivot, own = (centre, own) if own.sum() >= near.sum() else (y[i], near)
                    found.append(pivot)
                    left &= ~own
        return np.array(found).reshape(len(found), y.shape[1])

    def pivot_of(self, y: np.ndarray) -> np.ndarray:
        """The first pivot whose ball holds the vector, or -1."""
        out = np.full(len(y), -1)
        if len(self.pivots):
            inside = y @ self.pivots.T >= math.cos(self.angle / 2 - 1e-6)
            out = np.where(inside.any(axis=1), inside.argmax(axis=1), -1)
        return out

    def _grow(self, lead: np.ndarray, box: np.ndarray, depth: int) -> int:
        if depth == 0 or len(lead) < 4 or np.ptp(lead, axis=0).max() <= 0:
            self.boxes.append(box)
            return -len(self.boxes)
        axis = int(np.ptp(np.quantile(lead, [0.05, 0.95], axis=0), axis=0).argmax())
        at = float(np.median(lead[:, axis]))
        low = lead[:, axis] <= at
        node = len(self.cuts)
        self.cuts.append((axis, at, 0, 0))
        left, right = box.copy(), box.copy()
        left[axis, 1], right[axis, 0] = at, at
        self.cuts[node] = (axis, at, self._grow(lead[low], left, depth - 1), self._grow(lead[~low], right, depth - 1))
        return node

    def deal(self, y: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(leaf, vectors, whether it is their own). Visits go to leaves of a higher number than the own one only."""
        home = np.zeros(len(y), np.int64)
        pivot = self.pivot_of(y)
        todo = [(self.root, np.flatnonzero(pivot < 0))]
        while todo:
            node, own = todo.pop()
            if node < 0:
                home[own] = -node - 1
                yield -node - 1, own, True
            else:
                axis, at, left, right = self.cuts[node]
                low = y[own, axis] <= at
                todo += [(left, own[low]), (right, own[~low])]
        todo = [(self.root, np.flatnonzero(pivot < 0))]
        while todo:
            node, own = todo.pop()
            if node < 0:
                box, lead = self.boxes[-node - 1], y[own, :LEADING]
                off = np.maximum(np.maximum(box[:, 0] - lead, lead - box[:, 1]), 0)
                own = own[((off**2).sum(axis=1) <= self.reach**2) & (home[own] < -node - 1)]
                if len(own):
                    yield -node - 1, own, False
            else:
                axis, at, left, right = self.cuts[node]
                x = y[own, axis]
                todo += [(left, own[x <= at + self.reach]), (right, own[x >= at - self.reach])]
        n = len(self.boxes)
        home = np.where(pivot < 0, home, n + pivot)
        far = math.cos(min(math.pi, 1.5 * self.angle + 1e-6))
        for p, centre in enumerate(self.pivots):
            own = np.flatnonzero(pivot == p)
            if len(own):
                yield n + p, own, True
            own = np.flatnonzero((y @ centre >= far) & (home < n + p))
            if len(own):
                yield n + p, own, False


def _deal(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            for leaf, own, at_home in plan.deal(unit(matrix(batch.column("v"))) @ plan.turn):
                if len(own):
                    part = batch.take(pa.array(own))
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, leaf, np.int32)), pa.array(np.full(n, at_home)), part.column("rep"), part.column("w"), part.column("v")], names=["leaf", "own", "rep", "w", "v"])

    return run


class Side:
    """Vectors of one side of a tile, in component order, with the norms of what follows each step."""

    def __init__(self, x: np.ndarray, turn: np.ndarray):
        self.x = scaled(x)
        self.norm = np.linalg.norm(self.x, axis=1)
        self.y = (self.x / self.norm[:, None]) @ turn
        self.ends = [s for s in STEPS if s < self.y.shape[1]] + [self.y.shape[1]]
        self.lead = self.y[:, : self.ends[0]].astype(np.float32)
        self.rest = [np.sqrt(np.maximum(0, (self.y[:, e:] ** 2).sum(axis=1))) for e in self.ends]


def links_of(a: Side, b: Side, least: float, upper: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) of cosine >= least, tile by tile; upper: of one block with itself, each pair once."""
    for low in range(0, len(a.x), TILE):
        rows = slice(low, low + TILE)
        bound = a.lead[rows] @ b.lead.T
        bound += np.outer(a.rest[0][rows], b.rest[0]).astype(np.float32)
        i, j = np.nonzero(bound >= least - 1e-4)
        i += low
        if upper:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 1 << 18):
            yield _confirm(a, b, i[part : part + (1 << 18)], j[part : part + (1 << 18)], least)


def _confirm(a: Side, b: Side, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    done, sums = 0, np.zeros(len(i))
    for end, rest_a, rest_b in zip(a.ends, a.rest, b.rest):
        sums = sums + np.einsum("ij,ij->i", a.y[i, done:end], b.y[j, done:end])
        go = sums + rest_a[i] * rest_b[j] >= least - 1e-9
        i, j, sums, done = i[go], j[go], sums[go], end
    near = np.abs(sums - least) <= 1e-9
    if near.any():
        p, q = i[near], j[near]
        sums[near] = np.einsum("ij,ij->i", a.x[p], b.x[q]) / (a.norm[p] * b.norm[q])
    ok = sums >= least
    return i[ok], j[ok]


def _compare(shared):
    def run(table: pa.Table) -> pa.Table:
        plan = shared.value
        rep, w, first = (table.column(c).to_numpy() for c in ("rep", "w", "first"))
        x, same = matrix(table.column("v")), bool(table.column("same")[0].as_py())
        left, right = np.flatnonzero(first), np.flatnonzero(first if same else ~first)
        count, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        if len(left) and len(right):
            a = Side(x[left], plan.turn)
            b = a if same else Side(x[right], plan.turn)
            for i, j in links_of(a, b, plan.least, same):
                if len(i):
                    p, q = left[i], right[j]
                    count += np.bincount(p, w[q], len(rep)).astype(np.int64) + np.bincount(q, w[p], len(rep)).astype(np.int64)
                    moved = np.flatnonzero(label != np.arange(len(rep)))
                    label = graph.roots(len(rep), np.concatenate([moved, p]), np.concatenate([label[moved], q]))
        some = np.flatnonzero(count)
        return pa.table({"rep": pa.array(rep[some], pa.int64()), "n": pa.array(count[some], pa.int64()), "root": pa.array(rep[label[some]], pa.int64())})

    return run


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept.

    Vectors link if their cosine, in double precision, is at least `least` (over
    0); component_id is the smallest id reachable, kept is true for it. A vector
    that is null, empty, zero or holds a null or a value that isn't finite links
    with nothing, and so do vectors of different lengths. Very large and very
    small components keep their precision. Repeated rows are vectors of their
    own; rows with a null id are left out; other columns may have any names.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "embeddings")
    v = F.col("v")
    # A sum of squares that isn't finite is told by the values, not by it: 1e200 is a fine component.
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0) | (F.size(v) <= 0) | v.isNull()
    given = given.withColumn("ok", ~F.coalesce(odd, F.lit(True))).withColumns({"one": F.xxhash64("v"), "two": F.xxhash64(F.lit(7), "v"), "dim": F.size("v")})
    points = scratch.save(given.where("ok").groupBy("one", "two", "dim").agg(F.min("id").alias("rep"), F.count("*").alias("w"), F.first("v").alias("v")), "points")

    pieces, links = [], []
    for dim, n in sorted((r.dim, r.n) for r in points.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        own = points.where(F.col("dim") == dim)
        counted, edges = _of_dimension(own.select("rep", "w", "v"), dim, n, least, scratch)
        pieces.append(counted)
        links.append(edges)
    out = given.select("id", "ok", "one", "two", "dim")
    if not pieces:
        return out.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    counted, edges = pieces[0], links[0]
    for more, more_edges in zip(pieces[1:], links[1:]):
        counted, edges = counted.unionAll(more), edges.unionAll(more_edges)
    parts = graph.components(edges, scratch).select(F.col("node").alias("rep"), "component")
    known = points.select("one", "two", "dim", "rep", "w").join(counted.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left").join(parts, "rep", "left")
    known = known.select("one", "two", "dim", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"), F.lit(True).alias("ok"))
    out = out.join(known, ["one", "two", "dim", "ok"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))


def _of_dimension(points: DataFrame, dim: int, n: int, least: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rep, n) contributions to link counts, and links (u, v) with the same components."""
    spark = points.sparkSession
    moments = arrays.total(points.mapInArrow(_moments(dim), arrays.BLOCK_SCHEMA), dim * dim, 1 << 15, "float64").reshape(dim, dim)
    turn = np.linalg.eigh(moments)[1][:, ::-1].copy()
    share = min(1.0, SAMPLE / n)
    sample = points.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < int(share * 1_000_000)).select("v").limit(2 * SAMPLE).toArrow()
    x = matrix(sample.column("v")) if sample.num_rows else np.eye(1, dim)
    shared = spark.sparkContext.broadcast(Plan(turn, x, n, least))
    kind = points.schema["v"].dataType.simpleString()
    dealt = scratch.save(points.mapInArrow(_deal(shared), f"leaf int, own boolean, rep long, w long, v {kind}"), "dealt")

    n_boxes = len(shared.value.boxes)
    sizes: dict[int, list[int]] = {}
    for row in dealt.groupBy("leaf", "own").count().collect():
        sizes.setdefault(row.leaf, [0, 0])[0 if row.own else 1] = -(-row["count"] // BLOCK)
    plan = spark.createDataFrame([(k, h, g, k >= n_boxes) for k, (h, g) in sizes.items()], "leaf int, homes int, guests int, ball boolean")
    placed = dealt.join(F.broadcast(plan), "leaf")  # a row for each leaf, LEAVES and 1 / DENSE of them at most
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("own"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    unit_ = lambda a, b, guest, first: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(guest).alias("guest"), first.alias("first"))
    none = F.array().cast("array<struct<a:int,b:int,guest:boolean,first:boolean>>")
    range_ = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    m = F.col("mine")
    at_home = F.concat(
        F.when(F.col("ball"), none).otherwise(F.transform(range_(F.col("homes")), lambda j: unit_(F.least(m, j), F.greatest(m, j), False, m <= j))),
        F.transform(range_(F.col("guests")), lambda j: unit_(m, j, True, F.lit(True))),
    )
    visiting = F.transform(range_(F.col("homes")), lambda i: unit_(i, m, True, F.lit(False)))
    units = placed.withColumn("mine", mine).withColumn("u", F.explode(F.when(F.col("own"), at_home).otherwise(visiting)))
    units = units.select("leaf", "u.a", "u.b", "u.guest", "u.first", "rep", "w", "v", (~F.col("u.guest") & (F.col("u.a") == F.col("u.b"))).alias("same"))
    met = units.groupBy("leaf", "a", "b", "guest").applyInArrow(_compare(shared), "rep long, n long, root long")
    met = scratch.save(met, "met")
    balls = dealt.where((F.col("leaf") >= n_boxes) & F.col("own")).select("leaf", "rep", "w")
    each = balls.groupBy("leaf").agg(F.sum("w").alias("all"), F.min("rep").alias("root"))
    inside = balls.join(F.broadcast(each), "leaf")  # a row for each pivot
    counted = met.select("rep", "n").unionAll(inside.select("rep", (F.col("all") - F.col("w")).alias("n")))
    edges = met.select(F.col("rep").alias("u"), F.col("root").alias("v")).unionAll(inside.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    return counted, edges
