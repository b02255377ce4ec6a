"""Exact k nearest neighbours by blocks and bounds.

Rows are packed into blocks: a k-d partition (cut points from a bounded sample, the
largest part cut first, never between equal values) sends each row to a cell, and a cell's rows, dealt by a hash of the id if
they are many, make blocks of about ``BLOCK`` rows with a bounding box. Blocks that
follow each other make a region. Nothing is compared row by row in a join:

1. Every query is sent once, to the region of its own cell. The task there takes
   the blocks by the distance of their boxes and keeps the k nearest of each query
   so far, whose last distance bounds the blocks that still matter.
2. A query is sent once more to each further region that has a box within its bound;
   only candidates within the bound come back. The lists of both passes are merged
   to the k nearest, ties by id.

A region is met by its queries in groups of bounded size, so that no task holds more
than ``HELD`` bytes of either side. What is shuffled are the queries, once for each
region they need, the candidates, once for each group of queries, and the lists.

The boxes are broadcast: ``MOST_BLOCKS`` at most (larger tables get larger blocks).
In few dimensions most regions fall to the bound; in many dimensions nothing does,
regions are then as large as a task may hold, and the work is that of all pairs, in
matrix operations. A point that a third of all rows share is spread over many blocks
by the hash.

Distances are scaled per group of queries: ``sum(|q - c| / scale)^p``, so that the
folds of a search, each with the deviations of its own training part, are answered
in one pass; a query may be kept from the candidates of its own group.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: Rows of a block, if the table is small enough for ``MOST_BLOCKS`` of them.
BLOCK = 512
#: Boxes that are broadcast, at most: 2 x 80 numbers each make 5 MB.
MOST_BLOCKS = 4096
#: Rows the cut points are taken from.
SAMPLE = 20_000
#: Bytes of candidates, and of queries, that a task holds as numbers.
HELD = 64 << 20
#: Blocks of a region, at least.
REGION = 16
#: Queries that are compared together.
TILE = 256
#: Share of all regions that a query may need on average before regions are made as large as ``HELD`` allows.
MANY = 0.25

PACKED = "block int, ids array<long>, groups array<int>, data binary, lo array<double>, hi array<double>"
ASKED = "id long, grp int, v array<double>, cell int"
FOUND = "qid long, grp int, v array<double>, home int, bound double, near array<struct<dist:double,cid:long>>"


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), width)


def _spread(part: np.ndarray) -> np.ndarray:
    """Mean distance from the median, by axis; 0 where it is no number."""
    with np.errstate(invalid="ignore", over="ignore"):
        far = np.abs(part - np.median(part, axis=0)).mean(axis=0)
    return np.where(np.isfinite(far), far, 0.0)


def _cut(values: np.ndarray) -> float:
    """The value nearest to the middle that has others below it; equal values stay together."""
    values = np.sort(values)
    middle = len(values) // 2
    lo, hi = (int(np.searchsorted(values, values[middle], side)) for side in ("left", "right"))
    return float(values[hi] if hi < len(values) and (not lo or hi - middle < middle - lo) else values[lo])


class Cells:
    """A k-d partition: the part with the most rows of the sample is cut in two along its widest axis, between two values.

    Cells are numbered from left to right, so that neighbouring numbers are near each other.
    """

    def __init__(self, sample: np.ndarray, leaves: int):
        axis, cut, below = [-1], [0.0], [0]  # of each node: none for a cell; the child below the cut, the other follows it
        parts = [(-len(sample), 0, sample)]
        while parts and len(axis) < 2 * leaves - 1:
            _, at, part = heapq.heappop(parts)
            wide = _spread(part) if len(part) > 1 else np.zeros(1)
            if not wide.max() > 0:
                continue
            axis[at] = int(np.argmax(wide))
            cut[at], below[at] = _cut(part[:, axis[at]]), len(axis)
            high = part[:, axis[at]] >= cut[at]
            for child in (part[~high], part[high]):
                heapq.heappush(parts, (-len(child), len(axis), child))
                axis.append(-1)
                cut.append(0.0)
                below.append(0)
        self.axis, self.cut, self.below = np.array(axis), np.array(cut), np.array(below)
        self.cell, self.leaves, todo = np.zeros(len(axis), dtype=np.int64), 0, [0]
        while todo:
            at = todo.pop()
            if axis[at] >= 0:
                todo += [below[at] + 1, below[at]]
            else:
                self.cell[at] = self.leaves
                self.leaves += 1

    def scaled(self, by: np.ndarray) -> Cells:
        """For rows whose axes are ``by`` times the sample's."""
        self.cut = self.cut * by[self.axis]
        return self

    def of(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), dtype=np.int64)
        go = np.flatnonzero(self.axis[at] >= 0)
        while len(go):
            node = at[go]
            at[go] = self.below[node] + (rows[go, self.axis[node]] >= self.cut[node])
            go = go[self.axis[at[go]] >= 0]
        return self.cell[at]


def _placed(rows: DataFrame, cells, width: int) -> DataFrame:
    """``rows(id, grp, v)`` and their cells."""
    def place(batches):
        for b in batches:
            cell = cells.value.of(_matrix(b.column(2), width)) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], ["id", "grp", "v", "cell"])

    return rows.mapInArrow(place, ASKED)


def _packed(rows: DataFrame, cells, width: int, size: int, name: str) -> tuple[DataFrame, dict]:
    """``rows(id, grp, v)`` as blocks, written; and the first block and number of blocks of every cell in use."""
    placed = _placed(rows, cells, width).persist(StorageLevel.MEMORY_AND_DISK)
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # at most MOST_BLOCKS rows
    firsts, at = {}, 0
    for cell in sorted(counts):
        firsts[cell] = (at, -(-counts[cell] // size))
        at += firsts[cell][1]

    def number(batches):
        for b in batches:
            cell = np.asarray(b.column(3))
            h = np.asarray(b.column(0), dtype=np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            first = np.array([firsts[c][0] for c in cell.tolist()], dtype=np.int64)
            many = np.array([firsts[c][1] for c in cell.tolist()], dtype=np.int64)
            block = first + h.astype(np.int64) % np.maximum(many, 1)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *b.columns[:3]], ["block", "id", "grp", "v"])

    def pack(batches):
        now, held = None, []

        def out():
            ids, grp, data = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([grp], pa.list_(pa.int32())),
                 pa.array([data.tobytes()], pa.binary()), pa.array([data.min(axis=0)], pa.list_(pa.float64())),
                 pa.array([data.max(axis=0)], pa.list_(pa.float64()))], [c.split()[0] for c in PACKED.split(", ")])

        for b in batches:
            block, data = np.asarray(b.column(0)), _matrix(b.column(3), width)
            ids, grp = np.asarray(b.column(1)), np.asarray(b.column(2))
            edges = np.flatnonzero(np.diff(block)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(block)]):
                if lo == hi:
                    continue
                if held and block[lo] != now:
                    yield out()
                    held = []
                now = int(block[lo])
                held.append((ids[lo:hi], grp[lo:hi], data[lo:hi]))
        if held:
            yield out()

    dealt = placed.mapInArrow(number, "block int, id long, grp int, v array<double>").repartition("block")
    blocks = _written(dealt.sortWithinPartitions("block").mapInArrow(pack, PACKED), name)
    placed.unpersist()
    return blocks, firsts


def distances(q: np.ndarray, c: np.ndarray, p: int) -> np.ndarray:
    """All distances between two scaled blocks; for p = 2 their squares, up to rounding, from one product."""
    if p == 2:
        d = (q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :]
        d -= 2 * (q @ c.T)
        return d
    d, gap = np.zeros((len(q), len(c))), np.empty((len(q), len(c)))
    columns = np.ascontiguousarray(c.T)
    for j in range(q.shape[1]):
        np.subtract(q[:, j, None], columns[j], out=gap)
        np.abs(gap, out=gap)
        d += gap
    return d


def _by(keys: np.ndarray) -> np.ndarray:
    """A stable order by small whole numbers; by their 16 bits where they have no more."""
    return np.argsort(keys.astype(np.uint16) if keys.max(initial=0) < 1 << 16 else keys, kind="stable")


def _order(row: np.ndarray, dist: np.ndarray, cid: np.ndarray) -> np.ndarray:
    """The order by row, distance and id: a quick sort by distance, ties by id, then the rows, which are few."""
    order = np.argsort(dist)
    x = dist[order]
    if len(x) and np.isnan(x[-1]):
        return np.lexsort((cid, dist, row))
    same = x[1:] == x[:-1]
    if same.any():
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        by = np.argsort(cid[order[tied]])
        group = np.cumsum(np.append(False, x[tied][1:] != x[tied][:-1]))
        order[tied] = order[tied][by[_by(group[by])]]
    return order[_by(row[order])]


def block_nearest(q: np.ndarray, c: np.ndarray, cid: np.ndarray, k: int, p: int, bound: np.ndarray):
    """(query, exact distance, id) of the up to ``k`` nearest candidates of each query, by distance and id.

    What is farther than a query's ``bound`` is left out. Sums of the product form are off by rounding: all that
    might be among the nearest is kept and computed from the differences.
    """
    out = []
    step = 256 if p == 2 else 64
    reach = ((c * c) if p == 2 else np.abs(c)).sum(axis=1).max(initial=0)
    for lo in range(0, len(q), step):
        part = q[lo:lo + step]
        d = distances(part, c, p)
        slack = 2e-10 * (((part * part) if p == 2 else np.abs(part)).sum(axis=1).max(initial=0) + reach + 1)
        limit = bound[lo:lo + step] ** p * (1 + 1e-9) + slack
        within = d <= limit[:, None]
        over = np.flatnonzero(np.count_nonzero(within, axis=1) > k)
        if len(over):
            kth = np.partition(d[over], k - 1, axis=1)[:, k - 1]
            limit[over] = np.minimum(kth * (1 + 1e-9) + slack, limit[over])
            within[over] &= d[over] <= limit[over, None]
        row, col = np.nonzero(within)
        gap = np.abs(part[row] - c[col])
        exact = np.sqrt((gap * gap).sum(axis=1)) if p == 2 else gap.sum(axis=1)
        order = _order(row, exact, cid[col])
        row, col, exact = row[order], col[order], exact[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((row[keep] + lo, exact[keep], cid[col[keep]]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, int), np.empty(0), np.empty(0, int))


def _first_of(row: np.ndarray, dist: np.ndarray, cid: np.ndarray, k: int):
    """Of each row, the first ``k`` by distance and id."""
    order = _order(row, dist, cid)
    row, dist, cid = row[order], dist[order], cid[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], dist[keep], cid[keep]


def _gaps(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, p: int) -> np.ndarray:
    """Distances of all rows of ``q`` to all boxes."""
    far = np.zeros((len(q), len(lo)))
    for x, low, high in zip(q.T, lo.T, hi.T):
        gap = np.fmax(low[None, :] - x[:, None], x[:, None] - high[None, :])
        np.fmax(gap, 0, out=gap)  # a box of numbers that are none excludes nothing
        far += gap * gap if p == 2 else gap
    return np.sqrt(far) if p == 2 else far


def _reach(bound: np.ndarray) -> np.ndarray:
    return bound * (1 + 1e-9) + 1e-12


def tile_nearest(q: np.ndarray, blocks: list, lo: np.ndarray, hi: np.ndarray, k: int, p: int, bound: np.ndarray,
                 known: np.ndarray):
    """(query, distance, id) of the up to ``k`` nearest of each query among ``blocks``, sorted; nothing beyond its ``bound``.

    ``blocks`` holds (rows, ids), ``lo`` and ``hi`` their boxes; ``known`` marks (query, block) that are left out. The
    nearest boxes come first, so that the bound is soon narrow; what is found is merged whenever there is enough of it.
    """
    far = _gaps(q, lo, hi, p)
    bound = bound.copy()
    best = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
    fresh, waiting = [], 0

    def merge():
        nonlocal best, fresh, waiting
        best = _first_of(*(np.concatenate(x) for x in zip(best, *fresh)), k)
        fresh, waiting = [], 0
        ends = np.searchsorted(best[0], np.arange(len(q) + 1))
        full = np.flatnonzero(np.diff(ends) == k)
        bound[full] = np.minimum(bound[full], best[1][ends[full + 1] - 1])

    for j in np.argsort(far.min(axis=0), kind="stable").tolist():
        need = np.flatnonzero((far[:, j] <= _reach(bound)) & ~known[:, j])
        if not len(need) or not len(blocks[j][0]):
            continue
        row, dist, cid = block_nearest(q[need], *blocks[j], k, p, bound[need])
        if len(row):
            first = not len(best[0]) and not fresh
            fresh.append((need[row], dist, cid))
            waiting += len(row)
            if first or 2 * waiting >= len(q) * k:
                merge()
    if fresh:
        merge()
    return best


def _found(asks: pa.Table, region: int, row: np.ndarray, dist: np.ndarray, cid: np.ndarray, k: int) -> pa.Table:
    """One row of ``FOUND`` for each of ``asks``; ``row`` comes sorted."""
    first = np.searchsorted(row, np.arange(asks.num_rows + 1))
    full = np.diff(first) == k
    bound = np.full(asks.num_rows, np.inf)
    bound[full] = dist[first[1:][full] - 1]
    near = pa.StructArray.from_arrays([pa.array(dist, pa.float64()), pa.array(cid, pa.int64())], ["dist", "cid"])
    return pa.table([asks.column("id"), asks.column("grp"), asks.column("v"),
                     pa.array(np.full(asks.num_rows, region), pa.int32()), pa.array(bound, pa.float64()),
                     pa.ListArray.from_arrays(pa.array(first, pa.int32()), near)], [c.split()[0] for c in FOUND.split(", ")])


def _answered(asks: DataFrame, blocks: DataFrame, per_region: int, fine: int, counts: dict[int, int], width: int, k: int, p: int,
              scales: dict[int, np.ndarray], apart: bool, tasks: int) -> DataFrame:
    """``FOUND`` of ``asks``: each against the blocks of its region of ``per_region`` blocks.

    ``counts`` holds the number of asks of each region: many of them meet the region in several groups. The blocks of
    an ask's home, in regions of ``fine`` blocks, are left out.
    """
    spark = asks.sparkSession
    most = max(TILE, HELD // (8 * width))
    group = min(most, max(4 * TILE, -(-sum(counts.values()) // tasks)))
    parts, at = [], 0
    for region, n in sorted(counts.items()):
        many = -(-n // group)
        parts.append((region, at, many))
        at += many
    first = F.broadcast(spark.createDataFrame(parts, "region int, first int, many int"))
    width_of = max(1, min(2 * at, 4096))
    one = np.ones(width)
    left = asks.join(first, "region").withColumn("part", F.expr("first + cast(pmod(xxhash64(id, v), many) as int)")).select(
        "part", "region", "id", "grp", "v", "cell", "home", "bound").repartition(width_of, "part")
    right = blocks.withColumn("region", F.expr(f"block div {per_region}").cast("int")).join(first, "region").withColumn(
        "part", F.explode(F.expr("sequence(first, first + many - 1)"))).select(
        "part", "block", "ids", "groups", "data", "lo", "hi").repartition(width_of, "part")

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        asked = asked.sort_by("cell").combine_chunks()
        q = _matrix(asked.column("v").combine_chunks(), width) if asked.num_rows else np.empty((0, width))
        grp, home, bound = (asked.column(c).to_numpy() for c in ("grp", "home", "bound"))
        fine_region = held.column("block").to_numpy() // fine
        region = asked.column("region")[0].as_py() if asked.num_rows else 0
        rows = [(np.frombuffer(data.as_py(), dtype=np.float64).reshape(-1, width), ids.values.to_numpy(), groups.values.to_numpy())
                for data, ids, groups in zip(held.column("data"), held.column("ids"), held.column("groups"))]
        lo, hi = (np.array(held.column(c).to_pylist(), dtype=np.float64).reshape(-1, width) for c in ("lo", "hi"))
        found = []
        for g in np.unique(grp) if rows else ():
            s = scales.get(int(g), one)
            own = [(c[cgrp != g] / s, cid[cgrp != g]) if apart else (c / s, cid) for c, cid, cgrp in rows]
            mine = np.flatnonzero(grp == g)
            for at in range(0, len(mine), TILE):
                tile = mine[at:at + TILE]
                row, dist, cid = tile_nearest(q[tile] / s, own, lo / s, hi / s, k, p, bound[tile],
                                              fine_region[None, :] == home[tile][:, None])
                found.append((tile[row], dist, cid))
        row, dist, cid = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        order = np.argsort(row, kind="stable")
        return _found(asked, region, row[order], dist[order], cid[order], k)

    return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(search, FOUND)


def nearest_rows(queries: DataFrame, candidates: DataFrame, width: int, k: int, p: int = 2,
                 scales: dict[int, list[float]] | None = None, apart: bool = False) -> DataFrame:
    """``qid, near``: the up to ``k`` nearest candidates of each query, as (dist, cid) in order.

    Both tables are ``(id long, grp int, v array<double>)`` without nulls. ``scales`` divides the axes by the
    group of the query; ``apart`` keeps queries from the candidates of their own group. A query without any
    candidate gets an empty list; an empty query table no rows.
    """
    spark = queries.sparkSession
    scales = {g: np.asarray(s, dtype=np.float64) for g, s in (scales or {}).items()}
    one = np.ones(width)
    n = candidates.count()
    size = max(BLOCK, -(-n // MOST_BLOCKS))
    sample = candidates.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    base = np.mean(list(scales.values()), axis=0) if scales else one
    rows = np.array([r["v"] for r in sample], dtype=np.float64).reshape(len(sample), width)
    tree = Cells(rows / base, min(MOST_BLOCKS, max(1, -(-n // size)))).scaled(base)
    cells = spark.sparkContext.broadcast(tree)
    blocks, homes = _packed(candidates, cells, width, size, "knn-candidates")
    boxes = blocks.select("block", "lo", "hi").orderBy("block").collect()  # at most MOST_BLOCKS and one a cell
    box = spark.sparkContext.broadcast((np.array([b["block"] for b in boxes], dtype=np.int64), np.array([b["lo"] for b in boxes]).reshape(-1, width),
                                        np.array([b["hi"] for b in boxes]).reshape(-1, width)))

    # regions: as many as keep all tasks busy, unless their blocks would be few or their rows too many to hold
    tasks = 4 * spark.sparkContext.defaultParallelism
    total = max(1, len(boxes))
    largest = max(1, HELD // (8 * width * max(1, -(-n // total))))
    per_region = min(largest, max(REGION, -(-total // tasks)))
    start = np.zeros(tree.leaves, dtype=np.int64)  # first block of each cell, of the last one in use before it if it is empty
    for cell in range(tree.leaves):
        start[cell] = homes[cell][0] if cell in homes else start[max(cell - 1, 0)]
    start = spark.sparkContext.broadcast(start)

    def at_home(batches):
        for b in batches:
            region = start.value[np.asarray(b.column(3))] // per_region
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(b.num_rows, -1), pa.int32()), pa.array(region, pa.int32()), pa.array(np.full(b.num_rows, np.inf))],
                ["id", "grp", "v", "cell", "home", "region", "bound"])

    schema = f"{ASKED}, home int, region int, bound double"
    asks = _written(_placed(queries, cells, width).mapInArrow(at_home, schema), "knn-asks")
    first = _written(_answered(asks, blocks, per_region, per_region, _counts(asks), width, k, p, scales, apart, tasks), "knn-first")

    def needed(q, grp, bound, home, coarse: int):
        """For each query the regions of ``coarse`` blocks that have a box within its bound outside its home."""
        where, lo, hi = box.value
        need = np.zeros((len(q), int(where[-1]) // coarse + 1 if len(where) else 0), dtype=bool)
        if not len(where):
            return need
        first = np.flatnonzero(np.append(True, np.diff(where // per_region) > 0))  # boxes around the boxes of each home region
        ends, low, high = np.append(first[1:], len(where)), np.fmin.reduceat(lo, first), np.fmax.reduceat(hi, first)
        for g in np.unique(grp):
            s, mine = scales.get(int(g), one), np.flatnonzero(grp == g)
            for at in range(0, len(mine), 4 * TILE):
                tile = mine[at:at + 4 * TILE]
                x, reach = q[tile] / s, _reach(bound[tile])
                close = _gaps(x, low / s, high / s, p) <= reach[:, None]
                close &= (where[first] // per_region)[None, :] != home[tile][:, None]
                for j in np.flatnonzero(close.any(axis=0)).tolist():
                    some, own = np.flatnonzero(close[:, j]), slice(first[j], ends[j])
                    i, k_ = np.nonzero(_gaps(x[some], lo[own] / s, hi[own] / s, p) <= reach[some, None])
                    need[tile[some[i]], where[own][k_] // coarse] = True
        return need

    def rows_of(b):
        return (_matrix(b.column("v"), width), *(b.column(c).to_numpy() for c in ("grp", "bound", "home")))

    trial = first.limit(4 * TILE).drop("near").toArrow().combine_chunks()
    coarse = per_region
    if trial.num_rows and len(boxes):
        q, grp, bound, home = rows_of(pa.RecordBatch.from_arrays([c.combine_chunks() for c in trial.columns], trial.column_names))
        share = needed(q, grp, bound, home, per_region).mean()
        if share > MANY and largest > per_region:
            coarse = per_region * (largest // per_region)  # whole regions, as many as a task may hold

    def further(batches):
        """Each query once for every other region it needs."""
        for b in batches:
            if not b.num_rows:
                continue
            i, region = np.nonzero(needed(*rows_of(b), coarse))
            take = pa.array(i)
            yield pa.RecordBatch.from_arrays(
                [b.column("qid").take(take), b.column("grp").take(take), b.column("v").take(take),
                 b.column("home").take(take), b.column("home").take(take), pa.array(region, pa.int32()), b.column("bound").take(take)],
                ["id", "grp", "v", "cell", "home", "region", "bound"])

    more = _written(first.drop("near").mapInArrow(further, schema), "knn-asks")
    counts = _counts(more)
    lists = first.select("qid", "near")
    if counts:
        second = _answered(more, blocks, coarse, per_region, counts, width, k, p, scales, apart, tasks)
        lists = lists.unionByName(second.where("size(near) > 0").select("qid", "near"))
    lists = lists.groupBy("qid").agg(F.flatten(F.collect_list("near")).alias("near"))
    return lists.select("qid", F.slice(F.array_sort("near"), 1, k).alias("near"))


def _counts(asks: DataFrame) -> dict[int, int]:
    return {r["region"]: r["count"] for r in asks.groupBy("region").count().collect()}  # at most one row a block
