"""Conversation prefix trie: sorted paths, adjacent LCPs and range-minimum queries over sparse tables.

A conversation is the path of its turns, ordered by (turn, nulls first; role;
MD5 of the text); a null role or text is empty. Every distinct sequence of the
first d turns is a node, the textless root (d = 0) included.

1. Paths hold a 128-bit digest and the code points of each turn, no texts. They
   are sorted by (path, conv_id) over the whole table, so that copies of one
   conversation, however many, are dealt over partitions by their id. Each sorted
   partition is cut into blocks, one row a block.
2. ``L[j]`` is the number of turns that rows j - 1 and j share; the first row and
   the end have -1. Row j adds the nodes of depth ``L[j] + 1`` to its length: these
   are the candidate prefixes. Each one binary-searches its left and its right
   extent on its own in a sparse table of range minima of L: first in its block,
   then in the table of block minima (at most ``MOST_BLOCKS`` numbers and one a
   partition, broadcast). No stack, no order among the candidates.
3. A node is then an interval of rows; its numbers are differences of prefix sums
   over rows, its smallest member a range minimum. Only the nodes that are open at
   a block's edge, at most one for each depth, meet another block, in small joins.

Member ids for ``ends_sha256`` are joined within a block; where a run of copies
goes over block edges, the blocks' pieces are streamed in order through one
digest, piece by piece (SHA-256 cannot be split), never held together.

Defined cases: rows with a null ``conv_id`` belong to no conversation; repeated
rows are turns of their own; a conversation may have no turns left after
rebuilding and is then a member of the root alone; an empty table has no nodes;
long conversations and texts are read in whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: Conversations of a block, at least; a block is one row and one unit of work.
BLOCK = 4096
#: Blocks of the whole table, at most (besides one more a partition): what the driver and a broadcast hold.
MOST_BLOCKS = 65_536

PATH = "array<struct<key:binary,chars:int>>"
NODE = ("kind int, block int, depth int, conv_id long, pblock int, pdepth int, parent_conv_id long, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, tblock int, lo_sum long, factor long, "
        "piece int, ids binary")
NODE_NAMES = [c.split()[0] for c in NODE.split(", ")]
EMPTY = hashlib.sha256(b"").hexdigest()


def paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, path``: the digests and lengths of each conversation's turns, in order."""
    c = conversations.where("conv_id is not null")
    role, text = F.coalesce(c["role"], F.lit("")), F.coalesce(c["text"], F.lit(""))
    key = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(c["turn"].alias("turn"), role.alias("role"), F.md5(text).alias("tie"), key.alias("key"),
                    F.char_length(text).alias("chars"))
    got = c.select(c["conv_id"].alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("t"))
    return got.select("conv_id", F.transform("t", lambda t: F.struct(t["key"], t["chars"])).cast(PATH).alias("path"))


def rebuilt(own: DataFrame, group: int = 100, turns: int = 6) -> DataFrame:
    """Conversations that begin like the first of their group: crc32(conv_id) % ``turns`` turns are taken from it.

    The remainder is SQL's, so that the group of a negative id is counted towards 0.
    """
    first = own.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("path", 1, turns - 1).alias("start"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % turns).cast("int")
    got = own.select("conv_id", "path", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    got = got.join(first, "base", "left")
    start = F.coalesce(F.col("start"), F.array().cast(PATH))
    return got.select("conv_id", F.concat(F.slice(start, 1, F.col("h")), F.slice("path", F.col("h") + 1, F.size("path")))
                      .alias("path"))


def lcps(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Turns that each row shares with the one before; ``keys[at[j]:at[j + 1]]`` are those of row j; 0 for the first."""
    n = np.diff(at)
    both = np.minimum(n[1:], n[:-1])
    out = np.zeros(len(n), dtype=np.int64)
    if both.sum():
        k = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
        same = (keys[np.repeat(at[:-2], both) + k] == keys[np.repeat(at[1:-1], both) + k]).all(axis=1)
        some = np.flatnonzero(both)
        reach = np.minimum.reduceat(np.where(same, np.iinfo(np.int64).max, k), (np.cumsum(both) - both)[some])
        out[1 + some] = np.minimum(reach, both[some])
    return out


class RangeMin:
    """Sparse table: minima of all runs of 2**k values."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 * (1 << (len(self.rows) - 1)) <= len(values):
            half = 1 << (len(self.rows) - 1)
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of values lo to hi - 1; every range holds one at least."""
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), dtype=self.rows[0].dtype)
        for level in np.unique(k):
            w = np.flatnonzero(k == level)
            out[w] = np.minimum(self.rows[level][lo[w]], self.rows[level][hi[w] - (1 << level)])
        return out

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first position from ``at`` on whose value is below ``least``; the length if there is none."""
        at = at.copy()
        n = len(self.rows[0])
        for k in reversed(range(len(self.rows))):
            w = np.flatnonzero(at + (1 << k) <= n)
            w = w[self.rows[k][at[w]] >= least[w]]
            at[w] += 1 << k
        return at

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last position up to ``at`` whose value is below ``least``; -1 if there is none."""
        at = at.copy()
        for k in reversed(range(len(self.rows))):
            w = np.flatnonzero(at - (1 << k) >= -1)
            w = w[self.rows[k][at[w] - (1 << k) + 1] >= least[w]]
            at[w] -= 1 << k
        return at


def _digests(column: pa.Array) -> np.ndarray:
    """Fixed 16-byte values as rows of two integers."""
    n = len(column)
    at = np.frombuffer(column.buffers()[1], dtype=np.int32, count=n + 1, offset=4 * column.offset) if n else np.zeros(1, int)
    raw = column.buffers()[2] if n else None
    return np.frombuffer(raw, dtype=np.uint8)[at[0]:at[-1]].view(np.int64).reshape(n, 2) if n else np.empty((0, 2), np.int64)


def _sums(chars: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(chars.astype(np.int64))])[at]


BLOCKS = ("part int, seq int, convs array<long>, lens array<int>, lcp array<int>, chars array<int>, "
          "rows long, rest int, total long, added long, leaves long, low long, first binary, last binary")


def _cut(size: int):
    """Arrow function over a sorted partition: one row for each block of ``size`` paths."""
    def pack(part, seq, conv, at, chars, lcp, first, last):
        lens = np.diff(at)
        run = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
        new = run[at[1:]] - run[at[:-1] + np.maximum(lcp, 0)]
        values = [part, seq, conv, *(x.astype(np.int32) for x in (lens, lcp, chars)), len(conv), int(lcp[1:].min(initial=2**31 - 1)), int(run[-1]),
                  int(new[1:].sum()), int((lcp[1:] < lens[:-1]).sum()), int(conv.min()), first, last]
        types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()),
                 pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                 pa.binary(), pa.binary()]
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

    def run(batches):
        from pyspark import TaskContext

        part, seq, before, held = TaskContext.get().partitionId(), 0, None, None
        waiting: list = []

        def block(rows):
            nonlocal seq, before
            conv = np.concatenate([r[0] for r in rows])
            keys = np.concatenate([r[1] for r in rows])
            chars = np.concatenate([r[2] for r in rows])
            at = np.concatenate([[0], np.cumsum(np.concatenate([r[3] for r in rows]))]).astype(np.int64)
            lead = np.empty((0, 2), np.int64) if before is None else before
            lcp = lcps(np.concatenate([lead, keys]), np.concatenate([[0], at + len(lead)]))[1:]
            if before is None:
                lcp[0] = -1
            first = None if seq else keys[:at[1]].tobytes()
            before = keys[at[-2]:]
            seq += 1
            return seq - 1, conv, at, chars, lcp, first

        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column(1)
            turns = path.flatten()
            lens = np.asarray(path.value_lengths(), dtype=np.int64)
            lo = np.cumsum(lens) - lens
            conv, keys = np.asarray(batch.column(0)), _digests(turns.field(0))
            chars = np.asarray(turns.field(1), dtype=np.int64)
            done = 0
            while done < len(conv):
                take = min(len(conv) - done, size - sum(len(w[0]) for w in waiting))
                a, b = lo[done], lo[done + take - 1] + lens[done + take - 1]
                waiting.append((conv[done:done + take], keys[a:b], chars[a:b], lens[done:done + take]))
                done += take
                if sum(len(w[0]) for w in waiting) == size:
                    if held:
                        yield pack(part, *held, None)
                    held, waiting = block(waiting), []
        if waiting:
            if held:
                yield pack(part, *held, None)
            held = block(waiting)
        if held:
            yield pack(part, *held, before.tobytes())

    return run


class Outline:
    """What is known of all blocks: edges, minima and prefix sums; a few numbers a block."""

    def __init__(self, rows: list):
        b = len(rows)
        get = {k: np.array([r[k] for r in rows], dtype=np.int64) for k in
               ("part", "seq", "rows", "rest", "total", "added", "leaves", "low", "lcp0", "len0", "last_len", "new0")}
        self.ids = {(int(p), int(s)): i for i, (p, s) in enumerate(zip(get["part"], get["seq"]))}
        edge, new0 = get["lcp0"].copy(), get["new0"].copy()
        last = b""
        for i, r in enumerate(rows):
            if r["first"] is not None:
                if i:
                    both = bytes(last + r["first"])
                    two = np.ndarray((len(both) // 16, 2), np.int64, both)
                    edge[i] = lcps(two, np.array([0, len(last) // 16, len(two)]))[1]
                    new0[i] -= sum(r["chars0"][:edge[i]])
            if r["last"] is not None:
                last = r["last"]
        self.edge = np.concatenate([edge, [-1]])
        self.len0 = np.concatenate([get["len0"], [-1]])
        self.last_len = get["last_len"]
        self.minima = RangeMin(np.minimum(edge, get["rest"]))
        self.low = RangeMin(get["low"])
        leaves = get["leaves"] + (self.edge[1:] < get["last_len"])
        self.rows, self.total, self.added, self.leaves = (
            np.concatenate([[0], np.cumsum(x)]) for x in (get["rows"], get["total"], get["added"] + new0, leaves))

    def __len__(self) -> int:
        return len(self.rows) - 1


def _sha(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def extents(row: dict, b: int, o: Outline) -> dict:
    """All that one block says of nodes: columns of ``NODE`` as arrays."""
    conv, lens = np.array(row["convs"], np.int64), np.array(row["lens"], np.int64)
    lcp, chars = np.array(row["lcp"], np.int64), np.array(row["chars"], np.int64)
    m = len(conv)
    lcp[0] = o.edge[b]
    at = np.concatenate([[0], np.cumsum(lens)])
    run = np.concatenate([[0], np.cumsum(chars)])
    whole = run[at[1:]] - run[at[:-1]]
    new = run[at[1:]] - run[at[:-1] + np.maximum(lcp, 0)]
    after = np.concatenate([lcp[1:], [o.edge[b + 1]]])
    total, added, leaves = (np.concatenate([[0], np.cumsum(x)]) + base for x, base in
                            ((whole, o.total[b]), (new, o.added[b]), (after < lens, o.leaves[b])))
    table, low = RangeMin(lcp), RangeMin(conv)

    # candidate prefixes: row i, depth d
    fresh = lens - lcp
    i = np.repeat(np.arange(m), fresh)
    start = np.cumsum(fresh) - fresh
    d = np.arange(len(i)) - start[i] + lcp[i] + 1
    left = table.left(i, d)  # the row whose LCP is below d: there the prefix begins
    hi = table.right(left + 1, d)
    spans = (hi == m) & (o.edge[b + 1] >= d)
    before = run[at[left] + np.maximum(d - 1, 0)] - run[at[left]]

    # parents: the prefix of one turn less, searched in the same way
    up = table.left(i, d - 1)
    inside = up >= 0
    mother = np.where(inside, start[np.maximum(up, 0)] + (d - 1) - lcp[np.maximum(up, 0)] - 1, -1)
    mother = np.where(d > 0, mother, -1)
    far = (d > 0) & ~inside
    pblock = np.where(mother >= 0, np.where(spans[np.maximum(mother, 0)], b, -1), -1)
    pblock[far] = o.minima.left(np.full(int(far.sum()), b - 1), (d - 1)[far])
    children = np.bincount(mother[mother >= 0], minlength=len(i))

    smallest = low.of(left, hi) if len(i) else np.empty(0, np.int64)
    first_of = (total[left], added[left], leaves[left])
    t_hi, a_hi, l_hi, n_hi = total[hi], added[hi], leaves[hi], hi + o.rows[b]
    wait = np.full(len(i), -1)
    w = np.flatnonzero(spans)
    if len(w):  # the block that the prefix ends in, and the whole blocks on the way
        goal = o.minima.right(np.full(len(w), b + 1), d[w])
        some = goal > b + 1
        smallest[w[some]] = np.minimum(smallest[w[some]], o.low.of(np.full(int(some.sum()), b + 1), goal[some]))
        t_hi[w], a_hi[w], l_hi[w], n_hi[w] = o.total[goal], o.added[goal], o.leaves[goal], o.rows[goal]
        wait[w] = np.where(o.edge[goal] >= d[w], goal, -1)
    n = n_hi - (left + o.rows[b])
    # sum over the subtree of (members - 1) * code points; rows that a later block adds count ``factor`` off each
    saved = (t_hi - first_of[0]) - n * before - ((a_hi - first_of[1]) - new[left] + whole[left] - before)

    # members that end here: copies of the first row of the node
    ends = np.full(len(i), EMPTY, dtype=object)
    copy = np.concatenate([[(lcp[0] == lens[0]) and b > 0 and o.last_len[b - 1] == lens[0]],
                           (lcp[1:] == lens[1:]) & (lens[1:] == lens[:-1])])
    heads = np.flatnonzero(~copy)
    tails = np.append(heads[1:], m) if len(heads) else heads
    goes_on = o.edge[b + 1] == lens[-1] and o.len0[b + 1] == lens[-1]
    pieces = []
    for a, z in zip(heads.tolist(), tails.tolist()):
        if z == m and goes_on:
            ends[start[a] + fresh[a] - 1] = None
            pieces.append((b, lens[a], conv[a:z]))
        else:
            ends[start[a] + fresh[a] - 1] = _sha(conv[a:z])
    lead = int(heads[0]) if len(heads) else m
    if lead:
        pieces.append((int(o.minima.left(np.array([b - 1]), lens[:1])[0]), lens[0], conv[:lead]))

    none = np.full(len(i), None, dtype=object)
    out = {
        "kind": spans.astype(np.int64), "block": np.full(len(i), b), "depth": d, "conv_id": smallest,
        "pblock": pblock, "pdepth": d - 1,
        "parent_conv_id": np.where((mother >= 0) & (pblock < 0), smallest[np.maximum(mother, 0)], -1),
        "n_convs": n, "n_children": children, "n_leaves": l_hi - first_of[2], "saved_tokens": saved, "ends_sha256": ends,
        "tblock": wait, "lo_sum": np.zeros(len(i), np.int64), "factor": before, "piece": np.full(len(i), -1), "ids": none}
    frames = [out]

    def more(kind, k, **columns):
        base = {c: np.full(k, -1) for c in NODE_NAMES} | {"ends_sha256": np.full(k, None, dtype=object),
                                                         "ids": np.full(k, None, dtype=object)}
        frames.append(base | {"kind": np.full(k, kind)} | columns)

    # prefixes that come from earlier blocks and end in this one
    deep = np.arange(min(int(lcp.min()), int(lcp[0])) + 1, int(lcp[0]) + 1)
    if b and len(deep):
        end = table.right(np.zeros(len(deep), np.int64), deep)
        more(2, len(deep), block=np.full(len(deep), b), depth=deep, conv_id=low.of(np.zeros(len(deep), np.int64), end),
             n_convs=end, saved_tokens=total[end] - total[0] - (added[end] - added[0]), n_leaves=leaves[end] - leaves[0])
    # children of prefixes of earlier blocks
    if far.any():
        keys, counts = np.unique(np.stack([pblock[far], (d - 1)[far]]), axis=1, return_counts=True)
        more(4, len(counts), block=keys[0], depth=keys[1], n_children=counts)
    for owner, depth, ids in pieces:
        more(3, 1, block=np.array([owner]), depth=np.array([depth]), piece=np.array([b]),
             ids=np.array([",".join(map(str, ids.tolist())).encode()], dtype=object))
    return {c: np.concatenate([f[c] for f in frames]) for c in NODE_NAMES}


def _nodes(outline):
    def run(batches):
        o = outline.value
        types = {"ends_sha256": pa.string(), "ids": pa.binary(), **{c: pa.int32() for c in (
            "kind", "block", "depth", "pblock", "pdepth", "tblock", "piece")}}
        for batch in batches:
            for row in batch.to_pylist():
                got = extents(row, o.ids[row["part"], row["seq"]], o)
                for lo in range(0, len(got["kind"]), 100_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(got[c][lo:lo + 100_000], types.get(c, pa.int64())) for c in NODE_NAMES], NODE_NAMES)

    return run


def _stream(batches):
    """SHA-256 of each node's pieces, which come in order; keeps one digest and no piece."""
    key, digest, out = None, None, []
    for batch in batches:
        for block, depth, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (block, depth) != key:
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = (block, depth), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids)
    if key:
        out.append((*key, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()),
                                      pa.array([r[2] for r in out], pa.string())], ["block", "depth", "sha"])


def trie(table: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of ``table(conv_id, path)``: see the module's text.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``.
    """
    spark = table.sparkSession
    small_batches(spark)
    table = written(table.select(F.col("conv_id").cast("long").alias("conv_id"), "path"), "trie-paths")
    size = max(block, -(-table.count() // MOST_BLOCKS))
    blocks = written(table.orderBy("path", "conv_id").mapInArrow(_cut(size), BLOCKS), "trie-blocks")
    at0 = F.col("lens")[0]
    rows = blocks.select(
        "part", "seq", "rows", "rest", "total", "added", "leaves", "low", "first", "last", F.col("lcp")[0].alias("lcp0"),
        at0.alias("len0"), F.element_at("lens", -1).alias("last_len"),
        F.when(F.col("first").isNotNull(), F.slice("chars", 1, at0)).alias("chars0"),
        F.aggregate(F.slice("chars", F.greatest(F.col("lcp")[0], F.lit(0)) + 1,
                            at0 - F.greatest(F.col("lcp")[0], F.lit(0))), F.lit(0).cast("long"),
                    lambda s, x: s + x).alias("new0")).orderBy("part", "seq").collect()
    outline = spark.sparkContext.broadcast(Outline(rows))
    got = written(blocks.mapInArrow(_nodes(outline), NODE), "trie-nodes")

    key = ["block", "depth"]
    spans = got.where("kind = 1")
    stairs = got.where("kind = 2").select(F.col("block").alias("tblock"), "depth", F.col("conv_id").alias("c2"),
                                          F.col("n_convs").alias("n2"), F.col("saved_tokens").alias("s2"),
                                          F.col("n_leaves").alias("l2"))
    kids = got.where("kind = 4").groupBy(*key).agg(F.sum("n_children").alias("k2"))
    # one node's pieces in one stream: nothing but bytes to hash, some 4 KB of ids a row and up
    digests = (got.where("kind = 3").select(*key, "piece", "ids").repartition(*key)
               .sortWithinPartitions(*key, "piece").select(*key, "ids")
               .mapInArrow(_stream, "block int, depth int, sha string"))
    zero = F.lit(0).cast("long")
    spans = spans.join(stairs, ["tblock", "depth"], "left").join(kids, key, "left").join(digests, key, "left")
    n2 = F.coalesce("n2", zero)
    spans = written(spans.select(
        *key, F.least("conv_id", "c2").alias("conv_id"), "pblock", "pdepth", "parent_conv_id",
        (F.col("n_convs") + n2).alias("n_convs"), (F.col("n_children") + F.coalesce("k2", zero)).alias("n_children"),
        (F.col("n_leaves") + F.coalesce("l2", zero)).alias("n_leaves"),
        (F.col("saved_tokens") + F.coalesce("s2", zero) - n2 * F.col("factor")).alias("saved_tokens"),
        F.coalesce("ends_sha256", "sha").alias("ends_sha256")), "trie-spans")
    nodes = got.where("kind = 0").select(*spans.columns).unionByName(spans)
    # the few parents that each block needs from others, then each node its own
    wanted = nodes.where("pblock >= 0").select("block", "pblock", "pdepth").distinct()
    parents = wanted.join(spans.select(F.col("block").alias("pblock"), F.col("depth").alias("pdepth"),
                                       F.col("conv_id").alias("p2")), ["pblock", "pdepth"])
    nodes = nodes.join(parents, ["block", "pblock", "pdepth"], "left")
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"),
                        F.when(F.col("depth") > 0, F.coalesce("p2", "parent_conv_id")).alias("parent_conv_id"),
                        "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
