"""Substring dedup by a relative Lempel-Ziv parse against an indexed phrase reference.

The reference is the whole corpus, cut into phrases where its own content says
so: a window is ``WINDOW`` words, its anchor is the smallest hash among its
``SEED``-word runs (the leftmost one if equal), and a phrase is the stretch of
words under consecutive windows that share an anchor. Equal windows have equal
anchors, so a factor of ``WINDOW`` words or more in any document can only come
from reference phrases with the same anchor; the reference blocks are the hash
partitions of the anchors, and a document meets every block that can hold a
factor of it.

Every document is factored against the reference greedily, longest factor first.
A factor is (document, position, length, reference document, reference position):

1. A whole phrase that occurs elsewhere is a factor. Anchors that occur once, and
   phrases that occur several times, are settled here by counts alone; the
   reference is the first occurrence, for that one itself the last.
2. Other phrases whose anchor occurs elsewhere go to that anchor's reference block,
   once each. The block is indexed by the sorted suffixes of its phrases; from each
   parse position the longest match is the longer common prefix with the two
   neighbours in that order.
3. At factor boundaries the parse does not jump over the factor: it goes on with the
   first window that is not inside it, so that windows across a boundary are looked
   up as well, and overlapping factors join to one span.

A block of over ``MOST`` phrases is cut: twelve windows in a row share 24 words, six
share 30, three 33, and single windows are settled by counts. Each cut deals the
pieces by the words they share, so no task indexes more than ``MOST`` phrases of a
block. A factor ends where its piece ends; the next piece goes on.

Factors of at least ``WINDOW`` words are the duplicate spans. Hashes have 64 bits
and are compared in pairs (anchor and phrase, block and window); counting combines
before it shuffles, so that a passage in a third of all documents is one key with a
count.

Words are unchanged runs of non-blanks. Defined cases: null and empty texts have
no words (kept text empty); repeated rows are occurrences of each other; texts
shorter than a window keep everything; rows with a null id are kept apart from
others by their text; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import small_batches, written

WINDOW, SEED = 35, 12
#: Bytes of text that are parsed at once.
PART = 4 << 20
#: Phrases of a reference block that one task indexes at once; a larger block is cut by more of its words.
MOST = 4096
#: Windows that a phrase keeps at each cut (all of them contain the anchor, so a phrase has 24 at most).
STEPS = (12, 6, 3, 1)


def lowest(g: np.ndarray, span: int) -> np.ndarray:
    """Position of the leftmost smallest value among each ``span`` consecutive ones."""
    n = len(g) - span + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    best: dict[int, np.ndarray] = {1: np.arange(len(g), dtype=np.int32)}

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(g[a] <= g[b], a, b)

    size = 1
    while size * 2 <= span:
        p = best[size]
        best[size * 2] = join(p[:len(p) - size], p[size:])
        size *= 2
    out, done = best[size], size
    rest = span - size
    for s in sorted(best, reverse=True):
        while rest >= s:
            nxt = best[s][done:]
            m = min(len(out), len(nxt))
            out = join(out[:m], nxt[:m])
            done, rest = done + s, rest - s
    return out[:n].astype(np.int64)


def range_hashes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the words lo to hi - 1, for each pair."""
    if len(lo) == 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * wordhash._power(len(h), wordhash._BASE, "base"), out=total[1:])
    out = (total[hi] - total[lo]) * wordhash._power(len(h), wordhash._INVERSE, "inverse")[lo]
    return wordhash.mix(out + (hi - lo).astype(np.uint64))


def phrases(w: wordhash.Words) -> tuple[np.ndarray, ...]:
    """(row, anchor, phrase hash, first window, windows) of every phrase of a batch; positions count within the row."""
    n = np.diff(w.first)
    windows = np.maximum(n - WINDOW + 1, 0)
    row = np.repeat(np.arange(len(n)), windows)
    start = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + w.first[row]
    if not len(start):
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none, none
    g = wordhash.windows(w.hash, SEED)
    at = lowest(g, WINDOW - SEED + 1)[start]
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    size = np.diff(np.concatenate([new, [len(at)]]))
    lo = start[new]
    p = range_hashes(w.hash, lo, lo + size + WINDOW - 1)
    return row[new], g[at[new]].view(np.int64), p.view(np.int64), lo - w.first[row[new]], size


def joined(w: wordhash.Words, i: int, keep: np.ndarray | None = None) -> str:
    """SHA-256 of a row's words (those marked in ``keep``) joined by one space."""
    a, b = w.first[i], w.first[i + 1]
    start, end = w.start[a:b], w.end[a:b]
    if keep is not None:
        start, end = start[keep], end[keep]
    if not len(start):
        return hashlib.sha256(b"").hexdigest()
    lo = int(start[0])
    seg = w.data[lo:int(end[-1])].copy()
    mark = np.zeros(len(seg) + 1, dtype=np.int8)
    mark[start - lo] = 1
    mark[end - lo] -= 1
    inside = np.cumsum(mark[:-1]) > 0
    gaps = end[:-1] - lo  # the byte after each word but the last becomes the space
    seg[gaps] = 0x20
    inside[gaps] = True
    return hashlib.sha256(seg[inside].tobytes()).hexdigest()


def _row_hash(w: wordhash.Words) -> np.ndarray:
    return range_hashes(w.hash, w.first[:-1], w.first[1:]).view(np.int64) if len(w.hash) else np.zeros(len(w), np.int64)


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(at.astype(np.int32), values)


def parse(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, row_hash, n_words, sha`` and its phrases as lists."""
    small_batches(docs.sparkSession)
    slim = docs.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in wordhash.parts(batch, "text", PART):
                w = wordhash.words(part.column(1))
                row, anchor, phrase, lo, size = phrases(w)
                at = np.searchsorted(row, np.arange(len(w) + 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(_row_hash(w)), pa.array(np.diff(w.first)),
                     pa.array([joined(w, i) for i in range(len(w))]),
                     _lists(anchor, at), _lists(phrase, at), _lists(lo.astype(np.int32), at), _lists(size.astype(np.int32), at)],
                    names=["doc_id", "row_hash", "n_words", "sha", "anchor", "phrase", "lo", "size"])

    return slim.mapInArrow(run, f"doc_id {kind}, row_hash long, n_words long, sha string, anchor array<bigint>, "
                                "phrase array<bigint>, lo array<int>, size array<int>")


def _sources(texts: DataFrame) -> DataFrame:
    """The phrases listed in ``parts`` of each text with their words, as rows of the reference blocks.

    ``key`` (the block, the anchor at first), ``x`` (words before the anchor in the
    first window), ``size`` (windows), ``rid``, ``lo``, ``m``, ``words`` (hashes).
    """
    small_batches(texts.sparkSession)
    middle = np.arange(WINDOW - SEED + 1)

    def run(batches):
        for batch in batches:
            for part in wordhash.parts(batch, "text", PART):
                w = wordhash.words(part.column(1))
                ok = _row_hash(w) == np.asarray(part.column(2))
                lists = part.column(3)
                rows = np.repeat(np.arange(len(w)), lists.value_lengths().to_numpy())
                key, lo, size, m = (np.asarray(c) for c in lists.flatten().flatten())
                keep = ok[rows]
                rows, key, lo, size, m = rows[keep], key[keep], lo[keep].astype(np.int64), size[keep].astype(np.int64), m[keep]
                if not len(rows):
                    continue
                start = w.first[rows] + lo
                x = wordhash.windows(w.hash, SEED)[start[:, None] + middle].argmin(axis=1)
                words, at = _stretches(w.hash, start, size + WINDOW - 1)
                yield _source_batch(key, x, size, np.asarray(part.column(0))[rows], lo, m, words, at)

    return texts.select("rid", "text", "row_hash", "parts").mapInArrow(run, SOURCE)


SOURCE = "key long, x int, size int, rid long, lo int, m int, words array<bigint>"
FACTOR = "rid long, lo int, length int, ref_rid long, ref_lo int"


def _stretches(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` values from each ``start``, one stretch after the other, and where each begins."""
    at = np.concatenate([[0], np.cumsum(n)])
    return values[np.arange(at[-1]) + np.repeat(start - at[:-1], n)], at


def _source_batch(key, x, size, rid, lo, m, words, at) -> pa.RecordBatch:
    ints = [pa.array(c.astype(np.int32)) for c in (x, size, lo, m)]
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), ints[0], ints[1], pa.array(rid), ints[2], ints[3], _lists(words.view(np.int64), at)],
        names=["key", "x", "size", "rid", "lo", "m", "words"])


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(key, x, size, rid, lo, m, words of all rows, where each row's words begin) of rows of the reference blocks."""
    cols = [np.asarray(batch.column(i)).astype(np.int64) for i in range(6)]
    lists = batch.column(6)
    at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return *cols, np.asarray(lists.flatten()).view(np.uint64), at


def _cut(sources: DataFrame, step: int) -> DataFrame:
    """Rows of blocks that are too large, cut into at most ``step`` windows and dealt by all words that these share.

    ``step`` windows in a row have ``WINDOW - step + 1`` words in common; the
    positions are counted from the anchor, so equal windows are cut alike.
    """
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            key, x, size, rid, lo, m, words, at = _columns(batch)
            top, low = x // step, (x - size + 1) // step  # the pieces of a phrase, from its first window on
            n = top - low + 1
            row = np.repeat(np.arange(len(x)), n)
            piece = top[row] - (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
            first = np.minimum(x[row], piece * step + step - 1)
            last = np.maximum(x[row] - size[row] + 1, piece * step)
            # words that all windows of a piece share: from the start of its last window to the end of its first one
            whole, where = _stretches(words, at[row] + x[row] - piece * step, np.full(len(row), WINDOW - step + 1))
            hashed = range_hashes(whole, where[:-1], where[1:])
            block = wordhash.mix(hashed + wordhash.mix(key[row].view(np.uint64) + piece.astype(np.uint64)))
            skip = x[row] - first
            out, offsets = _stretches(words, at[row] + skip, first - last + WINDOW)
            yield _source_batch(block, first, first - last + 1, rid[row], lo[row] + skip, m[row], out, offsets)

    return sources.mapInArrow(run, SOURCE)


def longest(key: np.ndarray, size: np.ndarray, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(phrase, position, length, phrase of the reference, position in it): longest matches of ``WINDOW`` words or more.

    The index of a block is the sorted list of the suffixes of its phrases, taken
    at the windows' starts; the longest match of a suffix is its longer common
    prefix with the neighbour before or after it. Only starts with a match are returned.
    """
    row = np.repeat(np.arange(len(size)), size)
    j = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    start = at[row] + j
    win = wordhash.windows(words, WINDOW)[start]
    order = np.lexsort((win, key[row]))
    same = (win[order][1:] == win[order][:-1]) & (key[row][order][1:] == key[row][order][:-1])
    again = np.zeros(len(row), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    row, j, start, win = row[again], j[again], start[again], win[again]
    if not len(row):
        return (row,) * 5
    rest = size[row] - 1 - j  # words of the phrase after the window
    width = int(rest.max())
    ahead = start[:, None] + WINDOW + np.arange(width)
    tail = np.where(np.arange(width) < rest[:, None], words[np.minimum(ahead, len(words) - 1)], np.uint64(0))
    order = np.lexsort((rest, *tail.T[::-1], win, key[row]))
    row, j, rest, win, tail = row[order], j[order], rest[order], win[order], tail[order]
    same = (win[1:] == win[:-1]) & (key[row[1:]] == key[row[:-1]])
    common = np.minimum(rest[1:], rest[:-1])
    equal = np.concatenate([tail[1:] == tail[:-1], np.zeros((len(row) - 1, 1), dtype=bool)], axis=1)
    prefix = np.where(same, np.minimum(equal.argmin(axis=1), common) + WINDOW, 0)
    before, after = np.concatenate([[0], prefix]), np.concatenate([prefix, [0]])
    ref = np.arange(len(row)) + np.where(before >= after, -1, 1)
    return row, j, np.maximum(before, after), row[ref], j[ref]


def greedy(row: np.ndarray, j: np.ndarray, length: np.ndarray, phrases: int) -> np.ndarray:
    """Indexes of the matches that a parse from left to right takes.

    At each boundary the parse goes on with the next window that is not inside the
    factor before, so that windows across the boundary are looked up as well.
    """
    until = np.zeros(phrases, dtype=np.int64)
    order = np.argsort(j, kind="stable")
    edge = np.searchsorted(j[order], np.arange(int(j.max(initial=-1)) + 2))
    taken = []
    for a, b in zip(edge[:-1], edge[1:]):  # one step for each position in a phrase, 24 at most
        at = order[a:b]
        at = at[j[at] >= until[row[at]]]
        until[row[at]] = j[at] + length[at] - WINDOW + 1
        taken.append(at)
    return np.concatenate(taken) if taken else np.empty(0, dtype=np.int64)


def _parse_blocks(sources: DataFrame) -> DataFrame:
    """Factors of the phrases that occur once (``m`` = 1), each block indexed in one place."""
    small_batches(sources.sparkSession)

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, _, size, rid, lo, m, words, at = _columns(batch)
        row, j, length, ref, ref_j = longest(key, size, words, at)
        mine = m[row] == 1
        row, j, length, ref, ref_j = row[mine], j[mine], length[mine], ref[mine], ref_j[mine]
        t = greedy(row, j, length, len(key))
        row, ref = row[t], ref[t]
        cols = rid[row], (lo[row] + j[t]).astype(np.int32), length[t].astype(np.int32), rid[ref], (lo[ref] + ref_j[t]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["rid", "lo", "length", "ref_rid", "ref_lo"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < MOST:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = np.asarray(rows.column(0))
            whole = int(np.searchsorted(key, key[-1]))  # rows are sorted by block; the last one may go on
            if whole:
                yield found(rows.slice(0, whole))
            held = [rows.slice(whole)]
        if sum(b.num_rows for b in held):
            yield found(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return sources.repartition("key").sortWithinPartitions("key").mapInArrow(run, FACTOR)


def _other(own: list[str], first: list[str], last: list[str]) -> list:
    """Reference columns: the first occurrence, for the first one itself the last."""
    is_first = (F.col(own[0]) == F.col(first[0])) & (F.col(own[1]) == F.col(first[1]))
    return [F.when(is_first, F.col(b)).otherwise(F.col(a)).alias(n) for n, a, b in zip(("ref_rid", "ref_lo"), first, last)]


def _equal_windows(sources: DataFrame) -> DataFrame:
    """Factors of blocks of single windows: all rows of a block are equal, so counts settle them without collecting it."""
    # a block's windows are equal, so that any two rows of it serve as first and last
    sources = sources.withColumn("win", F.xxhash64("words"))
    ends = sources.groupBy("key", "win").agg(F.count("*").alias("n"), *[
        f(c).alias(f"{n}_{c}") for n, f in (("first", F.first), ("last", F.last)) for c in ("rid", "lo")]).where("n > 1")
    return sources.where("m = 1").join(ends, ["key", "win"]).select(
        "rid", "lo", F.lit(WINDOW).cast("int").alias("length"),
        *_other(["rid", "lo"], ["first_rid", "first_lo"], ["last_rid", "last_lo"]))


def block_factors(sources: DataFrame) -> DataFrame:
    """Factors of the phrases in their reference blocks; a block of over ``MOST`` phrases is cut by more of its words."""
    out = []
    for step in STEPS:
        sizes = sources.groupBy("key").agg(F.count("*").alias("block_rows"))
        hot = written(sizes.where(F.col("block_rows") > MOST).select("key"), "lz-hot")
        if hot.isEmpty():
            return reduce(DataFrame.union, [*out, _parse_blocks(sources)])
        out.append(_parse_blocks(sources.join(hot, "key", "left_anti")))
        sources = written(_cut(sources.join(hot, "key", "left_semi"), step), "lz-cut")
    return reduce(DataFrame.union, [*out, _equal_windows(sources)])


def _removed(texts: DataFrame) -> DataFrame:
    """Per text with ``spans`` (first word, words): ``doc_id, n_words, n_removed, kept_sha256``."""
    small_batches(texts.sparkSession)
    slim = texts.select("doc_id", "text", "row_hash", "spans")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in wordhash.parts(batch, "text", PART):
                w = wordhash.words(part.column(1))
                ok = _row_hash(w) == np.asarray(part.column(2))
                rows = np.flatnonzero(ok)
                n, gone, sha = [], [], []
                for i in rows:
                    total = int(w.first[i + 1] - w.first[i])
                    spans = part.column(3)[int(i)].values
                    lo, size = np.asarray(spans.field(0)), np.asarray(spans.field(1))
                    edge = np.zeros(total + 1, dtype=np.int64)
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, lo + size, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    n.append(total)
                    gone.append(total - int(keep.sum()))
                    sha.append(joined(w, int(i), keep))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return slim.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def _factors(parsed: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``FACTOR`` rows by ``rid``; texts of the documents concerned with their ``rid``)."""
    each = parsed.select("rid", F.explode(F.arrays_zip("anchor", "phrase", "lo", "size")).alias("f")).select("rid", "f.*")
    # any two occurrences serve as references; first and last of one aggregate differ where it has two rows
    shared = each.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("phrase").alias("p0"), F.max("phrase").alias("p1"), F.first("rid").alias("first_rid"),
        F.first("lo").alias("first_lo"), F.last("rid").alias("last_rid"), F.last("lo").alias("last_lo"))
    ends = ["first_rid", "first_lo", "last_rid", "last_lo"]
    # written, so that both sides of the join come from plain exchanges and Spark can split a hot anchor's rows
    shared = written(shared.where("n > 1").select("anchor", (F.col("p0") == F.col("p1")).alias("whole"), *ends), "lz-shared")
    met = written(each.join(shared, "anchor"), "lz-met")

    # one occurrence stands for all of a phrase; m says whether there are more
    mixed = met.where("not whole").groupBy("anchor", "phrase").agg(
        F.min(F.struct("rid", "lo", "size")).alias("o"), F.max(F.struct("rid", "lo")).alias("z"),
        F.least(F.count("*"), F.lit(2)).cast("int").alias("m"))
    mixed = written(mixed.select("anchor", "phrase", "o.*", F.col("z.rid").alias("last_rid"), F.col("z.lo").alias("last_lo"), "m"),
                    "lz-mixed")
    again = mixed.where("m > 1").select("anchor", "phrase", F.col("rid").alias("first_rid"), F.col("lo").alias("first_lo"),
                                        "last_rid", "last_lo")
    repeated = met.where("whole").select("rid", "lo", "size", *ends).union(
        met.where("not whole").drop(*ends).join(again, ["anchor", "phrase"]).select("rid", "lo", "size", *ends))
    repeated = repeated.select("rid", "lo", (F.col("size") + F.lit(WINDOW - 1)).alias("length"),
                               *_other(["rid", "lo"], ends[:2], ends[2:]))

    ids = parsed.select("rid", "doc_id", "row_hash").join(met.select("rid").distinct(), "rid", "left_semi")
    # copies of a row share phrases and factors; the first stands for them (a phrase's occurrence above is a first one too)
    ids = ids.groupBy("doc_id", "row_hash").agg(F.min("rid").alias("rid"))
    texts = docs.select(F.col("doc_id").alias("text_id"), "text")
    texts = texts.join(ids, texts["text_id"].eqNullSafe(ids["doc_id"])).drop("text_id")
    texts = written(texts, "lz-texts")

    parts = mixed.groupBy("rid").agg(F.collect_list(F.struct("anchor", "lo", "size", "m")).alias("parts"))
    sources = written(_sources(texts.join(parts, "rid")), "lz-sources")
    return repeated.union(block_factors(sources)), texts


def _parsed(docs: DataFrame) -> DataFrame:
    return written(parse(docs).withColumn("rid", F.monotonically_increasing_id()), "lz-parsed")


def factors(docs: DataFrame) -> DataFrame:
    """The parse: ``doc_id, start, length, ref_doc_id, ref_start``, in words; each stretch equals its reference.

    Several factors of a document may overlap. A row that repeats another with the
    same id is described once for the factors of stretches that occur in it alone.
    """
    parsed = _parsed(docs)
    found, _ = _factors(parsed, docs)
    ids = parsed.select("rid", "doc_id")
    refs = parsed.select(F.col("rid").alias("ref_rid"), F.col("doc_id").alias("ref_doc_id"))
    return found.join(ids, "rid").join(refs, "ref_rid").select(
        "doc_id", F.col("lo").alias("start"), "length", "ref_doc_id", F.col("ref_lo").alias("ref_start"))


def remove_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_words, n_removed, kept_sha256``."""
    parsed = _parsed(docs)
    found, texts = _factors(parsed, docs)
    spans = found.groupBy("rid").agg(F.collect_list(F.struct("lo", "length")).alias("spans"))
    spans = written(spans, "lz-spans")
    clean = parsed.join(spans, "rid", "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"),
                                                          F.col("sha").alias("kept_sha256"))
    return clean.union(_removed(texts.join(spans, "rid")))
