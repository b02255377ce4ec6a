"""Benchmark decontamination by spaced-seed hashing.

Each mask selects some positions of a short run of words and ignores the
others. The masked runs of the benchmark items are hashed into an index, the
masked runs of every document are joined with it, and each hit is verified: the
document's words and the item's words are compared along the hit's diagonal. A
document leaks an item if some ``WINDOW`` consecutive words of the item agree
with the document in all but ``TOLERANCE`` places; any such window holds a hit
of the masks (a test enumerates the cases). Items shorter than the window must
agree in whole; items under ``MIN_WORDS`` words are never matched.

The index of one block of items is broadcast: a block holds at most
``BLOCK_WORDS`` words, and a larger benchmark is searched block by block over
all documents. Documents are not shuffled.

Words are lower-cased (A-Z) runs of non-blanks. Defined cases: null and empty
texts leak nothing; equal items are all reported; repeated documents are
reported by id once; either table may be empty; rows with a null id are
searched like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import small_batches, word_count, written

MASKS = ("11111", "111101", "101111")
WINDOW, TOLERANCE, MIN_WORDS = 13, 2, 5
BLOCK_WORDS = 500_000
#: Bits of the table that sorts out most seeds before the exact look-up.
SIEVE = 20
#: Pairs of places, or words, that are compared at a time.
HITS = 1_000_000


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the selected words at each position; entry i begins at word i."""
    if len(h) < len(mask):
        return np.empty(0, dtype=np.uint64)
    n = len(h) - len(mask) + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in (i for i, c in enumerate(mask) if c == "1"):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k:k + n]
    return wordhash.mix(out ^ np.uint64(int(mask, 2)))


class Index:
    """Seeds of one block of benchmark items."""

    def __init__(self, items: list[tuple[object, str]]):
        w = wordhash.words(pa.array([t for _, t in items], type=pa.large_string()), lower=True)
        self.ids = [i for i, _ in items]
        self.words, self.first = w.hash, w.first
        self.tables = []
        row = np.repeat(np.arange(len(items)), np.diff(w.first))
        for mask in MASKS:
            s = seeds(w.hash, mask)
            at = np.flatnonzero(row[:len(s)] == row[len(mask) - 1:len(mask) - 1 + len(s)])
            at = at[np.argsort(s[at], kind="stable")]
            sieve = np.zeros(1 << SIEVE, dtype=bool)
            sieve[(s[at] >> np.uint64(64 - SIEVE)).astype(np.int64)] = True
            # places whose seed is not that of the place before: enough for a document's place of that kind
            head = at[~((at > 0) & (s[at] == s[at - 1]) & (row[at] == row[at - 1]))]
            self.tables.append((mask, s[at], at, s[head], head, sieve))
        self.row = row

    def leaks(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document row, item, first word, words covered, words that agree) of each leaked item's best diagonal."""
        found = []
        for mask, keys, at, head_keys, heads, sieve in self.tables:
            s = seeds(h, mask)
            pos = np.flatnonzero(sieve[(s >> np.uint64(64 - SIEVE)).astype(np.int64)])
            if not len(pos) or not len(keys):
                continue
            doc = np.searchsorted(first, pos, "right") - 1
            own = pos + len(mask) <= first[doc + 1]  # the run doesn't reach into the next document
            pos, doc = pos[own], doc[own]
            # equal seeds one after the other: the hits that continue a diagonal are known from the place before
            again = (pos > first[doc]) & (s[pos] == s[pos - 1])
            for p, d, table, places in ((pos[~again], doc[~again], keys, at), (pos[again], doc[again], head_keys, heads)):
                lo, hi = np.searchsorted(table, s[p], "left"), np.searchsorted(table, s[p], "right")
                n = hi - lo
                total = np.concatenate([[0], np.cumsum(n)])
                i = 0
                while i < len(p):  # at most about HITS pairs at a time; a diagonal is kept once
                    j = max(i + 1, int(np.searchsorted(total, total[i] + HITS, "right")) - 1)
                    m = n[i:j]
                    q = places[np.repeat(lo[i:j], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                    item = self.row[q]
                    begin = np.repeat(p[i:j], m) - (q - self.first[item])
                    if len(q):
                        found.append(_distinct(np.repeat(d[i:j], m), item, begin))
                        if sum(map(len, found)) > 2 * HITS:
                            found = [_distinct(*np.concatenate(found).T)]
                    i = j
        if not found:
            return []
        return self._verified(h, first, _distinct(*np.concatenate(found).T))

    def _verified(self, h: np.ndarray, first: np.ndarray, diagonals: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """The best diagonal of each (document, item) that holds a window; compared in blocks of many diagonals."""
        best: list[np.ndarray] = []
        lengths = np.diff(self.first)
        order = np.argsort(lengths[diagonals[:, 1]], kind="stable")
        diagonals = diagonals[order]
        width = lengths[diagonals[:, 1]]
        i = 0
        while i < len(diagonals):
            size = int(width[i])  # items of one length together
            j = min(int(np.searchsorted(width, size, "right")), i + max(1, HITS // max(size, 1)))
            doc, item, begin = diagonals[i:j].T
            i = j
            window = min(WINDOW, size)
            slack = TOLERANCE if window == WINDOW else 0
            a, b = np.maximum(begin, first[doc]), np.minimum(begin + size, first[doc + 1])
            place = begin[:, None] + np.arange(size)[None, :]
            inside = (place >= a[:, None]) & (place < b[:, None])
            words = self.words[self.first[item][:, None] + np.arange(size)[None, :]]
            same = (h[np.clip(place, 0, len(h) - 1)] == words) & inside
            run = np.concatenate([np.zeros((len(doc), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
            ok = run[:, window:] - run[:, :-window] >= window - slack
            ok &= inside[:, :size - window + 1] & inside[:, window - 1:]
            hit = np.flatnonzero(ok.any(axis=1))
            if len(hit):
                lo = ok[hit].argmax(axis=1)
                hi = ok.shape[1] - 1 - ok[hit][:, ::-1].argmax(axis=1) + window
                best.append(np.column_stack([doc[hit], item[hit], same[hit].sum(axis=1),
                                             begin[hit] + lo - first[doc[hit]], hi - lo]))
        if not best:
            return []
        rows = np.concatenate(best)
        rows = rows[np.lexsort(rows.T[::-1])]  # by document, item, agreement, start, length
        last = np.append((rows[1:, :2] != rows[:-1, :2]).any(axis=1), True)
        return [(d, i, start, n, agree) for d, i, agree, start, n in rows[last].tolist()]


def _distinct(doc: np.ndarray, item: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Distinct rows of three columns."""
    rows = np.column_stack([doc, item, begin])
    rows = rows[np.lexsort((begin, item, doc))]
    return rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))]


class indexes:
    """Index blocks of the benchmark (``item_id, text``), one after the other; a block's size is bounded, their number isn't.

    A block is read when its turn comes; ``len`` is the number of blocks, some of which may hold no item.
    """

    def __init__(self, benchmark: DataFrame):
        self.items = benchmark.select("item_id", "text").where(word_count(F.col("text")) >= MIN_WORDS)
        size = self.items.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
        self.n = int(2 * size // BLOCK_WORDS + 1)

    def __len__(self) -> int:
        return self.n

    def __iter__(self):
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n))
        for k in range(self.n):
            rows = self.items.where(block == k).orderBy("item_id").collect()
            if rows:
                yield Index([(r[0], r[1]) for r in rows])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per leaking document and item: ``doc_id, item_id, first_word, n_words, n_equal, item_words``."""
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select("doc_id", "text")
    doc_type = slim.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    out = None
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                for part in wordhash.parts(batch, "text"):
                    w = wordhash.words(part.column(1), lower=True)
                    found = index.leaks(w.hash, w.first)
                    if found:
                        d, i, start, n, agree = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(d)), pa.array([index.ids[x] for x in i]), pa.array(start),
                             pa.array(n), pa.array(agree), pa.array([int(index.first[x + 1] - index.first[x]) for x in i])],
                            names=["doc_id", "item_id", "first_word", "n_words", "n_equal", "item_words"])

        block = slim.mapInArrow(run, f"doc_id {doc_type}, item_id {item_type}, first_word long, n_words long, "
                                     "n_equal long, item_words long")
        # a block's finds are few: written, so that its broadcast can go before the next one is read
        block = written(block, "leaks")
        shared.unpersist()
        out = block if out is None else out.union(block)
    if out is None:
        return slim.crossJoin(benchmark.limit(0)).selectExpr(
            "doc_id", "item_id", "0L first_word", "0L n_words", "0L n_equal", "0L item_words")
    return out.dropDuplicates(["doc_id", "item_id"])


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, columns unchanged; no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index("text")
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                for part in wordhash.parts(batch, batch.schema.names[at]):
                    w = wordhash.words(part.column(at), lower=True)
                    bad = {f[0] for f in shared.value.leaks(w.hash, w.first)}
                    yield part.take(pa.array([i for i in range(part.num_rows) if i not in bad], type=pa.int64()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
