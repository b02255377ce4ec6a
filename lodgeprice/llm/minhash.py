"""MinHash near-dedup with HyperMinHash registers.

Every document's set of 5-word shingles is hashed into ``BUCKETS`` buckets; a
bucket keeps its smallest value compressed to a 16-bit register: the number of
leading zeros and the mantissa bits that follow. An empty bucket borrows from
another one that a fixed table names. Bands of registers are the blocking keys.

1. Documents with equal shingle sets form a class (128-bit set hash); only one
   row per class goes on.
2. Classes that share a band key are candidates. In each key's bucket a pivot
   is compared with every other class: the number of rows is that of the
   bucket, never its square.
3. A pair goes to verification if the collision-corrected estimate of its
   Jaccard similarity is within ``MARGIN`` of the threshold; it links if the
   full sets, rebuilt from the whole texts, reach the threshold.
4. Links are merged into components. Where buckets still hold many pairs across
   components, their documents outside the bucket's largest component meet
   another member of it, a few times; what then remains is compared across
   components in full, so that no link between different components is lost.

Defined cases: a null or empty text has no shingles, links with nothing and is
its own component; with fewer words than five the whole sequence is one
shingle; rows that share an id are one document; a row without an id links with
nothing and has a null component; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import small_batches, written
from .components import connected

SHINGLE = 5
BANDS, ROWS = 28, 5
BUCKETS = BANDS * ROWS
MANTISSA = 10
#: Links need 100 * intersection >= percent * union; this is op9's percentage.
PERCENT = 85
#: The estimate has a standard error of 0.03 near the threshold.
MARGIN = 0.15
#: Share of registers of different values that agree by chance, times 2**MANTISSA (published constant).
CHANCE = 0.169919487159739
TRIES = 64
#: Pivot rounds go on while buckets hold more pairs across components than ``FEW`` per row, ``TURNS`` times at most.
FEW, TURNS = 8, 1
#: Rows in one block of a large bucket; rows of a bucket that counts as small.
BLOCK, SMALL = 512, 64

_rng = np.random.default_rng(20262)
_BORROW = _rng.integers(0, BUCKETS, size=(TRIES, BUCKETS))


def shingles(h: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes of one document's word hashes, ascending."""
    if len(h) == 0:
        return h
    if len(h) < SHINGLE:
        return wordhash.windows(h, len(h)) ^ np.uint64(len(h))
    return np.unique(wordhash.windows(h, SHINGLE))


def registers(s: np.ndarray) -> np.ndarray:
    """Registers of a non-empty ascending shingle set."""
    bucket = ((s >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    value = (s[first] * np.uint64(BUCKETS)).astype(np.float64) + 1.0  # the place within the bucket, of 2**64
    bits = value.view(np.uint64)
    zeros = np.minimum(np.uint64(1023 + 64) - (bits >> np.uint64(52)), np.uint64(63))
    reg = (zeros << np.uint64(MANTISSA)) | ((bits >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1))
    out, have = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=bool)
    out[bucket[first].astype(np.int64)] = reg
    have[bucket[first].astype(np.int64)] = True
    if have.all():
        return out
    src = np.arange(BUCKETS)
    for t in range(TRIES):
        empty = ~have[src]
        if not empty.any():
            break
        src[empty] = _BORROW[t][empty]
    src[~have[src]] = np.flatnonzero(have)[0]
    return out[src]


def band_keys(reg: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, for rows of registers."""
    r = wordhash.mix(reg.astype(np.uint64).reshape(len(reg), BANDS, ROWS) + np.uint64(1))
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(reg), BANDS)).copy()
    for k in range(ROWS):
        key = wordhash.mix(key * np.uint64(0x9E3779B97F4A7C15) + r[:, :, k])
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, regs, bands`` per document."""
    small_batches(docs.sparkSession)
    slim = docs.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in wordhash.parts(batch, "text"):
                w = wordhash.words(part.column(1), lower=True)
                n = len(w)
                count, a, b = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                reg = np.zeros((n, BUCKETS), dtype=np.int64)
                for i in range(n):
                    s = shingles(w.row(i))
                    count[i] = len(s)
                    if len(s):
                        a[i], b[i] = s.sum(), wordhash.mix(s).sum()
                        reg[i] = registers(s)
                bands = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, band_keys(reg).ravel())
                regs = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BUCKETS,
                                                reg.astype(np.uint16).view(np.int16).ravel())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(count), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), regs, bands],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "regs", "bands"])

    return slim.mapInArrow(run, f"doc_id {kind}, n_shingles long, set_a long, set_b long, "
                                "regs array<smallint>, bands array<bigint>")


def full_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, shingles`` (every distinct shingle hash of the whole text)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in wordhash.parts(batch, "text", most=1 << 20):
                w = wordhash.words(part.column(1), lower=True)
                sets = [shingles(w.row(i)) for i in range(len(w))]
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(at, np.concatenate(sets).view(np.int64))],
                    names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, shingles array<bigint>")


def estimate(ra: Column, rb: Column, na: Column, nb: Column) -> Column:
    """Jaccard estimate of two register arrays, corrected for chance agreement."""
    same = F.size(F.filter(F.zip_with(ra, rb, lambda x, y: x == y), lambda e: e))
    ratio = F.greatest(na, nb) / F.least(na, nb)
    chance = BUCKETS * CHANCE * 4 * ratio / ((1 + ratio) * (1 + ratio)) / (1 << MANTISSA)
    return (same - chance) / BUCKETS


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a, b, na, nb``) whose full sets reach the threshold."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = written(full_sets(texts.join(ids, "doc_id")), "minhash-sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.where(_reaches("sa", "sb", "na", "nb", percent)).select("a", "b")


def _close(pairs: DataFrame, regs: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs whose estimate is near the threshold or above, with set sizes."""
    side = lambda s: regs.select(F.col("doc_id").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("regs").alias(f"r{s}"))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    possible = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    near = estimate(F.col("ra"), F.col("rb"), F.col("na"), F.col("nb")) >= percent / 100 - MARGIN
    return both.where(possible & near).select("a", "b", "na", "nb")


def _labelled(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """``rows`` with the component of ``doc`` (itself, if it has no link yet)."""
    return rows.join(comp.withColumnRenamed("node", "doc"), "doc", "left").withColumn(
        "component", F.coalesce("component", "doc"))


def _open_rows(rows: DataFrame) -> DataFrame:
    """Rows of buckets that hold several components, with the bucket's size and its largest component."""
    parts = rows.groupBy("band", "component").agg(F.count("*").alias("n"))
    per = parts.groupBy("band").agg(
        F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"),
        F.max(F.struct("n", "component"))["component"].alias("largest")).where("parts > 1")
    return rows.join(per.drop("parts"), "band")


def _pivot_pairs(open_rows: DataFrame, turn: int) -> DataFrame:
    """Every document outside a bucket's largest component, with one document of that component."""
    inside = open_rows.where("component = largest").withColumn("draw", F.xxhash64("doc", "band", F.lit(turn)))
    pivot = inside.groupBy("band").agg(F.min(F.struct("draw", "doc"))["doc"].alias("pivot"))
    outside = open_rows.where("component <> largest").select("band", "doc")
    return outside.join(pivot, "band").select(F.least("pivot", "doc").alias("a"), F.greatest("pivot", "doc").alias("b"))


def _cross_pairs(open_rows: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Close pairs of different components that share one of the open buckets, each pair from one bucket only."""
    sides = reps.select(F.col("doc_id").alias("doc"), "n_shingles", "regs", "bands")
    rows = open_rows.select("band", "doc", "component").join(sides, "doc")
    side = lambda s: rows.select("band", *[F.col(c).alias(f"{c}_{s}") for c in rows.columns if c != "band"])
    na, nb = F.col("n_shingles_a"), F.col("n_shingles_b")
    met = side("a").join(side("b"), "band").where(
        (F.col("doc_a") < F.col("doc_b")) & (F.col("component_a") != F.col("component_b"))
        & (100 * F.least(na, nb) >= percent * F.greatest(na, nb))
        & (F.array_min(F.array_intersect("bands_a", "bands_b")) == F.col("band"))
        & (estimate(F.col("regs_a"), F.col("regs_b"), na, nb) >= percent / 100 - MARGIN))
    return met.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"), na.alias("na"), nb.alias("nb"))


def _reaches(sa, sb, na, nb, percent):
    common = F.size(F.array_intersect(sa, sb))
    return 100 * common >= percent * (F.col(na) + F.col(nb) - common)


def _block_links(pdf, percent):
    """Links across components between the two blocks of one bucket that ``pdf`` holds."""
    lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
    one, two = pdf[pdf["own"] == lo].reset_index(drop=True), pdf[pdf["own"] == hi].reset_index(drop=True)
    regs, bands = np.stack(two["regs"]), np.stack(two["bands"])
    comp, doc, size = two["component"].to_numpy(), two["doc"].to_numpy(), two["n_shingles"].to_numpy()
    out = []
    for r in one.itertuples(index=False):
        ok = (comp != r.component) & (100 * np.minimum(size, r.n_shingles) >= percent * np.maximum(size, r.n_shingles))
        if lo == hi:
            ok &= doc > r.doc
        # the estimate without its correction for chance is never lower
        ok &= (regs == r.regs).sum(axis=1) >= BUCKETS * (percent / 100 - MARGIN)
        at = np.flatnonzero(ok)
        # the pair counts in the shared bucket of the smallest key only, as in _cross_pairs
        least = np.where(bands[at] == r.bands, bands[at], np.iinfo(np.int64).max).min(axis=1)
        at = at[least == r.band]
        for j in at:
            common = len(np.intersect1d(r.shingles, two["shingles"].iat[j], assume_unique=True))
            if 100 * common >= percent * (r.n_shingles + size[j] - common):
                out.append((r.doc, doc[j]))
    return pd.DataFrame(out, columns=["a", "b"])


def _remaining(open_rows: DataFrame, reps: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All links across components in the open buckets.

    Pairs of small buckets are at most ``SMALL`` per row and are verified like
    any others. Larger buckets are cut into blocks; two blocks meet in a group of
    bounded size with their full sets, and only links leave it.
    """
    few = open_rows.where(F.col("n") <= SMALL)
    out = _verified(written(_cross_pairs(few, reps, percent).distinct(), "minhash-pairs"), texts, percent)
    many = open_rows.where(F.col("n") > SMALL).select("band", "doc", "component", "n")
    sets = full_sets(texts.join(many.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    sides = reps.select("doc_id", "n_shingles", "regs", "bands").join(sets, "doc_id").withColumnRenamed("doc_id", "doc")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc"), blocks).cast("int")
    rows = many.join(written(sides, "minhash-sets"), "doc").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns(
        {"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other", "n")
    kind = reps.schema["doc_id"].dataType.simpleString()
    blocks_met = rows.groupBy("band", "lo", "hi").applyInPandas(lambda pdf: _block_links(pdf, percent), f"a {kind}, b {kind}")
    return out.union(blocks_met)


def links(docs: DataFrame, sig: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links ``a, b`` whose components are those of all pairs that reach ``percent``."""
    live = sig.where("n_shingles > 0 and doc_id is not null")
    classes = live.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("doc_id"))
    reps = live.join(classes, ["doc_id", "n_shingles", "set_a", "set_b"], "left_semi")
    keys = reps.select(F.col("doc_id").alias("doc"), F.explode("bands").alias("band"))
    buckets = keys.groupBy("band").agg(F.count("*").alias("n"), F.min("doc").alias("pivot")).where("n > 1")
    active = written(keys.join(buckets.select("band", "pivot"), "band").distinct(), "minhash-active")
    ids = active.select(F.col("doc").alias("doc_id")).distinct()
    reps = written(reps.join(ids, "doc_id", "left_semi"), "minhash-reps")
    texts = written(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), "minhash-texts")

    pairs = active.where("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b"))
    close = written(_close(pairs, reps, percent), "minhash-pairs")
    found = written(_verified(close, texts, percent), "minhash-links")
    turn = 0
    while True:
        rows = _labelled(active.select("band", "doc"), connected(found))
        rows = written(_open_rows(rows), "minhash-open")
        work = rows.select("band", "n", "squares").distinct().agg(
            F.sum("n").alias("rows"), F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2).alias("cross")).first()
        if not work["rows"]:
            return found
        if work["cross"] <= FEW * work["rows"] or turn == TURNS:
            break
        turn += 1
        close = written(_close(_pivot_pairs(rows, turn), reps, percent), "minhash-pairs")
        found = written(found.union(_verified(close, texts, percent)).distinct(), "minhash-links")
    return written(found.union(_remaining(rows, reps, texts, percent)).distinct(), "minhash-links")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept``."""
    sig = written(signatures(docs), "minhash-signatures")
    comp = connected(links(docs, sig, percent))
    live = sig.where("n_shingles > 0 and doc_id is not null")
    classes = live.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    classes = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("n_shingles").alias("n"), F.col("set_a").alias("sa"), F.col("set_b").alias("sb"),
        F.coalesce("component", "rep").alias("class_component"))
    same = (F.col("n_shingles") == F.col("n")) & (F.col("set_a") == F.col("sa")) & (F.col("set_b") == F.col("sb"))
    out = sig.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near duplicates, columns unchanged."""
    gone = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti").select(*docs.columns)
