"""Embedding near-dedup with product quantisation.

Coarse inverted lists: every vector belongs to the list of its nearest centroid;
the rest of it (the residual) is coded by one codeword per subspace. A query
probes the lists whose centroids are nearest to it; inside a list distances come
from a table of query against codewords (asymmetric), a bound on each code's own
error decides which rows may reach the threshold, and only those are compared by
exact cosine in double precision. Every row is both indexed and a query.

Centroids and codewords are fitted on a sample of at most ``SAMPLE`` vectors
(a documented bound; the rows with the smallest hashes). The error bound makes
the code filter exact; a link is missed only if neither vector probes the
other's list. A test measures recall against brute force.

Equal vectors form a class with a count. A list is cut into blocks of about
``BLOCK`` rows, and a group holds one query block and one indexed block, so that
a list with a third of all rows is many bounded groups. Per group only counts
per query and a spanning forest of the links leave Python, never all pairs.

Defined cases: null, empty, zero and non-finite vectors, and vectors whose length
differs from the most common one, link with nothing; rows that share an id are
one vector for components; null ids link with nothing; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected

COSINE = 0.9
SAMPLE = 20_000
#: Indexed rows per list aimed at, most lists, lists probed, subspaces and codewords per subspace.
PER_LIST, MOST_LISTS, PROBES, SUBSPACES, WORDS = 256, 1024, 16, 8, 64
BLOCK = 1024
SEED, ROUNDS = 5, 12


def _kmeans(x: np.ndarray, k: int, rng) -> np.ndarray:
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c


class Quantiser:
    """Centroids and codebooks of one index."""

    def __init__(self, sample: np.ndarray, rows: int):
        rng = np.random.default_rng(SEED)
        self.lists = int(min(MOST_LISTS, max(1, rows // PER_LIST), len(sample)))
        self.centroids = _kmeans(sample, self.lists, rng)
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        rest = sample - self.centroids[self.nearest(sample, 1)[:, 0]]
        self.books = [_kmeans(rest[:, cut], WORDS, rng) for cut in self.cuts]

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        d = (self.centroids ** 2).sum(1)[None, :] - 2 * x @ self.centroids.T
        n = min(n, d.shape[1])
        part = np.argpartition(d, n - 1, axis=1)[:, :n]
        return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distance between each vector and its code)."""
        rest = x - self.centroids[lists]
        codes, error = np.empty((len(x), len(self.cuts)), dtype=np.int64), np.zeros(len(x))
        for j, (cut, book) in enumerate(zip(self.cuts, self.books)):
            d = ((rest[:, cut][:, None, :] - book[None]) ** 2).sum(2)
            codes[:, j] = d.argmin(1)
            error += d.min(1)
        return codes, np.sqrt(error)

    def table(self, queries: np.ndarray, at: int) -> np.ndarray:
        """Squared distances of each query's residual in list ``at`` to every codeword: (query, subspace, word)."""
        rest = queries - self.centroids[at]
        return np.stack([((rest[:, cut][:, None, :] - book[None]) ** 2).sum(2) if len(book) == WORDS else np.pad(
            ((rest[:, cut][:, None, :] - book[None]) ** 2).sum(2), ((0, 0), (0, WORDS - len(book))))
            for cut, book in zip(self.cuts, self.books)], axis=1)


def _unit(rows) -> np.ndarray:
    x = np.stack(rows).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, smallest node of its part) of the bipartite graph ``links``."""
    low, high = left.copy(), right.copy()
    if not links.any():
        return []
    top = np.iinfo(np.int64).max
    while True:
        new_low = np.minimum(low, np.where(links, high[None, :], top).min(1))
        new_high = np.minimum(high, np.where(links, new_low[:, None], top).min(0))
        if (new_low == low).all() and (new_high == high).all():
            break
        low, high = new_low, new_high
    return [(a, b) for a, b in zip(np.concatenate([left, right]), np.concatenate([low, high])) if a != b]


def _compare(pdf: pd.DataFrame, q: Quantiser) -> pd.DataFrame:
    """Links between one block of queries and one block of a list."""
    one, two = pdf[pdf["query"]], pdf[~pdf["query"]]
    if one.empty or two.empty:
        return pd.DataFrame({"vec": [], "n": [], "root": []}, dtype="int64")
    at = int(pdf["list"].iloc[0])
    x, y = _unit(one["embedding"]), _unit(two["embedding"])
    codes, error = q.encode(y, np.full(len(y), at))
    table = q.table(x, at)
    near = np.zeros((len(x), len(y)))
    for j in range(table.shape[1]):
        near += table[:, j, :][:, codes[:, j]]
    # |x - y| <= |x - code| + error, so a pair at the threshold passes
    limit = np.sqrt(2 - 2 * COSINE) + error + 1e-6
    maybe = near <= (limit * limit)[None, :]
    a, b = one["vec"].to_numpy(np.int64), two["vec"].to_numpy(np.int64)
    maybe &= a[:, None] != b[None, :]
    links = np.zeros_like(maybe)
    i, j = np.nonzero(maybe)
    for s in range(0, len(i), 200_000):
        p, r = i[s:s + 200_000], j[s:s + 200_000]
        links[p, r] = np.einsum("ij,ij->i", x[p], y[r]) >= COSINE
    home = one["home"].to_numpy()
    wa, wb = one["n"].to_numpy(np.int64), two["n"].to_numpy(np.int64)
    # the indexed side counts a link itself if it probes the query's list; if not, it is counted here
    back = links & ~np.stack([np.isin(home, p) for p in two["probes"]], axis=1)
    out = pd.concat([pd.DataFrame({"vec": a, "n": links @ wb, "root": -1}),
                     pd.DataFrame({"vec": b, "n": back.T @ wa, "root": -1})])
    forest = pd.DataFrame(_forest(links, a, b), columns=["vec", "root"]).assign(n=0)
    return pd.concat([out[out["n"] > 0], forest])[["vec", "n", "root"]].astype("int64")


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that can link, one per distinct vector: ``vec, n, embedding``."""
    v = F.col("embedding")
    sound = vectors.where(v.isNotNull() & F.col("vec_id").isNotNull()).where(
        F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0))
    plain = F.transform(v, lambda e: e.cast("double") + 0.0)  # -0.0 becomes 0.0
    return sound.groupBy(plain.alias("embedding")).agg(F.min("vec_id").alias("vec"), F.count("*").alias("n"))


def near_vectors(vectors: DataFrame) -> DataFrame:
    """Per row: ``vec_id, n_links, component_id, kept``; vectors of each length have an index of their own."""
    base = written(usable(vectors.select("vec_id", "embedding")), "pq-classes")
    found = None
    for row in base.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect():  # a row per length
        links = _links(base.where(F.size("embedding") == row["d"]), row["count"])
        found = links if found is None else found.union(links)
    return _report(vectors, base, found)


def _links(base: DataFrame, rows: int) -> DataFrame:
    """Counts and component edges ``vec, n, root`` of the distinct vectors of one length."""
    spark = base.sparkSession
    sample = base.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).select("embedding").toPandas()
    shared = spark.sparkContext.broadcast(Quantiser(_unit(sample["embedding"]), rows))

    def probe(batches):
        q = shared.value
        for pdf in batches:
            if len(pdf):
                lists = q.nearest(_unit(pdf["embedding"]), PROBES)
                yield pdf.assign(home=lists[:, 0], probes=list(lists))

    placed = written(base.mapInPandas(probe, "embedding array<double>, vec long, n long, home long, probes array<long>"),
                     "pq-placed")
    held = placed.groupBy(F.col("home").alias("list")).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    asked = placed.select(F.explode("probes").alias("list")).groupBy("list").agg(
        F.ceil(F.count("*") / BLOCK).alias("q_blocks"))
    size = F.broadcast(held.join(asked, "list"))  # a row per list, MOST_LISTS at most
    index = placed.withColumn("list", F.col("home")).join(size, "list").withColumns({
        "block": F.pmod(F.xxhash64("vec"), "blocks"), "q_block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_blocks") - 1)),
        "query": F.lit(False)})
    queries = placed.withColumn("list", F.explode("probes")).join(size, "list").withColumns({
        "q_block": F.pmod(F.xxhash64("vec", F.lit(1)), "q_blocks"),
        "block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)), "query": F.lit(True)})
    cols = ["list", "block", "q_block", "query", "vec", "n", "home", "probes", "embedding"]
    met = index.select(*cols).union(queries.select(*cols)).groupBy("list", "block", "q_block")
    return written(met.applyInPandas(lambda pdf: _compare(pdf, shared.value), "vec long, n long, root long"), "pq-links")


def _report(vectors: DataFrame, base: DataFrame, found: DataFrame | None) -> DataFrame:
    n_links = None
    if found is not None:
        comp = connected(found.where("root >= 0").select(F.col("vec").alias("a"), F.col("root").alias("b")))
        n_links = found.groupBy("vec").agg(F.sum("n").alias("links"))
        per = base.join(n_links, "vec", "left").join(comp.withColumnRenamed("node", "vec"), "vec", "left").select(
            F.col("embedding").alias("key"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
            F.coalesce("component", "vec").alias("component"))
    v = F.transform("embedding", lambda e: e.cast("double") + 0.0)
    if n_links is None:
        out = vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    else:
        known = vectors.select("vec_id", F.when(F.col("vec_id").isNotNull(), v).alias("key"))
        out = known.join(per, "key", "left").select(
            "vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
