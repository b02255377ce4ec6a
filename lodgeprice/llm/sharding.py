"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a fixed number of cells; every shard owns several virtual
nodes on it and a key belongs to the first node clockwise from its cell. Every
shard has a bound: the mean load, rounded up for as many shards as needed, so
that counts are at most one apart. Keys that meet a full shard continue
clockwise. Only the number of keys per cell reaches the driver (``CELLS`` rows,
whatever the input); it settles there how many keys of each cell go to which
shard, and Spark places each row by its rank inside its cell.

Defined cases: a null or empty text has 16 bytes; null ids share a cell;
repeated rows are placed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, hidden, shown

#: Cells of the ring and virtual nodes per shard; both bound the driver's work.
CELLS = 1 << 14
NODES = 64
ROW_BYTES = 16
SEED = 20261


def ring_nodes(shards: int, nodes: int = NODES, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Cell and shard of every virtual node, in ring order (ties: the lower shard first)."""
    at = [(int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:8], "big") % cells, s)
          for s in range(shards) for v in range(nodes)]
    at.sort()
    return np.array([a for a, _ in at]), np.array([s for _, s in at])


def settle(counts: np.ndarray, shards: int, nodes: int = NODES) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot) so that shard sizes differ by one at most.

    In step k every cell offers its remaining keys to the k-th node clockwise; a
    shard takes offers in ring order until it is full.
    """
    cells = len(counts)
    node_cell, node_shard = ring_nodes(shards, nodes, cells)
    total = int(counts.sum())
    room = np.full(shards, total // shards, dtype=np.int64)
    room[: total % shards] += 1
    filled = np.zeros(shards, dtype=np.int64)
    first = np.searchsorted(node_cell, np.arange(cells)) % len(node_cell)
    left = counts.astype(np.int64).copy()
    rank = np.zeros(cells, dtype=np.int64)
    out = []
    for step in range(len(node_cell)):
        live = np.flatnonzero(left)
        if not len(live):
            break
        shard = node_shard[(first[live] + step) % len(node_cell)]
        order = np.argsort(shard, kind="stable")
        live, shard = live[order], shard[order]
        offer = left[live]
        run = np.cumsum(offer)
        start = np.searchsorted(shard, np.arange(shards))
        base = np.concatenate([[0], run])[start][shard]
        before = run - offer - base  # offered to the same shard by earlier cells in this step
        free = room[shard] - filled[shard]
        take = np.clip(free - before, 0, offer)
        for c, s, t, b in zip(live[take > 0], shard[take > 0], take[take > 0], before[take > 0]):
            out.append((int(c), int(rank[c]), int(rank[c] + t), int(s), int(filled[s] + b)))
        filled += np.bincount(shard, weights=take, minlength=shards).astype(np.int64)
        rank[live] += take
        left[live] -= take
    return out


def place(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """``docs`` plus ``shard`` and ``slot`` (gapless from 0 within the shard), in place of columns of those names."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    rows, names = hidden(docs.drop("shard", "slot"), "ring_col")
    pos = F.xxhash64(F.lit(SEED), F.col(names[key]))
    cell = F.pmod(pos, F.lit(CELLS)).cast("int")
    counts = np.zeros(CELLS, dtype=np.int64)
    for r in rows.select(cell.alias("ring_cell")).groupBy("ring_cell").count().collect():  # at most CELLS rows
        counts[r["ring_cell"]] = r["count"]
    moves = spark.createDataFrame(
        settle(counts, shards), "move_cell int, move_from long, move_to long, shard int, move_slot long")
    order = [F.col("ring_pos"), F.col(names[key])] + [F.col(names[c]) for c in ("text_crc32", "size") if c in names]
    ranked = rows.withColumns({"ring_pos": pos, "ring_cell": cell}).withColumn(
        "ring_rank", (F.row_number().over(Window.partitionBy("ring_cell").orderBy(*order)) - 1).cast("long"))
    # one row per cell and shard that takes keys from it: bounded by the ring, not by the input
    hit = (F.col("ring_cell") == F.col("move_cell")) & (F.col("ring_rank") >= F.col("move_from")) & (
        F.col("ring_rank") < F.col("move_to"))
    return ranked.join(F.broadcast(moves), hit).select(
        *shown(names), "shard", (F.col("move_slot") + F.col("ring_rank") - F.col("move_from")).alias("slot"))


def shard_report(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Per document: id, bytes, checksum, the law that holds, shard and slot."""
    text = F.coalesce(docs["text"], F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    return place(slim, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                                      F.lit(None).cast("int").alias("grown_shard"))
