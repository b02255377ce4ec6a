"""Mixing sources to target weights: repetition rates and seeded Bernoulli copies.

Tokens are counted per source, a target is derived for each source by filling
up shares in proportion to weight with a ceiling per source, and every document
is emitted floor(rate) times plus once more with probability equal to the
fraction. The draw is a hash of the document's id, so reruns agree.

Defined cases: a null or empty text has size 0; a null source is a source of
its own, ordered last; a null id draws like the id "null"; repeated rows are
separate documents that share a draw; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hidden, shown, word_count, written

SEED = "mix-1"
#: Hexadecimal digits of the draw: 13 digits are 52 bits, exact in a double.
DRAW_DIGITS = 13


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, ceiling: int) -> DataFrame:
    """One row per source: ``mix_source, source_size, target``.

    Sources in code-point order take the weights in turn. Water filling: with the
    sources sorted by ceiling per unit of weight, a prefix of them ends at its
    ceiling and the others share what is left by weight; a source is in the
    prefix if its ceiling is below the share it would get. Runs on one row per
    source, after the documents have been aggregated.
    """
    per = sizes.groupBy("mix_source").agg(F.sum("size").alias("source_size"))
    at = (F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (at + 1).cast("int")).cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("mix_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(share)
    per = per.select(
        "mix_source", "source_size", "w", total.alias("total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("filled"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
    )
    # share of one unit of weight if exactly the sources before this one end at their ceiling
    level = (F.col("total") - ceiling * F.col("filled")) / F.col("w_left")
    open_ = ceiling * F.col("source_size") > level * F.col("w")
    per = per.withColumn("level", F.min(F.when(open_, F.struct(F.col("filled"), level.alias("v")))).over(everything)["v"])
    goal = F.least(F.col("w") * F.col("level"), (ceiling * F.col("source_size")).cast("double"))
    return per.select("mix_source", "source_size",
                      F.coalesce(goal, (ceiling * F.col("source_size")).cast("double")).alias("target"))


def copies(doc_id: Column, rate: Column, seed: str = SEED) -> Column:
    """floor(rate), and one more if the document's draw in [0, 1) is below the fraction."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    draw = F.conv(F.substring(F.md5(text.cast("binary")), 1, DRAW_DIGITS), 16, 10).cast("double") / float(16 ** DRAW_DIGITS)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def rated(docs: DataFrame, per: DataFrame) -> DataFrame:
    """``docs`` (with ``mix_source``) joined to its source's size, target and rate."""
    per = per.withColumnRenamed("mix_source", "mix_key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return docs.join(per, docs["mix_source"].eqNullSafe(per["mix_key"])).drop("mix_key").withColumn("mix_rate", rate)


def mix_report(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, ceiling: int = 2) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken, copies``."""
    sizes = written(docs.select("doc_id", F.col("source").alias("mix_source"), word_count(docs["text"]).alias("size")),
                    "mix-sizes")
    per = source_targets(sizes, weights, share, ceiling)
    n = copies(F.col("doc_id"), F.col("mix_rate"))
    return rated(sizes, per).select("doc_id", "size", "source_size", "target", (F.col("size") * n).alias("taken"),
                                    n.alias("copies"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, ceiling: int = 2) -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as often as the mix takes it."""
    sizes = docs.select(F.col("source").alias("mix_source"), word_count(docs["text"]).alias("size"))
    per = written(source_targets(sizes, weights, share, ceiling), "mix-targets")
    rows, names = hidden(docs, "mix_col")
    out = rated(rows.withColumn("mix_source", F.col(names["source"])), per)
    n = copies(F.col(names["doc_id"]), F.col("mix_rate"))
    return out.withColumn("mix_copy", F.explode(F.array_repeat(F.lit(1), n))).select(*shown(names))
