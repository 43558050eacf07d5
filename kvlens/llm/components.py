"""Connected components of a table of links: union-find inside tasks, then alternating stars over written tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlens.llm.common import Scratch

ROUNDS = 40
#: Links that one task joins at once.
LINKS = 20_000


def contracted(edges: DataFrame, parts: int) -> DataFrame:
    """u, v: the links of each of ``parts`` tasks as stars around their smallest ids; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        stars = [(x, r) for x in parent if (r := root(x)) != x]
        for at in range(0, len(stars), 10_000):
            u, v = zip(*stars[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return edges.select("u", "v").coalesce(parts).mapInArrow(run, "u long, v long")


def are_stars(edges: DataFrame) -> bool:
    """Whether each upper end (u) has one edge and is no lower end (v): then v is its component."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("upper")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("upper")))
    odd = ends.groupBy("id").agg(F.sum("upper").alias("n"), F.min("upper").alias("lower")).where("n > 1 OR (n = 1 AND lower = 0)")
    return not odd.limit(1).count()


def star(edges: DataFrame) -> DataFrame:
    """A large star ties the larger neighbours of each id to its smallest, then a small star the smaller ones.

    Minima are summed in the map tasks and joined back, so a hub's edges are split by AQE.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
    small_least = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(small_least, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, component (its smallest id) of every id in ``links`` (a, b)."""
    edges = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    for _ in range(ROUNDS):
        parts = max(1, -(-edges.count() // LINKS))
        edges = scratch.save(contracted(edges, parts), "edges")
        if parts == 1 or are_stars(edges):
            break
        edges = scratch.save(star(edges), "edges")
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return scratch.save(stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct()), "components")
