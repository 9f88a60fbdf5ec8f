"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.session import materialise


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of one partition as links of each node to the least it is joined to here."""
    for batch in batches:
        ids, places = np.unique(batch[["a", "b"]].to_numpy(), return_inverse=True)
        a, b = places.reshape(-1, 2).T
        root = np.arange(len(ids))
        while True:
            least = root.copy()
            np.minimum.at(least, a, root[b])
            np.minimum.at(least, b, root[a])
            least = least[least]
            if (least == root).all():
                break
            root = least
        moved = root != np.arange(len(ids))
        yield pd.DataFrame({"a": ids[root[moved]], "b": ids[moved]})


def _settled(links: DataFrame) -> bool:
    """Whether all links are stars: no node is a centre and a leaf, and no leaf has two centres."""
    twice = links.groupBy("b").agg(F.count("*").alias("n")).filter("n > 1").select("b")
    centres = links.select(F.col("a").alias("b")).distinct()
    return twice.union(links.select("b").join(centres, "b", "left_semi")).isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link to another; its component's least node.

    Links are first contracted batch by batch where they lie, then large-star and small-star steps
    alternate until nothing changes; every step aggregates before it shuffles, so a node with very
    many links is no bottleneck.  Null ends and links of a node to itself are left out; direction
    and repetition don't matter.
    """
    kind = dict(links.dtypes)[a]
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a != b")
    now = materialise(pairs.mapInPandas(_contract, f"a {kind}, b {kind}").distinct())
    for _ in range(most_rounds):
        if _settled(now):
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a != b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low, "b")
        now = materialise(joined.select(F.col("m").alias("a"), "b").union(joined.filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct())
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    tops = now.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(tops)
