"""What was derived from what, and what is stale when something changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.session import materialise


def stale_outputs(derivations: DataFrame, changed: DataFrame, methods: DataFrame | None = None, most_rounds: int = 1000) -> DataFrame:
    """(change, output): what is stale after each change.

    ``derivations`` has (output, input, method_id, method_version), one row for each input;
    ``changed`` has (change, item); ``methods`` current versions (method_id, version).  An output is
    stale if an input changed or is itself stale, or, after every change, if its method has another
    current version; a method without one is unchanged.  Each round joins only what the round before
    added, so cycles end too.
    """
    links = materialise(derivations.select("output", F.col("input").alias("item")).distinct().repartition("item"))
    front = materialise(changed.select("change", "item").distinct())
    every, found = front.select("change").distinct(), []
    if methods is not None:
        # What is outdated is stale after every change: one closure of its own, given to all at the end.
        old = derivations.join(methods, "method_id").filter("method_version != version").select(F.col("output").alias("item")).distinct()
        always = _closure(links, old.select(F.lit(0).alias("change"), "item"), most_rounds, True)
        found = [every.join(always.select("item"), how="cross")]
    stale = _closure(links, front, most_rounds, False)
    out = stale if not found else stale.unionByName(found[0]).distinct()
    return out.select("change", F.col("item").alias("output"))


def _closure(links: DataFrame, front: DataFrame, most_rounds: int, whole: bool) -> DataFrame:
    """(change, item): what follows from ``front`` along links, with it if ``whole``; each round writes only what it adds."""
    parts = [materialise(front)] if whole else []
    for _ in range(most_rounds):
        new = front.join(links, "item").select("change", F.col("output").alias("item")).distinct()
        for part in parts:
            new = new.join(part, ["change", "item"], "left_anti")
        new = materialise(new)
        if new.isEmpty():
            break
        parts.append(new)
        front = new
    else:
        raise RuntimeError(f"not settled in {most_rounds} rounds")
    out = parts[0] if parts else front.limit(0)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("change", "item")


def derivation_rows(derived: DataFrame, output: str, inputs: str, method_id: int, version: int) -> DataFrame:
    """Rows to record: one for each different input of each output, by content."""
    return derived.select(F.col(output).alias("output"), F.explode(F.array_distinct(inputs)).alias("input"), F.lit(method_id).alias("method_id"), F.lit(version).cast("bigint").alias("method_version"))
