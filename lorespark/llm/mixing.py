"""A mix of sources with target shares of all tokens.

The documents of each source are counted by exact token length.  A source's budget is met by whole
passes over the source and one part pass; the part pass takes the same fraction of every length,
and bounded-knapsack dynamic programming over the lengths still available closes the gap that
rounding leaves.  Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.tokens import NAME, TOKENIZERS, count_tokens
from lorespark.session import materialise

#: A length's documents are ranked within this many parts by hash, so none is ranked in one task.
PARTS = 1024


def fit_subset(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their tokens come to ``budget``.

    The sum never exceeds the budget, and is the largest that the lengths allow near it.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    taken = [c * budget // total for c in counts]
    rest = budget - sum(n * k for n, k in zip(lengths, taken))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    room = 4 * max(lengths, default=0)
    for i in order:  # whole documents, until the gap is small
        if rest > room:
            more = min(counts[i] - taken[i], (rest - room) // lengths[i])
            taken[i] += more
            rest -= more * lengths[i]
    steps: list[tuple[int, int, int]] = []  # (length's place, copies, sums reachable before)
    reach, mask = 1, (1 << (rest + 1)) - 1
    for i in order:
        left, copies = min(counts[i] - taken[i], rest // lengths[i]), 1
        while left > 0 and not reach >> rest & 1:
            copies = min(copies, left)
            steps.append((i, copies, reach))
            reach |= (reach << (copies * lengths[i])) & mask
            left -= copies
            copies *= 2
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for i, copies, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += copies
            at -= copies * lengths[i]
    return taken


def _part_pass(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("n_tokens")
    lengths, counts = group.n_tokens.tolist(), group.n_docs.tolist()
    return group.assign(take=fit_subset(lengths, counts, int(group.part_budget.iloc[0])))[["source", "n_tokens", "take", "passes"]]


def token_sizes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", directory: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(doc_id, source, n_tokens) of every document with a source and at least one token."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).filter("source is not null")
    return count_tokens(rows, ["doc_id", "source"], "text", directory, name).filter("n_tokens > 0")


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, repeats): how often each document appears in the mix.

    ``sizes`` holds (doc_id, source, n_tokens), see `token_sizes`; it is read several times, so
    materialise it.  ``targets`` is a short table (source, target_share, max_repeats), one line for
    each source.  Without ``total_tokens`` the mix is the largest in which every source that has
    documents reaches its share; with it, a source that can't fill its share within ``max_repeats``
    gives all it may.  Documents without tokens, without a source or with a source that has no
    target are left out; a target without documents reaches share 0.  Repeated rows count as
    documents of their own.  Of several targets for a source the shares add up and the largest
    ``max_repeats`` holds; null or negative shares count as 0, null ``max_repeats`` as 1.
    """
    spark = sizes.sparkSession
    wanted = clean_targets(targets)
    held = sizes.join(wanted.select("source"), "source", "left_semi")
    rows = held.groupBy("source").agg(F.sum("n_tokens").alias("have")).join(wanted, "source").filter("share > 0").collect()  # as many as there are targets
    most = min((r.have * r.max_repeats / r.share for r in rows), default=0)
    total = most if total_tokens is None else total_tokens
    plan = []
    for r in rows:
        budget = min(round(r.share * total), r.have * r.max_repeats)
        plan.append((r.source, budget // r.have, budget % r.have))
    budgets = spark.createDataFrame(plan, "source string, passes bigint, part_budget bigint")
    counted = held.groupBy("source", "n_tokens").agg(F.count("*").alias("n_docs"))
    takes = counted.join(budgets, "source").groupBy("source").applyInPandas(_part_pass, "source string, n_tokens bigint, take bigint, passes bigint")
    part = held.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("part", F.pmod("h", F.lit(PARTS)))
    key = ["source", "n_tokens", "part"]
    ranked = part.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("h", "doc_id")))
    before = part.groupBy(*key).agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("source", "n_tokens").orderBy("part")) - F.col("n"))
    chosen = ranked.join(before.drop("n"), key).join(takes, ["source", "n_tokens"])
    repeats = F.col("passes") + (F.col("before") + F.col("nth") <= F.col("take")).cast("bigint")
    return chosen.select("doc_id", "source", "n_tokens", repeats.alias("repeats")).filter("repeats > 0")


def clean_targets(targets: DataFrame) -> DataFrame:
    return (
        targets.filter("source is not null")
        .groupBy("source")
        .agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).cast("bigint").alias("max_repeats"))
    )


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """The share of all tokens of the mix that each target source reached, next to its target."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats"))
    rows = clean_targets(targets).join(got, "source", "left").fillna(0, ["tokens", "n_docs", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy())  # over as many rows as there are targets
    actual = F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0)
    return rows.select("source", F.col("share").alias("target_share"), "max_repeats", "n_docs", "most_repeats", "tokens", F.round(actual, 6).alias("actual_share"))


def mixed_documents(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, directory: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """`mix` of a table of texts: every text is tokenised once and only its size is kept."""
    return mix(materialise(token_sizes(documents, directory=directory, name=name)), targets, total_tokens, seed)
