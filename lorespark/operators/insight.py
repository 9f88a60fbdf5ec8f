"""Findings with a test of chance: bridges, leads and reversals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.stats import binomial_tail
from lorespark.session import materialise

#: Floors and bounds of the lead detector (fixed values).
MIN_MENTIONS, MAX_LAG, TOLERANCE, MIN_COUNT, MIN_RATIO, MIN_TEST = 5, 90, 1, 4, 0.35, 2
#: Entities of a group; each two groups are compared in a task.
TOGETHER = 64
#: Floors that a finding needs (fixed values).
MIN_SUPPORT, MIN_SURPRISE = 2, 0.60


def cluster_profile(mentions: DataFrame) -> DataFrame:
    """(entity, cluster, n): in how many entries of a cluster an entity stands."""
    return mentions.select("entity", "cluster", "entry").distinct().groupBy("entity", "cluster").agg(F.count("*").alias("n"))


def structural_bridges(mentions: DataFrame) -> DataFrame:
    """(entity, c1, c2, support, spread, surprise, p_value) of entities in two or more clusters.

    ``mentions`` has (entity, cluster, entry).  The two clusters with most entries are tested
    against how common they are among all entities.
    """
    profile = cluster_profile(mentions)
    totals = profile.groupBy("cluster").agg(F.sum("n").alias("all"))
    grand = totals.agg(F.greatest(F.sum("all"), F.lit(1)).alias("grand")).first()
    grand = float(grand.grand or 1)
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("n"), "cluster"))
    best = profile.withColumn("place", place)
    by = best.groupBy("entity").agg(
        F.count("*").alias("spread"),
        F.sum("n").alias("support"),
        F.max(F.when(F.col("place") == 1, F.col("cluster"))).alias("c1"),
        F.max(F.when(F.col("place") == 2, F.col("cluster"))).alias("c2"),
        F.sum(F.when(F.col("place") <= 2, F.col("n"))).alias("top2"),
    ).filter("spread >= 2")
    q = by.join(totals.select(F.col("cluster").alias("c1"), F.col("all").alias("a1")), "c1").join(totals.select(F.col("cluster").alias("c2"), F.col("all").alias("a2")), "c2")
    surprise = F.col("top2") / F.col("support") / (F.col("spread") - 1)
    p = binomial_tail(F.col("support"), F.col("top2"), (F.col("a1") + F.col("a2")) / grand)
    return q.select("entity", "c1", "c2", "support", "spread", F.round(surprise, 6).alias("surprise"), F.round(p, 6).alias("p_value"))


def naive_bridges(mentions: DataFrame) -> DataFrame:
    """(entity, spread): every entity in two or more clusters, for contrast."""
    return mentions.select("entity", "cluster").distinct().groupBy("entity").agg(F.count("*").alias("spread")).filter("spread >= 2")


def false_discovery(candidates: DataFrame, q: float = 0.05, family: str | None = None, p_col: str = "p_value", id_col: str = "id") -> DataFrame:
    """Adds ``accepted``: Benjamini-Hochberg step-up, within each family if one is named.

    All candidates with the p-value of the cut-off are accepted.  Ranks come from counts of equal
    p-values, so no window runs over all candidates row by row.
    """
    keys = [family] if family else []
    counts = candidates.groupBy(*keys, p_col).agg(F.count("*").alias("__n"))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranks = counts.withColumn("__upto", F.sum("__n").over(over.orderBy(p_col))).withColumn("__m", F.sum("__n").over(over))
    cut = ranks.filter(F.col(p_col) <= F.col("__upto") / F.col("__m") * q).groupBy(*keys).agg(F.max(p_col).alias("__cut"))
    if keys:
        joined = candidates.join(cut, keys, "left")
    else:
        joined = candidates.withColumn("__cut", F.lit(cut.first()["__cut"]).cast("double"))  # one number
    return joined.withColumn("accepted", F.coalesce(F.col(p_col) <= F.col("__cut"), F.lit(False))).drop("__cut")


def validated(candidates: DataFrame, q: float = 0.05, family: str | None = None) -> DataFrame:
    """Candidates with enough support and surprise that pass `false_discovery`, in order of effect."""
    floors = candidates.filter((F.col("support") >= MIN_SUPPORT) & (F.col("surprise") >= MIN_SURPRISE))
    return false_discovery(floors, q, family).filter("accepted").drop("accepted")


def day_series(mentions: DataFrame) -> DataFrame:
    """(entity, nth, day, entry): mentions of each entity by day, numbered from 0, days may repeat."""
    rows = mentions.filter("day is not null").select("entity", "day", "entry").distinct()
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("entity").orderBy("day", "entry")) - 1)


def lag_counts(mentions: DataFrame, max_lag: int = MAX_LAG, tolerance: int = TOLERANCE, together: int = TOGETHER) -> DataFrame:
    """(a, b, lag, selected, held_out): of a's mentions those with one of b about ``lag`` days on.

    Odd mentions of a select the lag, even ones test it.  Mentions of a day are summed up first, and a
    row holds all days of an entity; the entities are in groups of about ``together``, and each two groups
    are compared in a task, so no pair of mentions is ever made.
    """
    series = day_series(mentions)
    odd = F.col("nth") % 2
    days = series.groupBy("entity", "day").agg(F.sum(odd).cast("double").alias("odd"), F.sum(1 - odd).cast("double").alias("even"))
    day = F.array_sort(F.collect_list(F.struct(F.col("day").cast("bigint").alias("day"), "odd", "even")))
    packed = days.groupBy("entity").agg(F.sum(F.col("odd") + F.col("even")).alias("n"), day.alias("d")).filter(F.col("n") >= MIN_MENTIONS)
    packed = materialise(packed.select("entity", F.col("d.day").alias("day"), F.col("d.odd").alias("odd"), F.col("d.even").alias("even")))
    groups = max(1, -(-packed.count() // together))
    own, other = F.pmod(F.xxhash64("entity"), F.lit(groups)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    left = packed.select(own.alias("ga"), other.alias("gb"), F.lit(0).alias("side"), "*")
    right = packed.select(other.alias("ga"), own.alias("gb"), F.lit(1).alias("side"), "*")
    kind = dict(mentions.dtypes)["entity"]
    return left.unionByName(right).groupBy("ga", "gb").applyInPandas(_lags_of(max_lag, tolerance), f"a {kind}, b {kind}, lag int, selected bigint, held_out bigint")


def _lags_of(max_lag: int, tolerance: int):
    """Counts for each a of side 0 and each b of side 1."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"a": [], "b": [], "lag": [], "selected": [], "held_out": []})]
        left, right = rows[rows.side == 0], rows[rows.side == 1]
        if len(left) and len(right):
            own = [np.asarray(d, np.int64) for d in left.day]
            after = [np.asarray(d, np.int64) for d in right.day]
            every = np.unique(np.concatenate(own + after))
            # Times without a mention are cut to what no lag reaches over.
            place = np.concatenate([[0], np.cumsum(np.minimum(np.diff(every), max_lag + tolerance + 1))])
            asked = np.unique(np.concatenate(own))
            sums = np.zeros((2 * len(left), len(asked)))
            for i, (d, odd, even) in enumerate(zip(own, left.odd, left.even)):
                at = np.searchsorted(asked, d)
                sums[i, at], sums[len(left) + i, at] = odd, even
            spot, lags = place[np.searchsorted(every, asked)], np.arange(max_lag + 1)
            low, high = np.maximum(lags - tolerance, 0), lags + tolerance + 1
            names = left.entity.to_numpy()
            for b, d in zip(right.entity, after):
                there = np.zeros(place[-1] + max_lag + tolerance + 2, np.int32)
                there[place[np.searchsorted(every, d)] + 1] = 1
                upto, counts = np.cumsum(there), np.zeros((len(sums), len(lags)))
                upto = np.concatenate([upto, np.full(2, upto[-1])])
                for x in range(0, len(asked), 8192):
                    some = spot[x : x + 8192, None]
                    counts += sums[:, x : x + 8192] @ (upto[some + high] > upto[some + low]).astype(np.float64)
                selected, held = counts[: len(left)], counts[len(left) :]
                i, lag = np.nonzero((selected + held > 0) & (names != b)[:, None])
                parts.append(pd.DataFrame({"a": names[i], "b": b, "lag": lag, "selected": selected[i, lag], "held_out": held[i, lag]}))
        return pd.concat(parts[1:] or parts).astype({"a": object, "b": object, "lag": np.int32, "selected": np.int64, "held_out": np.int64})

    return run


def best_lags(counts: DataFrame) -> DataFrame:
    """(a, b, lag, selected, held_out) with the lag that most selecting mentions support, the smallest of equals."""
    best = counts.filter("selected > 0").groupBy("a", "b").agg(F.max_by(F.struct("lag", "selected", "held_out"), F.struct("selected", -F.col("lag"))).alias("best"))
    return best.select("a", "b", "best.*")


def temporal_leads(mentions: DataFrame, max_lag: int = MAX_LAG, tolerance: int = TOLERANCE, min_ratio: float = MIN_RATIO) -> DataFrame:
    """(a, b, lag, support, effect, p_value): b follows a about ``lag`` days later.

    The p-value is exact: b's days are shifted round the whole period, and every shift counts at
    which as many held-out mentions of a meet one of b.
    """
    best = materialise(best_lags(lag_counts(mentions, max_lag, tolerance)))
    series = materialise(day_series(mentions))
    sizes = series.groupBy("entity").agg(F.count("*").alias("n"))
    period = int((mentions.agg(F.max("day")).first()[0] or 0) + 1)
    full = F.col("selected") + F.col("held_out")
    sized = best.join(sizes.select(F.col("entity").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("entity").alias("b"), F.col("n").alias("nb")), "b")
    good = sized.filter((full >= MIN_COUNT) & (full >= F.col("na") * min_ratio) & (F.col("held_out") >= MIN_TEST))
    # At most one element for each day of the period.
    held = series.filter("nth % 2 = 0").groupBy(F.col("entity").alias("a"), "day").agg(F.count("*").alias("n")).groupBy("a").agg(F.collect_list("day").alias("days"), F.collect_list("n").alias("times"))
    smear = series.select(F.col("entity").alias("b"), F.explode(F.array(*(F.pmod(F.col("day") + d, F.lit(period)) for d in range(-tolerance, tolerance + 1)))).alias("spot")).groupBy("b").agg(F.collect_set("spot").alias("spots"))
    p = good.select("a", "b", "held_out").join(held, "a").join(smear, "b").select("a", "b", "held_out", "days", "times", "spots").mapInPandas(_shift_test(period), "a string, b string, p_value double")
    effect = full / F.sqrt(F.col("na") * F.col("nb").cast("double"))
    return good.join(p, ["a", "b"]).select("a", "b", "lag", full.alias("support"), F.round(effect, 6).alias("effect"), "p_value")


def _shift_test(period: int):
    """For pairs of day series, how often a shift round the period meets as often as was seen."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, b, seen, days, times, spots in batch.itertuples(index=False):
                held, smear = np.zeros(period), np.zeros(period)
                np.add.at(held, np.asarray(days), np.asarray(times))
                smear[np.asarray(spots)] = 1
                meets = np.rint(np.fft.irfft(np.conj(np.fft.rfft(held)) * np.fft.rfft(smear), period))
                out.append((a, b, round(float((meets >= seen).sum()) / period, 6)))
            yield pd.DataFrame(out, columns=["a", "b", "p_value"])

    return run


def lead_evidence(leads: DataFrame, mentions: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """(a, b, entry_a, entry_b): for each mention of a the first of b within the window of its lag."""
    series = materialise(day_series(mentions))
    a = series.select(F.col("entity").alias("a"), F.col("day").alias("da"), F.col("entry").alias("entry_a"))
    first = series.groupBy(F.col("entity").alias("b"), F.col("day").alias("db")).agg(F.min("entry").alias("entry_b"))
    low, high = F.col("da") + F.greatest(F.col("lag") - tolerance, F.lit(0)), F.col("da") + F.col("lag") + tolerance
    # What follows a day of a is looked up once for all mentions of that day.
    days = leads.select("a", "b", "lag").distinct().join(a.select("a", "da").distinct(), "a").withColumn("db", F.explode(F.sequence(low, high))).join(first, ["b", "db"])
    after = days.groupBy("a", "b", "da").agg(F.min_by("entry_b", F.struct("db", "entry_b")).alias("entry_b"))
    return after.join(a, ["a", "da"]).select("a", "b", "entry_a", "entry_b")


def reversals(praise: DataFrame, regret: DataFrame) -> DataFrame:
    """(entity, praised, regretted, evidence) where some regret is dated after some praise.

    Both tables have (entity, day, entry); the evidence is all their entries.
    """
    both = praise.select("entity", "day", "entry", F.lit(True).alias("good")).unionByName(regret.select("entity", "day", "entry", F.lit(False).alias("good"))).filter("day is not null")
    rows = both.groupBy("entity").agg(F.min(F.when(F.col("good"), F.col("day"))).alias("praised"), F.max(F.when(~F.col("good"), F.col("day"))).alias("regretted"), F.array_sort(F.collect_set("entry")).alias("evidence"))
    return rows.filter("regretted > praised")


def cited(narrations: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, text, citations) of narrations that cite something, and only evidence of their candidate."""
    return narrations.join(candidates.select("id", "evidence"), "id").filter((F.size("citations") > 0) & (F.size(F.array_except("citations", "evidence")) == 0)).select("id", "text", "citations")


#: Kinds of findings by number (fixed values), and the false-discovery rate of each.
KINDS = {"bridge": 1, "lead": 2, "reversal": 3}
RATES = {"bridge": 0.05, "lead": 0.01, "reversal": 0.01}
CANDIDATE = ["kind", "entity", "claim", "evidence", "support", "surprise", "effect", "p_value"]


def bridge_candidates(mentions: DataFrame) -> DataFrame:
    """Candidates from `structural_bridges`, with the entries that stand for the two clusters."""
    found = structural_bridges(mentions)
    rows = mentions.select("entity", "cluster", "entry").distinct().join(found.select("entity", "c1", "c2"), "entity").filter("cluster = c1 or cluster = c2")
    held = rows.groupBy("entity").agg(F.array_sort(F.collect_set("entry")).alias("evidence"))
    claim = F.format_string("%s stands both with %s and with %s, which few others do", "entity", "c1", "c2")
    return found.join(held, "entity").select(F.lit("bridge").alias("kind"), "entity", claim.alias("claim"), "evidence", "support", "surprise", F.col("surprise").alias("effect"), "p_value")


def lead_candidates(mentions: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """Candidates from `temporal_leads`, with the entries of each pair of mentions."""
    found = temporal_leads(mentions, max_lag)
    pairs = lead_evidence(found, mentions)
    held = pairs.groupBy("a", "b").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("entry_a", "entry_b"))))).alias("evidence"))
    claim = F.format_string("%s comes about %d days after %s", "b", "lag", "a")
    return found.join(held, ["a", "b"]).select(F.lit("lead").alias("kind"), F.col("a").alias("entity"), claim.alias("claim"), "evidence", "support", F.col("effect").alias("surprise"), "effect", "p_value")


def reversal_candidates(praise: DataFrame, regret: DataFrame) -> DataFrame:
    """Candidates from `reversals`; nothing in them is left to chance."""
    claim = F.format_string("%s was spoken well of on day %d and badly on day %d", "entity", "praised", "regretted")
    one = F.lit(1.0)
    return reversals(praise, regret).select(F.lit("reversal").alias("kind"), "entity", claim.alias("claim"), "evidence", F.lit(2).cast("bigint").alias("support"), one.alias("surprise"), one.alias("effect"), F.lit(0.0).alias("p_value"))


def numbered(candidates: DataFrame) -> DataFrame:
    """Adds ``id``: the number of the kind above a place within it, by entity and claim."""
    from lorespark.operators.store import dense_ids

    kind = F.create_map(*(x for k, n in KINDS.items() for x in (F.lit(k), F.lit(n).cast("bigint"))))
    placed = dense_ids(candidates, ["kind", "entity", "claim"], "__nth")
    first = placed.groupBy("kind").agg(F.min("__nth").alias("__first"))
    return placed.join(F.broadcast(first), "kind").withColumn("id", F.shiftleft(kind[F.col("kind")], 56).bitwiseOR(F.col("__nth") - F.col("__first"))).drop("__nth", "__first")


def discovered(candidates: DataFrame, rates: dict[str, float] | None = None, narrations: DataFrame | None = None) -> DataFrame:
    """(id, kind, entity, text, citations, effect, p_value) of the findings that hold.

    Each kind is validated for itself at its own rate.  A finding is told by its claim, or by a
    narration (id, text, citations) of a log; one that cites nothing, or more than its evidence, is left out.
    """
    every = materialise(numbered(candidates))
    parts = [validated(every.filter(F.col("kind") == k), q) for k, q in (rates or RATES).items()]
    kept = parts[0]
    for part in parts[1:]:
        kept = kept.unionByName(part)
    told = kept.select("id", F.col("claim").alias("text"), F.col("evidence").alias("citations"))
    if narrations is not None:
        told = told.join(narrations.select("id", F.col("text").alias("own"), F.col("citations").alias("cites")), "id", "left").select("id", F.coalesce("own", "text").alias("text"), F.coalesce("cites", "citations").alias("citations"))
    return cited(told, kept).join(kept.select("id", "kind", "entity", "effect", "p_value"), "id").select("id", "kind", "entity", "text", "citations", "effect", "p_value")


def finding_derivations(found: DataFrame, entries: DataFrame, method: int = 1, version: int = 1) -> DataFrame:
    """(output, input, method_id, method_version): what a finding's text was derived from, by content.

    The output is a hash of the text, the inputs those of the different texts cited.
    """
    cites = found.select(F.sha2("text", 256).alias("output"), F.explode("citations").alias("entry"))
    hashed = entries.select(F.col("id").alias("entry"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("input"))
    return cites.join(hashed, "entry").select("output", "input").distinct().select("output", "input", F.lit(method).alias("method_id"), F.lit(version).cast("bigint").alias("method_version"))
