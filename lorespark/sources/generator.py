"""Invented entries with planted answers, for demonstrations and tests of detectors."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

PEOPLE = "Anna Boris Clara Dmitri Elena Felix Greta Hugo Irina Jonas Katya Leon Mira Nils Olga Pavel".split()
PLACES = ["the mill", "the pier", "the library", "the workshop", "the garden"]
TOPICS = {"music": ["harmony", "rhythm", "tuning"], "craft": ["joinery", "glazing", "weaving"], "sea": ["tides", "sails", "knots"], "kitchen": ["dough", "broth", "pickles"]}
TOOLS = ["lathe", "kiln", "loom", "anvil", "stove"]
_QUIET = ["Quiet day, walked along {place}.", "Talked with {person} about {word}.", "Thought about {word} all morning.", "{person} was late at {place}."]


def generate(spark: SparkSession, seed: int = 42, years: int = 2, per_day: int = 2) -> dict[str, DataFrame]:
    """Tables entries, recall, multi_hop, temporal, contradictions and bridges.

    Everything planted names the ids of the entries that prove it; the same seed gives the same
    tables.  Ids follow day, then the order in which entries were planted.
    """
    pick = random.Random(seed)
    rows: list[tuple[int, str, str]] = []  # (day, kind, text), ids come later
    add = lambda day, text: rows.append((day, pick.choice(("text", "voice")), text)) or len(rows) - 1
    recall, hops, leads, flips, bridges = [], [], [], [], []
    for year in range(years):
        day = lambda spare=0: year * 365 + pick.randrange(365 - spare)
        for i in range(8):
            person, word = pick.choice(PEOPLE), f"cipher{year}x{i}"
            recall.append((f"Which word did {person} hide under {word}?", word, [add(day(), f"{person} told me the word {word} at {pick.choice(PLACES)}.")]))
        for i in range(4):
            a, b = pick.sample(PEOPLE, 2)
            place, book, at = pick.choice(PLACES), f"Book {year}-{i}", day(40)
            hops.append((f"What did the person {a} introduced me to recommend?", book, [add(at, f"{a} introduced me to {b} at {place}."), add(at + pick.randint(1, 30), f"The new contact from {place} recommended {book}.")]))
        a, b, lag = *pick.sample(TOOLS, 2), pick.randint(2, 6)
        pairs = [(add(d, f"Worked on the {a} until dark."), add(d + lag, f"Repaired the {b} again.")) for d in sorted(pick.sample(range(year * 365, year * 365 + 350), 6))]
        leads.append((a, b, lag, [x for x, _ in pairs], [y for _, y in pairs]))
        for _ in range(2):
            tool, at = pick.choice(TOOLS), day(60)
            flips.append((tool, add(at, f"{tool} is a joy to use."), add(at + pick.randint(10, 50), f"I regret buying the {tool}.")))
        person, (one, two) = pick.choice(PEOPLE), pick.sample(sorted(TOPICS), 2)
        bridges.append((person, one, two, [add(day(), f"{person} explained {pick.choice(TOPICS[c])} to me.") for c in (one, one, two, two)]))
    for d in range(years * 365):
        for _ in range(per_day):
            add(d, pick.choice(_QUIET).format(place=pick.choice(PLACES), person=pick.choice(PEOPLE), word=pick.choice(TOPICS[pick.choice(sorted(TOPICS))])))
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], i))
    new = {old: at for at, old in enumerate(order)}
    ids = lambda some: sorted(new[i] for i in some)
    make = spark.createDataFrame
    entries = make([(new[i], rows[i][0], rows[i][1], rows[i][2]) for i in order], "id bigint, day int, kind string, text string").selectExpr("id", "day", "cast(date_add(date'2018-01-01', day) as string) as date", "kind", "text")
    return {
        "entries": entries,
        "recall": make([(i, q, a, ids(e)) for i, (q, a, e) in enumerate(recall)], "id int, question string, answer string, relevant_entries array<bigint>"),
        "multi_hop": make([(i, q, a, [new[x] for x in e]) for i, (q, a, e) in enumerate(hops)], "id int, question string, answer string, hop_entries array<bigint>"),
        "temporal": make([(i, a, b, lag, ids(x), ids(y)) for i, (a, b, lag, x, y) in enumerate(leads)], "id int, leading string, trailing string, lag_days int, lead_entries array<bigint>, trail_entries array<bigint>"),
        "contradictions": make([(i, t, new[x], new[y]) for i, (t, x, y) in enumerate(flips)], "id int, topic string, entry_before bigint, entry_after bigint"),
        "bridges": make([(i, p, a, b, ids(e)) for i, (p, a, b, e) in enumerate(bridges)], "id int, entity string, cluster_a string, cluster_b string, supporting_entries array<bigint>"),
    }


def synthetic_vectors(spark: SparkSession, n: int, dim: int, blobs: int = 24, noise: float = 0.45, seed: int = 42) -> DataFrame:
    """(vec_id, embedding): unit vectors around blob centres, made in parallel, the same each time."""
    import numpy as np
    import pandas as pd

    def run(batches):
        centres = np.random.default_rng(seed).standard_normal((blobs, dim))
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
        for batch in batches:
            out = []
            for i in batch.id:
                rng = np.random.default_rng((seed, int(i)))
                v = centres[rng.integers(blobs)] + noise / np.sqrt(dim) * rng.standard_normal(dim)
                out.append((v / np.linalg.norm(v)).astype(np.float32))
            yield pd.DataFrame({"vec_id": batch.id, "embedding": out})

    return spark.range(n).mapInPandas(run, "vec_id bigint, embedding array<float>")
