"""Repeats of notes in new batches, found against all history through persisted blocking keys.

A note is reduced to folded words.  Its blocking keys are a few of its numbers and rarer words,
each with the two days it was noted in.  A new batch is probed against the keys of accepted notes
of the days it touches only; candidate pairs are compared field by field, the fields are weighed by
weights learned from candidates of the first batch, and a rule check follows that lets no number
and no name differ.  Of each cluster of like notes only changes are written: a row that maps an event to
another of its cluster.  A cluster may go on for longer than 48 hours, as notes do that are made
every day; it is walked in order of arrival, and an event that no earliest event of a note lies
within 48 hours of is the earliest of a further note.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.operators.components import connected_components
from lorespark.session import materialise, scratch_path

HOURS, SPAN = 48, 48 * 3600
#: Numbers and words of a note that become blocking keys; the share of notes from which on a word
#: is too common for that; pairs that the weights are learned from, at most.
NUMBERS, WORDS, COMMON, LEARN_PAIRS = 6, 5, 0.02, 20_000
#: Events of a step for each task that writes a month of it.
MONTH_ROWS = 250_000
#: Letters that look like others (fixed values: lower-case Cyrillic and Greek to Latin).
_LOOK = str.maketrans("авекмнорстухіјѕһԁԛԝαεικνορτυχ", "abekmhopctyxijshdqwaeiknoptux")
#: Words that people put in without meaning anything (fixed values).
FILLERS = frozenset("um uh er erm hmm mm well so like and also just basically actually okay ok anyway you know i mean".split()) | frozenset("äh ähm also und na ja y pues eh bueno и ну вот ах э".translate(_LOOK).split())
#: Words of marks that programs put before or after a text (fixed values).
MARKS = frozenset("fwd fw re note to self sent from my phone imported voice memo diary cut tbc draft copy via app reminder".split())
_WORD = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+")
_NUMBER = re.compile(r"[.,:/]")
_UNSEEN = regex.compile(r"[\p{Mn}\p{Cf}]+")


def fold(text: str) -> list[str]:
    """The words and numbers of a note without case, accents, unseen characters or look-alikes."""
    if text.isascii():
        text = text.lower()
    else:
        text = _UNSEEN.sub("", unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).casefold())).translate(_LOOK)
    return [_NUMBER.sub("", w) if w[0].isdigit() else w for w in _WORD.findall(text)]


def seconds(created):
    """Seconds of a time that may be in milliseconds (a column or a number)."""
    if isinstance(created, (int, float)):
        return created // 1000 if created >= 100_000_000_000 else created
    return F.when(created >= 100_000_000_000, F.floor(created / 1000)).otherwise(created).cast("bigint")


def keys_of(words: list[str], common: frozenset[str]) -> list[int]:
    """Hashes of some numbers and rarer words; of all words where there are too few."""
    different = set(words)
    numbers = {w for w in different if w[0].isdigit()}
    rare = {w for w in different - numbers if len(w) > 3 and w not in common}
    low = lambda some, n: sorted(xxhash.xxh64_intdigest(w) >> 1 for w in some)[:n]
    out = low(numbers, NUMBERS) + low(rare, WORDS)
    return out if len(out) >= 3 else sorted({*out, *low(different, 3)})


@lru_cache(maxsize=200_000)
def near(a: str, b: str) -> bool:
    """A slip of one or, in long words, two letters; or one a short form of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < len(b) and a[0] == b[0] and len(a) <= 3 and len(b) >= 4:
        it = iter(b)
        if all(c in it for c in a):
            return True
    most = 1 if len(b) <= 5 else 2
    if len(b) - len(a) > most:
        return False
    two, one = None, list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        now = [i]
        for j in range(1, len(b) + 1):
            d = min(one[j] + 1, now[j - 1] + 1, one[j - 1] + (a[i - 1] != b[j - 1]))
            if two and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        two, one = one, now
    return one[-1] <= most


#: Products of word counts up to which all pairs of words are tried; letters up to which deletions
#: are keys of a word, and from which on pieces are (both where lengths two apart may meet).
FEW, DELETED, CUT = 400, 24, 22


def _deletions(word: str) -> set[str]:
    """The word without up to two letters, or one if it is too short for two slips."""
    out = {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}
    return out | {w[:i] + w[i + 1 :] for w in out if len(w) == len(word) - 1 for i in range(len(w))} if len(word) >= 4 else out


def _pieces(word: str) -> list[tuple[int, int]]:
    """Ends of five pieces; two slips, each of two neighbouring letters at most, leave one whole."""
    at = [len(word) * i // 5 for i in range(6)]
    return list(zip(at, at[1:]))


def _short_forms(word: str) -> set[str]:
    return {word[0], *(word[0] + a for a in word[1:]), *(word[0] + word[i] + word[j] for i in range(1, len(word)) for j in range(i + 1, len(word)))}


class NearWords:
    """The words near others among many, by keys that near words share."""

    def __init__(self, words: list[str]):
        self.places: dict[str, list[int]] = {}
        for i, w in reversed(list(enumerate(words))):
            self.places.setdefault(w, []).append(i)
        self.held: dict[tuple, list[str]] = {}
        for w in self.places:
            for key in self._held(w):
                self.held.setdefault(key, []).append(w)

    @staticmethod
    def _held(w: str) -> Iterator[tuple]:
        if len(w) <= DELETED:
            yield from (("slip", d) for d in _deletions(w))
        if len(w) > CUT:
            yield from (("piece", len(w), i, w[a:b]) for i, (a, b) in enumerate(_pieces(w)))
        if len(w) <= 3:
            yield "short", w
            yield "shorts", w[0]
        elif len(w) <= DELETED:
            yield from (("form", f) for f in _short_forms(w))
        else:
            yield "long", w[0]

    @staticmethod
    def _asked(w: str) -> Iterator[tuple]:
        if len(w) <= DELETED:
            yield from (("slip", d) for d in _deletions(w))
        if len(w) > CUT:
            for size in range(len(w) - 2, len(w) + 3):
                for i, (a, b) in enumerate(_pieces("." * size)):
                    yield from (("piece", size, i, w[a + s : b + s]) for s in range(max(-2, -a), 3))
        if len(w) <= 3:
            yield "form", w
            yield "long", w[0]
        elif len(w) <= DELETED:
            yield from (("short", f) for f in _short_forms(w))
        else:
            yield "shorts", w[0]

    def take(self, w: str) -> int | None:
        """The place of the first word near ``w``, which is no more among them afterwards."""
        some = {v for key in self._asked(w) for v in self.held.get(key, ()) if self.places[v]}
        for v in sorted(some, key=lambda v: self.places[v][-1]):
            if near(w, v):
                return self.places[v].pop()
        return None


def matched(wa: list[str], wb: list[str]) -> tuple[list[str], list[str], int]:
    """What is left of two lists when each word is paired with the first near one, and the pairs."""
    if len(wa) * len(wb) <= FEW:
        wa, wb, pairs = list(wa), list(wb), 0
        for w in list(wa):
            for v in wb:
                if near(w, v):
                    wa.remove(w)
                    wb.remove(v)
                    pairs += 1
                    break
        return wa, wb, pairs
    index, left, gone = NearWords(wb), [], set()
    for w in wa:
        at = index.take(w)
        if at is None:
            left.append(w)
        else:
            gone.add(at)
    return left, [v for i, v in enumerate(wb) if i not in gone], len(gone)


@lru_cache(maxsize=200_000)
def _letters(word: str) -> int:
    return sum(1 << x for x in {ord(c) & 63 for c in word})


def _alone(w: str, some: set[str]) -> bool:
    """Whether no word is near; two slips change four different letters at most."""
    if len(w) <= 3:
        return not any(near(w, v) for v in some)
    size, mine = len(w), _letters(w)
    return not any((len(v) <= 3 or (-2 <= len(v) - size <= 2 and (_letters(v) ^ mine).bit_count() <= 4)) and near(w, v) for v in some)


#: Words of each note that are tried for having no near one.
TRIED = 20

FEATURES = ("overlap_half", "overlap_most", "overlap_all", "numbers", "length", "hours", "rest")


def compare(a: list[str], b: list[str], gap: float, whole: bool = True) -> tuple[tuple[int, ...], bool]:
    """The fields in which two notes agree, and whether nothing in them speaks against one note.

    Unless ``whole``, the fields of notes that something speaks against may be left unfinished.
    """
    ca, cb = Counter(a), Counter(b)
    both = sum((ca & cb).values())
    share = both / max(1, min(len(a), len(b)))
    if share < 0.5:
        return (0, 0, 0, 0, 0, int(gap <= 7200), 0), False
    ra, rb = ca - cb, cb - ca
    na, nb = Counter({w: n for w, n in ra.items() if w[0].isdigit()}), Counter({w: n for w, n in rb.items() if w[0].isdigit()})
    # What one has more of: slips and short forms of the other's words, fillers, words said twice.
    wa = [w for w in ra.elements() if not w[0].isdigit()]
    wb = [w for w in rb.elements() if not w[0].isdigit()]
    twice = lambda w, other, own: w in other and w not in FILLERS and own[w] <= 2 * other[w]
    if not whole:
        # One note's words must all be near the other's, fillers, marks or said twice, see _one_sided.
        stay = lambda some, others, other, own: any(_alone(w, others) for w in islice((w for w in some if w not in FILLERS and w not in MARKS and not twice(w, other, own)), TRIED))
        if (na and nb) or (stay(wa, set(wb), cb, ca) and stay(wb, set(wa), ca, cb)):
            return (0,) * len(FEATURES), False
    if not (na and nb):
        wa, wb, pairs = matched(wa, wb)
        both += pairs
    wa = [w for w in wa if w not in FILLERS and not twice(w, cb, ca)]
    wb = [w for w in wb if w not in FILLERS and not twice(w, ca, cb)]
    fine = not (na and nb)
    if fine:
        fine = _one_sided(a, wa, wb, na, nb) or _one_sided(b, wb, wa, nb, na)
    like = both / max(1, min(len(a), len(b)))
    agree = (int(like >= 0.5), int(like >= 0.75), int(like >= 0.92), int(not (na and nb)), int(0.8 <= len(a) / len(b) <= 1.25), int(gap <= 7200), int(not (wa and wb)))
    return agree, fine and like >= 0.75


def _one_sided(whole: list[str], rest: list[str], other: list[str], numbers: Counter, other_numbers: Counter) -> bool:
    """Whether ``whole`` differs from the other note only by a lost end and short additions."""
    if other_numbers:
        return False
    extra = [w for w in other if w not in MARKS]
    lost = [w for w in rest if w not in MARKS]
    if not lost and not numbers:
        return len(extra) <= 5
    if extra:
        return False
    if not numbers and len(lost) <= 5 and (set(lost) & {*whole[:6], *whole[-6:]}) >= set(lost):
        return True
    if numbers and not lost:
        return False
    missing, places, left = Counter(lost) + numbers, [], len(whole)
    for i in range(len(whole) - 1, -1, -1):
        if missing[whole[i]] > 0:
            missing[whole[i]] -= 1
            places.append(i)
    span = max(places) - min(places) + 1
    return sum(len(whole[i]) for i in range(min(places), max(places) + 1)) <= 0.4 * sum(map(len, whole)) and span <= 0.4 * left + 2


DEFAULT = {"bias": -6.0, "agree": [1.0, 2.0, 2.0, 2.0, 1.0, 1.0, 3.0], "differ": [-6.0, -3.0, -1.0, -3.0, -0.5, -0.5, -1.5]}


def learn(vectors: np.ndarray, times: np.ndarray, rounds: int = 60) -> dict:
    """Weights of agreement and difference of each field, from pairs without labels.

    ``vectors`` are the different patterns of agreement, ``times`` how many pairs have each.  Pairs
    are a mixture of repeats and others whose fields agree independently; expectation maximisation
    finds how often they do in each, starting from pairs that agree in most.
    """
    if times.sum() < 50 or len(vectors) < 3:
        return DEFAULT
    p = np.clip(vectors.mean(axis=1) ** 2, 0.02, 0.98)
    for _ in range(rounds):
        yes, no = p * times, (1 - p) * times
        prior = np.clip(yes.sum() / times.sum(), 1e-3, 1 - 1e-3)
        m = np.clip((yes @ vectors + 0.5) / (yes.sum() + 1), 0.01, 0.99)
        u = np.clip((no @ vectors + 0.5) / (no.sum() + 1), 0.01, 0.99)
        x = np.log(prior / (1 - prior)) + vectors @ np.log(m / u) + (1 - vectors) @ np.log((1 - m) / (1 - u))
        p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    return {"bias": float(np.log(prior / (1 - prior))), "agree": np.log(m / u).tolist(), "differ": np.log((1 - m) / (1 - u)).tolist()}


def weigh(fields: tuple[int, ...], weights: dict) -> float:
    return weights["bias"] + sum(w if f else d for f, w, d in zip(fields, weights["agree"], weights["differ"]))


_RECORD = "event_id bigint, secs bigint, span bigint, canon bigint, words string, keys array<bigint>"
#: What is kept of copies in a batch and span: the first, and the first and last time of them all.
_KEPT = _RECORD + ", low bigint, high bigint, month int, step int"


def _prepared(events: DataFrame, common: frozenset[str]) -> DataFrame:
    """The notes that can be repeated: with an id, a time and words."""
    rows = events.filter("event_id is not null and created_utc_secs is not null and text is not null").select(F.col("event_id").cast("bigint").alias("event_id"), seconds(F.col("created_utc_secs")).alias("secs"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for event, secs, text in batch.itertuples(index=False):
                words = fold(text)
                if words:
                    canon = xxhash.xxh64_intdigest(" ".join(words)) >> 1
                    out.append((event, secs, secs // SPAN, canon, " ".join(words), keys_of(words, common)))
            yield pd.DataFrame(out, columns=["event_id", "secs", "span", "canon", "words", "keys"])

    return rows.mapInPandas(run, _RECORD)


def _compared(pairs: DataFrame, weights: dict | None) -> DataFrame:
    """Fields and score of pairs (new_id, old_id, new_words, old_words, gap); with weights only
    those taken for the same note."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for new, old, a, b, gap in batch.itertuples(index=False):
                fields, fine = compare(b.split(" "), a.split(" "), gap, whole=not weights)
                score = weigh(fields, weights) if weights else 0.0
                if not weights or (fine and score > 0):
                    out.append((new, old, list(fields), score))
            yield pd.DataFrame(out, columns=["new_id", "old_id", "fields", "score"])

    return pairs.select("new_id", "old_id", "new_words", "old_words", "gap").mapInPandas(run, "new_id bigint, old_id bigint, fields array<int>, score double")


@dataclass
class Linker:
    """What has been accepted so far, as tables in a folder all executors share."""

    spark: SparkSession
    folder: str
    common: frozenset[str] | None = None
    weights: dict | None = None
    batches: int = 0
    months: set = field(default_factory=set)

    @classmethod
    def new(cls, spark: SparkSession, folder: str | None = None) -> Linker:
        return cls(spark, folder or scratch_path(spark, "linkage"))

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if self.batches else self.spark.createDataFrame([], schema)

    def records(self) -> DataFrame:
        """Accepted notes; only the folders of months and steps that are filtered for are read."""
        return self._read("records", _KEPT)

    def parents(self) -> DataFrame:
        """(event_id, rep): events and another of their cluster, in the order found."""
        return self._read("parents", "event_id bigint, rep bigint")

    def _common_words(self, events: DataFrame) -> frozenset[str]:
        """Words in more than the share COMMON of the notes; at most a few for each word of a note."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                held = Counter(w for t in batch.text for w in set(fold(t)))
                yield pd.DataFrame({"word": ["", *held], "n": [len(batch), *held.values()]})

        counts = materialise(events.filter("text is not null").select("text").mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
        total = counts.filter("word = ''").first()  # one row: the number of notes
        least = max(3.0, COMMON * total.n) if total else 0.0
        return frozenset(r.word for r in counts.filter((F.col("word") != "") & (F.col("n") > least)).select("word").collect())

    def accept(self, events: DataFrame, months: list[int] | None = None, rows: int | None = None) -> None:
        """Takes in the next batch; its events must have arrived after all accepted ones.

        ``months`` are the numbers of the months it touches and ``rows`` its events, if they are known.
        """
        if self.common is None:
            self.common = self._common_words(events)
        every, step = _prepared(events, self.common).persist(), self.batches
        try:
            # Copies within a batch and span come to the first of them, before anything is compared.
            several = every.groupBy("canon", "span").agg(F.min("event_id").alias("first"), F.min("secs").alias("low"), F.max("secs").alias("high"), F.count("*").alias("n")).filter("n > 1").drop("n")
            copies = every.join(several, ["canon", "span"]).filter("event_id != first").select("event_id", F.col("first").alias("rep")).distinct()
            new = every.join(copies, "event_id", "left_anti").dropDuplicates(["event_id"]).join(several.drop("first"), ["canon", "span"], "left")
            new = new.select(*every.columns, F.coalesce("low", "secs").alias("low"), F.coalesce("high", "secs").alias("high"), month_of(F.col("span")).alias("month"), F.lit(step).alias("step"))
            # A month of very many notes is written by several tasks.
            new.repartition("month", F.pmod(F.xxhash64("event_id"), F.lit(max(1, -(-(every.count() if rows is None else rows) // MONTH_ROWS))))).write.mode("append").partitionBy("month", "step").parquet(f"{self.folder}/records")
            copies.write.mode("append").parquet(f"{self.folder}/parents")
        finally:
            every.unpersist()
        # From here on the batch is read as written, so no plan holds again how it was made.
        self.batches += 1
        records = self.records()
        new = records.filter(F.col("step") == step)
        touched = months if months is not None else [r.month for r in new.select("month").distinct().collect()]
        self.months |= set(touched)
        around = sorted({m + d for m in touched for d in (-1, 0, 1)} & self.months)
        self._mapped(self._links(new, records.filter(F.col("month").isin(around)))).write.mode("append").parquet(f"{self.folder}/parents")

    def _links(self, new: DataFrame, known: DataFrame) -> DataFrame:
        """(new_id, old_id): notes of the batch and accepted ones, its own too, that are one note."""
        probes = new.select(F.col("event_id").alias("new_id"), F.explode(F.array(*(F.col("span") + d for d in (-1, 0, 1)))).alias("span"), F.col("low").alias("new_low"), F.col("high").alias("new_high"), "keys").select("new_id", "span", "new_low", "new_high", F.size("keys").alias("new_keys"), F.explode("keys").alias("key"))
        held = known.select(F.col("event_id").alias("old_id"), "span", F.col("low").alias("old_low"), F.col("high").alias("old_high"), F.size("keys").alias("old_keys"), F.explode("keys").alias("key"))
        # How many keys two notes share is the first field: a third of those of either is the least.
        ids = probes.join(held, ["key", "span"]).filter("old_id < new_id and greatest(new_low - old_high, old_low - new_high) <= %d" % SPAN).groupBy("new_id", "old_id").agg(F.count("*").alias("shared"), F.min(F.least("new_keys", "old_keys")).alias("keys")).filter("shared >= floor(keys * 0.34)").select("new_id", "old_id")
        a = new.select(F.col("event_id").alias("new_id"), F.col("words").alias("new_words"), F.col("low").alias("new_low"), F.col("high").alias("new_high"))
        b = known.select(F.col("event_id").alias("old_id"), F.col("words").alias("old_words"), F.col("low").alias("old_low"), F.col("high").alias("old_high"))
        with_texts = lambda some: some.join(a, "new_id").join(b, "old_id").withColumn("gap", F.expr("greatest(new_low - old_high, old_low - new_high, 0)"))
        if self.weights is None:  # ids are chosen first, so no texts come to the driver
            ids = materialise(ids)
            few = ids.orderBy(F.xxhash64("new_id", "old_id"), "new_id", "old_id").limit(LEARN_PAIRS)
            fields = _compared(with_texts(few), None).groupBy("fields").agg(F.count("*").alias("n")).collect()  # at most 2 ** 7 rows
            self.weights = learn(np.array([list(r.fields) for r in fields], float).reshape(-1, len(FEATURES)), np.array([r.n for r in fields], float))
        return _compared(with_texts(ids), self.weights).select("new_id", "old_id")

    def _mapped(self, links: DataFrame) -> DataFrame:
        """Rows that map the batch's repeats, and clusters it joins, to the least of them."""
        old = links
        if self.batches > 1:
            up = self.parents().groupBy("event_id").agg(F.min("rep").alias("rep"))
            old = links.join(up.withColumnRenamed("event_id", "old_id"), "old_id", "left").select("new_id", F.coalesce("rep", "old_id").alias("old_id"))
        by_new = old.groupBy("new_id").agg(F.min("old_id").alias("rep"), F.collect_set("old_id").alias("roots"))
        return by_new.select(F.explode(F.concat(F.array("new_id"), "roots")).alias("event_id"), "rep").filter("event_id != rep")

    def clusters(self) -> DataFrame:
        """(event_id, cluster) of every event that is like another, by the least event of its cluster."""
        return connected_components(self.parents(), "rep", "event_id").select(F.col("node").alias("event_id"), F.col("component").alias("cluster"))


def anchored(members: DataFrame) -> DataFrame:
    """(event_id, dup_event_id): each repeat with the earliest event of its note.

    ``members`` (cluster, event_id, secs) are walked cluster by cluster in order of arrival.  An
    event repeats the earliest anchor at most 48 hours away; one without is an anchor itself.  A
    span of time has one anchor at most, and nothing else of a cluster is kept in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, anchors = None, {}
        for batch in batches:
            out = []
            for cluster, event, secs in zip(batch.cluster.tolist(), batch.event_id.tolist(), batch.secs.tolist()):
                if cluster != current:
                    current, anchors = cluster, {}
                at = secs // SPAN
                close = [anchors[x][0] for x in (at - 1, at, at + 1) if x in anchors and abs(anchors[x][1] - secs) <= SPAN]
                if close:
                    out.append((min(close), event))
                else:
                    anchors[at] = event, secs
            yield pd.DataFrame(out, columns=["event_id", "dup_event_id"])

    return members.select("cluster", "event_id", "secs").repartition("cluster").sortWithinPartitions("cluster", "event_id").mapInPandas(run, "event_id bigint, dup_event_id bigint")


def month_of(span):
    return F.floor(span / 15).cast("int")


def repeats(events: DataFrame, folder: str | None = None, share: float = 0.5) -> DataFrame:
    """(event_id, dup_event_id): each repeat with the earliest event of its note.

    Batches are accepted in the order of ``batch_id``, null ones last.  A backlog is taken in steps:
    as many batches at a time as hold half of what is accepted already, so there are few steps
    and none goes through more than it adds a few times; one batch at a time gives the same rows.
    Events without
    an id, a time or words repeat nothing; a repeat is noted at most 48 hours from the earliest, and
    one that is further from it than that begins a note of its own.
    Repeated rows are one event; an empty table gives an empty result.
    """
    spark = events.sparkSession
    linker = Linker.new(spark, folder)
    month = month_of(F.floor(seconds(F.col("created_utc_secs")) / SPAN))
    batches = events.select("batch_id", month.alias("month")).groupBy("batch_id").agg(F.collect_set("month").alias("months"), F.count("*").alias("n")).collect()  # batches and months only
    order = sorted(batches, key=lambda r: (r.batch_id is None, r.batch_id or 0))
    accepted, step = 0, []
    for r in order:
        step.append(r)
        if sum(x.n for x in step) >= accepted * share or r is order[-1]:
            some = F.col("batch_id").isin([x.batch_id for x in step if x.batch_id is not None])
            linker.accept(events.filter(some | F.col("batch_id").isNull() if any(x.batch_id is None for x in step) else some), sorted({m for x in step for m in x.months}), sum(x.n for x in step))
            accepted, step = accepted + sum(x.n for x in step), []
    if not order:
        return spark.createDataFrame([], T.StructType([T.StructField("event_id", T.LongType()), T.StructField("dup_event_id", T.LongType())]))
    times = events.filter("event_id is not null").groupBy(F.col("event_id").cast("bigint").alias("event_id")).agg(F.min(seconds(F.col("created_utc_secs"))).alias("secs"))
    return anchored(linker.clusters().join(times, "event_id"))
