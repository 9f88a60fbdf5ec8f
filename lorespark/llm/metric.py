"""All pairs of strings within one edit of each other, by partitioning their metric space.

The metric is the unrestricted Damerau-Levenshtein distance.  A tree of pivots, taken from a bounded
sample, splits the space: at each pivot a string's home is the inner or the outer side of a sphere
that halves the sample.  By the triangle inequality a string within one edit of another is at most
one step from the sphere on the other's side, so a string at most that near to it is replicated to
the other side as well.  In each leaf its homes are compared with all strings that came there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that the tree is planned on; strings of a leaf; pivots tried for a split; edits; strings
#: that a task places or compares, about.
SAMPLE, LEAF, TRIES, RADIUS, TASK = 4096, 192, 6, 1, 4096


def codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of character codes, 0 past the end, and their lengths."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    out = np.zeros((len(strings), int(size.max(initial=0)) + 2), np.int32)
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.int32)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat
    return out, size


def distances(pivot: str, text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The distance of each string to the pivot, for all strings at once."""
    count, width = len(text), int(size.max(initial=0))
    a = [ord(c) for c in pivot]
    rows = np.arange(count)
    table = np.zeros((len(a) + 1, width + 1, count), np.int16)
    table[0] = np.arange(width + 1, dtype=np.int16)[:, None]
    table[:, 0] = np.arange(len(a) + 1, dtype=np.int16)[:, None]
    for i in range(1, len(a) + 1):
        column = np.zeros(count, np.int64)  # the last place in the string of the pivot's letter
        for j in range(1, width + 1):
            letter = text[:, j - 1]
            same = letter == a[i - 1]
            best = np.minimum(table[i - 1, j - 1] + ~same, np.minimum(table[i - 1, j], table[i, j - 1]) + 1)
            if i > 1 and j > 1:
                row = np.zeros(count, np.int64)  # the last place before i in the pivot of the string's letter
                for k in range(1, i):
                    row[letter == a[k - 1]] = k
                swap = (row > 0) & (column > 0)
                if swap.any():
                    r, c, n = row[swap], column[swap], rows[swap]
                    best[swap] = np.minimum(best[swap], table[r - 1, c - 1, n] + (i - r - 1) + 1 + (j - c - 1))
            table[i, j] = best
            column[same] = j
    return table[len(a), size, rows]


@dataclass
class Ball:
    """A split of the space, or a leaf."""

    leaf: int
    pivot: str = ""
    radius: int = 0
    inner: Ball | None = None
    outer: Ball | None = None


def plan(sample: list[str], total: int, leaf: int = LEAF) -> Ball:
    """Splits until a leaf would hold about ``leaf`` strings of the whole."""
    number = iter(range(1 << 30))

    def split(members: list[str]) -> Ball:
        if len(members) < 4 or len(members) * total / max(1, len(sample)) <= leaf:
            return Ball(next(number))
        text, size = codes(members)
        best = None
        for pivot in members[:: max(1, len(members) // TRIES)][:TRIES]:
            d = distances(pivot, text, size)
            radius = int(np.median(d)) + 1
            edge = ((d >= radius - RADIUS) & (d < radius + RADIUS)).sum()
            inside = int((d < radius).sum())
            cost = edge + abs(2 * inside - len(members))
            if 0 < inside < len(members) and (best is None or cost < best[0]):
                best = cost, pivot, radius, d
        if best is None:
            return Ball(next(number))
        _, pivot, radius, d = best
        return Ball(-1, pivot, radius, split([m for m, x in zip(members, d) if x < radius]), split([m for m, x in zip(members, d) if x >= radius]))

    return split(sample)


def place(tree: Ball, strings: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each leaf: its number, the strings that come there, and which have their home there."""
    text, size = codes(strings)
    todo = [(tree, np.arange(len(strings)), np.ones(len(strings), bool))]
    while todo:
        ball, rows, home = todo.pop()
        if not len(rows):
            continue
        if ball.inner is None:
            yield ball.leaf, rows, home
            continue
        d = distances(ball.pivot, text[rows], size[rows])
        inner, outer = d < ball.radius + RADIUS, d >= ball.radius - RADIUS
        todo.append((ball.inner, rows[inner], (home & (d < ball.radius))[inner]))
        todo.append((ball.outer, rows[outer], (home & (d >= ball.radius))[outer]))


def within_one(a: list[str], b: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the different strings a[i] and b[j] at distance 1."""
    ta, na = codes(a)
    tb, nb = codes(b)
    width = max(ta.shape[1], tb.shape[1])
    ta, tb = np.pad(ta, ((0, 0), (0, width - ta.shape[1]))), np.pad(tb, ((0, 0), (0, width - tb.shape[1])))
    # The ends of the strings, written backwards.
    back = lambda t, n: np.take_along_axis(t, np.maximum(n[:, None] - 1 - np.arange(width), 0), 1) * (np.arange(width) < n[:, None])
    ra, rb = back(ta, na), back(tb, nb)
    step = max(1, 4_000_000 // max(1, len(b) * width))
    for at in range(0, len(a), step):
        s = slice(at, at + step)
        prefix = np.logical_and.accumulate((ta[s, None] == tb[None]) & (ta[s, None] > 0), axis=2).sum(axis=2)
        suffix = np.logical_and.accumulate((ra[s, None] == rb[None]) & (ra[s, None] > 0), axis=2).sum(axis=2)
        x, y = na[s, None], nb[None]
        low, gap = np.minimum(x, y), np.abs(x - y)
        shared = prefix + suffix
        near = ((gap == 1) & (shared >= low)) | ((gap == 0) & (shared >= low - 1) & (prefix < low))
        swap = (gap == 0) & (shared == low - 2)
        i, j = np.nonzero(swap)
        p = prefix[i, j]
        turned = (ta[at + i, p] == tb[j, p + 1]) & (ta[at + i, p + 1] == tb[j, p])
        near[i[turned], j[turned]] = True
        i, j = np.nonzero(near)
        yield at + i, j


def _one_edit(a: str, b: str) -> bool:
    """Whether the distance of two different strings is 1."""
    i, end = 0, min(len(a), len(b))
    while i < end and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    return a[1:] == b[1:] or a == b[1:] or a[1:] == b or (len(a) > 1 and a[:2] == b[1::-1] and a[2:] == b[2:])


def _by_deletions(homes: list[str], every: list[str]) -> Iterator[tuple[str, str]]:
    """The pairs by keys that two strings one edit apart share: each whole, or without one letter."""
    keys = lambda s: {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}
    held: dict[str, list[str]] = {}
    for s in every:
        for key in keys(s):
            held.setdefault(key, []).append(s)
    for a in homes:
        yield from ((a, b) for b in sorted({b for key in keys(a) for b in held.get(key, ())}) if b != a and _one_edit(a, b))


def leaf_pairs(homes: list[str], every: list[str], leaf: int = LEAF) -> Iterator[tuple[str, str]]:
    """(a, b): strings at home in a leaf and those that came there at distance 1.

    All are compared with all in a leaf of the planned size.  In one that holds far more, as where
    the sample was too small or no pivot splits the strings, only those that share a key are.
    """
    if len(every) > 8 * leaf:
        yield from _by_deletions(homes, every)
    elif homes:
        for i, j in within_one(homes, every):
            yield from ((homes[x], every[y]) for x, y in zip(i, j))


def pairs_within_one(strings: DataFrame, column: str, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """(a, b) with a < b: each pair of different strings of the column one edit apart, once.

    Null strings have no pairs.  At most ``sample`` strings come to the driver.
    """
    keys = strings.select(F.col(column).alias("key")).filter("key is not null").distinct()
    total = keys.count()
    some = [r.key for r in keys.orderBy(F.xxhash64("key"), "key").limit(sample).collect()]
    tree = plan(some, total, leaf)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.key.iloc[at : at + 4096]
                for number, rows, home in place(tree, part.tolist()):
                    yield pd.DataFrame({"leaf": number, "key": part.to_numpy()[rows], "home": home})

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        # A pair is found at the home of either; it comes out at the home of the first.
        out = [p for p in leaf_pairs(sorted(rows.key[rows.home]), sorted(rows.key), leaf) if p[0] < p[1]]
        return pd.DataFrame(out, columns=["a", "b"], dtype=object)

    parts = -(-total // TASK) or 1
    placed = keys.repartition(parts, "key").mapInPandas(spread, "leaf int, key string, home boolean")
    return placed.repartition(parts, "leaf").groupBy("leaf").applyInPandas(join, "a string, b string")
