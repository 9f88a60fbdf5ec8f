"""Valid vectors, classes of equal ones, and shards of similar ones.

Equal vectors are one class, so that a vector repeated a million times is searched once.  The
classes are spread over shards by the nearest of some centroids, fitted on a bounded sample; cells
of the centroids are packed into shards of bounded size, centroids that lie close together count
as one cell, and a cell that is too large is spread over several shards by hash.  A vector also
visits the shards of cells that are nearly as near as its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.session import materialise

#: Rows of a shard; centroids for each shard, at most; sampled vectors for each centroid; how much
#: less similar than its own a cell may be to be visited; centroids at least this similar are one cell.
SHARD_ROWS, CELLS, MOST_CELLS, SAMPLE, MARGIN, SAME_CELL = 24576, 8, 2048, 128, 0.15, 0.6
#: Vectors compared with all centroids at a time.
BLOCK = 2048


def valid_vectors(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """(vec_id, v) of the rows whose array has exactly ``dim`` finite numbers, not all zero.

    Rows with another ``dim``, a null id, a null array or null elements are not valid.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = (F.col("dim") == dim) & (F.size("v") == dim) & finite & F.exists("v", lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & good).select("vec_id", "v")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = np.asarray(batch.column(1).flatten(), np.float32).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.float32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in v], pa.binary()), batch.column(2)], ["rep", "vec", "copies"])


@dataclass
class Classes:
    """Equal vectors taken together: ``heads`` has (rep, vec, copies) for each different vector,
    ``repeated`` (vec_id, rep) for all members of classes of more than one."""

    heads: DataFrame
    repeated: DataFrame


def classes(valid: DataFrame) -> Classes:
    by_v = valid.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    kind = dict(valid.dtypes)["vec_id"]
    heads = materialise(by_v.select("rep", "v", "copies").mapInArrow(_pack, f"rep {kind}, vec binary, copies bigint"))
    shared = by_v.filter("copies > 1").select("v", "rep")
    return Classes(heads, materialise(valid.join(shared, "v").select("vec_id", "rep")))


def unit(packed: pd.Series, count: int | None = None) -> np.ndarray:
    """The packed vectors (``count``, if several are packed together) as rows of length one, in double precision."""
    v = np.frombuffer(b"".join(packed), np.float32).reshape(len(packed) if count is None else count, -1).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; of the sample's rows every few are the first centroids.

    The sample is gone through in blocks, so memory beside it grows with the count only.
    """
    centres = sample[:: max(1, len(sample) // max(count, 1))][:count].astype(np.float64)
    for _ in range(rounds):
        sums, there = np.zeros_like(centres), np.ascontiguousarray(centres.T, sample.dtype)
        for at in range(0, len(sample), BLOCK):
            some = sample[at : at + BLOCK]
            np.add.at(sums, (some @ there).argmax(axis=1), some)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def sampled(heads: DataFrame, most: int, total: int) -> np.ndarray:
    """The vectors whose ids hash lowest, at most ``most``, in single precision and of length one.

    Tasks leave out by a bound of the hash what can't be among them, so nothing is sorted or
    gathered but the sample, and it comes in Arrow's form.
    """
    share = (most + 6 * math.sqrt(most)) / max(total, 1)
    hashed = heads.select(F.xxhash64("rep").alias("hash"), "rep", "vec")
    rows = (hashed if share >= 1 else hashed.filter(F.col("hash") < int((share - 0.5) * 2.0**64))).toArrow()
    order = np.lexsort((rows.column("rep").to_numpy(), rows.column("hash").to_numpy()))[:most]
    width = len(rows.column("vec")[0].as_py()) if rows.num_rows else 0
    packed = [np.frombuffer(x.cast(pa.binary(width)).buffers()[1], np.float32).reshape(-1, width // 4)[x.offset : x.offset + len(x)] for x in rows.column("vec").chunks if len(x)]
    v = np.concatenate(packed)[order] if packed else np.zeros((0, 1), np.float32)
    for at in range(0, len(v), BLOCK):
        some = v[at : at + BLOCK].astype(np.float64)
        v[at : at + BLOCK] = some / np.linalg.norm(some, axis=1, keepdims=True)
    return v


@dataclass
class Shards:
    """Where vectors go: ``of`` has the shards of each cell, ``pairs`` of each cell with several
    shards the first of those where two of them meet."""

    centres: np.ndarray
    cell: np.ndarray
    of: dict[int, list[int]] = field(default_factory=dict)
    count: int = 1
    labels: list[int] = field(default_factory=list)
    pairs: dict[int, int] = field(default_factory=dict)

    def with_pairs(self) -> Shards:
        """Adds a shard for each two of those that a cell is spread over."""
        for c, parts in sorted(self.of.items()):
            if len(parts) > 1:
                self.pairs[c] = self.count
                self.count += len(parts) * (len(parts) - 1) // 2
        return self

    def pair(self, c: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The shards where the parts a and b of a cell meet, a being less than b."""
        return self.pairs[c] + a * len(self.of[c]) - a * (a + 1) // 2 + b - a - 1

    def label(self, shard: int) -> int:
        """A number for the shard that Spark hashes to a partition of its own among ``count``."""
        if len(self.labels) != self.count:
            free, number = {}, 0
            while len(free) < self.count:
                free.setdefault(_murmur(number) % self.count, number)
                number += 1
            self.labels = [free[i] for i in range(self.count)]
        return self.labels[shard]

    def likeness(self, u: np.ndarray) -> np.ndarray:
        """Of each vector to each cell: to the nearest of its centroids."""
        order = np.argsort(self.cell, kind="stable")
        there, first = np.ascontiguousarray(self.centres[order].T, np.float32), np.searchsorted(self.cell[order], np.arange(self.cell.max() + 1))
        out = np.empty((len(u), len(first)), np.float32)
        for at in range(0, len(u), BLOCK):
            out[at : at + BLOCK] = np.maximum.reduceat(u[at : at + BLOCK].astype(np.float32) @ there, first, axis=1)
        return out


def plan_shards(heads: DataFrame, shard_rows: int = SHARD_ROWS, part_rows: int | None = None) -> Shards:
    """Centroids from a sample of at most SAMPLE * MOST_CELLS vectors, and the shards of their cells.

    A cell of more than ``part_rows`` (as many as a shard has, if not given) is spread by hash.  To the driver come the sample and one count for each cell.
    """
    total = heads.count()
    count = max(1, min(MOST_CELLS, CELLS * math.ceil(total / shard_rows))) if total > shard_rows else 1
    if count == 1:
        return Shards(np.zeros((1, 1)), np.zeros(1, int), {0: [0]})
    centres = fit_centroids(sampled(heads, SAMPLE * count, total), count)
    count = len(centres)
    close, cell = centres @ centres.T >= SAME_CELL, np.full(count, -1)
    for c in range(count):
        if cell[c] < 0:
            todo, cell[c] = [c], (number := cell.max() + 1)
            while todo:
                new = np.flatnonzero(close[todo.pop()] & (cell < 0))
                cell[new] = number
                todo += new.tolist()
    shards = Shards(centres, cell)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"cell": shards.likeness(unit(batch.vec)).argmax(axis=1)})

    sizes = {r.cell: r.n for r in heads.select("vec").mapInPandas(cells, "cell int").groupBy("cell").agg(F.count("*").alias("n")).collect()}
    number = 0
    for c, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        if n > shard_rows:
            parts = math.ceil(n / (part_rows or shard_rows))
            shards.of[c] = list(range(number, number + parts))
            number += parts
    # Cells that are like each other share a shard, so what visits one of them seldom needs another.
    middle = np.stack([centres[cell == c].sum(axis=0) for c in range(cell.max() + 1)])
    middle /= np.maximum(np.linalg.norm(middle, axis=1, keepdims=True), 1e-9)
    left = {c: n for c, n in sizes.items() if c not in shards.of}
    while left:
        c = max(left, key=lambda c: (left[c], -c))
        room, whole = shard_rows, np.zeros(centres.shape[1])
        while c is not None:
            n = left.pop(c)
            shards.of[c], room, whole = [number], room - n, whole + n * middle[c]
            c = max((x for x in left if left[x] <= room), key=lambda x: (float(middle[x] @ whole), -x), default=None)
        number += 1
    shards.count = number
    return shards


def route(heads: DataFrame, shards: Shards, margin: float = MARGIN) -> DataFrame:
    """(shard, rep, vec, side) of each vector in its own shard and in those it visits.

    ``side`` is 1 in its own shard and 0 where it visits.  Of a cell spread over several shards it
    visits all; its own meet two by two in the shards of `Shards.pair`, one with side 2, one with 3.
    """
    kind = dict(heads.dtypes)["rep"]
    shards.label(0)  # made once, not in every task

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            like = shards.likeness(unit(batch.vec)) if shards.count > 1 else np.ones((len(batch), 1))
            own = like.argmax(axis=1)
            visits = like >= like.max(axis=1, keepdims=True) - margin
            salt = pd.util.hash_array(batch.rep.to_numpy(np.int64)).astype(np.uint64)
            rows = [np.zeros((3, 0), np.int64)]
            add = lambda i, shard, side: rows.append(np.array(np.broadcast_arrays(i, shard, side), np.int64))
            for c in np.flatnonzero(visits.any(axis=0)).tolist():
                i, parts = np.flatnonzero(visits[:, c]), shards.of.get(c, [])
                if len(parts) == 1:
                    add(i, parts[0], own[i] == c)
                elif parts:
                    for shard in parts:
                        add(i[own[i] != c], shard, 0)
                    i = i[own[i] == c]
                    part = (salt[i] % np.uint64(len(parts))).astype(np.int64)
                    add(i, np.array(parts)[part], 1)
                    for other in range(len(parts)):
                        some = part != other
                        add(i[some], shards.pair(c, np.minimum(part[some], other), np.maximum(part[some], other)), np.where(part[some] < other, 2, 3))
            i, shard, side = np.hstack(rows)
            order = np.lexsort((-side, shard, i))  # of cells that share a shard one visit is enough
            i, shard, side = i[order], shard[order], side[order]
            first = np.r_[True, (i[1:] != i[:-1]) | (shard[1:] != shard[:-1])][: len(i)]
            i, shard, side = i[first], shard[first], side[first]
            yield pd.DataFrame({"shard": np.array(shards.labels)[shard], "rep": batch.rep.to_numpy()[i], "vec": batch.vec.to_numpy()[i], "side": side})

    return heads.select("rep", "vec").mapInPandas(run, f"shard int, rep {kind}, vec binary, side int")


def _murmur(value: int) -> int:
    """Spark's hash of an int, by which rows are given to partitions."""
    mask = 0xFFFFFFFF
    turn = lambda x, n: (x << n | x >> 32 - n) & mask
    k = turn((value & mask) * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h = (turn(42 ^ k, 13) * 5 + 0xE6546B64 & mask) ^ 4
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def spread(routed: DataFrame, shards: Shards) -> DataFrame:
    """Each shard in a partition of its own: its label hashes to no other shard's partition."""
    return routed.repartition(max(1, shards.count), "shard")
