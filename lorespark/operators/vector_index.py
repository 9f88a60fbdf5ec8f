"""An index of vectors by lists that is written once, opened and pruned, and codes of a few bits.

Vectors are kept by the list of their nearest centroid, as sign codes of what is left of them
without it.  A query reads only the folders of the lists it probes, ranks their members by estimate,
and the best are ranked again by true products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.vector import dot
from lorespark.operators.lexical import ranked
from lorespark.operators.search import SignCodes, exact_nearest, kmeans, matrix, nearest_centre, sample_rows

#: Bounds of the number of lists (fixed values); members of a list that are one part.
LEAST_LISTS, MOST_LISTS, PART_ROWS, VERSION = 64, 65_536, 200_000, 1


def auto_lists(n: int) -> int:
    """Four times the root of the number of vectors, within bounds."""
    return max(LEAST_LISTS, min(MOST_LISTS, int(4 * math.sqrt(n))))


class Codec(Protocol):
    """What codes vectors: ``encode`` gives codes and factors, ``estimate`` products with queries."""

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]: ...

    def estimate(self, q: np.ndarray, codes: np.ndarray, factor: np.ndarray) -> np.ndarray: ...


@dataclass
class LevelCodes:
    """``bits`` bits for each rotated dimension: even levels over 3.5 deviations each way."""

    turn: SignCodes
    bits: int

    @property
    def _step(self) -> tuple[float, float]:
        reach = 3.5 / math.sqrt(self.turn.signs.shape[1])
        return reach, 2 * reach / ((1 << self.bits) - 1)

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = self.turn.rotate(v.astype(np.float64) - self.turn.centre)
        size = np.linalg.norm(r, axis=1)
        reach, step = self._step
        codes = np.clip(np.rint((r / np.maximum(size, 1e-12)[:, None] + reach) / step), 0, (1 << self.bits) - 1).astype(np.uint8)
        return codes, np.where(size > 1e-12, size / np.maximum(np.linalg.norm(codes * step - reach, axis=1), 1e-12), 0.0)

    def estimate(self, q: np.ndarray, codes: np.ndarray, factor: np.ndarray) -> np.ndarray:
        reach, step = self._step
        return (q @ self.turn.centre)[:, None] + self.turn.rotate(q.astype(np.float64)) @ (codes * step - reach).T * factor[None, :]


def query_planes(turned: np.ndarray, bits: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(planes, low, step): rotated queries in whole steps, one packed plane for each bit of these."""
    low = turned.min(axis=1)
    step = np.maximum(turned.max(axis=1) - low, 1e-12) / ((1 << bits) - 1)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    return np.stack([np.packbits(level >> b & 1, axis=1, bitorder="little") for b in range(bits)], axis=1), low, step


def plane_estimate(codec: SignCodes, q: np.ndarray, packed: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """As ``SignCodes.estimate``, by counting the bits that planes of the query and codes share."""
    turned = codec.rotate(q.astype(np.float64))
    planes, low, step = query_planes(turned)
    ones = np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
    out = np.empty((len(q), len(packed)))
    for i in range(len(q)):
        shared = sum(np.bitwise_count(packed & plane).sum(axis=1, dtype=np.int64) << b for b, plane in enumerate(planes[i]))
        out[i] = factor * (2 * (low[i] * ones + step[i] * shared) - turned[i].sum())
    return (q @ codec.centre)[:, None] + out


@dataclass
class ListIndex:
    """Lists of coded vectors in a folder that all executors share."""

    spark: SparkSession
    folder: str
    centres: np.ndarray
    codec: SignCodes
    parts: dict[int, int]

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, lists: int | None = None, id_col: str = "vec_id", v_col: str = "embedding", seed: int = 1) -> ListIndex:
        """Fits centroids on a bounded sample, codes every vector and writes the lists.

        A list of very many members is written in parts by hash.
        """
        spark, kind = vectors.sparkSession, dict(vectors.dtypes)[id_col]
        sample = sample_rows(vectors, id_col, v_col)
        centres = kmeans(sample, lists or auto_lists(vectors.count()), seed=seed)
        codec = SignCodes.fit(np.zeros_like(sample), seed)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 4096):
                    v = matrix(batch.iloc[at : at + 4096, 1])
                    home = nearest_centre(v, centres)
                    bits, factor = codec.encode(v - centres[home])
                    yield pd.DataFrame({"id": batch.iloc[at : at + 4096, 0], "code": [b.tobytes() for b in np.packbits(bits, axis=1, bitorder="little")], "factor": factor, "list_id": home})

        coded = vectors.select(id_col, v_col).mapInPandas(run, f"id {kind}, code binary, factor double, list_id int").persist()
        try:
            sizes = {r.list_id: r.n for r in coded.groupBy("list_id").agg(F.count("*").alias("n")).collect()}  # a row for each list
            parts = {i: -(-n // PART_ROWS) for i, n in sizes.items()}
            split = spark.createDataFrame(list(parts.items()), "list_id int, parts int")
            rows = coded.join(F.broadcast(split), "list_id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
            rows.repartition("list_id", "part").write.mode("overwrite").partitionBy("list_id").parquet(f"{folder}/lists")
        finally:
            coded.unpersist()
        head = [(VERSION, int(sample.shape[1]), i, parts.get(i, 0), [float(x) for x in c], seed) for i, c in enumerate(centres)]
        spark.createDataFrame(head, "version int, dim int, list_id int, parts int, centre array<double>, seed int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")
        return cls.open(spark, folder)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> ListIndex:
        """Reads the head of an index and checks its version and sizes; the lists stay where they are."""
        head = sorted(spark.read.parquet(f"{folder}/centres").collect(), key=lambda r: r.list_id)  # a row for each list
        if not head or {r.version for r in head} != {VERSION}:
            raise ValueError("no index of this version")
        if {len(r.centre) for r in head} != {head[0].dim} or [r.list_id for r in head] != list(range(len(head))):
            raise ValueError("the centres don't have the size that the index states")
        centres = np.array([r.centre for r in head])
        return cls(spark, folder, centres, SignCodes.fit(np.zeros((1, head[0].dim)), head[0].seed), {r.list_id: r.parts for r in head if r.parts})

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        held = self.spark.read.parquet(f"{self.folder}/lists")
        return held if lists is None else held.filter(F.col("list_id").isin(lists))

    def shortlist(self, queries: DataFrame, probes: int, length: int) -> DataFrame:
        """(qid, id, score, rank): the ``length`` best by estimate in the lists most like each query."""
        table = self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(self.centres)], "list_id int, c array<double>")
        probed = exact_nearest(table, queries, probes, "list_id", "c").select("qid", F.col("id").alias("list_id"))
        probed = probed.persist()
        lists = sorted(r.list_id for r in probed.select("list_id").distinct().collect())  # no more than there are lists
        split = self.spark.createDataFrame([(i, p) for i in lists for p in range(self.parts.get(i, 0))], "list_id int, part int")
        asked = probed.join(F.broadcast(split), "list_id").join(queries, "qid").select("list_id", "part", "qid", F.transform("q", lambda x: x.cast("double")).alias("q"))
        held, centres, codec = self.rows(lists), self.centres, self.codec
        kind = dict(held.dtypes)["id"]

        def run(key: tuple, ask: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"qid": [], "id": [], "score": []})]
            if len(rows):
                packed, factor = np.frombuffer(b"".join(rows.code), np.uint8).reshape(len(rows), -1), rows.factor.to_numpy()
                ids, centre = rows.id.to_numpy(), centres[int(key[0])]
                some = min(length, len(rows))
                for at in range(0, len(ask), 64):
                    part = ask.iloc[at : at + 64]
                    q = np.array([list(x) for x in part.q])
                    scores = plane_estimate(codec, q, packed, factor) + (q @ centre)[:, None]
                    best = np.argpartition(-scores, some - 1, axis=1)[:, :some]
                    out.append(pd.DataFrame({"qid": np.repeat(part.qid.to_numpy(), some), "id": ids[best.ravel()], "score": np.take_along_axis(scores, best, 1).ravel()}))
            return pd.concat(out)

        found = asked.groupBy("list_id", "part").cogroup(held.groupBy("list_id", "part")).applyInPandas(run, f"qid bigint, id {kind}, score double")
        return ranked(found, length)

    def search(self, vectors: DataFrame, queries: DataFrame, k: int, probes: int, refine: int, id_col: str = "vec_id", v_col: str = "embedding") -> DataFrame:
        """(qid, id, score, rank): the ``refine`` best of the probed lists, ranked again by true products."""
        coarse = self.shortlist(queries, probes, max(k, refine)).select("qid", "id")
        fine = coarse.join(vectors.select(F.col(id_col).alias("id"), v_col), "id").join(queries, "qid")
        return ranked(fine.select("qid", "id", F.round(dot(F.col("q"), F.col(v_col)), 6).alias("score")), k)


def resident_bytes(n: int, dim: int, bits: int = 1) -> int:
    """Bytes that an index of ``n`` vectors needs in memory: codes, factors, ids and centroids."""
    return n * (-(-dim * bits // 8) + 8 + 4) + auto_lists(n) * dim * 4
