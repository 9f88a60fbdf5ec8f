"""Nearest vectors: exact, shortened, quantised and by lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.vector import dot
from lorespark.operators.lexical import ranked

#: Queries that are compared with all vectors in one pass; rows a codec or centroids are fitted on.
QUERIES_AT_ONCE, SAMPLE = 4096, 65_536
#: Vectors and queries whose products are in memory at a time.
BLOCK_ROWS, BLOCK_QUERIES = 2048, 512


def matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float32) if len(column) else np.zeros((0, 1), np.float32)


def exact_nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", v_col: str = "embedding") -> DataFrame:
    """(qid, id, score, rank): the k vectors of greatest inner product with each query (qid, q).

    The queries go to the tasks in blocks of bounded size; each task keeps its own k best of each
    query, so no pair beyond those is shuffled.  Scores are in double precision, rounded to 6
    decimals; ties go to the smaller id.
    """
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-queries.count() // QUERIES_AT_ONCE)))))
    numbers = sorted(r.block for r in blocks.select("block").distinct().collect())
    out = None
    for number in numbers:
        rows = blocks.filter(F.col("block") == number).select("qid", "q").toPandas()
        part = _best_of_block(vectors.select(id_col, v_col), rows, k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = _best_of_block(vectors.select(id_col, v_col), pd.DataFrame({"qid": [], "q": []}), k)
    return ranked(out, k)


class Best:
    """The k best of each query so far.

    Products are made in single precision, a bounded block at a time; those that may be among the
    best, by more than its error, are made again in double precision.
    """

    def __init__(self, q: np.ndarray, k: int) -> None:
        self.q, self.single, self.k, self.ids = q, q.astype(np.float32), k, None
        self.scores, self.size = np.full((len(q), k), -np.inf), np.linalg.norm(q, axis=1)

    def add(self, ids: np.ndarray, column: pd.Series) -> None:
        if self.ids is None:
            self.ids = np.zeros(self.scores.shape, ids.dtype)
        for x in range(0, len(ids), BLOCK_ROWS):
            v = matrix(column.iloc[x : x + BLOCK_ROWS])
            told = ~np.isnan(v).any(axis=1)
            v, own = v[told], ids[x : x + BLOCK_ROWS][told]
            wide, most = v.astype(np.float64), float(np.linalg.norm(v, axis=1).max(initial=0))
            slack = (v.shape[1] + 2) * 1.2e-7 * most * self.size + 2e-6
            for y in range(0, len(self.q), BLOCK_QUERIES):
                self._block(slice(y, y + BLOCK_QUERIES), own, v, wide, slack[y : y + BLOCK_QUERIES])

    def _block(self, some: slice, ids: np.ndarray, v: np.ndarray, wide: np.ndarray, slack: np.ndarray) -> None:
        near, least = self.single[some] @ v.T, self.scores[some, -1]
        if len(ids) >= self.k and np.isneginf(least).any():
            least = np.fmax(least, np.partition(near, len(ids) - self.k, axis=1)[:, len(ids) - self.k] - slack)
        i, j = np.nonzero(near >= (least - slack)[:, None])
        if not len(i):
            return
        score = np.concatenate([np.round(np.einsum("nd,nd->n", self.q[some][i[n : n + 8192]], wide[j[n : n + 8192]]), 6) for n in range(0, len(i), 8192)])
        count = len(least)
        query = np.concatenate([np.repeat(np.arange(count), self.k), i])
        score, name = np.concatenate([self.scores[some].ravel(), score]), np.concatenate([self.ids[some].ravel(), ids[j]])
        order = np.lexsort((name, -score, query))
        query, score, name = query[order], score[order], name[order]
        keep = np.arange(len(query)) - np.searchsorted(query, np.arange(count))[query] < self.k
        self.scores[some], self.ids[some] = score[keep].reshape(count, -1), name[keep].reshape(count, -1)


def _best_of_block(vectors: DataFrame, rows: pd.DataFrame, k: int) -> DataFrame:
    held = vectors.sparkSession.sparkContext.broadcast((rows.qid.tolist(), np.array([list(q) for q in rows.q], np.float64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = held.value
        best = Best(q, k) if names else None
        for batch in batches:
            if names and len(batch):
                best.add(batch.iloc[:, 0].to_numpy(), batch.iloc[:, 1])
        if best is None or best.ids is None:
            yield pd.DataFrame({"qid": [], "id": [], "score": []})
        else:
            i, j = np.nonzero(best.scores > -np.inf)
            yield pd.DataFrame({"qid": np.asarray(names)[i], "id": best.ids[i, j], "score": best.scores[i, j]})

    kind = dict(vectors.dtypes)[vectors.columns[0]]
    return vectors.mapInPandas(run, f"qid bigint, id {kind}, score double")


def queries_of(vectors: DataFrame, id_col: str = "vec_id", v_col: str = "embedding") -> DataFrame:
    """The rows with an id divisible by 20, as queries (qid, q)."""
    return vectors.filter(F.col(id_col) % 20 == 0).select(F.col(id_col).cast("bigint").alias("qid"), F.col(v_col).alias("q"))


def dimension_range(vectors: DataFrame, v_col: str = "embedding") -> DataFrame:
    """(pos, lo, step): the least number of each dimension and a 255th of its range, 1 if flat."""
    by = vectors.select(F.posexplode(v_col).alias("pos", "x")).groupBy("pos").agg(F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi"))
    return by.select("pos", "lo", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / 255).otherwise(1.0).alias("step"))


def int8_codes(vectors: DataFrame, ranges: DataFrame, id_col: str = "vec_id", v_col: str = "embedding") -> DataFrame:
    """(id, codes): each number as its nearest of 256 levels.  ``ranges`` has a row for each dimension."""
    rows = sorted(ranges.collect(), key=lambda r: r.pos)
    lo, step = F.array(*(F.lit(r.lo) for r in rows)), F.array(*(F.lit(r.step) for r in rows))
    level = F.transform(F.arrays_zip(F.col(v_col).alias("x"), lo.alias("lo"), step.alias("step")), lambda t: F.floor((t["x"].cast("double") - t["lo"]) / t["step"] + 0.5).cast("int"))
    return vectors.select(F.col(id_col).alias("id"), level.alias("codes"))


def decoded(codes: Column, ranges: DataFrame) -> Column:
    rows = sorted(ranges.collect(), key=lambda r: r.pos)
    lo, step = F.array(*(F.lit(r.lo) for r in rows)), F.array(*(F.lit(r.step) for r in rows))
    return F.transform(F.arrays_zip(codes.alias("c"), lo.alias("lo"), step.alias("step")), lambda t: t["lo"] + t["c"] * t["step"])


def mean_vectors(vectors: DataFrame, by: str, v_col: str = "embedding") -> DataFrame:
    """(by, mean): the mean of each group's vectors, dimension by dimension, not normalised."""
    parts = vectors.select(by, F.posexplode(v_col).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: F.round(s["x"], 9)).alias("mean"))


def coarse_to_fine(vectors: DataFrame, queries: DataFrame, by: str, groups: int, k: int, id_col: str = "vec_id", v_col: str = "embedding") -> DataFrame:
    """(qid, id, score, rank): the k best members of the groups whose means are most like the query."""
    means = mean_vectors(vectors, by, v_col)
    coarse = exact_nearest(means, queries, groups, by, "mean").select("qid", F.col("id").alias(by))
    inside = coarse.join(queries, "qid").join(vectors.select(id_col, by, v_col), by)
    scores = inside.select("qid", F.col(id_col).alias("id"), F.round(dot(F.col("q"), F.col(v_col)), 6).alias("score"))
    return ranked(scores, k)


@dataclass
class SignCodes:
    """One bit for each dimension of a centred and rotated vector, with a factor for its length.

    The rotation changes signs at random and mixes all dimensions with a Walsh-Hadamard transform,
    twice, so every bit tells about as much as any other.
    """

    centre: np.ndarray
    signs: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, seed: int = 1) -> SignCodes:
        """The centre of a bounded sample; the signs come from the seed alone."""
        width = 1 << max(6, (sample.shape[1] - 1).bit_length())
        return cls(sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1]), np.random.default_rng(seed).choice([-1.0, 1.0], (2, width)))

    def rotate(self, v: np.ndarray) -> np.ndarray:
        width = self.signs.shape[1]
        x = np.pad(v, ((0, 0), (0, width - v.shape[1])))
        for signs in self.signs:
            x = x * signs
            half = 1
            while half < width:
                y = x.reshape(len(x), -1, 2, half)
                x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(v), width)
                half *= 2
            x = x / np.sqrt(width)
        return x

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits, factor): of a vector without its centre, the norm over the sum of rotated sizes."""
        r = self.rotate(v.astype(np.float64) - self.centre)
        total = np.abs(r).sum(axis=1)
        return r > 0, np.where(total > 1e-12, (r * r).sum(axis=1) / np.maximum(total, 1e-12), 0.0)

    def estimate(self, q: np.ndarray, bits: np.ndarray, factor: np.ndarray) -> np.ndarray:
        """Estimated inner products of queries with coded vectors."""
        turned = self.rotate(q.astype(np.float64))
        return (q @ self.centre)[:, None] + factor[None, :] * (2 * turned @ bits.T.astype(np.float64) - turned.sum(axis=1)[:, None])


def sample_rows(vectors: DataFrame, id_col: str, v_col: str, most: int = SAMPLE) -> np.ndarray:
    rows = vectors.orderBy(F.xxhash64(id_col), id_col).limit(most).select(v_col).toPandas()
    return matrix(rows.iloc[:, 0])


def sign_code_table(vectors: DataFrame, codec: SignCodes, id_col: str = "vec_id", v_col: str = "embedding") -> DataFrame:
    """(id, code BINARY, factor): packed bits, the lowest first."""
    kind = dict(vectors.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                bits, factor = codec.encode(matrix(batch.iloc[:, 1]))
                yield pd.DataFrame({"id": batch.iloc[:, 0], "code": [b.tobytes() for b in np.packbits(bits, axis=1, bitorder="little")], "factor": factor})

    return vectors.select(id_col, v_col).mapInPandas(run, f"id {kind}, code binary, factor double")


def two_stage(vectors: DataFrame, queries: DataFrame, k: int, refine: int, id_col: str = "vec_id", v_col: str = "embedding", seed: int = 1) -> DataFrame:
    """(qid, id, score, rank): the ``refine`` best by sign codes, ranked again by their true product."""
    codec = SignCodes.fit(sample_rows(vectors, id_col, v_col), seed)
    rows = queries.toPandas()
    if not len(rows):
        return exact_nearest(vectors, queries, k, id_col, v_col)
    held = vectors.sparkSession.sparkContext.broadcast((rows.qid.to_numpy(), np.array([list(q) for q in rows.q], np.float64)))
    kind = dict(vectors.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = held.value
        for batch in batches:
            if not len(batch):
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(batch.code), np.uint8).reshape(len(batch), -1), axis=1, bitorder="little")
            scores = codec.estimate(q, bits, batch.factor.to_numpy())
            some = min(refine, len(batch))
            best = np.argpartition(-scores, some - 1, axis=1)[:, :some]
            yield pd.DataFrame({"qid": np.repeat(names, some), "id": batch.id.to_numpy()[best.ravel()], "score": np.take_along_axis(scores, best, 1).ravel()})

    coarse = ranked(sign_code_table(vectors, codec, id_col, v_col).mapInPandas(run, f"qid bigint, id {kind}, score double"), refine).select("qid", "id")
    fine = coarse.join(vectors.select(F.col(id_col).alias("id"), v_col), "id").join(queries, "qid").select("qid", "id", F.round(dot(F.col("q"), F.col(v_col)), 6).alias("score"))
    return ranked(fine, k)


def kmeans(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Centroids of a bounded sample by least squared distance; an empty one takes another row."""
    rng = np.random.default_rng(seed)
    count = max(1, min(count, len(sample)))
    centres = sample[rng.choice(len(sample), count, replace=False)].astype(np.float64) if len(sample) else np.zeros((1, sample.shape[1]))
    for _ in range(rounds if len(sample) else 0):
        near = nearest_centre(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=count)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], sample[rng.integers(len(sample), size=count)])
    return centres


def nearest_centre(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector, of equals the first."""
    return ((centres * centres).sum(axis=1)[None, :] - 2 * v.astype(np.float64) @ centres.T).argmin(axis=1)


def assigned(vectors: DataFrame, centres: np.ndarray, id_col: str = "vec_id", v_col: str = "embedding") -> DataFrame:
    """(id, list_id, v): the list of every vector; write it partitioned by ``list_id`` to prune lists."""
    kinds = dict(vectors.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"id": batch.iloc[:, 0], "list_id": nearest_centre(matrix(batch.iloc[:, 1]), centres), "v": batch.iloc[:, 1]})

    return vectors.select(id_col, v_col).mapInPandas(run, f"id {kinds[id_col]}, list_id int, v {kinds[v_col]}")


def by_lists(vectors: DataFrame, queries: DataFrame, k: int, lists: int, probes: int, id_col: str = "vec_id", v_col: str = "embedding", seed: int = 1) -> DataFrame:
    """(qid, id, score, rank) among the vectors of the ``probes`` lists most like each query."""
    centres = kmeans(sample_rows(vectors, id_col, v_col), lists, seed=seed)
    held = assigned(vectors, centres, id_col, v_col)
    table = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list_id int, c array<double>")
    probed = exact_nearest(table, queries, probes, "list_id", "c").select("qid", F.col("id").alias("list_id"))
    pairs = probed.join(queries, "qid").join(held, "list_id")
    return ranked(pairs.select("qid", "id", F.round(dot(F.col("q"), F.col("v")), 6).alias("score")), k)


def product_codes(vectors: DataFrame, parts: int, levels: int = 256, id_col: str = "vec_id", v_col: str = "embedding", seed: int = 1) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, codes), codebooks): each part of a vector as the nearest of its codebook's centroids."""
    sample = sample_rows(vectors, id_col, v_col)
    cut = np.array_split(np.arange(sample.shape[1]), parts)
    books = [kmeans(sample[:, c], levels, 12, seed + i) for i, c in enumerate(cut)]
    kind = dict(vectors.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                v = matrix(batch.iloc[:, 1])
                yield pd.DataFrame({"id": batch.iloc[:, 0], "codes": list(np.stack([nearest_centre(v[:, c], b) for c, b in zip(cut, books)], axis=1).astype(np.int32))})

    return vectors.select(id_col, v_col).mapInPandas(run, f"id {kind}, codes array<int>"), books


def product_search(codes: DataFrame, books: list[np.ndarray], queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank) by sums of a table of products of each query part with each centroid."""
    rows = queries.toPandas()
    held = codes.sparkSession.sparkContext.broadcast((rows.qid.tolist(), [list(q) for q in rows.q]))
    kind = dict(codes.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = held.value
        for batch in batches:
            if not names or not len(batch):
                continue
            q_, c = np.array(q), np.vstack(batch.codes.to_numpy())
            at = np.cumsum([0, *(b.shape[1] for b in books)])
            scores = sum((q_[:, at[i] : at[i + 1]] @ b.T)[:, c[:, i]] for i, b in enumerate(books))
            some = min(k, len(batch))
            best = np.argpartition(-scores, some - 1, axis=1)[:, :some]
            yield pd.DataFrame({"qid": np.repeat(names, some), "id": batch.id.to_numpy()[best.ravel()], "score": np.round(np.take_along_axis(scores, best, 1).ravel(), 6)})

    return ranked(codes.mapInPandas(run, f"qid bigint, id {kind}, score double"), k)


def product_two_stage(vectors: DataFrame, queries: DataFrame, k: int, refine: int, parts: int, levels: int = 256, id_col: str = "vec_id", v_col: str = "embedding") -> DataFrame:
    """(qid, id, score, rank): the ``refine`` best by product codes, ranked again by their true product."""
    codes, books = product_codes(vectors, parts, levels, id_col, v_col)
    coarse = product_search(codes, books, queries, refine).select("qid", "id")
    fine = coarse.join(vectors.select(F.col(id_col).alias("id"), v_col), "id").join(queries, "qid").select("qid", "id", F.round(dot(F.col("q"), F.col(v_col)), 6).alias("score"))
    return ranked(fine, k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row ``recall``: the mean share of each query's true neighbours that was found."""
    hits = truth.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hits.groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share")).agg(F.avg("share").alias("recall"))


def hash_embedding(texts: DataFrame, dim: int = 256, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, embedding): the sum of a seeded Gaussian unit vector for each word, normalised.

    A text without words gets the vector of a word that no text holds.
    """
    from lorespark.functions.text import tokens

    kind = dict(texts.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        known: dict[str, np.ndarray] = {}

        def of(word: str) -> np.ndarray:
            if word not in known:
                if len(known) >= 50_000:
                    known.clear()
                v = np.random.default_rng(xxhash.xxh64_intdigest(word)).standard_normal(dim)
                known[word] = v / np.linalg.norm(v)
            return known[word]

        for batch in batches:
            out = []
            for words in batch.iloc[:, 1]:
                v = np.sum([of(w) for w in words], axis=0) if len(words) else of("\x00")
                n = np.linalg.norm(v)
                out.append((v / n if n > 1e-12 else v).astype(np.float32))
            yield pd.DataFrame({"id": batch.iloc[:, 0], "embedding": out})

    return texts.select(id_col, tokens(F.col(text_col)).alias("words")).mapInPandas(run, f"id {kind}, embedding array<float>")
