"""The k best documents of each question by words: exact, without a score for every pair that shares a word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import tokens
from lorespark.session import materialise

#: Documents that are searched at a time; words in no more documents than RARE are scored for each question
#: by itself; words of a chunk in more than a DENSE-th of its documents, and how many of them at most, are
#: looked up in an array of all documents.  Scores are rounded to 6 places, so what is closer may be equal.
CHUNK, RARE, DENSE, DENSE_WORDS, CLOSE = 131_072, 100, 16, 64, 2e-6

_BLOCK = "n bigint, total bigint, ids binary, lengths binary, doc binary, term binary, tf binary"


def _pack(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpack(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def blocks(docs: DataFrame, words: pa.Array, id_col: str, text_col: str) -> DataFrame:
    """A row for each batch of documents: ids and lengths of all, and postings of the asked words, packed."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column(1)
            lengths = pc.list_value_length(said).to_numpy(zero_copy_only=False).astype(np.int32)
            place = pc.index_in(said.flatten(), value_set=held.value)
            there = place.is_valid().to_numpy(zero_copy_only=False)
            term = place.fill_null(0).to_numpy(zero_copy_only=False)[there].astype(np.int64)
            key, tf = np.unique(np.repeat(np.arange(len(lengths)), lengths)[there] * max(len(held.value), 1) + term, return_counts=True)
            doc, term = np.divmod(key, max(len(held.value), 1))
            row = [len(lengths), int(lengths.sum()), _pack(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)), _pack(lengths), _pack(doc.astype(np.int32)), _pack(term.astype(np.int32)), _pack(tf.astype(np.int32))]
            kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=["n", "total", "ids", "lengths", "doc", "term", "tf"])

    return docs.select(F.col(id_col).cast("bigint"), tokens(F.col(text_col))).mapInArrow(run, _BLOCK)


def counted(packed: DataFrame, words: int) -> tuple[int, int, np.ndarray]:
    """Documents, words of all, and documents of each asked word: to the driver comes an array from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, df = 0, 0, np.zeros(words, np.int64)
        for batch in batches:
            n, total = n + (pc.sum(batch.column(0)).as_py() or 0), total + (pc.sum(batch.column(1)).as_py() or 0)
            for x in batch.column(2):
                df += np.bincount(_unpack(x.as_py(), np.int32), minlength=words)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total]), pa.array([_pack(df)], pa.binary())], names=["n", "total", "df"])

    n, total, df = 0, 0, np.zeros(words, np.int64)
    for r in packed.select("n", "total", "term").mapInArrow(run, "n bigint, total bigint, df binary").toLocalIterator():
        n, total, df = n + r.n, total + r.total, df + _unpack(bytes(r.df), np.int64)
    return n, total, df


@dataclass
class Asked:
    """Questions that hold the same words as often are one bag; the frequent words of bags are their cores.

    A document without the rare words of a question is among its k best only if it is among the k
    best of the core, so a core is searched once for all questions that have it.
    """

    k: int
    weights: np.ndarray  # of each word
    bags: list[tuple[np.ndarray, np.ndarray]]  # words and how often each is asked
    frequent: np.ndarray  # of each word
    k1: float | None
    b: float
    average: float
    cores: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    core_of: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        known: dict[bytes, int] = {}
        for words, times in self.bags:
            some = self.frequent[words]
            key = words[some].tobytes() + times[some].tobytes()
            if some.any() and key not in known:
                known[key] = len(self.cores)
                self.cores.append((words[some], times[some] * self.weights[words[some]]))
            self.core_of.append(known[key] if some.any() else -1)


class _Chunk:
    """An index of some documents."""

    def __init__(self, asked: Asked, rows: list[tuple]) -> None:
        sizes = [len(r[0]) for r in rows]
        self.ids, lengths = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        doc, term, tf = np.concatenate([r[2].astype(np.int64) + at for r, at in zip(rows, first)]), np.concatenate([r[3] for r in rows]), np.concatenate([r[4] for r in rows])
        order = np.argsort(term, kind="stable")
        self.n, self.words, self.doc, term, tf = len(self.ids), len(asked.weights), doc[order], term[order], tf[order].astype(np.float64)
        self.key = term * np.int64(self.n) + self.doc
        self.part = np.ones(len(tf)) if asked.k1 is None else tf * (asked.k1 + 1) / (tf + asked.k1 * (1 - asked.b + asked.b * lengths[self.doc] / asked.average))
        self.count = np.bincount(term, minlength=self.words)
        self.start = np.concatenate([[0], np.cumsum(self.count)])
        self.most = np.zeros(self.words)
        there = np.flatnonzero(self.count)
        if len(there):
            self.most[there] = np.maximum.reduceat(self.part, self.start[there])
        self.dense, self.scratch = {}, np.zeros(self.n)
        often = np.flatnonzero(self.count > self.n / DENSE)
        for t in often[np.argsort(-self.count[often], kind="stable")][:DENSE_WORDS].tolist():
            self.dense[t] = np.zeros(self.n)
            self.dense[t][self.doc[self.start[t] : self.start[t + 1]]] = self.part[self.start[t] : self.start[t + 1]]

    def of(self, t: int) -> slice:
        return slice(self.start[t], self.start[t + 1])

    def at(self, t: int, docs: np.ndarray) -> np.ndarray:
        """What a word counts in each of some documents."""
        if t in self.dense:
            return self.dense[t][docs]
        own = self.doc[self.of(t)]
        self.scratch[own] = self.part[self.of(t)]
        out = self.scratch[docs]
        self.scratch[own] = 0
        return out

    def best(self, words: np.ndarray, weights: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best documents for words, of those that reach ``least``."""
        some = self.count[words] > 0
        words, weights = words[some], weights[some]
        if not len(words):
            return self.ids[:0], np.zeros(0)
        # Words that can add least come first, and of those the most frequent.
        bound, count = weights * self.most[words], self.count[words]
        order = np.lexsort((-count, bound))
        words, weights, bound, count = words[order].tolist(), weights[order], bound[order], count[order]
        upto = np.cumsum(bound)
        enough = np.flatnonzero(count >= k)
        if len(enough) and upto[-1] >= least - CLOSE:
            docs = self.doc[self.of(words[enough[-1]])][: 64 * k]
            score = sum(w * self.at(t, docs) for t, w in zip(words, weights))
            least = max(least, np.partition(score, len(score) - k)[len(score) - k])
        # A document with none of the words from this on can't reach the least score.
        need = int(np.searchsorted(upto, least - CLOSE, side="left"))
        if need == len(words):
            return self.ids[:0], np.zeros(0)
        if need == len(words) - 1:
            docs, score = self.doc[self.of(words[need])], weights[need] * self.part[self.of(words[need])]
        else:
            total = np.zeros(self.n)
            for t, w in zip(words[need:], weights[need:]):
                if t in self.dense:
                    total += w * self.dense[t]
                else:
                    total[self.doc[self.of(t)]] += w * self.part[self.of(t)]
            docs = np.flatnonzero(total)
            score = total[docs]
        for i in range(need - 1, -1, -1):
            keep = score + upto[i] >= least - CLOSE
            docs, score = docs[keep], score[keep]
            if not len(docs):
                break
            score = score + weights[i] * self.at(words[i], docs)
        return top(self.ids[docs], np.round(score, 6), k)

    def pairs(self, asked: Asked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bag, id, score) of all documents that hold a rare word of a bag."""
        sizes = np.array([len(w) for w, _ in asked.bags], np.int64)
        none = np.zeros(0, np.int64), self.ids[:0], np.zeros(0)
        if not sizes.sum():
            return none
        words, times = np.concatenate([w for w, _ in asked.bags]).astype(np.int64), np.concatenate([t for _, t in asked.bags])
        first, bag = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(sizes)), sizes)
        rare = ~asked.frequent[words] & (self.count[words] > 0)
        size = self.count[words[rare]]
        if not size.sum():
            return none
        there = np.repeat(self.start[words[rare]] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        pair = np.unique(np.repeat(bag[rare], size) * self.n + self.doc[there])
        bag, doc = np.divmod(pair, self.n)
        size = sizes[bag]
        which = np.repeat(first[bag] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        key = words[which] * self.n + np.repeat(doc, size)
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        part = np.where(self.key[place] == key, times[which] * asked.weights[words[which]] * self.part[place], 0)
        score = np.bincount(np.repeat(np.arange(len(pair)), size), part, len(pair))
        return bag, self.ids[doc], np.round(score, 6)


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k of greatest score; of equal ones those of smaller ids."""
    if len(ids) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _search(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, found, waiting, size = held.value, {}, [], 0

        def out(of, ids, scores, core: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), core)), pa.array(np.asarray(of).astype(np.int32)), pa.array(ids), pa.array(scores)], names=["core", "of", "id", "score"])

        def searched() -> pa.RecordBatch:
            chunk = _Chunk(asked, waiting)
            for c, (words, weights) in enumerate(asked.cores):
                ids, scores = found.get(c, (chunk.ids[:0], np.zeros(0)))
                more = chunk.best(words, weights, asked.k, scores[-1] if len(scores) == asked.k else 0.0)
                if len(more[0]):
                    found[c] = top(np.concatenate([ids, more[0]]), np.concatenate([scores, more[1]]), asked.k)
            return out(*chunk.pairs(asked), False)

        for batch in batches:
            for r in zip(*(batch.column(i) for i in range(5))):
                waiting.append(tuple(_unpack(x.as_py(), kind) for x, kind in zip(r, (np.int64, np.int32, np.int32, np.int32, np.int32))))
                size += len(waiting[-1][0])
                if size >= CHUNK:
                    yield searched()
                    waiting, size = [], 0
        if size:
            yield searched()
        for c, (ids, scores) in found.items():
            yield out(np.full(len(ids), c), ids, scores, True)

    return run


def best_documents(docs: DataFrame, queries: DataFrame, k: int, id_col: str, text_col: str, query_id: str, query_text: str, k1: float | None, b: float = 0.75) -> DataFrame:
    """(qid, id, score, rank) of the k documents of greatest score; of equal ones those of smaller ids.

    The score is BM25, a word asked twice counting twice; with no ``k1`` it is the number of different
    words that a document shares with the question.  The driver holds the questions' words.
    """
    from lorespark.operators.lexical import ranked

    spark, kind, asker = docs.sparkSession, dict(docs.dtypes)[id_col], dict(queries.dtypes)[query_id]
    said = queries.select(F.col(query_id).alias("qid"), F.explode(tokens(F.col(query_text))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times")).toArrow()
    coded = said.column("term").combine_chunks().dictionary_encode()
    qids = said.column("qid").combine_chunks().dictionary_encode()
    term, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    times = said.column("times").to_numpy().astype(np.float64) if k1 is not None else np.ones(len(term))
    which = qids.indices.fill_null(len(qids.dictionary)).to_numpy(zero_copy_only=False)  # a null id asks for itself
    order = np.lexsort((term, which))
    which, term, times = which[order], term[order], times[order]
    edges = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else np.zeros(0, np.int64)
    bags, known, bag_of = [], {}, []
    for i, j in zip(edges, np.r_[edges[1:], len(which)].astype(np.int64)):
        key = term[i:j].tobytes() + times[i:j].tobytes()
        if key not in known:
            known[key] = len(bags)
            bags.append((term[i:j], times[i:j]))
        bag_of.append(known[key])
    packed = materialise(blocks(docs, names, id_col, text_col))
    n, total, df = counted(packed, len(names))
    weights = np.ones(len(names)) if k1 is None else np.log((n - df + 0.5) / (df + 0.5) + 1)
    asked = Asked(k, weights, bags, df > RARE, k1, b, max(total / n, 1.0) if n else 1.0)
    found = packed.select("ids", "lengths", "doc", "term", "tf").mapInArrow(_search(spark.sparkContext.broadcast(asked)), "core boolean, of int, id bigint, score double")
    found = materialise(found)
    cores = ranked(found.filter("core").select("of", "id", "score"), k, "of").drop("rank")
    to_core = spark.createDataFrame(pa.table({"of": pa.array(asked.core_of, pa.int32()), "bag": pa.array(range(len(bags)), pa.int32())}))
    every = cores.join(to_core, "of").select("bag", "id", "score").unionByName(found.filter("not core").select(F.col("of").alias("bag"), "id", "score"))
    best = ranked(every.groupBy("bag", "id").agg(F.max("score").alias("score")), k, "bag")
    asks = spark.createDataFrame(pa.table({"qid": qids.dictionary.take(pa.array(which[edges], mask=which[edges] == len(qids.dictionary))), "bag": pa.array(bag_of, pa.int32())}))
    return best.join(asks, "bag").select(F.col("qid").cast(asker).alias("qid"), F.col("id").cast(kind).alias("id"), "score", "rank")
