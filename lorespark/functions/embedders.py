"""Embeddings from a table of piece vectors, and from a transformer's weights."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.subwords import WordPiece


@dataclass(frozen=True)
class StaticTable:
    """The weighted mean of the vectors of a text's pieces, normalised; zero if none is known."""

    tokenizer: WordPiece
    vectors: np.ndarray
    weights: np.ndarray

    def embed(self, text: str) -> np.ndarray:
        ids = [i for i in self.tokenizer.ids(text) if 0 <= i < len(self.vectors) and i != self.tokenizer.vocabulary.get(self.tokenizer.unknown)]
        out = np.zeros(self.vectors.shape[1])
        if ids and (total := self.weights[ids].sum()) > 0:
            out = (self.weights[ids, None] * self.vectors[ids]).sum(axis=0) / total
        size = np.linalg.norm(out)
        return (out / size if size > 1e-12 else out).astype(np.float32)


def _layer_norm(x: np.ndarray, gain: np.ndarray, bias: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    mean = x.mean(axis=-1, keepdims=True)
    return (x - mean) / np.sqrt(((x - mean) ** 2).mean(axis=-1, keepdims=True) + eps) * gain + bias


_ERF = np.vectorize(math.erf, otypes=[np.float64])


def _gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + _ERF(x / math.sqrt(2)))


@dataclass(frozen=True)
class Encoder:
    """A transformer encoder with post-layer normalisation over given weights.

    ``weights`` maps names to arrays: ``words positions types gain bias`` and, for layer i,
    ``i.q i.k i.v i.o i.up i.down`` with biases ``i.bq …`` and ``i.gain1 i.bias1 i.gain2 i.bias2``.
    """

    tokenizer: WordPiece
    weights: dict[str, np.ndarray]
    layers: int
    heads: int
    pool: str = "mean"
    query_prefix: str = ""
    passage_prefix: str = ""

    def embed(self, text: str, query: bool = False) -> np.ndarray:
        w, t = self.weights, self.tokenizer
        ids = [t.vocabulary["[CLS]"], *t.ids((self.query_prefix if query else self.passage_prefix) + text), t.vocabulary["[SEP]"]][: len(w["positions"])]
        x = _layer_norm(w["words"][ids] + w["positions"][: len(ids)] + w["types"][0], w["gain"], w["bias"])
        width = x.shape[1] // self.heads
        for i in range(self.layers):
            q, k, v = (x @ w[f"{i}.{n}"] + w[f"{i}.b{n}"] for n in "qkv")
            q, k, v = (m.reshape(len(ids), self.heads, width).transpose(1, 0, 2) for m in (q, k, v))
            scores = q @ k.transpose(0, 2, 1) / math.sqrt(width)
            scores = np.exp(scores - scores.max(axis=-1, keepdims=True))
            mixed = (scores / scores.sum(axis=-1, keepdims=True) @ v).transpose(1, 0, 2).reshape(len(ids), -1)
            x = _layer_norm(x + mixed @ w[f"{i}.o"] + w[f"{i}.bo"], w[f"{i}.gain1"], w[f"{i}.bias1"])
            x = _layer_norm(x + _gelu(x @ w[f"{i}.up"] + w[f"{i}.bup"]) @ w[f"{i}.down"] + w[f"{i}.bdown"], w[f"{i}.gain2"], w[f"{i}.bias2"])
        out = x[0] if self.pool == "cls" else x.mean(axis=0)
        return (out / max(np.linalg.norm(out), 1e-12)).astype(np.float32)


def embedded(texts: DataFrame, embedder, id_col: str = "id", text_col: str = "text", **options) -> DataFrame:
    """(id, embedding) by any object with ``embed(text)``, sent to the tasks once; null is like empty."""
    held = texts.sparkSession.sparkContext.broadcast(embedder)
    kind = dict(texts.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch.iloc[:, 0], "embedding": [held.value.embed(t or "", **options) for t in batch.iloc[:, 1]]})

    return texts.select(F.col(id_col), F.col(text_col)).mapInPandas(run, f"id {kind}, embedding array<float>")
