"""Subword tokenizers over a given vocabulary: greedy longest match and best-scoring split."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PRE = re.compile(r"[^\W_]+|[^\w\s]|_")


@dataclass(frozen=True)
class WordPiece:
    """Greedy longest match; pieces inside a word begin with ``##``; a word that fails is unknown."""

    vocabulary: dict[str, int]
    unknown: str = "[UNK]"
    lower: bool = True
    longest_word: int = 100

    def split(self, text: str) -> list[str]:
        out = []
        for word in _PRE.findall(text.lower() if self.lower else text):
            out += self._word(word)
        return out

    def _word(self, word: str) -> list[str]:
        if len(word) > self.longest_word:
            return [self.unknown]
        pieces, at = [], 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in self.vocabulary), None)
            if end is None:
                return [self.unknown]
            pieces.append(("##" if at else "") + word[at:end])
            at = end
        return pieces

    def ids(self, text: str) -> list[int]:
        return [self.vocabulary.get(p, self.vocabulary.get(self.unknown, -1)) for p in self.split(text)]


@dataclass(frozen=True)
class Unigram:
    """The split of greatest total score; of equals the one with the longer last piece.

    Spaces become a mark in front of words; letters that no piece holds are unknown, and unknown
    neighbours are one.
    """

    scores: dict[str, float]
    unknown: str = "<unk>"
    mark: str = "▁"
    penalty: float = 10.0

    def split(self, text: str) -> list[str]:
        text = self.mark + re.sub(r"\s+", self.mark, text.strip()) if text.strip() else ""
        longest = max(map(len, self.scores), default=1)
        worst = min(self.scores.values(), default=0.0) - self.penalty
        best: list[tuple[float, int, str]] = [(0.0, 0, "")]
        for end in range(1, len(text) + 1):
            top = (best[end - 1][0] + worst, end - 1, self.unknown)
            for begin in range(max(0, end - longest), end):
                piece = text[begin:end]
                if piece in self.scores and (score := best[begin][0] + self.scores[piece]) >= top[0] and (score > top[0] or begin < top[1]):
                    top = (score, begin, piece)
            best.append(top)
        out, at = [], len(text)
        while at:
            _, begin, piece = best[at]
            if not (piece == self.unknown and out and out[-1] == self.unknown):
                out.append(piece)
            at = begin
        return out[::-1]


def pieces(texts: DataFrame, tokenizer: WordPiece | Unigram, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, pieces) of each text; null texts have none."""
    held = texts.sparkSession.sparkContext.broadcast(tokenizer)
    kind = dict(texts.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch.iloc[:, 0], "pieces": [held.value.split(t) if t else [] for t in batch.iloc[:, 1]]})

    return texts.select(F.col(id_col), F.col(text_col)).mapInPandas(run, f"id {kind}, pieces array<string>")
