"""Scores of texts for abusive, hateful or sexual content, learned from labels of whole documents.

A document is a bag of sentences, and it is abusive if any of them is: its score is the noisy-or of
theirs.  Only documents have labels; the gradient of the document's loss decides which of its
sentences answer for it, so the model also tells which sentence offends.  Disguised spellings are
undone before words and runs of words are hashed.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.linkage import _LOOK

#: Labelled documents that the model is fitted on, at most; hashed features; the score from which on
#: a document counts as abusive.
LABELLED, FEATURES, THRESHOLD = 20_000, 1 << 20, 0.5
#: Words of a window of a long sentence and from one window to the next; words whose features are
#: made at a time; tokens that a task remembers.
WINDOW, STEP, WORDS_AT_ONCE, KNOWN = 12, 6, 200_000, 200_000
_LEET = str.maketrans("0134578@$!|", "oieastbasil")
_END = re.compile(r"[.!?…。！？]+(?=\s|$)|\n+|</?p>|<br/?>")
_SPEAKER = re.compile(r"^\s*(?:[-*#>•]+\s+|\d+[.)]\s+|[^\W\d_]+:\s+)+")
_SPELLED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_*·•~/|,]{1,2}[^\W_]){2,}(?![^\W_])")
_TOKEN = re.compile(r"[^\W_]+(?:[*@$!|]+[^\W_]+)*")
_RUN = re.compile(r"(.)\1{2,}")
_UNSEEN = regex.compile(r"[\p{Mn}\p{Cf}]+")
_MIXED = re.compile(r"[^\W\d_]")


def _unspell(found: re.Match) -> str:
    text = found.group()
    letters = re.findall(r"[^\W_]", text)
    gaps = set(re.findall(r"[^\w]|_", text))
    return "".join(letters) if len(letters) >= 4 or len(gaps) == 1 and gaps != {" "} else text


def _word(token: str) -> str:
    """A token with disguises undone; all numbers are alike."""
    if token.isdigit():
        return "0"
    if not token.isalpha() and len(_MIXED.findall(token)) >= 2:
        token = token.translate(_LEET)
    return _RUN.sub(r"\1", token.translate(_LOOK))


class _Words(dict):
    """The words of tokens, looked up once each; emptied when it has grown large."""

    def __missing__(self, token: str) -> str:
        if len(self) >= KNOWN:
            self.clear()
        return self.setdefault(token, _word(token))


_WORDS = _Words()


def words(sentence: str) -> list[str]:
    """The words of a sentence, with disguises undone and numbers alike."""
    if sentence.isascii():
        text = sentence.lower()
    else:
        text = _UNSEEN.sub("", unicodedata.normalize("NFD", unicodedata.normalize("NFKC", sentence).casefold()))
    return [_WORDS[token] for token in _TOKEN.findall(_SPELLED.sub(_unspell, text))]


def instances(text: str) -> list[tuple[str, list[str]]]:
    """The sentences of a text with their words; long ones without stops as overlapping windows."""
    out, at = [], 0
    spans = [(m.start(), m.end()) for m in _END.finditer(text)] + [(len(text), len(text))]
    for end, following in spans:
        sentence = _SPEAKER.sub("", text[at:end]).strip()
        at = following
        w = words(sentence) if sentence else []
        if not w:
            continue
        if len(w) <= WINDOW + STEP:
            out.append((sentence, w))
        else:
            out += [(" ".join(w[i : i + WINDOW]), w[i : i + WINDOW]) for i in range(0, len(w) - STEP, STEP)]
    return out


#: Odd factors that mix the hashes of words of a run (fixed values).
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(kind: int, *parts: np.ndarray) -> np.ndarray:
    x = np.full(len(parts[0]), kind, np.uint64)
    for part, factor in zip(parts, _MIX):
        x = (x ^ part) * factor
        x ^= x >> np.uint64(29)
    return x


def features(sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, sizes): hashed features of all sentences one after another, and how many each has.

    They are a sentence's words, pairs and triples in a row, pairs with one word between, and runs of
    five letters of longer words, each once.  Hashes are made for each different word only.
    """
    known: dict[str, int] = {}
    at = np.fromiter((known.setdefault(w, len(known)) for s in sentences for w in s), np.int64)
    of = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    hashed = np.fromiter((xxhash.xxh32_intdigest(w) for w in known), np.uint64, len(known))
    inside = [[xxhash.xxh32_intdigest("#" + w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 6 else [] for w in known]
    many = np.array([len(x) for x in inside], np.int64)
    pieces = np.fromiter((h for x in inside for h in x), np.uint64)
    begin = np.cumsum(many) - many
    h, n = hashed[at], many[at]
    owner = [of, np.repeat(of, n)]
    place = np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    value = [h, _mixed(4, pieces[place])]
    for kind, steps in ((1, (0, 1)), (2, (0, 1, 2)), (3, (0, 2))):
        last = len(h) - steps[-1]
        whole = of[:last] == of[steps[-1] :] if last > 0 else np.zeros(0, bool)
        owner.append(of[: max(last, 0)][whole])
        value.append(_mixed(kind, *(h[s : s + last][whole] for s in steps)) if last > 0 else np.zeros(0, np.uint64))
    each = np.sort(np.concatenate(owner).astype(np.int64) * FEATURES + (np.concatenate(value) % np.uint64(FEATURES)).astype(np.int64))
    each = each[np.r_[True, each[1:] != each[:-1]][: len(each)]]
    return (each % FEATURES).astype(np.uint32), np.bincount(each // FEATURES, minlength=len(sentences))


def fit(flat: np.ndarray, sizes: np.ndarray, doc: np.ndarray, labels: np.ndarray, rounds: int = 300, penalty: float = 1e-5, noise: float = 0.05) -> np.ndarray:
    """Weights of the features, the bias last, that make the noisy-or of sentences fit the labels.

    ``flat`` has the features of all sentences, ``sizes`` how many each has and ``doc`` its document,
    in order.  A label is taken to be wrong with the probability ``noise``, so a document labelled
    abusive of which no sentence is like those of others moves the weights little.
    """
    weights = np.zeros(FEATURES + 1, np.float32)
    weights[-1] = -4.0
    if not len(flat) or not (0 < labels.mean() < 1):
        weights[-1] = -30.0  # nothing can be told apart
        return weights
    names, place = np.unique(flat, return_inverse=True)
    of = np.repeat(np.arange(len(sizes)), sizes)
    # Features of a single document say nothing about others; their weights stay 0.
    pairs = np.sort(place * np.int64(len(labels)) + doc[of])
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
    often = np.bincount(pairs // len(labels), minlength=len(names)) >= 2
    kept = often[place]
    names, place, of = names[often], (np.cumsum(often) - 1)[place[kept]], of[kept]
    some, start = np.unique(of, return_index=True)
    scale = 4 / np.sqrt(np.maximum(sizes, 1))
    slope = scale[of]
    keep = 1 - 2 * noise
    w, bias = np.zeros(len(names)), -4.0
    m, v, mb, vb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = np.full(len(sizes), bias)
        if len(start):
            z[some] += np.add.reduceat(w[place], start) * scale[some]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(labels))  # log of no sentence at all
        whole = np.clip(-np.expm1(none), 1e-9, 1 - 1e-9)
        said = noise + keep * whole  # the chance of the label abusive
        g = p * (keep * (1 - whole) * ((1 - labels) / (1 - said) - labels / said))[doc] / len(labels)
        gw = np.bincount(place, g[of] * slope, len(names)) + penalty * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w -= 0.05 * fix * m / (np.sqrt(v) + 1e-6)
        bias -= 0.05 * fix * mb / (np.sqrt(vb) + 1e-6)
    weights[names], weights[-1] = w, bias
    return weights


def _some(texts: Iterator[str | None]) -> Iterator[list[list[tuple[str, list[str]]]]]:
    """The instances of texts, a bounded number of words at a time or those of one text."""
    held, size = [], 0
    for text in texts:
        held.append(instances(text) if isinstance(text, str) else [])
        size += sum(len(w) for _, w in held[-1])
        if size >= WORDS_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def score(found: list[list[tuple[str, list[str]]]], weights: np.ndarray) -> list[tuple[float, str | None, float]]:
    """The score of each text by its instances, its worst sentence and that sentence's score."""
    doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
    if not len(doc):
        return [(0.0, None, 0.0)] * len(found)
    flat, sizes = features([w for x in found for _, w in x])
    z = np.add.reduceat(weights[flat].astype(np.float64), np.cumsum(sizes) - sizes) * 4 / np.sqrt(sizes) + float(weights[-1])
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(found))
    order = np.lexsort((-np.arange(len(doc)), p, doc))  # of equals the first
    last = np.flatnonzero(np.r_[doc[order][1:] != doc[order][:-1], True])
    worst = dict(zip(doc[order[last]].tolist(), order[last].tolist()))
    flat_sentences = [s for x in found for s, _ in x]
    return [(float(-np.expm1(none[d])), flat_sentences[worst[d]], float(p[worst[d]])) if d in worst else (0.0, None, 0.0) for d in range(len(found))]


def labelled(documents: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, their sizes, the document of each sentence, and labels of at most ``most`` labelled
    documents, chosen by hash and in the order of their ids.

    Null labels and repeated rows of a rater don't count; documents without text are left out.
    Features are made in the tasks; no text comes to the driver.
    """
    votes = labels.filter("abusive is not null and doc_id is not null").groupBy("doc_id", "rater").agg(F.max("abusive").alias("abusive")).groupBy("doc_id").agg(F.avg(F.col("abusive").cast("double")).alias("label"))
    some = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for found in _some(batch.text):
                flat, sizes = features([w for x in found for _, w in x])
                at = np.r_[0, np.cumsum([len(x) for x in found])]
                ends = np.r_[0, np.cumsum(sizes)]
                rows += [(flat[ends[i] : ends[j]].tobytes(), sizes[i:j].astype(np.int32).tobytes()) for i, j in zip(at, at[1:])]
            yield batch[["doc_id", "label"]].assign(flat=[r[0] for r in rows], sizes=[r[1] for r in rows])

    kind = dict(documents.dtypes)["doc_id"]
    texts = documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(some), "doc_id").select("doc_id", "label", "text")
    rows = texts.mapInPandas(run, f"doc_id {kind}, label double, flat binary, sizes binary").toPandas().sort_values(["doc_id", "flat"], ignore_index=True)
    sizes = [np.frombuffer(x, np.int32) for x in rows.sizes]
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in sizes])
    return np.frombuffer(b"".join(rows.flat), np.uint32), np.concatenate([*sizes, np.zeros(0, np.int32)]), doc, rows.label.to_numpy(float)


def scored(documents: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, source, score, worst, worst_score) of every document.

    Null, empty and blank texts score 0 and have no worst sentence.  Without labels of both kinds
    every text gets the same low score.  Repeated rows are all kept; other columns are dropped.
    """
    weights = documents.sparkSession.sparkContext.broadcast(fit(*labelled(documents, labels, most)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for found in _some(batch.text) for r in score(found, weights.value)]
            yield batch[["doc_id", "source"]].assign(score=[round(r[0], 6) for r in rows], worst=[r[1] for r in rows], worst_score=[round(r[2], 6) for r in rows])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "source", "text").mapInPandas(run, f"doc_id {kind}, source string, score double, worst string, worst_score double")


def rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, n_docs, n_abusive, rate, mean_score) of each source, null too."""
    bad = (F.col("score") >= threshold).cast("bigint")
    return scores.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(bad).alias("n_abusive"), F.round(F.avg(bad.cast("double")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
