"""Pieces of long items, cut where the topic changes.

Every sentence end is a possible cut.  The words of the few sentences before and after it are
compared as two blocks; where their similarity lies in a deep valley, the topic changes.  Each
piece ends at the deepest valley that its size leaves in reach.  Where there is no sentence end,
it ends at white space, and where there is none, between two characters.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, BLOCK = 2000, 200, 4
#: Ends of sentences in many scripts, with closing marks and the white space after them (fixed value).
_END = re.compile(r"(?:[.!?…]+[\"'”’»)\]]*(?=\s|$)|[。！？｡؟۔।॥]+[\"'”’»)\]」』]*|\n)\s*")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W_]{2,}")


def _decode(data: bytes) -> str:
    """A string with as many characters as the bytes hold; stray bytes become characters too."""
    return data.decode("utf-8", "surrogateescape")


def _sizes(text: str, ends: list[int]) -> list[int]:
    """Byte offsets of rising character offsets."""
    out, at, size = [], 0, 0
    for end in ends:
        size += len(text[at:end].encode("utf-8", "surrogateescape"))
        at = end
        out.append(size)
    return out


def valleys(sentences: list[str], block: int = BLOCK) -> list[float]:
    """For the gap after each sentence but the last, how deep its valley of block similarity is."""
    bags = [Counter(_WORD.findall(s.lower())) for s in sentences]
    before, after = Counter(), Counter()
    for bag in bags[1 : 1 + block]:
        after.update(bag)
    like = []
    for i in range(len(bags) - 1):  # both blocks slide on by one sentence
        before.update(bags[i])
        if i >= block:
            before.subtract(bags[i - block])
        if i:
            after.subtract(bags[i])
            if i + block < len(bags):
                after.update(bags[i + block])
        small, large = (before, after) if len(before) < len(after) else (after, before)
        dot = sum(n * large[w] for w, n in small.items() if n and w in large)
        norm = math.sqrt(sum(n * n for n in before.values()) * sum(n * n for n in after.values()))
        like.append(dot / norm if norm else 0.0)
        if i % 64 == 63:
            before, after = +before, +after
    n = len(like)
    left, right = like[:], like[:]
    for i in range(1, n):  # the peak on each side: up while similarity doesn't fall
        if like[i - 1] >= like[i]:
            left[i] = left[i - 1]
    for i in range(n - 2, -1, -1):
        if like[i + 1] >= like[i]:
            right[i] = right[i + 1]
    return [left[i] + right[i] - 2 * like[i] for i in range(n)]


def cut(data: bytes, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> list[tuple[int, int]]:
    """The byte spans of the pieces of one item.

    They cover it in order, none has more than ``limit`` bytes, none begins or ends inside a
    character, and each shares at most ``overlap`` bytes with the one before.  An item within the
    limit is one piece; an empty one has none.
    """
    if limit < 2 * overlap + 8:
        raise ValueError("the limit must be more than twice the overlap and 8 bytes")
    if len(data) <= limit:
        return [(0, len(data))] if data else []
    text = _decode(data)
    chars = [m.end() for m in _END.finditer(text)]
    if not chars or chars[-1] < len(text):
        chars.append(len(text))
    sentences = [text[a:b] for a, b in zip([0, *chars], chars)]
    ends = _sizes(text, chars)
    depth = [*valleys(sentences, block), 0.0]
    spaces = _sizes(text, [m.end() for m in _SPACE.finditer(text)])

    def near(marks: list[int], low: int, high: int) -> list[int]:
        return marks[bisect.bisect_right(marks, low) : bisect.bisect_right(marks, high)]

    def whole(at: int) -> int:
        """The last character boundary that is not after ``at``."""
        back = at
        while back > at - 4 and back < len(data) and data[back] & 0xC0 == 0x80:
            back -= 1
        return back if back == len(data) or data[back] & 0xC0 != 0x80 else at

    spans, start, done = [], 0, 0
    while True:
        top = start + limit
        if top >= len(data):
            return [*spans, (start, len(data))]
        low = start + limit // 2  # pieces of less than half the limit only where nothing else is natural
        a, b = bisect.bisect_right(ends, low), bisect.bisect_right(ends, top)
        if a == b:
            a = bisect.bisect_right(ends, done + overlap)
        if a < b:
            end = ends[max(range(a, b), key=lambda i: (depth[i], i))]
        else:
            found = near(spaces, done + overlap, top)
            end = found[-1] if found else whole(top)
        spans.append((start, end))
        back = max(end - overlap, start + 1)
        found = near(ends, back - 1, end - 1) or near(spaces, back - 1, end - 1)
        start = found[0] if found else min(p for p in range(back, end + 1) if p == end or whole(p) == p)
        done = end


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> DataFrame:
    """(item_kind, item_id, piece_no, byte_start, byte_end, text) of every item over the limit.

    ``items`` holds (item_kind, item_id, data BINARY).  Items within the limit, null and empty ones
    have no rows; repeated items are cut each time they occur; null ids stay null.
    """
    long = items.filter(F.octet_length("data") > limit).select("item_kind", "item_id", "data")
    kind = dict(long.dtypes)["item_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, i, data in batch.itertuples(index=False):
                spans = cut(bytes(data), limit, overlap, block)
                yield pd.DataFrame({"item_kind": k, "item_id": pd.Series([i] * len(spans), dtype="object"), "piece_no": range(len(spans)), "byte_start": [a for a, _ in spans], "byte_end": [b for _, b in spans], "text": [bytes(data[a:b]).decode("utf-8", "replace") for a, b in spans]})

    return long.mapInPandas(run, f"item_kind string, item_id {kind}, piece_no int, byte_start int, byte_end int, text string")


def event_items(events: DataFrame) -> DataFrame:
    """Whole texts of events as items."""
    return events.filter("event_id is not null and text is not null").select(F.lit("event").alias("item_kind"), "event_id", F.encode("text", "utf-8").alias("data")).withColumnRenamed("event_id", "item_id")


def unit_items(units: DataFrame, events: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Spans of units over the limit, as items; spans that are not valid and unknown events give none.

    Only the few units over the limit are joined with their texts, and only texts that can hold one.
    """
    spans = units.select("unit_id", "event_id", F.col("byte_start").cast("bigint").alias("a"), F.col("byte_end").cast("bigint").alias("b")).filter(f"a >= 0 and b - a > {limit}")
    texts = events.select("event_id", F.encode("text", "utf-8").alias("whole")).filter(F.octet_length("whole") > limit)
    rows = spans.join(texts, "event_id").filter(F.col("b") <= F.octet_length("whole"))
    return rows.select(F.lit("unit").alias("item_kind"), F.col("unit_id").alias("item_id"), F.expr("substring(whole, cast(a + 1 as int), cast(b - a as int))").alias("data"))
