"""Exact ids of a public byte-level tokenizer.

The pattern that splits a text into words before merging looks ahead only, so a cut in front of
white space that follows a non-space never changes the ids on either side.  Text that holds no
such place for long is split by the pattern itself; a single word of many bytes is then halved
again and again, the halves are encoded in parallel, and around each join a growing window is
encoded anew until its outer tokens fit their neighbours on both sides.

Two neighbouring tokens fit if encoding their joined bytes gives the same two tokens; a sequence
in which all neighbours fit is the encoding of its bytes, so the joined result is exact.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
#: Texts of more characters are cut at white space, words of more bytes are halved.
PIECE_CHARS = 4096
WORD_BYTES = 512
#: The split pattern of the vocabulary (fixed value, published with it).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def encoder(directory: str = TOKENIZERS, name: str = NAME):
    """The encoder of one vocabulary file, once for each Python worker."""
    import tiktoken

    with open(os.path.join(directory, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _fits(enc, left: int, right: int) -> bool:
    both = enc.decode_single_token_bytes(left) + enc.decode_single_token_bytes(right)
    return enc._encode_single_piece(both) == [left, right]


def join_ids(enc, left: list[int], right: list[int]) -> list[int]:
    """The ids of two encoded byte strings of one word, joined."""
    if not left or not right:
        return left or right
    if _fits(enc, left[-1], right[0]):
        return left + right
    width = 2
    while True:
        a, b = max(0, len(left) - width), min(len(right), width)
        window = b"".join(map(enc.decode_single_token_bytes, left[a:] + right[:b]))
        ids = enc._encode_single_piece(window)
        if (a == 0 or _fits(enc, left[a - 1], ids[0])) and (b == len(right) or _fits(enc, ids[-1], right[b])):
            return left[:a] + ids + right[b:]
        width *= 2


def encode_word(enc, word: bytes, word_bytes: int = WORD_BYTES, pool: ThreadPoolExecutor | None = None) -> list[int]:
    """The ids of one word of the pattern, of any length, by a tree of joins."""
    if len(word) <= word_bytes:
        return enc._encode_single_piece(word)
    parts = [word[i : i + word_bytes] for i in range(0, len(word), word_bytes)]
    level = list((pool.map if pool else map)(enc._encode_single_piece, parts))
    while len(level) > 1:
        level = [join_ids(enc, *level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


#: In front of plain white space after anything that no definition calls white space.
_SAFE = re.compile(r"(?<=\S)(?=[ \t\r\n])")
_WORD = PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def pieces(text: str, piece_chars: int = PIECE_CHARS) -> Iterator[tuple[str, bool]]:
    """Parts of a text that can be encoded alone; True marks one without a safe place to cut."""
    start = 0
    while len(text) - start > piece_chars:
        cut = None
        for found in _SAFE.finditer(text, start + piece_chars // 2, start + piece_chars):
            cut = found.start()
        if cut is None:
            found = _SAFE.search(text, start + piece_chars)
            cut = found.start() if found else len(text)
        yield text[start:cut], cut - start > piece_chars
        start = cut
    if start < len(text):
        yield text[start:], False


def encode_text(enc, text: str, piece_chars: int = PIECE_CHARS, word_bytes: int = WORD_BYTES, pool: ThreadPoolExecutor | None = None) -> list[int]:
    """The ids of a whole text; equal to encoding it in one go."""
    if len(text) <= piece_chars:
        return enc.encode_ordinary(text)
    import regex

    out: list[int] = []
    for piece, unsplit in pieces(text, piece_chars):
        if not unsplit:
            out += enc.encode_ordinary(piece)
            continue
        for word in regex.finditer(_WORD, piece):
            out += encode_word(enc, word.group().encode(), word_bytes, pool)
    return out


def _batches(count_only: bool, directory: str, name: str, piece_chars: int, word_bytes: int, keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(directory, name)
        with ThreadPoolExecutor(2) as pool:
            for batch in batches:
                texts = batch.column(text).to_pylist()
                ids = [encode_text(enc, t, piece_chars, word_bytes, pool) if t else [] for t in texts]
                out = pa.array(map(len, ids), pa.int64()) if count_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), out], [*keep, "n_tokens" if count_only else "ids"])

    return run


def encode_ids(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", directory: str = TOKENIZERS, name: str = NAME, piece_chars: int = PIECE_CHARS, word_bytes: int = WORD_BYTES) -> DataFrame:
    """(id, ids) of every row: one scan, no shuffle.

    Null and empty texts give an empty list; a null id stays null; repeated rows are all kept;
    other columns, whatever their names, are dropped; an empty table gives an empty result.
    """
    rows = documents.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = dict(rows.dtypes)[id_col]
    run = _batches(False, directory, name, piece_chars, word_bytes, [id_col], "__text")
    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], text_col: str = "text", directory: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of every row; null and empty texts have 0 tokens."""
    rows = documents.select(*keep, F.col(text_col).alias("__text"))
    kinds = dict(rows.dtypes)
    run = _batches(True, directory, name, PIECE_CHARS, WORD_BYTES, keep, "__text")
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens bigint"]))
