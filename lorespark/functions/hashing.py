"""FNV-1a hashes of UTF-8 text, for logs that are keyed by them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the hash.
OFFSET, PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


def fnv1a(data: bytes, seed: int = OFFSET) -> int:
    for byte in data:
        seed = (seed ^ byte) * PRIME & MASK
    return seed


@F.pandas_udf(T.StringType())
def fnv1a_hex(texts: pd.Series) -> pd.Series:
    """The hash as 16 hexadecimal digits; null stays null."""
    return texts.map(lambda t: f"{fnv1a(t.encode()):016x}", na_action="ignore")
