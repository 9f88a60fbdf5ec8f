"""Column functions on text: words, sentences, byte spans and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A character of no meaning that marks ends of sentences for a moment.
_MARK = "\ue000"


def tokens(text: Column) -> Column:
    """Runs of letters and numbers with at least 2 bytes, lower-cased; a null text has none."""
    runs = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) >= 2)
    return F.coalesce(F.transform(runs, F.lower), F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Parts of a text that end with . ! or ? before white space; white space begins the next part."""
    marked = F.regexp_replace(text, r"([.!?])([ \t\n\f\r])", rf"$1{_MARK}$2")
    return F.filter(F.split(marked, _MARK, -1), lambda s: s != "")


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The bytes from ``start`` up to ``end`` of a text as text."""
    data = F.encode(text, "utf-8")
    return F.decode(F.substring(data, start.cast("int") + 1, (end - start).cast("int")), "utf-8")


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters and 2."""
    return F.floor(F.length(text) / 4) + 2


def normalised_name(name: Column) -> Column:
    """A name trimmed and lower-cased, without a possessive ending or trailing marks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "'s$", ""), r"[^\p{L}\p{N}]+$", "")


def contains_word(text: Column, needle: Column) -> Column:
    """Whether the needle stands in the text with no letter or number next to it."""
    quoted = F.regexp_replace(needle, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    return F.regexp_count(text, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quoted, F.lit(r"(?![\p{L}\p{N}])"))) > 0


def date_of_day(day: Column) -> Column:
    """The date of a day counted from 2018-01-01."""
    return F.date_add(F.lit("2018-01-01").cast("date"), day.cast("int"))


def content_hash(*parts: Column) -> Column:
    """A hash of values that tells null from empty and one boundary from another."""
    told = [F.when(p.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"))) for p in parts]
    return F.sha2(F.concat(*told), 256)


def seconds(created: Column) -> Column:
    """Seconds of a time that may be in milliseconds."""
    return F.when(created >= 100_000_000_000, F.floor(created / 1000)).otherwise(created).cast("bigint")


def date_seconds(iso: Column) -> Column:
    """Seconds since 1970 of a date YYYY-MM-DD; null for anything else."""
    return F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.unix_seconds(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))))


def event_record(secs: Column, source: Column, text: Column) -> Column:
    """The record of an event: its time in 8 bytes, the lowest first, its source in one, and its text."""
    time = F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(secs), 16, "0"), F.lit("(..)"))), ""))
    return F.concat(time, F.unhex(F.lpad(F.hex(source), 2, "0")), F.encode(text, "utf-8"))


def record_fields(record: Column) -> tuple[Column, Column, Column]:
    """(time, source, text) of a record; null if it is too short."""
    whole = F.octet_length(record) >= 9
    turned = F.array_join(F.reverse(F.regexp_extract_all(F.hex(F.substring(record, 1, 8)), F.lit("(..)"))), "")
    time = F.conv(turned, 16, -10).cast("bigint")
    text = F.decode(F.substring(record, 10, (1 << 31) - 1), "utf-8")
    return F.when(whole, time), F.when(whole, F.conv(F.hex(F.substring(record, 9, 1)), 16, 10).cast("int")), F.when(whole, text)


def extraction_of(raw: Column) -> Column:
    """The object (entities, facts) in what a model wrote, with or without fences around it."""
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.from_json(body, "entities array<string>, facts array<array<string>>")


def safe_id(text: Column) -> Column:
    """An id fit for a file's name: letters, digits, ``_`` and ``-`` of it, others as ``_``."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_")
