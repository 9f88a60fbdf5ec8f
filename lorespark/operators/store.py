"""An append-only log of events and the units derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import byte_slice, content_hash, sentences


def event_hash(events: DataFrame) -> DataFrame:
    """Adds ``hash`` of time, source and text."""
    return events.withColumn("hash", content_hash(F.col("created_utc_secs"), F.col("source"), F.col("text")))


def distinct_events(events: DataFrame) -> DataFrame:
    """(event_id, copies): the first event of each content, aggregated before it is shuffled."""
    return event_hash(events).groupBy("hash").agg(F.min("event_id").alias("event_id"), F.count("*").alias("copies")).select("event_id", "copies")


def append_events(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The events of a batch that the store doesn't hold yet, once each."""
    new = event_hash(batch)
    first = new.groupBy("hash").agg(F.min("event_id").alias("event_id"))
    return new.join(first, ["hash", "event_id"], "left_semi").dropDuplicates(["hash"]).join(event_hash(store).select("hash"), "hash", "left_anti").drop("hash")


def sentence_units(events: DataFrame, id_col: str = "event_id") -> DataFrame:
    """(event_id, unit_no, byte_start, byte_end) of the sentences of each event; blank ones too."""
    parts = events.select(F.col(id_col).alias("event_id"), F.posexplode(sentences(F.col("text"))).alias("unit_no", "sentence")).withColumn("size", F.octet_length("sentence"))
    end = F.sum("size").over(Window.partitionBy("event_id").orderBy("unit_no"))
    return parts.withColumn("byte_end", end).select("event_id", "unit_no", (F.col("byte_end") - F.col("size")).alias("byte_start"), "byte_end")


def unit_status(units: DataFrame, events: DataFrame) -> DataFrame:
    """(unit_id, status): ok, unknown_event or bad_span."""
    sizes = events.select("event_id", F.octet_length("text").alias("size"), F.lit(True).alias("known"))
    good = (F.col("byte_start") >= 0) & (F.col("byte_start") < F.col("byte_end")) & (F.col("byte_end") <= F.coalesce("size", F.lit(0)))
    status = F.when(F.col("known").isNull(), "unknown_event").when(F.coalesce(good, F.lit(False)), "ok").otherwise("bad_span")
    return units.join(sizes, "event_id", "left").select("unit_id", status.alias("status"))


def unit_texts(units: DataFrame, events: DataFrame) -> DataFrame:
    """(unit_id, event_id, text) of the valid units."""
    rows = units.join(events.select("event_id", F.col("text").alias("whole")), "event_id").filter("byte_start >= 0 and byte_start < byte_end and byte_end <= octet_length(whole)")
    return rows.select("unit_id", "event_id", byte_slice(F.col("whole"), F.col("byte_start"), F.col("byte_end")).alias("text"))


def last_wins(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; ``order`` must end in what tells any two rows apart."""
    columns = [c for c in log.columns if c not in key]
    last = log.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("last"))
    return last.select(*key, "last.*")


def dense_ids(rows: DataFrame, order: list[str], name: str = "new_id", part_rows: int = 1_000_000) -> DataFrame:
    """Adds ids 0, 1, 2, … in the given order, without bringing all rows to one task.

    Rows are sorted by range; the number of rows in the partitions before is added to the place of
    a row within its own.
    """
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    from lorespark.session import materialise

    placed = materialise(placed)
    counts = placed.groupBy("__part").agg(F.count("*").alias("n"))  # one row for each partition
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__part")) - F.col("n")).drop("n")
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("before") + F.col("__place")).drop("__part", "__place", "before")


def tail(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    """The rows of the last ``n`` different ids; only those ids are sorted, partly in each task."""
    last = rows.select(id_col).filter(F.col(id_col).isNotNull()).distinct().orderBy(F.desc(id_col)).limit(n)
    return rows.join(F.broadcast(last), id_col, "left_semi") if n <= 100_000 else rows.join(last, id_col, "left_semi")


def surrogate_keys(rows: DataFrame, name_col: str, order: list[str]) -> DataFrame:
    """(name, key): each different name numbered from 0 in the order in which it is first seen."""
    first = rows.filter(F.col(name_col).isNotNull()).groupBy(F.col(name_col).alias("name")).agg(F.min(F.struct(*order)).alias("seen"))
    return dense_ids(first, ["seen", "name"], "key").select("name", "key")


def shuffled(rows: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Adds ``place``: a random order, the same for the same seed whatever the partitioning."""
    return dense_ids(rows.withColumn("__draw", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))), ["__draw", id_col], "place").drop("__draw")


def strided(rows: DataFrame, order: list[str], target: int) -> DataFrame:
    """Every n-th row in order, from the first, so that about and at most ``target`` come out."""
    placed = dense_ids(rows, order, "place")
    stride = max(1, placed.count() // max(1, target))
    return placed.filter((F.col("place") % stride == 0) & (F.col("place") < stride * target)).drop("place")


def parted(counts: DataFrame, total: int, by: str, weight: str) -> DataFrame:
    """(by, share): a whole number of ``total`` for each row in proportion to its weight.

    What rounding down leaves goes to the largest remainders, of equals to the first in order.
    ``counts`` is a small table, a row for each part.
    """
    grand = counts.agg(F.sum(weight)).first()[0] or 1
    exact = counts.select(by, (F.col(weight) * total / F.lit(grand)).alias("exact"), F.floor(F.col(weight) * total / F.lit(grand)).alias("whole"))
    left = total - int(exact.agg(F.sum("whole")).first()[0] or 0)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("exact") - F.col("whole"), 9)), by))
    return exact.select(by, (F.col("whole") + (place <= left).cast("bigint")).alias("share"))


def units_as_entries(units: DataFrame, events: DataFrame) -> DataFrame:
    """(id, day, date, kind, text): one entry for each valid unit, dated by the time of its event."""
    from lorespark.functions.text import seconds

    when = events.select("event_id", F.to_date(F.timestamp_seconds(seconds(F.col("created_utc_secs")))).alias("on"), "source")
    rows = unit_texts(units, events).join(when, "event_id", "left")
    return rows.select(F.col("unit_id").alias("id"), F.datediff("on", F.lit("2018-01-01").cast("date")).alias("day"), F.date_format("on", "yyyy-MM-dd").alias("date"), F.col("source").alias("kind"), "text")


def storage(units: DataFrame, events: DataFrame) -> DataFrame:
    """One row: bytes of text, of records and of unit spans, their ratio and the index bytes of a unit.

    A record has 9 bytes besides its text, a span 16.
    """
    e = events.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("text_bytes"), F.count("*").alias("n_events"))
    u = units.agg(F.count("*").alias("n_units"))
    spans = F.col("n_units") * 16
    records = F.col("text_bytes") + F.col("n_events") * 9
    return e.crossJoin(u).select("text_bytes", records.alias("record_bytes"), spans.alias("span_bytes"), F.round((records + spans) / F.greatest("text_bytes", F.lit(1)), 6).alias("overhead"), F.when(F.col("n_units") > 0, 16.0).otherwise(0.0).alias("unit_bytes"))


def watermark(events: DataFrame, id_col: str = "event_id") -> DataFrame:
    """One row: how many rows there are and the highest id, so that a reader can go on from there."""
    return events.agg(F.count("*").alias("n"), F.max(id_col).alias("high"))


def above(events: DataFrame, high: int, id_col: str = "event_id") -> DataFrame:
    """The rows past a watermark; the bound is pushed to the scan, where row groups below it are skipped."""
    return events.filter(F.col(id_col) > high)


def merged_runs(runs: list[DataFrame], most: int = 8) -> list[DataFrame]:
    """Runs (hash, event_id) with the first id of each hash; more than ``most`` become one."""
    if len(runs) <= most:
        return runs
    both = runs[0]
    for run in runs[1:]:
        both = both.unionByName(run)
    return [both.groupBy("hash").agg(F.min("event_id").alias("event_id"))]


def expanded_texts(entries: DataFrame, log: DataFrame) -> DataFrame:
    """(id, text): texts with the questions of a log (entry, line, questions) added, one a line.

    The last line of an entry counts; questions are trimmed and blank ones left out.
    """
    last = last_wins(log.select("entry", "line", "questions"), ["entry"], ["line"])
    kept = F.filter(F.transform("questions", F.trim), lambda q: q != "")
    more = last.select(F.col("entry").alias("id"), F.array_join(kept, "\n").alias("more"))
    text = F.when(F.coalesce("more", F.lit("")) == "", F.col("text")).otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.col("more")))
    return entries.select("id", "text").join(more, "id", "left").select("id", text.alias("text"))
