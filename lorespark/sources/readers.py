"""Readers and writers of the engine's files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of a corpus file (fixed values).
ENTRY = "struct<id:bigint,day:int,date:string,kind:string,text:string>"
TRUTH = (
    "struct<entities:array<struct<id:bigint,name:string,kind:string,cluster:string>>,"
    "recall:array<struct<id:int,question:string,answer:string,relevant_entries:array<bigint>>>,"
    "multi_hop:array<struct<id:int,question:string,answer:string,hop_entries:array<bigint>>>,"
    "temporal:array<struct<id:int,leading:bigint,trailing:bigint,lag_days:int,description:string,lead_entries:array<bigint>,trail_entries:array<bigint>>>,"
    "contradictions:array<struct<id:int,topic:string,entry_before:bigint,entry_after:bigint>>,"
    "insights:array<struct<id:int,bridge_entity:bigint,cluster_a:string,cluster_b:string,description:string,supporting_entries:array<bigint>,surprise:float>>,"
    "negative_bridges:array<struct<id:int,entity:bigint,clusters:array<string>,entries:array<bigint>>>>"
)
CORPUS = f"meta struct<seed:bigint,years:int,num_entries:bigint,difficulty:string>, entries array<{ENTRY}>, ground_truth {TRUTH}"
QUESTION_TYPES = frozenset("single-session-user single-session-assistant single-session-preference multi-session temporal-reasoning knowledge-update".split())


def corpus(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a nested corpus file, by name."""
    whole = spark.read.schema(CORPUS).json(path, multiLine=True)
    out = {"meta": whole.select("meta.*"), "entries": whole.select(F.inline("entries"))}
    for name in ("entities", "recall", "multi_hop", "temporal", "contradictions", "insights", "negative_bridges"):
        out[name] = whole.select(F.inline(F.col(f"ground_truth.{name}")))
    return out


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def dialogues(spark: SparkSession, path: str, category: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, questions) of conversation samples: turns in order of session, by sample.

    Entries are (sample, id, day, dia_id, text), questions (sample, qid, question, answer, category,
    relevant_entries).  A question without evidence among the turns is left out.
    """

    def samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            rows = []
            for text in batch.value:
                for number, sample in enumerate(json.loads(text)):
                    talk, at, ids = sample.get("conversation", {}), 0, {}
                    sessions = sorted((int(m[1]), k) for k in talk if (m := re.fullmatch(r"session_(\d+)", k)) and isinstance(talk[k], list))
                    for day, key in sessions:
                        for turn in talk[key]:
                            ids[_text(turn.get("dia_id"))] = at
                            rows.append((number, "turn", at, day, _text(turn.get("dia_id")), f"{_text(turn.get('speaker'))}: {_text(turn.get('text'))}", None, None, None))
                            at += 1
                    for q, qa in enumerate(sample.get("qa", [])):
                        hits = sorted({ids[d] for d in map(_text, qa.get("evidence") or []) if d in ids})
                        if hits and category in (None, qa.get("category")):
                            rows.append((number, "question", q, None, None, _text(qa.get("question")), _text(qa.get("answer")), qa.get("category"), hits))
            yield pd.DataFrame(rows, columns=["sample", "part", "id", "day", "dia_id", "text", "answer", "category", "relevant_entries"])

    schema = "sample int, part string, id bigint, day int, dia_id string, text string, answer string, category int, relevant_entries array<bigint>"
    both = spark.read.text(path, wholetext=True).mapInPandas(samples, schema)
    entries = both.filter("part = 'turn'").select("sample", "id", "day", "dia_id", "text")
    return entries, both.filter("part = 'question'").select("sample", F.col("id").alias("qid"), F.col("text").alias("question"), "answer", "category", "relevant_entries")


def memory_instances(spark: SparkSession, path: str, question_type: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, questions) of long-memory instances, each with its own entries.

    Entries are (instance, id, day, text) with day the session's number; relevant are turns with an
    answer, or else all turns of the answering sessions.  Ids ending in _abs are skipped; an unknown
    type is an error; ``limit`` counts instances after both.
    """
    if question_type not in (None, *QUESTION_TYPES):
        raise ValueError(f"unknown question type {question_type}")

    def instances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            rows = []
            for text in batch.value:
                kept = [x for x in json.loads(text) if not _text(x.get("question_id")).endswith("_abs") and question_type in (None, x.get("question_type"))][:limit]
                for number, x in enumerate(kept):
                    at, direct, of_session = 0, [], {}
                    for session, turns in enumerate(x.get("haystack_sessions", [])):
                        for turn in turns:
                            rows.append((number, "turn", at, session, f"{_text(turn.get('role'))}: {_text(turn.get('content'))}", None, None, None))
                            of_session.setdefault(session, []).append(at)
                            if turn.get("has_answer"):
                                direct.append(at)
                            at += 1
                    answering = [int(m[1]) for s in x.get("answer_session_ids", []) if (m := re.search(r"(\d+)$", _text(s)))]
                    relevant = direct or sorted(i for s in set(answering) for i in of_session.get(s, []))
                    rows.append((number, "question", number, None, _text(x.get("question")), _text(x.get("answer")), x.get("question_type"), relevant))
            yield pd.DataFrame(rows, columns=["instance", "part", "id", "day", "text", "answer", "question_type", "relevant_entries"])

    schema = "instance int, part string, id bigint, day int, text string, answer string, question_type string, relevant_entries array<bigint>"
    both = spark.read.text(path, wholetext=True).mapInPandas(instances, schema)
    return both.filter("part = 'turn'").select("instance", "id", "day", "text"), both.filter("part = 'question'").select("instance", F.col("text").alias("question"), "answer", "question_type", "relevant_entries")


def pooled(entries: DataFrame, group: str = "instance", id_col: str = "id") -> DataFrame:
    """Entries of all groups with one row of ids: each group's begin where those before end."""
    sizes = entries.groupBy(group).agg(F.count("*").alias("n"))  # one row for each group
    starts = sizes.withColumn("start", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(group)) - F.col("n")).drop("n")
    return entries.join(starts, group).withColumn("global_id", F.col("start") + F.col(id_col)).drop("start")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """A log of JSON lines; blank ones are skipped, bad ones are an error or, if not strict, skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if strict:
        return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    bad = "__bad string"
    parsed = lines.select(F.from_json("value", f"{schema}, {bad}", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r")).select("r.*")
    return parsed.filter("__bad is null").drop("__bad")


def _open(path: str):
    """(file system, path) of a URI, also of one with a single slash after ``file:``."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if path.startswith("file:") else path if "://" in path else f"file://{path}")


def raw_vectors(spark: SparkSession, path: str, dim: int, limit: int | None = None, rows_at_once: int = 65_536) -> DataFrame:
    """(vec_id, embedding) of files of little-endian float32 rows, each read in ranges by many tasks.

    Ids go on from file to file, in the order of their paths; the first ``limit`` rows if that is
    given.  A file whose length is no whole number of rows is an error.
    """
    files = sorted((r.path, r.length) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect())  # a row for each file
    ranges, begin = [], 0
    for name, length in files:
        if length % (4 * dim):
            raise ValueError(f"{length} bytes of {name} are no rows of {dim} numbers")
        count = length // (4 * dim) if limit is None else min(length // (4 * dim), max(0, limit - begin))
        ranges += [(name, at, min(rows_at_once, count - at), begin + at) for at in range(0, count, rows_at_once)]
        begin += length // (4 * dim)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, at, count, first in batch.itertuples(index=False):
                system, inner = _open(name)
                with system.open_input_file(inner) as file:
                    v = np.frombuffer(file.read_at(count * 4 * dim, at * 4 * dim), "<f4").reshape(-1, dim)
                for i in range(0, count, 4096):
                    yield pd.DataFrame({"vec_id": np.arange(first + i, first + min(count, i + 4096)), "embedding": list(v[i : i + 4096])})

    told = spark.createDataFrame(ranges, "path string, at bigint, count bigint, first bigint").repartition(max(1, len(ranges)))
    return told.mapInPandas(rows, "vec_id bigint, embedding array<float>")


def write_raw_vectors(vectors: DataFrame, path: str, id_col: str = "vec_id", v_col: str = "embedding") -> int:
    """Writes vectors as float32 rows in the order of their ids, a file for each range of ids.

    Files are named by their first id, so a task that runs again writes the same file.  The number
    of rows comes back.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, count = None, 0
        for batch in batches:
            if len(batch):
                if out is None:
                    system, inner = _open(path)
                    system.create_dir(inner, recursive=True)
                    out = system.open_output_stream(f"{inner}/rows-{int(batch.iloc[0, 0]):020d}.bin")
                out.write(np.vstack(batch.iloc[:, 1].to_numpy()).astype("<f4").tobytes())
                count += len(batch)
        if out is not None:
            out.close()
        yield pd.DataFrame({"n": [count]})

    ordered = vectors.select(id_col, v_col).repartitionByRange(id_col).sortWithinPartitions(id_col)
    return ordered.mapInPandas(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def replayed_vectors(vectors: DataFrame, entries: DataFrame, dim: int, id_col: str = "id") -> DataFrame:
    """(id, embedding): row i of a dump belongs to entry i in order of ids; any other number of rows is an error."""
    from lorespark.operators.store import dense_ids

    n, m = vectors.count(), entries.count()
    if n != m:
        raise ValueError(f"{n} vectors of {dim} numbers for {m} entries")
    placed = dense_ids(entries.select(id_col), [id_col], "vec_id")
    return placed.join(vectors, "vec_id").select(F.col(id_col).alias("id"), "embedding")


def extraction_facts(log: DataFrame) -> DataFrame:
    """(entry, subj, rel, obj) of facts of exactly three strings with both ends filled."""
    facts = log.select("entry", F.explode("facts").alias("f")).filter("size(f) = 3")
    return facts.select("entry", F.trim(F.col("f")[0]).alias("subj"), F.col("f")[1].alias("rel"), F.trim(F.col("f")[2]).alias("obj")).filter("subj != '' and obj != ''")


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_lists(assigned: DataFrame, path: str) -> None:
    """An index by lists: a query reads only the folders of the lists it probes."""
    assigned.repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(path)


def held_out(vectors: DataFrame, queries: int, id_col: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """(base, queries): the rows of the last ids are held out."""
    last = vectors.orderBy(F.desc(id_col)).limit(queries).select(id_col)
    return vectors.join(last, id_col, "left_anti"), vectors.join(last, id_col, "left_semi")
