import json

import numpy as np
import pytest

from lorespark.sources import readers
from lorespark.streaming import ingest


def test_corpus(spark, tmp_path):
    data = {"meta": {"seed": 1, "years": 2, "num_entries": 1, "difficulty": "v1"}, "entries": [{"id": 0, "day": 3, "date": "2018-01-04", "kind": "text", "text": "x"}], "ground_truth": {"recall": [{"id": 1, "question": "q", "answer": "a", "relevant_entries": [0]}]}}
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps(data))
    tables = readers.corpus(spark, str(path))
    assert tables["entries"].first().day == 3
    assert tables["recall"].first().relevant_entries == [0]
    assert tables["insights"].count() == 0


def test_dialogues(spark, tmp_path):
    talk = {"speaker_a": "A", "speaker_b": "B", "session_2": [{"speaker": "B", "dia_id": "D2:1", "text": "later"}], "session_1": [{"speaker": "A", "dia_id": "D1:1", "text": "hi"}, {"speaker": "B", "dia_id": "D1:2", "text": "yo"}], "session_1_date_time": "x"}
    qa = [{"question": "q", "answer": 7, "evidence": ["D2:1", "zz"], "category": 1}, {"question": "none", "answer": "x", "evidence": [], "category": 1}]
    path = tmp_path / "talk.json"
    path.write_text(json.dumps([{"conversation": talk, "qa": qa}]))
    entries, questions = readers.dialogues(spark, str(path))
    assert [(r.id, r.day, r.text) for r in entries.orderBy("id").collect()] == [(0, 1, "A: hi"), (1, 1, "B: yo"), (2, 2, "B: later")]
    assert [(r.answer, r.relevant_entries) for r in questions.collect()] == [("7", [2])]
    assert readers.dialogues(spark, str(path), category=2)[1].count() == 0


def test_memory_instances(spark, tmp_path):
    turns = [[{"role": "user", "content": "a"}, {"role": "assistant", "content": "b", "has_answer": True}], [{"role": "user", "content": "c"}]]
    base = {"question": "q", "answer": 1, "question_type": "multi-session", "haystack_sessions": turns}
    plain = [[{"role": "user", "content": "a"}], [{"role": "user", "content": "c"}, {"role": "user", "content": "d"}]]
    data = [base | {"question_id": "x", "answer_session_ids": ["s_1"]}, base | {"question_id": "y_abs"}, base | {"question_id": "z", "haystack_sessions": plain, "answer_session_ids": ["s_1", "s_9"]}]
    path = tmp_path / "memory.json"
    path.write_text(json.dumps(data))
    entries, questions = readers.memory_instances(spark, str(path), "multi-session")
    assert [r.relevant_entries for r in questions.orderBy("instance").collect()] == [[1], [1, 2]]
    ids = [r.global_id for r in readers.pooled(entries).orderBy("global_id").collect()]
    assert ids == list(range(6))
    assert readers.memory_instances(spark, str(path), limit=1)[1].count() == 1
    with pytest.raises(ValueError):
        readers.memory_instances(spark, str(path), "other")


def test_json_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"entry": 1, "facts": [["a", "r", "b"], ["a", "b"], ["", "r", "b"]]}\n\n{bad\n')
    schema = "entry long, facts array<array<string>>"
    good = readers.json_lines(spark, str(path), schema, strict=False)
    assert good.count() == 1
    assert [tuple(r) for r in readers.extraction_facts(good).collect()] == [(1, "a", "r", "b")]
    with pytest.raises(Exception):
        readers.json_lines(spark, str(path), schema).collect()


def test_raw_vectors(spark, tmp_path):
    v = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "v.bin").write_bytes(v.tobytes())
    got = readers.raw_vectors(spark, str(tmp_path / "v.bin"), 4).orderBy("vec_id").collect()
    assert [r.embedding for r in got] == v.tolist()
    with pytest.raises(Exception):
        readers.raw_vectors(spark, str(tmp_path / "v.bin"), 5).collect()
    base, last = readers.held_out(readers.raw_vectors(spark, str(tmp_path / "v.bin"), 4), 1)
    assert (base.count(), last.first().vec_id) == (2, 2)


EVENTS = "event_id long, created_utc_secs long, source string, text string"


def test_ingest_as_a_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, "text", "One. Two."), (2, 1, "text", "One. Two.")], EVENTS).write.parquet(folder)
    for more in ([(3, 1, "text", "One. Two."), (4, 2, "voice", "Three")], []):
        if more:
            spark.createDataFrame(more, EVENTS).write.mode("append").parquet(folder)
        ingest.ingest(ingest.read_events(spark, folder, EVENTS), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    ids = [r.event_id for r in spark.read.parquet(str(tmp_path / "store/events")).collect()]
    assert len(ids) == 2 and 4 in ids
    assert spark.read.parquet(str(tmp_path / "store/units")).count() == 3


def test_streams_drop_repeats(spark, tmp_path):
    folder = str(tmp_path / "in")
    data = [(1, 1, "text", "a", 0), (2, 1, "text", "a", 60), (3, 1, "text", "b", 120)]
    spark.createDataFrame(data, EVENTS + ", at long").selectExpr("*", "timestamp_seconds(at) ts").drop("at").write.parquet(folder)
    stream = ingest.read_events(spark, folder, EVENTS + ", ts timestamp")
    for name, df in (("within", ingest.distinct_within(stream, "ts", "1 hour")), ("ever", ingest.distinct_ever(stream)), ("wide", ingest.windowed_counts(stream, "ts", "1 minute", "1 hour", "source"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("within").count() == 2 == spark.table("ever").count()
