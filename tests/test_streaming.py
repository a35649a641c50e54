"""Streams: pieces while answers are spoken, abandoned streams, a log that restarts, empty batches of questions."""

import os
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clausewise import schemas
from clausewise.plans import ask
from clausewise.streaming import speak, tags

ROOT = str(Path(__file__).resolve().parent.parent)


def until(test, seconds=60):
    end = time.time() + seconds
    while not test() and time.time() < end:
        time.sleep(0.1)
    assert test()


def test_pieces_leave_before_the_answer_ends(spark, tmp_path):
    class Slow:
        """Says sixteen words and writes down when."""

        def __init__(self, path):
            self.path = path

        def chat(self, system, user, reasoning=False):
            return "".join(self.stream_chat(system, user, reasoning))

        def stream_chat(self, system, user, reasoning=False):
            for k in range(16):
                time.sleep(0.05)
                with open(self.path, "a") as f:
                    f.write(f"{user} {k} {time.time()}\n")
                yield f"{user}{k} "

    spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "query_id string, prompt string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("query_id string, prompt string").parquet(f"{tmp_path}/in")
    spoken = speak.speak(stream, Slow(f"{tmp_path}/said"), "s", seconds=0.3, pieces=5, run=str(tmp_path))
    seen = []
    q = spoken.writeStream.foreachBatch(lambda df, n: seen.extend((time.time(), *r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        until(lambda: sum(r[4] for r in seen) == 3, 120)
    finally:
        q.stop()
    for key, prompt in (("a", "x"), ("b", "y"), ("c", "")):
        mine = sorted((r[2], r[3], r[4], r[0]) for r in seen if r[1] == key)
        assert [m[:3] for m in mine] == [(k, f"{prompt}{k} ", False) for k in range(16)] + [(16, "", True)]
        made = [float(line.rsplit(" ", 1)[1]) for line in Path(f"{tmp_path}/said").read_text().splitlines() if line.startswith(f"{prompt} ")]
        assert mine[0][3] < max(made)


def test_an_answer_goes_on_where_it_was_in_another_worker():
    speak._open.clear()
    start = lambda: iter("abcdef")
    assert list(speak._resumed(("r", 1, "p"), 2, start)) == list("cdef")
    speak._open["r", 1, "p"] = (2, iter("xyz"))
    assert list(speak._resumed(("r", 1, "p"), 2, start)) == list("xyz") and not speak._open
    speak._open["r", 1, "p"] = (1, iter("xyz"))
    assert list(speak._resumed(("r", 1, "p"), 2, start)) == list("cdef")


def test_abandoned_streams_are_flushed_and_forgotten(spark, tmp_path):
    kind = "stream_id string, seq int, piece string, done boolean"
    rows = [("a", 0, "hello <thi", False), ("b", 0, "x<think>secret", False), ("c", 0, "whole", True)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = tags.filter_stream(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), idle="2 seconds")
    seen = []
    q = stream.writeStream.foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        until(lambda: ("a", 1, "<thi") in seen, 90)
        until(lambda: q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0)
    finally:
        q.stop()
    assert sorted(seen) == [("a", 0, "hello "), ("a", 1, "<thi"), ("b", 0, "x"), ("c", 0, "whole")]


def test_the_log_has_each_exchange_once_after_a_restart(spark, tmp_path):
    def add(k):
        rows = [(f"2026-01-0{k} 10:00:00", "u", f"q{k}", "a", ["s"])]
        df = spark.createDataFrame(rows, "time string, user string, question string, answer string, sources array<string>")
        df.withColumn("time", F.to_timestamp("time")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        exchanges = spark.readStream.schema(schemas.CHAT_LOG).parquet(f"{tmp_path}/in")
        tags.append_log(exchanges, f"{tmp_path}/log", f"{tmp_path}/check").awaitTermination(120)

    add(1)
    run()
    # the batch was written, but the job died before it could say so
    (commit,) = [p for p in Path(f"{tmp_path}/check/commits").iterdir() if p.name == "0"]
    commit.unlink()
    (Path(f"{tmp_path}/check/commits") / ".0.crc").unlink(missing_ok=True)
    add(2)
    run()
    log = spark.read.json(f"{tmp_path}/log")
    assert sorted((str(r.dt), r.question) for r in log.collect()) == [("2026-01-01", "q1"), ("2026-01-02", "q2")]


@pytest.fixture(scope="module")
def chunks(spark):
    kind = "id string, pos long, text string, regulation string, article_number string, article_title string, document_label string, doc_type string, language string, chunk_index int, total_chunks int"
    rows = [(f"r{k}", k, f"word{k} duty of the entity", r, str(k + 1), "", "", "statute", "en", 0, 1) for k, r in enumerate(["GDPR", "DORA", "KVKK"] * 2)]
    return spark.createDataFrame(rows, kind)


def test_empty_and_wholly_denied_batches(spark, chunks):
    asked = spark.createDataFrame([(1, "What does GDPR Article 99 say?", "GDPR")], "query_id int, query string, regulation string")
    assert ask.ask(asked.limit(0), chunks).count() == 0
    denied = ask.ask(asked, chunks).collect()
    assert [r.query_id for r in denied] == [1] and denied[0].indices == []
    pairs = spark.createDataFrame([(1, "which deadlines?", "GDPR", "GDPR")], "query_id int, query string, reg_a string, reg_b string")
    assert [r.query_id for r in ask.compare(pairs, chunks).collect()] == [1]
    assert ask.compare(pairs.limit(0), chunks).count() == 0


def test_a_session_without_a_checkpoint_folder(tmp_path):
    code = "from clausewise.session import local_session, scratch_dir, keep; s = local_session('1', '1g'); print(keep(s.range(3), scratch_dir(s, 'x') + '/t').count())"
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("3"), done.stderr[-2000:]
