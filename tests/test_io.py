import json

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausewise.sources import readers, sinks
from clausewise.streaming import tags


def run(pieces):
    f = tags.TagFilter()
    return "".join([f.feed(p) for p in pieces] + [f.finish()])


def test_tag_filter_pieces():
    assert run(["a<th", "ink>x</thi", "nk>b"]) == "ab"
    assert run(["a <", " b"]) == "a < b"
    assert run(["a<think>never closed"]) == "a"
    assert run(["<thin"]) == "<thin"


@given(st.text("<>/thinkab", max_size=60), st.lists(st.integers(1, 5), max_size=40))
def test_cuts_do_not_matter(text, sizes):
    pieces, at = [], 0
    for n in sizes:
        pieces.append(text[at : at + n])
        at += n
    assert run([*pieces, text[at:]]) == run([text])


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s1", i, p, False) for i, p in enumerate(["Hi <th", "ink>secret</thi", "nk> there"])] + [("s1", 3, "", True), ("s2", 0, "x<think>y", False), ("s2", 1, "", True)]
    kind = "stream_id string, seq int, piece string, done boolean"
    for n in range(2):
        spark.createDataFrame(rows[n::2] if n else rows[::2], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "all"))
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = tags.filter_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("tags_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {}
    for r in spark.table("tags_out").orderBy("seq").collect():
        got[r.stream_id] = got.get(r.stream_id, "") + r.piece
    batch = {r.stream_id: r.text for r in tags.filter_batch(spark.createDataFrame(rows, kind)).collect()}
    assert got == batch == {"s1": "Hi  there", "s2": "x"}


def test_token_sources(spark):
    nd = spark.createDataFrame([("a", 0, '{"message":{"content":"x"},"done":false}'), ("a", 1, ""), ("a", 2, '{"message":{"content":"y"},"done":true}'), ("a", 3, '{"message":{"content":"z"}}')], "stream_id string, seq int, line string")
    assert [r.piece for r in readers.ndjson_tokens(nd).orderBy("seq").collect()] == ["x", "y"]
    sse = spark.createDataFrame([("a", 0, 'data: {"choices":[{"delta":{"content":"x"}}]}'), ("a", 1, ": ping"), ("a", 2, "data: [DONE]"), ("a", 3, 'data: {"choices":[{"delta":{"content":"z"}}]}')], "stream_id string, seq int, line string")
    assert [r.piece for r in readers.sse_tokens(sse).collect()] == ["x"]


def test_files(spark, tmp_path):
    for name, content in {"GDPR.txt": "t", "GDPR.html": "<p>h</p>", "D1.txt": "d", "KVKK.pdf": "%PDF-"}.items():
        (tmp_path / name).write_text(content)
    raw = {r.doc_id: (r.ext, r.text) for r in readers.raw_documents(spark, str(tmp_path)).collect()}
    assert raw == {"GDPR": ("html", "<p>h</p>"), "D1": ("txt", "d")}
    known = spark.createDataFrame([("D1",)], "doc_id string")
    assert [tuple(r) for r in readers.targets(spark, str(tmp_path), known).collect()] == [("D1", "document"), ("GDPR", "statute"), ("KVKK", "statute")]
    pdf = readers.pdf_documents(spark, str(tmp_path), lambda b: ["one", None, "two"]).collect()
    assert [(r.doc_id, r.text) for r in pdf] == [("KVKK", "one\n\ntwo")]


def test_stores_and_sets(spark, tmp_path):
    meta = {"regulation": "R", "article_number": "1", "chunk_index": 0, "total_chunks": 1, "doc_date": ""}
    (tmp_path / "docs.json").write_text(json.dumps({"b": {"text": "x", "metadata": meta}, "a": {"text": "y", "metadata": meta | {"doc_date": "2020-01-02"}}}))
    rows = readers.json_store(spark, str(tmp_path / "docs.json")).orderBy("pos").collect()
    assert [(r.id, str(r.doc_date)) for r in rows] == [("b", "None"), ("a", "2020-01-02")]
    (tmp_path / "gold.json").write_text(json.dumps({"items": [{"id": "1", "regulation": "R", "expected_articles": ["1", "2"]}]}))
    assert readers.gold_set(spark, str(tmp_path / "gold.json")).first().expected_articles == ["1", "2"]
    (tmp_path / "st.json").write_text(json.dumps({"cases": [{"id": "c", "must_retrieve_articles": [{"regulation": "R", "article": "1"}], "zero_citations": True}]}))
    assert readers.stability_set(spark, str(tmp_path / "st.json")).first().must_retrieve_articles[0].article == "1"
    (tmp_path / "cases.yaml").write_text(json.dumps([{"id": "Q1", "mode": "ask", "checks": {"forbid_regex": ["x"]}}, {"id": "Q2"}]))
    assert [r.id for r in readers.cases(spark, str(tmp_path / "cases.yaml"), only=["Q1"]).collect()] == ["Q1"]


def test_download(tmp_path):
    meta = {"celex": "3", "url": "u"}
    assert readers.candidate_urls(meta)[0] == "u"
    answers = {"u": (b"tiny", "text/html")}
    path = readers.download(meta, str(tmp_path / "R"), lambda url: answers.get(url, (b"%PDF-1.4", "")))
    assert path.suffix == ".pdf"


def test_sinks(spark, tmp_path):
    log = spark.createDataFrame([("2026-01-02 03:04:05", "u", "q", "a", ["s"])], "time string, user string, question string, answer string, sources array<string>").withColumn("time", F.to_timestamp("time"))
    for _ in range(2):
        sinks.append_chat_log(log, str(tmp_path / "log"))
    back = readers.chat_log(spark, str(tmp_path / "log"))
    assert back.count() == 2 and (tmp_path / "log" / "dt=2026-01-02").is_dir()
    graded = spark.createDataFrame([(1, "PASS", []), (2, "FAIL", ["x"])], "query_id int, status string, reasons array<string>")
    text = sinks.markdown_report(graded).first().value
    assert "PASS: 1, FAIL: 1, SKIP: 0" in text and "**2** FAIL: x" in text
    summary = spark.createDataFrame([("R", None, 2, 1, 0.5, 0.5), (None, "en", 2, 1, 0.5, 0.5), (None, None, 2, 1, 0.5, 0.5)], "regulation string, language string, total int, hits int, hit_rate double, mrr double")
    assert json.loads(sinks.eval_report(summary).first().value)["by_regulation"]["R"]["hits"] == 1
    answers = spark.createDataFrame([(1, "a [2]", [2], [("c", "t", 0.5)])], "query_id int, answer string, indices array<int>, sources array<struct<citation:string,text:string,score:double>>")
    assert json.loads(sinks.answer_payload(answers).first().json)["sources"][0]["index"] == 2


def test_recorded_token_streams(spark, tmp_path):
    (tmp_path / "a.log").write_text('{"message": {"content": "x"}}\r\n\n{"message": {"content": "y"}, "done": true}\n{"message": {"content": "z"}}\n')
    (tmp_path / "b.log").write_text('data: {"choices": [{"delta": {"content": "p"}}]}\n: note\ndata: {"choices": [{"delta": {}}]}\ndata: [DONE]\ndata: {"choices": [{"delta": {"content": "q"}}]}\n')
    lines = readers.token_lines(spark, str(tmp_path))
    assert sorted(map(tuple, readers.ndjson_tokens(lines.where("stream_id = 'a'")).collect())) == [("a", 0, "x"), ("a", 2, "y")]
    assert sorted(map(tuple, readers.sse_tokens(lines.where("stream_id = 'b'")).collect())) == [("b", 0, "p")]
