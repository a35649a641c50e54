"""Sources: documents, stores, evaluation sets, token streams, logs."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clausewise import schemas

#: Which file of a document counts if it comes in several formats.
PRECEDENCE = ("html", "txt", "pdf")
LEAST_HTML = 50_000


def raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ext, text) of a folder's HTML and text files: one row per document, HTML before text."""
    files = spark.read.option("pathGlobFilter", "*.{html,txt}").text(path, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = files.select(F.url_decode(F.regexp_extract(name, r"^(.*)\.\w+$", 1)).alias("doc_id"), F.regexp_extract(name, r"\.(\w+)$", 1).alias("ext"), F.col("value").alias("text"))
    rank = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("ext"))
    first = F.row_number().over(W.partitionBy("doc_id").orderBy(rank))
    return rows.withColumn("n", first).where("n = 1").drop("n")


def pdf_documents(spark: SparkSession, path: str, text_of: Callable[[bytes], Iterable[str | None]] | None = None) -> DataFrame:
    """(doc_id, ext, text) of PDF files, pages joined by line ends.

    ``text_of`` gives a file's page texts; by default pypdf does, where it is installed.
    """

    def pages(content: bytes) -> Iterable[str | None]:
        if text_of is not None:
            return text_of(content)
        import io

        from pypdf import PdfReader

        return [page.extract_text() for page in PdfReader(io.BytesIO(content)).pages]

    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: "\n".join(p or "" for p in pages(bytes(c))))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("doc_id"), F.lit("pdf").alias("ext"), read("content").alias("text"))


def targets(spark: SparkSession, path: str, documents: DataFrame) -> DataFrame:
    """(doc_id, kind): files that are statutes, and text files of known documents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{html,txt,pdf}").load(path).select("path")
    named = files.select(F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("doc_id"), F.regexp_extract("path", r"\.(\w+)$", 1).alias("ext"))
    known = documents.select("doc_id")
    statutes = named.join(known, "doc_id", "left_anti").select("doc_id", F.lit("statute").alias("kind"))
    others = named.where("ext = 'txt'").join(known, "doc_id", "left_semi").select("doc_id", F.lit("document").alias("kind"))
    return statutes.unionByName(others).distinct().orderBy("doc_id")


def json_store(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a store that is one JSON map from id to text and metadata; ``pos`` is the order in the map."""
    text = spark.read.text(path, wholetext=True)
    kind = "map<string,struct<text:string,metadata:struct<regulation:string,article_number:string,article_title:string,chapter:string,chunk_index:int,total_chunks:int,source_url:string,language:string,doc_type:string,doc_date:string,in_force:boolean,document_label:string>>>"
    rows = text.select(F.posexplode(F.map_entries(F.from_json("value", kind))).alias("pos", "e"))
    return rows.select(F.col("e.key").alias("id"), F.col("pos").cast("long").alias("pos"), F.col("e.value.text").alias("text"), "e.value.metadata.*").withColumn(
        "doc_date", F.try_to_date(F.nullif("doc_date", F.lit("")))
    )


def gold_set(spark: SparkSession, path: str) -> DataFrame:
    items = spark.read.schema(f"items array<struct<{_fields(schemas.GOLD)}>>").json(path, multiLine=True)
    return items.select(F.explode("items").alias("i")).select("i.*")


def stability_set(spark: SparkSession, path: str) -> DataFrame:
    items = spark.read.schema(f"cases array<struct<{_fields(schemas.STABILITY)}>>").json(path, multiLine=True)
    return items.select(F.explode("cases").alias("i")).select("i.*")


def _fields(ddl: str) -> str:
    """Top-level columns of a DDL as fields of a struct."""
    columns, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            columns.append("")
        else:
            columns[-1] += c
    return ",".join(":".join(c.strip().split(" ", 1)) for c in columns)


def cases(spark: SparkSession, path: str, only: Iterable[str] | None = None) -> DataFrame:
    """Evaluation cases from YAML (read on the driver: such a file is written by hand), or some of them by id."""
    import json

    try:
        import yaml

        loaded = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except ImportError:  # JSON is YAML, too
        loaded = json.loads(Path(path).read_text(encoding="utf-8"))
    loaded = loaded["cases"] if isinstance(loaded, dict) else loaded
    lines = spark.createDataFrame([(json.dumps(c, ensure_ascii=False, default=str),) for c in loaded], "value string")
    rows = lines.select(F.from_json("value", schemas.CASES).alias("c")).select("c.*")
    return rows if only is None else rows.where(F.col("id").isin(*only))


def token_lines(spark: SparkSession, path: str) -> DataFrame:
    """(stream_id, seq, line) of recorded streams, a text file each; a stream is named as its file."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stream_id"), "value")
    return whole.select("stream_id", F.posexplode(F.split("value", r"\r?\n", -1)).alias("seq", "line"))


def ndjson_tokens(lines: DataFrame) -> DataFrame:
    """(stream_id, seq, piece) of newline-delimited JSON; lines from the first ``done`` on don't count."""
    parsed = lines.where("trim(line) <> ''").select("stream_id", "seq", F.from_json("line", "message struct<content:string>, done boolean").alias("j"))
    done = F.min(F.when(F.col("j.done"), F.col("seq"))).over(W.partitionBy("stream_id"))
    before = parsed.withColumn("end", done).where("end IS NULL OR seq <= end")
    return before.where("coalesce(j.message.content, '') <> ''").select("stream_id", "seq", F.col("j.message.content").alias("piece"))


def sse_tokens(lines: DataFrame) -> DataFrame:
    """(stream_id, seq, piece) of server-sent events up to ``[DONE]``."""
    data = lines.where(F.startswith("line", F.lit("data: "))).select("stream_id", "seq", F.trim(F.expr("substr(line, 7)")).alias("d"))
    done = F.min(F.when(F.col("d") == "[DONE]", F.col("seq"))).over(W.partitionBy("stream_id"))
    before = data.withColumn("end", done).where("end IS NULL OR seq < end")
    return before.select("stream_id", "seq", F.get_json_object("d", "$.choices[0].delta.content").alias("piece")).where("coalesce(piece, '') <> ''")


def chat_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CHAT_LOG).json(path)


def candidate_urls(meta: dict) -> list[str]:
    """Where a regulation may be fetched, in order."""
    celex, url = meta.get("celex"), meta.get("url")
    base = "https://eur-lex.europa.eu/legal-content/EN/TXT"
    found = [f"{base}/HTML/?uri=CELEX:{celex}", f"{base}/?uri=CELEX:{celex}"] if celex else []
    return list(dict.fromkeys([*([url] if url else []), *found]))


def download(meta: dict, target: str, fetch: Callable[[str], tuple[bytes, str]] | None = None) -> Path:
    """The first candidate that is a PDF, or HTML of a plausible length, as a file; a landing job for the driver."""

    def get(url: str) -> tuple[bytes, str]:
        with urllib.request.urlopen(url, timeout=60) as r:  # noqa: S310
            return r.read(), r.headers.get("Content-Type", "")

    problems = []
    for url in candidate_urls(meta):
        try:
            content, kind = (fetch or get)(url)
        except OSError as e:
            problems.append(f"{url}: {e}")
            continue
        pdf = content[:5] == b"%PDF-" or "pdf" in kind
        if pdf or len(content.decode("utf-8", "replace")) >= LEAST_HTML:
            path = Path(target).with_suffix(".pdf" if pdf else ".html")
            path.write_bytes(content)
            return path
        problems.append(f"{url}: too short")
    raise RuntimeError("no source could be fetched: " + "; ".join(problems))
