"""Sinks: articles, logs, reports, transcripts, API payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_articles(articles: DataFrame, path: str) -> None:
    """JSON by document, in order."""
    articles.repartition("doc_id").sortWithinPartitions("doc_id", "seq").write.mode("overwrite").partitionBy("doc_id").json(path)


def append_chat_log(log: DataFrame, path: str) -> None:
    """Appends exchanges, one folder per day."""
    log.withColumn("dt", F.to_date("time")).write.mode("append").partitionBy("dt").json(path)


def eval_report(summary: DataFrame) -> DataFrame:
    """One row of JSON from a summary by grouping sets with columns regulation and language."""
    cell = F.struct("hits", "total")
    by = lambda c, other: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull() & F.col(other).isNull(), F.struct(F.col(c).alias("k"), cell.alias("v"))))))
    whole = F.col("regulation").isNull() & F.col("language").isNull()
    pick = lambda c: F.max(F.when(whole, F.col(c)))
    report = summary.agg(pick("hit_rate").alias("hit_at_k"), pick("mrr").alias("mrr"), by("regulation", "language").alias("by_regulation"), by("language", "regulation").alias("by_language"))
    return report.select(F.to_json(F.struct("*")).alias("value"))


def markdown_report(graded: DataFrame) -> DataFrame:
    """One row of Markdown: a scorecard and the cases with their reasons."""
    line = F.concat(F.lit("- **"), F.col("query_id").cast("string"), F.lit("** "), "status", F.when(F.size("reasons") > 0, F.concat(F.lit(": "), F.array_join("reasons", "; "))).otherwise(""))
    count = lambda s: F.concat(F.lit(f"{s}: "), F.count_if(F.col("status") == s).cast("string"))
    rows = graded.agg(F.concat_ws(", ", count("PASS"), count("FAIL"), count("SKIP")).alias("score"), F.array_sort(F.collect_list(line)).alias("lines"))
    return rows.select(F.concat(F.lit("# Evaluation\n\n"), "score", F.lit("\n\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("value"))


def transcript(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", heads: dict[str, str] | None = None) -> DataFrame:
    """(conv_id, markdown): each conversation's messages in order. ``heads`` maps roles to headings."""
    heads = heads or {"user": "Question", "assistant": "Answer"}
    names = F.create_map(*[F.lit(x) for kv in heads.items() for x in kv])
    text = F.concat(F.lit("### "), F.coalesce(F.try_element_at(names, F.col("role")), F.col("role")), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    lists = messages.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), text.alias("m")))).alias("x"))
    return lists.select(conv, F.array_join(F.transform("x", lambda y: y["m"]), "\n").alias("markdown"))


def answer_payload(answers: DataFrame) -> DataFrame:
    """(query_id, json): an answer with its sources as an API returns them. ``sources``: array of structs in order of ``indices``."""
    zipped = F.transform(F.arrays_zip(F.col("indices").alias("i"), F.col("sources").alias("s")), lambda z: F.struct(z["i"].alias("index"), z["s"]["citation"].alias("citation"), z["s"]["text"].alias("text"), z["s"]["score"].alias("score")))
    return answers.select("query_id", F.to_json(F.struct("answer", zipped.alias("sources"))).alias("json"))


def search_payload(results: DataFrame, citation: Column) -> DataFrame:
    return results.select("query_id", "rank", citation.alias("citation"), "text", F.round("score", 4).alias("score"))
