"""What an index holds: regulations, document types, article ranges, and notes about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.functions.routing import single_regulation
from clausewise.functions.text import is_statute


def regulations(chunks: DataFrame) -> DataFrame:
    return chunks.select("regulation").distinct().orderBy("regulation")


def doc_types(chunks: DataFrame) -> DataFrame:
    kinds = F.array_sort(F.collect_set(F.coalesce("doc_type", F.lit("statute"))))
    return chunks.groupBy("regulation").agg(kinds.alias("doc_types"))


def article_range(chunks: DataFrame) -> DataFrame:
    """(regulation, lo, hi) over numeric statute articles."""
    number = F.col("article_number").try_cast("int")
    numeric = chunks.where(is_statute(F.col("doc_type")) & F.col("article_number").rlike("^[0-9]+$"))
    return numeric.groupBy("regulation").agg(F.min(number).alias("lo"), F.max(number).alias("hi"))


def scope_note(chunks: DataFrame) -> DataFrame:
    """(regulation, note): what the prompt says about the corpus."""
    both = doc_types(chunks).join(article_range(chunks), "regulation", "left")
    others = F.array_sort(F.transform(F.array_remove("doc_types", "statute"), lambda t: F.replace(t, F.lit("_"), F.lit(" "))))
    ranged = F.format_string("%s statute is indexed from Article %d to Article %d", "regulation", "lo", "hi")
    more = F.concat(F.lit("also indexed for "), "regulation", F.lit(": "), F.array_join(others, ", "))
    only = F.concat(F.lit("no Board (Kurul) decisions or guidance documents are indexed for "), "regulation", F.lit(" — statute text only"))
    parts = F.array_compact(F.array(F.when(F.col("lo").isNotNull(), ranged), F.when(F.size(others) > 0, more).otherwise(only)))
    return both.select("regulation", F.concat(F.lit("Corpus scope: "), F.array_join(parts, "; "), F.lit(".\n\n")).alias("note"))


def out_of_range(questions: DataFrame, chunks: DataFrame, regulation: Column | None = None) -> DataFrame:
    """(query_id, answer) for questions about an article that the statute doesn't have."""
    asked = F.lit(None).cast("string") if regulation is None else regulation
    named = single_regulation(F.col("query"))
    mention = F.regexp_extract("query", r"(?iU)\b(?:article|art\.?|madde)\s+(\d+)\b", 0)
    number = F.regexp_extract("query", r"(?iU)\b(?:article|art\.?|madde)\s+(\d+)\b", 1).try_cast("int")
    rows = questions.select(
        "query_id",
        F.coalesce(asked, named).alias("regulation"),
        (asked.isNotNull() & named.isNotNull() & (asked != named)).alias("other"),
        F.col("query").rlike(r"(?U)\b\d{4}/\d{1,5}\b").alias("numbered"),
        F.lower(mention).startswith("madde").alias("turkish"),
        number.alias("n"),
    )
    missed = rows.join(article_range(chunks), "regulation").where("n IS NOT NULL AND NOT other AND NOT numbered AND NOT (n BETWEEN lo AND hi)")
    tr = F.format_string("%s Madde %d mevcut değil — bu külliyatta %s Madde %d ile Madde %d arasında indekslenmiştir.", "regulation", "n", "regulation", "lo", "hi")
    en = F.format_string("%s Article %d does not exist — %s in this corpus is indexed from Article %d to Article %d.", "regulation", "n", "regulation", "lo", "hi")
    return missed.select("query_id", F.when(F.col("turkish"), tr).otherwise(en).alias("answer"))
