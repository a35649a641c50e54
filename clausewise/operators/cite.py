"""Citations in generated answers: which hold, which sources they name, and how those are grouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clausewise.functions.text import CITATION, citation, fill_blank_cells, is_grounded, is_statute, replace_each, strip_unexpected_script

# Named articles, where a claim ends, what a removed marker leaves behind, and how doubt is worded.
PROSE = r"(?iU)\b(DORA|GDPR|KVKK)\s+(?:Article|Art\.?|Madde)\s+(\d+)\b"
CLAIM_END = r"(?<=[.!?\n|])"
LEFTOVERS = ((r"(?U)\s+and\s*([.,;:]|$)", "$1"), (r"(?U),\s*([.,;:])", "$1"), (r" {2,}", " "), (r" ([.,;:])", "$1"))
UNCONFIRMED = {"en": " (article number not confirmed in the sources)", "tr": " (madde numarası kaynaklarda doğrulanamadı)"}


def markers(answers: DataFrame) -> DataFrame:
    """(query_id, place, rank, claim): every ``[n]`` with the sentence or table cell around it."""
    pieces = F.split("answer", CLAIM_END, -1)
    rows = answers.select("query_id", F.posexplode(pieces).alias("piece", "claim"))
    found = rows.select("query_id", "piece", "claim", F.posexplode(F.regexp_extract_all("claim", F.lit(CITATION), F.lit(1))).alias("i", "n"))
    return found.select("query_id", "piece", "i", F.col("n").try_cast("int").alias("rank"), "claim")


def cited(answers: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, rank, id): sources that some marker names with a claim they can back."""
    checked = markers(answers).join(results.select("query_id", "rank", "id", "text", "language"), ["query_id", "rank"])
    return checked.where(is_grounded(F.col("claim"), F.col("text"), F.col("language"))).select("query_id", "rank", "id").distinct()


def unverified_mentions(answers: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, regulation, article_number): statute articles named in prose that were not retrieved."""
    found = F.regexp_extract_all("answer", F.lit(r"(?iU)\b(?:DORA|GDPR|KVKK)\s+(?:Article|Art\.?|Madde)\s+\d+\b"), F.lit(0))
    said = answers.select("query_id", F.explode(F.array_distinct(found)).alias("m")).select(
        "query_id", F.upper(F.regexp_extract("m", r"^\S+", 0)).alias("regulation"), F.regexp_extract("m", r"\d+$", 0).alias("article_number")
    )
    have = results.where(is_statute(F.col("doc_type"))).select("query_id", "regulation", "article_number")
    return said.distinct().join(have, ["query_id", "regulation", "article_number"], "left_anti")


def _confirmed(answer: Column, sources: Column) -> Column:
    """The answer with articles in prose that no source is of named as unconfirmed."""
    statutes = F.transform(F.filter(sources, lambda s: is_statute(s["doc_type"])), lambda s: F.concat_ws(" ", s["regulation"], s["article_number"]))

    def mention(said: Column) -> Column:
        regulation = F.upper(F.regexp_extract(said, PROSE, 1))
        known = F.array_contains(statutes, F.concat_ws(" ", regulation, F.regexp_extract(said, PROSE, 2)))
        turkish = F.contains(F.lower(said), F.lit("madde"))
        unsure = F.concat(regulation, F.when(turkish, UNCONFIRMED["tr"]).otherwise(UNCONFIRMED["en"]))
        return F.when(known, said).otherwise(unsure)

    return replace_each(answer, PROSE, mention)


def _backed(answer: Column, sources: Column) -> Column:
    """The answer without markers whose sentence or cell the source can't back; what joined them to others goes, too."""

    def held(claim: Column) -> Column:
        def marker(mark: Column) -> Column:
            n = F.regexp_extract(mark, CITATION, 1).try_cast("int")
            source = F.when(n >= 1, F.get(sources, n - 1))
            return F.when(source.isNotNull() & is_grounded(claim, F.coalesce(source["text"], F.lit("")), source["language"]), mark)

        return replace_each(claim, CITATION, marker)

    out = F.array_join(F.transform(F.split(answer, CLAIM_END, -1), held), "")
    for pattern, to in LEFTOVERS:
        out = F.regexp_replace(out, pattern, to)
    return out


def verify(answers: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, answer, indices): cleaned answers and the ranks that they still cite.

    An answer meets the few sources of its own prompt in one row; each piece of it
    is then checked by Column functions.
    """
    fields = ("rank", "text", "regulation", "article_number", "doc_type", "language")
    sources = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("sources"))
    none = F.array().cast(sources.schema["sources"].dataType)
    rows = answers.join(sources, "query_id", "left").withColumn("sources", F.coalesce("sources", none))
    said = _confirmed(strip_unexpected_script(F.coalesce("answer", F.lit(""))), F.col("sources"))
    clean = rows.withColumn("answer", said).withColumn("answer", fill_blank_cells(_backed(F.col("answer"), F.col("sources"))))
    found = F.transform(F.regexp_extract_all("answer", F.lit(CITATION), F.lit(1)), lambda x: x.try_cast("int"))
    held = F.filter(found, lambda x: (x >= 1) & (x <= F.size("sources")))
    return clean.select("query_id", "answer", F.array_sort(F.array_distinct(held)).alias("indices"))


def group_sources(cited_rows: DataFrame) -> DataFrame:
    """Sources by article: (query_id, group_no, indices, citation, text), in order of first mention.

    ``cited_rows`` has query_id, rank, text and the metadata of a chunk.
    """
    keys = ["query_id", "regulation", F.coalesce("document_label", F.lit("")).alias("document_label"), "article_number"]
    part = F.struct("rank", "text", (F.col("chunk_index") + 1).alias("part"), "total_chunks", "article_title", "doc_type")
    groups = cited_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("rows"))
    first = F.col("rows")[0]
    parts = F.array_join(F.transform(F.array_sort(F.transform("rows", lambda r: r["part"])), lambda p: p.cast("string")), ", ")
    base = citation(F.col("regulation"), F.col("article_number"), first["article_title"], F.col("document_label"), first["doc_type"])
    total = F.coalesce(first["total_chunks"], F.lit(1))
    suffix = F.when(total > 1, F.concat(F.lit(" (parts "), parts, F.lit(" of "), total.cast("string"), F.lit(")"))).otherwise("")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(first["rank"]))
    return groups.select(
        "query_id",
        rank.alias("group_no"),
        F.transform("rows", lambda r: r["rank"]).alias("indices"),
        F.concat(base, suffix).alias("citation"),
        F.array_join(F.transform("rows", lambda r: r["text"]), "\n\n---\n\n").alias("text"),
    )


def format_sources(results: DataFrame, start: int = 1) -> DataFrame:
    """(query_id, sources): the numbered sources of a prompt. Needs rank, citation and text."""
    line = F.struct("rank", F.concat(F.lit("["), (F.col("rank") + (start - 1)).cast("string"), F.lit("] "), "citation", F.lit("\n"), "text").alias("line"))
    lists = results.groupBy("query_id").agg(F.array_sort(F.collect_list(line)).alias("x"))
    return lists.select("query_id", F.array_join(F.transform("x", lambda y: y["line"]), "\n\n").alias("sources"))
