"""Measuring retrieval and answers: hit rates, case grades, stability."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hits(gold: DataFrame, results: DataFrame, key: str = "article_number") -> DataFrame:
    """Each gold item with ``first_hit_rank`` (null: none) and ``hit``.

    ``gold`` has query_id and expected (array), ``results`` query_id, rank and ``key``.
    """
    found = results.join(gold.select("query_id", "expected"), "query_id").where(F.array_contains("expected", F.col(key)))
    ranks = found.groupBy("query_id").agg(F.min("rank").alias("first_hit_rank"))
    return gold.join(ranks, "query_id", "left").withColumn("hit", F.col("first_hit_rank").isNotNull())


def summary(rows: DataFrame, *groups: str) -> DataFrame:
    """Hit rate and mean reciprocal rank by each group and overall, in one pass by grouping sets."""
    sets = [[F.col(g)] for g in groups] + [[]]
    return rows.groupingSets(sets, *[F.col(g) for g in groups]).agg(
        F.count("*").alias("total"),
        F.count_if("hit").alias("hits"),
        F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first_hit_rank"), F.lit(0.0))), 6).alias("mrr"),
    )


def evaluable(gold: DataFrame, indexed: DataFrame) -> DataFrame:
    """Gold items of regulations that the index holds; the others can't be judged."""
    return gold.join(indexed.select("regulation").distinct(), "regulation", "left_semi")


def evaluate_retrieval(gold: DataFrame, indexed: DataFrame, search: Callable[[DataFrame], DataFrame], *groups: str) -> tuple[DataFrame, DataFrame]:
    """Each evaluable item with what was found for it, and the summary by groups.

    ``gold``: query_id, query, regulation, expected (array of articles).  ``search``
    gives (query_id, rank, article_number) for (query_id, query, regulation).
    """
    items = evaluable(gold, indexed)
    results = search(items.select("query_id", "query", "regulation"))
    found = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "article_number"))).alias("x"))
    listed = found.select("query_id", F.transform("x", lambda y: y["article_number"]).alias("retrieved"))
    none = F.array().cast("array<string>")
    rows = hits(items, results).join(listed, "query_id", "left").withColumn("retrieved", F.coalesce("retrieved", none))
    return rows, summary(rows, *groups)


def document_misses(cases: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, regulation, document_label): required documents that were not retrieved."""
    need = cases.select("query_id", F.explode("must_documents").alias("m")).select("query_id", "m.regulation", "m.document_label")
    have = results.where("coalesce(document_label, '') <> ''").select("query_id", "regulation", "document_label")
    return need.join(have, ["query_id", "regulation", "document_label"], "left_anti")


def retrieval_misses(cases: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, regulation, article): required pairs that were not retrieved."""
    need = cases.select("query_id", F.explode("must").alias("m")).select("query_id", "m.regulation", "m.article")
    have = results.select("query_id", "regulation", F.col("article_number").alias("article"))
    return need.join(have, ["query_id", "regulation", "article"], "left_anti")


def grade(cases: DataFrame, results: DataFrame, answers: DataFrame, indexed: DataFrame) -> DataFrame:
    """(query_id, status, reasons) for cases.

    ``cases``: query_id, needed (array of regulations), must (array of regulation and
    article), forbid (array of regexes), require (regex or null), no_citation
    (boolean or null), only (array of regulations or null), and must_documents (array
    of regulation and document_label) if documents are asked for.  ``answers``: query_id,
    answer, cited (array of regulations), null where none was generated.  A case
    that needs a regulation that isn't indexed, or that nothing can be checked of,
    is skipped.
    """
    known = indexed.agg(F.collect_set("regulation").alias("indexed"))
    documents = "must_documents" in cases.columns
    if not documents:
        cases = cases.withColumn("must_documents", F.lit(None).cast("array<struct<regulation:string,document_label:string>>"))
    missing = retrieval_misses(cases, results).select("query_id", F.concat(F.lit("retrieval miss: "), "regulation", F.lit(" Art "), "article").alias("miss"))
    if documents:
        missing = missing.unionByName(document_misses(cases, results).select("query_id", F.concat(F.lit("retrieval miss: "), "regulation", F.lit(" "), "document_label").alias("miss")))
    missed = missing.groupBy("query_id").agg(F.array_sort(F.collect_list("miss")).alias("misses"))
    rows = cases.join(F.broadcast(known)).join(missed, "query_id", "left").join(answers, "query_id", "left")
    none = F.array().cast("array<string>")
    said = F.col("answer").isNotNull()
    forbidden = F.transform(F.filter(F.coalesce("forbid", none), lambda p: said & F.regexp_like("answer", p)), lambda p: F.concat(F.lit("forbidden pattern matched: "), p))
    one = lambda condition, text: F.when(condition, F.array(text)).otherwise(none)
    lacking = one(said & F.col("require").isNotNull() & ~F.regexp_like("answer", F.col("require")), F.concat(F.lit("required pattern missing: "), "require"))
    footer = one(said & F.coalesce("no_citation", F.lit(False)) & (F.size(F.coalesce("cited", none)) > 0), F.lit("expected no citation"))
    wrong = F.array_sort(F.array_except(F.coalesce("cited", none), F.coalesce("only", none)))
    outside = one(said & F.col("only").isNotNull() & (F.size(wrong) > 0), F.concat(F.lit("citations from disallowed: "), F.array_join(wrong, ",")))
    reasons = F.concat(F.coalesce("misses", none), forbidden, lacking, footer, outside)
    asked = lambda c: F.coalesce(F.size(F.when(F.col(c).isNotNull(), F.col(c))), F.lit(0)) > 0
    checkable = asked("must") | asked("must_documents") | (
        said & ((F.size(F.coalesce("forbid", none)) > 0) | F.col("require").isNotNull() | F.coalesce("no_citation", F.lit(False)) | F.col("only").isNotNull())
    )
    absent = F.size(F.array_except(F.coalesce("needed", none), "indexed")) > 0
    status = F.when(absent | ~checkable, "SKIP").when(F.size(reasons) > 0, "FAIL").otherwise("PASS")
    return rows.select("query_id", status.alias("status"), F.when(absent, none).otherwise(reasons).alias("reasons"))


def scorecard(graded: DataFrame) -> DataFrame:
    return graded.groupBy("status").agg(F.count("*").alias("n"))


def stability(runs: DataFrame) -> DataFrame:
    """(query_id, n_sets, diverged): whether repeated runs cite the same. ``runs``: query_id, run, source (null: none)."""
    sets = runs.groupBy("query_id", "run").agg(F.array_sort(F.collect_set("source")).alias("s"))
    counted = sets.groupBy("query_id").agg(F.count_distinct("s").alias("n_sets"))
    return counted.withColumn("diverged", F.col("n_sets") > 1)


def run_failures(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """(query_id, run, failures): what is wrong with each repeated run of a case.

    ``cases``: query_id, must (array of regulation and article), zero_citations,
    only (array of regulations), contains_any and contains_none (arrays of phrases), all
    of which may be null.  ``runs``: query_id, run, answer, indices, cited and
    retrieved (arrays of regulation and article).
    """
    rows = runs.join(cases, "query_id")
    none = F.array().cast("array<string>")
    pair = "array<struct<regulation:string,article:string>>"
    low = F.lower(F.coalesce("answer", F.lit("")))
    said = lambda p: F.contains(low, F.lower(p))
    must, cited = (F.coalesce(F.col(c).cast(pair), F.array().cast(pair)) for c in ("must", "cited"))
    missed = F.transform(F.array_except(must, F.col("retrieved").cast(pair)), lambda m: F.concat(F.lit("retrieval miss: "), m["regulation"], F.lit(" Art "), m["article"]))
    one = lambda condition, text: F.when(F.coalesce(condition, F.lit(False)), F.array(text)).otherwise(none)
    outside = F.array_sort(F.array_except(F.transform(cited, lambda c: c["regulation"]), F.coalesce("only", none)))
    wanted = F.coalesce("contains_any", none)
    markers = F.size(F.array_distinct(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1))))
    failures = F.concat(
        missed,
        one(F.col("zero_citations") & (F.size(cited) > 0), F.lit("expected zero citations")),
        one((F.size(F.coalesce("only", none)) > 0) & (F.size(outside) > 0), F.concat(F.lit("citations from disallowed: "), F.array_join(outside, ","))),
        one((F.size(wanted) > 0) & ~F.exists(wanted, said), F.lit("none of the expected phrases")),
        F.transform(F.filter(F.coalesce("contains_none", none), said), lambda p: F.concat(F.lit("forbidden phrase: "), p)),
        one((markers > 0) & (markers > F.size(F.coalesce("indices", F.array().cast("array<int>")))), F.lit("dangling marker")),
    )
    return rows.select("query_id", "run", failures.alias("failures"))


def dangling_markers(answers: DataFrame) -> DataFrame:
    """(query_id, n_markers, dangling): more markers in a text than sources it cites. ``answers``: query_id, answer, indices."""
    n = F.size(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1))))
    return answers.select("query_id", n.alias("n_markers"), (n > F.size("indices")).alias("dangling"))
