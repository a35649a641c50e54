"""HTML pages as tables of blocks, and Official Journal pages as articles, by built-in functions and windows.

A page is cut into tokens in its own row; the tokens that matter are shuffled once by
page, and all windows and groups below share that partitioning.  Nested tables are
followed by running sums of their tags; chapters are carried forward by ``last``.

Tokens: comments, scripts and styles carry no text; a ``<`` without a tag is text; a
quoted ``>`` belongs to its tag.  A paragraph ends where the next block starts.  Null
and empty pages have no blocks.  Entities are decoded where a name is written in
full (the final ``;`` may lack where HTML lets it); unknown ones stay as they are.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Element classes of the format.
HEADING_CLASSES = ("ti-art", "oj-ti-art")
CHAPTER_CLASSES = ("ti-section-1", "oj-ti-section-1", "ti-section-2", "oj-ti-section-2")
DASH = " — "

_TAG = r"""<[a-zA-Z/!?](?:[^>"']++|"[^"]*+"|'[^']*+'){0,300}+>|<[a-zA-Z/!?][^>]*+>"""
_TOKEN = rf"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|{_TAG}|[^<]+|<"
_ENTITY = r"&(?:#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|[a-zA-Z][a-zA-Z0-9]{1,31});?|[^&]+|&"
#: What counts as white space around a text: that of Unicode.
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def _names() -> str:
    """Entities by their first two characters, then by name: look-ups scan few entries."""
    found: dict[str, dict[str, str]] = {}
    old = {f"#{n}": bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}
    for name, text in (html5 | {k: v for k, v in old.items() if v}).items():
        found.setdefault(name[:2], {})[name] = text
    return json.dumps(found)


def unescape(text: Column) -> Column:
    """``text`` with its entities decoded."""
    names = F.from_json(F.lit(_names()), "map<string,map<string,string>>")

    def one(part: Column) -> Column:
        name = F.substring(part, 2, 40)
        bare = F.rtrim(name, F.lit(";"))
        digits = F.regexp_extract(bare, r"^#([0-9]+)$", 1)
        number = F.when(digits != "", F.conv(digits, 10, 10)).otherwise(F.conv(F.regexp_extract(bare, r"^#[xX]([0-9a-fA-F]+)$", 1), 16, 10)).cast("long")
        listed = lambda key: names[F.substring(key, 1, 2)][key]
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        coded = F.coalesce(listed(F.concat(F.lit("#"), number.cast("string"))), char)
        named = F.coalesce(listed(name), F.concat(listed(bare), F.when(name.endswith(";"), ";").otherwise("")), part)
        return F.when(~part.rlike("^&."), part).when(part.rlike("^&#"), coded).otherwise(named)

    return F.when(text.contains("&"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), 0), one), "")).otherwise(text)


def tidy(text: Column) -> Column:
    """Runs of blanks and tabs as one blank, at most one empty line, nothing around."""
    return strip(F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_SPACE}++|{_SPACE}++$", "")


def blocks(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(``page``, block, name, classes, text): paragraphs and tables of each page, ``block`` in the order in which they open.

    A table's text is all text within it, that of its paragraphs included.  Values
    of ``page`` must differ; rows where it is null are read as one page.
    """
    token = F.col("_token")
    cut = pages.select(page, F.posexplode(F.regexp_extract_all(html, F.lit(_TOKEN), 0)).alias("_i", "_token"))
    tag = F.lower(F.regexp_extract(token, r"^<(/?[a-zA-Z][^\s/>]*)", 1))
    cut = cut.select(page, "_i", "_token", F.when(token.startswith("<") & (F.length(token) > 1), tag).alias("_tag"))
    cut = cut.where("_tag in ('p', '/p', 'table', '/table') or (_tag is null and trim(_token) <> '')")
    # a tag that closes itself opens a block without text
    cut = cut.withColumn("_self", F.col("_tag").isin("p", "table") & token.rlike(r"/\s*>$"))
    cut = cut.withColumn("_step", F.when(F.col("_self"), 0).when(F.col("_tag") == "table", 1).when(F.col("_tag") == "/table", -1).otherwise(0))

    by = W.partitionBy(page).orderBy("_i")
    so_far, before = by.rowsBetween(W.unboundedPreceding, 0), by.rowsBetween(W.unboundedPreceding, -1)
    rows = cut.repartition(F.col(page)).withColumn("_sum", F.sum("_step").over(so_far))
    # a closing tag without an open table counts for nothing: the floor follows the sum down
    rows = rows.withColumn("_floor", F.least(F.coalesce(F.min("_sum").over(before), F.lit(0)), F.lit(0)))
    rows = rows.withColumn("_depth", F.col("_sum") - F.least("_floor", "_sum"))
    ends = F.col("_tag").isin("p", "/p", "table") | ((F.col("_tag") == "/table") & (F.col("_sum") >= F.col("_floor")))
    opened = F.col("_tag").eqNullSafe("p") & ~F.col("_self")
    rows = rows.withColumn("_last", F.last(F.when(ends, F.when(opened, F.col("_i")).otherwise(-1)), ignorenulls=True).over(so_far))
    text = F.col("_tag").isNull()
    own = F.when(F.col("_tag").eqNullSafe("p") | F.col("_self"), F.col("_i")).when(text & (F.col("_last") >= 0), F.col("_last"))
    table = F.col("_tag").eqNullSafe("table") & ~F.col("_self")

    # level 0 is the paragraph around a row, level n the n-th table around it
    rows = rows.where("_tag is null or _tag in ('p', 'table')").withColumn("_own", own)
    rows = rows.withColumn("_level", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(text | table, F.col("_depth")).otherwise(0).cast("bigint"))))
    level = W.partitionBy(page, "_level").orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    outer = F.last(F.when(table & (F.col("_depth") == F.col("_level")), F.col("_i")), ignorenulls=True).over(level)
    rows = rows.withColumn("_block", F.when(F.col("_level") == 0, F.col("_own")).otherwise(outer)).where("_block is not null")
    piece = F.when(text, strip(unescape(token)))
    rows = rows.withColumn("_piece", F.when(piece != "", F.struct("_i", piece.alias("text"))))
    opens = F.col("_i") == F.col("_block")
    classes = F.regexp_extract(token, r"""(?i)\sclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", 0)
    classes = F.regexp_replace(classes, r"""(?i)^\sclass\s*=\s*["']?|["']$""", "")
    made = rows.groupBy(page, F.col("_block").alias("block")).agg(
        F.max(F.when(opens, F.col("_tag"))).alias("name"),
        F.max(F.when(opens, classes)).alias("classes"),
        F.sort_array(F.collect_list("_piece")).alias("_pieces"),
    )
    return made.select(page, "block", "name", F.split(F.trim("classes"), r"\s+").alias("classes"), tidy(F.array_join("_pieces.text", " ")).alias("text"))


def articles(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(``page``, seq, article_number, article_title, chapter, text) of Official Journal pages.

    A heading's class opens an article; chapter lines since the heading before name
    its chapter, and without any the chapter before goes on.  The first block of
    fewer than 200 characters is the title unless a paragraph of more comes first;
    the other paragraphs are the text, and articles without one are left out.
    """
    has = lambda names: F.arrays_overlap("classes", F.array(*map(F.lit, names)))
    kind = F.when(has(CHAPTER_CLASSES), "chapter").when(has(HEADING_CLASSES), "heading").otherwise("body")
    rows = blocks(pages, page, html).withColumn("_kind", kind).where("_kind = 'heading' or text <> ''")
    by = W.partitionBy(page).orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_article", F.count(F.when(F.col("_kind") == "heading", 1)).over(by))
    here = F.struct("block", "text")
    body = F.col("_kind") == "body"
    lead = body & ((F.col("name") == "p") | (F.length("text") < 200))
    found = rows.groupBy(page, "_article").agg(
        F.max(F.when(F.col("_kind") == "heading", F.col("text"))).alias("_heading"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("_kind") == "chapter", here))).getField("text"), DASH).alias("_next"),
        F.min(F.when(lead, here)).alias("_lead"),
        F.sort_array(F.collect_list(F.when(body & (F.col("name") == "p"), here))).alias("_body"),
    )
    order = W.partitionBy(page).orderBy("_article")
    carried = F.last(F.when(F.col("_next") != "", F.col("_next")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    short = F.length("_lead.text") < 200
    number = F.regexp_extract("_heading", r"(?iU)^Article\s+(\d+\w*)", 1)
    found = found.select(
        page,
        "_article",
        F.when(number != "", number).otherwise(F.col("_heading")).alias("article_number"),
        F.when(short, F.col("_lead.text")).otherwise("").alias("article_title"),
        F.coalesce(carried, F.lit("")).alias("chapter"),
        tidy(F.array_join(F.filter("_body", lambda x: ~(short & (x.block == F.col("_lead.block")))).getField("text"), "\n")).alias("text"),
    )
    kept = found.where("_article > 0 and text <> ''")
    return kept.withColumn("seq", F.row_number().over(order) - 1).select(page, "seq", "article_number", "article_title", "chapter", "text")
