"""Scalar text functions as Column expressions: everything here stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose results must equal the established behaviour.
WORD = r"[\p{L}\p{N}_]+"
DOC_NUMBER = r"(?U)\d{4}/\d{1,5}"
ARTICLE_BEFORE = r"(?iU)\b(?:article|art\.?|madde)\s+(\d+\w*)\b"
ARTICLE_AFTER = r"(?iU)\b(\d+\w*)\.\s*madde\w*"
CITATION = r"(?U)\[(\d+)\]"
CONTENT_WORD = r"[a-zA-ZçğıöşüÇĞİÖŞÜ]{4,}"
TURKISH_LETTER = r"[çğıöşüÇĞİÖŞÜ]"
UNEXPECTED_SCRIPT = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7A3}]+"
PAGE_FOOTER = r"(?mUd)^\s*\d+/\d+\s+ELI:\s*\S+\s*$"
THINK_SPAN = r"(?s)<think>.*?</think>"
SUBQUESTION_PREFIX = r"(?U)^[\s\-*\d.)]+"
DANGLING = r"(?iUd)\b(under|per|pursuant to|according to)\s*[.,]?\s*$"
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　"
# Words that carry no claim, English and Turkish.
STOPWORDS = (
    "the and for that with this from shall must have been will not are was were its their they which such also when where "
    "under into only than then these those about between within upon more some any all can may should would could does each "
    "other being veya gibi için olan olarak ile ancak ise kadar göre üzere olması olduğu olduğunu olup değil edilir edilmesi "
    "edilecek yapılır kişisel verilerin"
).split()


def tokenize(text: Column) -> Column:
    """Search tokens: lower case without the combining dot that Turkish capitals leave behind."""
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("̇"), F.lit("")), F.lit(WORD), F.lit(0))


def places(text: Column, pattern: str) -> Column:
    """Where a pattern stands: an array of (start, end), counted in characters from 0."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    walk = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("found"))

    return F.aggregate(walk, start, step)["found"]


def replace_each(text: Column, pattern: str, by: Callable[[Column], Column]) -> Column:
    """``text`` with every match of the pattern as ``by`` makes it."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.array_join(F.zip_with(gaps, hits, lambda gap, hit: F.concat(gap, F.coalesce(by(hit), F.lit("")))), "")


def strip(text: Column, characters: str = WHITESPACE) -> Column:
    return F.btrim(text, F.lit(characters))


def clean(text: Column) -> Column:
    """Runs of blanks to one, three and more line ends to two, nothing around."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def strip_page_footers(text: Column) -> Column:
    return F.regexp_replace(text, PAGE_FOOTER, "")


def article_slug(number: Column) -> Column:
    """An article number as part of an id."""
    ascii_ = F.translate(number, "çÇıİ", "cCiI")
    return F.btrim(F.regexp_replace(ascii_, "[^0-9A-Za-z]+", "-"), F.lit("-"))


def label_slug(label: Column) -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(slug == "", "doc").otherwise(slug)


def is_statute(doc_type: Column) -> Column:
    """Documents without a type are statutes."""
    return F.coalesce(doc_type, F.lit("statute")) == "statute"


def citation(regulation: Column, number: Column, title: Column, label: Column, doc_type: Column) -> Column:
    """How a source is named: by its label, or as an article of a statute."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    named = F.concat(regulation, F.lit(", "), label, F.when(has(number), F.concat(F.lit(" ("), number, F.lit(")"))).otherwise(""))
    article = F.concat(regulation, F.lit(", Article "), number, F.when(has(title), F.concat(F.lit(" — "), title)).otherwise(""))
    return F.when(~is_statute(doc_type) & has(label), named).otherwise(article)


def part_suffix(index: Column, total: Column) -> Column:
    return F.when(F.coalesce(total, F.lit(1)) > 1, F.format_string(" (part %d of %d)", index + 1, total)).otherwise("")


def requested_articles(query: Column) -> Column:
    """Article numbers that a question names, in either word order; lower case."""
    found = F.concat(F.regexp_extract_all(query, F.lit(ARTICLE_BEFORE), F.lit(1)), F.regexp_extract_all(query, F.lit(ARTICLE_AFTER), F.lit(1)))
    return F.array_distinct(found)


def content_words(text: Column) -> Column:
    words = F.transform(F.regexp_extract_all(text, F.lit(CONTENT_WORD), F.lit(0)), F.lower)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOPWORDS)))


def overlap(claim: Column, source: Column) -> Column:
    """Share of the claim's content words that the source has; null if it has none."""
    words = content_words(claim)
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, content_words(source))) / F.size(words))


def is_grounded(claim: Column, source: Column, language: Column, least: float = 0.12) -> Column:
    """Whether a source may back a claim.

    Words of different languages can't overlap, so there the claim stands; so it
    does if nothing in it can be checked.
    """
    spoken = F.when(claim.rlike(TURKISH_LETTER), "tr").otherwise("en")
    foreign = language.isin("tr", "en") & (language != spoken)
    return F.coalesce(foreign, F.lit(False)) | F.coalesce(overlap(claim, source) >= least, F.lit(True))


def strip_unexpected_script(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, UNEXPECTED_SCRIPT, ""), r"[ \t]{2,}", " ")


def fill_blank_cells(text: Column) -> Column:
    """Blank cells of Markdown table rows get a dash; the parts outside the outer bars are no cells."""

    def row(line: Column) -> Column:
        cells = F.split(line, r"\|", -1)
        filled = F.transform(cells, lambda c, i: F.when((i > 0) & (i < F.size(cells) - 1) & (strip(c) == ""), " — ").otherwise(c))
        table = F.startswith(strip(line), F.lit("|")) & (F.size(F.split(strip(line), r"\|", -1)) > 2)
        return F.when(table, F.array_join(filled, "|")).otherwise(line)

    return F.array_join(F.transform(F.split(text, "\n", -1), row), "\n")


def strip_thinking(text: Column, exhausted: str) -> Column:
    """A model's answer without its thoughts; a missing one says that they used up the budget."""
    return F.coalesce(strip(F.regexp_replace(text, THINK_SPAN, "")), F.lit(exhausted))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two number arrays in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def user_name(email: Column, name: Column) -> Column:
    """Who asked: the address, else the name, else somebody unknown."""
    some = lambda c: F.when(c != "", c)
    return F.coalesce(some(email), some(name), F.lit("bilinmeyen"))
