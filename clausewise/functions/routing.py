"""Which regulations a question is about: cue tables and what follows from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewise.functions.text import DANGLING, TURKISH_LETTER, strip
from clausewise.sources.dimensions import REGULATIONS

LANGUAGES = {name: language for name, _, _, language in REGULATIONS}
# The cues of each regulation.
ACRONYM = r"(?iU)\b(?:DORA|GDPR|KVKK|BDDK)\b"
KVKK_CUE = (
    r"(?iU)\b(istanbul|ankara|izmir|t[üu]rkiye|turkey|turkish|t[üu]rk vatanda|"
    r"tckn|verb[iİ]s|kurul(?:un|ca|dan|u)?)\b"
)
DORA_CUE = (
    r"(?iU)\b(eu bank|european bank|financial entit(?:y|ies)|"
    r"ict third[- ]party|digital operational resilience|credit institution|"
    r"payment institution|e-?money institution|electronic money institution|"
    r"investment firm|insurance undertaking|payment service provider|"
    r"banka(?:s[ıi]|n[ıi]n|da|dan|ya)?|[öo]deme kurulu[şs]u|"
    r"finansal kurulu[şs]|yat[ıi]r[ıi]m kurulu[şs]u|sigorta [şs]irket\w*)\b"
)
EU_CUE = r"(?iU)\b(ab['’´](?:de(?:ki(?:ler)?)?|nin|ye|den|yle)|avrupa birli[gğ]i|european union|eu)\b"
EU_PLACE = (
    r"(?iU)\b(ab['’´](?:de(?:ki(?:ler)?)?|nin|ye|den|yle)|avrupa birli[gğ]i|"
    r"european union|frankfurt|berlin|m[üu]nih|munich|almanya|germany|"
    r"amsterdam|hollanda|netherlands|dublin|[iİ]rlanda|ireland|paris|fransa|france)\b"
)
TRANSFER = r"(?iU)\b(g[öo]nder\w*|aktar\w*|y[üu]kle\w*|ilet\w*|send\w*|transfer\w*|upload\w*|backup\w*|forward\w*)\b"
TURKISH_ONLY = r"[ığşİĞŞ]"
TURKISH_ASCII = (
    r"(?iU)\b(nedir|nelerdir|hangi|gerekir|gerekiyor|zorunlu|yukumlu\w*|"
    r"kisisel|sorumlusu|ihlali|bildirim\w*|kanun\w*|sayili|mevzuat\w*|"
    r"madde\w*)\b|m[iıuü]\s?s[iıuü]n\w*\b"
)
FREQUENCY = r"(?iU)\b(how often|ne s[ıi]kl[ıi]k\w*|ka[çc] kez)\b"
SPELLED_OUT = r"(?iU)threat[- ]led penetration test(?:ing|s)?"
ASKS = ("how often", "how long", "how many", "how much", r"ne s[ıi]kl[ıi]k\w*", r"ne kadar s[üu]r\w*", r"ka[çc] kez", r"ka[çc] g[üu]n\w*")
LONG, LONG_FOR_SEVERAL = 400, 180
ASCII_EDGE = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"

#: How cues are read: as they stand, with the letters of all scripts in words, unless a caller says otherwise.
Words = Callable[[str], str]


def ascii_words(pattern: str) -> str:
    """A cue as engines read it in which only ASCII letters make words: there ``dora`` stands in ``dorañ``, in ``kuruluş`` no word ends."""
    return pattern.replace("(?iU)", "(?iu)").replace(r"\b", ASCII_EDGE).replace(r"\w", "[0-9A-Za-z_]").replace(r"\s", r"[ \t\n\f\r]")


def acronyms(question: Column, words: Words = str) -> Column:
    """Regulations that a question names, each once, in capitals."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(words(ACRONYM)), F.lit(0)), F.upper)))


def single_regulation(question: Column, words: Words = str) -> Column:
    """The one regulation that a question names, or null."""
    named = acronyms(question, words)
    return F.when(F.size(named) == 1, F.get(named, F.lit(0)))


def looks_turkish(text: Column, words: Words = str) -> Column:
    return text.rlike(TURKISH_LETTER) | text.rlike(words(TURKISH_ASCII))


def _if(condition: Column, regulation: str) -> Column:
    return F.when(condition, F.array(F.lit(regulation))).otherwise(F.array().cast("array<string>"))


def required_regulations(question: Column, words: Words = str) -> Column:
    """Named regulations and those that cues stand for; Turkish alone means the Turkish one."""
    cued = F.array_union(F.array_union(acronyms(question, words), _if(question.rlike(words(KVKK_CUE)), "KVKK")), _if(question.rlike(words(DORA_CUE)), "DORA"))
    fallback = (F.size(cued) == 0) & (question.rlike(TURKISH_ONLY) | question.rlike(words(TURKISH_ASCII)))
    return F.array_sort(F.array_union(cued, _if(fallback, "KVKK")))


def required_regulations_extended(question: Column, triage: Column | None = None, words: Words = str) -> Column:
    """The same with a classifier's verdict where no cue fires, and explicit mentions of the EU."""
    found = required_regulations(question, words)
    if triage is not None:
        ask = (F.size(found) == 0) & (F.length(question) >= LONG_FOR_SEVERAL)
        found = F.array_union(found, F.when(ask, F.coalesce(triage, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    found = F.array_union(found, _if(question.rlike(words(EU_CUE)), "GDPR"))
    return F.array_sort(F.array_union(found, _if(question.rlike(words(DORA_CUE)), "DORA")))


def needs_decomposition(question: Column, words: Words = str) -> Column:
    """Long questions, and middling ones that several regulations are required for."""
    return (F.length(question) > LONG) | ((F.length(question) >= LONG_FOR_SEVERAL) & (F.size(required_regulations(question, words)) >= 2))


def strip_regulation_names(query: Column) -> Column:
    """A search query without names of regulations; one that would be empty stays."""
    bare = F.regexp_replace(F.regexp_replace(query, ACRONYM, ""), DANGLING, "")
    bare = strip(F.regexp_replace(bare, r"(?U)\s{2,}", " "), " .,")
    return F.coalesce(F.nullif(bare, F.lit("")), query)


def augment_frequency(query: Column, question: Column) -> Column:
    """Questions of recurrence search for the wording of recurring duties."""
    short = F.concat(F.regexp_replace(query, SPELLED_OUT, "TLPT"), F.lit(" at least every"))
    return F.when(question.rlike(FREQUENCY), short).otherwise(query)


def native_query(question: Column, regulation: Column) -> Column:
    """The Turkish wording as a second query for the Turkish statute, else null."""
    return F.when((regulation == "KVKK") & question.rlike(TURKISH_ONLY), question)


def retrieval_degraded(query: Column, regulations: Column, words: Words = str) -> Column:
    """A Turkish query against English sources; null regulations mean all of them."""
    english = F.array(*[F.lit(r) for r, lang in LANGUAGES.items() if lang != "en"])
    other = F.coalesce(F.size(F.array_except(regulations, english)) > 0, F.lit(True))
    return looks_turkish(query, words) & other


def language_directive(question: Column) -> Column:
    return F.when(looks_turkish(question), "\n\nCEVABINIZIN TAMAMINI TÜRKÇE YAZIN.").otherwise("\n\nAnswer entirely in English.")


def sub_questions(raw: Column, question: Column, most: int = 5, least: int = 8) -> Column:
    """Questions from a model's list, one per line, without bullets and scraps; the whole one if none is left."""
    from clausewise.functions.text import SUBQUESTION_PREFIX

    lines = F.transform(F.split(raw, r"\r\n|\n|\r"), lambda x: strip(F.regexp_replace(x, SUBQUESTION_PREFIX, "")))
    kept = F.slice(F.filter(lines, lambda x: F.length(x) > least), 1, most)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(question))
