"""Captions: language keys, the caption header at a block's start, figure numbers and label votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import once

#: Caption keywords by language, and names of languages.
KEYWORDS = {
    "ita": ("figura", "fig", "tavola", "tav"),
    "eng": ("figure", "fig", "plate"),
    "deu": ("abbildung", "abb", "bild", "tafel"),
    "bul": ("фигура", "фиг", "обр"),
}
ALIASES = {
    "it": "ita", "ita": "ita", "italian": "ita",
    "en": "eng", "eng": "eng", "english": "eng",
    "de": "deu", "deu": "deu", "ger": "deu", "german": "deu",
    "bg": "bul", "bul": "bul", "bulgarian": "bul",
}
DEFAULT = "ita"
PREFIX_LETTERS, PREFIX_MOST = "A-Za-zÀ-ɏЀ-ӿ", 30
#: A character that sets parts off, which no header holds.
MARK = "\x01"


def alias_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])


def lang_code(name: Column) -> Column:
    """The code of a language's name; an unknown name stands for itself, trimmed and in lower case."""
    key = F.lower(F.trim(name))
    return F.coalesce(F.element_at(alias_map(), key), key)


def resolve_language(asked: Column, default: str) -> Column:
    """Each part of a +-joined request by its code; the default where nothing is asked."""
    return F.coalesce(F.array_join(F.transform(F.split(F.nullif(asked, F.lit("")), r"\+"), lang_code), "+"), F.lit(default))


def lang_key(lang: Column) -> Column:
    """The first part of a language string that has caption keywords, else the default."""
    parts = F.transform(F.split(F.lower(F.trim(lang)), r"[+,\s]+"), lambda p: F.element_at(alias_map(), p))
    first = F.try_element_at(F.filter(parts, lambda k: k.isNotNull()), F.lit(1))
    return F.coalesce(F.element_at(alias_map(), F.lower(F.trim(lang))), first, F.lit(DEFAULT))


def header_pattern(key: str) -> str:
    """Fixed value: the form of a caption's header.

    A short directional prefix with a colon, if any; a keyword, the longest first; a number of 1 to 3 digits."""
    words = "|".join(sorted(KEYWORDS[key], key=len, reverse=True))
    return rf"(?iU)^\s*(?:([{PREFIX_LETTERS} ]{{1,{PREFIX_MOST}}}?)\s*:\s*)?({words})\.?\s*([0-9]{{1,3}})(?![0-9])"


def by_language(lang: Column, made) -> Column:
    """made(k) for the keyword language k that a row's language resolves to; the other branches are not reckoned."""
    found = None
    for k in KEYWORDS:
        found = F.when(lang_key(lang) == k, made(k)) if found is None else found.when(lang_key(lang) == k, made(k))
    return found


def _marked(text: Column, pattern: str) -> Column:
    """The text with its header's parts and the rest set off by a mark; one without a header stays as it is."""
    return F.regexp_replace(text, pattern + r"[ \t:;.,\-–—|/·]*+", MARK + f"$1{MARK}$2{MARK}$3{MARK}")


def _header(p: Column, key: Column) -> Column:
    prefix = F.trim(p[1])
    return F.struct(
        p[3].cast("int").alias("number"), F.lower(p[2]).alias("keyword"), key.alias("lang"),
        F.when(prefix != "", prefix).alias("prefix"), F.regexp_replace(p[4], r"(?U)^\s+|\s+$", "").alias("residual"),
    )


def _found(text: Column, cut: Column, key: Column) -> Column:
    return once(cut, lambda c: F.when(c != text, once(F.split(c, MARK, 5), lambda p: _header(p, key))))


def parse_caption(text: Column, lang: Column) -> Column:
    """struct(number, keyword, lang, prefix, residual) of the caption header that the text begins with, or null.

    One replacement sets the header's parts and the rest off by a mark, and so changes a text just if it has a header."""
    return _found(text, by_language(lang, lambda k: _marked(text, header_pattern(k))), lang_key(lang))


def parsed_captions(rows: DataFrame, text: str, key: str) -> DataFrame:
    """The rows that begin with a caption header, with it as ``c``: what ``parse_caption`` finds where ``key`` has each row's ``lang_key``."""
    cut = None
    for k in KEYWORDS:
        one = _marked(F.col(text), header_pattern(k))
        cut = F.when(F.col(key) == k, one) if cut is None else cut.when(F.col(key) == k, one)
    # a filter on the header would reckon it twice
    return rows.select("*", F.explode(F.array_compact(F.array(_found(F.col(text), cut, F.col(key))))).alias("c"))


def is_caption(text: Column, lang: Column) -> Column:
    return F.coalesce(by_language(lang, lambda k: text.rlike(header_pattern(k))), F.lit(False))


def figure_number(text: Column) -> Column:
    """The number of a text that is nothing but an optional label and 1 to 3 digits, or null."""
    words = "|".join(sorted({w for ws in KEYWORDS.values() for w in ws}, key=len, reverse=True))
    return F.nullif(F.regexp_extract(text, rf"(?iU)^\s*(?:(?:{words})\.?\s*)?([0-9]{{1,3}})\s*$", 1), F.lit("")).cast("int")


def vote_label(reads: Column, least_single: int = 3, least_double: int = 2, low: int = 1, high: int = 99) -> Column:
    """The corner number that an array of reads agrees on, or null.

    A two-digit read wins with two votes and no rival; any other two-digit read blocks; without one, a
    one-digit read needs three votes and no rival."""
    digits = F.filter(reads, lambda r: r.rlike("^[0-9]{1,2}$") & r.cast("int").between(low, high))
    two, one = F.filter(digits, lambda r: F.length(r) == 2), F.filter(digits, lambda r: F.length(r) == 1)

    def agreed(votes, least):
        return F.when((F.size(votes) >= least) & (F.size(F.array_distinct(votes)) == 1), F.try_element_at(votes, F.lit(1)).cast("int"))

    return F.when(F.size(two) > 0, agreed(two, least_double)).otherwise(agreed(one, least_single))
