"""Text expressions. Regular expressions name their character classes, so that other engines agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\x0B\f]"


def join_hyphenated(c: Column) -> Column:
    """Words broken by a hyphen or soft hyphen at a line's end, joined. One pass joins chains too, as nothing is consumed."""
    return F.regexp_replace(c, r"(?U)(?<=\w)[-­]\s*\n\s*(?=\w)", "")


def normalize_text(c: Column) -> Column:
    """Hyphens joined, white space collapsed, ends stripped."""
    return F.regexp_replace(F.regexp_replace(join_hyphenated(c), r"(?U)\s+", " "), r"^ | $", "")


def tokenize(c: Column) -> Column:
    """Tokens of the normalised text; an empty text has none."""
    return F.filter(F.split(normalize_text(c), " "), lambda t: t != "")


def strip(c: Column) -> Column:
    """Unicode white space off both ends; trim() would take U+0020 alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """Whether nothing but Unicode white space is there; the search ends at the first other character."""
    return F.coalesce(~c.rlike(r"(?U)\S"), F.lit(True))


def normalize_token(c: Column) -> Column:
    """Lexicon form: digits, ASCII letters and Russian letters, in lower case; accented Latin is dropped."""
    return F.lower(F.regexp_replace(c, "[^0-9a-zA-Zа-яёА-ЯЁ]+", ""))


def capitalized(c: Column) -> Column:
    """The first letter large and the others small, one for one: what has no large letter of its own stays, and ß has ẞ.

    initcap() writes some letters as two, and begins anew after a hyphen."""
    first = F.left(c, F.lit(1))
    large = F.translate(first, "ß", "ẞ")
    return F.concat(F.when(F.length(F.upper(large)) == 1, F.upper(large)).otherwise(large), F.lower(F.substr(c, F.lit(2))))


def anchor_tokens(c: Column) -> Column:
    """Tokens for anchors: lower case, hyphens joined, digits and Latin letters up to U+024F; Cyrillic is dropped."""
    joined = F.regexp_replace(F.lower(c), r"(?U)-\s*", "")
    return F.filter(F.split(F.regexp_replace(joined, "[^0-9a-zÀ-ɏ]+", " "), " "), lambda t: t != "")


def has_cyrillic(c: Column) -> Column:
    return c.rlike("[Ѐ-ӿ]")


#: Letters of caption keywords with their marks dropped.
MARKED, PLAIN = "àáâäãåèéêëìíîïòóôöõùúûüçñй", "aaaaaaeeeeiiiiooooouuuucnи"


def plain_keyword(c: Column) -> Column:
    """A keyword in lower case without diacritics."""
    return F.translate(F.lower(c), MARKED, PLAIN)


def escape_html(c: Column) -> Column:
    """& < > \" and ' as entities; the ampersand first."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def data_uri(png: Column) -> Column:
    """PNG bytes as a data URI on one line."""
    return F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(png), r"\s", ""))


def percent(c: Column) -> Column:
    return F.when(c.isNull(), "—").otherwise(F.concat(F.format_string("%.1f", c * 100), F.lit("%")))


def three_places(c: Column) -> Column:
    return F.when(c.isNull(), "—").otherwise(F.format_string("%.3f", c))


def signed_tau(c: Column) -> Column:
    return F.when(c.isNull(), "n/a").otherwise(F.format_string("%+.2f", c))
