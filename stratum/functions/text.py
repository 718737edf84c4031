"""Scalar functions on text, all as column expressions. Offsets are code points, half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names as they occur in text ids, in calendar order; fixed values.
MONTHS = {"JAN": 1, "FEB": 2, "MAR": 3, "MRZ": 3, "APR": 4, "MAY": 5, "MAI": 5, "JUN": 6, "JUL": 7, "AUG": 8, "SEP": 9, "OCT": 10, "OKT": 10, "NOV": 11, "DEC": 12, "DEZ": 12}
#: Foundries whose prefix differs from their name.
PREFIXES = {"tree_tagger": "tt", "marmot-malt": "marmot"}
#: Sorts behind every number.
LAST = (1 << 63) - 1
#: Shapes of dates, the more exact and the dotted first, and the group of each that is year, month and day; fixed values.
DATE_SHAPES = [
    (r"\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b", (3, 2, 1)),
    (r"\b(\d{4})\.(\d{1,2})\.(\d{1,2})\b", (1, 2, 3)),
    (r"\b(\d{4})-(\d{2})-(\d{2})\b", (1, 2, 3)),
    (r"\b(\d{4})\.(\d{1,2})\b", (1, 2)),
    (r"\b(\d{4})-(\d{2})\b", (1, 2)),
    (r"\b(\d{4})\b", (1,)),
]


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Characters [start, end), clamped to the text."""
    lo = F.greatest(F.lit(0), start)
    return F.substring(text, lo + 1, F.greatest(F.lit(0), end - lo))


def given(c: Column) -> Column:
    """A cell, or null where it is the empty marker ``_``."""
    return F.nullif(c, F.lit("_"))


def cell(c: Column) -> Column:
    """A cell for output: ``_`` where there is nothing."""
    return F.coalesce(c, F.lit("_"))


def surface_cell(c: Column) -> Column:
    """A surface for a tab-separated column: white space that would break it becomes a space, blank becomes ``_``."""
    flat = F.translate(c, "\t\n\r", "   ")
    return F.when(F.trim(flat) == "", "_").otherwise(flat)


def escape_value(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("#"), F.lit("\\#")), F.lit("$"), F.lit("\\$"))


def escape_attribute(c: Column) -> Column:
    for char, code in (("#", "%23"), ("$", "%24"), (":", "%3A"), ("<", "%3C"), (">", "%3E")):
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def escape_parens(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("("), F.lit("-LRB-")), F.lit(")"), F.lit("-RRB-"))


def escape_json(c: Column) -> Column:
    """Inside of a JSON string; the remaining control characters become \\u00xx."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    for code in [*range(0x01, 0x08), 0x0B, 0x0C, *range(0x0E, 0x20)]:
        c = F.replace(c, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return c


def encode_link(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(":"), F.lit("%3A")), F.lit("/"), F.lit("%2F"))


def encode_form(c: Column) -> Column:
    """Percent encoding as forms have it: a space becomes +."""
    return F.url_encode(c)


def data_uri(value: Column) -> Column:
    return F.concat(F.lit("data:,"), value)


def link_uri(kind: str, title: Column, url: Column) -> Column:
    return F.concat(F.lit(f"data:{kind};title="), title, F.lit(","), encode_link(url))


def squish(c: Column) -> Column:
    """White space runs become one space, ends are trimmed, a text of dashes alone is empty."""
    out = F.trim(F.regexp_replace(c, r"\s\s+", " "))
    return F.when(out.rlike("^-+$"), "").otherwise(out)


def foundry_prefix(c: Column) -> Column:
    out = c
    for name, prefix in PREFIXES.items():
        out = F.when(c == name, prefix).otherwise(out)
    return F.when(c == "base", F.lit(None)).otherwise(out)


def sigle(text_id: Column) -> Column:
    """C/D/T of C_D.T"""
    return F.translate(text_id, "_.", "//")


def file_name(text_id: Column) -> Column:
    """C-D-T of C_D.T, the name of an archive entry."""
    return F.translate(text_id, "_.", "--")


def text_id(path: Column) -> Column:
    """C_D.T of C/D/T/...; the first part alone where there are fewer than three."""
    part = F.split(path, "/")
    return F.when(F.size(part) >= 3, F.concat(part[0], F.lit("_"), part[1], F.lit("."), part[2])).otherwise(part[0])


def order_key(text_id: Column) -> Column:
    """A struct that sorts text ids by prefix, month, middle part, number and id."""
    part = F.split(text_id, "[-_.]")
    middle = F.coalesce(F.get(part, F.lit(1)), F.lit(""))
    rank = F.lit(LAST)
    for name, n in MONTHS.items():
        rank = F.when((F.length(middle) == 3) & (F.upper(middle) == name), n).otherwise(rank)
    number = F.coalesce(F.get(part, F.lit(2)).try_cast("long"), F.lit(LAST))
    return F.struct(part[0].alias("prefix"), rank.alias("month"), F.when(rank == LAST, middle).otherwise("").alias("middle"), number.alias("number"), text_id.alias("id"))


def glob_regex(glob: str) -> str:
    """A whole-name pattern in which only * and ? are special."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c != "_" else c for c in glob) + "$"


def is_word(c: Column) -> Column:
    """Whether a token has a letter, digit, underscore, symbol, or any character beyond the basic plane."""
    return c.rlike(r"[\p{L}\p{Nd}_\p{So}\x{10000}-\x{10FFFF}]")


def normalise_date(c: Column) -> Column:
    """An ISO date of free text, as exact as the text is; the first date of a range. Null if there is none."""
    return F.transform(F.array(F.trim(F.regexp_replace(c, r"\s+", " "))), _date_in)[0]  # the text is cleaned once


def _date_in(s: Column) -> Column:
    """The first shape that the text has, its parts padded and joined."""
    out = F.lit(None).cast("string")
    for pattern, groups in reversed(DATE_SHAPES):
        parts = [F.regexp_extract(s, pattern, g) for g in groups]
        out = F.when(s.rlike(pattern), F.concat_ws("-", parts[0], *[F.lpad(x, 2, "0") for x in parts[1:]])).otherwise(out)
    return out


def compose_date(year: Column, month: Column, day: Column, plain: Column) -> Column:
    """YYYY[-MM[-DD]] of its parts, else the plain date; a day without a month is ignored."""
    y, m, d, p = (F.nullif(F.trim(x), F.lit("")) for x in (year, month, day, plain))
    pad = lambda x: F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)
    return F.when(y.isNotNull(), F.concat_ws("-", y, pad(m), F.when(m.isNotNull(), pad(d)))).otherwise(p)
