"""Column expressions on text. White space is spelled out, as engines differ on it."""

from __future__ import annotations

from pyspark.sql import functions as F

WS = r"[ \t\n\r\f\x0B]"
#: Single-glyph ligatures and what they stand for (fixed values).
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Characters that no text layer should hold: controls, private use, the replacement character.
GARBLED = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{FFFD}\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFF}]"


def trimmed(t):
    return F.regexp_replace(t, rf"^{WS}+|{WS}+$", "")


def running_key(t):
    """Of a running header or footer: lower case, digits as #, single spaces."""
    return F.regexp_replace(F.regexp_replace(F.lower(trimmed(t)), "[0-9]+", "#"), rf"{WS}+", " ")


def heading_key(t):
    """Of a heading: no section number, only letters and digits of ASCII, in lower case."""
    return F.regexp_replace(F.lower(F.regexp_replace(t, rf"^{WS}*([0-9]+|[A-Z]|[IVXLC]+)(\.[0-9]+)*\.?{WS}+", "")), "[^0-9a-z]+", "")


def escape_markdown(t):
    return F.regexp_replace(t, r"([\\`*_\[\]<>])", r"\\$1")


def escape_html(t):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def expand_ligatures(t):
    for a, b in LIGATURES.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def garbled_ratio(t):
    """Part of the characters besides white space that is garbled; 0 for none."""
    n = F.length(F.regexp_replace(t, rf"{WS}+", ""))
    return F.when(n > 0, F.regexp_count(t, F.lit(GARBLED)) / n).otherwise(0.0)


def hex_color(c):
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(c)), 6, "0"))


#: A line that is a page's number (a fixed value).
PAGE_NUMBER = r"(?i)^[ \t]*(?:page[ \t]*)?[-–—(\[]?[ \t]*(?:[0-9]{1,4}|[ivxlcdm]{1,7})[ \t]*[-–—)\]]?[ \t]*(?:(?:of|/)[ \t]*[0-9]{1,4})?[ \t]*$"
#: Marks of list items: bullets, and numbers or letters with a dot or bracket (fixed values).
LIST_BULLETS = "•◦▪▫‣⁃∙·●○■□►▶➢➤✓✔–—*-"
_BULLET = r"[•◦▪▫‣⁃∙·●○■□►▶➢➤✓✔–—*\-]"
_ENUM = r"\(?(?:[0-9]{1,3}|[a-zA-Z]|[ivxlcdm]{1,6})[.)]|[0-9]{1,3}(?:\.[0-9]{1,3})+\.?"
#: Code points of East Asian scripts (fixed values).
CJK = r"[\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FFEF}\x{20000}-\x{3FFFF}]"
#: Bodies of paragraphs that Markdown would take for something else (a fixed value).
_SYNTAX = r"^(?:#{1,6}[ \t\n]|>|[0-9]+[.)][ \t\n]|[-+*][ \t\n])"


def list_marker(t, bullets_only: bool = False):
    """The bullet or number that a line starts with and that text follows; else ''."""
    return F.regexp_extract(t, rf"^[ \t]*({_BULLET if bullets_only else _BULLET + '|' + _ENUM})[ \t]+[^ \t]", 1)


def wrap_markdown(t, bold, italic, mono, url=None):
    """A run in Markdown: white space at its ends stays outside the marks; code takes no other style."""
    core = trimmed(t)
    lead, trail = F.regexp_extract(t, rf"^({WS}*)", 1), F.regexp_extract(t, rf"({WS}*)$", 1)
    plain = escape_markdown(core)
    plain = F.when(italic, F.concat(F.lit("_"), plain, F.lit("_"))).otherwise(plain)
    plain = F.when(bold, F.concat(F.lit("**"), plain, F.lit("**"))).otherwise(plain)
    out = F.when(mono, F.concat(F.lit("`"), F.replace(core, F.lit("`"), F.lit("'")), F.lit("`"))).otherwise(plain)
    if url is not None:
        target = F.replace(F.replace(url, F.lit(" "), F.lit("%20")), F.lit(")"), F.lit("%29"))
        out = F.when(url != "", F.concat(F.lit("["), out, F.lit("]("), target, F.lit(")"))).otherwise(out)
    return F.when(core == "", t).otherwise(F.concat(lead, out, trail))


def guard(body):
    """A paragraph's Markdown, with a backslash where it would begin a heading, quote or list."""
    return F.when(body.rlike(_SYNTAX), F.concat(F.lit("\\"), body)).otherwise(body)


def clean(t):
    """Odd spaces as spaces, carriage returns as line feeds, ligatures spelled out, controls and formats dropped."""
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, r"[\x{00A0}\x{FEFF}\x{FFFE}]", " ")
    return F.regexp_replace(expand_ligatures(t), r"[\x00-\x08\x0B\x0E-\x1F\x7F-\x9F\x{00AD}\p{Cf}\p{Co}]", "")


def image_markdown(alt, page):
    """A placeholder for an image: its description, else its page from 1."""
    own = F.regexp_replace(F.replace(F.replace(F.coalesce(alt, F.lit("")), F.lit("["), F.lit("(")), F.lit("]"), F.lit(")")), "\n", " ")
    return F.concat(F.lit("!["), F.when(own != "", own).otherwise(F.concat(F.lit("image p"), (page + 1).cast("string"))), F.lit("]()"))
