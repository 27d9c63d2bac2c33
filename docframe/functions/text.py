"""Text functions on columns: white space, escapes, truncation, markers, headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space; Java's own class leaves most of it out.
UNICODE_SPACE = r"[\s\p{Z}\x{85}]"
# Bullets, and the least ratios to the body size of heading levels 1 to 5 (level 6 below), and of a heading
BULLETS = "•‣·◦▪●–—*-"
HEADING_RATIOS = (2.0, 1.6, 1.4, 1.25, 1.15)
# White-space modes -> (collapse spaces, keep line ends, wrap)
WHITE_SPACE = {"normal": (True, False, True), "nowrap": (True, False, False), "pre": (False, True, False), "pre-wrap": (False, True, True), "pre-line": (True, True, True)}


def collapse_box(text: Column) -> Column:
    """Runs of ASCII white space to one space, ends kept."""
    return F.regexp_replace(text, r"[ \t\n\r\f]+", " ")


def collapse_keep_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\r\f]+", " ")


def collapse_inline(text: Column) -> Column:
    """Runs of Unicode white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, UNICODE_SPACE + "+", " "))


def white_space_flag(mode: Column, flag: int) -> Column:
    """flag 0: collapse spaces, 1: keep line ends, 2: wrap; unknown modes are normal."""
    table = F.create_map(*[F.lit(x) for m, flags in WHITE_SPACE.items() for x in (m, flags[flag])])
    return F.coalesce(table[mode], F.lit(WHITE_SPACE["normal"][flag]))


def normalise_lines(text: Column) -> Column:
    """Byte order mark dropped, CR LF and CR to LF."""
    return F.regexp_replace(F.regexp_replace(text, r"\A\x{FEFF}", ""), r"\r\n?", "\n")


def escape_html(text: Column, quotes: bool = False) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if quotes else ())):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]])", r"\\$1")


def escape_url(url: Column) -> Column:
    out = url
    for a, b in ((" ", "%20"), ("(", "%28"), (")", "%29")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def quote_csv(value: Column, comma: str = ",") -> Column:
    """Quoted if it holds the separator, a quote or a line end, starts with white space, or is a backslash and a dot."""
    needs = F.contains(value, F.lit(comma)) | value.rlike(r'["\r\n]') | value.rlike(r"\A" + UNICODE_SPACE) | (value == "\\.")
    return F.when(needs, F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def truncate_bytes(text: Column, most: int) -> Column:
    """The first bytes of the text's UTF-8, cut back to whole characters."""
    data = F.encode(text, "UTF-8")
    head = F.hex(F.substring(data, 1, most))
    inside = F.hex(F.substring(data, most + 1, 1)).rlike("^[89AB]")  # the next byte continues a character
    whole = F.regexp_replace(head, r"[C-F][0-9A-F](?:[89AB][0-9A-F])*$", "")
    return F.when(F.octet_length(data) <= most, text).otherwise(F.decode(F.unhex(F.when(inside, whole).otherwise(head)), "UTF-8"))


def capitalise_words(text: Column) -> Column:
    """The first letter of each word in upper case, the rest as it is."""
    words = F.split(text, " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def transform_case(text: Column, mode: Column) -> Column:
    return F.when(mode == "uppercase", F.upper(text)).when(mode == "lowercase", F.lower(text)).when(mode == "capitalize", capitalise_words(text)).otherwise(text)


def list_marker(line: Column) -> Column:
    """struct(marker, ordered) of a line's first word: a bullet by its first character; digits, one letter or roman letters, and a dot or bracket. Null if none."""
    word = F.regexp_extract(F.trim(line), r"\A(\S+)", 1)
    bullet = F.substring(word, 1, 1)
    return (
        F.when(word.rlike(r"\A[" + BULLETS.replace("-", r"\-") + "]"), F.struct(bullet.alias("marker"), F.lit(False).alias("ordered")))
        .when(word.rlike(r"\A(?:[0-9]+|[A-Za-z]|[ivxlcdmIVXLCDM]+)[.)]\z"), F.struct(word.alias("marker"), F.lit(True).alias("ordered")))
    )


def heading_level(size: Column, body: Column) -> Column:
    """1 to 6 by the ratio of sizes; null if it is no heading."""
    ratio = size / body
    out = F.when(ratio < HEADING_RATIOS[-1], None)
    for level, least in enumerate(HEADING_RATIOS, 1):
        out = out.when(ratio >= least, level)
    return F.when((body > 0) & (size > 0), out)
