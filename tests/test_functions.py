"""Formats, text, counters and sheet functions against fixed cases."""

import math

import pytest
from pyspark.sql import functions as F

from docframe.functions import counters, formats, sheet, text
from docframe.operators import rules
from docframe.operators.convert import can_convert
from docframe.sources.packages import pack, package_format


def values(spark, column, rows, schema="s string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column).collect()]


def test_names_and_paths(spark):
    assert values(spark, formats.format_of_name(F.col("s")), ["PDF", ".pdf", "MD", "tab", "xlsm", " jpg ", "", "word", "image"]) == ["pdf", "pdf", "markdown", "tsv", "xlsx", "jpeg", None, None, None]
    assert values(spark, formats.format_of_path(F.col("s")), ["/a/b/Doc.PDF", "README.md", "data.tab", "none", "/a.b/c"]) == ["pdf", "markdown", "tsv", None, None]
    kinds = ["text/HTML; charset=utf-8", "application/msword", "text/x-any", "image/jpg", "video/mp4", "application/zip"]
    assert values(spark, formats.format_of_media_type(F.col("s")), kinds) == ["html", None, "text", "jpeg", None, None]


def test_capabilities(spark):
    pairs = formats.conversion(formats.dimension(spark)).collect()
    assert len(pairs) == 196 and sum(r.verdict == "ok" for r in pairs) == 169
    assert [can_convert(*p) for p in (("x", "pdf"), ("pdf", "x"), ("pdf", "heic"), ("csv", "csv"), ("heic", "png"))] == ["unknown", "unknown", "output", "same", "ok"]


def test_detection(spark):
    heic = (24).to_bytes(4, "big") + b"ftypmif1" + bytes(4) + b"mif1heic"
    cases = [
        (b"\x89PNG\r\n\x1a\n..", "a.txt", "png"), (b"\xff\xd8\xff\xe0", "", "jpeg"), (b"{\\rtf1 x}", "a.md", "rtf"), (b"junk %PDF-1.4", "", "pdf"), (heic, "", "heic"), (heic[:20], "", None),
        (b"<p>x</p>", "a.md", "markdown"), (b" \n<!DOCTYPE html><p>", "", "html"), (b"<prefix>", "", None), (b"plain", "x", None), (b"<!--c-->", "noext", "html"),
    ]
    rows = [(c, p) for c, p, _ in cases]
    assert values(spark, formats.detect(F.col("c"), F.col("p")), rows, "c binary, p string") == [f for _, _, f in cases]
    assert package_format(pack([("[Content_Types].xml", ""), ("word/other.xml", "")])) == "docx"
    assert package_format(pack([("mimetype", "application/epub+zip")])) == "epub" and package_format(pack([("a", "")])) is None and package_format(b"no") is None


def test_detection_without_bounds(spark):
    """Any number of brands is looked at, and any white space before a page's first tag."""
    brands = lambda last: (16 + 4 * 70).to_bytes(4, "big") + b"ftypmif1" + bytes(4) + b"abcd" * 69 + last
    cases = [(brands(b"heic"), "heic"), (brands(b"xxxx"), None), (b"abcdheic".join([brands(b"xxhe")[:-4], b""])[:296], None), (b" " * 5000 + b"<html>", "html"), (b"\xef\xbb\xbf\n" * 1 + b"<p>", "html")]
    assert values(spark, formats.detect(F.col("c"), F.lit("x")), [(c,) for c, _ in cases], "c binary") == [f for _, f in cases]


def test_letters_of_any_length(spark):
    def letters(n):
        out = ""
        while n > 0:
            n, rest = divmod(n - 1, 26)
            out = chr(65 + rest) + out
        return out

    numbers = [1, 26, 27, 26**6 * 30, 26**9 + 5, 2**53 + 1, 2**63 - 1]
    assert values(spark, counters.format_counter(F.col("n"), F.lit("upper-alpha")), numbers, "n long") == [letters(n) for n in numbers]
    assert values(spark, sheet.column_name(F.col("n")), [26**6 * 30], "n long") == [letters(26**6 * 30)]


def test_parts_of_any_size():
    from docframe.sources.packages import parts_of

    parts = parts_of(pack([("big", bytes((1 << 28) + 1)), ("small", "x")]))
    assert set(parts) == {"big", "small"} and parts["small"] == b"x" and len(parts["big"]) == (1 << 28) + 1 and parts.get("none") is None


def test_page_fit(spark):
    boxes = [(480.0, 0.0, 612.0, 792.0, 0.0), (0.0, 0.0, 612.0, 792.0, 0.0), (0.0, 0.0, 612.0, 792.0, 96.0), (100.0, 100.0, 200.0, 50.0, 0.0), (1000.0, 0.0, 612.0, 792.0, 72.0), (-1.0, 396.0, 612.0, 792.0, 300.0)]
    got = values(spark, rules.fit_scale(*[F.col(c) for c in "whpqd"]), boxes, "w double, h double, p double, q double, d double")
    for (w, h, p, q, d), dpi in zip(boxes, got):
        assert not (w > 0 and math.ceil(p * (dpi / 72)) > w + 1) and not (h > 0 and math.ceil(q * (dpi / 72)) > h + 1)
    assert got[1:] == [150.0, 96.0, 36.0, 72.0, 36.0] and abs(got[0] - 480 / 612 * 72) < 1e-9


def test_text(spark):
    assert values(spark, text.collapse_inline(F.col("s")), [" a 　b\n", ""]) == ["a b", ""]
    assert values(spark, text.collapse_box(F.col("s")), [" a \t\nb "]) == [" a b "]
    assert values(spark, text.truncate_bytes(F.col("s"), 4), ["abc", "abcd", "abcde", "aéé", "aééx", "漢字", "a\U0001f600"]) == ["abc", "abcd", "abcd", "aé", "aé", "漢", "a"]
    assert values(spark, text.quote_csv(F.col("s")), ["a", "a,b", 'q"', " lead", "\\.", ""]) == ["a", '"a,b"', '"q"""', '" lead"', '"\\."', ""]
    assert values(spark, text.normalise_lines(F.col("s")), ["﻿a\r\nb\rc"]) == ["a\nb\nc"]
    assert values(spark, text.transform_case(F.col("s"), F.lit("capitalize")), ["ab cD"]) == ["Ab CD"]
    got = values(spark, text.list_marker(F.col("s")), ["- x", "1. x", "iv) x", "-5", "ab. x", "A. x", "plain"])
    assert [(g.marker, g.ordered) if g else None for g in got] == [("-", False), ("1.", True), ("iv)", True), ("-", False), None, ("A.", True), None]
    assert values(spark, text.heading_level(F.col("a"), F.lit(10.0)), [20.0, 16.0, 14.0, 12.5, 11.5, 11.4], "a double") == [1, 2, 3, 4, 5, None]
    assert values(spark, text.escape_markdown(F.col("s")), ["a*b_[c]`\\"]) == ["a\\*b\\_\\[c\\]\\`\\\\"]


@pytest.mark.parametrize(
    "style,wanted",
    [("upper-roman", ["I", "IV", "MMMCMXCIX", "4000", "0", "-2"]), ("lower-alpha", ["a", "d", "ewu", "ewv", "0", "-2"]), ("decimal-leading-zero", ["01", "04", "3999", "4000", "00", "-2"]), ("disc", ["•"] * 6), ("odd", ["1", "4", "3999", "4000", "0", "-2"])],
)
def test_counters(spark, style, wanted):
    assert values(spark, counters.format_counter(F.col("n"), F.lit(style)), [1, 4, 3999, 4000, 0, -2], "n long") == wanted


def test_references(spark):
    assert values(spark, sheet.column_name(F.col("n")), [1, 26, 27, 702, 703, 0], "n long") == ["A", "Z", "AA", "ZZ", "AAA", ""]
    got = values(spark, sheet.parse_part_ref(F.col("s")), ["A1", "Z1", "AA1", "AB10", "BA1", "", "12", "A", "A0"])
    assert [tuple(g) for g in got] == [(0, 0), (0, 25), (0, 26), (9, 27), (0, 52), *[(-1, -1)] * 4]
    assert tuple(values(spark, sheet.parse_ref(F.col("s")), ["$b$3"])[0]) == (3, 2)
    assert values(spark, sheet.normalise_rgb(F.col("s")), ["ff00aa11", " abcdef ", "abc"]) == ["00AA11", "ABCDEF", ""]


def test_dates_and_numbers(spark):
    codes = [("mm-dd-yy", True), ("yyyy\\-mm\\-dd", True), ("h:mm:ss", True), ("[h]:mm", True), ("d-mmm", True), ("", False), ("0.00", False), ("#,##0", False), ("0%", False), ("[Magenta]0.00", False), ('0.00" mph"', False), ("[>=100]0", False), ("[mm", False)]
    assert values(spark, sheet.is_date_code(F.col("s")), [c for c, _ in codes]) == [w for _, w in codes]
    shown = values(spark, sheet.format_serial(F.col("a"), F.col("c"), F.lit(False)), [(45000.0, "yyyy-mm-dd"), (0.5, "h:mm:ss"), (45000.75, "m/d/yy h:mm"), (100.0, "mm-dd-yy")], "a double, c string")
    assert shown == ["2023-03-15", "12:00:00", "2023-03-15 18:00", "1900-04-09"]
    assert values(spark, sheet.format_serial(F.col("a"), F.lit("d"), F.lit(True)), [100.0], "a double") == ["1904-04-10"]
    numbers = [(42.0, "42"), (42.5, "42.5"), (-3.0, "-3"), (0.1, "0.1"), (1e20, "1e+20"), (1234567.5, "1.2345675e+06"), (123456.5, "123456.5"), (0.00001, "1e-05"), (0.0001, "0.0001"), (-0.025, "-0.025")]
    assert [sheet.general_number(n) for n, _ in numbers] == [t for _, t in numbers]
    assert values(spark, sheet.format_number(F.col("s"), F.col("c"), F.lit(False)), [("0.5", "0%"), ("x", "0"), ("12", "General")], "s string, c string") == ["50%", "x", "12"]


@pytest.mark.parametrize(
    "source,rows,cols,wanted",
    [("A1*2", 1, 0, "A2*2"), ("$A$1+B2", 3, 3, "$A$1+E5"), ("$A1+A$1", 1, 1, "$A2+B$1"), ("SUM(A1:B2)", 2, 0, "SUM(A3:B4)"), ('"A1 stays"&B1', 1, 0, '"A1 stays"&B2'), ("'A1'!B1+1", 1, 0, "'A1'!B2+1"), ("LOG10(5)", 1, 1, "LOG10(5)"), ("SUM2020", 1, 1, "SUN2021"), ("A1", -5, 0, "#REF!"), ("IF(A1>0,B1,C$2)", 1, 2, "IF(C2>0,D2,E$2)")],
)
def test_formula_shift(source, rows, cols, wanted):
    assert sheet.shift_formula(source, rows, cols) == wanted
