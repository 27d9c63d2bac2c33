"""Readers, writers and operators on small documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.functions import css
from docframe.operators import crop, glyphs, grid, numbering, page_blocks, pivot, rules, style
from docframe.operators.convert import READ, WRITE, convert, convert_one
from docframe.sinks.csv import to_csv
from docframe.sinks.markdown import to_markdown
from docframe.sinks.workbook import clean_number, sheet_names
from docframe.sources import html, pdf, workbook
from docframe.sources.text import separated

#: Recipes, orders and letters of our own, each for one or two rules of the writer.
MARKDOWN = [
    ("<h3>Bread</h3>Mix well.<h4>Rest</h4>", "### Bread\n\nMix well.\n\n#### Rest\n"),
    ("<div>Use <b>warm</b> water, <i>never</i> <b><i>boiling</i></b>!</div>", "Use **warm** water, _never_ _**boiling**_!\n"),
    ('<div><a href="mailto:cook@kitchen.example">Write <b>us</b></a></div>', "[Write](mailto:cook@kitchen.example) [**us**](mailto:cook@kitchen.example)\n"),
    ("<ul><li>flour<ol><li>rye<ul><li>dark</ul></ol><li>salt</ul>", "- flour\n  1. rye\n    - dark\n- salt\n"),
    ("<ol start=3><li>knead<li value=7>prove<li>bake</ol>", "3. knead\n7. prove\n8. bake\n"),
    ("<ol type=A><li>oven</ol>", "A. oven\n"),
    ("<blockquote>Slow<blockquote>and low</blockquote></blockquote>", "> Slow\n>\n> > and low\n"),
    ("<div><s>180</s> 220 degrees, <strike>fan</strike></div>", "~~180~~ 220 degrees, ~~fan~~\n"),
    ('<figure><img alt="A loaf [cut]" src="loaf (1).jpg"></figure>', "![A loaf \\[cut\\]](loaf%20%281%29.jpg)\n"),
    ("one<hr>two", "one\n\n---\n\ntwo\n"),
    ("<ul><li><input type=checkbox>shop<li><input checked type=checkbox>cook</ul>", "- [ ] shop\n- [x] cook\n"),
    ("<table><tr><td>gram<td>cup<tr><td colspan=2>by taste</table>", "| gram | cup |\n| --- | --- |\n| by taste | by taste |\n"),
    ("<table><tr><th rowspan=3>dough<th>day 1<tr><td>day 2<tr><td>day 3</table>", "| dough | day 1 |\n| --- | --- |\n| dough | day 2 |\n| dough | day 3 |\n"),
    ("<table><thead><tr><td align=right>kg<td>a|b</thead><tr><td>2<td>x</table>", "| kg | a\\|b |\n| ---: | --- |\n| 2 | x |\n"),
    ("<i>not closed<div>still slanted</div>", "_not closed_\n\n_still slanted_\n"),
    ("<div style='display: none'>gone</div><style>x</style><div>5*3 `is` [15]_</div>", "5\\*3 \\`is\\` \\[15\\]\\_\n"),
    ("<pre>  two\n    four\n</pre>", "```\n  two\n    four\n```\n"),
]


@pytest.mark.parametrize("source,wanted", MARKDOWN)
def test_markdown(source, wanted):
    assert to_markdown(source) == wanted


def test_plain_and_csv():
    assert to_markdown("<h5>Pie</h5><div><u>Cut</u> the <a href=apple>apple</a> in <s>two</s> four</div>", bare=True) == "Pie\n\nCut the apple in two four\n"
    orders = "<table><caption>Orders</caption><tr><th>who<th>what<tr><td>Ann<td>tea; 2 cups<tr><td>Bo<td>cake, \"big\"</table>"
    assert to_csv(orders) == 'who,what\nAnn,tea; 2 cups\nBo,"cake, ""big"""\n' and to_csv(orders, ";") == 'who;what\nAnn;"tea; 2 cups"\nBo;"cake, ""big"""\n'
    assert to_csv("<table><tr><td rowspan=2 colspan=2>q<td>r<tr><td>s<tr><td>t</table>") == "q,q,r\nq,q,s\nt,,\n"
    assert to_csv("<div>No table.</div>") == "" and to_csv("<table><tr><td></table><blockquote><table><tr><td>in a quote</table></blockquote>") == '""\n\nin a quote\n'
    assert separated(b'kg;x,2\r\n"a ""b""\nc",\r\n\r\n,') == [["kg;x", "2"], ['a "b"\nc', ""], ["", ""]]


PAGE = "<h1>Head</h1><p>a <b>bold</b> <i>word</i> é</p><ul><li>one<ul><li>in</li></ul></li><li>two</li></ul><ol><li>x</li><li>y</li></ol><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>007</td></tr></table>"


@pytest.mark.parametrize("target", ["docx", "rtf", "epub", "markdown"])
def test_round_trip(target):
    """Through a format and back to Markdown is the same as straight there; equal input gives equal bytes."""
    data, error = convert_one("html", target, PAGE.encode())
    assert error is None and convert_one("html", target, PAGE.encode())[0] == data
    direct = convert_one("html", "markdown", PAGE.encode())[0]
    assert (data if target == "markdown" else convert_one(target, "markdown", data)[0]) == direct


def test_pdf(spark):
    """Through a page description: headings, a wrapped paragraph, lists and a ruled table come back."""
    page = "<h1>Title here</h1><p>a <b>bold</b> word " + "and more words " * 20 + "é.</p><h2>Sub head</h2><ul><li>one</li><li>two</li></ul><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>x y</td></tr><tr><td>2</td><td>007</td></tr></table><ol><li>x y</li><li>y z</li></ol><p>(end)</p>"
    data = convert_one("html", "pdf", page.encode())[0]
    assert convert_one("pdf", "markdown", data)[0] == convert_one("html", "markdown", page.encode())[0]
    docs = spark.createDataFrame([(1, data), (2, b"%PDF-1.4 broken"), (3, b"no")], "doc_id long, content binary")
    assert pdf.pages(docs, "doc_id", "content").where("error is null").collect()[0][1:4] == (0, 612.0, 792.0)
    words = glyphs.page_words(pdf.glyphs(docs, "doc_id", "content").where("error is null").drop("error"))
    assert words.where("text = 'Title' and bold").count() == 1
    assert pdf.rules(docs, "doc_id", "content").where("error is null").count() > 6
    assert pdf.glyphs(docs, "doc_id", "content").where("doc_id = 3 and error is not null").count() == 1


def test_pdf_filters():
    assert pdf.run_lengths(b"\x02abc\xfex\x80") == b"abcxxx"
    assert pdf.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert [v for v, _ in pdf.objects(b"<< /A [1 2.5 (x\\)\\101) <4142>] /B 3 0 R >>")] == [{"A": [1, 2.5, b"x)A", b"AB"], "B": pdf.Ref((3, 0))}]


def test_matrix():
    made = {"html": PAGE.encode()} | {t: convert_one("html", t, PAGE.encode())[0] for t in WRITE if t != "html"}
    for a in READ:
        for b in WRITE:
            out, error = convert_one(a, b, made[a])
            assert (error is None) == (a != b) and (a == b or out is not None), (a, b, error)


def test_convert_isolates_failures(spark):
    docs = spark.createDataFrame([(1, b"<p>x</p>", "html"), (2, b"not a zip", "docx"), (3, b"x", None), (4, b"x", "markdown"), (5, None, "text")], "doc_id long, content binary, format string")
    got = {r.doc_id: (r.output, r.error) for r in convert(docs, "markdown").collect()}
    assert bytes(got[1][0]) == b"x\n" and got[2][0] is None and "BadZip" in got[2][1] and got[3][1] == "unknown document format" and "same" in got[4][1] and got[5][1] is None


def test_nodes(spark):
    docs = spark.createDataFrame([(1, "<title>T</title><div id=a><p>x<p>y</div>"), (2, None)], "doc_id long, html string")
    rows = html.nodes(docs, "doc_id", "html").where("doc_id = 1").collect()
    by = {r.node_id: r for r in rows}
    assert all(r.parent_id is None or by[r.parent_id].pre < r.pre and by[r.parent_id].post > r.post for r in rows if r.tag != "#text")
    assert [r.tag for r in sorted(rows, key=lambda r: r.pre)] == ["html", "head", "title", "#text", "body", "div", "p", "#text", "p", "#text"]


def test_style(spark):
    docs = spark.createDataFrame([(1, "<div class='c d'><p id=x>1</p><p style='color: red'>2</p><p>3</p></div><p>4</p>")], "doc_id long, html string")
    nodes = html.nodes(docs, "doc_id", "html").cache()
    ps = nodes.where("tag = 'p'").orderBy("pre").select("node_id").collect()
    sheets = [("ua", "p { color: black; display: block; margin: 1px 2px }"), ("author", ".c p { color: blue } div p:nth-child(3) { color: green } #x { color: navy } p { margin: 0 !important } p:not(.a) { color: pink } @media print { p { color: gray } }")]
    won = {(r.node_id, r.prop): r.value for r in style.apply_sheets(spark, nodes, sheets).collect()}
    assert [won[p.node_id, "color"] for p in ps] == ["navy", "red", "green", "black"] and won[ps[0].node_id, "margin-left"] == "0"
    assert style.nth("2n+1") == (2, 1) and style.nth("odd") == (2, 1) and style.nth("-n+3") == (-1, 3) and style.nth("x") is None
    assert [s.specificity for s in style.parse_selectors("#a .b c, *")] == [(1, 1, 1), (0, 0, 0)]


def test_grid(spark):
    rows = [(1, 0, 0, 0, 2, 1, False, "tall"), (1, 0, 0, 1, 1, 2, False, "wide"), (1, 0, 1, 0, 1, 1, False, "m"), (1, 0, 1, 1, 1, 1, False, "n"), (2, 0, 0, 0, 1, 1, False, "a"), (2, 0, 1, 0, 1, 1, False, "b"), (2, 0, 1, 1, 1, 1, False, "c")]
    cells = grid.place_cells(spark.createDataFrame(rows, "doc_id long, table_id long, row int, ord int, rowspan int, colspan int, header boolean, text string"))
    got = {(r.doc_id, r.row): list(r["values"]) for r in grid.dense(cells).collect()}
    assert got == {(1, 0): ["tall", "wide", "wide"], (1, 1): ["tall", "m", "n"], (2, 0): ["a", ""], (2, 1): ["b", "c"]}


def test_workbook(spark):
    page = "<table><caption>A: b</caption><tr><th>n</th><th>t</th></tr><tr><td colspan=2>12.5</td></tr><tr><td>007</td><td>x</td></tr></table><table><caption>a: B</caption><tr><td>1</td></tr></table>"
    docs = spark.createDataFrame([(1, convert_one("html", "xlsx", page.encode())[0]), (2, b"broken")], "doc_id long, content binary")
    raw = workbook.raw_cells(docs, "doc_id", "content")
    assert raw.where("error is not null").count() == 1
    got = {(r.name, r.row, r.col): (r.text, r.value.kind) for r in workbook.cells(raw).collect()}
    assert got == {("A  b", 0, 0): ("n", "string"), ("A  b", 0, 1): ("t", "string"), ("A  b", 1, 0): ("12.5", "number"), ("A  b", 2, 0): ("007", "string"), ("A  b", 2, 1): ("x", "string"), ("a  B 2", 0, 0): ("1", "number")}
    merges = workbook.merges(docs.where("doc_id = 1"), "doc_id", "content")
    assert [tuple(r)[2:6] for r in merges.select("doc_id", "sheet", "r0", "c0", "r1", "c1").collect()] == [(1, 0, 1, 1)]
    assert sheet_names(["", "x" * 40, "X" * 40]) == ["Table 1", "x" * 31, "X" * 29 + " 2"]
    assert [clean_number(t) for t in ("1", "007", "-3", "1.5", "1.50", "", "1e+20")] == [True, False, True, True, False, False, True]


def test_glyphs(spark):
    at = [("A", 0, 100), ("B", 6, 100), ("C", 20, 100), ("D", 26, 100), ("x", 0, 120)]
    rows = [(1, 0, i, r, float(x), x + 6.0, float(y), 10.0, False, False, False) for i, (r, x, y) in enumerate(at)]
    df = spark.createDataFrame(rows, "doc_id long, page int, seq int, r string, x double, x1 double, y double, size double, bold boolean, italic boolean, is_space boolean")
    assert sorted((r.line, r.text) for r in glyphs.page_words(df).collect()) == [(0, "AB"), (0, "CD"), (1, "x")]
    snapped = spark.range(1).select(glyphs.snap(F.array(*[F.lit(v) for v in (0.0, 1.0, 3.5, 10.0, 12.0)])).alias("s")).first().s
    assert snapped == [1.5, 11.0]
    assert glyphs.xy_cut([(0, 40, 10, 10), (100, 140, 10, 10), (0, 40, 22, 10), (100, 140, 22, 10)], 200) == [0, 2, 1, 3]
    rules_df = spark.createDataFrame([(1, 0, h, a, 0.0, 100.0) for h, a in [(True, 0.0), (True, 20.0), (True, 40.0), (False, 0.0), (False, 50.0), (False, 100.0)]], "doc_id long, page int, horizontal boolean, a double, b0 double, b1 double")
    words = spark.createDataFrame([(1, 0, t, x, x + 10.0, y) for t, x, y in [("A", 20.0, 10.0), ("B", 70.0, 10.0), ("C", 20.0, 30.0), ("D", 70.0, 30.0)]], "doc_id long, page int, text string, x double, x1 double, y double")
    assert sorted((r.row, r.col, r.text) for r in glyphs.ruled_cells(rules_df, words).collect()) == [(0, 0, "A"), (0, 1, "B"), (1, 0, "C"), (1, 1, "D")]


def plain_order(boxes, width, vertical_first=True):
    """Places of boxes (x, x1, y, size) by recursion, one cut at a time."""

    def vertical(own):
        own = sorted(own, key=lambda b: b[1][0])
        gaps = [(own[k][1][0] - max(b[1] for _, b in own[:k]), -k) for k in range(1, len(own))]
        gap, k = max(gaps, default=(0, 0))
        if gap < max(18.0, 0.05 * width):
            return None
        middle = (own[-k][1][0] + max(b[1] for _, b in own[:-k])) / 2
        return [b for b in own if b[1][0] < middle], [b for b in own if b[1][0] >= middle]

    def horizontal(own):
        own = sorted(own, key=lambda b: b[1][2])
        gaps = [(b[1][2] - a[1][2], -k) for k, (a, b) in enumerate(zip(own, own[1:]), 1)]
        gap, k = max(gaps, default=(0, 0))
        if not gaps or gap < 1.6 * max(own[-k - 1][1][3], 1.0) or gap < 1.5 * np.median([g for g, _ in gaps]) + 0.01:
            return None
        return own[:-k], own[-k:]

    def order(own, first):
        for cut in (vertical, horizontal) if first else (horizontal, vertical):
            parts = cut(own)
            if parts and all(parts):
                return [i for p in parts for i in order(p, cut is horizontal)]
        return [i for i, _ in sorted(own, key=lambda b: (b[1][2], b[1][0]))]

    return order(list(enumerate(boxes)), vertical_first)


def test_reading_order_of_many_pages(spark):
    """Pages that end within batches and between them are read as each by itself, and no page goes to Python alone."""
    random = np.random.default_rng(3)
    pages = {}
    for doc in range(60):
        step = int(random.choice([1, 30, 110]))
        x = random.integers(0, 600 // step, int(random.choice([1, 2, 5, 40]))) * float(step)
        pages[doc] = [(float(a), float(a + random.choice([5, 80, 250])), float(random.integers(0, 60) * 14), float(random.choice([0, 8, 24]))) for a in x]
    rows = [(doc, 0, n, *b, 612.0) for doc, boxes in pages.items() for n, b in enumerate(boxes)]
    lines = spark.createDataFrame([rows[k] for k in random.permutation(len(rows))], "doc_id long, page int, line int, x double, x1 double, y double, size double, width double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for at_once in (1, 50, 100_000):
            df = glyphs.reading_order(lines, at_once)
            got = {(r.doc_id, r.reading_seq): r.line for r in df.collect()}
            assert got == {(doc, seq): line for doc, boxes in pages.items() for seq, line in enumerate(plain_order(boxes, 612.0))}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()


def test_reading_order_of_odd_boxes(spark):
    """Boxes that end before they begin end the cutting; lines without a place are numbered too, behind all others."""
    assert glyphs.xy_cut([(100, 0, 5, 10), (100, 0, 1, 10)], 200) == [1, 0] and glyphs.xy_cut([], 200) == []
    rows = [(1, 0, 0, None, 5.0, 1.0, 9.0, 612.0), (1, 0, 1, 0.0, None, 40.0, None, None), (1, 0, 2, 0.0, 9.0, 1.0, 9.0, None), (1, 1, 0, None, None, None, None, None), (None, 0, 0, 1.0, 2.0, 3.0, 4.0, 5.0)]
    lines = spark.createDataFrame(rows, "doc_id long, page int, line int, x double, x1 double, y double, size double, width double")
    assert {(r.doc_id, r.page, r.line, r.reading_seq) for r in glyphs.reading_order(lines).collect()} == {(1, 0, 2, 0), (1, 0, 1, 1), (1, 0, 0, 2), (1, 1, 0, 0), (None, 0, 0, 0)}


def page_of(spark, at):
    """Glyphs (character, x, x1, y, size) of one page."""
    rows = [(1, 0, i, r, float(x), float(x1), float(y), float(size), False, False, r == " ") for i, (r, x, x1, y, size) in enumerate(at)]
    return spark.createDataFrame(rows, "doc_id long, page int, seq int, r string, x double, x1 double, y double, size double, bold boolean, italic boolean, is_space boolean")


def test_words_of_mixed_sizes(spark):
    """A gap counts against the greater of a glyph's size and that of its word's first glyph; glyphs without a character show as U+FFFD."""
    big = [("A", 0, 14, 100, 20), ("b", 16, 21, 100, 10), ("c", 23.5, 28, 100, 10), ("d", 33, 38, 100, 10)]
    small = [("x", 0, 5, 140, 10), ("Y", 7, 20, 140, 20), ("z", 22, 27, 140, 10), ("", 27, 30, 140, 10), (" ", 30, 33, 140, 10), ("w", 33, 38, 140, 10)]
    words = glyphs.page_words(page_of(spark, big + small)).orderBy("line", "word").collect()
    assert [(w.line, w.word, w.text, w.x, w.x1, w.size) for w in words] == [(0, 1, "Abc", 0.0, 28.0, 10.0), (0, 2, "d", 33.0, 38.0, 10.0), (1, 1, "xY", 0.0, 20.0, 15.0), (1, 2, "z\ufffd", 22.0, 30.0, 10.0), (1, 3, "w", 33.0, 38.0, 10.0)]


def test_runs_and_glyphs_agree(spark):
    """Runs of a page and its single glyphs give the same words; nulls and empty pages give none."""
    rng = np.random.default_rng(4)
    runs, at = [], []
    for _ in range(60):
        text = "".join(rng.choice(list("ab c")) for _ in range(rng.integers(0, 12)))
        size, x, y = float(rng.choice([8, 10, 12])), float(rng.integers(0, 400)), float(rng.integers(0, 40) * 9)
        widths = rng.uniform(3, 6, len(text)).tolist()
        runs.append((text, widths, x, y, size, False, False))
        for c, width in zip(text, widths):
            at.append((c, x, x + width, y, size))
            x += width
    pages = spark.createDataFrame([(1, 0, runs), (2, 0, []), (3, 0, [("", [], 0.0, 0.0, 9.0, True, True)])], f"doc_id long, page int, runs {glyphs.RUNS}")
    shown = lambda df: sorted((r.doc_id, r.line, r.word, r.text, round(r.x, 6), round(r.x1, 6), r.y, r["size"]) for r in df.collect())
    assert shown(glyphs.run_words(pages)) == shown(glyphs.page_words(page_of(spark, at)))


def test_grid_lines_margin_and_least(spark):
    track = lambda v: spark.range(1).select(glyphs.track(F.array(F.lit(0.0), F.lit(20.0), F.lit(40.0)), F.lit(v))).first()[0]
    assert [track(v) for v in (-3.5, -3.0, 0.0, 20.0, 20.1, 40.0, 43.0, 43.1)] == [-1, 0, 0, 0, 1, 1, 1, -1]
    line = [{"words": [{"x": 10.0, "x1": 20.0, "text": "a", "bold": False, "italic": False}, {"x": 60.0, "x1": 70.0, "text": "b", "bold": False, "italic": False}], "y": 10.0}]
    cross = lambda ys, xs: [(True, y, 0.0, 100.0) for y in ys] + [(False, x, 0.0, 40.0) for x in xs]
    assert page_blocks.lattice(line, cross((0.0, 20.0), (0.0, 50.0, 100.0))) is None
    assert page_blocks.lattice(line, cross((0.0, 20.0, 40.0), (0.0, 50.0, 100.0)))[2].count("<td") == 4


def test_gutters():
    """Gaps that half of the lines have and no word crosses part columns; near ones count together, narrow ones not at all."""
    rows = [[(0, 40, 10), (100, 130, 10), (200, 260, 10)], [(0, 30, 10), (98, 130, 10)], [(2, 44, 10), (102, 140, 10), (150, 160, 10)], [(0, 20, 10), (24, 44, 10), (100, 140, 10)]]
    assert glyphs.gutters(rows) == [70.0] and glyphs.gutters([]) == [] and glyphs.gutters([*rows, [(50, 90, 10)]]) == []
    assert glyphs.dedupe_sorted([1.0, 2.0, 4.5, 5.0]) == [1.0, 4.5]
    texts = [[(x, x1, size, f"t{k}") for k, (x, x1, size) in enumerate(r)] for r in rows]
    assert glyphs.stream_grid(texts)[3] == ["t0 t1", "t2"] and glyphs.stream_grid(texts[:2]) == []


def test_own_sheets_and_plan_size(spark):
    """Each document's style elements hold for itself; a plan does not grow with the number of selectors."""
    docs = spark.createDataFrame([(1, "<style>p { color: red } div p { margin: 1px }</style><div><p>a</div><p>b"), (2, "<style>p.x { color: blue }</style><style>.x { color: green }</style><p class=x>c<p>d"), (3, "<p style='color: pink'>e")], "doc_id long, html string")
    nodes = html.nodes(docs, "doc_id", "html")
    won = sorted((r.doc_id, r.prop, r.value) for r in style.apply_own_sheets(nodes).collect())
    assert won == sorted([(1, "color", "red")] * 2 + [(1, f"margin-{s}", "1px") for s in ("top", "right", "bottom", "left")] + [(2, "color", "blue"), (3, "color", "pink")])
    size = lambda n: style.apply_sheets(spark, nodes, [("author", "".join(f".c{k} p:nth-child({k + 1}) {{ color: red }}" for k in range(n)))])._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert size(3) == size(500)


def test_deep_pages():
    depth = 2000
    assert to_markdown("<div>" * depth + "<h2>Deep</h2><b>text</b>" + "</div>" * depth + "<p>after") == "## Deep\n\n**text**\n\nafter\n"
    assert to_markdown("<ul><li>" * depth + "x").split("\n")[-2] == "  " * (depth - 1) + "- x"
    assert to_markdown("<span>" * depth + "x<script>y</script>" + "</span>" * depth) == "x\n"
    root = html.parse("<div>" * depth + "<nav>m")
    assert max(r[4] for r in html.node_rows(root)) == depth + 3


def test_numbering(spark):
    paras = spark.createDataFrame([(1, i, 1, lvl, s) for i, (lvl, s) in enumerate([(0, 1), (1, 3), (1, 3), (0, 1), (1, 3), (2, 1), (1, 3)])], "doc_id long, seq long, num_id int, ilvl int, start int")
    assert [r.value for r in numbering.counters(paras).orderBy("seq").collect()] == [1, 3, 4, 2, 3, 1, 4]
    chain = spark.createDataFrame([(1, "a", "b", None, "x"), (1, "b", "c", 1, None), (1, "c", "a", 2, "z")], "doc_id long, style_id string, based_on string, size int, font string")
    got = {r.style_id: (r.size, r.font) for r in numbering.style_chain(chain, ["size", "font"]).collect()}
    assert got == {"a": (1, "x"), "b": (1, "z"), "c": (2, "z")}
    cells = spark.createDataFrame([(1, 0, 0, 0, 1, "restart"), (1, 0, 0, 1, 2, None), (1, 0, 1, 0, 1, "continue"), (1, 0, 1, 1, 2, None)], "doc_id long, table_id long, row int, ord int, span int, merge string")
    spans = {(r.row, r.col): r.row_span for r in numbering.row_spans(cells).collect()}
    assert spans[0, 0] == 2 and spans[0, 1] == spans[1, 1] == 1


def test_pivot_and_rules(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 4.0)], "r string, c string, v double")
    got = {(r.r, r.c, r.grand_row, r.grand_column): r.sum_v for r in pivot.pivot_long(df, ["r"], ["c"], [("sum", "v")]).collect()}
    assert got[None, None, True, True] == 7 and got["a", None, False, True] == 3 and got[None, "x", True, False] == 5
    with pytest.raises(ValueError):
        pivot.pivot_wide(df, ["nope"], "c", ["x"], [("sum", "v")])
    pages = spark.createDataFrame([("1-3,5", 4), ("all", 3), ("2,2,9", 3)], "s string, n int").select(rules.page_numbers(F.col("s"), F.col("n")).alias("p")).collect()
    assert [r.p for r in pages] == [[1, 2, 3], [1, 2, 3], [2]]


def test_css():
    assert css.length("1in") == (72, "px") and css.length("2em") == (2, "em") and css.length("3") is None and css.length("0") == (0, "px")
    assert [css.colour(c) for c in ("#abc", "Red", "rgb(255, 0, 16)", "rgb(100%,0%,0%)", "nope")] == ["aabbcc", "ff0000", "ff0010", "ff0000", None]
    assert css.expand("margin", "1px 2px 3px") == [("margin-top", "1px"), ("margin-right", "2px"), ("margin-bottom", "3px"), ("margin-left", "2px")]
    assert dict(css.expand("border-top", "2px solid red")) == {"border-top-width": "2px", "border-top-style": "solid", "border-top-color": "red"}
    assert css.expand("flex", "2 1 10px") == [("flex-grow", "2"), ("flex-shrink", "1"), ("flex-basis", "10px")]
    assert dict(css.expand("font", "italic bold 12px/1.5 A, b"))["line-height"] == "1.5"
    assert css.hints("td", {"align": "right", "bgcolor": "#fff", "width": "50%"}) == [("background-color", "#ffffff"), ("text-align", "right"), ("width", "50%")]


def test_crop(spark):
    df = spark.createDataFrame([(400, 300, 1, 1, "center"), (400, 300, 2, 1, "south"), (3, 1000, 16, 9, "east")], "w int, h int, a int, b int, g string")
    got = df.select(crop.anchor(F.col("w"), F.col("h"), crop.fit_window(F.col("w"), F.col("h"), F.col("a"), F.col("b")), F.col("g")).alias("r")).collect()
    assert [tuple(r.r) for r in got] == [(50, 0, 350, 300), (0, 100, 400, 300), (0, 499, 3, 500)]
    image = np.zeros((64, 64, 3), np.uint8)
    assert crop.best_window(image, (16, 16)) == (24, 24, 40, 40)
    image[40:60:2, 44:60:2] = (255, 0, 0)
    x0, y0, x1, y1 = crop.best_window(image, (16, 16), {"center": 0.0})
    assert x0 >= 40 and y0 >= 36 and (x1 - x0, y1 - y0) == (16, 16)
    flat = crop.saliency(image, {"edge": 0.0, "saturation": 0.0, "skin": 0.0})
    assert flat.argmax() // 64 in (31, 32)
