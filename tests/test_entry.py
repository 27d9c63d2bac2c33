"""Registered queries against DuckDB on the smallest tables."""

import glob
import math
import os
import re
from collections import Counter
from html.parser import HTMLParser

import duckdb
import pytest

import __spark_entry__
from docframe.plans import queries

SF = __spark_entry__.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in queries.ORACLE_SQL:
        assert rows
        return
    got = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    a = sorted([shown(r[df.columns.index(c)]) for c in order] for r in rows)
    assert a == sorted([shown(r[names.index(c)]) for c in order] for r in got.fetchall())


class Seen(HTMLParser):
    """Start tags as they stand, and what is shown as text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.text, self.mute = Counter(), [], 0

    def handle_starttag(self, tag, attrs):
        self.tags[tag] += 1
        self.mute += tag in ("title", "script", "style")

    def handle_endtag(self, tag):
        self.mute -= tag in ("title", "script", "style")

    def handle_data(self, data):
        if not self.mute:
            self.text.append(data)


def pages(duck):
    for page_id, source in duck.execute("select page_id, html from pages").fetchall():
        seen = Seen()
        seen.feed(source or "")
        seen.close()
        yield page_id, seen


def test_nodes_against_parser(spark, duck):
    """Every start tag of a page is a node, by the standard library's parser; a tree adds what is implied, and goes on with formatting."""
    got = Counter({(r.doc_id, r.tag): r.n for r in queries.QUERIES["html_nodes"](spark, SF).collect()})
    implied = {"html", "head", "body", "tbody", "b", "i", "a"}
    for page_id, seen in pages(duck):
        own = {tag: n for (i, tag), n in got.items() if i == page_id and not tag.startswith("#")}
        assert {t: n for t, n in own.items() if t not in implied} == {t: n for t, n in seen.tags.items() if t not in implied}
        assert all(own.get(t, 0) >= n for t, n in seen.tags.items())


@pytest.mark.parametrize("name", ["html_text", "html_markdown"])
def test_texts_against_parser(spark, duck, name):
    """What a page shows, letter by letter, is in the output in its order, and no other letters are but those of link targets and marks."""
    got = {r[0]: r[1] for r in queries.QUERIES[name](spark, SF).collect()}
    for page_id, seen in pages(duck):
        out = re.sub(r"\]\([^)]*\)", "]", got[page_id]) if name == "html_markdown" else got[page_id]
        letters = lambda t: re.sub(r"[\W\d_]+", "", t)
        assert letters(out) == letters("".join(seen.text))


def test_document_markdown_against_lines(spark, duck):
    """Texts without a sign that Markdown reads are one paragraph for each run of lines that are not blank."""
    got = {r.doc_id: r.kinds for r in queries.QUERIES["document_markdown"](spark, SF).collect()}
    checked = 0
    for doc_id, text in duck.execute("select doc_id, text from documents").fetchall():
        if re.fullmatch(r"[^\W\d_][^\d#>*+`~|<&\[\]\\=_-]*", text or "") and not re.search(r"\n[ \t]|^[ivxlcdmIVXLCDM]+[.)]|\n\w+[.)]", text):
            runs = len([r for r in re.split(r"\n\s*\n", text) if r.strip()])
            assert got[doc_id] == ",".join(["paragraph"] * runs), text[:200]
            checked += 1
    assert checked > 20


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
