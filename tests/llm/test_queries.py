"""The registered queries on the smallest tables: against DuckDB where SQL can express them, else their shape."""

import glob
import os
import re
import struct
import zlib
from collections import Counter
from html.parser import HTMLParser

import duckdb
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

import __spark_entry__
from docframe.llm import byte_bpe, queries

SF = __spark_entry__.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
COLUMNS = {
    "op1_html_extract": ["page_id", "url", "text", "n_chars"],
    "op2_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op4_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op6_simhash": ["doc_id", "fingerprint", "component_id"],
    "op7_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op8_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9_token_rollup": ["source", "lang", "tokenizer_version", "n_docs", "n_tokens"],
    "op10_language_id": ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.QUERIES[name](spark, SF)
    got = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, got.fetchall()))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_shape(spark, name):
    table = "pages" if name == "op1_html_extract" else "documents"
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name]
    if "doc_id" in df.columns or "page_id" in df.columns:
        ids = {r[0] for r in df.select(df.columns[0]).collect()}
        assert ids == {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(df.columns[0]).collect()}
    else:
        assert df.count() > 0


def rows(name, columns):
    return duckdb.sql(f"select {columns} from '{SF}/{name}.parquet'").fetchall()


def test_rollup_against_library(spark):
    """Totals after inserts, revisions, deletes and replays, of words and of the tiktoken library's ids."""
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path(queries.VOCABULARY)), special_tokens={})
    labels = rows("labels", "doc_id, quality, toxic")
    gone, marked = {i for i, q, _ in labels if q == 0}, {i for i, _, t in labels if t == 1}
    wanted = Counter()
    for i, text, source, lang in rows("documents", "doc_id, text, source, lang"):
        if i not in gone:
            for version, n in (("words", len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))), (queries.VOCABULARY, len(library.encode_ordinary(text or "")))):
                wanted[source, lang, version, "docs"] += 1
                wanted[source, lang, version, "tokens"] += n + (i in marked)
    got = Counter()
    for r in queries.QUERIES["op9_token_rollup"](spark, SF).collect():
        got[r.source, r.lang, r.tokenizer_version, "docs"] += r.n_docs
        got[r.source, r.lang, r.tokenizer_version, "tokens"] += r.n_tokens
    assert gone and marked and got == wanted


def test_simhash_against_all_pairs(spark):
    docs = rows("documents", "doc_id, text")
    fps = {}
    for i, text in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))] if words else []
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    least = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and least[a] < least[b]:
                    least[b], changed = least[a], True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op6_simhash"](spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", least[i]) for i in fps}


def test_packing_against_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path(queries.WORD_TOKENIZER))
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows("documents", "doc_id, text")}
    used, at = Counter(), {}
    for r in sorted(queries.QUERIES["op7_packing"](spark, SF).collect(), key=lambda r: (r.sequence_id, r.offset)):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *part)) and r.doc_tokens == len(ids[r.doc_id])
        used.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert set(used.values()) == {1} and len(used) == sum(map(len, ids.values()))
    assert all(n <= 2048 and (n == 2048 or n & (n - 1) == 0) for n in at.values())


class Plain(HTMLParser):
    """The blocks of a page's only article, by rules that hold for the tables' pages."""

    BLOCK = frozenset("article h1 h2 h3 p ul ol li div table tr td th pre blockquote figure figcaption section".split())
    GONE = frozenset("nav aside header footer form script style button select".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.gone, self.parts, self.blocks, self.open = 0, [], [], [], []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "input", "meta", "link", "hr"):
            self.parts.append("\n")
            return
        if tag in self.GONE or dict(attrs).get("class") in ("ad", "comments", "notice"):
            self.gone.append(tag)
        elif self.gone and tag == self.gone[-1]:
            self.gone.append(tag)
        if tag == "article":
            self.inside += 1
        if tag in self.BLOCK or tag in self.GONE:
            self.flush()

    def handle_endtag(self, tag):
        if tag in self.BLOCK or tag in self.GONE:
            self.flush()
        if self.gone and tag == self.gone[-1]:
            self.gone.pop()
        if tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside and not self.gone:
            self.parts.append(data)


def test_pages_against_plain_parser(spark):
    """Where a page has one article, its text is that of the article's blocks, by the standard library's parser."""
    got = {r.page_id: r.text for r in queries.QUERIES["op1_html_extract"](spark, SF).collect()}
    checked = 0
    for i, page in rows("pages", "page_id, html"):
        if page and len(re.findall("<article", page)) == 1:
            plain = Plain()
            plain.feed(page)
            plain.close()
            plain.flush()
            checked += 1
            assert got[i] == "\n\n".join(plain.blocks)
    assert checked >= len(got) / 2
