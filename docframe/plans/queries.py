"""Registered queries of the document engine, each over a whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docframe.functions import counters as C
from docframe.functions import formats as FM
from docframe.functions import sheet as S
from docframe.functions import text as T
from docframe.operators import glyphs as G
from docframe.operators import grid, numbering, pivot, rules, style
from docframe.operators.boxes import Block, Cell, Run
from docframe.plans.registry import ORACLE_SQL, QUERIES, query, table
from docframe.sinks import csv as csv_sink
from docframe.sinks import markdown as md_sink
from docframe.sinks import workbook as workbook_sink
from docframe.sources import html as html_source

FORMAT_VALUES = ", ".join(f"('{n}', {i}, {o})" for n, (_, _, _, i, o) in FM.FORMATS.items())


@query(
    f"""
    WITH f(name, i, o) AS (VALUES {FORMAT_VALUES})
    SELECT a.name AS from_format, b.name AS to_format,
           CASE WHEN NOT a.i THEN 'input' WHEN NOT b.o THEN 'output' WHEN a.name = b.name THEN 'same' ELSE 'ok' END AS verdict
    FROM f a CROSS JOIN f b
    """
)
def format_matrix(spark, sf_dir):
    return FM.conversion(FM.dimension(spark))


EXT_VALUES = ", ".join(f"('{e}', '{n}')" for n, (_, exts, *_) in FM.FORMATS.items() for e in exts)


@query(
    f"""
    WITH e(ext, fmt) AS (VALUES {EXT_VALUES}), p AS (
      SELECT page_id, url || CASE CAST(page_id % 5 AS INTEGER) WHEN 0 THEN '/index.HTML' WHEN 1 THEN '/a.tar.Md' WHEN 2 THEN '/x.pdf' WHEN 3 THEN '/noext' ELSE '/t.tab' END AS path FROM pages)
    SELECT page_id, path, fmt AS format FROM p LEFT JOIN e ON e.ext = lower(regexp_extract(path, '\\.([^./]*)$', 1))
    """
)
def detect_from_url(spark, sf_dir):
    m = F.col("page_id") % 5
    ending = F.when(m == 0, "/index.HTML").when(m == 1, "/a.tar.Md").when(m == 2, "/x.pdf").when(m == 3, "/noext").otherwise("/t.tab")
    own = table(spark, sf_dir, "pages").select("page_id", F.concat("url", ending).alias("path"))
    return own.withColumn("format", FM.format_of_path(F.col("path")))


MIME_VALUES = ", ".join(f"('{m}', '{n}')" for m, n in ({v[2]: k for k, v in FM.FORMATS.items()} | FM.MORE_MEDIA).items())


@query(
    f"""
    WITH m(mime, fmt) AS (VALUES {MIME_VALUES}), e AS (
      SELECT event_id, CASE CAST(event_id % 7 AS INTEGER) WHEN 0 THEN 'Text/HTML; charset=utf-8' WHEN 1 THEN 'application/zip' WHEN 2 THEN 'text/x-unknown' WHEN 3 THEN 'image/JPG'
             WHEN 4 THEN 'application/pdf' WHEN 5 THEN 'video/mp4' ELSE ' application/csv ' END AS mime FROM events), k AS (SELECT event_id, mime, lower(trim(split_part(mime, ';', 1))) AS kind FROM e)
    SELECT event_id, k.mime, coalesce(fmt, CASE WHEN starts_with(kind, 'text/') THEN 'text' END) AS format FROM k LEFT JOIN m ON m.mime = kind
    """
)
def detect_from_mime(spark, sf_dir):
    kinds = ["Text/HTML; charset=utf-8", "application/zip", "text/x-unknown", "image/JPG", "application/pdf", "video/mp4", " application/csv "]
    mime = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", mime.alias("mime")).withColumn("format", FM.format_of_media_type(F.col("mime")))


SNIFF = r"(?i)^\x{FEFF}?[\t\n\f\r ]*(?:<!--|<\?xml|<(?:" + "|".join(FM.SNIFFED_TAGS) + r")[ \t\n\f\r>])"


@query(
    rf"""
    SELECT 'page' AS kind, page_id AS id, regexp_matches(html, '{SNIFF}') AS is_html FROM pages
    UNION ALL SELECT 'document', doc_id, regexp_matches(text, '{SNIFF}') FROM documents
    """
)
def sniff_html(spark, sf_dir):
    a = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), FM.looks_like_html(F.col("html")).alias("is_html"))
    return a.unionByName(table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), FM.looks_like_html(F.col("text")).alias("is_html")))


@query(
    r"""
    SELECT doc_id, regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g') AS boxed, regexp_replace(text, '[ \t\r\f]+', ' ', 'g') AS lined,
           trim(regexp_replace(text, '[\s\x{A0}\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}]+', ' ', 'g'), ' ') AS inlined
    FROM documents
    """
)
def collapse_ws(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_box(t).alias("boxed"), T.collapse_keep_lines(t).alias("lined"), T.collapse_inline(t).alias("inlined"))


@query(
    r"""
    SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html,
           regexp_replace(text, '([\\`*_\[\]])', '\\\1', 'g') AS markdown, replace(replace(replace(text, ' ', '%20'), '(', '%28'), ')', '%29') AS url
    FROM documents
    """
)
def escapes(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.escape_html(t).alias("html"), T.escape_markdown(t).alias("markdown"), T.escape_url(t).alias("url"))


@query(
    """
    WITH c AS (SELECT doc_id, text, encode(text) AS b FROM documents), n AS (
      SELECT doc_id, list_sum([CASE WHEN p <= 100 THEN 1 ELSE 0 END FOR p IN list_transform(range(1, least(length(text), 100) + 1), lambda i: octet_length(encode(substr(text, 1, CAST(i AS INTEGER)))))]) AS k, text FROM c)
    SELECT doc_id, substr(text, 1, CAST(coalesce(k, 0) AS INTEGER)) AS head FROM n
    """
)
def utf8_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_bytes(F.col("text"), 100).alias("head"))


def document_lines(spark, sf_dir):
    lines = F.posexplode(F.split(F.col("text"), "\n"))
    return table(spark, sf_dir, "documents").select("doc_id", lines.alias("line", "content"))


LINES_SQL = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents)"""


@query(
    rf"""
    WITH {LINES_SQL}, w AS (SELECT doc_id, line, regexp_extract(trim(content), '^(\S+)', 1) AS word FROM lines),
    m AS (SELECT doc_id, CAST(line AS BIGINT) AS line, CASE WHEN regexp_matches(word, '^[•‣·◦▪●–—*\-]') THEN substr(word, 1, 1) WHEN regexp_matches(word, '^(?:[0-9]+|[A-Za-z]|[ivxlcdmIVXLCDM]+)[.)]$') THEN word END AS marker FROM w)
    SELECT doc_id, line, marker, regexp_matches(marker, '[.)]$') AS ordered FROM m WHERE marker IS NOT NULL
    """
)
def list_markers(spark, sf_dir):
    own = document_lines(spark, sf_dir).withColumn("m", T.list_marker(F.col("content"))).where("m is not null")
    return own.select("doc_id", F.col("line").cast("long").alias("line"), "m.marker", "m.ordered")


@query(
    f"""
    WITH {LINES_SQL}, s AS (SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(length(content) AS DOUBLE) AS size FROM lines), b AS (SELECT doc_id, median(size) AS body FROM s WHERE size > 0 GROUP BY doc_id)
    SELECT s.doc_id, line, CAST(CASE WHEN size/body >= 2.0 THEN 1 WHEN size/body >= 1.6 THEN 2 WHEN size/body >= 1.4 THEN 3 WHEN size/body >= 1.25 THEN 4 ELSE 5 END AS INTEGER) AS level
    FROM s JOIN b ON s.doc_id = b.doc_id WHERE size > 0 AND size / body >= 1.15
    """
)
def heading_levels(spark, sf_dir):
    own = document_lines(spark, sf_dir).select("doc_id", F.col("line").cast("long").alias("line"), F.length("content").cast("double").alias("size"))
    body = own.where("size > 0").groupBy("doc_id").agg(F.median("size").alias("body"))
    out = own.join(body, "doc_id").withColumn("level", T.heading_level(F.col("size"), F.col("body")))
    return out.where("level is not null").select("doc_id", "line", "level")


@query(
    rf"""
    WITH {LINES_SQL}, f AS (SELECT doc_id, line, content, content = '' AS blank, CASE WHEN (content = '') IS DISTINCT FROM lag(content = '') OVER w THEN 1 ELSE 0 END AS new FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line) AS island FROM f)
    SELECT doc_id, min(line) AS first_line, count(*) AS n_lines, sum(length(content))::BIGINT AS n_chars FROM g WHERE NOT blank GROUP BY doc_id, island
    """
)
def line_blocks(spark, sf_dir):
    own = rules.islands(document_lines(spark, sf_dir), F.col("content") == "", ["doc_id"], "line").where("content <> ''")
    return own.groupBy("doc_id", "island").agg(F.min("line").cast("long").alias("first_line"), F.count("*").alias("n_lines"), F.sum(F.length("content")).cast("long").alias("n_chars")).drop("island")


A1_SQL = "CASE WHEN n > 702 THEN chr(CAST(65 + ((n - 703) // 676) % 26 AS INTEGER)) ELSE '' END || CASE WHEN n > 26 THEN chr(CAST(65 + ((n - 27) // 26) % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INTEGER))"


@query(
    f"""
    WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey % 18000 + 1 AS n FROM lineitem)
    SELECT l_orderkey, l_linenumber, {A1_SQL} || CAST(l_orderkey + 1 AS VARCHAR) AS ref, l_orderkey + 1 AS row, n AS col FROM c
    """
)
def a1_refs(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem")
    ref = S.cell_ref(F.col("l_orderkey") + 1, F.col("l_partkey") % 18000 + 1)
    return own.select("l_orderkey", "l_linenumber", ref.alias("ref")).withColumn("p", S.parse_ref(F.col("ref"))).select("l_orderkey", "l_linenumber", "ref", "p.row", "p.col")


@query(
    """
    SELECT o_orderkey, round(epoch(o_orderdate - TIMESTAMP '1899-12-30') / 86400, 6) AS serial, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS shown,
           strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day
    FROM orders
    """
)
def excel_serial(spark, sf_dir):
    no = F.lit(False)
    own = table(spark, sf_dir, "orders").select("o_orderkey", S.time_to_serial(F.col("o_orderdate"), no).alias("serial"))
    return own.select("o_orderkey", F.round("serial", 6).alias("serial"), S.format_serial(F.col("serial"), F.lit("m/d/yy h:mm"), no).alias("shown"), S.format_serial(F.col("serial"), F.lit("yyyy\\-mm\\-dd"), no).alias("day"))


@query(
    """
    WITH c AS (SELECT event_id, CASE CAST(event_id % 6 AS INTEGER) WHEN 0 THEN 's' WHEN 1 THEN 'str' WHEN 2 THEN 'b' WHEN 3 THEN 'e' ELSE '' END AS t,
                      CASE CAST(event_id % 6 AS INTEGER) WHEN 2 THEN CAST(event_id % 2 AS VARCHAR) WHEN 4 THEN CAST(event_id % 1000 AS VARCHAR) WHEN 5 THEN CASE WHEN event_id % 4 = 1 THEN ' ' ELSE 'x1' END ELSE event_type END AS raw,
                      CASE WHEN event_id % 12 = 4 THEN 'yyyy-mm-dd' ELSE '0.00' END AS code, event_type FROM events)
    SELECT event_id, CASE WHEN t IN ('s', 'str') THEN 'string' WHEN t = 'b' THEN 'bool' WHEN t = 'e' THEN 'error' WHEN trim(raw) = '' THEN 'empty' WHEN try_cast(raw AS DOUBLE) IS NULL THEN 'string' WHEN code = '0.00' THEN 'number' ELSE 'date' END AS kind,
           CASE WHEN t IN ('s', 'str', 'e') THEN raw WHEN t = '' AND trim(raw) <> '' AND try_cast(raw AS DOUBLE) IS NULL THEN raw END AS s,
           CASE WHEN t = '' THEN try_cast(raw AS DOUBLE) END AS f, CASE WHEN t = 'b' THEN raw = '1' END AS b,
           CASE WHEN t = '' AND code <> '0.00' AND try_cast(raw AS DOUBLE) IS NOT NULL THEN strftime(DATE '1899-12-30' + CAST(CAST(raw AS DOUBLE) AS INTEGER), '%Y-%m-%d') END AS day
    FROM c
    """
)
def typed_values(spark, sf_dir):
    m = F.col("event_id") % 6
    kind = F.when(m == 0, "s").when(m == 1, "str").when(m == 2, "b").when(m == 3, "e").otherwise("")
    raw = F.when(m == 2, (F.col("event_id") % 2).cast("string")).when(m == 4, (F.col("event_id") % 1000).cast("string")).when(m == 5, F.when(F.col("event_id") % 4 == 1, " ").otherwise("x1")).otherwise(F.col("event_type"))
    code = F.when(F.col("event_id") % 12 == 4, "yyyy-mm-dd").otherwise("0.00")
    own = table(spark, sf_dir, "events").select("event_id", S.typed_value(kind, raw, F.col("event_type"), code, F.lit(False)).alias("v"))
    return own.select("event_id", "v.kind", "v.s", "v.f", "v.b", F.date_format("v.t", "yyyy-MM-dd").alias("day"))


@query(
    """
    SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS n_f, count(*) FILTER (l_linestatus = 'O') AS n_o,
           round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS sum_f, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS sum_o
    FROM lineitem GROUP BY l_returnflag
    """
)
def pivot_sum(spark, sf_dir):
    out = pivot.pivot_wide(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus", ["F", "O"], [("count", "l_quantity"), ("sum", "l_quantity")])
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select("l_returnflag", n("F_count_l_quantity").alias("n_f"), n("O_count_l_quantity").alias("n_o"), F.round("F_sum_l_quantity", 2).alias("sum_f"), F.round("O_sum_l_quantity", 2).alias("sum_o"))


@query(
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS s, count(l_quantity) AS n, round(avg(l_quantity), 6) AS a, max(l_quantity) AS hi, min(l_quantity) AS lo,
           round(product(1 + l_discount / 1000), 6) AS p, count(l_quantity) AS nums, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 6) AS v, round(var_pop(l_quantity), 6) AS vp
    FROM lineitem GROUP BY ALL
    """
)
def pivot_all_aggs(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").withColumn("f", 1 + F.col("l_discount") / 1000)
    names = {"sum": "s", "count": "n", "average": "a", "max": "hi", "min": "lo", "product": "p", "countNums": "nums", "stdDev": "sd", "stdDevp": "sdp", "var": "v", "varp": "vp"}
    out = pivot.pivot_long(own, ["l_returnflag"], ["l_linestatus"], [(k, "f" if k == "product" else "l_quantity") for k in names], False, False)
    digits = {"s": 2, "a": 6, "p": 6, "sd": 6, "sdp": 6, "v": 6, "vp": 6}
    cols = [F.col(f"{k}_{'f' if k == 'product' else 'l_quantity'}") for k in names]
    return out.select("l_returnflag", "l_linestatus", *[(F.round(c, digits[n]) if n in digits else c).alias(n) for c, n in zip(cols, names.values())])


@query(
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS total, grouping(l_returnflag) = 1 AS grand_row, grouping(l_linestatus) = 1 AS grand_column
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())
    """
)
def pivot_grand_totals(spark, sf_dir):
    out = pivot.pivot_long(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_linestatus"], [("sum", "l_extendedprice")])
    return out.select("l_returnflag", "l_linestatus", F.round("sum_l_extendedprice", 2).alias("total"), "grand_row", "grand_column")


def order_cells(spark, sf_dir):
    """Each customer's orders as a table of three columns, without spans."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    own = table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w) - 1)
    return own.select(
        F.col("o_custkey").alias("doc_id"), F.lit(0).cast("long").alias("table_id"), F.floor(F.col("n") / 3).cast("int").alias("row"), (F.col("n") % 3).cast("int").alias("ord"),
        F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.lit(False).alias("header"), F.col("o_orderkey").cast("string").alias("text"),
    )


@query(
    """
    WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders)
    SELECT o_custkey AS doc_id, CAST(n // 3 AS INTEGER) AS row, string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY n) || repeat('|', CAST(least(3, any_value(c)) - count(*) AS INTEGER)) AS cells
    FROM n GROUP BY o_custkey, n // 3
    """
)
def grid_slots(spark, sf_dir):
    cells = grid.place_cells(order_cells(spark, sf_dir))
    return grid.dense(cells).select("doc_id", "row", F.array_join("values", "|").alias("cells"))


@query(
    """
    SELECT o_custkey AS doc_id, CAST(0 AS BIGINT) AS row0, count(*) AS slots, CAST(max((o_orderkey % 3) + 1) AS BIGINT) AS widest
    FROM (SELECT o_custkey, o_orderkey, unnest(range(CAST(o_orderkey % 3 AS BIGINT) + 1)) AS k FROM orders) GROUP BY o_custkey
    """
)
def grid_spans(spark, sf_dir):
    """One row a customer, an order spanning one to three columns."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    own = table(spark, sf_dir, "orders")
    cells = own.select(
        F.col("o_custkey").alias("doc_id"), F.lit(0).cast("long").alias("table_id"), F.lit(0).alias("row"), F.row_number().over(w).alias("ord"), F.lit(1).alias("rowspan"),
        (F.col("o_orderkey") % 3 + 1).cast("int").alias("colspan"), F.lit(False).alias("header"), F.col("o_orderkey").cast("string").alias("text"),
    )
    at = grid.slots(grid.place_cells(cells))
    return at.groupBy("doc_id").agg(F.min("slot_row").cast("long").alias("row0"), F.count("*").alias("slots"), F.max("colspan").cast("long").alias("widest"))


@query(
    """
    WITH v AS (SELECT p_partkey, CASE CAST(p_partkey % 4 AS INTEGER) WHEN 0 THEN p_name || ', "' || p_brand || '"' WHEN 1 THEN ' ' || p_type WHEN 2 THEN p_type || chr(10) || p_brand ELSE p_name END AS value FROM part)
    SELECT p_partkey, CASE WHEN contains(value, ',') OR contains(value, '"') OR contains(value, chr(10)) OR starts_with(value, ' ') THEN '"' || replace(value, '"', '""') || '"' ELSE value END AS quoted FROM v
    """
)
def csv_quote(spark, sf_dir):
    m = F.col("p_partkey") % 4
    value = F.when(m == 0, F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))).when(m == 1, F.concat(F.lit(" "), "p_type")).when(m == 2, F.concat("p_type", F.lit("\n"), "p_brand")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.quote_csv(value).alias("quoted"))


@query(
    """
    WITH r(priority, stop, lo) AS (VALUES (1, false, 45.0), (2, true, 30.0), (3, false, 10.0)),
    h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, priority, stop FROM lineitem JOIN r ON l_quantity >= lo)
    SELECT l_orderkey, l_linenumber, l_partkey, priority FROM h WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.l_orderkey = h.l_orderkey AND x.l_linenumber = h.l_linenumber AND x.l_partkey = h.l_partkey AND x.l_extendedprice = h.l_extendedprice AND x.stop AND x.priority < h.priority)
    """
)
def cf_winner(spark, sf_dir):
    formats = spark.createDataFrame([(1, False, 45.0), (2, True, 30.0), (3, False, 10.0)], "priority int, stop boolean, lo double")
    hits = table(spark, sf_dir, "lineitem").join(F.broadcast(formats), F.col("l_quantity") >= F.col("lo")).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "priority", "stop")
    return rules.conditional_winners(hits, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "priority")


@query(
    """
    WITH d AS (SELECT l_orderkey AS node_id, CAST(l_partkey % 4 AS INTEGER) AS prop, CAST(l_linenumber * 1000000 + l_partkey AS INTEGER) AS seq, CAST(l_suppkey % 3 AS INTEGER) AS origin, CAST(l_quantity % 2 AS INTEGER) AS classes, l_tax > 0.06 AS important, l_partkey % 11 = 0 AS inl, l_partkey FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY node_id, prop ORDER BY important DESC, CASE WHEN important THEN CASE WHEN origin = 0 THEN 4 ELSE 3 END WHEN inl THEN 3 ELSE origin END DESC, CASE WHEN inl THEN 1048576 ELSE 0 END DESC, classes DESC, seq DESC) AS k FROM d)
    SELECT node_id, prop, l_partkey AS value FROM r WHERE k = 1
    """
)
def cascade_winner(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(
        F.lit(0).cast("long").alias("doc_id"), F.col("l_orderkey").alias("node_id"), (F.col("l_partkey") % 4).cast("int").alias("prop"), F.col("l_partkey").alias("value"), (F.col("l_suppkey") % 3).cast("int").alias("origin"),
        F.lit(0).alias("ids"), (F.col("l_quantity") % 2).cast("int").alias("classes"), F.lit(0).alias("types"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).cast("int").alias("seq"), (F.col("l_tax") > 0.06).alias("important"), (F.col("l_partkey") % 11 == 0).alias("inline"),
    )
    return style.cascade(own).select("node_id", "prop", "value")


@query(
    """
    WITH p AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS lvl FROM conversations), q AS (
      SELECT *, CASE WHEN lvl = 1 THEN coalesce(max(CASE WHEN lvl = 0 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn), -1) ELSE -1 END AS run FROM p)
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, lvl, run ORDER BY turn) AS value FROM q
    """
)
def list_counter(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.lit(0).alias("num_id"), F.when(F.col("role") == "user", 0).otherwise(1).alias("ilvl"), F.lit(1).alias("start"))
    return numbering.counters(own).select(F.col("doc_id").alias("conv_id"), F.col("seq").alias("turn"), "value")


ROMAN_SQL = " || ".join(
    "[" + ", ".join(f"'{C.roman_digit(d, C.ROMAN[p])}'" for d in range(4 if p == 3 else 10)) + f"][CAST((n // {10**p}) % 10 AS INTEGER) + 1]" for p in (3, 2, 1, 0)
)


@query(
    f"""
    WITH c AS (SELECT p_partkey, p_partkey % 3999 + 1 AS n FROM part)
    SELECT p_partkey, {A1_SQL} AS alpha, {ROMAN_SQL} AS roman, CASE WHEN n < 10 THEN '0' || CAST(n AS VARCHAR) ELSE CAST(n AS VARCHAR) END AS padded FROM c
    """
)
def alpha_roman(spark, sf_dir):
    n = F.col("p_partkey") % 3999 + 1
    return table(spark, sf_dir, "part").select("p_partkey", *[C.format_counter(n, F.lit(style_name)).alias(name) for name, style_name in (("alpha", "upper-alpha"), ("roman", "upper-roman"), ("padded", "decimal-leading-zero"))])


@query("SELECT conv_id, turn, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations")
def split_sections(spark, sf_dir):
    return rules.sections(table(spark, sf_dir, "conversations"), F.col("role") == "user", ["conv_id"], "turn").select("conv_id", "turn", F.col("section").cast("long").alias("section"))


@query(
    """
    SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events
    """
)
def running_strings(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = table(spark, sf_dir, "events").withColumn("seq", F.row_number().over(w)).withColumn("v", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return rules.carried(own, ["user_id"], "seq", "v").select("event_id", "running")


@query(
    """
    WITH m AS (SELECT o_custkey, min(o_orderkey) AS lo, min(o_orderkey) + 5000 AS hi FROM orders GROUP BY o_custkey)
    SELECT o.o_orderkey FROM orders o JOIN m ON m.o_custkey = o.o_custkey WHERE NOT (o.o_orderkey BETWEEN lo AND hi) OR o.o_orderkey = lo
    """
)
def merge_coverage(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(0).alias("sheet"), F.col("o_orderkey").alias("r"), F.lit(0).alias("c"))
    merges = own.groupBy("doc_id", "sheet").agg(F.min("r").alias("r0")).select("doc_id", "sheet", "r0", F.lit(0).alias("c0"), (F.col("r0") + 5000).alias("r1"), F.lit(0).alias("c1"))
    return rules.uncovered(own, merges).select(F.col("r").alias("o_orderkey"))


@query(
    """
    WITH RECURSIVE v AS (SELECT DISTINCT l_orderkey AS g, l_quantity AS x FROM lineitem), s AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x) AS k FROM v),
    f(g, k, total, n, cluster) AS (SELECT g, k, x, CAST(1 AS BIGINT), CAST(0 AS BIGINT) FROM s WHERE k = 1
      UNION ALL SELECT s.g, s.k, CASE WHEN x - total / n <= 3 THEN total + x ELSE x END, CASE WHEN x - total / n <= 3 THEN n + 1 ELSE 1 END, CASE WHEN x - total / n <= 3 THEN cluster ELSE cluster + 1 END FROM f JOIN s ON s.g = f.g AND s.k = f.k + 1)
    SELECT g, cluster, round(max_by(total / n, k), 6) AS mean FROM f GROUP BY g, cluster
    """
)
def snap_lines(spark, sf_dir):
    """Quantities of each order snapped to clusters, as rule lines of a page are."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_quantity").alias("x")).distinct()
    out = own.groupBy("g").agg(G.snap(F.collect_list("x")).alias("means"))
    return out.select("g", F.posexplode("means").alias("cluster", "mean")).select("g", F.col("cluster").cast("long").alias("cluster"), F.round("mean", 6).alias("mean"))


def document_pages(spark, sf_dir):
    """Each document as a page of runs, one a line, set in one size: a character is 6 points wide, a line 12 points high."""
    lines = F.transform(F.split(F.col("text"), "\n"), lambda t, i: F.struct(
        t.alias("text"), F.array_repeat(F.lit(6.0), F.length(t)).alias("widths"), F.lit(0.0).alias("x"), (i * 12).cast("double").alias("y"), F.lit(10.0).alias("size"), F.lit(False).alias("bold"), F.lit(False).alias("italic")))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.lit(0).alias("page"), F.filter(lines, lambda r: r["text"] != "").alias("runs"))


@query(
    rf"""
    WITH {LINES_SQL}, w AS (SELECT doc_id, line, unnest([x FOR x IN string_split_regex(content, '[ \t]+') IF x <> '']) AS word FROM lines WHERE content <> '')
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n_words, CAST(count(DISTINCT line) AS BIGINT) AS n_lines, CAST(sum(length(word)) AS BIGINT) AS n_glyphs, min(word) AS first_word, max(word) AS last_word FROM w GROUP BY doc_id
    """
)
def glyph_words(spark, sf_dir):
    own = G.run_words(document_pages(spark, sf_dir))
    return own.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.countDistinct("line").alias("n_lines"), F.sum(F.length("text")).cast("long").alias("n_glyphs"), F.min("text").alias("first_word"), F.max("text").alias("last_word"))


@query(
    """
    WITH w AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, l_extendedprice + l_quantity * 100 AS x1 FROM lineitem),
    r AS (SELECT *, max(x1) OVER (PARTITION BY l_orderkey ORDER BY x, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w)
    SELECT l_orderkey, l_linenumber, CAST(sum(CASE WHEN x - reach >= 2500 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY x, l_linenumber) AS BIGINT) AS part FROM r
    """
)
def gutter_split(spark, sf_dir):
    """Lines of an order as words at their price, as wide as their quantity, on a page of 50,000."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("line"), F.col("l_linenumber").alias("word"), F.col("l_extendedprice").alias("x"), (F.col("l_extendedprice") + F.col("l_quantity") * 100).alias("x1"))
    out = G.gutter_split(own, F.lit(50_000.0))
    return out.select(F.col("doc_id").alias("l_orderkey"), F.col("word").alias("l_linenumber"), F.col("part").cast("long").alias("part"))


PAGE_VIEW = "p AS (SELECT page_id, html FROM pages)"


@query(f"WITH {PAGE_VIEW} SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '&amp;?', '&', 'g'), '&quot;', '\"', 'g'), '&lt;', '<', 'g'), '\\s+', ' ', 'g')) AS title FROM p")
def html_title(spark, sf_dir):
    nodes = html_source.nodes(table(spark, sf_dir, "pages"), "page_id", "html")
    title = nodes.where("tag = 'title'").select("doc_id", "node_id").alias("t")
    text = nodes.where("tag = '#text'").alias("x")
    out = title.join(text, (F.col("t.doc_id") == F.col("x.doc_id")) & (F.col("t.node_id") == F.col("x.parent_id")), "left")
    return out.select(F.col("t.doc_id").alias("page_id"), T.collapse_inline(F.coalesce("x.text", F.lit(""))).alias("title"))


@query(f"WITH {PAGE_VIEW}, l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM p) SELECT page_id, replace(href, '&amp;', '&') AS href, count(*) AS n FROM l GROUP BY ALL")
def html_links(spark, sf_dir):
    nodes = html_source.nodes(table(spark, sf_dir, "pages"), "page_id", "html")
    own = nodes.where("tag = 'a'").select(F.col("doc_id").alias("page_id"), F.element_at("attrs", F.lit("href")).alias("href")).where("href is not null")
    return own.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query()
def html_nodes(spark, sf_dir):
    nodes = html_source.nodes(table(spark, sf_dir, "pages"), "page_id", "html")
    return nodes.groupBy("doc_id", "tag").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


def written(spark, sf_dir, write, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([write(h) for h in batch.column(1).to_pylist()], pa.string())], ["page_id", name])

    return table(spark, sf_dir, "pages").select("page_id", "html").mapInArrow(run, f"page_id long, {name} string")


@query()
def html_markdown(spark, sf_dir):
    return written(spark, sf_dir, md_sink.to_markdown, "markdown")


@query()
def html_text(spark, sf_dir):
    return written(spark, sf_dir, lambda h: md_sink.to_markdown(h, bare=True), "text")


@query()
def html_csv(spark, sf_dir):
    """Orders of each customer as a table, written as CSV."""
    own = order_cells(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row", "ord", "text"))).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([csv_sink.write([table_of(cells)]) for cells in batch.column(1).to_pylist()], pa.string())], ["doc_id", "csv"])

    return own.mapInArrow(run, "doc_id long, csv string")


def table_of(cells: list[dict]) -> Block:
    return Block("table", cells=[Cell(c["row"], c["ord"], 1, 1, False, "", [[Run(c["text"])]]) for c in cells])


ORACLE_SQL["html_csv"] = """
    WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders),
    r AS (SELECT o_custkey, n // 3 AS row, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY n) || repeat(',', CAST(least(3, any_value(c)) - count(*) AS INTEGER)) AS line FROM n GROUP BY o_custkey, n // 3)
    SELECT o_custkey AS doc_id, string_agg(line || chr(10), '' ORDER BY row) AS csv FROM r GROUP BY o_custkey
"""


@query(
    """
    SELECT p_partkey, 'A' || CAST(p_size + 1 AS VARCHAR) || '*$B$2+SUM(C' || CAST(p_size + 1 AS VARCHAR) || ':D9)' AS moved
    FROM part
    """
)
def formula_shift(spark, sf_dir):
    source = F.concat(F.lit("A"), F.col("p_size").cast("string"), F.lit("*$B$2+SUM(C"), F.col("p_size").cast("string"), F.lit(":D8)"))
    return table(spark, sf_dir, "part").select("p_partkey", S.shifted(source, F.lit(1), F.lit(0)).alias("moved"))


@query("SELECT doc_id, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def doc_join_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source", "quality", "toxic")


def round_trip(target: str):
    """Pages to a format and back: whether both ways to Markdown agree, and where not, what differs first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from docframe.operators.convert import convert_one

        def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                same = []
                for source in batch.column(1).to_pylist():
                    data = (source or "").encode()
                    direct, (packed, error) = convert_one("html", "markdown", data)[0], convert_one("html", target, data)
                    same.append(error is None and convert_one(target, "markdown", packed)[0] == direct)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.bool_())], ["page_id", "same"])

        return table(spark, sf_dir, "pages").select("page_id", "html").mapInArrow(both, "page_id long, same boolean")

    return run


for _target in ("docx", "rtf", "epub"):
    QUERIES[f"{_target}_round_trip"] = round_trip(_target)
    ORACLE_SQL[f"{_target}_round_trip"] = "SELECT page_id, true AS same FROM pages"


@query(
    """
    WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)
    SELECT o_custkey AS doc_id, CAST(n // 3 AS INTEGER) AS row, CAST(n % 3 AS INTEGER) AS col, 'number' AS kind, CAST(o_orderkey AS VARCHAR) AS text, CAST(o_orderkey AS DOUBLE) AS number FROM n
    """
)
def workbook_cells(spark, sf_dir):
    """Each customer's orders written as a workbook, read again as typed cells."""
    from docframe.sources import workbook

    own = order_cells(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row", "ord", "text"))).alias("cells"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [workbook_sink.write([table_of(cells)]) for cells in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "content"])

    books = own.mapInArrow(write, "doc_id long, content binary")
    cells = workbook.cells(workbook.raw_cells(books, "doc_id", "content"))
    return cells.select("doc_id", "row", "col", "value.kind", "text", F.col("value.f").alias("number"))


@query()
def document_markdown(spark, sf_dir):
    """Documents' texts read as Markdown: the kinds of their blocks."""
    from docframe.operators.boxes import blocks_of
    from docframe.sources.html import Element, parse
    from docframe.sources.text import markdown_to_html

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [",".join(b.kind for b in blocks_of(parse(markdown_to_html(t or "")).find("body") or Element("body"))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string())], ["doc_id", "kinds"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, kinds string")


from docframe.plans import format_queries, layout_queries  # noqa: E402, F401  they register theirs
