"""Queries of styles, numbering, page geometry and cell rules, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docframe.functions import colour
from docframe.functions import page_functions as pages
from docframe.functions import text as T
from docframe.operators import crop, flow, glyphs, numbering, rules, style
from docframe.plans.registry import query, table


def order_tree(spark, sf_dir):
    """Each customer as a document: a div that holds its orders, p or li by parity, of their status as class and their key as id."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w)).withColumn("size", F.count("*").over(Window.partitionBy("o_custkey")))
    attrs = F.create_map(F.lit("class"), F.concat(F.lit("order "), F.lower("o_orderstatus")), F.lit("id"), F.concat(F.lit("o"), F.col("o_orderkey")))
    leaf = orders.select(
        F.col("o_custkey").alias("doc_id"), (F.col("n") + 1).cast("int").alias("node_id"), F.lit(1).alias("parent_id"), (2 * F.col("n")).cast("int").alias("pre"), (2 * F.col("n") + 1).cast("int").alias("post"), F.lit(1).alias("depth"),
        F.when(F.col("o_orderkey") % 2 == 0, "p").otherwise("li").alias("tag"), attrs.alias("attrs"), F.lit(None).cast("string").alias("text"),
    )
    root = orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.max("size").alias("size"))
    root = root.select("doc_id", F.lit(1).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(1).alias("pre"), (2 * F.col("size") + 2).cast("int").alias("post"), F.lit(0).alias("depth"), F.lit("div").alias("tag"), F.create_map(F.lit("class"), F.lit("list")).alias("attrs"), F.lit(None).cast("string").alias("text"))
    return root.unionByName(leaf)


TREE_SQL = """
    t AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS size, o_orderkey % 2 = 0 AS p, lower(o_orderstatus) AS c, o_orderkey AS k,
          row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) AS nt, count(*) OVER (PARTITION BY o_custkey, o_orderkey % 2) AS st FROM orders)"""


@query(
    f"""
    WITH {TREE_SQL}
    SELECT 'div.list .f:nth-child(2n+1)' AS selector, doc_id, CAST(n + 1 AS INTEGER) AS node_id FROM t WHERE c = 'f' AND n % 2 = 1
    UNION ALL SELECT 'p:nth-last-of-type(-n+2)', doc_id, n + 1 FROM t WHERE p AND st - nt + 1 <= 2
    UNION ALL SELECT 'li.o:first-child, p:only-of-type', doc_id, n + 1 FROM t WHERE (NOT p AND c = 'o' AND n = 1) OR (p AND st = 1)
    UNION ALL SELECT 'div:root #o7.order', doc_id, n + 1 FROM t WHERE k = 7
    UNION ALL SELECT 'p li, a:hover', doc_id, n + 1 FROM t WHERE false
    """
)
def selector_match(spark, sf_dir):
    nodes = order_tree(spark, sf_dir)
    selectors = ["div.list .f:nth-child(2n+1)", "p:nth-last-of-type(-n+2)", "li.o:first-child, p:only-of-type", "div:root #o7.order", "p li, a:hover"]
    out = None
    for s in selectors:
        own = style.selected(nodes, s).select(F.lit(s).alias("selector"), "doc_id", "node_id")
        out = own if out is None else out.unionByName(own)
    return out


SHEETS = [
    ("ua", "p { color: black; margin: 1px 2px } li { color: gray; display: list-item }"),
    ("author", ".order { color: teal } div .f { color: navy; padding: 3px } p.o:last-child { color: red !important } #o7 { color: lime } @media print { p { color: white } } p:nth-child(odd) { margin-left: 9px }"),
]


@query(
    f"""
    WITH {TREE_SQL}
    SELECT doc_id, CAST(n + 1 AS INTEGER) AS node_id, 'color' AS prop, CASE WHEN p AND c = 'o' AND n = size THEN 'red' WHEN k = 7 THEN 'lime' WHEN c = 'f' THEN 'navy' ELSE 'teal' END AS value FROM t
    UNION ALL SELECT doc_id, n + 1, 'display', 'list-item' FROM t WHERE NOT p
    UNION ALL SELECT doc_id, n + 1, 'margin-' || side, CASE WHEN side = 'left' AND n % 2 = 1 THEN '9px' WHEN side IN ('left', 'right') THEN '2px' ELSE '1px' END FROM t, (VALUES ('top'), ('right'), ('bottom'), ('left')) s(side) WHERE p
    UNION ALL SELECT doc_id, n + 1, 'padding-' || side, '3px' FROM t, (VALUES ('top'), ('right'), ('bottom'), ('left')) s(side) WHERE c = 'f'
    """
)
def style_cascade(spark, sf_dir):
    return style.apply_sheets(spark, order_tree(spark, sf_dir), SHEETS).select("doc_id", "node_id", "prop", "value")


@query(
    """
    WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role FROM conversations),
    h AS (SELECT conv_id, n, last_value(CASE WHEN role = 'user' THEN 'c' || CAST(n AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY n) AS color, CASE WHEN role = 'user' THEN 'w' || CAST(n AS VARCHAR) END AS width FROM t)
    SELECT conv_id, CAST(n AS INTEGER) AS node_id, 'color' AS prop, color AS value FROM h WHERE color IS NOT NULL
    UNION ALL SELECT conv_id, n, 'width', width FROM h WHERE width IS NOT NULL
    """
)
def style_inherit(spark, sf_dir):
    """A conversation as nested elements, a turn within the one before; users' turns set a colour, which passes on, and a width, which does not."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.row_number().over(w).alias("node_id"), F.count("*").over(Window.partitionBy("conv_id")).cast("int").alias("size"), "role")
    nodes = own.select("doc_id", "node_id", F.col("node_id").alias("pre"), (2 * F.col("size") + 1 - F.col("node_id")).alias("post"), F.col("node_id").alias("depth"))
    sets = own.where("role = 'user'")
    winners = None
    for prop in ("color", "width"):
        rows = sets.select("doc_id", "node_id", F.lit(prop).alias("prop"), F.concat(F.lit(prop[0]), F.col("node_id")).alias("value"))
        winners = rows if winners is None else winners.unionByName(rows)
    return style.inherit(nodes, winners).withColumnRenamed("doc_id", "conv_id")


@query(
    """
    WITH s AS (SELECT c_nationkey AS doc_id, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
    g AS (SELECT *, sum(CASE WHEN k % 40 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS chain FROM s)
    SELECT doc_id, CAST(c_custkey AS VARCHAR) AS style_id, last_value(CASE WHEN c_custkey % 37 = 0 THEN c_custkey END IGNORE NULLS) OVER w AS size, last_value(CASE WHEN k % 40 = 1 THEN 'base' || CAST(c_custkey AS VARCHAR) END IGNORE NULLS) OVER w AS font
    FROM g WINDOW w AS (PARTITION BY doc_id, chain ORDER BY k)
    """
)
def style_chain(spark, sf_dir):
    """Customers of a nation as styles, each based on the one before, in chains of forty."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    own = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), "c_custkey", F.row_number().over(w).alias("k"), F.lag("c_custkey").over(w).alias("before"))
    name = F.col("c_custkey").cast("string")
    styles = own.select(
        "doc_id", name.alias("style_id"), F.when(F.col("k") % 40 != 1, F.col("before").cast("string")).alias("based_on"),
        F.when(F.col("c_custkey") % 37 == 0, F.col("c_custkey")).alias("size"), F.when(F.col("k") % 40 == 1, F.concat(F.lit("base"), name)).alias("font"),
    )
    return numbering.style_chain(styles, ["size", "font"])


@query(
    """
    WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, o_orderkey % 3 = 0 AS go FROM orders),
    c AS (SELECT o_custkey AS doc_id, CAST(k // 2 AS INTEGER) AS row, CAST(k % 2 AS INTEGER) AS col, go FROM n),
    o AS (SELECT *, max(CASE WHEN NOT go THEN row END) OVER (PARTITION BY doc_id, col ORDER BY row) AS owner FROM c)
    SELECT doc_id, owner AS row, col, CAST(count(*) AS INTEGER) AS row_span FROM o WHERE owner IS NOT NULL GROUP BY ALL
    """
)
def row_spans(spark, sf_dir):
    """Each customer's orders in two columns; one in three goes on the cell above."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    own = table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w) - 1)
    cells = own.select(
        F.col("o_custkey").alias("doc_id"), F.lit(0).alias("table_id"), F.floor(F.col("k") / 2).cast("int").alias("row"), (F.col("k") % 2).cast("int").alias("ord"), F.lit(1).alias("span"),
        F.when(F.col("o_orderkey") % 3 == 0, "continue").otherwise("restart").alias("merge"),
    )
    return numbering.row_spans(cells).where("merge = 'restart'").select("doc_id", "row", "col", "row_span")


@query(
    """
    WITH p AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS lvl FROM conversations), q AS (
      SELECT *, CASE WHEN lvl = 1 THEN coalesce(max(CASE WHEN lvl = 0 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn), -1) ELSE -1 END AS run FROM p),
    v AS (SELECT conv_id, turn, lvl, row_number() OVER (PARTITION BY conv_id, lvl, run ORDER BY turn) AS n FROM q)
    SELECT conv_id, turn, CASE WHEN lvl = 0 THEN 'Part ' || CAST(n AS VARCHAR) || ': ' ELSE '(' || chr(CAST(96 + n AS INTEGER)) || ') ' END AS marker FROM v
    """
)
def numbering_markers(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.lit(0).alias("num_id"), F.when(F.col("role") == "user", 0).otherwise(1).alias("ilvl"), F.lit(1).alias("start"))
    first = F.col("ilvl") == 0
    counted = numbering.counters(own).withColumn("fmt", F.when(first, "decimal").otherwise("lowerLetter")).withColumn("lvl_text", F.when(first, "Part %1:").otherwise("(%2)"))
    return numbering.markers(counted).select(F.col("doc_id").alias("conv_id"), F.col("seq").alias("turn"), "marker")


@query(
    """
    WITH p AS (SELECT p_partkey, CAST(p_size AS INTEGER) AS n, CASE CAST(p_partkey % 4 AS INTEGER) WHEN 0 THEN 'all' WHEN 1 THEN '2-4, 9' WHEN 2 THEN CAST(p_size // 2 + 1 AS VARCHAR) || '-' || CAST(p_size + 3 AS VARCHAR) ELSE '5,1,5' END AS spec FROM part),
    e AS (SELECT p_partkey, n, spec, unnest(range(1, n + 1)) AS page FROM p)
    SELECT p.p_partkey, p.spec, coalesce(string_agg(CAST(page AS VARCHAR), ' ' ORDER BY page) FILTER (
      WHERE p.spec = 'all' OR (p.p_partkey % 4 = 1 AND (page BETWEEN 2 AND 4 OR page = 9)) OR (p.p_partkey % 4 = 2 AND page >= p.n // 2 + 1) OR (p.p_partkey % 4 = 3 AND page IN (1, 5))), '') AS pages
    FROM p LEFT JOIN e ON e.p_partkey = p.p_partkey GROUP BY p.p_partkey, p.spec
    """
)
def page_ranges(spark, sf_dir):
    m, half = F.col("p_partkey") % 4, F.floor(F.col("p_size") / 2) + 1
    spec = F.when(m == 0, "all").when(m == 1, "2-4, 9").when(m == 2, F.concat(half.cast("string"), F.lit("-"), (F.col("p_size") + 3).cast("string"))).otherwise("5,1,5")
    own = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("int").alias("n"), spec.alias("spec"))
    return own.select("p_partkey", "spec", F.array_join(F.transform(rules.page_numbers(F.col("spec"), F.col("n")), lambda p: p.cast("string")), " ").alias("pages"))


@query(
    """
    WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_partkey % 700 + 100 END AS DOUBLE) AS w, CAST(CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_suppkey % 500 + 50 END AS DOUBLE) AS h,
                      612.0::DOUBLE AS pw, l_extendedprice / 100 + 50 AS ph, CAST(CASE WHEN l_partkey % 2 = 0 THEN 72 ELSE 0 END AS DOUBLE) AS dpi FROM lineitem),
    s0 AS (SELECT *, least(CASE WHEN w > 0 THEN w / pw END, CASE WHEN h > 0 THEN h / ph END, CASE WHEN dpi > 0 THEN dpi / 72 END) AS s FROM p)
    SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN w > 0 OR h > 0 THEN s * 72 WHEN dpi > 0 THEN dpi ELSE 150 END, 6) AS dpi, NOT (w > 0 AND ceil(pw * s) > w + 1) AND NOT (h > 0 AND ceil(ph * s) > h + 1) AS inside FROM s0
    """
)
def page_fit(spark, sf_dir):
    """Pages as wide as a letter fitted to boxes; `inside`: rounded-up pixels stay within them."""
    w = F.when(F.col("l_linenumber") % 3 == 0, 0).otherwise(F.col("l_partkey") % 700 + 100).cast("double")
    h = F.when(F.col("l_linenumber") % 4 == 0, 0).otherwise(F.col("l_suppkey") % 500 + 50).cast("double")
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", w.alias("w"), h.alias("h"), F.lit(612.0).alias("pw"), (F.col("l_extendedprice") / 100 + 50).alias("ph"), F.when(F.col("l_partkey") % 2 == 0, 72.0).otherwise(0.0).alias("most"))
    own = own.withColumn("dpi", rules.fit_scale(F.col("w"), F.col("h"), F.col("pw"), F.col("ph"), F.col("most")))
    free = (F.col("w") <= 0) & (F.col("h") <= 0)
    fits = ((F.col("w") <= 0) | (F.ceil(F.col("pw") * F.col("dpi") / 72) <= F.col("w") + 1)) & ((F.col("h") <= 0) | (F.ceil(F.col("ph") * F.col("dpi") / 72) <= F.col("h") + 1))
    return own.select("l_orderkey", "l_linenumber", "l_partkey", F.round("dpi", 6).alias("dpi"), (free | fits).alias("inside"))


@query(
    """
    WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey % 900 + 10 AS INTEGER) AS w, CAST(l_suppkey % 700 + 10 AS INTEGER) AS h, CAST(l_linenumber AS INTEGER) AS a, 3 AS b, ['center', 'north', 'south', 'east', 'west'][CAST(l_partkey % 5 AS INTEGER) + 1] AS g FROM lineitem),
    f AS (SELECT *, greatest(1, least(w, CASE WHEN w * b > a * h THEN h * a // b ELSE w END)) AS x, greatest(1, least(h, CASE WHEN w * b > a * h THEN h ELSE w * b // a END)) AS y FROM p),
    o AS (SELECT *, CASE g WHEN 'west' THEN 0 WHEN 'east' THEN w - x ELSE (w - x) // 2 END AS x0, CASE g WHEN 'north' THEN 0 WHEN 'south' THEN h - y ELSE (h - y) // 2 END AS y0 FROM f)
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(x0 AS INTEGER) AS x0, CAST(y0 AS INTEGER) AS y0, CAST(x0 + x AS INTEGER) AS x1, CAST(y0 + y AS INTEGER) AS y1 FROM o
    """
)
def crop_windows(spark, sf_dir):
    w, h = (F.col("l_partkey") % 900 + 10).cast("int"), (F.col("l_suppkey") % 700 + 10).cast("int")
    gravity = F.element_at(F.array(*[F.lit(g) for g in ("center", "north", "south", "east", "west")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    at = crop.anchor(w, h, crop.fit_window(w, h, F.col("l_linenumber").cast("int"), F.lit(3)), gravity)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", at.alias("at")).select("l_orderkey", "l_linenumber", "l_partkey", "at.x0", "at.y0", "at.x1", "at.y1")


def columned_lines(spark, sf_dir):
    """Lines of an order on a page of 612: in columns at 0 and 300 by parity, 14 points apart."""
    own = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    x = F.when(F.col("n") % 2 == 0, 300.0).otherwise(0.0)
    return own.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.col("n").cast("int").alias("line"), x.alias("x"), (x + 100).alias("x1"), (F.col("n") * 14.0).alias("y"), F.lit(10.0).alias("size"), F.lit(612.0).alias("width"))


@query(
    """
    WITH n AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)
    SELECT doc_id, CAST(n AS INTEGER) AS line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n % 2 DESC, n) - 1 AS INTEGER) AS reading_seq FROM n
    """
)
def reading_order(spark, sf_dir):
    return glyphs.reading_order(columned_lines(spark, sf_dir)).select("doc_id", "line", "reading_seq")


@query(
    """
    WITH w AS (SELECT conv_id, turn, CAST(turn AS DOUBLE) AS x, role <> 'user' AS rtl FROM conversations),
    r AS (SELECT *, CASE WHEN rtl IS DISTINCT FROM lag(rtl) OVER (PARTITION BY conv_id ORDER BY x) THEN 1 ELSE 0 END AS new FROM w), i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY x) AS run FROM r)
    SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY run, CASE WHEN rtl THEN -x ELSE x END) AS INTEGER) AS logical_seq,
           CASE WHEN rtl THEN reverse('אב' || CAST(turn AS VARCHAR)) ELSE 'w' || CAST(turn AS VARCHAR) END AS text FROM i
    """
)
def rtl_order(spark, sf_dir):
    rtl = F.col("role") != "user"
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("line"), "turn", F.col("turn").cast("double").alias("x"), F.concat(F.when(rtl, "אב").otherwise("w"), F.col("turn").cast("string")).alias("text"))
    return glyphs.reorder_rtl(own).select(F.col("doc_id").alias("conv_id"), "turn", F.col("logical_seq").cast("int").alias("logical_seq"), "text")


def table_words(spark, sf_dir):
    """Lines of an order as rows of three columns without rules: the part at 0, the supplier at 200, the quantity at 400."""
    own = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    cells = F.array(*[F.struct(F.lit(x).alias("x"), F.concat(F.lit(p), F.col(c).cast("bigint").cast("string")).alias("text")) for x, p, c in ((0.0, "p", "l_partkey"), (200.0, "s", "l_suppkey"), (400.0, "q", "l_quantity"))])
    words = own.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.col("n").cast("int").alias("line"), F.posexplode(cells).alias("word", "c"))
    return words.select("doc_id", "page", "line", "word", "c.text", "c.x", (F.col("c.x") + 60).alias("x1"), (F.col("line") * 20.0).alias("y"), F.lit(10.0).alias("size"))


ROWS_SQL = """n AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, count(*) OVER (PARTITION BY l_orderkey) AS size,
      ['p' || CAST(CAST(l_partkey AS BIGINT) AS VARCHAR), 's' || CAST(CAST(l_suppkey AS BIGINT) AS VARCHAR), 'q' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)] AS v FROM lineitem)"""


@query(f"WITH {ROWS_SQL} SELECT doc_id, CAST(n - 1 AS INTEGER) AS row, CAST(c AS INTEGER) AS col, v[c + 1] AS text FROM n, (VALUES (0), (1), (2)) k(c) WHERE size >= 3")
def stream_tables(spark, sf_dir):
    return glyphs.stream_cells(table_words(spark, sf_dir)).select("doc_id", "row", "col", "text")


@query(f"WITH {ROWS_SQL} SELECT doc_id, CAST(n - 1 AS INTEGER) AS row, CAST(c AS INTEGER) AS col, v[c + 1] AS text FROM n, (VALUES (0), (1), (2)) k(c) WHERE size >= 2")
def ruled_tables(spark, sf_dir):
    """The same words within rules; the outer ones stand up to three points inside of them."""
    words = table_words(spark, sf_dir)
    rows = words.groupBy("doc_id", "page").agg(F.max("line").alias("last"))
    across = rows.select("doc_id", "page", F.lit(True).alias("horizontal"), F.explode(F.transform(F.sequence(F.lit(0), "last"), lambda k: F.when(k == F.col("last"), k * 20.0 + 7.5).otherwise(k * 20.0 + 10))).alias("a"), F.lit(0.0).alias("b0"), F.lit(460.0).alias("b1"))
    down = rows.select("doc_id", "page", F.lit(False).alias("horizontal"), F.explode(F.array(*[F.lit(x) for x in (-5.0, 130.0, 330.0, 500.0)])).alias("a"), F.lit(0.0).alias("b0"), (F.col("last") * 20.0 + 10).alias("b1"))
    moved = words.withColumn("y", F.when(F.col("line") == 1, 8.0).otherwise(F.col("y")))
    return glyphs.ruled_cells(across.unionByName(down).where("a is not null"), moved).where("doc_id is not null").select("doc_id", "row", "col", "text")


@query(
    """
    WITH l AS (SELECT conv_id AS doc_id, turn AS line, CASE WHEN turn % 5 = 4 THEN 20.0 ELSE 10.0 END AS size, turn * 12.0 + (turn // 3) * 12.0 AS y FROM conversations),
    b AS (SELECT doc_id, quantile_cont(size, 0.5) AS body FROM l GROUP BY doc_id),
    f AS (SELECT l.*, CASE WHEN lag(y) OVER w IS NULL OR y - lag(y) OVER w > 1.6 * greatest(size, lag(size) OVER w) OR (size >= 1.15 * body) IS DISTINCT FROM (lag(size) OVER w >= 1.15 * body) THEN 1 ELSE 0 END AS new FROM l JOIN b USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY y, line))
    SELECT doc_id, line, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY y, line) AS INTEGER) AS para FROM f
    """
)
def paragraph_groups(spark, sf_dir):
    """Turns as lines of a page, three by three with a gap between, every fifth one large."""
    turn = F.col("turn")
    size = F.when(turn % 5 == 4, 20.0).otherwise(10.0)
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("page"), turn.alias("line"), (turn * 12.0 + F.floor(turn / 3) * 12.0).alias("y"), size.alias("size"), F.lit("words").alias("text"), F.lit(1).alias("n_words"))
    return glyphs.paragraphs(own).select("doc_id", "line", F.col("para").cast("int").alias("para"))


@query(
    """
    SELECT event_id, upper(event_type) AS upper, lower(event_type || 'X') AS lower, regexp_replace(regexp_replace(chr(65279) || event_type || chr(13) || chr(10) || 'b' || chr(13) || 'c', '^' || chr(65279), ''), chr(13) || chr(10) || '?|' || chr(13), chr(10), 'g') AS lined,
           event_id % 6 IN (0, 1, 2, 5) AS collapses, event_id % 6 IN (2, 3, 4) AS keeps, event_id % 6 NOT IN (1, 3) AS wraps
    FROM events
    """
)
def text_modes(spark, sf_dir):
    mode = F.element_at(F.array(*[F.lit(m) for m in ("normal", "nowrap", "pre-line", "pre", "pre-wrap", "odd")]), (F.col("event_id") % 6 + 1).cast("int"))
    t = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", T.transform_case(t, F.lit("uppercase")).alias("upper"), T.transform_case(F.concat(t, F.lit("X")), F.lit("lowercase")).alias("lower"),
        T.normalise_lines(F.concat(F.lit("\ufeff"), t, F.lit("\r\nb\rc"))).alias("lined"),
        *[T.white_space_flag(mode, k).alias(n) for k, n in enumerate(("collapses", "keeps", "wraps"))],
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, printf('%02x%02x%02x', CAST(floor((1 - l_discount * 4) * (1 - l_tax) * 255 + 0.5) AS INTEGER) * (CASE WHEN l_discount * 4 > 1 THEN 0 ELSE 1 END), CAST(floor((1 - l_tax) * 255 + 0.5) AS INTEGER), CAST(floor((1 - l_tax) * (1 - l_tax) * 255 + 0.5) AS INTEGER)) AS inks,
           printf('%02x%02x%02x', CAST(floor(least(l_quantity / 40, 1) * 255 + 0.5) AS INTEGER), CAST(floor(least(l_quantity / 40, 1) * 255 + 0.5) AS INTEGER), CAST(floor(least(l_quantity / 40, 1) * 255 + 0.5) AS INTEGER)) AS grays
    FROM lineitem
    """
)
def colours(spark, sf_dir):
    tax = F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", colour.hex_of(colour.cmyk(F.col("l_discount") * 4, F.lit(0.0), tax, tax)).alias("inks"), colour.hex_of(colour.gray(F.col("l_quantity") / 40)).alias("grays"))


@query(
    """
    WITH b AS (SELECT l_orderkey, row_number() OVER w AS seq, CASE WHEN l_partkey % 4 <> 0 THEN CAST(l_suppkey % 5 - 2 AS INTEGER) END AS z FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
    SELECT l_orderkey, seq, CAST(sign(coalesce(z, 0)) AS INTEGER) AS band, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(z, 0), seq) AS paint FROM b
    """
)
def paint_order(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("seq"), F.when(F.col("l_partkey") % 4 != 0, (F.col("l_suppkey") % 5 - 2).cast("int")).alias("z"))
    return flow.paint_order(boxes, ["l_orderkey"], "seq", "z").select("l_orderkey", "seq", "band", "paint")


@query(
    """
    WITH RECURSIVE i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_quantity AS s, CASE WHEN l_orderkey % 5 <> 0 THEN 100.0 END AS room FROM lineitem),
    f(l_orderkey, n, line, used) AS (SELECT l_orderkey, n, 0, s FROM i WHERE n = 1
      UNION ALL SELECT i.l_orderkey, i.n, CASE WHEN used + 5 + s > room THEN line + 1 ELSE line END, CASE WHEN used + 5 + s > room THEN s ELSE used + 5 + s END FROM f JOIN i ON i.l_orderkey = f.l_orderkey AND i.n = f.n + 1)
    SELECT l_orderkey, CAST(n AS INTEGER) AS seq, line FROM f
    """
)
def wrapped_lines(spark, sf_dir):
    """Lines of an order as items as wide as their quantity, 5 apart, in a container of 100; one order in five has no end."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("seq"), "l_quantity", F.when(F.col("l_orderkey") % 5 != 0, 100.0).alias("room"), F.lit(5.0).alias("gap"))
    return flow.wrapped_lines(items, ["l_orderkey"], "seq", "l_quantity", "room", "gap").select("l_orderkey", "seq", "line")


@query(
    """
    WITH RECURSIVE i AS (SELECT l_orderkey, row_number() OVER w AS n, l_quantity AS s, sum(l_quantity) OVER w - l_quantity AS top FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
    f(l_orderkey, n, page, used, top) AS (SELECT l_orderkey, n, 0, s, top FROM i WHERE n = 1
      UNION ALL SELECT i.l_orderkey, i.n, CASE WHEN used + s > 80 THEN page + 1 ELSE page END, CASE WHEN used + s > 80 THEN s ELSE used + s END, i.top FROM f JOIN i ON i.l_orderkey = f.l_orderkey AND i.n = f.n + 1),
    t AS (SELECT l_orderkey, page, min(top) AS top FROM f GROUP BY ALL)
    SELECT l_orderkey, count(*) AS pages, CAST(max(CASE WHEN top <= 100 THEN page ELSE 0 END) AS INTEGER) AS at_100 FROM t GROUP BY l_orderkey
    """
)
def page_buckets(spark, sf_dir):
    """Lines of an order as blocks as high as their quantity on pages of 80; the page of the height 100."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    blocks = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("seq"), "l_quantity")
    tops = flow.page_tops(blocks, ["l_orderkey"], "seq", "l_quantity", 80.0)
    return tops.groupBy("l_orderkey").agg(F.count("*").alias("pages"), flow.page_at(F.array_sort(F.collect_list("top")), F.lit(100.0)).alias("at_100"))


@query(
    """
    SELECT user_id, event_type, min(event_id) AS first, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) - 1 AS number FROM events GROUP BY user_id, event_type
    """
)
def first_uses(spark, sf_dir):
    return flow.first_uses(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query(
    """
    WITH b AS (SELECT o_custkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS name, o_orderstatus AS c FROM orders WHERE o_orderkey % 5 <> 0),
    a AS (SELECT o_custkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS name, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS c FROM orders WHERE o_orderkey % 7 <> 0)
    SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, coalesce(b.name, a.name) AS name, CASE WHEN a.name IS NULL THEN 'deleted' WHEN b.name IS NULL THEN 'added' WHEN a.c = b.c THEN 'kept' ELSE 'changed' END AS change
    FROM b FULL JOIN a ON a.doc_id = b.doc_id AND a.name = b.name
    """
)
def part_changes(spark, sf_dir):
    """Orders as parts of a customer's package before and after an edit."""
    key = F.col("o_orderkey")
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), key.cast("string").alias("name"), "o_orderkey", F.col("o_orderstatus").alias("content"), "o_orderpriority")
    after = own.where(key % 7 != 0).withColumn("content", F.when(key % 3 == 0, F.col("o_orderpriority")).otherwise(F.col("content")))
    return flow.part_changes(own.where(key % 5 != 0), after)


@query(
    """
    WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role = 'user' AS u FROM conversations),
    s AS (SELECT *, count(*) FILTER (u) OVER (PARTITION BY conv_id ORDER BY n) AS sec FROM t), c AS (SELECT *, count(*) FILTER (NOT u) OVER (PARTITION BY conv_id, sec ORDER BY n) AS sub FROM s)
    SELECT conv_id, CAST(n + 1 AS INTEGER) AS node_id, CASE WHEN u THEN 'Part ' || CAST(sec AS VARCHAR) || ':' ELSE CAST(sec AS VARCHAR) || '.' || chr(CAST(64 + sub AS INTEGER)) END AS text FROM c
    """
)
def generated_counters(spark, sf_dir):
    """Turns as siblings: users' ones count sections and start a counter anew, the others count within."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    user = F.col("role") == "user"
    turns = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(w)).select(
        F.col("conv_id").alias("doc_id"), (F.col("n") + 1).cast("int").alias("node_id"), F.lit(1).alias("parent_id"), (F.col("n") + 1).cast("int").alias("pre"), F.when(user, "sub").alias("reset"),
        F.when(user, "sec").otherwise("sub 1").alias("increment"), F.lit("none").alias("set"), F.when(user, "\"Part \" counter(sec) ':'").otherwise("counters(sec, '/') '.' counter(sub, upper-alpha)").alias("content"),
    )
    root = turns.select("doc_id").distinct().select("doc_id", F.lit(1).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(1).alias("pre"), F.lit("sec sub").alias("reset"), F.lit(None).cast("string").alias("increment"), F.lit(None).cast("string").alias("set"), F.lit("none").alias("content"))
    return flow.generated_texts(root.unionByName(turns)).withColumnRenamed("doc_id", "conv_id")


@query(
    """
    WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 12 AS x FROM lineitem), c AS (SELECT *, least(greatest(x, 0), 1) AS t FROM v)
    SELECT l_orderkey, l_linenumber, l_partkey, round(0.2 + t * t * 0.6, 9) AS power, round(CASE WHEN t < 0.25 THEN t / 0.25 ELSE 1 - (t - 0.25) / 0.75 END, 9) AS stitched,
           round(CASE WHEN t * 2 >= 1 THEN 128 / 255.0 + (t * 2 - 1) * (255 - 128) / 255.0 ELSE t * 2 * 128 / 255.0 END, 9) AS sampled, round(CASE WHEN t > 0.5 THEN 1 - t ELSE t * t END, 9) AS calculated
    FROM c
    """
)
def page_functions(spark, sf_dir):
    unit = [(0.0, 1.0)]
    line = lambda a, b: pages.Exponential(unit, [], [a], [b], 1.0)
    functions = {
        "power": pages.Exponential(unit, unit, [0.2], [0.8], 2.0), "stitched": pages.Stitched(unit, [], [line(0.0, 1.0), line(1.0, 0.0)], [0.25], [(0.0, 1.0), (0.0, 1.0)]),
        "sampled": pages.Sampled(unit, unit, [3], 8, data=bytes([0, 128, 255])), "calculated": pages.Calculated(unit, unit, pages.read_program("{ dup 0.5 gt { 1 exch sub } { dup mul } ifelse }")),
    }
    x = F.col("l_discount") * 12
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(pages.evaluated(f, x)[0], 9).alias(name) for name, f in functions.items()])
