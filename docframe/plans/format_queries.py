"""Queries of readers, writers and conversion, most on files that foreign() writes in other programs' manner, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions import formats as FM
from docframe.functions import sheet as S
from docframe.operators.convert import convert
from docframe.plans import foreign
from docframe.plans.registry import ORACLE_SQL, QUERIES, query, table


def made(rows: DataFrame, make: Callable[[list[str]], bytes]) -> DataFrame:
    """(doc_id, content) of rows (doc_id, parts array<string>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([make(p or []) for p in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "content"])

    return rows.mapInArrow(run, "doc_id long, content binary")


def converted(files: DataFrame, source: str, target: str) -> DataFrame:
    return convert(files.withColumn("format", F.lit(source)), target).select("doc_id", F.decode("output", "UTF-8").alias("text"), "error")


#: A document's paragraphs: the lines of a text in which no white space but single blanks is left, those of letters and commas only, which no format reads as marks.
WORDY = r"^[A-Za-z][A-Za-z ,.]*$"


def paragraphs(spark, sf_dir) -> DataFrame:
    cleaned = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t: F.trim(F.regexp_replace(t, " +", " ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.filter(cleaned, lambda t: t.rlike(WORDY) & ~t.rlike(r"^\S{1,6}[.]( |$)")).alias("parts"))


PARAGRAPH_SQL = rf"""
    l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents),
    c AS (SELECT doc_id, n, trim(regexp_replace(line, ' +', ' ', 'g'), ' ') AS line FROM l), p AS (SELECT * FROM c WHERE regexp_matches(line, '{WORDY}') AND NOT regexp_matches(line, '^\S{{1,6}}[.]( |$)'))"""
TEXT_SQL = f"""
    WITH {PARAGRAPH_SQL}, t AS (SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY n) || chr(10) AS text FROM p GROUP BY doc_id)
    SELECT doc_id, coalesce(t.text, '') AS text, CAST(NULL AS VARCHAR) AS error FROM documents d LEFT JOIN t USING (doc_id)
"""


def text_of(kind: str):
    def run(spark, sf_dir) -> DataFrame:
        return converted(made(paragraphs(spark, sf_dir), foreign.MAKERS[kind]), kind, "text")

    run.__doc__ = f"Paragraphs of documents as {kind} files in another program's manner, read as text."
    return run


for _kind in ("docx", "pptx", "rtf", "epub", "markdown", "html"):
    QUERIES[f"foreign_{_kind}"] = text_of(_kind)
    ORACLE_SQL[f"foreign_{_kind}"] = TEXT_SQL


@query(
    f"""
    WITH {PARAGRAPH_SQL}, f AS (SELECT doc_id, string_agg(line, ' ' ORDER BY n) AS words FROM p GROUP BY doc_id)
    SELECT doc_id, coalesce(words, '') AS words FROM documents LEFT JOIN f USING (doc_id)
    """
)
def foreign_pdf(spark, sf_dir):
    """Paragraphs of documents, twenty a page, as page descriptions with kerned strings and a plain cross-reference table; all their words in reading order."""
    out = converted(made(paragraphs(spark, sf_dir), foreign.MAKERS["pdf"]), "pdf", "text")
    return out.select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("words"))


def order_rows(spark, sf_dir) -> DataFrame:
    """Each customer's orders as separated values: key, status and price, with a heading."""
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.concat(F.lit('"'), F.lit("st ""atus"""), F.lit(" "), F.col("o_orderstatus"), F.lit('"')), F.col("o_orderpriority"))
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda s: s["line"]).alias("lines"))
    return own.select("doc_id", F.encode(F.concat(F.lit("\ufeffkey,status,priority\r\n"), F.array_join("lines", "\r\n"), F.lit("\r\n\r\n")), "UTF-8").alias("content"))


def order_table(form: str) -> str:
    return f"""
    WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS a, 'st atus ' || o_orderstatus AS b, o_orderpriority AS c FROM orders)
    SELECT doc_id, {form}, CAST(NULL AS VARCHAR) AS error FROM o GROUP BY doc_id
    """


@query(order_table("'| key | status | priority |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || a || ' | ' || b || ' | ' || c || ' |', chr(10) ORDER BY k) || chr(10) AS text"))
def csv_to_markdown(spark, sf_dir):
    return converted(order_rows(spark, sf_dir), "csv", "markdown")


@query(order_table("'key' || chr(9) || 'status' || chr(9) || 'priority' || chr(10) || string_agg(a || chr(9) || b || chr(9) || c, chr(10) ORDER BY k) || chr(10) AS text"))
def csv_to_tsv(spark, sf_dir):
    return converted(order_rows(spark, sf_dir), "csv", "tsv")


@query(
    """
    WITH o AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, * FROM orders)
    SELECT doc_id, 0 AS sheet, CAST(n AS INTEGER) AS row, col, kind, text, number FROM (
      SELECT doc_id, n, 0 AS col, 'number' AS kind, CAST(o_orderkey AS VARCHAR) AS text, CAST(o_orderkey AS DOUBLE) AS number FROM o
      UNION ALL SELECT doc_id, n, 1, 'string', o_orderpriority, NULL FROM o
      UNION ALL SELECT doc_id, n, 2, 'date', strftime(o_orderdate, '%Y-%m-%d'), date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) FROM o
      UNION ALL SELECT doc_id, n, 3, 'bool', CASE WHEN o_orderstatus = 'F' THEN 'TRUE' ELSE 'FALSE' END, NULL FROM o
      UNION ALL SELECT doc_id, n, 4, 'number', CAST(o_orderkey % 100 * 100 AS VARCHAR) || '%', o_orderkey % 100 FROM o)
    """
)
def foreign_xlsx(spark, sf_dir):
    """Each customer's orders as a workbook in another program's manner: shared strings, serial dates, truth values, per cents; a hidden sheet."""
    from docframe.sources import workbook

    fields = F.struct("o_orderkey", F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderpriority", F.date_diff(F.to_date("o_orderdate"), F.lit("1899-12-30")).cast("string"), F.when(F.col("o_orderstatus") == "F", "1").otherwise("0"), (F.col("o_orderkey") % 100).cast("string")).alias("line"))
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(fields)), lambda s: s["line"]).alias("parts"))
    cells = workbook.select_sheets(workbook.cells(workbook.raw_cells(made(own, foreign.MAKERS["xlsx"]), "doc_id", "content")))
    return cells.select("doc_id", "sheet", "row", "col", "value.kind", "text", F.col("value.f").alias("number"))


@query(
    """
    SELECT event_id, CASE CAST(event_id % 6 AS INTEGER) WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'rtf' WHEN 3 THEN 'pdf' WHEN 4 THEN CASE WHEN event_id % 4 = 0 THEN 'markdown' ELSE 'html' END ELSE CASE WHEN event_id % 4 = 1 THEN 'csv' END END AS format,
           CASE CAST(event_id % 6 AS INTEGER) WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'application/rtf' WHEN 3 THEN 'application/pdf' WHEN 4 THEN CASE WHEN event_id % 4 = 0 THEN 'text/markdown' ELSE 'text/html' END ELSE CASE WHEN event_id % 4 = 1 THEN 'text/csv' ELSE '' END END AS mime
    FROM events
    """
)
def detect_bytes(spark, sf_dir):
    heads = [b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"{\\rtf1", b"junk %PDF-1.7", b"\xef\xbb\xbf" + b" " * 3000 + b"\n<!DOCTYPE html>", b"plain words"]
    n = F.col("event_id")
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), (n % 6 + 1).cast("int"))
    path = F.when((n % 6 == 4) & (n % 4 == 0), "a.MD").when((n % 6 == 5) & (n % 4 == 1), "b.csv").otherwise("file")
    own = table(spark, sf_dir, "events").select("event_id", F.concat(head, F.encode("event_type", "UTF-8")).alias("c"), path.alias("p")).withColumn("format", FM.detect(F.col("c"), F.col("p")))
    return own.select("event_id", "format", FM.media_type_of(F.col("format")).alias("mime"))


@query(
    """
    SELECT p_partkey, CAST(p_size * 100 AS VARCHAR) || '%' AS percent, strftime(DATE '1899-12-30' + CAST(40000 + p_size AS INTEGER), '%Y-%m-%d') AS day, strftime(DATE '1904-01-01' + CAST(p_size AS INTEGER), '%Y-%m-%d') AS mac_day,
           CAST(p_partkey AS VARCHAR) AS whole, p_brand AS kept, lpad(upper(printf('%06x', p_partkey % 16777216)), 6, '0') AS rgb
    FROM part
    """
)
def number_formats(spark, sf_dir):
    n, no = F.col("p_size").cast("string"), F.lit(False)
    own = table(spark, sf_dir, "part")
    rgb = F.concat(F.lit("ff"), F.lower(F.lpad(F.hex("p_partkey"), 6, "0")))
    return own.select(
        "p_partkey", S.format_number(n, F.lit("0%"), no).alias("percent"), S.format_number((F.col("p_size") + 40000).cast("string"), F.lit("dd/mm/yyyy"), no).alias("day"),
        S.format_serial(F.col("p_size").cast("double"), F.lit("d"), F.lit(True)).alias("mac_day"), S.format_number(F.col("p_partkey").cast("string"), F.lit("#,##0"), no).alias("whole"), S.format_number(F.col("p_brand"), F.lit("0.00"), no).alias("kept"), S.normalise_rgb(rgb).alias("rgb"),
    )


@query(
    """
    SELECT c_custkey, 'text/plain;charset=utf-8' AS media, c_name AS text, CAST(NULL AS VARCHAR) AS other FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey, 'text/plain;charset=US-ASCII', c_name || ' a', NULL FROM customer WHERE c_custkey % 2 = 1
    """
)
def data_urls(spark, sf_dir):
    from docframe.sources.resources import data_urls as decoded

    name, even = F.col("c_name"), F.col("c_custkey") % 2 == 0
    url = F.when(even, F.concat(F.lit("data:text/plain;charset=utf-8;base64,"), F.base64(F.encode(name, "UTF-8")))).otherwise(F.concat(F.lit("DATA:,"), F.replace(name, F.lit("#"), F.lit("%23")), F.lit("%20a")))
    own = table(spark, sf_dir, "customer").select("c_custkey", decoded(url).alias("d"), decoded(name).alias("n"))
    return own.select("c_custkey", "d.media", F.decode("d.content", "UTF-8").alias("text"), F.col("n.media").alias("other"))


@query(
    """
    SELECT p_partkey, CAST(p_size % 4 AS INTEGER) AS tables, CAST(p_size % 3 + CASE WHEN p_size % 4 > 0 THEN 1 ELSE 0 END AS INTEGER) AS dropped FROM part
    """
)
def table_counts(spark, sf_dir):
    """How many tables a page has, and how many other blocks a writer of tables leaves out."""
    from docframe.sinks.csv import counted

    n = F.col("p_size")
    page = F.concat(F.repeat(F.lit("<p>x</p>"), (n % 3).cast("int")), F.when(n % 4 > 0, "<h2>y</h2>").otherwise(""), F.repeat(F.lit("<table><tr><td>1</table>"), (n % 4).cast("int")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[k] for f in found], pa.int32()) for k in (0, 1)]], ["p_partkey", "tables", "dropped"])

    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long"), page).mapInArrow(run, "p_partkey long, tables int, dropped int")
