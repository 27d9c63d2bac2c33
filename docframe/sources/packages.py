"""Zip packages: their kind by part names, and their parts as rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Part names and folders that tell a package's format
EXACT = {"word/document.xml": "docx", "xl/workbook.xml": "xlsx", "ppt/presentation.xml": "pptx"}
FOLDERS = (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx"))


def package_format(data: bytes | None) -> str | None:
    """The first of the known names in the directory's order; else a folder beside [Content_Types].xml; null if none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            names = [i.filename for i in z.infolist()]
            for n in names:
                if n in EXACT:
                    return EXACT[n]
                if n == "mimetype" and z.read(n)[:64].strip() == b"application/epub+zip":
                    return "epub"
    except (zipfile.BadZipFile, OSError, ValueError):
        return None
    if "[Content_Types].xml" in names:
        return next((f for folder, f in FOLDERS if any(n.startswith(folder) for n in names)), None)
    return None


@F.arrow_udf(StringType())
def package_kind(content: pa.Array) -> pa.Array:
    return pa.array([package_format(c) for c in content.to_pylist()], pa.string())


class Parts(Mapping[str, bytes]):
    """A package's parts by name, each unpacked when it is asked for, so that media no reader wants take no memory."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.entries = {i.filename: i for i in self.zip.infolist() if not i.is_dir()}

    def __getitem__(self, name: str) -> bytes:
        return self.zip.read(self.entries[name])

    def __contains__(self, name: object) -> bool:
        return name in self.entries

    def __iter__(self) -> Iterator[str]:
        return iter(self.entries)

    def __len__(self) -> int:
        return len(self.entries)


def parts_of(data: bytes) -> Parts:
    return Parts(data)


def pack(parts: list[tuple[str, bytes | str]], stored: tuple[str, ...] = ()) -> bytes:
    """A package with fixed times, so that equal parts give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED
            z.writestr(info, data)
    return out.getvalue()


def read_files(spark, path: str) -> DataFrame:
    """path, content, format, error of the files at a path."""
    from docframe.functions import formats

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kind = formats.detect(F.col("content"), F.col("path"), package_kind(F.col("content")))
    return files.withColumn("format", kind).withColumn("error", F.when(F.col("format").isNull(), "unknown document format"))


def per_document(docs: DataFrame, id_col: str, content_col: str, parse, fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """Rows that parse(content) gives for each document, after doc_id; a failure gives one row with an error and nulls."""
    names = ["doc_id", *[f for f, _, _ in fields], "error"]
    kinds = [pa.int64(), *[k for _, k, _ in fields], pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = [(doc, *r, None) for r in parse(content)]
                except Exception as e:  # noqa: BLE001  the document is named, the others go on
                    rows = [(doc, *[None] * len(fields), f"{type(e).__name__}: {e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = ", ".join(["doc_id long", *[f"{f} {ddl}" for f, _, ddl in fields], "error string"])
    return docs.select(docs[id_col].cast("long"), docs[content_col]).mapInArrow(run, schema)
