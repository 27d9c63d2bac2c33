"""Document formats: names, media types, capabilities, and detection by bytes, name and media type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Format -> (aliases, path extensions, media type, can be read, can be written)
FORMATS: dict[str, tuple[tuple[str, ...], tuple[str, ...], str, bool, bool]] = {
    "pdf": (("pdf",), ("pdf",), "application/pdf", True, True),
    "docx": (("docx",), ("docx",), "application/vnd.openxmlformats-officedocument.wordprocessingml.document", True, True),
    "html": (("html", "htm", "xhtml"), ("html", "htm", "xhtml"), "text/html", True, True),
    "markdown": (("markdown", "md"), ("md", "markdown"), "text/markdown", True, True),
    "text": (("text", "txt", "plain"), ("txt", "text"), "text/plain", True, True),
    "csv": (("csv",), ("csv",), "text/csv", True, True),
    "tsv": (("tsv", "tab"), ("tsv", "tab"), "text/tab-separated-values", True, True),
    "xlsx": (("xlsx", "xlsm"), ("xlsx", "xlsm"), "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", True, True),
    "rtf": (("rtf",), ("rtf",), "application/rtf", True, True),
    "pptx": (("pptx", "pptm"), ("pptx", "pptm"), "application/vnd.openxmlformats-officedocument.presentationml.presentation", True, True),
    "epub": (("epub",), ("epub",), "application/epub+zip", True, True),
    "png": (("png",), ("png",), "image/png", True, True),
    "jpeg": (("jpeg", "jpg"), ("jpg", "jpeg"), "image/jpeg", True, True),
    "heic": (("heic", "heif"), ("heic", "heif"), "image/heic", True, False),
}
# More media types that are read, and those that are refused
MORE_MEDIA = {
    "application/x-pdf": "pdf", "application/xhtml+xml": "html", "text/x-markdown": "markdown", "application/csv": "csv",
    "text/rtf": "rtf", "image/jpg": "jpeg", "image/heif": "heic",
}
REFUSED_MEDIA = (
    "application/msword", "application/vnd.ms-word", "application/vnd.ms-excel", "application/vnd.ms-powerpoint",
    "image/heic-sequence", "image/heif-sequence", "application/zip", "application/octet-stream",
)
# Tags that mark HTML at the start of a file; brands of still images
SNIFFED_TAGS = ("!doctype html", "html", "head", "script", "iframe", "h1", "div", "font", "table", "a", "style", "title", "b", "body", "br", "p")
HEIF_BRANDS = ("heic", "heix", "heim", "heis", "hevc", "hevx", "hevm", "hevs")
PDF_WINDOW = 1024


def dimension(spark: SparkSession) -> DataFrame:
    """name, can_input, can_output, mime: one row a format."""
    return spark.createDataFrame([(n, i, o, m) for n, (_, _, m, i, o) in FORMATS.items()], "name string, can_input boolean, can_output boolean, mime string")


def lookup(key: Column, table: dict[str, str]) -> Column:
    """table[key], null where there is none; a literal map, so no join."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def format_of_name(name: Column) -> Column:
    aliases = {a: n for n, (names, *_) in FORMATS.items() for a in names}
    return lookup(F.lower(F.regexp_replace(F.trim(name), r"^\.", "")), aliases)


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def format_of_path(path: Column) -> Column:
    return lookup(extension_of(path), {e: n for n, (_, exts, *_) in FORMATS.items() for e in exts})


def format_of_media_type(mime: Column) -> Column:
    """Parameters are ignored; refused types have none; any other text type is text."""
    kind = F.lower(F.trim(F.split(mime, ";")[0]))
    known = {m: n for n, (_, _, m, _, _) in FORMATS.items()} | MORE_MEDIA
    return F.when(kind.isin(*REFUSED_MEDIA), None).otherwise(F.coalesce(lookup(kind, known), F.when(kind.startswith("text/"), "text")))


def media_type_of(name: Column) -> Column:
    return F.coalesce(lookup(name, {n: m for n, (_, _, m, _, _) in FORMATS.items()}), F.lit(""))


def looks_like_html(text: Column, mark: str = r"\x{FEFF}") -> Column:
    """After a byte order mark and white space: a comment, an XML declaration, or a known tag and its end."""
    return text.rlike(rf"(?i)\A(?:{mark})?[\t\n\f\r ]*+(?:<!--|<\?xml|<(?:" + "|".join(SNIFFED_TAGS) + r")[ \t\n\f\r>])")


def byte_text(content: Column) -> Column:
    """Bytes as characters of the same numbers, for searching."""
    return F.decode(content, "ISO-8859-1")


def big_endian(content: Column, start: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(content, start, size)), 16, 10).cast("long")


def still_image(content: Column) -> Column:
    """An ISO base-media file of a still-image brand: the main one, or for mif1 a compatible one. Its first box must lie within the bytes."""
    size, head = big_endian(content, 1, 4), byte_text(F.substring(content, 1, 16))
    brand = F.substring(head, 9, 4)
    listed = byte_text(F.substring(content, F.lit(17), F.greatest(F.floor((size - 16) / 4) * 4, F.lit(0)).cast("int")))
    among = listed.rlike(r"(?s)\A(?:.{4})*?(?:" + "|".join(sorted(HEIF_BRANDS)) + ")")
    fine = (F.octet_length(content) >= 12) & (F.substring(head, 5, 4) == "ftyp") & (size >= 16) & (size <= F.octet_length(content))
    return F.when(fine & brand.isin(*HEIF_BRANDS), True).when(fine & (brand == "mif1"), among).otherwise(False)


def format_of_bytes(content: Column, package: Column | None = None) -> Column:
    """By signature; `package` is the format of a zip container, found by sources.packages."""
    text = byte_text(F.substring(content, 1, PDF_WINDOW))
    zipped = text.startswith("PK\x03\x04") | text.startswith("PK\x05\x06")
    return (
        F.when(text.startswith("\x89PNG\r\n\x1a\n"), "png")
        .when(text.startswith("\xff\xd8\xff"), "jpeg")
        .when(zipped, package if package is not None else F.lit(None).cast("string"))
        .when(text.startswith("{\\rtf"), "rtf")
        .when(still_image(content), "heic")
        .when(F.contains(text, F.lit("%PDF-")), "pdf")
    )


def detect(content: Column, path: Column, package: Column | None = None) -> Column:
    """Signature, then the name's extension, then the look of HTML; else null."""
    html = looks_like_html(byte_text(content), r"\xEF\xBB\xBF")
    return F.coalesce(format_of_bytes(content, package), format_of_path(path), F.when(html, "html"))


def conversion(formats: DataFrame) -> DataFrame:
    """Every ordered pair of formats: from, to, verdict (ok, input, output, same)."""
    a, b = formats.alias("a"), formats.alias("b")
    verdict = F.when(~F.col("a.can_input"), "input").when(~F.col("b.can_output"), "output").when(F.col("a.name") == F.col("b.name"), "same").otherwise("ok")
    # 14 x 14 pairs of a fixed dimension
    return a.crossJoin(F.broadcast(b)).select(F.col("a.name").alias("from_format"), F.col("b.name").alias("to_format"), verdict.alias("verdict"))
