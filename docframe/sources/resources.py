"""What documents refer to: data URLs, parts held by name, files below one folder, and addresses where a caller allows them."""

from __future__ import annotations

import base64
import os
import re
import urllib.parse
from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

# Media types by extension, as far as documents refer to such files
MEDIA = {"css": "text/css", "gif": "image/gif", "htm": "text/html", "html": "text/html", "jpeg": "image/jpeg", "jpg": "image/jpeg", "png": "image/png", "svg": "image/svg+xml", "ttf": "font/ttf", "txt": "text/plain", "webp": "image/webp", "woff2": "font/woff2"}
DATA = re.compile(r"(?is)\Adata:([^,]*),(.*)\Z")


def media_type(name: str) -> str:
    return MEDIA.get(name.split("?")[0].rpartition(".")[2].lower(), "")


def data_url(url: str | None) -> tuple[bytes, str] | None:
    """The bytes and media type of a data URL; null if it is none or its base64 is malformed."""
    m = DATA.match(url or "")
    if m is None:
        return None
    kind, *rest = m[1].split(";")
    body = urllib.parse.unquote_to_bytes(m[2])
    if rest and rest[-1].strip().lower() == "base64":
        rest = rest[:-1]
        plain = re.sub(rb"\s", b"", body).replace(b"-", b"+").replace(b"_", b"/").rstrip(b"=")
        try:
            body = base64.b64decode(plain + b"=" * (-len(plain) % 4), validate=True)
        except ValueError:
            return None
    return body, ";".join([kind.strip() or "text/plain", *rest]) if kind.strip() or rest else "text/plain;charset=US-ASCII"


def load(ref: str, base: str = "", folder: str | None = None, parts: Mapping[str, bytes] | None = None, fetch: Callable[[str], tuple[bytes, str]] | None = None) -> tuple[bytes, str] | None:
    """(bytes, media type) of a reference, or null: a data URL, else a held part, else a file that lies below the folder, links followed, else what fetch gives for http and https.

    References are relative to base. Without fetch nothing is read from a network.
    """
    found = data_url(ref)
    if found is not None or ref.lower().startswith("data:"):
        return found
    whole = urllib.parse.urljoin(base, ref) if base else ref
    scheme = urllib.parse.urlsplit(whole).scheme.lower()
    if scheme in ("http", "https"):
        return fetch(whole) if fetch else None
    if scheme not in ("", "file"):
        return None
    name = urllib.parse.unquote(urllib.parse.urlsplit(whole).path)
    if parts is not None and (held := parts.get(name.lstrip("/"))) is not None:
        return held, media_type(name)
    if folder is not None:
        top = os.path.realpath(folder)
        path = os.path.realpath(os.path.join(top, name.lstrip("/")))
        if os.path.commonpath([top, path]) == top and os.path.isfile(path):
            with open(path, "rb") as f:
                return f.read(), media_type(name)
    return None


@F.arrow_udf(StructType([StructField("content", BinaryType()), StructField("media", StringType())]))
def data_urls(urls: pa.Array) -> pa.Array:
    """A data URL's bytes and media type; nulls where it is none."""
    found = [data_url(u) for u in urls.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([f and f[0] for f in found], pa.binary()), pa.array([f and f[1] for f in found], pa.string())], ["content", "media"])
