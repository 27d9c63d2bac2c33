"""Still images without loss (PNG): to pixels and back, cropped and scaled."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docframe.operators.crop import best_window
from docframe.sources.packages import per_document

# Fixed values of the format: its signature, channels by colour type, starts and steps of interlaced passes
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if not data.startswith(SIGNATURE):
        raise ValueError("no PNG signature")
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + size]
        at += size + 12


def unfiltered(data: bytes, rows: int, width: int, step: int) -> np.ndarray:
    """Rows of bytes from rows that each tell their difference to the left, the row above, or both."""
    out = np.zeros((rows + 1, width + step), np.int32)
    lines = np.frombuffer(data[: rows * (width + 1)], np.uint8).reshape(rows, width + 1)
    for y in range(rows):
        kind, line, above, own = lines[y, 0], lines[y, 1:].astype(np.int32), out[y], out[y + 1]
        if kind == 0:
            own[step:] = line
        elif kind == 1:
            for k in range(step):
                own[step + k :: step] = np.cumsum(line[k::step]) & 255
        elif kind == 2:
            own[step:] = line + above[step:] & 255
        elif kind in (3, 4):
            for i in range(step, width + step):
                a, b, c = int(own[i - step]), int(above[i]), int(above[i - step])
                near = (a + b) // 2 if kind == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                own[i] = line[i - step] + near & 255
        else:
            raise ValueError(f"unknown filter {kind}")
    return out[1:, step:].astype(np.uint8)


def samples(data: bytes, height: int, width: int, channels: int, depth: int) -> tuple[np.ndarray, int]:
    """(height, width, channels) of a pass, and how many bytes it has taken."""
    if not height or not width:
        return np.zeros((height, width, channels), np.uint16), 0
    row = -(-width * channels * depth // 8)
    own = unfiltered(data, height, row, max(1, channels * depth // 8))
    if depth == 16:
        flat = own.reshape(height, -1, 2).astype(np.uint16)
        flat = flat[:, :, 0] << 8 | flat[:, :, 1]
    elif depth == 8:
        flat = own.astype(np.uint16)
    else:
        bits = np.unpackbits(own, axis=1).reshape(height, -1, depth)
        flat = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint16)
    return flat[:, : width * channels].reshape(height, width, channels), height * (row + 1)


def read_png(data: bytes) -> np.ndarray:
    """(height, width, 4) of bytes: red, green, blue, and how solid a pixel is."""
    head, palette, clear, body = b"", b"", b"", []
    for kind, own in chunks(data):
        if kind == b"IHDR":
            head = own
        elif kind == b"PLTE":
            palette = own
        elif kind == b"tRNS":
            clear = own
        elif kind == b"IDAT":
            body.append(own)
        elif kind == b"IEND":
            break
    width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", head)
    raw, n = zlib.decompress(b"".join(body)), CHANNELS[colour]
    if laced:
        out, at = np.zeros((height, width, n), np.uint16), 0
        for x0, y0, dx, dy in PASSES:
            part, used = samples(raw[at:], max(0, -(-(height - y0) // dy)), max(0, -(-(width - x0) // dx)), n, depth)
            out[y0::dy, x0::dx], at = part, at + used
    else:
        out, _ = samples(raw, height, width, n, depth)
    solid = np.full((height, width, 1), 255, np.uint8)
    if colour == 3:
        table = np.zeros((256, 4), np.uint8)
        table[:, 3] = 255
        table[: len(palette) // 3, :3] = np.frombuffer(palette[: len(palette) // 3 * 3], np.uint8).reshape(-1, 3)
        table[: len(clear), 3] = np.frombuffer(clear, np.uint8)
        return table[np.minimum(out[:, :, 0], 255)]
    if clear and colour in (0, 2):
        solid[(out == np.frombuffer(clear, ">u2")[:n]).all(axis=2)] = 0
    scaled = (out >> 8 if depth == 16 else out * (255 // ((1 << depth) - 1))).astype(np.uint8)
    if colour in (0, 4):
        solid = scaled[:, :, 1:] if colour == 4 else solid
        return np.concatenate([np.repeat(scaled[:, :, :1], 3, axis=2), solid], axis=2)
    return scaled if colour == 6 else np.concatenate([scaled, solid], axis=2)


def write_png(pixels: np.ndarray) -> bytes:
    """Of (height, width, 4) bytes; three channels where all is solid."""
    own = np.ascontiguousarray(pixels if (pixels[:, :, 3] < 255).any() else pixels[:, :, :3])
    height, width, n = own.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), own.reshape(height, -1)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6 if n == 4 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def cubic_weights(source: int, target: int) -> np.ndarray:
    """(target x source) shares of a cubic through its points, as wide as a target pixel where it shrinks; each row adds up to 1."""
    scale = source / target
    spread = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    t = np.abs(np.arange(source)[None, :] + 0.5 - centre[:, None]) / spread
    weight = np.where(t < 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0.0))
    return weight / weight.sum(axis=1, keepdims=True)


def scaled(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """To exactly width x height; colours weigh as much as they are solid."""
    solid = pixels[:, :, 3:].astype(float) / 255
    own = np.concatenate([pixels[:, :, :3] * solid, solid * 255], axis=2)
    out = np.einsum("yj,jxc->yxc", cubic_weights(pixels.shape[0], height), np.einsum("xi,jic->jxc", cubic_weights(pixels.shape[1], width), own))
    alpha = np.clip(out[:, :, 3:], 0, 255)
    colour = np.divide(out[:, :, :3] * 255, alpha, out=np.zeros_like(out[:, :, :3]), where=alpha > 0)
    return np.floor(np.concatenate([np.clip(colour, 0, 255), alpha], axis=2) + 0.5).astype(np.uint8)


def cropped(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """The window of the target's shape that holds most, scaled to the target."""
    h, w = pixels.shape[:2]
    size = (max(1, min(w, h * width // height)), max(1, min(h, w * height // width)))
    x0, y0, x1, y1 = best_window(pixels[:, :, :3], size)
    return scaled(pixels[y0:y1, x0:x1], width, height)


def images(docs: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(doc_id, width, height, opaque, error) of PNG files."""

    def rows(content: bytes):
        pixels = read_png(content)
        yield pixels.shape[1], pixels.shape[0], bool((pixels[:, :, 3] == 255).all())

    return per_document(docs, id_col, content_col, rows, [("width", pa.int32(), "int"), ("height", pa.int32(), "int"), ("opaque", pa.bool_(), "boolean")])


def thumbnails(docs: DataFrame, id_col: str, content_col: str, width: int, height: int) -> DataFrame:
    """(doc_id, output, error): each PNG file cropped to what holds most and scaled to width x height, as PNG."""
    return per_document(docs, id_col, content_col, lambda content: [(write_png(cropped(read_png(content), width, height)),)], [("output", pa.binary(), "binary")])
