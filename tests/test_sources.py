"""Encrypted page descriptions, references, images, page functions, generated content."""

import hashlib
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.functions import colour, counters
from docframe.functions import page_functions as pages
from docframe.operators import flow
from docframe.operators.convert import convert_one
from docframe.sources import images, pdf_crypt, resources


def test_ciphers():
    """Published vectors."""
    assert pdf_crypt.rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"
    block = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8)
    for size, wanted in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        key = bytes(range(size))
        sealed = pdf_crypt.encrypted_block(pdf_crypt.round_keys(key), block).tobytes()
        assert sealed.hex() == wanted and pdf_crypt.decrypted_blocks(key, np.frombuffer(sealed * 3, np.uint8).reshape(3, 16)).tobytes() == block.tobytes() * 3
    assert pdf_crypt.cbc_decrypted(bytes(16), bytes(16) + pdf_crypt.cbc_encrypted(bytes(16), b"fifteen letters\x01", bytes(16))) == b"fifteen letters"


def file_id():
    return bytes(range(16))


def sealed_pdf(method, password=b""):
    """One page that says `Hidden words`, sealed by RC4 of 40 and 128 bits, or by AES of 128 and 256."""
    owner, flags = bytes(32), -44
    revision, size = {"RC40": (2, 5), "RC128": (3, 16), "AESV2": (4, 16), "AESV3": (6, 32)}[method]
    filled = (password + pdf_crypt.PAD)[:32]
    if revision < 6:
        key = hashlib.md5(filled + owner + struct.pack("<i", flags) + file_id()).digest()
        for _ in range(50 if revision > 2 else 0):
            key = hashlib.md5(key[:size]).digest()
        key = key[:size]
        user = pdf_crypt.rc4(key, pdf_crypt.PAD)
        if revision > 2:
            user = hashlib.md5(pdf_crypt.PAD + file_id()).digest()
            for i in range(20):
                user = pdf_crypt.rc4(bytes(b ^ i for b in key), user)
            user += bytes(16)
        more = ""
    else:
        key = bytes(range(32))
        user = pdf_crypt.hardened(password, b"validate", b"", 6) + b"validatekeysalt."
        more = "/UE<%s>" % pdf_crypt.cbc_encrypted(pdf_crypt.hardened(password, b"keysalt.", b"", 6), key, bytes(16)).hex()

    def seal(number, data):
        padded = data + bytes([16 - len(data) % 16]) * (16 - len(data) % 16)
        start = b"0123456789abcdef"
        if revision == 6:
            return start + pdf_crypt.cbc_encrypted(key, padded, start)
        own = hashlib.md5(key + struct.pack("<I", number)[:3] + bytes(2) + (b"sAlT" if method == "AESV2" else b"")).digest()[: min(16, size + 5)]
        return start + pdf_crypt.cbc_encrypted(own, padded, start) if method == "AESV2" else pdf_crypt.rc4(own, data)

    body = seal(4, b"BT /F 12 Tf 72 700 Td (Hidden words) Tj ET")
    filters = f"/CF<</Std<</CFM/{method}>>>>/StmF/Std/StrF/Std" if revision > 3 else ""
    version = {2: 1, 3: 2, 4: 4, 6: 5}[revision]
    objects = [
        b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]/Contents 4 0 R/Resources<</Font<</F 5 0 R>>>>>>", b"<</Length %d>>stream\n%s\nendstream" % (len(body), body),
        b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Note<%s>>>" % seal(5, b"note").hex().encode(), f"<</Filter/Standard/V {version}/R {revision}/Length {size * 8}/P {flags}/O<{owner.hex()}>/U<{user.hex()}>{more}{filters}>>".encode(),
    ]
    out = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in enumerate(objects, 1))
    return out + b"trailer <</Root 1 0 R/Encrypt 6 0 R/ID[<%s><%s>]>>" % (file_id().hex().encode(), file_id().hex().encode())


@pytest.mark.parametrize("method", ["RC40", "RC128", "AESV2", "AESV3"])
def test_sealed_files(method):
    """Files that the empty password opens are read; others are an error of their own."""
    assert convert_one("pdf", "text", sealed_pdf(method)) == (b"Hidden words\n", None)
    output, error = convert_one("pdf", "text", sealed_pdf(method, b"secret"))
    assert output is None and "password" in error
    assert "unknown handler" in convert_one("pdf", "text", sealed_pdf(method).replace(b"/Filter/Standard", b"/Filter/Own"))[1]


def test_references(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b.css").write_bytes(b"p {}")
    (tmp_path / "secret.txt").write_bytes(b"no")
    os.symlink(tmp_path / "secret.txt", tmp_path / "in" / "link.txt")
    here = str(tmp_path / "in")
    assert resources.load("data:image/png;base64,aGk", folder=here) == (b"hi", "image/png") and resources.load("data:,a%20b") == (b"a b", "text/plain;charset=US-ASCII")
    assert resources.load("data:text/css;x=1,p%7B%7D") == (b"p{}", "text/css;x=1") and resources.load("data:;base64,*") is None and resources.load("data:nothing") is None
    assert resources.load("a%20b.css", folder=here) == (b"p {}", "text/css")
    assert [resources.load(r, folder=here) for r in ("../secret.txt", "link.txt", "none.css", "ftp://x/a.css")] == [None] * 4
    assert resources.load("pics/x.png", parts={"pics/x.png": b"P"}) == (b"P", "image/png")
    assert resources.load("x.css?v=1", base="https://h.example/d/page.html") is None
    assert resources.load("x.css?v=1", base="https://h.example/d/page.html", fetch=lambda u: (u.encode(), "text/css")) == (b"https://h.example/d/x.css?v=1", "text/css")


def png(rows, colour_type, depth, extra=b""):
    """A file of rows of bytes, each with its filter in front."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return lambda w, h, laced=0: images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour_type, 0, 0, laced)) + extra + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def test_images(spark):
    rng = np.random.default_rng(2)
    pixels = rng.integers(0, 256, (9, 7, 4), dtype=np.uint8)
    assert (images.read_png(images.write_png(pixels)) == pixels).all()
    solid = pixels.copy()
    solid[:, :, 3] = 255
    assert (images.read_png(images.write_png(solid)) == solid).all()
    # every filter, of single gray bytes
    rows, above = [], np.zeros(5, int)
    gray = rng.integers(0, 256, (5, 5))
    for kind, row in enumerate(gray):
        left, corner = np.concatenate([[0], row[:-1]]), np.concatenate([[0], above[:-1]])
        paeth = [min(((abs(a + b - c - v), k, v) for k, v in enumerate((a, b, c))))[2] for a, b, c in zip(left, above, corner)]
        rows.append(bytes([kind, *((row - [np.zeros(5, int), left, above, (left + above) // 2, np.array(paeth)][kind]) & 255).tolist()]))
        above = row
    got = images.read_png(png(rows, 0, 8)(5, 5))
    assert (got[:, :, 0] == gray).all() and (got[:, :, 3] == 255).all()
    two = images.read_png(png([b"\x00\x1b"], 0, 2)(4, 1))
    assert two[0, :, 0].tolist() == [0, 85, 170, 255]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    table = images.read_png(png([b"\x00\x40"], 3, 4, chunk(b"PLTE", bytes(range(15))) + chunk(b"tRNS", b"\x07"))(2, 1))
    assert table.tolist() == [[[12, 13, 14, 255], [0, 1, 2, 7]]]
    laced = images.read_png(png([b"\x00\x0a", b"\x00\x0b", b"\x00\x0c\x0d"], 0, 8)(2, 2, 1))
    assert laced[:, :, 0].tolist() == [[10, 11], [12, 13]]
    docs = spark.createDataFrame([(1, images.write_png(pixels)), (2, b"no"), (3, images.write_png(solid))], "doc_id long, content binary")
    assert sorted((r.doc_id, r.width, r.opaque) for r in images.images(docs, "doc_id", "content").where("error is null").collect()) == [(1, 7, False), (3, 7, True)]
    small = {r.doc_id: r for r in images.thumbnails(docs, "doc_id", "content", 3, 2).collect()}
    assert images.read_png(bytes(small[1].output)).shape == (2, 3, 4) and "signature" in small[2].error


def test_scaling():
    weights = images.cubic_weights(10, 4)
    assert np.allclose(weights.sum(axis=1), 1) and np.allclose(images.cubic_weights(5, 5), np.eye(5)) and (weights[0, 7:] == 0).all()
    flat = np.full((6, 8, 4), 200, np.uint8)
    assert (images.scaled(flat, 3, 11) == 200).all() and images.scaled(flat, 3, 11).shape == (11, 3, 4)
    half = np.zeros((2, 2, 4), np.uint8)
    half[:, 0] = (255, 0, 0, 255)
    assert images.scaled(half, 1, 1)[0, 0].tolist() == [255, 0, 0, 128]


def test_page_functions():
    rows = lambda *x: np.array(x, float).reshape(len(x), -1)
    plane = pages.Sampled([(0, 1), (0, 1)], [(0, 1)], [2, 2], 16, data=struct.pack(">4H", 0, 65535, 0, 65535))
    assert np.allclose(plane(rows([0.25, 0.7], [2, 0], [-1, 1]))[:, 0], [0.25, 1, 0])
    assert np.allclose(pages.Sampled([(0, 1)], [(0, 1)], [5], 4, data=bytes([0x0F, 0x0F, 0x00]))(rows([0.125], [0.75]))[:, 0], [0.5, 1])
    run = lambda text, *x: pages.Calculated([(-100, 100)] * len(x), [(-1000, 1000)], pages.read_program(text))(rows(list(x)))[0, 0]
    cases = [("{ 3 1 roll sub add }", (1, 2, 3), 2), ("{ 2 copy mul exch pop exch pop }", (4, 5), 20), ("{ 1 index 7 idiv mod }", (50, 9), 2), ("{ 0 eq { 5 } { 6 } ifelse }", (0,), 5), ("{ dup 0 lt { neg } if }", (-8,), 8), ("{ cvi 3 bitshift 1 or not }", (2.9,), -18), ("{ 1 atan }", (1,), 45), ("{ round }", (2.5,), 3), ("{ % note\n pop true false or { 1 } { 2 } ifelse }", (0,), 1), ("{ 0 div }", (1,), 0), ("{ pop pop }", (1,), 0), ("{ huh }", (1,), 0)]
    assert [run(text, *x) for text, x, _ in cases] == [w for *_, w in cases]
    get = lambda v, default=None: default if v is None else v
    whole = pages.function_of(get, {"FunctionType": 3, "Domain": [0, 1], "Bounds": [0.5], "Encode": [0, 1, 1, 0], "Functions": [{"FunctionType": 2, "Domain": [0, 1], "N": 1}, {"FunctionType": 2, "Domain": [0, 1], "N": 1, "C0": [0], "C1": [2]}]})
    assert np.allclose(whole(rows([0.25], [0.5], [1.0]))[:, 0], [0.5, 2, 0])
    own = {"FunctionType": 3, "Domain": [0, 1], "Bounds": [], "Encode": [0, 1]}
    own["Functions"] = [own]
    with pytest.raises(ValueError):
        pages.function_of(get, own)
    both = pages.function_of(get, [{"FunctionType": 2, "Domain": [0, 1], "N": 2}, {"FunctionType": 4, "Domain": [0, 1], "Range": [0, 9]}], lambda s: b"{3 mul}")
    assert np.allclose(both(rows([0.5])), [[0.25, 1.5]])


def test_generated_content(spark):
    assert flow.counter_ops("a 3 b -2 none c", 1) == [("a", 3), ("b", -2), ("c", 1)] and flow.counter_ops("none", 0) == [] and flow.counter_ops(None, 0) == []
    assert flow.content_parts("\"a\" counter( n , upper-roman ) url(x) counters(m, '.') ")[:3] == [("text", "a"), ("counter", "n", "upper-roman"), ("counters", "m", ".", "decimal")]
    assert [counters.counter_text(n, s) for n, s in ((4, "lower-roman"), (27, "upper-latin"), (0, "lower-alpha"), (7, "decimal-leading-zero"), (3, "disc"), (5, "odd"))] == ["iv", "AA", "0", "07", "•", "5"]
    rows = [(1, 1, None, 1, "n", None, None, None), (1, 2, 1, 2, None, "n", None, "counters(n, '.')"), (1, 3, 2, 3, "n", None, None, None), (1, 4, 3, 4, None, "n 2", None, "counters(n, '.')"), (1, 5, 2, 5, None, "n", None, "counters(n, '-')"), (1, 6, 1, 6, None, "n", "n 9", "counter(n) counter(none)"), (2, 1, None, 1, None, None, None, "none")]
    nodes = spark.createDataFrame(rows, "doc_id long, node_id int, parent_id int, pre int, reset string, increment string, set string, content string")
    assert sorted((r.node_id, r.text) for r in flow.generated_texts(nodes).collect()) == [(2, "1"), (4, "1.2"), (5, "1-3"), (6, "90")]


def test_colours(spark):
    got = spark.createDataFrame([(0.5, -1.0, 2.0, None)], "a double, b double, c double, d double").select(colour.hex_of(colour.rgb(F.col("a"), F.col("b"), F.col("c"))), colour.hex_of(colour.gray(F.col("d"))), colour.hex_of(colour.cmyk(F.lit(1.0), F.lit(0.0), F.lit(0.5), F.lit(0.2)))).first()
    assert list(got) == ["8000ff", "000000", "00cc66"]
