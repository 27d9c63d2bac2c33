"""The standard security handler of page descriptions, for files that open without a password."""

from __future__ import annotations

import hashlib

import numpy as np

# Fixed value: what short passwords are filled up with
PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(data), 0, 0
    for k, b in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[k] = b ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def times(a: int, b: int) -> int:
    """In the field of 256 elements."""
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = a << 1 ^ (0x11B if a & 128 else 0)
        b >>= 1
    return out


def substitution() -> np.ndarray:
    """Each byte's inverse in the field, turned and added up."""
    inverse = [0] + [next(b for b in range(1, 256) if times(a, b) == 1) for a in range(1, 256)]
    return np.array([b ^ (b << 1 | b >> 7) & 255 ^ (b << 2 | b >> 6) & 255 ^ (b << 3 | b >> 5) & 255 ^ (b << 4 | b >> 4) & 255 ^ 0x63 for b in inverse], np.uint8)


BOX = substitution()
UNBOX = np.argsort(BOX).astype(np.uint8)
#: Bytes of a block, column by column, after its rows have been shifted.
SHIFT = np.array([(4 * (c + r) + r) % 16 for c in range(4) for r in range(4)])
UNSHIFT = np.argsort(SHIFT)
MULTIPLES = {k: np.array([times(a, k) for a in range(256)], np.uint8) for k in (1, 2, 3, 9, 11, 13, 14)}


def mixed(state: np.ndarray, factors: tuple[int, int, int, int]) -> np.ndarray:
    columns = state.reshape(-1, 4, 4)
    out = np.zeros_like(columns)
    for r in range(4):
        for k in range(4):
            out[:, :, r] ^= MULTIPLES[factors[(k - r) % 4]][columns[:, :, k]]
    return out.reshape(-1, 16)


def round_keys(key: bytes) -> np.ndarray:
    n = len(key) // 4
    words = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
    constant = 1
    for i in range(n, 4 * (n + 7)):
        w = list(words[-1])
        if i % n == 0:
            w = [int(BOX[b]) for b in w[1:] + w[:1]]
            w[0] ^= constant
            constant = times(constant, 2)
        elif n > 6 and i % n == 4:
            w = [int(BOX[b]) for b in w]
        words.append([a ^ b for a, b in zip(words[i - n], w)])
    return np.array(words, np.uint8).reshape(-1, 16)


def decrypted_blocks(key: bytes, blocks: np.ndarray) -> np.ndarray:
    """All blocks (n x 16) at once."""
    keys = round_keys(key)
    state = blocks ^ keys[-1]
    for k in range(len(keys) - 2, -1, -1):
        state = UNBOX[state[:, UNSHIFT]] ^ keys[k]
        if k:
            state = mixed(state, (14, 11, 13, 9))
    return state


def encrypted_block(keys: np.ndarray, block: np.ndarray) -> np.ndarray:
    state = (block ^ keys[0]).reshape(1, 16)
    for k in range(1, len(keys)):
        state = BOX[state][:, SHIFT]
        if k < len(keys) - 1:
            state = mixed(state, (2, 3, 1, 1))
        state = state ^ keys[k]
    return state[0]


def cbc_decrypted(key: bytes, data: bytes, start: bytes | None = None, padded: bool = True) -> bytes:
    """Without a start, the first block is it; with padding, the last byte tells how many to drop. What is no whole block is left out."""
    start, data = (data[:16], data[16:]) if start is None else (start, data)
    blocks = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
    if not len(blocks) or len(start) < 16:
        return b""
    before = np.concatenate([np.frombuffer(start, np.uint8).reshape(1, 16), blocks[:-1]])
    out = (decrypted_blocks(key, blocks) ^ before).tobytes()
    return out[: -out[-1]] if padded and 1 <= out[-1] <= 16 else out


def cbc_encrypted(key: bytes, data: bytes, start: bytes) -> bytes:
    keys, last, out = round_keys(key), np.frombuffer(start, np.uint8), []
    for at in range(0, len(data), 16):
        last = encrypted_block(keys, np.frombuffer(data[at : at + 16], np.uint8) ^ last)
        out.append(last.tobytes())
    return b"".join(out)


def hardened(password: bytes, salt: bytes, extra: bytes, revision: int) -> bytes:
    """The digest of a password and salt: revision 5 takes it as it is, revision 6 goes on with rounds of encryption."""
    k = hashlib.sha256(password + salt + extra).digest()
    if revision < 6:
        return k
    i = 0
    while True:
        e = cbc_encrypted(k[:16], (password + k + extra) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Handler:
    """Strings and streams of a file that the empty password opens; others are an error."""

    def __init__(self, encrypt: dict, file_id: bytes):
        if encrypt.get("Filter") != "Standard":
            raise ValueError(f"encrypted by an unknown handler: {encrypt.get('Filter')}")
        revision, self.method = encrypt.get("R", 0), "V2"
        owner, user = (bytes(encrypt.get(k) or b"") for k in "OU")
        if revision >= 4:
            filters = encrypt.get("CF") or {}
            name = encrypt.get("StmF", "Identity")
            self.method = str((filters.get(name) or {}).get("CFM", "None")) if name != "Identity" else "None"
        if revision in (2, 3, 4):
            size = 16 if self.method == "AESV2" else 5 if revision == 2 else (encrypt.get("Length") or 40) // 8
            size = size if 5 <= size <= 16 else 5
            tail = b"\xff\xff\xff\xff" if revision >= 4 and encrypt.get("EncryptMetadata") is False else b""
            key = hashlib.md5(PAD + owner[:32] + (int(encrypt.get("P", 0)) & 0xFFFFFFFF).to_bytes(4, "little") + file_id + tail).digest()
            for _ in range(50 if revision >= 3 else 0):
                key = hashlib.md5(key[:size]).digest()
            self.key = key[:size]
            if self.checked(revision, file_id) != user[: 32 if revision == 2 else 16]:
                raise ValueError("encrypted: a password is needed")
        elif revision in (5, 6):
            if hardened(b"", user[32:40], b"", revision) != user[:32]:
                raise ValueError("encrypted: a password is needed")
            self.key = cbc_decrypted(hardened(b"", user[40:48], b"", revision), bytes(encrypt.get("UE") or b"")[:32], bytes(16), False)
        else:
            raise ValueError(f"encrypted by an unknown revision: {revision}")

    def checked(self, revision: int, file_id: bytes) -> bytes:
        if revision == 2:
            return rc4(self.key, PAD)
        out = hashlib.md5(PAD + file_id).digest()
        for i in range(20):
            out = rc4(bytes(b ^ i for b in self.key), out)
        return out

    def plain(self, number: int, generation: int, data: bytes) -> bytes:
        if self.method == "AESV3":
            return cbc_decrypted(self.key, data)
        if self.method in ("None", "Identity"):
            return data
        salt = b"sAlT" if self.method == "AESV2" else b""
        key = hashlib.md5(self.key + number.to_bytes(4, "little")[:3] + generation.to_bytes(2, "little") + salt).digest()[: min(16, len(self.key) + 5)]
        return cbc_decrypted(key, data) if salt else rc4(key, data)
