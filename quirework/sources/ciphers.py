"""The public standard security handler of PDF, for files that open without a password: RC4 of 40 to 128 bits."""

from __future__ import annotations

from hashlib import md5

# Fixed value: what fills a password up to 32 bytes; an empty one is all of it.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    i = j = 0
    out = bytearray(data)
    for n, byte in enumerate(data):
        i = (i + 1) & 255
        p = s[i]
        j = (j + p) & 255
        q = s[i] = s[j]
        s[j] = p
        out[n] = byte ^ s[(p + q) & 255]
    return bytes(out)


def check_of(key: bytes, revision: int, file_id: bytes) -> bytes:
    """What the file holds as its check of the empty password, as far as it is fixed."""
    if revision < 3:
        return rc4(key, PADDING)
    out = md5(PADDING + file_id).digest()
    for i in range(20):
        out = rc4(bytes(b ^ i for b in key), out)
    return out


def empty_password_key(version: int, revision: int, bits: int, owner: bytes, user: bytes, permissions: int, file_id: bytes, metadata: bool = True) -> bytes | None:
    """The file's key, or None where it needs a password."""
    size = 5 if version == 1 or revision < 3 else bits // 8
    if not 5 <= size <= 16:
        return None
    seed = PADDING + owner[:32] + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + file_id
    key = md5(seed + b"\xff" * (0 if metadata or revision < 4 else 4)).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = md5(key[:size]).digest()
    key = key[:size]
    check = check_of(key, revision, file_id)
    return key if user[: len(check)] == check else None


def object_key(key: bytes, number: int, generation: int) -> bytes:
    return md5(key + number.to_bytes(4, "little")[:3] + generation.to_bytes(4, "little")[:2]).digest()[: min(16, len(key) + 5)]
