"""Files that open with an empty password, and those that don't."""

import zlib
from hashlib import md5

import pytest

from quirework.operators.pagefold import Page, View
from quirework.sources.ciphers import PADDING, check_of, object_key, rc4
from quirework.sources.fonts import Font
from quirework.sources.pdf import open_pdf

OWNER, FILE_ID, P = bytes(range(32)), b"0123456789abcdef", -3904


def file_key(size: int, revision: int) -> bytes:
    key = md5(PADDING + OWNER + (P & 0xFFFFFFFF).to_bytes(4, "little") + FILE_ID).digest()
    for _ in range(50 * (revision >= 3)):
        key = md5(key[:size]).digest()
    return key[:size]


def encrypted(version: int, revision: int, size: int, user: bytes | None = None, more: bytes = b"") -> bytes:
    key = file_key(size, revision)
    body = rc4(object_key(key, 4, 0), zlib.compress(b"BT /F1 10 Tf 1 0 0 1 50 700 Tm (plain text) Tj ET"))
    user = check_of(key, revision, FILE_ID).ljust(32, b"\0") if user is None else user
    return b"".join(
        [
            b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Count 1/Kids[3 0 R]>>endobj\n",
            b"3 0 obj<</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]/Resources<</Font<</F1<</Subtype/Type1/BaseFont/Helvetica>>>>>>/Contents 4 0 R/Note<%s>>>endobj\n" % rc4(object_key(key, 3, 0), b"kept").hex().encode(),
            b"4 0 obj<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream endobj\n" % (len(body), body),
            b"5 0 obj<</Filter/Standard/V %d/R %d/Length %d/P %d/O<%s>/U<%s>%s>>endobj\n" % (version, revision, 8 * size, P, OWNER.hex().encode(), user.hex().encode(), more),
            b"trailer<</Root 1 0 R/Encrypt 5 0 R/ID[<%s><00>]>>" % FILE_ID.hex().encode(),
        ]
    )


def test_cipher_by_its_published_vector():
    assert rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


CRYPT = b"/CF<</StdCF<</CFM/%s>>>>/StmF/StdCF/StrF/StdCF"


@pytest.mark.parametrize("data", [encrypted(1, 2, 5), encrypted(2, 3, 16), encrypted(2, 3, 7), encrypted(4, 4, 16, more=CRYPT % b"V2")])
def test_empty_password(data):
    pdf, err = open_pdf(data)
    assert err is None
    (page,) = pdf.pages()
    row = pdf.page(page, set())
    fonts = {k: Font.of(k, f) for k, f in row["fonts"]}
    assert [r["text"] for r in Page(View(0, 0, 612, 792, 0), fonts).run(row["content"]).records] == ["plain text"]
    assert page["Note"] == b"kept"


@pytest.mark.parametrize("data", [encrypted(2, 3, 16, user=bytes(32)), encrypted(4, 4, 16, more=CRYPT % b"AESV2"), encrypted(5, 6, 16), encrypted(2, 3, 16).replace(b"/Standard", b"/Another_")])
def test_locked(data):
    assert open_pdf(data) == (None, "locked")
