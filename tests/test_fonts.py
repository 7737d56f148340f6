"""Font models: encodings, differences, widths, and what a font can be written with."""

from quirework.operators.pagefold import Page, View, fold_pages
from quirework.sources.fonts import METRICS, Font, glyph_char
from quirework.sources.pdf import open_pdf

VIEW = View(0.0, 0.0, 612.0, 792.0, 0)


def pdf(fonts: str, content: bytes, extra: bytes = b"") -> bytes:
    return b"%%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Count 1/Kids[3 0 R]>>endobj\n3 0 obj<</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]/Resources<</Font<<%s>>>>/Contents 4 0 R>>endobj\n4 0 obj<</Length %d>>stream\n%s\nendstream endobj\n%strailer<</Root 1 0 R>>" % (fonts.encode(), len(content), content, extra)


def read(data: bytes) -> list[dict]:
    file, err = open_pdf(data)
    assert err is None
    row = file.page(file.pages()[0], set())
    return Page(VIEW, {k: Font.of(k, f) for k, f in row["fonts"]}).run(row["content"]).records


def test_encodings_of_a_file():
    shown = b"BT /F1 10 Tf (A\\216\\001) Tj ET"
    one = "/F1<</Subtype/Type1/BaseFont/ABCDEF+Arial/Encoding%s>>"
    assert read(pdf(one % "/WinAnsiEncoding", shown))[0]["text"] == "AŽ\x01"
    assert read(pdf(one % "/MacRomanEncoding", shown))[0]["text"] == "A\x8e\x01"
    assert read(pdf(one % "<</Differences[1/eacute/uni20AC 65/Scaron/nosuchname]>>", b"BT /F1 10 Tf (AB\\001\\002) Tj ET"))[0]["text"] == "Š�é€"
    assert read(pdf(one % "<</BaseEncoding/WinAnsiEncoding/Differences 5 0 R>>", shown, b"5 0 obj[142/f_i 1/adieresis]endobj\n"))[0]["text"] == "A�ä"


def test_two_byte_fonts():
    cmap = b"beginbfchar <0001> <0041> <0002> <00660069> endbfchar"
    extra = b"5 0 obj<</Length %d>>stream\n%s\nendstream endobj\n6 0 obj<</Subtype/CIDFontType2/DW 700/W[1[500 0]]>>endobj\n" % (len(cmap), cmap)
    font = "/F1<</Subtype/Type0/BaseFont/X/DescendantFonts[6 0 R]/Encoding/%s/ToUnicode 5 0 R>>"
    (r,) = read(pdf(font % "Identity-H", b"BT /F1 10 Tf <00010002000300> Tj ET", extra))
    assert (r["text"], r["advance"], r["editable"], r["pending_widths"]) == ("Afi�", 12.0, True, False)
    (r,) = read(pdf(font % "UniJIS-UCS2-H", b"BT /F1 10 Tf <0001> Tj ET", extra))
    assert not r["editable"] and "Identity-H" in r["reason"]


def test_glyph_names():
    got = [glyph_char(n) for n in ("zero", "A", "Ccedilla", "zcaron", "u1F600", "daggerdbl", ".notdef", "agraveacute", "qacute", "space")]
    assert got == ["0", "A", "Ç", "ž", "😀", "‡", "�", "�", "�", " "]


def test_inverse_prefers_shown_codes():
    f = Font.of("F", {"subtype": "Type1", "base_font": "X", "widths": {65: 500.0, 66: 0.0, 200: 400.0}, "differences": {200: "A", 67: "C"}})
    assert f.inverse() == {"A": 65}
    f.decode(b"\xc8B")
    assert f.inverse() == {"A": 200, "B": 66} and f.used() == {200: "A", 66: "B"}
    assert Font.of("F", {"subtype": "Type1", "base_font": "Unknown"}).inverse() == {}
    assert Font.of("F", {"subtype": "Type1", "base_font": "ABCDEF+CourierNew"}).inverse()["€"] == 128
    plain = Font.of("F", {"subtype": "Type1", "base_font": "Courier", "encoding": "StandardEncoding"})
    assert set(plain.inverse()) == set(map(chr, range(32, 127)))
    two = Font.of("F", {"subtype": "Type0", "encoding": "Identity-H", "to_unicode": {5: "x", 3: "x", 9: ""}})
    assert two.inverse() == {"x": 3}


def test_widths_of_standard_fonts():
    font = lambda: {"F1": Font.of("F1", {"subtype": "Type1", "base_font": "Helvetica"})}
    content = b"BT /F1 10 Tf 2 Tw 1 0 0 1 100 700 Tm [(Wi) -1000 ( \\200)] TJ (x) Tj ET"
    before, after = (Page(VIEW, font(), metrics=m).run(content).records for m in ({}, METRICS))
    assert before[0]["advance"] == 32.0 and before[0]["pending_widths"] and not after[0]["pending_widths"]
    assert round(after[0]["advance"], 6) == 21.44 and round(after[0]["right"], 6) == 121.44
    assert [r["x"] for r in before] == [r["x"] for r in after] and round(after[1]["right"] - after[1]["x"], 6) == 5
    turned = Page(VIEW, font(), metrics=METRICS).run(b"BT /F1 10 Tf 0 1 -1 0 100 100 Tm (i) Tj ET").records[0]
    assert round(turned["advance"], 6) == 2.22 and turned["bottom"] - turned["top"] == 5.0
    assert len(METRICS["Helvetica"]) == 95 and METRICS["Courier"]["é"] == 600


def test_used_codes(spark):
    from tests.test_pages import TEXT, page, relation

    got = fold_pages(relation(spark, page(TEXT), page("")), characters=False).select("page", "used_codes").collect()
    assert {r["page"]: r["used_codes"] for r in got} == {0: {"F1": {ord(c): c for c in "secret word"}}, 1: {}}
