"""PDF files written by hand: plain and compressed, with object streams, fonts with maps, and faults."""

import zlib

from kelpie.sources import files, pdf


def build(objects, packed=()):
    """A file of numbered objects (bytes, or (dictionary, data) for streams); those in `packed` go to an object stream."""
    out = b"%PDF-1.5\n"
    for k, v in objects.items():
        if isinstance(v, tuple):
            out += b"%d 0 obj\n<< %s /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (k, v[0], len(v[1]), v[1])
        elif k not in packed:
            out += b"%d 0 obj\n%s\nendobj\n" % (k, v)
    if packed:
        bodies = [objects[k] for k in packed]
        at = [sum(len(b) + 1 for b in bodies[:i]) for i in range(len(bodies))]
        index = b" ".join(b"%d %d" % x for x in zip(packed, at)) + b"\n"
        data = zlib.compress(index + b" ".join(bodies))
        out += b"99 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(packed), len(index), len(data), data)
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


PAGE = b"""BT /F2 18 Tf 72 720 Td (Motor \\(driver\\)) Tj ET
BT /F1 10 Tf 1 0 0 1 72 690 Tm [(Red val) 20 (ve) -300 (and pump)] TJ 0 -12 Td (second li) Tj (ne) Tj T* ET
BT /F1 10 Tf 14 TL 72 600 Td (a) Tj (b) ' ET"""
MAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <00E9> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
OBJECTS = {
    1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 612 792] /Resources << /Font << /F1 5 0 R /F2 6 0 R /F3 7 0 R >> >> >>",
    3: b"<< /Type /Page /Parent 2 0 R /Contents [8 0 R] >>", 4: b"<< /Type /Page /Parent 2 0 R /Contents 9 0 R >>",
    5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /Differences [98 /uni00DF] >> >>", 6: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>", 7: b"<< /Type /Font /Subtype /Type0 /BaseFont /X /ToUnicode 10 0 R >>",
    8: (b"/Filter /FlateDecode", zlib.compress(PAGE)), 9: (b"", b"BT /F3 10 Tf 72 700 Td <0001001000110012> Tj ET"), 10: (b"", MAP),
}


def texts(raw):
    return [(x["page"], x["element_type"], x["text"]) for x in pdf.parse_pdf(raw)]


def test_lines_headings_and_fonts():
    want = [(1, "heading", "Motor (driver)"), (1, "text", "Red valve and pump"), (1, "text", "second line"), (1, "text", "a"), (1, "text", "\u00df"), (2, "text", "\u00e9abc")]
    assert texts(build(OBJECTS)) == want
    assert texts(build(OBJECTS, packed=(1, 2, 3, 5, 6))) == want
    first = pdf.parse_pdf(build(OBJECTS))[0]
    assert first["is_bold"] and first["font_size"] == 18 and first["bbox"]["x0"] == 72 and first["bbox"]["y1"] == 72


def test_faults():
    raw = build(OBJECTS)
    assert pdf.parse_pdf(b"") == pdf.parse_pdf(b"no pdf") == pdf.parse_pdf(raw + b" /Encrypt 5 0 R") == []
    ring = {**OBJECTS, 2: b"<< /Type /Pages /Kids [2 0 R 3 0 R] >>"}
    pdf.parse_pdf(build(ring))
    for cut in range(0, len(raw), 41):
        pdf.parse_pdf(raw[:cut])


def test_read_with_other_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(build(OBJECTS))
    (tmp_path / "b.PDF").write_bytes(b"broken")
    (tmp_path / "c.txt").write_text("plain")
    rows = files.read_elements(spark, str(tmp_path)).collect()
    assert {r.source_file for r in rows} == {"a.pdf", "c.txt"} and len(rows) == 7
