"""PDF and PNG files, and image operators."""

import zlib

import numpy as np
import pytest

from foliant.operators import images
from foliant.sources import pdf, png


def made_pdf(texts, packed=False):
    parts = [b"%PDF-1.4\n", b"1 0 obj <</Type /Catalog /Pages 2 0 R /Outlines 9 0 R>> endobj\n"]
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(texts)))
    parts.append(b"2 0 obj <</Type /Pages /Kids [%s] /Count %d>> endobj\n" % (kids, len(texts)))
    for i, body in enumerate(texts):
        head = b"/Filter /FlateDecode" if packed else b""
        body = zlib.compress(body) if packed else body
        parts.append(b"%d 0 obj <</Type /Page /Parent 2 0 R /MediaBox [0 0 200 100] /Contents %d 0 R>> endobj\n" % (10 + 2 * i, 11 + 2 * i))
        parts.append(b"%d 0 obj <<%s /Length %d>> stream\n%s\nendstream endobj\n" % (11 + 2 * i, head, len(body), body))
    parts.append(b"90 0 obj <</Subtype /Image /Width 4 /Height 2 /Filter /DCTDecode>> stream\njpegbytes\nendstream endobj\n")
    return b"".join(parts) + b"trailer <</Root 1 0 R>>\n%%EOF"


@pytest.mark.parametrize("packed", [False, True])
def test_pdf(spark, tmp_path, packed):
    one = rb"BT /F1 10 Tf 20 80 Td (Hello \(a\) \101) Tj 0 -20 Td [(Wo) -20 (rld)] TJ T* ( ) Tj ET"
    (tmp_path / "a.pdf").write_bytes(made_pdf([one, b"0 0 1 rg", b"BT /F1 8 Tf <FEFF00e9> Tj ET"], packed))
    (tmp_path / "b.pdf").write_bytes(b"none")
    out = pdf.pages(spark, str(tmp_path)).withColumn("scanned", pdf.scanned("spans")).orderBy("path", "page_num").collect()
    assert [(r.page_num, [s.text for s in r.spans or []], r.scanned) for r in out] == [(1, ["Hello (a) A", "World"], False), (2, [], True), (3, ["é"], False), (0, [], True)]
    assert (out[0].width, out[0].height) == (200, 100) and [(s.x1, s.y2) for s in out[0].spans] == [(20, 20), (20, 40)] and "ValueError" in out[3].error
    assert pdf.pages(spark, str(tmp_path), max_pages=1).where("error is null").count() == 1
    assert [r.text for r in pdf.tokens(pdf.pages(spark, str(tmp_path)).where("page_num = 1")).collect()] == ["Hello (a) A", "World"]
    m = pdf.metadata(spark, str(tmp_path)).orderBy("path").first()
    assert (m.page_count, m.has_toc, m.has_links, m.has_images, m.form_fields) == (3, True, False, True, 0)
    assert [(r.kind, r.width, bytes(r.content)) for r in pdf.images(spark, str(tmp_path)).collect()] == [("jpeg", 4, b"jpegbytes")]


def test_png(spark, tmp_path):
    x = np.random.default_rng(0).integers(0, 256, (13, 7)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(png.encode(x))
    (tmp_path / "b.png").write_bytes(b"none")
    a, b = png.pages(spark, str(tmp_path)).orderBy("path").collect()
    assert (a.height, a.width, bytes(a.pixels)) == (13, 7, x.tobytes()) and b.pixels is None and b.error


def test_png_filters():
    x = np.random.default_rng(1).integers(0, 256, (5, 6)).astype(int)
    rows = []
    for y in range(5):
        up = x[y - 1] if y else np.zeros(6, int)
        left, corner = np.r_[0, x[y][:-1]], np.r_[0, up[:-1]]
        paeth = [min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2] for a, b, c in zip(left, up, corner, strict=True)]
        guess = [np.zeros(6, int), left, up, (left + up) // 2, np.array(paeth)][y]
        rows.append(bytes([y]) + ((x[y] - guess) % 256).astype(np.uint8).tobytes())
    data = png.encode(x.astype(np.uint8))
    at = data.index(b"IDAT")
    body = zlib.compress(b"".join(rows))
    filtered = data[: at - 4] + len(body).to_bytes(4, "big") + b"IDAT" + body + bytes(4) + data[data.index(b"IEND") - 4 :]
    assert (png.decode(filtered) == x).all()


def test_image_operators(spark):
    x = np.array([[50, 50, 50], [50, 200, 50], [50, 50, 150]], np.uint8)
    assert images.autocontrast(x).min() == 0 and images.autocontrast(x).max() == 255 and images.median(x)[1, 1] == 50
    assert images.unsharp(x)[1, 1] == 255 and set(images.binarize(x).ravel()) == {0, 255} and (images.rotate(x, 360) == x).all()
    dot = np.full((5, 5), 255, np.uint8)
    dot[2, 2] = 0
    assert images.despeckle(dot).min() == 255 and images.downscale(np.zeros((3300, 10), np.uint8)).shape == (1100, 3)
    page = np.full((120, 200), 255, np.uint8)
    for y in range(20, 110, 20):
        for i in range(10, 190):
            page[y + round(i * np.tan(np.deg2rad(2))) - 4, i] = 0
    assert images.skew(page) == pytest.approx(2, abs=0.3) and abs(images.skew(images.deskew(page))) <= 0.3
    frame = spark.createDataFrame([(1, 3, 3, bytearray(x.tobytes())), (2, None, None, None)], "id int, height int, width int, pixels binary")
    a, b = images.apply(frame, ["autocontrast", "binarize"]).orderBy("id").collect()
    assert (a.height, a.width, len(a.pixels)) == (3, 3, 9) and b.pixels is None
