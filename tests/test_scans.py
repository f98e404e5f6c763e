"""Files made by hand into pages; detector grids into words; the steps of a corpus."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphkin.functions import scans
from glyphkin.operators import detection
from glyphkin.plans.corpus import Corpus
from glyphkin.sources import scans as source
from glyphkin.sources.files import read_pages


def tiff(img, coding=1, order="<", kind=1, extra=()):
    """A TIFF file with one strip."""
    h, w = img.shape[:2]
    samples = img.shape[2] if img.ndim == 3 else 1
    data = {1: bytes, 8: zlib.compress, 32773: lambda b: b"".join(bytes([len(b[i : i + 100]) - 1]) + b[i : i + 100] for i in range(0, len(b), 100))}[coding](img.tobytes())
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 8), (259, 3, 1, coding), (262, 3, 1, kind), (273, 4, 1, 8), (277, 3, 1, samples), (279, 4, 1, len(data)), *extra]
    entry = lambda t, k, n, v: struct.pack(order + "HHI", t, k, n) + (struct.pack(order + "HH", v, 0) if k == 3 else struct.pack(order + "I", v))
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(data))
    return head + data + struct.pack(order + "H", len(tags)) + b"".join(entry(*t) for t in sorted(tags)) + struct.pack(order + "I", 0)


IMG = np.random.default_rng(0).integers(0, 256, (12, 17), np.uint8)


@pytest.mark.parametrize("coding", [1, 8, 32773])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff(coding, order):
    assert (scans.tiff_pixels(tiff(IMG, coding, order)) == IMG).all()
    rgb = np.stack([IMG, IMG + 1, IMG + 2], -1)
    assert (scans.tiff_pixels(tiff(rgb, coding, order, 2)) == rgb).all()
    assert (scans.tiff_pixels(tiff(IMG, coding, order, 0)) == 255 - IMG).all()


def packed_lzw(data):
    """A plain encoder for the test: clear, codes of growing width, end."""
    table = {bytes([i]): i for i in range(256)}
    codes, word, width = [(256, 9)], b"", 9
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        codes.append((table[word], width))
        table[word + bytes([b])] = len(table) + 2
        word = bytes([b])
        n = len(table) + 2
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    codes += [(table[word], width), (257, width)]
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def test_lzw():
    data = bytes(np.random.default_rng(1).integers(0, 4, 3000, np.uint8)) + b"aaaaaaaaaa" * 20
    assert scans.unpack_lzw(packed_lzw(data)) == data


def test_lanczos():
    flat = np.full((20, 30), 77, np.uint8)
    assert (scans.lanczos(flat, 7, 11) == 77).all()
    assert (scans.lanczos(IMG, *IMG.shape) == IMG).all()
    assert scans.rescaled(IMG, 300, 150).shape == (6, 8) and scans.rescaled(IMG, 150, 150.5) is IMG


def pdf(pages, packed=False):
    """A PDF file whose pages have the given images: (pixels, filter) each."""
    objects, kids = {}, []
    number = 10
    for images in pages:
        names = []
        for img, extra in images:
            data = zlib.compress(img.tobytes())
            space = b"/DeviceRGB" if img.ndim == 3 else b"/DeviceGray"
            mask = b""
            if extra is not None:
                m = zlib.compress(extra.tobytes())
                objects[number] = b"<</Type/XObject/Subtype/Image/Width %d/Height %d/BitsPerComponent 8/ColorSpace/DeviceGray/Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream" % (extra.shape[1], extra.shape[0], len(m), m)
                mask = b"/SMask %d 0 R" % number
                number += 1
            objects[number] = b"<</Type/XObject/Subtype/Image/Width %d/Height %d/BitsPerComponent 8/ColorSpace%s%s/Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream" % (img.shape[1], img.shape[0], space, mask, len(data), data)
            names.append(b"/I%d %d 0 R" % (number, number))
            number += 1
        objects[number] = b"<</Type/Page/Parent 2 0 R/Resources<</XObject<<%s>>>>>>" % b" ".join(names)
        kids.append(b"%d 0 R" % number)
        number += 1
    objects[1] = b"<</Type/Catalog/Pages 2 0 R>>"
    objects[2] = b"<</Type/Pages/Count %d/MediaBox[0 0 144 72]/Kids[%s]>>" % (len(kids), b" ".join(kids))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in objects.items()) + b"trailer<</Root 1 0 R>>\n"


def test_pdf():
    rgb = np.stack([IMG, IMG, IMG], -1)
    pages = scans.Pdf(pdf([[(IMG, None)], [], [(rgb, None), (IMG, None)]])).pages()
    assert [(p.width_pt, p.height_pt, len(p.images)) for p in pages] == [(144, 72, 1), (144, 72, 0), (144, 72, 2)]
    assert (pages[0].images[0].pixels() == IMG).all() and (pages[2].images[0].pixels() == rgb).all()


def test_pdf_predictors():
    rows = []
    before = np.zeros(17, np.int64)
    for k, line in enumerate(IMG.astype(np.int64)):
        left = np.concatenate([[0], line[:-1]])
        corner = np.concatenate([[0], before[:-1]])
        kind = k % 5
        paeth = np.array([min((a, b, c), key=lambda v: abs(a + b - c - v)) for a, b, c in zip(left, before, corner)])
        guess = [0 * line, left, before, (left + before) // 2, paeth][kind]
        rows.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        before = line
    img = scans.PdfImage(17, 12, 8, "FlateDecode", zlib.compress(b"".join(rows)), 15)
    assert (img.pixels() == IMG).all()


def test_layers():
    mask = np.zeros(IMG.shape, np.uint8)
    mask[3:5] = 255
    page = scans.Pdf(pdf([[(IMG, None), (255 - IMG, mask)]])).pages()[0]
    assert (scans.layered(page) == np.where(mask > 0, 255 - IMG, IMG)).all()


def test_scans_to_pages(spark, tmp_path):
    (tmp_path / "s" / "folder").mkdir(parents=True)
    (tmp_path / "s" / "a.pdf").write_bytes(pdf([[(IMG, None)], [(IMG, None), (IMG, None)]]))
    for n in ("b", "a"):
        (tmp_path / "s" / "folder" / f"{n}.tif").write_bytes(tiff(IMG if n == "b" else IMG // 2))
    p = source.read_pdf(spark, f"file://{tmp_path}/s")
    assert [(r.doc, r.page, r.dpi_width, r.n_images) for r in p.orderBy("page").collect()] == [("a", 0, 8.5, 1), ("a", 1, 8.5, 2)]
    t = source.read_tiff(spark, f"file://{tmp_path}/s")
    assert [(r.doc, r.page, r.name, bytes(r.pixels) == (IMG // 2).tobytes()) for r in t.orderBy("page").collect()] == [("folder", 0, "a", True), ("folder", 1, "b", False)]
    known = spark.createDataFrame([("a", 300), ("folder", 150)], "doc string, dpi int")
    files = source.convert(p.unionByName(t), f"file://{tmp_path}/out", 150, known).collect()
    assert len(files) == 4
    got = {(r.doc, r.page): (r.height, r.width) for r in read_pages(spark, f"file://{tmp_path}/out/*").collect()}
    assert got == {("a", "page_0"): (6, 8), ("a", "page_1"): (6, 8), ("folder", "page_0"): (12, 17), ("folder", "page_1"): (12, 17)}


def jpeg(spark, img):
    """A baseline JPEG file of a grey image, by the JVM."""
    jvm = spark._jvm
    out = jvm.java.awt.image.BufferedImage(img.shape[1], img.shape[0], 10)
    for y, x in np.ndindex(*img.shape):
        out.getRaster().setSample(x, y, 0, int(img[y, x]))
    sink = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(out, "jpg", sink)
    return bytes(sink.toByteArray())


def test_jpeg_pages_and_damaged_files(spark, tmp_path):
    """JPEG pages become files like others; damaged and unknown ones are rows with a status, and the rest goes on."""
    smooth = np.add.outer(np.arange(16) * 4, np.arange(24) * 5).astype(np.uint8)
    page = b"<</Type/XObject/Subtype/Image/Width 24/Height 16/BitsPerComponent 8/ColorSpace/DeviceGray/Filter/%s/Length %d>>\nstream\n%s\nendstream"
    root = b"%PDF-1.4\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj\n<</Type/Pages/Count 1/MediaBox[0 0 144 72]/Kids[3 0 R]>>\nendobj\n3 0 obj\n<</Type/Page/Parent 2 0 R/Resources<</XObject<</I 4 0 R>>>>>>\nendobj\n4 0 obj\n"
    folder = tmp_path / "s" / "t"
    folder.mkdir(parents=True)
    coded = jpeg(spark, smooth)
    for name, coding, data in (("good", b"DCTDecode", coded), ("bad", b"DCTDecode", b"\xff\xd8 no image"), ("fax", b"CCITTFaxDecode", b"abc"), ("torn", b"FlateDecode", b"not deflated")):
        (tmp_path / "s" / f"{name}.pdf").write_bytes(root + page % (coding, len(data), data) + b"\nendobj\ntrailer<</Root 1 0 R>>\n")
    whole = tiff(IMG)
    (folder / "a.tif").write_bytes(whole)
    (folder / "b.tif").write_bytes(whole[: len(whole) // 2])
    rows = source.read_pdf(spark, f"file://{tmp_path}/s").unionByName(source.read_tiff(spark, f"file://{tmp_path}/s"))
    got = {(r.doc, r.name): r.status for r in source.unread(rows).collect()}
    assert set(got) == {("fax", "page_0"), ("torn", "page_0"), ("t", "b")}
    assert got["fax", "page_0"] == "SKIP: CCITTFaxDecode" and all(v.startswith("ERROR") for k, v in got.items() if k[0] != "fax")
    known = spark.createDataFrame([(d, 150) for d in ("good", "bad", "t")], "doc string, dpi int")
    done = source.convert(rows, f"file://{tmp_path}/out", 150, known).collect()
    assert sorted(r.path.rsplit("/", 2)[-2] for r in done) == ["good", "t"]
    pages = {r.doc: r for r in read_pages(spark, f"file://{tmp_path}/out/*").collect()}
    img = np.frombuffer(pages["good"].pixels, np.uint8).reshape(pages["good"].height, pages["good"].width)
    assert img.shape == smooth.shape and np.abs(img.astype(int) - smooth).max() < 12
    lost = source.unread(source.decoded(rows, f"file://{tmp_path}/again"))
    assert [(r.doc, r.status) for r in lost.filter("doc = 'bad'").collect()] == [("bad", "ERROR: JPEG")]


def test_damaged_arrays_and_tags(spark, tmp_path):
    from glyphkin.sources.files import read_npz, read_tiff_info

    folder = tmp_path / "d"
    folder.mkdir()
    np.savez_compressed(folder / "p_data.npz", char_imgs=np.zeros((2, 3, 4)), char_labels=np.array(["a", "b"]), char_word_idx=np.array([0, 0]))
    (folder / "q_data.npz").write_bytes(b"PK damaged")
    (folder / "r_data.npz").write_bytes(b"")
    assert {r.page for r in read_npz(spark, f"file://{tmp_path}").collect()} == {"p"}
    (folder / "a.tif").write_bytes(b"II*")
    (folder / "b.tif").write_bytes(tiff(IMG))
    assert {r.page: r.width_px for r in read_tiff_info(spark, f"file://{tmp_path}").collect()} == {"a": None, "b": 17}


def test_a_word_that_fails_loses_itself_only(spark, monkeypatch):
    from glyphkin.operators import glyphs

    page = np.full((160, 400), 230, np.uint8)
    words = []
    for k in range(3):
        chars = []
        for c in range(3):
            lo = 24 + 120 * k + 20 * c
            page[24:44, lo : lo + 6] = 20
            page[32:36, lo : lo + 14] = 20
            chars.append((c, "abc"[c], 22, 46, lo - 2, lo + 16))
        words.append((k, 20, 48, 20 + 120 * k, 86 + 120 * k, chars))
    words[1] = (*words[1][:5], [(0, "a", None, 46, 140, 150), (1, "b", 22, 46, 160, 170)])
    words.append((3, None, 48, 20, 86, []))
    char = "array<struct<char_idx: int, label: string, t: int, b: int, l: int, r: int>>"
    schema = f"doc string, page string, height int, width int, pixels binary, words array<struct<word_idx: int, t: int, b: int, l: int, r: int, chars: {char}>>"
    rows = [("d", "p", 160, 400, page.tobytes(), words), ("d", "null", 160, 400, None, words), ("d", "short", 160, 400, b"abc", words), ("d", "size", None, 400, page.tobytes(), words)]
    got = glyphs.process_pages(spark.createDataFrame(rows, schema), (128, 128), (64, 64)).collect()
    assert [r.status for r in got if r.page == "p" and r.kind == "status"] == ["OK: processed"]
    assert {(r.kind, r.word_idx) for r in got if r.page == "p" and r.kind in ("word", "word_status")} == {("word", 0), ("word_status", 1), ("word", 2), ("word_status", 3)}
    assert {r.word_idx for r in got if r.kind == "char"} == {0, 2}
    assert {r.page: r.status.split(":")[0] for r in got if r.kind == "status"} == {"p": "OK", "null": "ERROR", "short": "ERROR", "size": "ERROR"}


def test_detection(spark):
    """Two words of three letters, each seen by two neighbouring cells."""
    words, chars = [], []
    for k, row in enumerate((10, 40)):
        for dx in (0, 1):
            words.append(("d", "p", 20 + dx, row, 0.99 - dx / 100, 3.0, 3.0, 10.0 + dx, 10.0 - dx, 0.0, 1.0, 1.0, 400, 400))
        for i, letter in enumerate((0, 1, 2) if k == 0 else (2, 1, 0)):
            for dx in (0, 1):
                classes = [0.1, 0.1, 0.1]
                classes[letter] = 0.8
                chars.append(("d", "p", 13 + 6 * i + dx, row, 0.9 - dx / 10, 2.0, 2.0, 2.0 + dx, 2.0 - dx, classes, 1.0, 1.0))
    for x in range(60):
        words += [("d", "p", x, y, 0.96, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 400, 400) for y in (10, 40) if x not in (20, 21)]
    w = spark.createDataFrame(words, "doc string, page string, x int, y int, score double, t double, b double, l double, r double, angle double, scale_x double, scale_y double, width int, height int")
    c = spark.createDataFrame(chars, "doc string, page string, x int, y int, score double, t double, b double, l double, r double, classes array<double>, scale_x double, scale_y double")
    labels = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "id int, char string")
    got = detection.detect_words(w, c, labels).orderBy("word_idx").collect()
    assert [(r.text, r.tblr) for r in got] == [("ABC", [28, 52, 40, 120]), ("CBA", [148, 172, 40, 120])]
    assert got[0].text_score == pytest.approx(0.8) and [x.label for x in got[0].chars] == ["A", "B", "C"]


def test_corpus_steps(spark, tmp_path):
    """Drawn pages of three documents through all steps; a second run skips what is there."""
    rows = []
    char = lambda i, t, left, label: (i, label, t + 2, t + 26, left - 2, left + 16)
    for d in range(3):
        page = np.full((400, 500), 230, np.uint8)
        words = []
        for k in range(24):
            t, left = 20 + 60 * (k // 4), 20 + 110 * (k % 4)
            chars = []
            for i, label in enumerate("xo"):
                lo = left + 4 + 24 * i
                page[t + 4 : t + 24, lo : lo + 5] = 20
                if label == "o":
                    page[t + 4 : t + 8, lo : lo + 14] = 20
                else:
                    page[t + 18 : t + 24, lo : lo + 12] = 20
                chars.append(char(i, t, lo, label))
            words.append((k, t, t + 28, left, left + 60, chars))
        rows.append((f"d{d}", "p0", 400, 500, bytearray(page.tobytes()), words))
    inner = "array<struct<char_idx: int, label: string, t: int, b: int, l: int, r: int>>"
    schema = f"doc string, page string, height int, width int, pixels binary, words array<struct<word_idx: int, t: int, b: int, l: int, r: int, chars: {inner}>>"
    spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/c/pages")
    corpus = Corpus(spark, f"file://{tmp_path}/c", pages={"window": (128, 128), "step": (64, 64)}, initial={"components": 2}, refined={"least": 8, "register": False, "depth": 1})
    assert set(corpus.run().values()) == {"done"}
    assert corpus.table("glyphs").filter("kind = 'status'").select("status").distinct().collect()[0].status == "OK: processed"
    assert corpus.table("clusters").select("letter").distinct().count() == 2
    assert corpus.table("clusters").agg(F.min("share")).first()[0] >= 0.6
    assert set(corpus.run(skip_existing=True).values()) == {"skipped"}


def test_tiff_pages_are_numbered_without_lists_of_names(spark, tmp_path):
    from glyphkin.sources.files import packed

    names = {"a": ["b.tif", "B.TIFF", "b.tiff", "10.tif", "9.tif", "c.tif"], "d": [f"{k}.tif" for k in range(700)]}
    for doc, files in names.items():
        (tmp_path / doc).mkdir()
        for k, f in enumerate(files):
            (tmp_path / doc / f).write_bytes(b"no" if f == "c.tif" else scans.tiff_bytes(np.full((2, 3), k % 256, np.uint8), 300))
    path = f"file://{tmp_path}"
    rows = source.read_tiff(spark, path)
    got = sorted((r.doc, r.page, r.name, r.status) for r in rows.collect())
    want = []
    for doc, files in names.items():
        order = sorted(f.rsplit(".", 1)[0] for f in files)
        want += [(doc, order.index(f.rsplit(".", 1)[0]), f.rsplit(".", 1)[0], "ERROR: ValueError" if f == "c.tif" else "OK") for f in files]
    assert [g[:3] for g in got] == sorted(w[:3] for w in want) and [g[3][:2] for g in got] == [w[3][:2] for w in sorted(want)]
    assert {(r.doc, r.name, r.page) for r in source.tiff_pages(spark, path).collect()} == {(d, n, p) for d, p, n, _ in got}
    # a document's names in each of its rows would be quadratic in its pages
    assert "collect_list" not in rows._jdf.queryExecution().optimizedPlan().toString()
    found = source._tiffs(spark, path)
    assert found.rdd.getNumPartitions() > packed(found).rdd.getNumPartitions() == 16
