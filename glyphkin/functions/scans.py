"""Scanned pages out of TIFF and PDF files, in numpy and zlib: the encodings that need no further library.

TIFF: the first page, 1 or 8 bits, grey, palette or RGB; stored, PackBits, Deflate or LZW. PDF: the image objects of
each page in order, stored or Deflate (with PNG predictors); JPEG data is handed on as it is.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's variable-width codes: most significant bit first, 256 clears, 257 ends, widths grow one code early."""
    out = bytearray()
    entries: list[bytes] = []
    width, before, have, bits = 9, b"", 0, 0
    for byte in data:
        bits, have = bits << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code, bits = bits >> have, bits & ((1 << have) - 1)
        if code == 257:
            break
        if code == 256:
            entries = [bytes([i]) for i in range(256)] + [b"", b""]
            width, before = 9, b""
            continue
        word = entries[code] if code < len(entries) else before + before[:1]
        out += word
        if before:
            entries.append(before + word[:1])
        before = word
        # the reader is one entry behind the writer
        width = 9 if len(entries) < 511 else 10 if len(entries) < 1023 else 11 if len(entries) < 2047 else 12
    return bytes(out)


_UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


def _tags(data: bytes) -> dict[int, list]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", data, 4)[0]
    out: dict[int, list] = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        code = {1: "B", 3: "H", 4: "I"}.get(kind)
        if code:
            place = at + 10 + 12 * i
            if n * struct.calcsize(code) > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            out[tag] = list(struct.unpack_from(f"{order}{n}{code}", data, place))
    return out


def tiff_pixels(data: bytes) -> np.ndarray:
    """The first page as 8-bit (h, w) or (h, w, 3)."""
    tags = _tags(data)
    one = lambda t, default: tags.get(t, [default])[0]
    w, h, bits, samples = one(256, 0), one(257, 0), one(258, 1), one(277, 1)
    if one(259, 1) not in _UNPACK or bits not in (1, 8) or one(284, 1) != 1:
        raise ValueError("this kind of TIFF file can't be read")
    strips = [_UNPACK[one(259, 1)](data[a : a + n]) for a, n in zip(tags[273], tags[279])]
    row = (w * samples * bits + 7) // 8
    flat = np.frombuffer(b"".join(strips)[: row * h], np.uint8).reshape(h, row)
    if bits == 1:
        img = np.unpackbits(flat, axis=1)[:, :w] * np.uint8(255)
    else:
        img = flat.reshape(h, w, samples)
        if one(317, 1) == 2:
            img = np.cumsum(img, axis=1, dtype=np.uint8)
        img = img[..., 0] if samples < 3 else img[..., :3]
    kind = one(262, 1)
    if kind == 0:
        img = 255 - img
    if kind == 3:
        table = (np.array(tags[320]) >> 8).astype(np.uint8).reshape(3, -1)
        img = table[:, img].transpose(1, 2, 0)
    return img


def lanczos(img: np.ndarray, h: int, w: int, lobes: int = 3) -> np.ndarray:
    """8-bit resampling with the windowed sinc, widened where the image shrinks."""

    def matrix(n: int, m: int) -> np.ndarray:
        scale = n / m
        wide = max(scale, 1.0)
        x = (np.arange(n) + 0.5 - (np.arange(m)[:, None] + 0.5) * scale) / wide
        k = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0)
        return k / k.sum(1, keepdims=True)

    out = np.tensordot(matrix(img.shape[0], h), img.astype(float), 1)
    out = np.moveaxis(np.tensordot(matrix(img.shape[1], w), out, (1, 1)), 0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def rescaled(img: np.ndarray, original: float, target: float, tolerance: float = 0.01) -> np.ndarray:
    """An image at a target resolution, untouched where that changes next to nothing."""
    scale = target / original if original else 1.0
    if abs(scale - 1) <= tolerance:
        return img
    return lanczos(img, int(img.shape[0] * scale), int(img.shape[1] * scale))


def grey(img: np.ndarray) -> np.ndarray:
    """Luma of an RGB image (ITU-R 601)."""
    return img if img.ndim == 2 else np.rint(img @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


@dataclass
class PdfImage:
    width: int
    height: int
    bits: int
    coding: str
    data: bytes
    predictor: int = 1
    channels: int = 1
    mask: PdfImage | None = None

    def pixels(self) -> np.ndarray | None:
        """(h, w) or (h, w, channels); None for codings that can't be read here."""
        if self.coding not in ("", "FlateDecode") or self.bits not in (1, 8):
            return None
        raw = zlib.decompress(self.data) if self.coding else self.data
        row = (self.width * self.channels * self.bits + 7) // 8
        if self.predictor >= 10:
            raw = _unpredicted(raw, row, max(1, self.channels * self.bits // 8))
        flat = np.frombuffer(raw[: row * self.height], np.uint8).reshape(self.height, row)
        if self.bits == 1:
            return np.unpackbits(flat, axis=1)[:, : self.width] * np.uint8(255)
        img = flat.reshape(self.height, self.width, self.channels)
        return img[..., 0] if self.channels == 1 else img


def _unpredicted(raw: bytes, row: int, step: int) -> bytes:
    """PNG's row filters undone."""
    above = np.zeros(row, np.int64)
    out = []
    for i in range(0, len(raw) - row, row + 1):
        kind, line = raw[i], np.frombuffer(raw, np.uint8, row, i + 1).astype(np.int64)
        if kind == 2:
            line = (line + above) % 256
        elif kind:
            done = np.zeros(row + step, np.int64)
            up = np.concatenate([np.zeros(step, np.int64), above])
            for j in range(row):
                a, b, c = int(done[j]), int(above[j]), int(up[j])
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((a, b, c), key=lambda v: abs(a + b - c - v))
                done[j + step] = (line[j] + guess) % 256
            line = done[step:]
        above = line
        out.append(line.astype(np.uint8).tobytes())
    return b"".join(out)


@dataclass
class PdfPage:
    width_pt: float
    height_pt: float
    images: list[PdfImage] = field(default_factory=list)


class Pdf:
    """Objects by number, found by scanning the file; good enough for scans, whatever the state of its tables."""

    def __init__(self, data: bytes) -> None:
        self.objects: dict[int, bytes] = {}
        for m in re.finditer(rb"(?:^|[\r\n\s])(\d+)\s+\d+\s+obj\b(.*?)endobj", data, re.S):
            self.objects[int(m[1])] = m[2]
        for body in list(self.objects.values()):
            if b"/ObjStm" in body.split(b"stream", 1)[0]:
                self._packed(body)

    def _packed(self, body: bytes) -> None:
        head, data = self.stream(body)
        data = zlib.decompress(data) if b"FlateDecode" in head else data
        n, first = int(self.number(head, b"N")), int(self.number(head, b"First"))
        numbers = list(map(int, data[:first].split()[: 2 * n]))
        ends = [*numbers[3::2], len(data) - first]
        for k, at, end in zip(numbers[::2], numbers[1::2], ends):
            self.objects.setdefault(k, data[first + at : first + end])

    def stream(self, body: bytes) -> tuple[bytes, bytes]:
        head, _, rest = body.partition(b"stream")
        rest = rest[2:] if rest[:2] == b"\r\n" else rest[1:]
        size = self.number(head, b"Length")
        return head, rest[: int(size)] if size is not None else rest.rpartition(b"endstream")[0]

    def number(self, body: bytes, key: bytes) -> float | None:
        if m := re.search(rb"/" + key + rb"\s+(\d+)\s+\d+\s+R\b", body):
            return float(self.objects.get(int(m[1]), b"0").split()[0])
        m = re.search(rb"/" + key + rb"\s+(-?[\d.]+)", body)
        return float(m[1]) if m else None

    def part(self, body: bytes, key: bytes) -> bytes:
        """A dictionary or array below a key, by reference or in place."""
        if m := re.search(rb"/" + key + rb"\s+(\d+)\s+\d+\s+R\b", body):
            return self.objects.get(int(m[1]), b"")
        m = re.search(rb"/" + key + rb"\s*(<<|\[)", body)
        if not m:
            return b""
        opening, closing = (b"<<", b">>") if m[1] == b"<<" else (b"[", b"]")
        depth = 0
        for t in re.finditer(re.escape(opening) + rb"|" + re.escape(closing), body[m.start(1) :]):
            depth += 1 if t[0] == opening else -1
            if not depth:
                return body[m.start(1) : m.start(1) + t.end()]
        return body[m.start(1) :]

    def pages(self) -> list[PdfPage]:
        roots = [k for k, v in self.objects.items() if re.search(rb"/Type\s*/Pages\b", v) and b"/Parent" not in v]
        out: list[PdfPage] = []
        seen: set[int] = set()

        def walk(number: int, inherited: bytes) -> None:
            body = self.objects.get(number, b"")
            if number in seen:
                return
            seen.add(number)
            if re.search(rb"/Type\s*/Pages\b", body):
                for k in re.findall(rb"(\d+)\s+\d+\s+R", self.part(body, b"Kids")):
                    walk(int(k), body + inherited)
            else:
                out.append(self._page(body + inherited))

        for r in roots:
            walk(r, b"")
        return out

    def _page(self, body: bytes) -> PdfPage:
        box = [float(x) for x in re.findall(rb"-?[\d.]+", self.part(body, b"MediaBox"))] or [0, 0, 0, 0]
        page = PdfPage(box[2] - box[0], box[3] - box[1])
        for k in re.findall(rb"/[^\s/]+\s+(\d+)\s+\d+\s+R", self.part(self.part(body, b"Resources"), b"XObject")):
            if img := self.image(int(k)):
                page.images.append(img)
        return page

    def image(self, number: int) -> PdfImage | None:
        body = self.objects.get(number, b"")
        if not re.search(rb"/Subtype\s*/Image\b", body.split(b"stream", 1)[0]):
            return None
        head, data = self.stream(body)
        coding = re.search(rb"/Filter\s*\[?\s*/(\w+)", head)
        space = re.search(rb"/ColorSpace\s*(?:\[\s*)?/(\w+)", head)
        channels = {b"DeviceRGB": 3, b"CalRGB": 3, b"DeviceCMYK": 4}.get(space[1], 1) if space else 1
        if space and space[1] == b"ICCBased" and (m := re.search(rb"/ICCBased\s+(\d+)", head)):
            channels = int(self.number(self.objects.get(int(m[1]), b"").split(b"stream", 1)[0], b"N") or 3)
        mask = re.search(rb"/SMask\s+(\d+)", head)
        value = lambda key, default: int(self.number(head, key) or default)
        return PdfImage(value(b"Width", 0), value(b"Height", 0), value(b"BitsPerComponent", 8), coding[1].decode() if coding else "", data, value(b"Predictor", 1), channels, self.image(int(mask[1])) if mask else None)


def layered(page: PdfPage) -> np.ndarray | None:
    """Background with the text layer laid over it where its mask is set; the first image alone if there is no more."""
    back = page.images[0].pixels() if page.images else None
    if back is None or len(page.images) < 2 or page.images[1].mask is None:
        return back
    front, mask = page.images[1].pixels(), page.images[1].mask.pixels()
    if front is None or mask is None or mask.shape != back.shape[:2]:
        return back
    front = lanczos(front, *back.shape[:2]) if front.shape[:2] != back.shape[:2] else front
    return np.where(mask[..., None] > 0 if back.ndim == 3 else mask > 0, front, back)


def tiff_bytes(img: np.ndarray, dpi: int = 0) -> bytes:
    """An 8-bit grey image as a TIFF file with one Deflate strip."""
    data = zlib.compress(np.ascontiguousarray(img, np.uint8).tobytes())
    at = 8 + len(data)
    tags = [(256, 4, img.shape[1]), (257, 4, img.shape[0]), (258, 3, 8), (259, 3, 8), (262, 3, 1), (273, 4, 8), (277, 3, 1), (279, 4, len(data))]
    if dpi:
        place = at + 2 + 12 * 11 + 4
        tags += [(282, 5, place), (283, 5, place), (296, 3, 2)]
    body = b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags)
    return b"II" + struct.pack("<HI", 42, at) + data + struct.pack("<H", len(tags)) + body + struct.pack("<I", 0) + struct.pack("<II", dpi or 1, 1)


def pdf_bytes(images: list[np.ndarray], width_pt: float, height_pt: float, layers: list[tuple[np.ndarray, np.ndarray]] | None = None) -> bytes:
    """A PDF file with one grey image a page, and on each a second one with a mask if given."""

    def image(number: int, img: np.ndarray, mask: int | None = None) -> bytes:
        data = zlib.compress(np.ascontiguousarray(img, np.uint8).tobytes())
        soft = b"/SMask %d 0 R" % mask if mask else b""
        head = b"<</Type/XObject/Subtype/Image/Width %d/Height %d/BitsPerComponent 8/ColorSpace/DeviceGray%s/Filter/FlateDecode/Length %d>>" % (img.shape[1], img.shape[0], soft, len(data))
        return b"%d 0 obj\n%s\nstream\n%s\nendstream\nendobj\n" % (number, head, data)

    out, kids = [], []
    for k, img in enumerate(images):
        n = 10 + 10 * k
        names = b"/A %d 0 R" % n
        out.append(image(n, img))
        if layers:
            out += [image(n + 2, layers[k][1]), image(n + 1, layers[k][0], n + 2)]
            names += b" /B %d 0 R" % (n + 1)
        out.append(b"%d 0 obj\n<</Type/Page/Parent 2 0 R/Resources<</XObject<<%s>>>>>>\nendobj\n" % (n + 3, names))
        kids.append(b"%d 0 R" % (n + 3))
    tree = b"2 0 obj\n<</Type/Pages/Count %d/MediaBox[0 0 %g %g]/Kids[%s]>>\nendobj\n" % (len(kids), width_pt, height_pt, b" ".join(kids))
    return b"%PDF-1.4\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n" + tree + b"".join(out) + b"trailer<</Root 1 0 R>>\n"
