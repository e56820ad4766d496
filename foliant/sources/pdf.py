"""PDF files: pages with their native text, metadata and embedded images, by the standard library alone.

Text is read as Latin-1 or UTF-16; fonts with encodings of their own, and encrypted files, give what bytes they have.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import files

OBJECT = re.compile(rb"(?:^|[\r\n \t])(\d+) +\d+ +obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+.\d]+|[A-Za-z'\"*]+\*?", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Of a glyph's width nothing is known: so much of the font's size.
GLYPH = 0.5

SPAN = "struct<text: string, x1: double, y1: double, x2: double, y2: double, font: string, size: double>"
PAGE = f"path string, page_num int, width double, height double, spans array<{SPAN}>, error string"


class File:
    """The objects of a file, by number: dictionary and inflated stream."""

    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF"):
            raise ValueError("not a PDF")
        self.objects: dict[int, tuple[bytes, bytes]] = {}
        for m in OBJECT.finditer(data):
            self._add(int(m[1]), m[2])
        for head, body in list(self.objects.values()):
            if b"/ObjStm" in head:
                first = int(re.search(rb"/First\s+(\d+)", head)[1])
                numbers = list(map(int, body[:first].split()))
                places = [*numbers[1::2], len(body) - first]
                for number, a, b in zip(numbers[::2], places, places[1:], strict=False):
                    self.objects.setdefault(number, (body[first + a : first + b], b""))

    def _add(self, number: int, raw: bytes) -> None:
        found = STREAM.search(raw)
        head, body = (raw[: found.start()], found[1]) if found else (raw, b"")
        if found and b"/FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                body = b""
        self.objects[number] = (head, body)

    def refs(self, head: bytes, key: bytes) -> list[int]:
        m = re.search(key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", head)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def pages(self) -> list[int]:
        """In the order of the tree; in that of the file if there is no tree."""
        found: list[int] = []
        seen: set[int] = set()
        waiting = [n for n, (h, _) in self.objects.items() if re.search(rb"/Type\s*/Pages\b", h) and b"/Parent" not in h][:1]
        while waiting:
            n = waiting.pop(0)
            if n in seen or n not in self.objects:
                continue
            seen.add(n)
            if kids := self.refs(self.objects[n][0], rb"/Kids"):
                waiting = kids + waiting
            elif re.search(rb"/Type\s*/Page\b", self.objects[n][0]):
                found.append(n)
        return found or [n for n, (h, _) in self.objects.items() if re.search(rb"/Type\s*/Page\b", h)]

    def box(self, page: int) -> tuple[float, float]:
        m = re.search(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", self.objects[page][0])
        a, b, c, d = map(float, m.groups()) if m else (0.0, 0.0, 612.0, 792.0)
        return c - a, d - b

    def spans(self, page: int) -> list[dict]:
        """Non-blank strings shown on a page, with boxes from its top left corner."""
        content = b"\n".join(self.objects[n][1] for n in self.refs(self.objects[page][0], rb"/Contents") if n in self.objects)
        height, out, stack = self.box(page)[1], [], []
        font, size, x, y, left, lead, inside = "", 0.0, 0.0, 0.0, 0.0, 0.0, None

        def number(i: int) -> float:
            try:
                return float(stack[i])
            except (ValueError, IndexError, TypeError):
                return 0.0

        def show(parts: list[bytes]) -> None:
            nonlocal x
            text = "".join(map(_text, parts))
            wide = GLYPH * size * len(text)
            if text.strip():
                out.append({"text": text, "x1": x, "y1": height - y - size, "x2": x + wide, "y2": height - y, "font": font, "size": size})
            x += wide

        for m in TOKEN.finditer(content):
            t = m[0]
            if t == b"[":
                inside = []
            elif t == b"]":
                stack.append(inside or [])
                inside = None
            elif t[:1] in b"(<" and t[:1]:
                (stack if inside is None else inside).append(t)
            elif t[:1] == b"/" or t[:1] in b"-+.0123456789":
                if inside is None:
                    stack.append(t)
            else:
                if t == b"BT":
                    x = y = left = 0.0
                elif t == b"Tf" and len(stack) > 1:
                    font, size = bytes(stack[-2])[1:].decode("latin-1"), number(-1)
                elif t == b"TL":
                    lead = number(-1)
                elif t in (b"Td", b"TD"):
                    left, y = left + number(-2), y + number(-1)
                    x, lead = left, -number(-1) if t == b"TD" else lead
                elif t == b"Tm":
                    left = x = number(-2)
                    y = number(-1)
                elif t in (b"T*", b"'", b'"'):
                    x, y = left, y - lead
                if t in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
                    show([stack[-1]])
                elif t == b"TJ" and stack and isinstance(stack[-1], list):
                    show(stack[-1])
                stack.clear()
        return out

    def images(self) -> list[tuple[str, int, int, bytes]]:
        out = []
        for head, body in self.objects.values():
            if re.search(rb"/Subtype\s*/Image\b", head):
                size = [int(m[1]) if (m := re.search(key + rb"\s+(\d+)", head)) else 0 for key in (rb"/Width", rb"/Height")]
                out.append(("jpeg" if b"/DCTDecode" in head else "raw", *size, body))
        return out

    def metadata(self) -> dict:
        heads = [h for h, _ in self.objects.values()]
        some = lambda pattern: any(re.search(pattern, h) for h in heads)
        return {
            "page_count": len(self.pages()), "has_toc": some(rb"/Outlines\b"), "has_links": some(rb"/Subtype\s*/Link\b"), "has_images": some(rb"/Subtype\s*/Image\b"),
            "form_fields": sum(bool(re.search(rb"/FT\s*/", h)) for h in heads),
        }


def _text(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1]).decode()
        raw = bytes.fromhex(digits + "0" * (len(digits) % 2))
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes((int(m[1], 8) & 255,)) if m[1][:1].isdigit() else b"" if m[1][-1:] == b"\n" else ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def pages(spark: SparkSession, path: str, max_pages: int | None = None) -> DataFrame:
    """A row per page: path, page_num, width, height, spans, error; pages beyond max_pages aren't read. A file that can't
    be read is one row with its error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for p, content in zip(x["path"], x["content"], strict=True):
                try:
                    file = File(bytes(content))
                    rows += [(p, i, *file.box(n), file.spans(n), None) for i, n in enumerate(file.pages()[:max_pages], 1)]
                except Exception as e:
                    rows.append((p, 0, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_num", "width", "height", "spans", "error"])

    return files(spark, path, "*.pdf").select("path", "content").mapInPandas(read, PAGE)


def scanned(spans: Column) -> Column:
    """A page without native text is a scan."""
    return F.coalesce(F.size(spans), F.lit(0)) <= 0


def tokens(pages: DataFrame) -> DataFrame:
    """Native spans as tokens, confidence 1."""
    each = pages.select("path", "page_num", F.posexplode("spans").alias("pos", "s"))
    box = [F.col(f"s.{c}").cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")]
    return each.select("path", "page_num", "pos", F.col("s.text").alias("text"), *box, F.lit(1.0).alias("confidence"), F.lit("native").alias("engine"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A row per file: path, bytes, page_count, has_toc, has_links, has_images, form_fields."""

    @F.pandas_udf("page_count int, has_toc boolean, has_links boolean, has_images boolean, form_fields int")
    def read(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([File(bytes(c)).metadata() if bytes(c[:4]) == b"%PDF" else {} for c in contents], columns=["page_count", "has_toc", "has_links", "has_images", "form_fields"])

    return files(spark, path, "*.pdf").select("path", "bytes", read("content").alias("m")).select("path", "bytes", "m.*")


def images(spark: SparkSession, path: str) -> DataFrame:
    """A row per embedded image: path, image_num (from 1), kind (jpeg or raw samples), width, height, content."""

    @F.pandas_udf("array<struct<kind: string, width: int, height: int, content: binary>>")
    def read(contents: pd.Series) -> pd.Series:
        keys = ("kind", "width", "height", "content")
        return pd.Series([[dict(zip(keys, i, strict=True)) for i in File(bytes(c)).images()] if bytes(c[:4]) == b"%PDF" else [] for c in contents])

    found = files(spark, path, "*.pdf").select("path", F.posexplode(read("content")).alias("i", "m"))
    return found.select("path", (F.col("i") + 1).alias("image_num"), "m.*")
