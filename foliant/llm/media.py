"""Media columns: progressive JPEG, decoded by accumulating scans into coefficient arrays and transforming them in numpy."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

# Fixed by the format.
SOI, EOI, SOS, DQT, DHT, DRI, COM, SOF2 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xFE, 0xC2
#: Index in a block of 8 x 8 of each coefficient in zigzag order: along the diagonals, in turn up and down.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))

#: The cosine basis, and the inverse transform of a block's 64 coefficients in zigzag order to its 64 samples.
BASIS = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)], np.float32)
INVERSE = np.kron(BASIS, BASIS)[ZIGZAG]
MARKER, RESTART = re.compile(rb"\xff[^\x00\xd0-\xd7]"), re.compile(rb"\xff[\xd0-\xd7]")
#: Rows of MCUs that are transformed at a time.
STRIP = 64


@lru_cache(256)
def _inverse(steps: bytes) -> np.ndarray:
    """The inverse transform, with the quantizer's steps (32-bit) in it."""
    return INVERSE * np.frombuffer(steps, np.int32)[:, None].astype(np.float32)


@lru_cache(256)
def _grids(mcus_high: int, mcus_wide: int, v: int, h: int, high: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """A component's blocks in the order of its own scans, and of scans of several components (a row for each MCU)."""
    grid = np.arange(mcus_high * v * mcus_wide * h)
    own = grid.reshape(mcus_high * v, mcus_wide * h)[:high, :wide].reshape(-1, 1)
    return own, grid.reshape(mcus_high, v, mcus_wide, h).transpose(0, 2, 1, 3).reshape(mcus_high * mcus_wide, v * h)


class Table:
    """A Huffman table, from the number of codes of each length (1 to 16) and the symbols in order."""

    def __init__(self, lengths: bytes, symbols: bytes):
        self.codes, code, at = {}, 0, 0
        for n, count in enumerate(lengths, 1):
            for _ in range(count):
                self.codes[n, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        #: By the next 16 bits: the symbol whose code they begin with, and the code's length (0 if there is none).
        self.ahead: list[tuple[int, int]] = [(0, 0)] * (1 << 16)
        for (n, code), symbol in self.codes.items():
            self.ahead[code << (16 - n) : (code + 1) << (16 - n)] = [(symbol, n)] * (1 << (16 - n))
        #: The symbol and the length of its code (zeros), if the table has one only: then codes have fixed places.
        self.only = (symbols[0], next(n for n, c in enumerate(lengths, 1) if c)) if len(symbols) == 1 else None


@lru_cache(32)
def _table(lengths: bytes, symbols: bytes) -> Table:
    return Table(lengths, symbols)


class Bits:
    """The bits of a scan between two restart markers."""

    def __init__(self, data: bytes):
        self.data, self.at = np.frombuffer(data, np.uint8), 0
        self.all: np.ndarray | None = None
        self.windows: list[int] | None = None

    @property
    def bits(self) -> np.ndarray:
        if self.all is None:
            self.all = np.unpackbits(self.data)
        return self.all

    def take(self, n: int) -> np.ndarray:
        out = self.bits[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("a scan ends too early")
        self.at += n
        return out

    @property
    def ahead(self) -> list[int]:
        """For each byte the number of four bytes that begins with it; bits 1 follow the end."""
        if self.windows is None:
            padded = np.concatenate([self.data, np.full(4, 255, np.uint8)]).astype(np.uint32)
            self.windows = (padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]).tolist()
        return self.windows

    def number(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("a scan ends too early")
        out = (self.ahead[self.at >> 3] << (self.at & 7) & 0xFFFFFFFF) >> (32 - n) if n else 0
        self.at += n
        return out

    def symbol(self, table: Table) -> int:
        if self.at >= 8 * len(self.data):
            raise ValueError("a scan ends too early")
        symbol, n = table.ahead[self.ahead[self.at >> 3] >> (16 - (self.at & 7)) & 0xFFFF]
        if not n:
            raise ValueError("no such code")
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("a scan ends too early")
        return symbol

    def signed(self, n: int) -> int:
        v = self.number(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def fixed(self, table: Table, count: int) -> np.ndarray | None:
        """`count` signed numbers at once, if the table has one symbol with run 0 (the code's bits are all 0)."""
        if table.only is None or table.only[0] >> 4:
            return None
        size, length = table.only
        if not size:
            if self.take(count * length).any():
                raise ValueError("no such code")
            return np.zeros(count, np.int32)
        if length + size == 8 and not self.at % 8:
            values = self.data[self.at // 8 : self.at // 8 + count]
            self.at += 8 * count
            wrong = len(values) < count or (values >> size).any()
        else:
            rows = self.take(count * (length + size)).reshape(count, length + size)
            wrong = rows[:, :length].any()
            wide = np.zeros((count, 16), np.uint8)
            wide[:, 16 - size :] = rows[:, length:]
            values = np.packbits(wide, axis=1).view(">u2")[:, 0]
        if wrong:
            raise ValueError("no such code")
        values = values.astype(np.int32)
        return np.where(values >> (size - 1), values, values - (1 << size) + 1)


class Component:
    def __init__(self, h: int, v: int, table: int):
        self.h, self.v, self.table = h, v, table

    def size(self, width: int, height: int, most_h: int, most_v: int) -> None:
        """Blocks of the component's own size, and of the whole MCUs that the array is for."""
        self.wide, self.high = -(-(-(-width * self.h // most_h)) // 8), -(-(-(-height * self.v // most_v)) // 8)
        mcus_wide, mcus_high = -(-width // (8 * most_h)), -(-height // (8 * most_v))
        self.coefficients = np.zeros((mcus_high * self.v, mcus_wide * self.h, 64), np.int32)
        self.own, self.together = _grids(mcus_high, mcus_wide, self.v, self.h, self.high, self.wide)


class Image:
    """A progressive JPEG: its coefficient arrays after all scans."""

    def __init__(self, data: bytes):
        self.quantizers: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], Table] = {}
        self.components: dict[int, Component] = {}
        self.comment, self.restart, self.width = b"", 0, 0
        if data[:2] != bytes((0xFF, SOI)):
            raise ValueError("not a JPEG")
        at = 2
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            kind = data[at + 1]
            if kind == EOI:
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind == SOS:
                at = self.scan(body, data, at)
            elif kind == DQT:
                while body:
                    wide = body[0] >> 4
                    self.quantizers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int32)
                    body = body[129 if wide else 65 :]
            elif kind == DHT:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0] >> 4, body[0] & 15] = _table(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif kind == SOF2:
                depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8 or n not in (1, 3):
                    raise ValueError("only 8 bits and 1 or 3 components")
                self.components = {body[i]: Component(body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)}
                self.most_h, self.most_v = max(c.h for c in self.components.values()), max(c.v for c in self.components.values())
                for c in self.components.values():
                    c.size(self.width, self.height, self.most_h, self.most_v)
            elif 0xC0 <= kind <= 0xCF and kind != 0xCC and kind != 0xC8:
                raise ValueError("not a progressive JPEG")
            elif kind == DRI:
                self.restart = struct.unpack(">H", body)[0]
            elif kind == COM:
                self.comment = body

    def scan(self, head: bytes, data: bytes, at: int) -> int:
        """Accumulates one scan; returns where the next marker stands."""
        n = head[0]
        chosen = [(self.components[head[1 + 2 * i]], head[2 + 2 * i]) for i in range(n)]
        first, last, steps = head[1 + 2 * n : 4 + 2 * n]
        high, low = steps >> 4, steps & 15
        end = MARKER.search(data, at).start()
        pieces = RESTART.split(data[at:end]) if self.restart else [data[at:end]]
        if len(chosen) == 1:
            c, tables = chosen[0]
            # Blocks in rows; those beyond the component's own size aren't in the scan.
            units = [(c, tables, c.own)]
        else:
            units = [(c, tables, c.together) for c, tables in chosen]
        total, each = len(units[0][2]), self.restart or len(units[0][2])
        for i, piece in zip(range(0, total, each), pieces, strict=False):
            bits, part = Bits(piece.replace(b"\xff\x00", b"\xff")), [(c, t, g[i : i + each]) for c, t, g in units]
            if first == 0:
                if high:
                    self.refine_dc(bits, part, low)
                else:
                    self.first_dc(bits, part, low)
            else:
                c, t, g = part[0]
                blocks = c.coefficients.reshape(-1, 64)
                if high:
                    self.refine_ac(bits, self.tables[1, t & 15], blocks, g[:, 0], first, last, low)
                else:
                    self.first_ac(bits, self.tables[1, t & 15], blocks, g[:, 0], first, last, low)
        return end

    def refine_dc(self, bits: Bits, part: list, low: int) -> None:
        per = [g.shape[1] for _, _, g in part]
        rows = bits.take(len(part[0][2]) * sum(per)).reshape(-1, sum(per)).astype(np.int32)
        for (c, _, g), a, b in zip(part, np.cumsum([0, *per]), np.cumsum(per), strict=False):
            c.coefficients.reshape(-1, 64)[g.ravel(), 0] |= rows[:, a:b].ravel() << low

    def first_dc(self, bits: Bits, part: list, low: int) -> None:
        per, tables = [g.shape[1] for _, _, g in part], [self.tables[0, t >> 4] for _, t, _ in part]
        count = len(part[0][2])
        if all(t.only is not None and t.only == tables[0].only for t in tables):
            rows = bits.fixed(tables[0], count * sum(per)).reshape(count, sum(per))
        else:
            rows = np.array([[bits.signed(bits.symbol(t)) for t, n in zip(tables, per, strict=True) for _ in range(n)] for _ in range(count)], np.int32)
        for (c, _, g), a, b in zip(part, np.cumsum([0, *per]), np.cumsum(per), strict=False):
            c.coefficients.reshape(-1, 64)[g.ravel(), 0] = np.cumsum(rows[:, a:b].ravel()) << low

    @staticmethod
    def first_ac(bits: Bits, table: Table, blocks: np.ndarray, order: np.ndarray, first: int, last: int, low: int) -> None:
        width = last - first + 1
        if table.only is not None and table.only[0] and not table.only[0] >> 4:
            blocks[order, first : last + 1] = bits.fixed(table, len(order) * width).reshape(-1, width) * (1 << low)
            return
        i = 0
        while i < len(order):
            k = first
            while k <= last:
                run, size = divmod(bits.symbol(table), 16)
                if size:
                    k += run
                    blocks[order[i], k] = bits.signed(size) * (1 << low)
                    k += 1
                elif run == 15:
                    k += 16
                else:
                    i += (1 << run) + bits.number(run) - 1
                    break
            i += 1

    @staticmethod
    def refine_ac(bits: Bits, table: Table, blocks: np.ndarray, order: np.ndarray, first: int, last: int, low: int) -> None:
        """Corrects known coefficients by a bit each, and places new ones; a run of ended blocks is corrected at once."""
        one = 1 << low

        def correct(rows: np.ndarray, a: int) -> None:
            band = blocks[rows, a : last + 1]
            known = band != 0
            band[known] += np.sign(band[known]) * bits.take(int(known.sum())).astype(np.int32) * one
            blocks[rows, a : last + 1] = band

        i = 0
        while i < len(order):
            k, block = first, blocks[order[i]]
            while k <= last:
                run, size = divmod(bits.symbol(table), 16)
                if not size and run < 15:
                    ended = (1 << run) + bits.number(run)
                    if k > first:
                        correct(order[i : i + 1], k)
                        i, ended = i + 1, ended - 1
                    if ended:
                        correct(order[i : i + ended], first)
                    i += ended - 1
                    break
                new = (one if bits.number(1) else -one) if size else 0
                while k <= last:
                    if block[k]:
                        if bits.number(1):
                            block[k] += one if block[k] > 0 else -one
                    elif run:
                        run -= 1
                    else:
                        break
                    k += 1
                if new and k <= last:
                    block[k] = new
                k += 1
            i += 1

    def rgb(self) -> np.ndarray:
        """(height, width, 3) uint8: inverse transform, chroma repeated to full resolution, colours converted."""
        out = np.empty((self.height, self.width, 3), np.uint8)
        step = 8 * self.most_v
        for top in range(0, -(-self.height // step), STRIP):
            planes = []
            for c in self.components.values():
                part = c.coefficients[top * c.v : (top + STRIP) * c.v]
                samples = part.reshape(-1, 64).astype(np.float32) @ _inverse(self.quantizers[c.table].tobytes())
                plane = samples.reshape(len(part), part.shape[1], 8, 8).swapaxes(1, 2).reshape(len(part) * 8, -1)
                planes.append(np.clip(np.rint(plane), -128, 127))
            rows = out[top * step : (top + STRIP) * step]
            y = self._full(planes[0] + 128, next(iter(self.components.values())))[: len(rows), : self.width]
            if len(planes) == 1:
                rows[:] = y[:, :, None]
                continue
            (b, r), cb, cr = planes[1:], *[*self.components.values()][1:]
            if (cb.h, cb.v) != (cr.h, cr.v):
                b, r, cb, cr = self._full(b, cb), self._full(r, cr), None, None
            for i, chroma in enumerate((1.402 * r, -0.344136 * b - 0.714136 * r, 1.772 * b)):
                plane = self._full(chroma, cb)[: len(rows), : self.width]
                rows[:, :, i] = np.clip(np.rint(y + plane), 0, 255)
        return out

    def _full(self, plane: np.ndarray, c: Component | None) -> np.ndarray:
        """A component's plane at full resolution, each sample repeated."""
        if c is None or (c.h, c.v) == (self.most_h, self.most_v):
            return plane
        return plane.repeat(self.most_v // c.v, 0).repeat(self.most_h // c.h, 1)


# Bytes as coefficients: each block of an image with halved chroma carries 48 bytes, each MCU of six blocks 288.

CARRIED, UNIT, PADDING = 48, 288, 576


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _scan(parts: list[int], tables: int, first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes((len(parts), *(x for c in parts for x in (c, tables)), first, last, high << 4 | low))
    return _segment(SOS, head) + data.replace(b"\xff", b"\xff\x00")


def _packed(bits: np.ndarray) -> bytes:
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def _zeros(n: int) -> bytes:
    """n bits 0, then bits 1 up to a byte's end."""
    return bytes(n // 8) + (bytes((0xFF >> n % 8,)) if n % 8 else b"")


def carry(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients 1 to 48 of each block are the payload's bytes, so that it can be read back.

    A byte b is the coefficient b if it is at least 128, else b - 255: all have magnitudes of 128 to 255, so that the first
    scans (luma in two bands, without the lowest bit) have one Huffman symbol and the lowest bits follow in refinement scans.
    The payload's length is in a comment; MCUs beyond it carry bytes 255.
    """
    units = max(1, -(-len(payload) // UNIT))
    wide = math.isqrt(units)
    high = -(-units // wide)
    values = np.full(wide * high * UNIT, 255, np.uint8)
    values[: len(payload)] = np.frombuffer(payload, np.uint8)
    n = wide * high
    planes = [(1, values[: n * 192]), (2, values[n * 192 : n * 240]), (3, values[n * 240 :])]
    ends = bytes(range(0, 0xF0, 0x10))
    out = [
        bytes((0xFF, SOI)), _segment(COM, str(len(payload)).encode()), _segment(DQT, b"\x00" + b"\x01" * 64),
        _segment(SOF2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes((1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))),
        _segment(DHT, b"\x00" + bytes((1, *[0] * 15)) + b"\x00" + b"\x10" + bytes((1, *[0] * 15)) + b"\x07" + b"\x11" + bytes((0, 0, 0, len(ends), *[0] * 12)) + ends),
        _scan([1, 2, 3], 0x00, 0, 0, 0, 0, _zeros(n * 6)),
    ]
    rows = [(c, x.reshape(-1, CARRIED)) for c, x in planes]
    half = CARRIED // 2
    for c, x in rows:
        # The code is one bit 0, then seven bits: b >> 1.
        for a, b in ((0, half), (half, CARRIED)) if c == 1 else ((0, CARRIED),):
            out.append(_scan([c], 0x00, 1 + a, b, 0, 1, (x[:, a:b] >> 1).tobytes()))
    for c, x in rows:
        bits, at = [], 0
        while at < len(x):
            run = min(len(x) - at, 32767)
            k = run.bit_length() - 1
            code = [k >> i & 1 for i in (3, 2, 1, 0)] + [(run - (1 << k)) >> i & 1 for i in range(k - 1, -1, -1)]
            part = x[at : at + run].ravel()
            bits += [np.array(code, np.uint8), (part & 1) ^ (part < 128)]
            at += run
        out.append(_scan([c], 0x01, 1, CARRIED, 1, 0, _packed(np.concatenate(bits))))
    return b"".join(out) + bytes((0xFF, EOI))


def carried(image: Image) -> bytes:
    """The payload of carry(), from the decoded coefficients."""
    values = np.concatenate([c.coefficients[:, :, 1 : CARRIED + 1].ravel() for c in image.components.values()])
    return np.where(values > 0, values, values + 255).astype(np.uint8).tobytes()[: int(image.comment)]


def decoded(df: DataFrame, content: str) -> DataFrame:
    """The rows of df with `height`, `width` and `rgb` (bytes of the full-resolution tensor) of a column of progressive
    JPEGs; all three are null for null. Columns of these names are replaced. What is no progressive JPEG is an error."""

    @F.pandas_udf("height int, width int, rgb binary")
    def decode(values: pd.Series) -> pd.DataFrame:
        images = [None if x is None else Image(bytes(x)).rgb() for x in values]
        return pd.DataFrame([(None, None, None) if x is None else (*x.shape[:2], x.tobytes()) for x in images], columns=["height", "width", "rgb"])

    kept = [c for c in df.columns if c not in ("height", "width", "rgb")]
    return df.select(*(df[c] for c in kept), decode(F.col(content)).alias("__media")).select(*kept, "__media.*")


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FEATURES = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)
#: Rows of an Arrow batch that are worked on at a time.
ROWS = 200


def _batches(work: Callable[..., tuple], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Row-wise work on Arrow batches, a few rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                rows = [work(*x) for x in zip(*(c.to_pylist() for c in batch.slice(i, ROWS).columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _stored(doc_id: int | None, text: str | None) -> tuple:
    raw = (text or "").encode("utf-8", "replace")
    return doc_id, len(raw), carry(raw + b"\xff" * (-len(raw) % PADDING if raw else PADDING))


def _features(doc_id: int | None, n_bytes: int, media: bytes) -> tuple:
    image = Image(media)
    payload, rgb = carried(image), image.rgb()
    mean = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 3 / rgb.size
    feature = f"{image.width}x{image.height} rgb {mean[0]:.2f} {mean[1]:.2f} {mean[2]:.2f}"
    return doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def text_media(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of df: doc_id, n_bytes, media: whole texts (null: empty) as progressive JPEGs.

    Empty texts are one unit of padding; equal texts have equal bytes; a task holds a few texts at a time, and a long
    one in memory in proportion to itself. Other columns of df have no part in it; an empty table gives an empty one.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_batches(_stored, MEDIA), "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """A row per row of text_media(): the payload read back from the stored bytes, and features of the RGB tensor.

    Long texts are transformed in strips, so that a task holds little more than the tensor of one text.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_batches(_features, FEATURES), schema)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores the media column as a table, and computes the features from the bytes that the table has."""
    return media_features(saved(text_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media", compression="zstd"))
