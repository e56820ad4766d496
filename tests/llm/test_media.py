"""The decoder on scans of any kind: an encoder with general Huffman codes, and the transform by its definition."""

import math
import struct

import numpy as np
import pytest

from foliant.llm import media


class Out:
    """Bits with codes of 9 bits, the symbol's number: enough for any symbol, and none is all ones."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def symbol(self, run, size):
        self.put(run << 4 | size, 9)

    def signed(self, v):
        n = abs(int(v)).bit_length()
        return n, (int(v) if v > 0 else int(v) + (1 << n) - 1)

    def data(self):
        return media._packed(np.array(self.bits, np.uint8))


def dc_first(blocks_by, low):
    out, before = Out(), {}
    for row in blocks_by:
        for c, block in row:
            v = int(block[0]) >> low
            n, code = out.signed(v - before.get(c, 0))
            out.symbol(0, n)
            out.put(code, n)
            before[c] = v
    return out.data()


def point(v, low):
    return int(math.copysign(abs(int(v)) >> low, v))


def ac_first(blocks, first, last, low):
    out, ended = Out(), 0

    def flush():
        nonlocal ended
        if ended:
            n = ended.bit_length() - 1
            out.symbol(n, 0)
            out.put(ended - (1 << n), n)
            ended = 0

    for block in blocks:
        run = 0
        for k in range(first, last + 1):
            v = point(block[k], low)
            if not v:
                run += 1
                continue
            flush()
            while run > 15:
                out.symbol(15, 0)
                run -= 16
            n, code = out.signed(v)
            out.symbol(run, n)
            out.put(code, n)
            run = 0
        if run:
            ended += 1
    flush()
    return out.data()


def ac_refine(blocks, first, last, low):
    out, ended, waiting = Out(), 0, []

    def flush():
        nonlocal ended, waiting
        if ended:
            n = ended.bit_length() - 1
            out.symbol(n, 0)
            out.put(ended - (1 << n), n)
            out.bits += waiting
            ended, waiting = 0, []

    for block in blocks:
        new = [k for k in range(first, last + 1) if abs(int(block[k])) >> low == 1]
        run, corrections = 0, []
        for k in range(first, last + 1):
            m = abs(int(block[k])) >> low
            if m > 1:
                corrections.append(m & 1)
                continue
            if m == 0:
                if new and k < new[-1]:
                    if run == 15:
                        flush()
                        out.symbol(15, 0)
                        out.bits += corrections
                        run, corrections = 0, []
                    else:
                        run += 1
                continue
            flush()
            out.symbol(run, 1)
            out.put(int(block[k] > 0), 1)
            out.bits += corrections
            run, corrections = 0, []
        if not new or new[-1] < last:
            ended += 1
            waiting += corrections
        elif corrections:
            raise AssertionError("corrections without an end")
    flush()
    return out.data()


@pytest.mark.parametrize("seed", range(4))
def test_any_scans(seed):
    rng = np.random.default_rng(seed)
    width, height = int(rng.integers(1, 70)), int(rng.integers(1, 70))
    wide, high = -(-width // 16), -(-height // 16)
    shapes = {1: (2, 2), 2: (1, 1), 3: (1, 1)}
    own = {1: (-(-height // 8), -(-width // 8)), 2: (-(-(-(-height // 2)) // 8), -(-(-(-width // 2)) // 8))}
    own[3] = own[2]
    coefficients = {}
    for c, (h, v) in shapes.items():
        x = np.zeros((high * v, wide * h, 64), int)
        x[..., 0] = rng.integers(-300, 300, x.shape[:2])
        rows, columns = own[c]
        x[:rows, :columns, 1:] = rng.integers(-40, 40, (rows, columns, 63)) * (rng.random((rows, columns, 63)) < rng.choice([0.02, 0.3, 0.9]))
        coefficients[c] = x
    lengths = bytes([0] * 8 + [255] + [0] * 7)
    symbols = bytes(range(255))
    steps = rng.integers(1, 9, 64).astype(np.uint8)
    out = [b"\xff\xd8", media._segment(media.DQT, b"\x00" + steps.tobytes()), media._segment(media.SOF2, struct.pack(">BHHB", 8, height, width, 3) + bytes((1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0)))]
    out.append(media._segment(media.DHT, b"\x00" + lengths + symbols + b"\x10" + lengths + symbols))
    mcus = [[(c, coefficients[c][y * v + i, x * h + j]) for c, (h, v) in shapes.items() for i in range(v) for j in range(h)] for y in range(high) for x in range(wide)]
    out.append(media._scan([1, 2, 3], 0, 0, 0, 0, 1, dc_first(mcus, 1)))
    lists = {c: coefficients[c][: own[c][0], : own[c][1]].reshape(-1, 64) for c in shapes}
    for c in shapes:
        out.append(media._scan([c], 0, 1, 5, 0, 2, ac_first(lists[c], 1, 5, 2)))
        out.append(media._scan([c], 0, 6, 63, 0, 2, ac_first(lists[c], 6, 63, 2)))
    out.append(media._scan([1, 2, 3], 0, 0, 0, 1, 0, media._packed(np.array([int(b[0]) & 1 for m in mcus for _, b in m], np.uint8))))
    for low in (1, 0):
        for c in shapes:
            out.append(media._scan([c], 0, 1, 63, low + 1, low, ac_refine(lists[c], 1, 63, low)))
    image = media.Image(b"".join(out) + b"\xff\xd9")
    for i, c in shapes.items():
        assert (image.components[i].coefficients == coefficients[i]).all()
    rgb = image.rgb()
    assert rgb.shape == (height, width, 3)
    # One sample by the definition of the inverse transform.
    y, x = height // 2, width // 2
    sample = {}
    for c, (h, v) in shapes.items():
        sy, sx = y * v // 2, x * h // 2
        block = np.zeros(64)
        block[media.ZIGZAG] = coefficients[c][sy // 8, sx // 8] * steps
        total = sum(block[u * 8 + w] * (math.sqrt(0.125) if u == 0 else 0.5) * (math.sqrt(0.125) if w == 0 else 0.5) * math.cos((2 * (sy % 8) + 1) * u * math.pi / 16) * math.cos((2 * (sx % 8) + 1) * w * math.pi / 16) for u in range(8) for w in range(8))
        sample[c] = min(127, max(-128, round(total)))
    want = [sample[1] + 128 + a * sample[2] + b * sample[3] for a, b in ((0, 1.402), (-0.344136, -0.714136), (1.772, 0))]
    assert all(abs(int(got) - min(255, max(0, w))) <= 2.5 for got, w in zip(rgb[y, x], want, strict=True))


def test_round_trip():
    for n in (0, 1, 575, 576, 577, 40_000):
        payload = bytes(i * 37 % 256 for i in range(n))
        assert media.carried(media.Image(media.carry(payload))) == payload
    with pytest.raises(ValueError):
        media.Image(b"no image")


def test_column(spark):
    frame = spark.createDataFrame([(1, bytearray(media.carry(b"abc"))), (2, None)], "id int, content binary")
    out = {r.id: r for r in media.decoded(frame, "content").collect()}
    assert (out[1].height, out[1].width, len(out[1].rgb)) == (16, 16, 768) and out[2].rgb is None
