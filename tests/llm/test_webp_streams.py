"""Lossless WebP: streams put together by hand from the format's description, a foreign file, lockstep, and the query against brute force."""

import base64
import hashlib
import struct
import zlib

import numpy as np
import pytest

from fernspark.llm import entries, webp


class Stream:
    """Bits by hand: fields by number and width, lowest bit first; codes by their bits as written in the description, first bit first."""

    def __init__(self, width, height):
        self.bits = ""
        for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
            self.field(value, n)

    def field(self, value, n):
        self.bits += "".join(str(value >> i & 1) for i in range(n))
        return self

    def code(self, bits):
        self.bits += bits
        return self

    def one(self, symbol):
        """A code of one symbol."""
        return self.field(1, 1).field(0, 1).field(1, 1).field(symbol, 8)

    def two(self, a, b):
        """A code of two symbols, of a bit each."""
        return self.field(1, 1).field(1, 1).field(1, 1).field(a, 8).field(b, 8)

    def lengths(self, size, by_symbol):
        """A code of given lengths (1 to 4 here), each length written as itself in three bits, zeros in runs: code lengths 0 to 4, 17 and 18 have 3 bits each, one more fills the code."""
        order = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
        three = [0, 1, 2, 3, 4, 5, 17, 18]
        self.field(0, 1).field(len(order) - 4, 4)
        for s in order:
            self.field(3 if s in three else 0, 3)
        self.field(0, 1)
        name = {s: format(k, "03b") for k, s in enumerate(three)}
        at = 0
        for s, n in [*sorted(by_symbol.items()), (size, 0)]:
            gap = s - at
            while gap:
                step = min(gap, 138)
                if step >= 11:
                    self.code(name[18]).field(step - 11, 7)
                elif step >= 3:
                    self.code(name[17]).field(step - 3, 3)
                else:
                    step = 1
                    self.code(name[0])
                gap -= step
            if s < size:
                self.code(name[n])
            at = s + 1
        return self

    def file(self):
        bits = self.bits + "0" * (-len(self.bits) % 16)
        body = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
        return b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


def argb(a, r, g, b):
    return a << 24 | r << 16 | g << 8 | b


def test_a_foreign_file():
    """The one-pixel file by which browsers are widely tested for lossless WebP."""
    assert webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")).tolist() == [[0]]


def test_two_symbols():
    s = Stream(4, 1).field(0, 1).field(0, 1).field(0, 1).two(10, 200).one(1).one(2).one(255).one(0)
    assert webp.decode(s.code("0110").file()).tolist() == [[argb(255, 1, g, 2) for g in (10, 200, 200, 10)]]


def test_lengths_and_a_back_reference():
    # Green symbols 5 (1 bit: 0), 7 (2 bits: 10), 258 (2 bits: 11); 258 is a length of 3. Distance code 1 + 3 of the neighbours: symbol 1, one pixel up.
    s = Stream(3, 2).field(0, 1).field(0, 1).field(0, 1).lengths(280, {5: 1, 7: 2, 258: 2}).one(0).one(0).one(9).one(0)
    out = webp.decode(s.code("0").code("10").code("0").code("11").file())
    assert out.tolist() == [[argb(9, 0, g, 0) for g in (5, 7, 5)]] * 2


def test_a_colour_cache():
    # Cache of two colours; 280 and 281 are its places.
    x = argb(255, 3, 1, 4)
    place = (x * 0x1E35A7BD & 0xFFFFFFFF) >> 31
    s = Stream(3, 1).field(0, 1).field(1, 1).field(1, 4).field(0, 1).lengths(282, {1: 1, 280 + place: 1}).one(3).one(4).one(255).one(0)
    assert webp.decode(s.code("0").code("1").code("1").file()).tolist() == [[x, x, x]]


def test_groups_of_codes():
    # Tiles of 4 by 4 pixels; the entropy image names group 0 for the first and 1 for the second.
    s = Stream(8, 1).field(0, 1).field(0, 1).field(1, 1).field(0, 3)
    s.field(0, 1).two(0, 1).one(0).one(0).one(0).one(0).code("01")
    for green in (20, 30):
        s.one(green).one(0).one(0).one(255).one(0)
    assert webp.decode(s.file()).tolist() == [[argb(255, 0, 20, 0)] * 4 + [argb(255, 0, 30, 0)] * 4]


def test_subtract_green_and_palette():
    s = Stream(2, 1).field(1, 1).field(2, 2).field(0, 1).field(0, 1).field(0, 1).two(10, 250).one(5).one(250).one(255).one(0)
    assert webp.decode(s.code("01").file()).tolist() == [[argb(255, 15, 10, 4), argb(255, 255, 250, 244)]]
    # Two colours, the second written as its difference: eight indices to a green byte, the first in the lowest bit.
    s = Stream(8, 1).field(1, 1).field(3, 2).field(1, 8)
    s.field(0, 1).two(7, 100).one(1).one(2).two(0, 255).one(0).code("0").code("1").code("1").code("0")
    s.field(0, 1).field(0, 1).field(0, 1).one(0b10110010).one(0).one(0).one(255).one(0)
    colours = [argb(255, 1, 7, 2), argb(255, 2, 107, 4)]
    assert webp.decode(s.file()).tolist() == [[colours[0b10110010 >> i & 1] for i in range(8)]]


@pytest.mark.parametrize(("mode", "want"), [(0, 7), (1, 17 + 7), (2, 15 + 7), (4, 10 + 7), (7, 16 + 7), (8, 12 + 7), (11, 17 + 7), (12, 22 + 7), (13, 19 + 7)])
def test_predictors(mode, want):
    # Green of the pixels: 10, 15 in the first row, 17 below 10, and what the mode predicts from left 17, top 15, top left 10, plus 7.
    s = Stream(2, 2).field(1, 1).field(0, 2).field(0, 3).field(0, 1).one(mode).one(0).one(0).one(255).one(0)
    s.field(0, 1).field(0, 1).field(0, 1).lengths(280, {5: 2, 7: 2, 10: 1}).one(0).one(0).one(0).one(0)
    s.code("0").code("10").code("11").code("11")  # 10, then 5 more than left, 7 more than the one above, 7 more than predicted
    assert [p >> 8 & 255 for row in webp.decode(s.file()).tolist() for p in row] == [10, 15, 17, want]


def test_cross_colour():
    # Green to red 32 (so 32 * green / 32), green to blue -32, red to blue 16; green 3: red 5 + 3, blue 100 - 3 + 16 * 8 / 32.
    s = Stream(1, 1).field(1, 1).field(1, 2).field(0, 3).field(0, 1).one(256 - 32).one(16).one(32).one(255).one(0)
    s.field(0, 1).field(0, 1).field(0, 1).one(3).one(5).one(100).one(255).one(0)
    assert webp.decode(s.file()).tolist() == [[argb(255, 8, 3, 101)]]


def test_lockstep_reads_as_one_by_one():
    rng = np.random.default_rng(8)
    payloads = [bytes(rng.choice(np.frombuffer(b"etaoin shrdlu,.ABC\n\xc3\xa9\xf0", np.uint8), 64 * int(n))) for n in rng.integers(1, 80, 150)]
    payloads += [b"".join(rng.choice([b"a" * 8, b"b" * 8], 32).tolist()) for _ in range(5)]  # two symbols
    payloads += [p[:64] * 5 + p for p in payloads[:30]] + [bytes(range(256)) * 3, bytes(64), b"ab" * 320, bytes(rng.integers(0, 256, 6400, dtype=np.uint8))]
    skewed = np.minimum(rng.geometric(0.4, 64 * 300), 255).astype(np.uint8)  # codes of very different lengths
    stored = [webp.store(p) for p in [*payloads, bytes(skewed)]]
    colour = rng.integers(0, 1 << 32, (9, 9), dtype=np.uint64).astype(np.uint32)
    stored.append(webp.encode(colour))
    deep = np.repeat(np.arange(30), 2 ** np.minimum(np.arange(30), 13))[: 64 * 200]  # codes of more bits than a step's
    green = deep[: 64 * (len(deep) // 64)].reshape(-1, 64).astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)
    stored.append(webp.encode(rng.permutation(green), references=False))
    for some in (stored, stored[:10]):
        for x, data in zip(webp.decode_all(some), some, strict=True):
            assert (x == webp.decode(data)).all()
    cut = [stored[0][: len(stored[0]) // 2]]
    with pytest.raises(ValueError):
        list(webp.decode_all(cut + stored[1:100]))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = entries.op5_lossless_webp(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        full = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        stored = webp.store(full)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        samples = list(full)
        n = len(samples)
        mean = sum(samples) / n
        deviation = (sum(x * x for x in samples) / n - mean * mean) ** 0.5 if len(set(samples)) > 1 else 0.0
        size, shown_mean, shown_deviation, bands = r.feature.split(";")
        assert size == f"64x{n // 64}" and abs(float(shown_mean) - mean) < 1e-4 and abs(float(shown_deviation) - deviation) < 1e-4
        step = n // 16
        assert bytes.fromhex(bands) == bytes(int(np.rint(sum(samples[i * step : (i + 1) * step]) / step)) for i in range(16))
