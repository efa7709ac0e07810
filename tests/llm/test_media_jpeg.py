"""The JPEG reader against pictures from a plain bit writer, and against damaged files."""

import os

import numpy as np
import pytest

from sonarium.llm import jpeg
from sonarium.llm.media import describe_media

ZIGZAG = 64


class Bits:
    def __init__(self):
        self.out, self.held, self.n = bytearray(), 0, 0

    def put(self, value, size):
        self.held, self.n = (self.held << size) | value, self.n + size
        while self.n >= 8:
            byte = (self.held >> (self.n - 8)) & 255
            self.out += bytes((byte, 0)) if byte == 255 else bytes((byte,))
            self.n -= 8
            self.held &= (1 << self.n) - 1

    def flush(self):
        if self.n:
            self.put((1 << (8 - self.n)) - 1, 8 - self.n)


def table(symbols, length):
    """Equal code lengths: counts, symbols, and the code of each."""
    return bytes(len(symbols) if n == length else 0 for n in range(1, 17)) + bytes(symbols), {s: k for k, s in enumerate(symbols)}


DC_BODY, DC = table(range(12), 5)
AC_BODY, AC = table([0, 0xF0, *[(r << 4) | s for r in range(16) for s in range(1, 11)]], 8)


def magnitude(v):
    size = abs(v).bit_length()
    return (v if v > 0 else v + (1 << size) - 1), size


def write_block(bits, block, before):
    step = int(block[0]) - before
    value, size = magnitude(step)
    bits.put(DC[size], 5)
    bits.put(value, size)
    run = 0
    for k in range(1, 64):
        if not block[k]:
            run += 1
            continue
        while run > 15:
            bits.put(AC[0xF0], 8)
            run -= 16
        value, size = magnitude(int(block[k]))
        bits.put(AC[(run << 4) | size], 8)
        bits.put(value, size)
        run = 0
    if run:
        bits.put(AC[0], 8)


def picture(width, height, shapes, blocks, restart=0):
    """Interleaved scan of components with sampling ``shapes``; ``blocks[c]`` has shape (rows, columns, 64)."""
    frame = bytes((8,)) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes((len(shapes),))
    frame += b"".join(bytes((c + 1, h << 4 | v, 0)) for c, (h, v) in enumerate(shapes))
    scan = bytes((len(shapes),)) + b"".join(bytes((c + 1, 0)) for c in range(len(shapes))) + bytes((0, 63, 0))
    s = jpeg._segment
    out = b"\xff\xd8" + s(0xE0, b"JFIF\0") + s(0xDB, bytes((0,)) + bytes([4] * 64)) + s(0xC0, frame)
    out += s(0xC4, b"\x00" + DC_BODY) + s(0xC4, b"\x10" + AC_BODY)
    out += (s(0xDD, restart.to_bytes(2, "big")) if restart else b"") + s(0xDA, scan)
    big = max(h for h, _ in shapes), max(v for _, v in shapes)
    across, down = -(-width // (8 * big[0])), -(-height // (8 * big[1]))
    bits, before, n = Bits(), [0] * len(shapes), 0
    for y in range(down):
        for x in range(across):
            if restart and n and n % restart == 0:
                bits.flush()
                bits.out += bytes((0xFF, 0xD0 + (n // restart - 1) % 8))
                before = [0] * len(shapes)
            for c, (h, v) in enumerate(shapes):
                for dy in range(v):
                    for dx in range(h):
                        block = blocks[c][y * v + dy, x * h + dx]
                        write_block(bits, block, before[c])
                        before[c] = int(block[0])
            n += 1
    bits.flush()
    return out + bytes(bits.out) + b"\xff\xd9"


def random_blocks(rng, rows, columns):
    blocks = np.where(rng.random((rows, columns, 64)) < 0.2, rng.integers(-300, 300, (rows, columns, 64)), 0)
    blocks[..., 0] = rng.integers(-250, 250, (rows, columns))
    blocks[0, 0, 1:] = 0
    blocks[0, 0, 63] = 5
    return blocks


@pytest.mark.parametrize("restart", [0, 1, 3])
@pytest.mark.parametrize("shapes", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1)]])
def test_reads_any_baseline_layout(shapes, restart):
    rng = np.random.default_rng(len(shapes) + restart)
    width, height = 45, 39
    if len(shapes) == 1:
        grids = [(5, 6)]
    else:
        big = max(h for h, _ in shapes), max(v for _, v in shapes)
        grids = [(-(-height // (8 * big[1])) * v, -(-width // (8 * big[0])) * h) for h, v in shapes]
    blocks = [random_blocks(rng, *g) for g in grids]
    file = picture(width, height, shapes, blocks, restart)
    bad, pic = jpeg.decode([b"\xff\xd8junk", file])
    assert bad.error and not pic.error
    assert (pic.width, pic.height) == (width, height)
    assert np.array_equal(pic.luma.reshape(blocks[0].shape), blocks[0])
    grey = pic.thumbnail()
    assert grey.shape == (5, 6)
    want = np.clip((blocks[0][:5, :6, 0] * 4 + 4 >> 3) + 128, 0, 255)
    assert np.array_equal(grey, want)


def test_stores_bytes_exactly():
    payloads = [bytes(64), os.urandom(64 * 33), bytes(range(256)) * 5, b"\xff" * 640, bytes([jpeg.SHIFT]) * 128, b"text " * 64 * 9]
    payloads.append(os.urandom(64 * 1300))
    for most in (1 << 14, 64):
        files = list(jpeg.encode(payloads, most))
        stored = {jpeg.stored_bytes(p) for p in jpeg.decode(files)}
        assert stored == set(payloads) and len(files) == len(payloads)
    assert sorted(jpeg.encode(payloads, 64)) == sorted(jpeg.encode(payloads))


def test_order_of_files_is_kept():
    payloads = [os.urandom(64 * n) for n in (3, 500, 2, 900, 1)]
    assert [jpeg.stored_bytes(p) for p in jpeg.decode(list(jpeg.encode(payloads, 256)))] == payloads


def test_damaged_files(spark):
    good = next(jpeg.encode([os.urandom(64 * 40)]))
    rows = [("good", good), ("null", None), ("empty", b""), ("short", good[: len(good) // 2]), ("text", b"hello"), ("cut", good[:30])]
    progressive = good.replace(b"\xff\xc0", b"\xff\xc2", 1)
    swapped = good.replace(b"\xff\xd1", b"\xff\xd2", 1)
    rows += [("progressive", progressive), ("marker", swapped)]
    got = {r.name: r for r in describe_media(spark.createDataFrame(rows, "name string, media binary"), payload=True).collect()}
    assert got["good"].error is None and got["good"].payload_bytes == 64 * 40
    assert all(got[n].error and got[n].width is None for n in got if n != "good")
    assert len(got) == len(rows)


def test_equal_pictures_share_hashes():
    rng = np.random.default_rng(0)
    flat = rng.integers(-50, 50, (6, 6, 64))
    flat[..., 1:] = 0
    busy = flat.copy()
    busy[..., 5] = 9
    one, two = jpeg.decode([picture(48, 48, [(1, 1)], [b]) for b in (flat, busy)])
    assert jpeg.thumbnail_hashes(one) == jpeg.thumbnail_hashes(two)
