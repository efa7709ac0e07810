"""Baseline JPEG in numpy: a decoder for sequential Huffman scans, and a writer that stores bytes as coefficients.

Scans are decoded for many images at once: every restart interval is a lane, and all lanes take one symbol per step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

SHIFT = 106
RESTART = 4
DC_STEP = 8
LANES = 1 << 13
U = np.uint64


# --- fixed layout of the writer -----------------------------------------------------------------------------------------


def _code_table(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """DHT body (counts and symbols) and the code and length of each symbol, for symbols given with their code lengths."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(1 for s in order if lengths[s] == n) for n in range(1, 17))
    codes, sizes, code, before = np.zeros(256, U), np.zeros(256, np.int64), 0, 0
    for s in order:
        code <<= lengths[s] - before
        before = lengths[s]
        codes[s], sizes[s] = code, before
        code += 1
    return counts + bytes(order), codes, sizes


# most bytes of text differ from SHIFT by less than 16, blanks by 64 to 127: these get the short codes
_AC_LENGTHS = {(run << 4) | size: 9 for run in range(16) for size in range(1, 11)} | {0x00: 9, 0xF0: 9}
_AC_LENGTHS |= dict.fromkeys((0x01, 0x02, 0x03, 0x04, 0x07), 3) | dict.fromkeys((0x05, 0x06), 5)
_AC_BODY, _AC_CODE, _AC_SIZE = _code_table(_AC_LENGTHS)
_DC_BODY, _DC_CODE, _DC_SIZE = _code_table(dict.fromkeys(range(12), 4))
_BITS = np.array([int(v).bit_length() for v in range(2048)], np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


_TABLES = (
    _segment(0xDB, bytes((0, DC_STEP)) + b"\x01" * 63)
    + _segment(0xC4, b"\x00" + _DC_BODY)
    + _segment(0xC4, b"\x10" + _AC_BODY)
    + _segment(0xDD, RESTART.to_bytes(2, "big"))
)
_SCAN = _segment(0xDA, bytes((1, 1, 0x00, 0, 63, 0)))


def grid(blocks: int) -> tuple[int, int]:
    """Blocks across and down of a nearly square image that holds at least ``blocks``."""
    across = max(1, int(np.ceil(np.sqrt(blocks))))
    return across, -(-blocks // across)


def _header(across: int, down: int, length: int) -> bytes:
    frame = bytes((8,)) + (8 * down).to_bytes(2, "big") + (8 * across).to_bytes(2, "big") + bytes((1, 1, 0x11, 0))
    return b"\xff\xd8" + _segment(0xFE, b"bytes=%d" % length) + _TABLES + _segment(0xC0, frame) + _SCAN


def _scan_bytes(blocks: np.ndarray, last: np.ndarray, number: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of blocks ``(n, 64)`` of coefficients, and where each interval ends in them.

    ``last`` marks the last block of an interval, ``number`` its restart number, ``ends`` the last interval of an image.
    """
    n = len(blocks)
    first = np.concatenate([[True], last[:-1]])
    dc = blocks[:, 0].astype(np.int64)
    step = dc - np.where(first, 0, np.concatenate([[0], dc[:-1]]))
    value = np.zeros((n, 66), U)
    size = np.zeros((n, 66), np.int64)

    def magnitude(v: np.ndarray, bits: np.ndarray) -> np.ndarray:
        return np.where(v < 0, v + (1 << bits) - 1, v).astype(U)

    bits = _BITS[np.abs(step)]
    value[:, 0] = (_DC_CODE[bits] << bits.astype(U)) | magnitude(step, bits)
    size[:, 0] = _DC_SIZE[bits] + bits
    row, k = np.nonzero(blocks[:, 1:])
    k += 1
    ac = blocks[row, k].astype(np.int64)
    same = np.concatenate([[False], row[1:] == row[:-1]])
    run = k - np.where(same, np.concatenate([[0], k[:-1]]), 0) - 1
    bits = _BITS[np.abs(ac)]
    symbol = ((run & 15) << 4) | bits
    code = (_AC_CODE[symbol] << bits.astype(U)) | magnitude(ac, bits)
    length = _AC_SIZE[symbol] + bits
    for _ in range(int(run.max(initial=0)) // 16):
        more = run >= 16
        code = np.where(more, code | (_AC_CODE[0xF0] << length.astype(U)), code)
        length = np.where(more, length + _AC_SIZE[0xF0], length)
        run = np.where(more, run - 16, run)
    value[row, k], size[row, k] = code, length
    short = blocks[:, 63] == 0
    value[short, 64], size[short, 64] = _AC_CODE[0], _AC_SIZE[0]
    stop = np.flatnonzero(last)
    per_block = size.sum(axis=1)
    total = np.add.reduceat(per_block, np.concatenate([[0], stop[:-1] + 1]))
    pad = -total % 8
    value[stop, 65], size[stop, 65] = (U(1) << pad.astype(U)) - U(1), pad
    flat, value = size.ravel(), value.ravel()
    used = np.flatnonzero(flat)
    at = (np.cumsum(flat) - flat)[used]
    flat, value = flat[used], value[used]
    room = 64 - (at & 63) - flat
    word = at >> 6
    high = np.where(room >= 0, value << np.maximum(room, 0).astype(U), value >> np.maximum(-room, 0).astype(U))
    words = np.zeros(int(total.sum() + pad.sum()) // 64 + 2, U)
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[starts]] = np.bitwise_or.reduceat(high, starts)
    over = np.flatnonzero(room < 0)
    words[word[over] + 1] |= value[over] << (64 + room[over]).astype(U)
    lengths = (total + pad) // 8
    raw = words.astype(">u8").view(np.uint8)[: int(lengths.sum())]
    # a zero byte follows every 0xFF, a restart marker every interval but an image's last
    stuffed = np.cumsum(raw == 0xFF)
    bounds = np.cumsum(lengths)
    marks = np.where(ends, 0, 2)
    interval = np.repeat(np.arange(len(lengths)), lengths)
    ahead = (np.cumsum(marks) - marks)[interval]
    place = np.arange(len(raw)) + stuffed - (raw == 0xFF) + ahead
    out_ends = bounds + stuffed[bounds - 1] + np.cumsum(marks)
    out = np.zeros(int(out_ends[-1]), np.uint8)
    out[place] = raw
    mark = np.flatnonzero(marks)
    out[out_ends[mark] - 2] = 0xFF
    out[out_ends[mark] - 1] = 0xD0 + number[mark] % 8
    return out, out_ends


def _image_bytes(data: np.ndarray, blocks: np.ndarray, counts: list[int], totals: list[int], first: int = 0) -> list[bytes]:
    """Entropy-coded bytes of consecutive images: ``counts`` blocks of ``data`` each, then empty ones up to ``totals``.

    With one image, ``data`` may be a run of its blocks that begins at block ``first``; ``blocks`` is cleared working space.
    """
    ends = np.cumsum(totals)
    heads = ends - totals
    index = np.arange(ends[-1]) - np.repeat(heads, totals)
    blocks[index < np.repeat(counts, totals)] = data.astype(np.int16) - SHIFT
    final = np.zeros(len(index), bool)
    final[ends - 1] = True
    last = (index % RESTART == RESTART - 1) | final
    out, stops = _scan_bytes(blocks, last, (first + index[last]) // RESTART, final[last])
    cuts = stops[np.cumsum(np.add.reduceat(last, heads)) - 1]
    return [out[a:b].tobytes() for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


def encode(payloads: Iterable[bytes], most_blocks: int = 1 << 14) -> Iterator[bytes]:
    """Images whose quantised coefficients, in scan order, are the bytes of each payload less ``SHIFT``.

    A payload is a positive multiple of 64 bytes, one block each; the image's comment holds its length. Small images are coded
    together, large ones in runs of whole restart intervals, about ``most_blocks`` blocks at a time, so memory beyond the
    payloads and images is bounded.
    """
    waiting: list[bytes] = []
    size = 0

    def together() -> Iterator[bytes]:
        if not waiting:
            return
        shapes = [grid(len(p) // 64) for p in waiting]
        totals = [a * d for a, d in shapes]
        data = np.frombuffer(b"".join(waiting), np.uint8).reshape(-1, 64)
        scans = _image_bytes(data, np.zeros((sum(totals), 64), np.int16), [len(p) // 64 for p in waiting], totals)
        for payload, shape, scan in zip(waiting, shapes, scans, strict=True):
            yield _header(*shape, len(payload)) + scan + b"\xff\xd9"
        waiting.clear()

    for payload in payloads:
        blocks = len(payload) // 64
        if size + blocks > most_blocks:
            yield from together()
            size = 0
        if blocks <= most_blocks:
            waiting.append(payload)
            size += blocks
            continue
        across, down = grid(blocks)
        parts = [_header(across, down, len(payload))]
        data = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        total, step = across * down, max(RESTART, most_blocks // RESTART * RESTART)
        for a in range(0, total, step):
            b = min(a + step, total)
            part = data[a:b]
            scan = _image_bytes(part, np.zeros((b - a, 64), np.int16), [len(part)], [b - a], a)[0]
            # a run that does not end the image still needs the marker of its last interval
            parts.append(scan if b == total else scan + bytes((0xFF, 0xD0 + (b // RESTART - 1) % 8)))
        yield b"".join([*parts, b"\xff\xd9"])
    yield from together()


# --- reading ------------------------------------------------------------------------------------------------------------


@dataclass
class Component:
    across: int
    down: int
    step: int
    dc: int = 0
    ac: int = 0
    #: blocks in a row and in a column of the padded and of the real component
    wide: int = 0
    high: int = 0
    real_wide: int = 0
    real_high: int = 0


@dataclass
class Scan:
    parts: list[Component]
    numbers: list[int]
    tables: list[tuple[int, int]]
    start: int
    end: int
    restart: int


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    comment: bytes = b""
    parts: dict[int, Component] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    #: coefficients of the first component, blocks in raster order, each in scan order
    luma: np.ndarray | None = None
    error: str = ""

    def thumbnail(self) -> np.ndarray:
        """Luminance of each block's mean, from its DC coefficient alone."""
        part = next(iter(self.parts.values()))
        means = self.luma[:, 0].astype(np.int64) * part.step
        grey = np.clip((means + 4 >> 3) + 128, 0, 255).astype(np.uint8).reshape(-1, part.wide)
        return grey[: part.real_high, : part.real_wide]


_LUTS: dict[bytes, np.ndarray] = {}


def _lookup(body: bytes) -> np.ndarray:
    """For each 16 bits ahead: code length << 8 | symbol; 0 where no code fits."""
    if body not in _LUTS:
        if len(_LUTS) > 64:
            _LUTS.clear()
        lut, code, at = np.zeros(1 << 16, np.int64), 0, 16
        for length in range(1, 17):
            for _ in range(body[length - 1]):
                low = code << (16 - length)
                if low + (1 << (16 - length)) > 1 << 16:
                    raise ValueError("more codes than bits")
                lut[low : low + (1 << (16 - length))] = (length << 8) | body[at]
                code, at = code + 1, at + 1
            code <<= 1
        _LUTS[body] = lut
    return _LUTS[body]


def parse(data: bytes, marks: np.ndarray, tables: list[bytes]) -> Picture:
    """Read the markers; ``marks`` are the places of 0xFF bytes that begin one, ``tables`` gets the Huffman tables in use."""
    pic, at, restart = Picture(), 2, 0
    steps: dict[int, int] = {}
    huffman: dict[int, int] = {}
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if len(data) < at + 2 or data[at] != 0xFF:
            raise ValueError("marker expected")
        kind = data[at + 1]
        if kind == 0xD9:
            return pic
        length = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + length]
        if length < 2 or len(body) != length - 2:
            raise ValueError("segment cut short")
        at += 2 + length
        if kind == 0xFE:
            pic.comment = body
        elif kind == 0xDD:
            restart = int.from_bytes(body, "big")
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                steps[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                if body[1:n] not in tables:
                    tables.append(body[1:n])
                huffman[body[0]] = tables.index(body[1:n])
                body = body[n:]
        elif kind == 0xC0:
            if body[0] != 8:
                raise ValueError("8 bits a sample expected")
            pic.height, pic.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            for k in range(body[5]):
                name, shape, table = body[6 + 3 * k : 9 + 3 * k]
                pic.parts[name] = Component(shape >> 4, shape & 15, steps.get(table, 0))
            most = max(c.across for c in pic.parts.values()), max(c.down for c in pic.parts.values())
            for c in pic.parts.values():
                if not c.across or not c.down or not c.step or not pic.width or not pic.height:
                    raise ValueError("empty frame")
                c.wide = -(-pic.width // (8 * most[0])) * c.across
                c.high = -(-pic.height // (8 * most[1])) * c.down
                c.real_wide = -(-(-(-pic.width * c.across // most[0])) // 8)
                c.real_high = -(-(-(-pic.height * c.down // most[1])) // 8)
        elif 0xC1 <= kind <= 0xCF and kind != 0xC8:
            raise ValueError("not a baseline frame")
        elif kind == 0xDA:
            chosen = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            later = marks[np.searchsorted(marks, at) :]
            stop = next((int(m) for m in later if not 0xD0 <= data[m + 1] <= 0xD7), len(data))
            names = list(pic.parts)
            pic.scans.append(
                Scan(
                    [pic.parts[c] for c, _ in chosen],
                    [names.index(c) for c, _ in chosen],
                    [(huffman[t >> 4], huffman[16 | (t & 15)]) for _, t in chosen],
                    at, stop, restart,
                )
            )
            at = stop


def _lanes(window: np.ndarray, luts: np.ndarray, lane: dict[str, np.ndarray], tables: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Decode all lanes together into ``out``; true where a lane's bits are no valid code or end too early.

    ``lane``: first bit, bits' end, first block, number of blocks and row of ``tables``; ``tables[row, 0]`` is the number of
    blocks of an MCU, the DC and AC table of each follow.
    """
    bad = np.zeros(len(lane["bit"]), bool)
    now = np.arange(len(bad))
    bit, block, left, row = (lane[k].copy() for k in ("bit", "block", "blocks", "row"))
    k = np.zeros(len(bad), np.int64)
    turn = np.zeros(len(bad), np.int64)
    width = tables[:, 0]
    single = bool((width == 1).all())
    limit = lane["end"]
    while len(now):
        w = window[bit >> 3] << (bit & 7).astype(U)
        dc = k == 0
        code = luts[tables[row, 2 * turn + np.where(dc, 1, 2)], (w >> U(48)).astype(np.int64)]
        length, symbol = code >> 8, code & 255
        size = np.where(dc, symbol, symbol & 15)
        run = np.where(dc, 0, symbol >> 4)
        bits = ((w << length.astype(U)) >> U(1) >> (63 - size).astype(U)).astype(np.int64)
        low = (np.int64(1) << size) >> 1
        number = np.where(bits < low, bits - 2 * low + 1, bits)
        bit += length + size
        at = k + run
        wrong = (code == 0) | (size > 11) | (at > 63) & (size > 0) | (bit > limit[now])
        put = (size > 0) & ~wrong
        out[block[put], at[put]] = number[put]
        k = np.where(size > 0, at + 1, np.where(dc, 1, np.where(run == 15, k + 16, 64)))
        over = k > 63
        k[over] = 0
        block += over
        left -= over
        if not single:
            turn = np.where(over, (turn + 1) % width[row], turn)
        gone = wrong | (left == 0)
        if gone.any():
            bad[now[wrong]] = True
            go = ~gone
            now, bit, block, left, row, k, turn = (x[go] for x in (now, bit, block, left, row, k, turn))
    return bad


def decode(files: list[bytes]) -> list[Picture]:
    """Pictures of a few files with the first component's coefficients; one with an ``error`` where a file is not valid."""
    joined = np.frombuffer(b"".join([*files, b"\xff" * 16]), np.uint8)
    offsets = np.cumsum([0, *map(len, files)])
    follow = joined[1:]
    begins = np.flatnonzero((joined[:-1] == 0xFF) & (follow != 0) & (follow != 0xFF))
    filler = np.flatnonzero((joined[:-1] == 0xFF) & (follow == 0)) + 1
    tables: list[bytes] = []
    pics, lanes, rows, blocks = [], [], [], 0
    homes: list[tuple[int, int, Scan, int, int]] = []
    for i, data in enumerate(files):
        a, b = np.searchsorted(begins, offsets[i : i + 2])
        marks = begins[a:b] - offsets[i]
        try:
            pic = parse(data, marks, tables)
            if not pic.scans:
                raise ValueError("no scan")
            found = []
            for scan in pic.scans:
                alone = len(scan.parts) == 1
                part = scan.parts[0]
                mcu = 1 if alone else sum(c.across * c.down for c in scan.parts)
                count = part.real_wide * part.real_high if alone else part.wide // part.across * (part.high // part.down)
                inner = marks[(marks >= scan.start) & (marks < scan.end)]
                per = scan.restart or count
                if len(inner) != -(-count // per) - 1 or any(
                    data[int(m) + 1] != 0xD0 + j % 8 for j, m in enumerate(inner)
                ):
                    raise ValueError("restart markers do not fit")
                found.append((scan, mcu, count, per, np.array([scan.start, *(inner + 2)]), np.array([*inner, scan.end])))
        except (ValueError, IndexError, KeyError) as e:
            pics.append(Picture(error=str(e) or type(e).__name__))
            continue
        pics.append(pic)
        for scan, mcu, count, per, starts, stops in found:
            row = [mcu]
            for c, (dc, ac) in zip(scan.parts, scan.tables, strict=True):
                row += [dc, ac] * (1 if len(scan.parts) == 1 else c.across * c.down)
            homes.append((len(pics) - 1, blocks, scan, mcu, count))
            firsts = np.arange(len(starts)) * per
            lanes.append((starts + offsets[i], stops + offsets[i], blocks + firsts * mcu,
                          np.minimum(per, count - firsts) * mcu, np.full(len(starts), len(rows))))
            rows.append(row)
            blocks += count * mcu
    if not homes:
        return pics
    starts, stops, first, number, row = (np.concatenate(x) for x in zip(*lanes, strict=True))
    plain = np.delete(joined, filler)
    starts, stops = (x - np.searchsorted(filler, x) for x in (starts, stops))
    padded = np.concatenate([plain, np.full(8, 0xFF, np.uint8)]).astype(U)
    window = np.zeros(len(plain), U)
    for j in range(8):
        window |= padded[j : j + len(plain)] << U(56 - 8 * j)
    shape = np.zeros((len(rows), max(map(len, rows))), np.int64)
    for j, r in enumerate(rows):
        shape[j, : len(r)] = r
    luts = np.stack([_lookup(t) for t in tables])
    out = np.zeros((blocks, 64), np.int16)
    bad = np.zeros(len(starts), bool)
    for a in range(0, len(starts), LANES):
        s = slice(a, a + LANES)
        lane = {"bit": 8 * starts[s], "end": 8 * stops[s], "block": first[s], "blocks": number[s], "row": row[s]}
        bad[s] = _lanes(window, luts, lane, shape, out)
    wrong = {homes[r][0] for r in row[bad]}
    for p, at, scan, mcu, count in homes:
        if p in wrong:
            pics[p] = Picture(error="invalid code in a scan")
        elif not pics[p].error and 0 in scan.numbers:
            _place(pics[p], scan, out[at : at + mcu * count], mcu, count)
    return pics


def _place(pic: Picture, scan: Scan, blocks: np.ndarray, mcu: int, count: int) -> None:
    """Undo the DC prediction of the first component and put its blocks in raster order."""
    which = scan.numbers.index(0)
    part = scan.parts[which]
    each = 1 if mcu == 1 else part.across * part.down
    skip = 0 if mcu == 1 else sum(c.across * c.down for c in scan.parts[:which])
    mine = blocks.reshape(count, mcu, 64)[:, skip : skip + each].reshape(-1, 64)
    steps = mine[:, 0].astype(np.int64)
    total = np.cumsum(steps)
    per = (scan.restart or count) * each
    heads = np.arange(0, len(steps), per)
    total -= np.repeat(total[heads] - steps[heads], np.diff([*heads, len(steps)]))
    mine[:, 0] = total
    if mcu == 1:
        pic.luma = mine
        if (part.real_wide, part.real_high) != (part.wide, part.high):
            pic.luma = np.zeros((part.high, part.wide, 64), np.int16)
            pic.luma[: part.real_high, : part.real_wide] = mine.reshape(part.real_high, part.real_wide, 64)
            pic.luma = pic.luma.reshape(-1, 64)
    else:
        shape = (part.high // part.down, part.wide // part.across, part.down, part.across, 64)
        pic.luma = mine.reshape(shape).transpose(0, 2, 1, 3, 4).reshape(-1, 64)


def stored_bytes(pic: Picture) -> bytes:
    """The payload that :func:`encode` put into the picture."""
    if not pic.comment.startswith(b"bytes="):
        raise ValueError("the picture holds no payload")
    flat = (pic.luma + np.int16(SHIFT)).astype(np.uint8).reshape(-1)
    return flat[: int(pic.comment[6:])].tobytes()


@lru_cache(1 << 12)
def _bounds(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.arange(parts) * n // parts
    return low, np.maximum((np.arange(parts) + 1) * n // parts, low + 1)


def _means(total: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over a grid of cells, from running totals; cells overlap where the thumbnail is smaller than the grid."""
    (a, b), (c, d) = _bounds(len(total) - 1, rows), _bounds(total.shape[1] - 1, columns)
    low, high = total[a], total[b]
    return (high[:, d] - low[:, d] - high[:, c] + low[:, c]) / ((b - a)[:, None] * (d - c))


def thumbnail_hashes(pic: Picture) -> tuple[str, str, str]:
    """Mean hash and gradient hash (64 bits each) and the SHA-1 of the DC-only luminance thumbnail."""
    grey = pic.thumbnail()
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(grey, 0, dtype=np.int64), 1, out=total[1:, 1:])
    small, slope = _means(total, 8, 8), _means(total, 8, 9)
    bits = [(small > small.mean()).ravel(), (slope[:, 1:] > slope[:, :-1]).ravel()]
    return (*[np.packbits(b).tobytes().hex() for b in bits], hashlib.sha1(grey.tobytes()).hexdigest())
