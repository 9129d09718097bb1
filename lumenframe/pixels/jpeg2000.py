"""JPEG 2000 (ITU-T T.800): decoder of codestreams and JP2 files, lossless encoder.

Bit planes are coded sample by sample in plain Python; wavelets are NumPy. Not
supported: arithmetic-coding bypass, termination of each pass, vertically causal
contexts, regions of interest, changes of progression, packed packet headers.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np


class Jpeg2000Error(ValueError):
    pass


# The states of the arithmetic coder (estimate, next after the more and the less probable symbol, whether they change places).
_STATES = """5601 1 1 1|3401 2 6 0|1801 3 9 0|0AC1 4 12 0|0521 5 29 0|0221 38 33 0|5601 7 6 1|5401 8 14 0|4801 9 14 0|3801 10 14 0|3001 11 17 0|2401 12 18 0|1C01 13 20 0|1601 29 21 0|5601 15 14 1|5401 16 14 0|5101 17 15 0
4801 18 16 0|3801 19 17 0|3401 20 18 0|3001 21 19 0|2801 22 19 0|2401 23 20 0|2201 24 21 0|1C01 25 22 0|1801 26 23 0|1601 27 24 0|1401 28 25 0|1201 29 26 0|1101 30 27 0|0AC1 31 28 0|09C1 32 29 0|08A1 33 30 0
0521 34 31 0|0441 35 32 0|02A1 36 33 0|0221 37 34 0|0141 38 35 0|0111 39 36 0|0085 40 37 0|0049 41 38 0|0025 42 39 0|0015 43 40 0|0009 44 41 0|0005 45 42 0|0001 45 43 0|5601 46 46 0"""
STATES = [(int(q, 16), int(m), int(n), int(s)) for q, m, n, s in (x.split() for line in _STATES.split("\n") for x in line.split("|"))]
RUN, UNIFORM = 17, 18


def _fresh() -> tuple[list[int], list[int]]:
    """State and more probable symbol of each context."""
    index = [0] * 19
    index[0], index[RUN], index[UNIFORM] = 4, 3, 46
    return index, [0] * 19


class MqDecoder:
    def __init__(self, data: bytes):
        self.data, self.at = data + b"\xff\xff", 0
        self.index, self.mps = _fresh()
        self.c = self.data[0] << 16
        self.ct = 0
        self._byte()
        self.c = (self.c << 7) & 0xFFFFFFFF
        self.ct -= 7
        self.a = 0x8000

    def _byte(self) -> None:
        if self.data[self.at] == 0xFF:
            if self.at + 1 >= len(self.data) or self.data[self.at + 1] > 0x8F:
                self.c += 0xFF00
                self.ct = 8
                return
            self.at += 1
            self.c += self.data[self.at] << 9
            self.ct = 7
            return
        self.at += 1
        self.c += self.data[self.at] << 8
        self.ct = 8

    def bit(self, context: int) -> int:
        i = self.index[context]
        q, more, less, switch = STATES[i]
        self.a -= q
        if (self.c >> 16) < q:
            lps = self.a >= q
            self.a = q
        else:
            self.c -= q << 16
            if self.a & 0x8000:
                return self.mps[context]
            lps = self.a < q
        out = self.mps[context]
        if lps:
            out = 1 - out
            if switch:
                self.mps[context] = out
            self.index[context] = less
        else:
            self.index[context] = more
        while True:
            if not self.ct:
                self._byte()
            self.a <<= 1
            self.c = (self.c << 1) & 0xFFFFFFFF
            self.ct -= 1
            if self.a & 0x8000:
                return out


class MqEncoder:
    def __init__(self):
        self.out = bytearray(1)  # a byte before the first, for carries
        self.index, self.mps = _fresh()
        self.a, self.c, self.ct = 0x8000, 0, 12

    def bit(self, context: int, value: int) -> None:
        q, more, less, switch = STATES[self.index[context]]
        self.a -= q
        if value == self.mps[context]:
            if self.a & 0x8000:
                self.c += q
                return
            if self.a < q:
                self.a = q
            else:
                self.c += q
            self.index[context] = more
        else:
            if self.a < q:
                self.c += q
            else:
                self.a = q
            if switch:
                self.mps[context] = 1 - self.mps[context]
            self.index[context] = less
        while True:
            self.a <<= 1
            self.c <<= 1
            self.ct -= 1
            if not self.ct:
                self._byte()
            if self.a & 0x8000:
                return

    def _byte(self) -> None:
        if self.out[-1] == 0xFF:
            self._seven()
        elif self.c < 0x8000000:
            self._eight()
        else:
            self.out[-1] += 1
            if self.out[-1] == 0xFF:
                self.c &= 0x7FFFFFF
                self._seven()
            else:
                self._eight()

    def _seven(self) -> None:
        self.out.append(self.c >> 20 & 0xFF)
        self.c &= 0xFFFFF
        self.ct = 7

    def _eight(self) -> None:
        self.out.append(self.c >> 19 & 0xFF)
        self.c &= 0x7FFFF
        self.ct = 8

    def flush(self) -> bytes:
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        self.c <<= self.ct
        self._byte()
        self.c <<= self.ct
        self._byte()
        return bytes(self.out[1:-1] if self.out[-1] == 0xFF else self.out[1:])


def _zero_contexts(band: str) -> list[int]:
    """The context of a sample that is not yet significant, by its significant neighbours: at h * 15 + v * 5 + d for so many horizontal, vertical and diagonal ones."""
    out = []
    for h in range(3):
        for v in range(3):
            for d in range(5):
                if band == "HH":
                    s = h + v
                    out.append(8 if d >= 3 else (7 if s else 6) if d == 2 else (5 if s >= 2 else 4 if s else 3) if d == 1 else min(s, 2))
                else:
                    x, y = (v, h) if band == "HL" else (h, v)
                    out.append(8 if x == 2 else (7 if y else 6 if d else 5) if x == 1 else 4 if y == 2 else 3 if y == 1 else min(d, 2))
    return out


_ZERO = {b: _zero_contexts(b) for b in ("LL", "HL", "LH", "HH")}
#: Context and flip of a sign by the horizontal and vertical signs around it, each from -1 to 1.
_SIGN = {(1, 1): (13, 0), (1, 0): (12, 0), (1, -1): (11, 0), (0, 1): (10, 0), (0, 0): (9, 0), (0, -1): (10, 1), (-1, 1): (11, 1), (-1, 0): (12, 1), (-1, -1): (13, 1)}


class _Planes:
    """The bit planes of a code block, decoded or (with given samples) encoded by the same passes."""

    def __init__(self, width: int, height: int, band: str, coder, samples: list[int] | None = None):
        self.w, self.h, self.row = width, height, width + 2
        size = self.row * (height + 2)
        self.sig, self.neg, self.mag = [0] * size, [0] * size, [0] * size
        self.seen, self.refined = [0] * size, [0] * size
        self.zero, self.coder, self.want = _ZERO[band], coder, None
        if samples is not None:
            self.want = [0] * size
            for y in range(height):
                at = (y + 1) * self.row + 1
                self.want[at : at + width] = samples[y * width : (y + 1) * width]

    def _bit(self, context: int, value: int) -> int:
        if self.want is None:
            return self.coder.bit(context)
        self.coder.bit(context, value)
        return value

    def _context(self, i: int) -> int:
        s, r = self.sig, self.row
        return self.zero[(s[i - 1] + s[i + 1]) * 15 + (s[i - r] + s[i + r]) * 5 + s[i - r - 1] + s[i - r + 1] + s[i + r - 1] + s[i + r + 1]]

    def _any(self, i: int) -> int:
        s, r = self.sig, self.row
        return s[i - 1] or s[i + 1] or s[i - r] or s[i + r] or s[i - r - 1] or s[i - r + 1] or s[i + r - 1] or s[i + r + 1]

    def _begin(self, i: int, plane: int) -> None:
        """A sample becomes significant: its sign is coded."""
        s, n, r = self.sig, self.neg, self.row
        way = lambda a, b: max(-1, min(1, s[a] * (1 - 2 * n[a]) + s[b] * (1 - 2 * n[b])))
        context, flip = _SIGN[way(i - 1, i + 1), way(i - r, i + r)]
        value = 0 if self.want is None else int(self.want[i] < 0) ^ flip
        self.neg[i] = self._bit(context, value) ^ flip
        self.sig[i], self.mag[i] = 1, 1 << plane

    def _asked(self, i: int, plane: int) -> int:
        return 0 if self.want is None else abs(self.want[i]) >> plane & 1

    def significance(self, plane: int) -> None:
        for top in range(0, self.h, 4):
            for x in range(self.w):
                for y in range(top, min(top + 4, self.h)):
                    i = (y + 1) * self.row + x + 1
                    if not self.sig[i] and self._any(i):
                        if self._bit(self._context(i), self._asked(i, plane)):
                            self._begin(i, plane)
                        self.seen[i] = 1

    def refinement(self, plane: int) -> None:
        for top in range(0, self.h, 4):
            for x in range(self.w):
                for y in range(top, min(top + 4, self.h)):
                    i = (y + 1) * self.row + x + 1
                    if self.sig[i] and not self.seen[i]:
                        context = 16 if self.refined[i] else 15 if self._any(i) else 14
                        self.mag[i] |= self._bit(context, self._asked(i, plane)) << plane
                        self.refined[i] = 1

    def cleanup(self, plane: int) -> None:
        for top in range(0, self.h, 4):
            for x in range(self.w):
                at = [(y + 1) * self.row + x + 1 for y in range(top, min(top + 4, self.h))]
                k = 0
                if len(at) == 4 and not any(self.sig[i] or self.seen[i] or self._any(i) for i in at):
                    first = next((j for j, i in enumerate(at) if self._asked(i, plane)), 4)
                    if not self._bit(RUN, int(first < 4)):
                        continue
                    k = self._bit(UNIFORM, first >> 1 & 1) << 1
                    k |= self._bit(UNIFORM, first & 1)
                    self._begin(at[k], plane)
                    k += 1
                for i in at[k:]:
                    if not self.sig[i] and not self.seen[i] and self._bit(self._context(i), self._asked(i, plane)):
                        self._begin(i, plane)
        self.seen = [0] * len(self.seen)

    def run(self, planes: int, passes: int, reset: bool = False, symbols: bool = False) -> int:
        """Codes so many passes from the highest plane; the lowest plane that was reached."""
        plane = planes - 1
        for k in range(passes):
            if plane < 0:
                raise Jpeg2000Error("more passes than bit planes")
            kind = (k + 2) % 3
            (self.significance, self.refinement, self.cleanup)[kind](plane)
            if kind == 2:
                if symbols:
                    for _ in range(4):
                        self.coder.bit(UNIFORM)
                plane -= 1
            if reset:
                self.coder.index, self.coder.mps = _fresh()
        return plane + 1 if passes and (passes + 1) % 3 == 2 else plane if passes else planes

    def values(self) -> np.ndarray:
        a = np.array(self.mag, np.int64).reshape(self.h + 2, self.row)[1:-1, 1:-1]
        return np.where(np.array(self.neg).reshape(self.h + 2, self.row)[1:-1, 1:-1] == 1, -a, a)


class _TagTree:
    def __init__(self, width: int, height: int):
        self.sizes = [(width, height)]
        while self.sizes[-1] != (1, 1):
            w, h = self.sizes[-1]
            self.sizes.append((-(-w // 2), -(-h // 2)))
        self.low = [[0] * (w * h) for w, h in self.sizes]
        self.known = [[False] * (w * h) for w, h in self.sizes]
        self.value = [[0] * (w * h) for w, h in self.sizes]

    def set(self, leaves: list[int]) -> None:
        self.value[0] = list(leaves)
        for k in range(1, len(self.sizes)):
            w, h = self.sizes[k]
            up = self.sizes[k - 1]
            self.value[k] = [min(self.value[k - 1][y * up[0] + x] for y in range(2 * j, min(2 * j + 2, up[1])) for x in range(2 * i, min(2 * i + 2, up[0]))) for j in range(h) for i in range(w)]

    def code(self, x: int, y: int, threshold: int, bits) -> bool:
        """Whether the leaf's value is below the threshold; bits.tree(node value known to be) reads or writes what is not yet known."""
        low = 0
        for k in reversed(range(len(self.sizes))):
            i = (y >> k) * self.sizes[k][0] + (x >> k)
            low = max(low, self.low[k][i])
            while low < threshold and not self.known[k][i]:
                if bits.tree(self.value[k][i] <= low):
                    self.known[k][i], self.value[k][i] = True, low
                else:
                    low += 1
            self.low[k][i] = low
        return self.known[0][y * self.sizes[0][0] + x] and self.value[0][y * self.sizes[0][0] + x] < threshold


class _HeaderReader:
    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.left, self.held = data, at, 0, 0

    def bit(self) -> int:
        if not self.left:
            stuffed = self.held == 0xFF
            if self.at >= len(self.data):
                raise Jpeg2000Error("packet header is cut off")
            self.held, self.at = self.data[self.at], self.at + 1
            self.left = 7 if stuffed else 8
        self.left -= 1
        return self.held >> self.left & 1

    def bits(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.bit()
        return out

    def tree(self, _: bool) -> int:
        return self.bit()

    def end(self) -> int:
        if self.held == 0xFF:
            self.at += 1
        return self.at


class _HeaderWriter:
    def __init__(self):
        self.out, self.held, self.left = bytearray(), 0, 8

    def bit(self, v: int) -> None:
        self.left -= 1
        self.held |= v << self.left
        if not self.left:
            self.out.append(self.held)
            self.left, self.held = (7 if self.held == 0xFF else 8), 0

    def bits(self, v: int, n: int) -> None:
        for i in reversed(range(n)):
            self.bit(v >> i & 1)

    def tree(self, below: bool) -> int:
        self.bit(int(below))
        return int(below)

    def end(self) -> bytes:
        full = 7 if self.out and self.out[-1] == 0xFF else 8
        if self.left < full or full == 7:
            self.out.append(self.held)
            if self.held == 0xFF:
                self.out.append(0)
        return bytes(self.out)


@dataclass
class _Style:
    levels: int
    xcb: int
    ycb: int
    flags: int
    reversible: bool
    precincts: list[tuple[int, int]]


@dataclass
class _Steps:
    kind: int
    guard: int
    values: list[tuple[int, int]]  # exponent, mantissa

    def of(self, k: int) -> tuple[int, int]:
        if self.kind == 1:
            e, m = self.values[0]
            return e - max(0, (k - 1) // 3), m
        return self.values[k]


@dataclass
class _Block:
    x0: int
    y0: int
    x1: int
    y1: int
    data: bytearray = field(default_factory=bytearray)
    passes: int = 0
    zero: int = 0
    size: int = 3
    included: bool = False


@dataclass
class _Band:
    name: str
    x0: int
    y0: int
    x1: int
    y1: int
    k: int  # place among the quantisation steps
    precincts: list = field(default_factory=list)  # (blocks wide, blocks high, blocks, inclusion tree, zero-plane tree)


def _up(a: int, b: int) -> int:
    return -(-a // b)


def _bands(box: tuple[int, int, int, int], style: _Style, r: int) -> tuple[tuple[int, int, int, int], int, int, list[_Band]]:
    """(box of a resolution, precincts wide, high, bands with their precincts and code blocks)."""
    x0, y0, x1, y1 = box
    n = style.levels - r
    res = tuple(_up(v, 1 << n) for v in box)
    px, py = style.precincts[r]
    wide = _up(res[2], 1 << px) - (res[0] >> px) if res[2] > res[0] else 0
    high = _up(res[3], 1 << py) - (res[1] >> py) if res[3] > res[1] else 0
    out = []
    for j, (name, ox, oy) in enumerate((("LL", 0, 0),) if r == 0 else (("HL", 1, 0), ("LH", 0, 1), ("HH", 1, 1))):
        nb = style.levels if r == 0 else n + 1
        half = 1 << (nb - 1) if nb else 0
        shift = lambda v, o, nb=nb, half=half: _up(v - half * o, 1 << nb)
        band = _Band(name, shift(x0, ox), shift(y0, oy), shift(x1, ox), shift(y1, oy), 0 if r == 0 else 3 * (r - 1) + 1 + j)
        sx, sy = (px, py) if r == 0 else (px - 1, py - 1)
        cx, cy = min(style.xcb, sx), min(style.ycb, sy)
        for q in range(high):
            for p in range(wide):
                left, top = ((res[0] >> px) + p) << sx, ((res[1] >> py) + q) << sy
                bx0, by0 = max(left, band.x0), max(top, band.y0)
                bx1, by1 = min(left + (1 << sx), band.x1), min(top + (1 << sy), band.y1)
                if bx0 >= bx1 or by0 >= by1:
                    band.precincts.append((0, 0, [], None, None))
                    continue
                gx, gy = range(bx0 >> cx, _up(bx1, 1 << cx)), range(by0 >> cy, _up(by1, 1 << cy))
                blocks = [_Block(max(bx0, i << cx), max(by0, k << cy), min(bx1, (i + 1) << cx), min(by1, (k + 1) << cy)) for k in gy for i in gx]
                band.precincts.append((len(gx), len(gy), blocks, _TagTree(len(gx), len(gy)), _TagTree(len(gx), len(gy))))
        out.append(band)
    return res, wide, high, out


def _read_packet(data: bytes, at: int, bands: list[_Band], p: int, layer: int) -> int:
    if data[at : at + 2] == b"\xff\x91":
        at += 6
    h = _HeaderReader(data, at)
    found = []
    if h.bit():
        for band in bands:
            wide, _, blocks, inclusion, zero = band.precincts[p]
            for i, b in enumerate(blocks):
                x, y = i % wide, i // wide
                if b.included:
                    if not h.bit():
                        continue
                else:
                    if not inclusion.code(x, y, layer + 1, h):
                        continue
                    b.included = True
                    while not zero.code(x, y, b.zero + 1, h):
                        b.zero += 1
                n = 1
                if h.bit():
                    n = 2
                    if h.bit():
                        n = 3 + h.bits(2)
                        if n == 6:
                            n += h.bits(5)
                            if n == 37:
                                n += h.bits(7)
                while h.bit():
                    b.size += 1
                found.append((b, n, h.bits(b.size + n.bit_length() - 1)))
    at = h.end()
    if data[at : at + 2] == b"\xff\x92":
        at += 2
    for b, n, size in found:
        if at + size > len(data):
            raise Jpeg2000Error("code block is cut off")
        b.data += data[at : at + size]
        b.passes += n
        at += size
    return at


def _lifted(low: np.ndarray, high: np.ndarray, start: int, axis: int, reversible: bool) -> np.ndarray:
    """One level of the inverse wavelet along an axis; start: the first sample's coordinate."""
    low, high = np.moveaxis(low, axis, 0), np.moveaxis(high, axis, 0)
    n = len(low) + len(high)
    y = np.zeros((n, *low.shape[1:]), low.dtype if len(low) else high.dtype)
    odd = start & 1
    y[odd::2], y[1 - odd :: 2] = low, high
    if n == 1:
        return np.moveaxis(y if not odd else (y >> 1 if reversible else y / 2), 0, axis)
    pad = 4
    index = np.arange(-pad, n + pad)
    period = 2 * (n - 1)
    index = np.abs((index % period + period) % period)
    index = np.where(index >= n, period - index, index)
    e = y[index]  # extended by mirrors on both ends
    at = (np.arange(-pad, n + pad) + start) & 1
    even, uneven = np.flatnonzero(at == 0), np.flatnonzero(at == 1)
    inner = lambda ix: ix[(ix > 0) & (ix < len(e) - 1)]
    even, uneven = inner(even), inner(uneven)
    if reversible:
        e[even] -= (e[even - 1] + e[even + 1] + 2) >> 2
        e[uneven] += (e[uneven - 1] + e[uneven + 1]) >> 1
    else:
        k = 1.230174104914001
        e[at == 0] *= k
        e[at == 1] /= k
        for ix, factor in ((even, 0.443506852043971), (uneven, 0.882911075530934), (even, -0.052980118572961), (uneven, -1.586134342059924)):
            e[ix] -= factor * (e[ix - 1] + e[ix + 1])
    return np.moveaxis(e[pad:-pad], 0, axis)


def _codestream(data: bytes) -> bytes:
    if data[:2] == b"\xff\x4f":
        return data
    at = 0
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        if kind == b"jp2c":
            return data[at + head : at + size if size else len(data)]
        if size < head:
            break
        at += size
    raise Jpeg2000Error("no JPEG 2000 picture")


def _read_style(body: bytes, has_precincts: bool) -> _Style:
    levels, xcb, ycb, flags, kind = body[:5]
    if levels > 32 or flags & (1 | 4 | 8) or kind > 1:
        raise Jpeg2000Error("coding style not supported")
    sizes = [(b & 15, b >> 4) for b in body[5 : 6 + levels]] if has_precincts else [(15, 15)] * (levels + 1)
    if len(sizes) != levels + 1 or any(r and not (x and y) for r, (x, y) in enumerate(sizes)):
        raise Jpeg2000Error("precincts are damaged")
    return _Style(levels, xcb + 2, ycb + 2, flags, kind == 1, sizes)


def _read_steps(body: bytes) -> _Steps:
    kind, guard = body[0] & 31, body[0] >> 5
    if kind == 0:
        return _Steps(0, guard, [(b >> 3, 0) for b in body[1:]])
    if kind > 2:
        raise Jpeg2000Error("quantisation not supported")
    return _Steps(kind, guard, [(v >> 11, v & 2047) for (v,) in struct.iter_unpack(">H", body[1 : 1 + (len(body) - 1) // 2 * 2])])


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """(rows x columns x components, bits of a sample) of a JPEG 2000 picture whose components are alike and not subsampled; signed samples as they are."""
    try:
        return _decode(_codestream(data))
    except (IndexError, KeyError, struct.error) as e:
        raise Jpeg2000Error("codestream is damaged") from e
    except ValueError as e:
        raise e if isinstance(e, Jpeg2000Error) else Jpeg2000Error("codestream is damaged") from e


def _decode(data: bytes) -> tuple[np.ndarray, int]:
    at, siz, tiles = 2, None, {}
    main: dict = {"cod": None, "coc": {}, "qcd": None, "qcc": {}}
    while True:
        mark = struct.unpack_from(">H", data, at)[0]
        if mark == 0xFFD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, start = data[at + 4 : at + 2 + size], at
        at += 2 + size
        if mark == 0xFF51:
            siz = struct.unpack_from(">H8IH", body)
            parts = [struct.unpack_from("BBB", body, 36 + 3 * i) for i in range(siz[9])]
            if len({p[0] for p in parts}) != 1 or any(p[1:] != (1, 1) for p in parts) or siz[1] <= siz[3] or siz[2] <= siz[4] or not siz[5] or not siz[6]:
                raise Jpeg2000Error("picture size, depth or sampling not supported")
            px = np.zeros((siz[2] - siz[4], siz[1] - siz[3], siz[9]), np.int64)
        elif mark == 0xFF90:
            tile, length, _, _ = struct.unpack(">HIBB", body)
            own = tiles.setdefault(tile, [{**main, "coc": dict(main["coc"]), "qcc": dict(main["qcc"])}, b""])
            end = start + length if length else len(data) - (2 if data[-2:] == b"\xff\xd9" else 0)
            while data[at : at + 2] != b"\xff\x93":
                mark, size = struct.unpack_from(">HH", data, at)
                _read_marker(own[0], mark, data[at + 4 : at + 2 + size], siz[9])
                at += 2 + size
            own[1] += data[at + 2 : end]
            at = end
            if at >= len(data):
                break
        else:
            _read_marker(main, mark, body, siz[9] if siz else 0)
    if siz is None or not tiles:
        raise Jpeg2000Error("no tiles")
    across, down = _up(siz[1] - siz[7], siz[5]), _up(siz[2] - siz[8], siz[6])
    if sorted(tiles) != list(range(across * down)):
        raise Jpeg2000Error("tiles are missing")
    depth, signed = (parts[0][0] & 127) + 1, parts[0][0] >> 7
    for k, (held, body) in sorted(tiles.items()):
        x0, y0 = max(siz[7] + k % across * siz[5], siz[3]), max(siz[8] + k // across * siz[6], siz[4])
        x1, y1 = min(siz[7] + (k % across + 1) * siz[5], siz[1]), min(siz[8] + (k // across + 1) * siz[6], siz[2])
        px[y0 - siz[4] : y1 - siz[4], x0 - siz[3] : x1 - siz[3]] = _tile(held, body, (x0, y0, x1, y1), siz[9], depth, signed)
    return px, depth


def _read_marker(held: dict, mark: int, body: bytes, components: int) -> None:
    wide = 2 if components > 256 else 1
    if mark == 0xFF52:
        held["cod"] = (body[0], body[1], struct.unpack_from(">H", body, 2)[0], body[4], _read_style(body[5:], bool(body[0] & 1)))
    elif mark == 0xFF53:
        held["coc"][int.from_bytes(body[:wide], "big")] = _read_style(body[wide + 1 :], bool(body[wide] & 1))
    elif mark == 0xFF5C:
        held["qcd"] = _read_steps(body)
    elif mark == 0xFF5D:
        held["qcc"][int.from_bytes(body[:wide], "big")] = _read_steps(body[wide:])
    elif mark in (0xFF5E, 0xFF5F, 0xFF60, 0xFF61):
        raise Jpeg2000Error(f"marker {mark:04X} not supported")


def _tile(held: dict, data: bytes, box: tuple[int, int, int, int], components: int, depth: int, signed: int) -> np.ndarray:
    _, progression, layers, mct, style = held["cod"]
    styles = [held["coc"].get(c, style) for c in range(components)]
    steps = [held["qcc"].get(c, held["qcd"]) for c in range(components)]
    plan = [[_bands(box, s, r) for r in range(s.levels + 1)] for s in styles]
    order = []
    for c, resolutions in enumerate(plan):
        for r, (res, wide, high, _) in enumerate(resolutions):
            (sx, sy), n = styles[c].precincts[r], styles[c].levels - r
            for p in range(wide * high):
                x = max(((res[0] >> sx) + p % wide) << (sx + n), box[0])
                y = max(((res[1] >> sy) + p // wide) << (sy + n), box[1])
                for layer in range(layers):
                    keys = ((layer, r, c, p), (r, layer, c, p), (r, y, x, c, p, layer), (y, x, c, r, p, layer), (c, y, x, r, p, layer))
                    order.append((keys[progression], c, r, p, layer))
    at = 0
    for _, c, r, p, layer in sorted(order):
        if at >= len(data):
            break  # fewer layers than announced
        at = _read_packet(data, at, plan[c][r][3], p, layer)
    planes = [_component(plan[c], styles[c], steps[c], depth) for c in range(components)]
    if mct and components >= 3:
        y, u, v = planes[:3]
        if styles[0].reversible:
            g = y - ((u + v) >> 2)
            planes[:3] = [v + g, g, u + g]
        else:
            planes[:3] = [y + 1.402 * v, y - 0.344136 * u - 0.714136 * v, y + 1.772 * u]
    low, high = (-(1 << (depth - 1)), (1 << (depth - 1)) - 1) if signed else (0, (1 << depth) - 1)
    return np.stack([np.clip(np.rint(p).astype(np.int64) + (0 if signed else 1 << (depth - 1)), low, high) for p in planes], 2)


def _component(resolutions: list, style: _Style, steps: _Steps, depth: int) -> np.ndarray:
    kind = np.int64 if style.reversible else np.float64
    out = None
    for r, (res, _, _, bands) in enumerate(resolutions):
        found = {}
        for band in bands:
            a = np.zeros((max(0, band.y1 - band.y0), max(0, band.x1 - band.x0)), kind)
            exponent, mantissa = steps.of(band.k)
            most = steps.guard + exponent - 1
            gain = {"LL": 0, "HL": 1, "LH": 1, "HH": 2}[band.name]
            step = 1 if style.reversible else 2.0 ** (depth + gain - exponent) * (1 + mantissa / 2048)
            for *_, blocks, _, _ in band.precincts:
                for b in blocks:
                    if not b.passes:
                        continue
                    coded = _Planes(b.x1 - b.x0, b.y1 - b.y0, band.name, MqDecoder(bytes(b.data)))
                    last = coded.run(most - b.zero, b.passes, bool(style.flags & 2), bool(style.flags & 32))
                    v = coded.values()
                    if not style.reversible:
                        v = np.where(v == 0, 0.0, (np.abs(v) + 0.5 * (1 << last)) * np.sign(v)) * step
                    elif last:
                        v = np.where(v == 0, 0, (np.abs(v) + (1 << last >> 1)) * np.sign(v))
                    a[b.y0 - band.y0 : b.y1 - band.y0, b.x0 - band.x0 : b.x1 - band.x0] = v
            found[band.name] = a
        if r == 0:
            out = found["LL"]
            continue
        low = _lifted(out, found["HL"], res[0], 1, style.reversible)
        high = _lifted(found["LH"], found["HH"], res[0], 1, style.reversible)
        out = _lifted(low, high, res[1], 0, style.reversible)
    return out


def _split(a: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """One level of the reversible wavelet along an axis that starts at 0."""
    x = np.moveaxis(a, axis, 0).copy()
    n = len(x)
    if n == 1:
        return np.moveaxis(x, 0, axis), np.moveaxis(x[:0], 0, axis)
    mirror = lambda ix: np.where(ix >= n, 2 * (n - 1) - ix, np.abs(ix))
    uneven, even = np.arange(1, n, 2), np.arange(0, n, 2)
    x[uneven] -= (x[uneven - 1] + x[mirror(uneven + 1)]) >> 1
    x[even] += (x[mirror(even - 1)] + x[mirror(even + 1)] + 2) >> 2
    return np.moveaxis(x[0::2], 0, axis), np.moveaxis(x[1::2], 0, axis)


def encode(px: np.ndarray, bits: int, levels: int = 5) -> bytes:
    """A lossless codestream of (rows, columns, components) unsigned samples: one tile, one layer, three components as luma and differences."""
    rows, columns, count = px.shape
    if not 1 <= bits <= 16 or not rows or not columns or not 0 < count < 257:
        raise Jpeg2000Error("picture size not supported")
    levels = min(levels, max(0, min(rows, columns).bit_length() - 1))
    planes = [px[:, :, c].astype(np.int64) - (1 << (bits - 1)) for c in range(count)]
    if count == 3:
        r, g, b = planes
        planes = [(r + 2 * g + b) >> 2, b - g, r - g]
    guard = 2
    gains = [0, *(g for _ in range(levels) for g in (1, 1, 2))]
    exponents = [bits + (count == 3) + g for g in gains]
    style = _Style(levels, 6, 6, 0, True, [(15, 15)] * (levels + 1))
    packets = []
    resolved = []
    for plane in planes:
        bands: dict[int, dict[str, np.ndarray]] = {}
        low = plane
        for r in range(levels, 0, -1):
            top, bottom = _split(low, 0)
            ll, hl = _split(top, 1)
            lh, hh = _split(bottom, 1)
            bands[r], low = {"HL": hl, "LH": lh, "HH": hh}, ll
        bands[0] = {"LL": low}
        resolved.append(bands)
    for r in range(levels + 1):
        for c in range(count):
            _, wide, high, listed = _bands((0, 0, columns, rows), style, r)
            h, body = _HeaderWriter(), b""
            if wide * high:
                h.bit(1)
                for band in listed:
                    across, _, blocks, inclusion, zero = band.precincts[0]
                    most = guard + exponents[band.k] - 1
                    for b in blocks:
                        a = resolved[c][r][band.name][b.y0 - band.y0 : b.y1 - band.y0, b.x0 - band.x0 : b.x1 - band.x0]
                        n = int(np.abs(a).max(initial=0)).bit_length()
                        b.zero, b.passes = most - n, max(0, 3 * n - 2)
                        if n:
                            coder = MqEncoder()
                            _Planes(b.x1 - b.x0, b.y1 - b.y0, band.name, coder, a.ravel().tolist()).run(n, b.passes)
                            b.data = bytearray(coder.flush())
                    if blocks:
                        inclusion.set([0 if b.passes else 1 for b in blocks])
                        zero.set([b.zero for b in blocks])
                    for i, b in enumerate(blocks):
                        x, y = i % across, i // across
                        if not inclusion.code(x, y, 1, h):
                            continue
                        for t in range(1, b.zero + 2):
                            zero.code(x, y, t, h)
                        n = b.passes
                        if n == 1:
                            h.bit(0)
                        elif n == 2:
                            h.bits(2, 2)
                        elif n < 6:
                            h.bits(12 | (n - 3), 4)
                        elif n < 37:
                            h.bits(15 << 5 | (n - 6), 9)
                        else:
                            h.bits(511 << 7 | (n - 37), 16)
                        extra = n.bit_length() - 1
                        size = max(3, len(b.data).bit_length() - extra)
                        h.bits((1 << (size - 2)) - 2, size - 2)
                        h.bits(len(b.data), size + extra)
                        body += bytes(b.data)
                packets.append(h.end() + body)
    segment = lambda mark, b: struct.pack(">HH", mark, len(b) + 2) + b
    siz = struct.pack(">H8IH", 0, columns, rows, 0, 0, columns, rows, 0, 0, count) + bytes((bits - 1, 1, 1)) * count
    cod = bytes((0, 0, 0, 1, int(count == 3), levels, 4, 4, 0, 1))
    qcd = bytes((guard << 5, *(e << 3 for e in exponents)))
    body = b"".join(packets)
    tile = struct.pack(">HHHIBB", 0xFF90, 10, 0, 14 + len(body), 0, 1) + b"\xff\x93" + body
    return b"\xff\x4f" + segment(0xFF51, siz) + segment(0xFF52, cod) + segment(0xFF5C, qcd) + tile + b"\xff\xd9"
