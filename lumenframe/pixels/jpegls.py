"""JPEG-LS (ITU-T T.87): decoder of lossless and near-lossless pictures of any interleave, lossless and near-lossless encoder.

Plain Python loops over samples: the state of the context model changes with every one.
"""

from __future__ import annotations

import struct

import numpy as np

# Orders of run lengths.
_J = (0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 9, 10, 11, 12, 13, 14, 15)


class JpegLsError(ValueError):
    pass


class _Model:
    """The context model of one scan: thresholds, counters and prediction."""

    def __init__(self, top: int, near: int, thresholds: tuple[int, int, int] | None = None, reset: int = 64):
        self.top, self.near, self.reset = top, near, reset
        self.step = 2 * near + 1
        self.range = (top + 2 * near) // self.step + 1
        self.qbpp = max(1, (self.range - 1).bit_length())
        bpp = max(2, top.bit_length())
        self.limit = 2 * (bpp + max(8, bpp))
        t1, t2, t3 = thresholds or self._defaults()
        self.q = {}
        for d in range(-top, top + 1):
            a = abs(d)
            size = 0 if a <= near else 1 if a < t1 else 2 if a < t2 else 3 if a < t3 else 4
            self.q[d] = size if d >= 0 else -size
        start = max(2, (self.range + 32) // 64)
        self.a, self.b, self.c, self.n = [start] * 367, [0] * 367, [0] * 367, [1] * 367  # b counts negative errors in the two run contexts

    def _defaults(self) -> tuple[int, int, int]:
        top, near = self.top, self.near
        clamp = lambda v, low: low if v > top or v < low else v
        if top >= 128:
            f = (min(top, 4095) + 128) // 256
            want = (f + 2 + 3 * near, f * 4 + 3 + 5 * near, f * 17 + 4 + 7 * near)
        else:
            f = 256 // (top + 1)
            want = (max(2, 3 // f + 3 * near), max(3, 7 // f + 5 * near), max(4, 21 // f + 7 * near))
        t1 = clamp(want[0], near + 1)
        t2 = clamp(want[1], t1)
        return t1, t2, clamp(want[2], t2)

    def context(self, a: int, b: int, c: int, d: int) -> tuple[int, int]:
        """(context, sign) of a sample's neighbours; context 0 is a run."""
        q = 81 * self.q[d - b] + 9 * self.q[b - c] + self.q[c - a]
        return (-q, -1) if q < 0 else (q, 1)

    def predicted(self, a: int, b: int, c: int, q: int, sign: int) -> int:
        p = min(a, b) if c >= max(a, b) else max(a, b) if c <= min(a, b) else a + b - c
        return min(max(p + sign * self.c[q], 0), self.top)

    def order(self, q: int, extra: int = 0) -> int:
        k, n, a = 0, self.n[q], self.a[q] + extra
        while n << k < a:
            k += 1
        return k

    def learn(self, q: int, error: int) -> None:
        a, b, c, n = self.a[q] + abs(error), self.b[q] + error * self.step, self.c[q], self.n[q]
        if n == self.reset:
            a, b, n = a >> 1, b >> 1 if b >= 0 else -((1 - b) >> 1), n >> 1
        n += 1
        if b <= -n:
            b, c = max(b + n, 1 - n), max(c - 1, -128)
        elif b > 0:
            b, c = min(b - n, 0), min(c + 1, 127)
        self.a[q], self.b[q], self.c[q], self.n[q] = a, b, c, n

    def learn_run(self, q: int, error: int, mapped: int) -> None:
        if error < 0:
            self.b[q] += 1
        self.a[q] += (mapped + 1 - (q - 365)) >> 1
        if self.n[q] == self.reset:
            self.a[q], self.b[q], self.n[q] = self.a[q] >> 1, self.b[q] >> 1, self.n[q] >> 1
        self.n[q] += 1

    def rebuilt(self, p: int, error: int) -> int:
        x = p + error * self.step
        if x < -self.near:
            x += self.range * self.step
        elif x > self.top + self.near:
            x -= self.range * self.step
        return min(max(x, 0), self.top)

    def reduced(self, error: int) -> int:
        """An error of prediction, quantised and folded into the range."""
        if self.near:
            error = (error + self.near) // self.step if error > 0 else -((self.near - error) // self.step)
        if error < 0:
            error += self.range
        return error - self.range if error >= (self.range + 1) // 2 else error


class _Bits:
    """Bits of coded data as a text of digits: after a byte FF the next one has seven."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        bits = np.unpackbits(raw).reshape(-1, 8)
        keep = np.ones(bits.shape, bool)
        keep[1:, 0] = raw[:-1] != 255
        self.text, self.at = (bits[keep] + 48).tobytes().decode("ascii"), 0

    def golomb(self, k: int, limit: int, qbpp: int) -> int:
        one = self.text.find("1", self.at)
        if one < 0:
            raise JpegLsError("coded data are cut off")
        zeros, self.at = one - self.at, one + 1
        if zeros < limit - qbpp - 1:
            return zeros << k | self.take(k)
        return self.take(qbpp) + 1

    def take(self, k: int) -> int:
        if not k:
            return 0
        if self.at + k > len(self.text):
            raise JpegLsError("coded data are cut off")
        self.at += k
        return int(self.text[self.at - k : self.at], 2)


class _Line:
    """Decodes the lines of one component."""

    def __init__(self, width: int):
        self.width, self.run = width, 0
        self.above, self.own = [0] * (width + 2), [0] * (width + 2)

    def begin(self) -> None:
        self.above, self.own = self.own, self.above
        self.above[-1] = self.above[-2]
        self.own[0] = self.above[1]


def _read_error(m: _Model, bits: _Bits, q: int) -> int:
    k = m.order(q)
    v = bits.golomb(k, m.limit, m.qbpp)
    error = (v >> 1) if v % 2 == 0 else -((v + 1) >> 1)
    if not m.near and not k and 2 * m.b[q] <= -m.n[q]:
        error = -error - 1
    m.learn(q, error)
    return error


def _read_break(m: _Model, bits: _Bits, kind: int, order: int) -> int:
    """The error of the sample that ends a run."""
    q = 365 + kind
    k = m.order(q, m.n[q] >> 1 if kind else 0)
    v = bits.golomb(k, m.limit - order - 1, m.qbpp)
    odd = (v + kind) & 1
    size = (v + kind + odd) >> 1
    error = -size if (k != 0 or 2 * m.b[q] >= m.n[q]) == bool(odd) else size
    m.learn_run(q, error, v)
    return error


def _read_run(bits: _Bits, line: _Line, left: int) -> tuple[int, bool]:
    """(samples of a run, whether a sample ends it before the line's end)."""
    n = 0
    while n < left:
        if not bits.take(1):
            return n + bits.take(_J[line.run]), True
        whole = 1 << _J[line.run]
        if n + whole > left:
            return left, False
        n += whole
        line.run = min(line.run + 1, 31)
    return n, False


def _decode_line(m: _Model, bits: _Bits, line: _Line) -> None:
    above, own, x, w = line.above, line.own, 1, line.width
    while x <= w:
        a, b, c, d = own[x - 1], above[x], above[x - 1], above[x + 1]
        q, sign = m.context(a, b, c, d)
        if q:
            p = m.predicted(a, b, c, q, sign)
            own[x] = m.rebuilt(p, sign * _read_error(m, bits, q))
            x += 1
            continue
        n, broken = _read_run(bits, line, w + 1 - x)
        if x + n > w + (not broken):
            raise JpegLsError("a run is longer than its line")
        own[x : x + n] = [a] * n
        x += n
        if broken:
            b = above[x]
            kind = int(abs(a - b) <= m.near)
            error = _read_break(m, bits, kind, _J[line.run])
            own[x] = m.rebuilt(a, error) if kind else m.rebuilt(b, -error if a > b else error)
            line.run = max(line.run - 1, 0)
            x += 1


def _decode_samples(m: _Model, bits: _Bits, lines: list[_Line]) -> None:
    """One line of sample-interleaved components: a run is one of all components."""
    x, w, first = 1, lines[0].width, lines[0]
    while x <= w:
        around = [(s.own[x - 1], s.above[x], s.above[x - 1], s.above[x + 1]) for s in lines]
        contexts = [m.context(*r) for r in around]
        if any(q for q, _ in contexts):
            for s, (a, b, c, _), (q, sign) in zip(lines, around, contexts, strict=True):
                s.own[x] = m.rebuilt(m.predicted(a, b, c, q, sign), sign * _read_error(m, bits, q))
            x += 1
            continue
        n, broken = _read_run(bits, first, w + 1 - x)
        if x + n > w + (not broken):
            raise JpegLsError("a run is longer than its line")
        for s, (a, *_) in zip(lines, around, strict=True):
            s.own[x : x + n] = [a] * n
        x += n
        if broken:
            for s, (a, *_) in zip(lines, around, strict=True):
                error = _read_break(m, bits, 0, _J[first.run])
                s.own[x] = m.rebuilt(s.above[x], -error if a > s.above[x] else error)
            first.run = max(first.run - 1, 0)
            x += 1


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """(rows x columns x components, bits of a sample) of a JPEG-LS picture."""
    at, shape, bits, ids = 2, None, 8, []
    top = thresholds = None
    reset, px, done = 64, None, 0
    if data[:2] != b"\xff\xd8":
        raise JpegLsError("no JPEG picture")
    try:
        while shape is None or done < shape[2]:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            if data[at] != 0xFF:
                raise JpegLsError(f"no marker at {at}")
            mark, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if mark == 0xF7:
                bits, rows, columns, count = struct.unpack_from(">BHHB", body)
                if not rows or not columns or not count or not 2 <= bits <= 16 or any(body[7 + 3 * i] != 0x11 for i in range(count)):
                    raise JpegLsError("picture size or sampling not supported")
                ids, shape = [body[6 + 3 * i] for i in range(count)], (rows, columns, count)
                px = np.zeros(shape, np.int64)
            elif mark == 0xF8 and body[0] == 1:
                top, *rest, reset = struct.unpack(">5H", body[1:11])
                thresholds = tuple(rest) if any(rest) else None
                top, reset = top or None, reset or 64
            elif mark == 0xF8 or mark == 0xDD or mark == 0xD9 or 0xC0 <= mark <= 0xCF:
                raise JpegLsError(f"marker {mark:02X} not supported")
            elif mark == 0xDA:
                if shape is None:
                    raise JpegLsError("scan before frame")
                own = [ids.index(body[1 + 2 * i]) for i in range(body[0])]
                near, interleave, shift = body[1 + 2 * body[0]], body[2 + 2 * body[0]], body[3 + 2 * body[0]] & 15
                if interleave > 2 or shift or any(body[2 + 2 * i] for i in range(body[0])):
                    raise JpegLsError("scan parameters not supported")
                end = at
                while (end := data.find(b"\xff", end)) >= 0 and end + 1 < len(data) and data[end + 1] < 128:
                    end += 1
                end = len(data) if end < 0 else end
                model, stream, lines = _Model(top or (1 << bits) - 1, near, thresholds, reset), _Bits(data[at:end]), [_Line(shape[1]) for _ in own]
                for y in range(shape[0]):
                    for s in lines:
                        s.begin()
                    if interleave == 2:
                        _decode_samples(model, stream, lines)
                    else:
                        for s in lines:
                            _decode_line(model, stream, s)
                    for k, s in zip(own, lines, strict=True):
                        px[y, :, k] = s.own[1:-1]
                at, done = end, done + len(own)
    except (IndexError, KeyError, struct.error) as e:
        raise JpegLsError("segment is damaged") from e
    except ValueError as e:
        raise e if isinstance(e, JpegLsError) else JpegLsError("segment is damaged") from e
    return px, bits


class _Writer:
    def __init__(self):
        self.parts: list[str] = []

    def golomb(self, v: int, k: int, limit: int, qbpp: int) -> None:
        if v >> k < limit - qbpp - 1:
            self.parts.append("0" * (v >> k) + "1")
            self.put(v & ((1 << k) - 1), k)
        else:
            self.parts.append("0" * (limit - qbpp - 1) + "1")
            self.put(v - 1, qbpp)

    def put(self, v: int, k: int) -> None:
        if k:
            self.parts.append(format(v, f"0{k}b"))

    def bytes(self) -> bytes:
        text, out, at = "".join(self.parts), bytearray(), 0
        while at < len(text):
            n = 7 if out and out[-1] == 255 else 8
            out.append(int(text[at : at + n].ljust(n, "0"), 2))
            at += n
        if out and out[-1] == 255:
            out.append(0)
        return bytes(out)


def _encode_line(m: _Model, out: _Writer, line: _Line, want: list[int]) -> None:
    above, own, x, w = line.above, line.own, 1, line.width
    while x <= w:
        a, b, c, d = own[x - 1], above[x], above[x - 1], above[x + 1]
        q, sign = m.context(a, b, c, d)
        if q:
            p = m.predicted(a, b, c, q, sign)
            error = m.reduced(sign * (want[x - 1] - p))
            k = m.order(q)
            mirrored = not m.near and not k and 2 * m.b[q] <= -m.n[q]
            e = -error - 1 if mirrored else error
            out.golomb(2 * e if e >= 0 else -2 * e - 1, k, m.limit, m.qbpp)
            m.learn(q, error)
            own[x] = m.rebuilt(p, sign * error)
            x += 1
            continue
        n = 0
        while x + n <= w and abs(want[x + n - 1] - a) <= m.near:
            n += 1
        own[x : x + n] = [a] * n
        x, left = x + n, n
        while left >= 1 << _J[line.run]:
            out.put(1, 1)
            left -= 1 << _J[line.run]
            line.run = min(line.run + 1, 31)
        if x > w:
            if left:
                out.put(1, 1)
            continue
        out.put(left, _J[line.run] + 1)  # a 0 and the rest of the run
        b = above[x]
        kind = int(abs(a - b) <= m.near)
        p, turn = (a, 1) if kind else (b, -1 if a > b else 1)
        error, q = m.reduced(turn * (want[x - 1] - p)), 365 + kind
        k = m.order(q, m.n[q] >> 1 if kind else 0)
        odd = (error > 0 and not k and 2 * m.b[q] < m.n[q]) or (error < 0 and (k != 0 or 2 * m.b[q] >= m.n[q]))
        v = 2 * abs(error) - kind - odd
        out.golomb(v, k, m.limit - _J[line.run] - 1, m.qbpp)
        m.learn_run(q, error, v)
        own[x] = m.rebuilt(p, turn * error)
        line.run = max(line.run - 1, 0)
        x += 1


def encode(px: np.ndarray, bits: int, near: int = 0) -> bytes:
    """A JPEG-LS picture of (rows, columns, components) samples, a scan for each component."""
    rows, columns, count = px.shape
    if not 2 <= bits <= 16 or not 0 < rows < 65536 or not 0 < columns < 65536 or not 0 < count < 256:
        raise JpegLsError("picture size not supported")
    out = [b"\xff\xd8\xff\xf7", struct.pack(">HBHHB", 8 + 3 * count, bits, rows, columns, count), b"".join(bytes((i + 1, 0x11, 0)) for i in range(count))]
    for i in range(count):
        m, coded, line = _Model((1 << bits) - 1, near), _Writer(), _Line(columns)
        for want in px[:, :, i].tolist():
            line.begin()
            _encode_line(m, coded, line, want)
        out += [b"\xff\xda", struct.pack(">HBBBBBB", 8, 1, i + 1, 0, near, 0, 0), coded.bytes()]
    return b"".join(out) + b"\xff\xd9"
