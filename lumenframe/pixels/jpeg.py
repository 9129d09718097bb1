"""JPEG with Huffman coding (ITU-T T.81) in NumPy: lossless pictures (process 14), baseline, extended sequential and progressive DCT pictures (1, 2, 4, 10), a baseline encoder and a lossless one."""

from __future__ import annotations

import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np


class JpegError(ValueError):
    pass


def _huffman(counts: bytes, values: bytes) -> list[tuple[int, int]]:
    """(code length, value) for every 16 bits that may come next; length 0 where no code begins so."""
    table, code, at = [(0, 0)] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            if code >> length or at >= len(values):
                raise JpegError("Huffman table overflows")
            lo = code << (16 - length)
            table[lo : lo + (1 << (16 - length))] = [(length, values[at])] * (1 << (16 - length))
            code, at = code + 1, at + 1
        code <<= 1
    return table


def _differences(data: bytes, tables: list[list[tuple[int, int]]], n: int) -> np.ndarray:
    """n differences of every component in turn from one restart interval."""
    data = data.replace(b"\xff\x00", b"\xff")
    whole, held, bits, at = 8 * len(data), 0, 0, 0
    out, used = [], 0
    for _ in range(n):
        for table in tables:
            if bits < 32:
                held = (held & ((1 << bits) - 1)) << 64 | int.from_bytes(data[at : at + 8].ljust(8, b"\0"), "big")
                bits, at = bits + 64, at + 8
            length, size = table[held >> (bits - 16) & 65535]
            bits -= length
            more = size if size < 16 else 0
            bits -= more
            used += length + more
            if not length or size > 16 or used > whole:
                raise JpegError("entropy-coded data are damaged or cut off")
            low = held >> bits & ((1 << more) - 1)
            out.append(32768 if size == 16 else low if not size or low >> (size - 1) else low - (1 << size) + 1)
    return np.array(out, np.int64).reshape(n, len(tables))


def _predicted(d: np.ndarray, predictor: int, first: int) -> np.ndarray:
    """Samples of one component of an interval from differences (rows x columns)."""
    d = d.copy()
    d[0, 0] += first
    if predictor == 1:
        d[:, 0] = np.cumsum(d[:, 0])
        return np.cumsum(d, axis=1) & 65535
    if predictor == 2:
        d[0] = np.cumsum(d[0])
        return np.cumsum(d, axis=0) & 65535
    if predictor == 4:
        return np.cumsum(np.cumsum(d, axis=0), axis=1) & 65535
    rule = {3: lambda a, b, c: c, 5: lambda a, b, c: a + ((b - c) >> 1), 6: lambda a, b, c: b + ((a - c) >> 1), 7: lambda a, b, c: (a + b) >> 1}[predictor]
    above = (np.cumsum(d[0]) & 65535).tolist()
    out = [above]
    for row in d[1:].tolist():
        a = (above[0] + row[0]) & 65535
        own = [a]
        for j in range(1, len(row)):
            a = (rule(a, above[j], above[j - 1]) + row[j]) & 65535
            own.append(a)
        out.append(own)
        above = own
    return np.array(out, np.int64)


def _segments(data: bytes, may_end: list | None = None) -> Iterator[tuple[int, bytes, bytes]]:
    """(marker, body, entropy-coded bytes that follow a scan's header) of a picture; its end is an error, as readers stop at their last scan, unless may_end has something in it."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no JPEG picture")
    at = 2
    while True:
        if may_end and data[at : at + 2] == b"\xff\xd9":
            return
        if at + 4 > len(data) or data[at] != 0xFF:
            raise JpegError("marker expected")
        mark = data[at + 1]
        if mark == 0xFF:  # fill byte
            at += 1
            continue
        if mark == 0xD9:
            raise JpegError("picture ends before its last scan")
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise JpegError("segment is cut off")
        at += 2 + size
        coded = b""
        if mark == 0xDA:
            end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, at)
            coded = data[at : end.start() if end else len(data)]
            at += len(coded)
        yield mark, body, coded


def _read_huffman(body: bytes, tables: dict[int, list[tuple[int, int]]]) -> None:
    while body:
        n = sum(body[1:17])
        tables[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
        body = body[17 + n :]


def decode_lossless(data: bytes) -> tuple[np.ndarray, int]:
    """(rows x columns x components, bits of a sample) of a lossless JPEG picture."""
    tables: dict[int, list[tuple[int, int]]] = {}
    restart, shape, ids, px, bits = 0, None, [], None, 0
    done: set[int] = set()
    try:
        for mark, body, coded in _segments(data):
            if mark == 0xC4:
                _read_huffman(body, tables)
            elif mark == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif mark == 0xC3:
                bits, rows, columns, n = struct.unpack_from(">BHHB", body)
                ids = [body[6 + 3 * i] for i in range(n)]
                if not rows or not columns or not n or not 2 <= bits <= 16 or any(body[7 + 3 * i] != 0x11 for i in range(n)):
                    raise JpegError("picture size or sampling not supported")
                shape, px = (rows, columns), np.zeros((rows, columns, n), np.int64)
            elif 0xC0 <= mark <= 0xCF and mark != 0xCC:
                raise JpegError(f"JPEG process {mark - 0xC0} not supported")
            elif mark == 0xDA:
                if shape is None:
                    raise JpegError("scan before frame")
                own = [ids.index(body[1 + 2 * i]) for i in range(body[0])]
                used = [tables[body[2 + 2 * i] >> 4] for i in range(body[0])]
                predictor, shift = body[1 + 2 * body[0]], body[3 + 2 * body[0]] & 15
                if not 1 <= predictor <= 7 or not own or shift >= bits or restart % columns:
                    raise JpegError("scan parameters not supported")
                step = restart // columns or rows
                parts = re.split(rb"\xff+[\xd0-\xd7]", coded) if restart else [coded]
                if len(parts) < -(-rows // step):
                    raise JpegError("restart intervals are missing")
                for lo, part in zip(range(0, rows, step), parts, strict=False):
                    high = min(step, rows - lo)
                    d = _differences(part, used, high * columns)
                    for k, c in enumerate(own):
                        px[lo : lo + high, :, c] = (_predicted(d[:, k].reshape(high, columns), predictor, 1 << (bits - shift - 1)) << shift) & 65535
                done |= set(own)
                if len(done) == len(ids):
                    break
    except (IndexError, KeyError, struct.error) as e:
        raise JpegError("segment is damaged") from e
    except ValueError as e:
        raise e if isinstance(e, JpegError) else JpegError("segment is damaged") from e
    return px, bits


#: Place in a block (row * 8 + column) of each coefficient as it is coded: diagonals, upwards and downwards in turn.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
#: Row u holds the u-th cosine of eight samples, orthonormal.
COSINES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _blocks(data: bytes, plan: list[tuple[int, list, list]], n: int) -> list[list[int]]:
    """Coefficients, as coded, of the blocks of n units of one restart interval; plan: (component, DC and AC table) of each block of a unit."""
    data = data.replace(b"\xff\x00", b"\xff")
    whole, held, bits, at = 8 * len(data), 0, 0, 0
    before, out = dict.fromkeys((k for k, _, _ in plan), 0), []
    for _ in range(n):
        for k, dc, ac in plan:
            block, i = [0] * 64, 0
            while i < 64:
                if bits < 32:
                    held = (held & ((1 << bits) - 1)) << 64 | int.from_bytes(data[at : at + 8].ljust(8, b"\0"), "big")
                    bits, at = bits + 64, at + 8
                length, value = (ac if i else dc)[held >> (bits - 16) & 65535]
                run, size = (value >> 4, value & 15) if i else (0, value)
                if not length or size > 15:
                    raise JpegError("entropy-coded data are damaged")
                bits -= length + size
                low = held >> bits & ((1 << size) - 1)
                if not i:
                    before[k] += low if not size or low >> (size - 1) else low - (1 << size) + 1
                    block[0] = before[k]
                    i = 1
                elif size:
                    i += run
                    if i > 63:
                        raise JpegError("a block has too many coefficients")
                    block[i] = low if low >> (size - 1) else low - (1 << size) + 1
                    i += 1
                elif run == 15:
                    i += 16
                else:
                    break
            if 8 * at - bits > whole:
                raise JpegError("entropy-coded data are cut off")
            out.append(block)
    return out


class _Bits:
    """Single bits and codes of entropy-coded data, for progressive scans."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff")
        self.whole, self.held, self.left, self.at = 8 * len(self.data), 0, 0, 0

    def take(self, n: int) -> int:
        if not n:
            return 0
        while self.left < 32:
            self.held = (self.held & ((1 << self.left) - 1)) << 64 | int.from_bytes(self.data[self.at : self.at + 8].ljust(8, b"\0"), "big")
            self.left, self.at = self.left + 64, self.at + 8
        self.left -= n
        if 8 * self.at - self.left > self.whole:
            raise JpegError("entropy-coded data are cut off")
        return self.held >> self.left & ((1 << n) - 1)

    def symbol(self, table: list[tuple[int, int]]) -> int:
        if self.left < 32:
            self.take(1)
            self.left += 1
        length, value = table[self.held >> (self.left - 16) & 65535]
        if not length:
            raise JpegError("entropy-coded data are damaged")
        self.take(length)
        return value

    def value(self, size: int) -> int:
        low = self.take(size)
        return low if not size or low >> (size - 1) else low - (1 << size) + 1


def _progress(data: bytes, plan: list[tuple[int, list, list]], blocks: list[list[int]], band: tuple[int, int], high: int, low: int) -> None:
    """One restart interval of a progressive scan into blocks (coefficients as coded), in the order of the plan's units. band: first and last coefficient; high: bits that earlier scans gave; low: bits left out."""
    bits = _Bits(data)
    first, last = band
    one, skip = 1 << low, 0
    before = dict.fromkeys((k for k, _, _ in plan), 0)

    def refine(block: list[int], i: int) -> None:
        if bits.take(1) and not abs(block[i]) & one:
            block[i] += one if block[i] > 0 else -one

    for at, block in enumerate(blocks):
        k, dc, ac = plan[at % len(plan)]
        if not first:
            if high:
                block[0] |= bits.take(1) << low
            else:
                before[k] += bits.value(bits.symbol(dc))
                block[0] = before[k] << low
            continue
        i = first
        if not skip:
            while i <= last:
                run, size = divmod(bits.symbol(ac), 16)
                if not size and run < 15:
                    skip = (1 << run) + bits.take(run)
                    break
                if not high:
                    i += run
                    if i > last:
                        raise JpegError("a block has too many coefficients")
                    if size:
                        block[i] = bits.value(size) << low
                    i += 1
                    continue
                new = (one if bits.take(1) else -one) if size else 0
                while i <= last:
                    if block[i]:
                        refine(block, i)
                    else:
                        run -= 1
                        if run < 0:
                            break
                    i += 1
                if new and i <= last:
                    block[i] = new
                i += 1
        if skip:
            if high:
                for j in range(i, last + 1):
                    if block[j]:
                        refine(block, j)
            skip -= 1


def decode_dct(data: bytes) -> tuple[np.ndarray, int, int | None]:
    """(rows x columns x components, bits of a sample, colour transform of an Adobe or JFIF marker) of a sequential or progressive DCT picture; subsampled components are repeated."""
    tables: dict[int, list[tuple[int, int]]] = {}
    steps: dict[int, np.ndarray] = {}
    restart, parts, transform, jfif, ids = 0, [], None, False, []
    done: set[int] = set()
    progressive: list[int] = []
    try:
        for mark, body, coded in _segments(data, progressive):
            if mark == 0xC4:
                _read_huffman(body, tables)
            elif mark == 0xDB:
                while body:
                    wide = body[0] >> 4
                    steps[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                    body = body[1 + 64 * (2 if wide else 1) :]
            elif mark == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif mark == 0xE0:
                jfif = jfif or body[:5] == b"JFIF\0"
            elif mark == 0xEE and body[:5] == b"Adobe":
                transform = body[11]
            elif mark in (0xC0, 0xC1, 0xC2):
                if mark == 0xC2:
                    progressive.append(mark)
                bits, rows, columns, n = struct.unpack_from(">BHHB", body)
                ids = [body[6 + 3 * i] for i in range(n)]
                across, down, quant = ([f(body[7 + 3 * i + j]) for i in range(n)] for f, j in ((lambda b: b >> 4, 0), (lambda b: b & 15, 0), (int, 1)))
                if not rows or not columns or not n or bits not in (8, 12) or not all(1 <= x <= 4 for x in across + down):
                    raise JpegError("picture size or sampling not supported")
                most_x, most_y = max(across), max(down)
                if any(most_x % x for x in across) or any(most_y % y for y in down):
                    raise JpegError("sampling is not by whole factors")
                units_x, units_y = -(-columns // (8 * most_x)), -(-rows // (8 * most_y))
                parts = [np.zeros((units_y * down[k], units_x * across[k], 64), np.int64) for k in range(n)]
            elif 0xC0 <= mark <= 0xCF and mark != 0xCC:
                raise JpegError(f"JPEG process {mark - 0xC0} not supported")
            elif mark == 0xDA:
                if not parts:
                    raise JpegError("scan before frame")
                own = [ids.index(body[1 + 2 * i]) for i in range(body[0])]
                used = [(tables.get(body[2 + 2 * i] >> 4), tables.get(16 | body[2 + 2 * i] & 15)) for i in range(body[0])]
                first, last, high_bits, low_bits = body[1 + 2 * body[0]], body[2 + 2 * body[0]], body[3 + 2 * body[0]] >> 4, body[3 + 2 * body[0]] & 15
                if any((dc is None and not first and not (progressive and high_bits)) or (ac is None and (first or not progressive)) for dc, ac in used):
                    raise JpegError("a scan lacks its tables")
                if len(own) == 1:  # blocks of the component alone, without those that only fill units
                    k = own[0]
                    wide, high = -(-(-(-columns * across[k] // most_x)) // 8), -(-(-(-rows * down[k] // most_y)) // 8)
                    inside = [(k, 0, 0)]
                    grow = {k: (1, 1)}
                else:
                    wide, high = units_x, units_y
                    inside = [(k, y, x) for k in own for y in range(down[k]) for x in range(across[k])]
                    grow = {k: (down[k], across[k]) for k in own}
                plan = [(k, *used[own.index(k)]) for k, _, _ in inside]
                total, step = wide * high, restart or wide * high
                runs = re.split(rb"\xff+[\xd0-\xd7]", coded) if restart else [coded]
                if not own or len(runs) < -(-total // step):
                    raise JpegError("restart intervals are missing")
                if progressive:
                    if first > last or last > 63 or (first == 0) != (last == 0) or (first and len(own) > 1) or low_bits > 13:
                        raise JpegError("scan parameters not supported")
                    views = [parts[k][y : high * grow[k][0] : grow[k][0], x : wide * grow[k][1] : grow[k][1]] for k, y, x in inside]
                    blocks = np.stack(views, 2).reshape(-1, 64).tolist()
                    for lo, run in zip(range(0, total, step), runs, strict=False):
                        _progress(run, plan, blocks[lo * len(plan) : min(lo + step, total) * len(plan)], (first, last), high_bits, low_bits)
                    found = blocks
                else:
                    found = [b for lo, run in zip(range(0, total, step), runs, strict=False) for b in _blocks(run, plan, min(step, total - lo))]
                each = np.array(found, np.int64).reshape(high, wide, len(inside), 64)
                for j, (k, y, x) in enumerate(inside):
                    parts[k][y : high * grow[k][0] : grow[k][0], x : wide * grow[k][1] : grow[k][1]] = each[:, :, j]
                done |= set(own)
                if len(done) == len(ids) and not progressive:
                    break
        if len(done) < len(ids):
            raise JpegError("scans are missing")
        planes = []
        for k, part in enumerate(parts):
            natural = np.zeros(part.shape)
            natural[:, :, ZIGZAG] = part * steps[quant[k]]
            px = COSINES.T @ natural.reshape(*part.shape[:2], 8, 8) @ COSINES
            px = px.transpose(0, 2, 1, 3).reshape(part.shape[0] * 8, part.shape[1] * 8)
            px = px.repeat(most_y // down[k], 0).repeat(most_x // across[k], 1)[:rows, :columns]
            planes.append(np.clip(np.rint(px) + (1 << (bits - 1)), 0, (1 << bits) - 1).astype(np.int64))
    except (IndexError, KeyError, struct.error) as e:
        raise JpegError("segment is damaged") from e
    except ValueError as e:
        raise e if isinstance(e, JpegError) else JpegError("segment is damaged") from e
    return np.stack(planes, 2), bits, 1 if transform is None and jfif and len(planes) == 3 else transform


def _code_lengths(counts: Counter, most: int = 16) -> dict[int, int]:
    """Least total Huffman code lengths of at most so many bits (package-merge); no code is of ones only."""
    items = sorted([(c, (s,)) for s, c in counts.items()] + [(0, (-1,))])
    packages: list[tuple[int, tuple[int, ...]]] = []
    for _ in range(most):
        merged = sorted(items + packages)
        packages = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(merged[::2], merged[1::2], strict=False)]
    lengths = Counter(s for _, symbols in packages[: len(items) - 1] for s in symbols)
    del lengths[-1]  # as rare as any, so among the longest: the unused last code is its own
    return dict(lengths)


def _tables(counts: dict[int, Counter]) -> tuple[dict[tuple[int, int], str], bytes]:
    """The code of each symbol of each table, and the segment that says so."""
    codes: dict[tuple[int, int], str] = {}
    huffman = b""
    for t, c in sorted(counts.items()):
        lengths = _code_lengths(c)
        order, code, at = sorted(lengths, key=lambda s: (lengths[s], s)), 0, 0
        for s in order:
            code <<= lengths[s] - at
            at = lengths[s]
            codes[t, s] = format(code, f"0{at}b")
            code += 1
        per = Counter(lengths.values())
        huffman += bytes([t]) + bytes(per[i] for i in range(1, 17)) + bytes(order)
    return codes, huffman


def _stuffed(text: str) -> bytes:
    text += "1" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def encode_lossless(px: np.ndarray, bits: int) -> bytes:
    """A lossless picture (first-order prediction from the left) of (rows, columns, components) samples, with a Huffman table of its own."""
    rows, columns, n = px.shape
    if not 2 <= bits <= 16 or not 0 < rows < 65536 or not 0 < columns < 65536 or not 0 < n < 5:
        raise JpegError("a lossless picture has 2 to 16 bits, at most four components and sides under 65536")
    guess = np.empty_like(px, dtype=np.int64)
    guess[:, 1:], guess[1:, 0], guess[0, 0] = px[:, :-1], px[:-1, 0], 1 << (bits - 1)
    d = (px.astype(np.int64) - guess) % 65536
    flat = np.where(d > 32768, d - 65536, d).ravel()
    sizes = [abs(x).bit_length() for x in flat.tolist()]
    codes, huffman = _tables({0: Counter(sizes)})
    text = "".join(codes[0, size] + (format(x if x > 0 else x + (1 << size) - 1, f"0{size}b") if 0 < size < 16 else "") for x, size in zip(flat.tolist(), sizes, strict=True))
    frame = struct.pack(">BHHB", bits, rows, columns, n) + b"".join(bytes((k + 1, 0x11, 0)) for k in range(n))
    scan = bytes([n]) + b"".join(bytes((k + 1, 0)) for k in range(n)) + b"\x01\0\0"
    return b"\xff\xd8" + _segment(0xC3, frame) + _segment(0xC4, huffman) + _segment(0xDA, scan) + _stuffed(text) + b"\xff\xd9"


def encode_baseline(picture: np.ndarray, quality: int = 90) -> bytes:
    """A baseline picture of (rows, columns, 1 or 3) uint8 samples as they are, without subsampling, with Huffman tables of its own.

    Quantisation steps grow evenly with the frequency: 1 everywhere at quality 100, up to 99 more for the highest at quality 1.
    """
    rows, columns, n = picture.shape
    if n not in (1, 3) or not 0 < rows < 65536 or not 0 < columns < 65536:
        raise JpegError("a baseline picture has one or three components and sides under 65536")
    if not 1 <= quality <= 100:
        raise JpegError("quality is 1 to 100")
    step = np.array([[1 + round((100 - quality) * (u + v + 1) / 15) for v in range(8)] for u in range(8)])
    padded = np.pad(picture.astype(float) - 128, ((0, -rows % 8), (0, -columns % 8), (0, 0)), mode="edge")
    high, wide = padded.shape[0] // 8, padded.shape[1] // 8
    blocks = COSINES @ padded.reshape(high, 8, wide, 8, n).transpose(0, 2, 4, 1, 3) @ COSINES.T
    coded = np.rint(blocks / step).astype(np.int64).reshape(high * wide, n, 64)[:, :, ZIGZAG]
    coded[:, :, 1:] = np.clip(coded[:, :, 1:], -1023, 1023)
    coded[:, :, 0] = np.clip(coded[:, :, 0], -1023, 1023)
    out: list[tuple[int, int, int, int]] = []  # table, symbol, value bits, their number
    before = [0] * n
    for unit in coded.tolist():
        for k, block in enumerate(unit):
            table, run = min(k, 1), 0
            last = max((i for i in range(1, 64) if block[i]), default=0)
            for i in range(last + 1):
                v = block[i] - before[k] if i == 0 else block[i]
                if i and not v:
                    run += 1
                    continue
                while run > 15:
                    out.append((16 | table, 0xF0, 0, 0))
                    run -= 16
                size = abs(v).bit_length()
                out.append((16 | table if i else table, run << 4 | size, v if v >= 0 else v + (1 << size) - 1, size))
                run = 0
            before[k] = block[0]
            if last < 63:
                out.append((16 | table, 0, 0, 0))
    counts: dict[int, Counter] = {}
    for t, symbol, _, _ in out:
        counts.setdefault(t, Counter())[symbol] += 1
    codes, huffman = _tables(counts)
    text = "".join(codes[t, s] + (format(v, f"0{size}b") if size else "") for t, s, v, size in out)
    body = _stuffed(text)
    frame = struct.pack(">BHHB", 8, rows, columns, n) + b"".join(bytes((k + 1, 0x11, 0)) for k in range(n))
    scan = bytes([n]) + b"".join(bytes((k + 1, 0x11 * min(k, 1))) for k in range(n)) + b"\0\x3f\0"
    quant = bytes([0]) + bytes(step.ravel()[ZIGZAG].tolist())
    return b"\xff\xd8" + _segment(0xDB, quant) + _segment(0xC0, frame) + _segment(0xC4, huffman) + _segment(0xDA, scan) + body + b"\xff\xd9"
