"""Frame codecs in NumPy: native samples, RLE, JPEG (lossless, baseline, extended), JPEG-LS, JPEG 2000, PNG, TIFF, and their registry."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np

from lumenframe.dictionary import BIG, EXPLICIT, IMPLICIT, RLE
from lumenframe.pixels import jpeg, jpeg2000, jpegls


class CodecError(ValueError):
    pass


@dataclass
class Image:
    """What a frame's bytes mean."""

    rows: int
    columns: int
    samples: int = 1
    allocated: int = 8
    stored: int = 8
    signed: bool = False
    photometric: str = "MONOCHROME2"
    planar: int = 0
    slope: float = 1.0
    intercept: float = 0.0
    center: float | None = None
    width: float | None = None
    modality: str = ""
    palette: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    palette_first: int = 0
    palette_bits: int = 16
    extra: dict = field(default_factory=dict)

    @property
    def frame_bytes(self) -> int:
        return -(-self.rows * self.columns * self.samples * self.allocated // 8)


def samples_of(raw: bytes, im: Image, big: bool = False) -> np.ndarray:
    """Stored values (rows, columns, samples) of a native frame; 12-bit packed frames included."""
    n = im.rows * im.columns * im.samples
    if len(raw) < im.frame_bytes:
        raise CodecError(f"frame of {len(raw)} bytes, {im.frame_bytes} needed")
    if im.allocated == 1:
        flat = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[:n].astype(np.int64)
    elif im.allocated == 8:
        flat = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    elif im.allocated == 12:
        b = np.frombuffer(raw, np.uint8, im.frame_bytes).astype(np.int64)
        b = np.append(b, np.zeros(-len(b) % 3, np.int64)).reshape(-1, 3)
        flat = np.stack([b[:, 0] | (b[:, 1] & 15) << 8, b[:, 1] >> 4 | b[:, 2] << 4], 1).ravel()[:n]
    elif im.allocated in (16, 32):
        flat = np.frombuffer(raw, np.dtype(f"{'>' if big else '<'}u{im.allocated // 8}"), n).astype(np.int64)
    else:
        raise CodecError(f"{im.allocated} bits allocated")
    flat &= (1 << im.stored) - 1
    if im.signed:
        flat = np.where(flat >= 1 << (im.stored - 1), flat - (1 << im.stored), flat)
    if im.samples > 1 and im.planar == 1:
        return flat.reshape(im.samples, im.rows, im.columns).transpose(1, 2, 0)
    return flat.reshape(im.rows, im.columns, im.samples)


def ycc_to_rgb(x: np.ndarray, middle: int = 128) -> np.ndarray:
    """Rounded RGB, not yet clipped, of full-range luma and colour differences around the middle."""
    y, cb, cr = x[:, :, 0].astype(float), x[:, :, 1] - float(middle), x[:, :, 2] - float(middle)
    return np.round(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2))


def rgb_to_ycc(x: np.ndarray, middle: int = 128) -> np.ndarray:
    """Rounded luma and colour differences around the middle, not yet clipped."""
    r, g, b = (x[:, :, c].astype(float) for c in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return np.round(np.stack([y, middle + (b - y) / 1.772, middle + (r - y) / 1.402], 2))


def rgba(raw: bytes, im: Image, big: bool = False) -> np.ndarray:
    """An opaque (rows, columns, 4) uint8 picture of a native frame."""
    v = samples_of(raw, im, big)
    kind = im.photometric
    out = np.full((im.rows, im.columns, 4), 255, np.uint8)
    if kind == "PALETTE COLOR":
        if im.palette is None:
            raise CodecError("palette image without lookup tables")
        at = np.clip(v[:, :, 0] - im.palette_first, 0, len(im.palette[0]) - 1)
        for c in range(3):
            out[:, :, c] = (im.palette[c][at] >> (8 if im.palette_bits > 8 else 0)).astype(np.uint8)
        return out
    if im.samples >= 3:
        x = v[:, :, :3].astype(float)
        if im.stored > 8:
            x = np.floor(x / (1 << (im.stored - 8)))
        if kind.startswith("YBR"):
            x = ycc_to_rgb(x)
        out[:, :, :3] = np.clip(x, 0, 255)
        return out
    x = v[:, :, 0].astype(float)
    center, width = im.center, im.width
    if im.allocated <= 8:
        if width is not None and center is not None and width > 0:
            low, high = center - width / 2, center + width / 2
            x = np.where(x <= low, 0, np.where(x >= high, 255, np.floor((x - low) / width * 255)))
    else:
        x = x * im.slope + im.intercept
        if center is None or width is None or width <= 0:
            center, width = (x.min() + x.max()) / 2, max(1.0, x.max() - x.min())
        if im.modality == "PT":  # the window is rescaled with the values, intercept included
            center, width = center * im.slope + im.intercept, width * im.slope + im.intercept
        low = center - width / 2
        x = np.floor((np.clip(x, low, center + width / 2) - low) / width * 255)
    x = np.clip(x, 0, 255)
    if kind == "MONOCHROME1":
        x = 255 - x
    out[:, :, :3] = x[:, :, None]
    return out


def expand_palette(data: bytes, entries: int, bits: int, segmented: bool = False) -> np.ndarray:
    """Lookup values; segmented tables are of discrete (0), linear (1) and indirect (2) segments."""
    words = np.frombuffer(data, "<u2") if bits > 8 or len(data) >= 2 * entries else np.frombuffer(data, np.uint8)
    words = words.astype(np.int64)
    if not segmented:
        return words[: entries or 65536]
    out: list[int] = []

    def run(at: int, count: int | None) -> int:
        done = 0
        while at + 1 < len(words) and (count is None or done < count):
            op, n = int(words[at]), int(words[at + 1])
            if op == 0:
                out.extend(words[at + 2 : at + 2 + n].tolist())
                at += 2 + n
            elif op == 1:
                start, end = out[-1], int(words[at + 2])
                out.extend(round(start + (end - start) * i / n) for i in range(1, n + 1))
                at += 3
            elif op == 2:
                run((int(words[at + 2]) | int(words[at + 3]) << 16) // 2, n)
                at += 4
            else:
                raise CodecError(f"palette segment {op}")
            done += 1
        return at

    run(0, None)
    return np.array(out[: entries or 65536], np.int64)


def rle_decode(data: bytes, im: Image) -> bytes:
    """A native little-endian frame of an RLE frame: byte planes, most significant first."""
    count = struct.unpack_from("<I", data)[0]
    offsets = struct.unpack_from("<15I", data, 4)[:count]
    depth = im.allocated // 8
    if count != depth * im.samples:
        raise CodecError(f"{count} RLE segments for {im.samples} samples of {depth} bytes")
    n = im.rows * im.columns
    planes = []
    for start, end in zip(offsets, [*offsets[1:], len(data)], strict=True):
        out, at = bytearray(), start
        while at < end and len(out) < n:
            k = data[at]
            if k < 128:
                out += data[at + 1 : at + 2 + k]
                at += 2 + k
            elif k > 128:
                out += data[at + 1 : at + 2] * (257 - k)
                at += 2
            else:
                at += 1
        if len(out) < n:
            raise CodecError("RLE segment is too short")
        planes.append(np.frombuffer(bytes(out[:n]), np.uint8))
    a = np.stack(planes).reshape(im.samples, depth, n)[:, ::-1]
    a = a.transpose(0, 2, 1) if im.planar == 1 else a.transpose(2, 0, 1)
    return a.tobytes()


_RUN = re.compile(rb"(.)\1{1,127}", re.DOTALL)


def _pack(plane: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for start in range(at, end, 128):
            part = plane[start : min(start + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in _RUN.finditer(plane):
        literal(run.start())
        at = run.end()
        out += bytes((257 - at + run.start(), plane[at - 1]))
    literal(len(plane))
    return bytes(out) + (b"\x00" if len(out) % 2 else b"")


def rle_encode(native: bytes, im: Image) -> bytes:
    depth, n = im.allocated // 8, im.rows * im.columns
    a = np.frombuffer(native, np.uint8, n * im.samples * depth)
    a = a.reshape(im.samples, n, depth) if im.planar == 1 else a.reshape(n, im.samples, depth).transpose(1, 0, 2)
    parts = [_pack(a[s, :, d].tobytes()) for s in range(im.samples) for d in range(depth - 1, -1, -1)]
    offsets, at = [], 64
    for p in parts:
        offsets.append(at)
        at += len(p)
    return struct.pack("<16I", len(parts), *offsets, *([0] * (15 - len(parts)))) + b"".join(parts)


_PNG = b"\x89PNG\r\n\x1a\n"


def png_encode(picture: np.ndarray) -> bytes:
    """PNG of a (rows, columns[, 3 or 4]) uint8 or uint16 array."""
    a = picture if picture.ndim == 3 else picture[:, :, None]
    rows, columns, samples = a.shape
    bits = a.dtype.itemsize * 8
    body = a.astype(">u2" if bits == 16 else np.uint8).tobytes()
    step = len(body) // max(1, rows)
    marked = np.zeros((rows, step + 1), np.uint8)
    marked[:, 1:] = np.frombuffer(body, np.uint8).reshape(rows, step)
    lines = marked.tobytes()
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    head = struct.pack(">IIBBBBB", columns, rows, bits, {1: 0, 2: 4, 3: 2, 4: 6}[samples], 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def png_decode(data: bytes) -> np.ndarray:
    """(rows, columns, samples) of a PNG that is not interlaced; palettes are applied, low depths scaled to 8 bits."""
    if data[:8] != _PNG:
        raise CodecError("no PNG")
    at, idat, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat += body
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None or head[6]:
        raise CodecError("PNG without a header or interlaced")
    columns, rows, bits, color = head[:4]
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    stride, step = -(-columns * samples * bits // 8), max(1, samples * bits // 8)
    raw = zlib.decompress(idat)
    out = np.zeros((rows, stride), np.uint8)
    above = np.zeros(stride, np.int64)
    plain = len(raw) >= rows * (stride + 1) and not any(raw[: rows * (stride + 1) : stride + 1])  # no line refers to others
    if plain:
        out = np.frombuffer(raw, np.uint8, rows * (stride + 1)).reshape(rows, stride + 1)[:, 1:].copy()
    for y in () if plain else range(rows):
        kind = raw[y * (stride + 1)]
        line = np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1).astype(np.int64)
        if kind == 2:
            line = (line + above) & 255
        elif kind == 1:
            for c in range(step):
                line[c::step] = np.cumsum(line[c::step]) & 255
        elif kind in (3, 4):
            for i in range(stride):
                left, up, corner = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min(((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)))[2]
                line[i] = (line[i] + guess) & 255
        out[y] = line
        above = line
    if bits == 16:
        px = out.view(">u2").astype(np.uint16).reshape(rows, columns, samples)
    elif bits == 8:
        px = out.reshape(rows, columns, samples)
    else:
        each = np.unpackbits(out, axis=1).reshape(rows, -1, bits)
        px = (each * (1 << np.arange(bits - 1, -1, -1))).sum(2).astype(np.uint8)[:, :columns, None]
        if color == 0:
            px = (px * (255 // ((1 << bits) - 1))).astype(np.uint8)
    return palette[px[:, :, 0]] if color == 3 and palette is not None else px


def tiff_encode(picture: np.ndarray) -> bytes:
    """A little-endian TIFF of one uncompressed strip."""
    a = picture if picture.ndim == 3 else picture[:, :, None]
    rows, columns, samples = a.shape
    bits, body = a.dtype.itemsize * 8, a.astype(a.dtype.newbyteorder("<")).tobytes()
    extra_at = 8 + len(body) + len(body) % 2
    entries = [(256, 4, 1, columns), (257, 4, 1, rows), (258, 3, samples, bits if samples == 1 else extra_at), (259, 3, 1, 1), (262, 3, 1, 1 if samples < 3 else 2), (273, 4, 1, 8), (277, 3, 1, samples), (278, 4, 1, rows), (279, 4, 1, len(body)), (284, 3, 1, 1)]
    if samples == 2:
        entries[2] = (258, 3, 2, bits | bits << 16)
    if samples in (2, 4):
        entries.append((338, 3, 1, 2))
    extra = struct.pack(f"<{samples}H", *[bits] * samples) if samples > 2 else b""
    extra += b"\x00" * (len(extra) % 2)
    ifd = extra_at + len(extra)
    table = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
    return b"II*\x00" + struct.pack("<I", ifd) + body + b"\x00" * (len(body) % 2) + extra + table


def tiff_decode(data: bytes) -> np.ndarray:
    """(rows, columns, samples) of a TIFF: strips, uncompressed, PackBits or deflate, 8 or 16 bits, chunky or planar."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise CodecError("no TIFF")
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags: dict[int, list[int]] = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        size, code = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}.get(kind, (0, ""))
        if size:
            where = at + 10 + 12 * i if size * n <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            tags[tag] = list(struct.unpack_from(f"{order}{n}{code}", data, where))
    columns, rows, bits = tags[256][0], tags[257][0], tags.get(258, [1])[0]
    samples, packing = tags.get(277, [1])[0], tags.get(259, [1])[0]
    if bits not in (8, 16):
        raise CodecError(f"TIFF of {bits} bits")
    body = b""
    for start, n in zip(tags[273], tags.get(279, [len(data)]), strict=False):
        strip = data[start : start + n]
        if packing == 1:
            body += strip
        elif packing in (8, 32946):
            body += zlib.decompress(strip)
        elif packing == 32773:
            out, i = bytearray(), 0
            while i < len(strip):
                k = strip[i]
                if k < 128:
                    out += strip[i + 1 : i + 2 + k]
                    i += 2 + k
                elif k > 128:
                    out += strip[i + 1 : i + 2] * (257 - k)
                    i += 2
                else:
                    i += 1
            body += bytes(out)
        else:
            raise CodecError(f"TIFF compression {packing}")
    flat = np.frombuffer(body, np.dtype(f"{order}u{bits // 8}"), rows * columns * samples).astype(f"u{bits // 8}")
    a = flat.reshape(samples, rows, columns).transpose(1, 2, 0) if tags.get(284, [1])[0] == 2 else flat.reshape(rows, columns, samples)
    return 255 - a if tags.get(262, [1])[0] == 0 and bits == 8 else a


def _whole_samples(decode: Callable[[bytes], tuple[np.ndarray, int]], data: bytes, im: Image) -> bytes:
    """A native little-endian frame of a picture of samples as they are stored."""
    try:
        px, bits = decode(data)
    except (jpeg.JpegError, jpegls.JpegLsError, jpeg2000.Jpeg2000Error) as e:
        raise CodecError(str(e)) from e
    if px.shape != (im.rows, im.columns, im.samples) or bits > im.allocated or im.allocated not in (8, 16):
        raise CodecError(f"picture of {px.shape} and {bits} bits is not what the object declares")
    px = px.transpose(2, 0, 1) if im.planar == 1 else px
    return px.astype(f"<u{im.allocated // 8}").tobytes()


def jpeg_lossless_decode(data: bytes, im: Image) -> bytes:
    return _whole_samples(jpeg.decode_lossless, data, im)


def jpeg_ls_decode(data: bytes, im: Image) -> bytes:
    return _whole_samples(jpegls.decode, data, im)


def jpeg_2000_decode(data: bytes, im: Image) -> bytes:
    """Colours come out as RGB, whatever the object says of their transform."""
    out = _whole_samples(jpeg2000.decode, data, im)
    im.photometric = "RGB" if im.photometric in ("YBR_RCT", "YBR_ICT") else im.photometric
    return out


def _stored(native: bytes, im: Image) -> tuple[np.ndarray, int]:
    """Samples as unsigned numbers of the bits that are coded: the stored ones, or all of the cell if some are set above."""
    if im.allocated not in (8, 16):
        raise CodecError(f"samples of {im.allocated} bits")
    px = samples_of(native, im) & ((1 << im.allocated) - 1)
    return px, im.stored if int(px.max(initial=0)) < 1 << im.stored else im.allocated


def jpeg_lossless_encode(native: bytes, im: Image) -> bytes:
    try:
        return jpeg.encode_lossless(*_stored(native, im))
    except jpeg.JpegError as e:
        raise CodecError(str(e)) from e


def jpeg_ls_encode(native: bytes, im: Image) -> bytes:
    try:
        return jpegls.encode(*_stored(native, im))
    except jpegls.JpegLsError as e:
        raise CodecError(str(e)) from e


def jpeg_2000_encode(native: bytes, im: Image) -> bytes:
    """Lossless; three components are coded with the reversible colour transform."""
    try:
        out = jpeg2000.encode(*_stored(native, im))
    except jpeg2000.Jpeg2000Error as e:
        raise CodecError(str(e)) from e
    im.photometric = "YBR_RCT" if im.photometric == "RGB" else im.photometric
    return out


def jpeg_dct_decode(data: bytes, im: Image) -> bytes:
    """A native little-endian frame of a baseline or extended JPEG frame, in the declared colours at full resolution."""
    try:
        px, bits, transform = jpeg.decode_dct(data)
    except jpeg.JpegError as e:
        raise CodecError(str(e)) from e
    if px.shape != (im.rows, im.columns, im.samples) or bits > im.allocated or im.allocated not in (8, 16):
        raise CodecError(f"picture of {px.shape} and {bits} bits is not what the object declares")
    if im.samples == 3 and transform is not None and bool(transform) != im.photometric.startswith("YBR"):
        px = np.clip((ycc_to_rgb if transform else rgb_to_ycc)(px, 1 << (bits - 1)), 0, (1 << bits) - 1)
    px = px.transpose(2, 0, 1) if im.planar == 1 else px
    return px.astype(f"<u{im.allocated // 8}").tobytes()


def eight_bit(native: bytes, im: Image) -> tuple[bytes, Image]:
    """What a baseline JPEG frame can hold: grey or YBR_FULL samples of 8 bits. Deeper samples and palettes are drawn, which uses up window and rescaling."""
    if im.allocated == 8 and im.stored == 8 and not im.signed and im.photometric != "PALETTE COLOR":
        px = samples_of(native, im)
        if im.samples == 1:
            return native, im
        px = px if im.photometric.startswith("YBR") else np.clip(rgb_to_ycc(px), 0, 255)
        return px.astype(np.uint8).tobytes(), replace(im, planar=0, photometric="YBR_FULL")
    drawn = rgba(native, im)
    drawn_as = replace(im, allocated=8, stored=8, signed=False, planar=0, slope=1.0, intercept=0.0, center=None, width=None, palette=None)
    if im.samples == 1 and im.photometric != "PALETTE COLOR":
        return drawn[:, :, 0].tobytes(), replace(drawn_as, photometric="MONOCHROME2")
    return np.clip(rgb_to_ycc(drawn), 0, 255).astype(np.uint8).tobytes(), replace(drawn_as, samples=3, photometric="YBR_FULL")


def jpeg_baseline_encode(native: bytes, im: Image) -> bytes:
    """A baseline JPEG frame of what `eight_bit` gives."""
    if im.allocated != 8 or im.samples not in (1, 3):
        raise CodecError("baseline JPEG holds one or three samples of 8 bits")
    try:
        return jpeg.encode_baseline(samples_of(native, im).astype(np.uint8))
    except jpeg.JpegError as e:
        raise CodecError(str(e)) from e


def jpeg_picture(data: bytes) -> np.ndarray:
    """(rows, columns, 1 or 3) grey or RGB samples of a JPEG file; three components without a marker are luma and differences."""
    try:
        px, bits, transform = jpeg.decode_dct(data)
    except jpeg.JpegError as e:
        raise CodecError(str(e)) from e
    if bits != 8 or px.shape[2] not in (1, 3):
        raise CodecError(f"JPEG file of {px.shape[2]} components of {bits} bits")
    px = ycc_to_rgb(px) if px.shape[2] == 3 and transform != 0 else px
    return np.clip(px, 0, 255).astype(np.uint8)


def jpeg_file(picture: np.ndarray, quality: int = 90) -> bytes:
    """A JPEG file of a grey, RGB or RGBA uint8 picture; alpha is left out."""
    a = picture if picture.ndim == 3 else picture[:, :, None]
    try:
        return jpeg.encode_baseline(np.clip(rgb_to_ycc(a), 0, 255).astype(np.uint8) if a.shape[2] > 2 else a[:, :, :1], quality)
    except jpeg.JpegError as e:
        raise CodecError(str(e)) from e


JPEG_BASELINE, JPEG_EXTENDED = "1.2.840.10008.1.2.4.50", "1.2.840.10008.1.2.4.51"
JPEG_LOSSLESS = ("1.2.840.10008.1.2.4.57", "1.2.840.10008.1.2.4.70")
JPEG_LS, JPEG_LS_NEAR = "1.2.840.10008.1.2.4.80", "1.2.840.10008.1.2.4.81"
JPEG_2000 = ("1.2.840.10008.1.2.4.90", "1.2.840.10008.1.2.4.91")
#: Decoders to native little-endian frames by transfer syntax; others pass through with a concern.
DECODERS: dict[str, Callable[[bytes, Image], bytes]] = {
    IMPLICIT: lambda b, im: b, EXPLICIT: lambda b, im: b, BIG: lambda b, im: swap(b, im.allocated // 8), RLE: rle_decode, **dict.fromkeys((JPEG_BASELINE, JPEG_EXTENDED), jpeg_dct_decode), **dict.fromkeys(JPEG_LOSSLESS, jpeg_lossless_decode),
    **dict.fromkeys((JPEG_LS, JPEG_LS_NEAR), jpeg_ls_decode), **dict.fromkeys(JPEG_2000, jpeg_2000_decode),
}
ENCODERS: dict[str, Callable[[bytes, Image], bytes]] = {IMPLICIT: lambda b, im: b, EXPLICIT: lambda b, im: b, BIG: lambda b, im: swap(b, im.allocated // 8), RLE: rle_encode, JPEG_BASELINE: jpeg_baseline_encode, JPEG_LOSSLESS[1]: jpeg_lossless_encode, JPEG_LS: jpeg_ls_encode, JPEG_2000[0]: jpeg_2000_encode}
#: Pictures of frames: RGBA samples (rows, columns, 4) to the bytes of a file.
PICTURES: dict[str, Callable[[np.ndarray], bytes]] = {"png": png_encode, "tiff": tiff_encode, "jpeg": jpeg_file, "rgba": np.ndarray.tobytes}


@dataclass(frozen=True)
class Registry:
    """Codecs by transfer syntax and pictures by kind; immutable, each with_* gives a new one. It is sent to the executors with the functions that use it.

    A decoder takes (bytes, Image) and gives a native little-endian frame, an encoder the reverse; both raise CodecError.
    """

    decoders: dict[str, Callable[[bytes, Image], bytes]] = field(default_factory=lambda: dict(DECODERS))
    encoders: dict[str, Callable[[bytes, Image], bytes]] = field(default_factory=lambda: dict(ENCODERS))
    pictures: dict[str, Callable[[np.ndarray], bytes]] = field(default_factory=lambda: dict(PICTURES))

    @classmethod
    def empty(cls) -> Registry:
        return cls({}, {}, {})

    def _with(self, name: str, key: str, codec: Callable | None, replace_: bool) -> Registry:
        held = dict(getattr(self, name))
        if not isinstance(key, str) or not key.strip():
            raise ValueError("a codec needs a transfer syntax or kind")
        if codec is None:
            held.pop(key, None)
        elif not callable(codec):
            raise TypeError(f"codec of {key} cannot be called")
        elif key in held and not replace_:
            raise ValueError(f"{key} has a codec already")
        else:
            held[key] = codec
        return replace(self, **{name: held})

    def with_decoder(self, syntax: str, codec: Callable[[bytes, Image], bytes], replace: bool = False) -> Registry:
        return self._with("decoders", syntax, codec, replace)

    def with_encoder(self, syntax: str, codec: Callable[[bytes, Image], bytes], replace: bool = False) -> Registry:
        return self._with("encoders", syntax, codec, replace)

    def with_picture(self, kind: str, codec: Callable[[np.ndarray], bytes], replace: bool = False) -> Registry:
        return self._with("pictures", kind, codec, replace)

    def without(self, key: str) -> Registry:
        out = self
        for name in ("decoders", "encoders", "pictures"):
            out = out._with(name, key, None, True)
        return out

    def decode(self, syntax: str, data: bytes, im: Image) -> bytes:
        if syntax not in self.decoders:
            raise CodecError(f"{NO_CODEC} for {syntax}")
        return self.decoders[syntax](data, im)

    def converts(self, source: str, target: str) -> bool:
        return source in self.decoders and target in self.encoders


NO_CODEC = "no codec"


def swap(raw: bytes, width: int) -> bytes:
    """Bytes reversed in words of the given width."""
    if width <= 1:
        return raw
    n = len(raw) // width * width
    return np.frombuffer(raw, np.uint8, n).reshape(-1, width)[:, ::-1].tobytes() + raw[n:]


def fragments(encapsulated: bytes) -> tuple[list[int], list[bytes]]:
    """(offset table, fragments) of an encapsulated value."""
    at, items = 0, []
    while at + 8 <= len(encapsulated):
        g, e, n = struct.unpack_from("<HHI", encapsulated, at)
        if (g, e) != (0xFFFE, 0xE000):
            break
        items.append(encapsulated[at + 8 : at + 8 + n])
        at += 8 + n
    if not items:
        raise CodecError("encapsulated value without items")
    return list(struct.unpack(f"<{len(items[0]) // 4}I", items[0])), items[1:]


def frames_of(encapsulated: bytes, count: int = 1) -> list[bytes]:
    """Frames by the offset table; without one, fragments are dealt evenly to the declared frames."""
    table, parts = fragments(encapsulated)
    if table:
        starts, at = [], 0
        for p in parts:
            starts.append(at)
            at += 8 + len(p)
        return [b"".join(p for p, s in zip(parts, starts, strict=True) if a <= s < b) for a, b in zip(table, [*table[1:], at], strict=True)]
    count = max(1, count)
    if len(parts) % count:
        raise CodecError(f"{len(parts)} fragments for {count} frames")
    each = len(parts) // count
    return [b"".join(parts[i * each : (i + 1) * each]) for i in range(count)]


def encapsulate(frames: list[bytes]) -> bytes:
    """Items with an offset table, one fragment a frame, and the sequence's end."""
    padded = [f + b"\x00" * (len(f) % 2) for f in frames]
    offsets, at = [], 0
    for f in padded:
        offsets.append(at)
        at += 8 + len(f)
    item = lambda b: struct.pack("<HHI", 0xFFFE, 0xE000, len(b)) + b
    return item(struct.pack(f"<{len(offsets)}I", *offsets)) + b"".join(map(item, padded)) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
