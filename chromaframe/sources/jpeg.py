"""Sequential JPEG files: pixels, orientation, and a depth picture stored behind the first one.

Read are 8-bit baseline and extended sequential files with Huffman codes, one or three colours, any sampling and restarts; coarser planes are
repeated, not interpolated. A file that is damaged, ends early or is of another kind (progressive, arithmetic, four colours) raises ``ValueError``.
What a file may claim is checked against its length before memory is taken: a block of 64 samples has at least two bits.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Row-major places of the 64 coefficients, by diagonals that change direction.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))
_U, _X = np.mgrid[:8, :8]
#: One-dimensional cosine transform: coefficients = COSINE @ samples.
COSINE = np.cos((2 * _X + 1) * _U * np.pi / 16) * np.where(_U == 0, np.sqrt(1 / 8), 0.5)

XMP = b"http://ns.adobe.com/xap/1.0/\0"  # fixed value of the format
_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_PAD = 512  # bytes after the data of a scan; a block takes at most 250


@dataclass
class Plane:
    name: int
    across: int
    down: int
    table: int
    coefficients: np.ndarray | None = None  # (rows of blocks, blocks, 64), whole units


@dataclass
class Frame:
    width: int = 0
    height: int = 0
    planes: list[Plane] = field(default_factory=list)
    transform: int = 1

    def units(self) -> tuple[int, int, int, int]:
        """Largest sampling across and down, units across and down."""
        across, down = max(p.across for p in self.planes), max(p.down for p in self.planes)
        return across, down, -(-self.width // (8 * across)), -(-self.height // (8 * down))


def segments(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(marker, place of the body, body) up to the end of the picture; the body of a scan's header is followed by its data in the file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at = 2
    while True:
        while at + 1 < len(data) and data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        if at + 4 > len(data) and data[at : at + 2] != b"\xff\xd9" or data[at] != 0xFF:
            raise ValueError("a JPEG file ends early or has no marker where one is due")
        marker = data[at + 1]
        if marker == 0xD9:
            return
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise ValueError("a JPEG segment ends early")
        yield marker, at + 4, body
        at += 2 + size
        if marker == 0xDA:
            at = _scan_end(data, at)


def _scan_end(data: bytes, start: int) -> int:
    end = _SCAN_END.search(data, start)
    if end is None:
        raise ValueError("a JPEG scan ends early")
    return end.start()


def _codes(body: bytes) -> Iterator[tuple[int, list[int]]]:
    """(class and number, table of all 16-bit prefixes: length * 256 + symbol, 0 where no code fits)."""
    at = 0
    while at < len(body):
        which, counts = body[at], body[at + 1 : at + 17]
        symbols = body[at + 17 : at + 17 + sum(counts)]
        if len(counts) != 16 or len(symbols) != sum(counts):
            raise ValueError("a Huffman table ends early")
        table, i = [], 0
        for length, n in enumerate(counts, 1):
            for s in symbols[i : i + n]:
                table += [length * 256 + s] * (1 << (16 - length))
            i += n
        if len(table) > 65536:
            raise ValueError("a Huffman table has too many codes")
        yield which, table + [0] * (65536 - len(table))
        at += 17 + len(symbols)


def _scan(data: bytes, planes: list[tuple[Plane, list[int], list[int]]], units: tuple[int, int], interval: int) -> None:
    """Coefficients of the ``planes`` (with their two tables) of one scan."""
    single = len(planes) == 1
    layout = [(p, dc, ac, [(0, 0)] if single else [(v, h) for v in range(p.down) for h in range(p.across)]) for p, dc, ac in planes]
    total = units[0] * units[1]
    parts = _RESTART.split(data) if interval else [data]
    step = interval or total
    if len(parts) < -(-total // step):
        raise ValueError("a JPEG scan has too few restarts")
    found: list[tuple[list[int], list[int]]] = [([], []) for _ in planes]
    for k in range(-(-total // step)):
        part = parts[k].replace(b"\xff\x00", b"\xff")
        end = 8 * len(part)
        raw = np.frombuffer(part + b"\0" * _PAD, np.uint8).astype(np.int64)
        window = (raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]).tolist()
        at, before = 0, [0] * len(planes)
        for unit in range(k * step, min(total, (k + 1) * step)):
            row, column = divmod(unit, units[0])
            for c, (p, dc, ac, places) in enumerate(layout):
                where, values = found[c]
                wide = p.coefficients.shape[1]
                for v, h in places:
                    base = (_unit_row(row, p, v, single) * wide + (column if single else column * p.across + h)) * 64
                    i, table = 0, dc
                    while i < 64:
                        code = table[window[at >> 3] >> (16 - (at & 7)) & 0xFFFF]
                        if not code:
                            raise ValueError("a code that no table has")
                        at += code >> 8
                        size = code & 15
                        run = code >> 4 & 15
                        if table is ac and not size and run != 15:
                            break  # the rest of the block is 0
                        value = 0
                        if size:
                            value = window[at >> 3] >> (32 - size - (at & 7)) & (1 << size) - 1
                            at += size
                            if value < 1 << (size - 1):
                                value -= (1 << size) - 1
                        if table is dc:
                            before[c] = value = before[c] + value
                            table = ac
                        else:
                            i += run
                        if i > 63:
                            raise ValueError("a block of more than 64 coefficients")
                        if value:
                            where.append(base + i)
                            values.append(value)
                        i += 1
                    if at > end:
                        raise ValueError("a JPEG scan ends early")
    for (p, _, _), (where, values) in zip(planes, found, strict=True):
        p.coefficients.reshape(-1)[where] = values


def _unit_row(row: int, plane: Plane, v: int, single: bool) -> int:
    return row if single else row * plane.down + v


def pixels(data: bytes) -> np.ndarray:
    """(height, width, 3) bytes of the first picture; gray ones have equal colours."""
    frame, steps, codes, interval = None, {}, {}, 0
    for marker, at, body in segments(data):
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide, which = divmod(body[i], 16)
                values = np.frombuffer(body[i + 1 : i + 1 + 64 * (wide + 1)], ">u2" if wide else "u1")
                if wide > 1 or len(values) != 64:
                    raise ValueError("a quantisation table ends early")
                steps[which] = values.astype(np.int64)
                i += 1 + 64 * (wide + 1)
        elif marker == 0xC4:
            codes |= dict(_codes(body))
        elif marker in (0xC0, 0xC1):
            if len(body) < 6 or len(body) < 6 + 3 * body[5] or frame is not None:
                raise ValueError("a wrong frame")
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            frame = Frame(width, height, [Plane(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)], frame_transform(data))
            if depth != 8 or n not in (1, 3) or not width or not height or not all(1 <= s <= 4 for p in frame.planes for s in (p.across, p.down)):
                raise ValueError("only 8-bit pictures of one or three colours with a size")
            if n == 1:
                frame.planes[0].across = frame.planes[0].down = 1
        elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only sequential JPEG files with Huffman codes")
        elif marker == 0xDD and len(body) == 2:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            _read_scan(data, at, body, frame, codes, interval)
    if frame is None or any(p.coefficients is None for p in frame.planes):
        raise ValueError("a JPEG file without all of its scans")
    return _colours(frame, steps)


def _read_scan(data: bytes, at: int, body: bytes, frame: Frame | None, codes: dict[int, list[int]], interval: int) -> None:
    if frame is None or not body or len(body) < 1 + 2 * body[0]:
        raise ValueError("a scan without its frame")
    named = {p.name: p for p in frame.planes}
    try:
        planes = [(named[body[i]], codes[body[i + 1] >> 4], codes[16 + (body[i + 1] & 15)]) for i in range(1, 1 + 2 * body[0], 2)]
    except KeyError as e:
        raise ValueError("a scan of unknown planes or tables") from e
    across, down, wide, high = frame.units()
    start = at + len(body)
    scan = data[start : _scan_end(data, start)]
    if len(planes) == 1:
        p = planes[0][0]
        units = -(-(-(-frame.width * p.across // across)) // 8), -(-(-(-frame.height * p.down // down)) // 8)
    else:
        units = wide, high
    blocks = units[0] * units[1] * (1 if len(planes) == 1 else sum(p.across * p.down for p, _, _ in planes))
    if not planes or 4 * len(scan) < blocks:
        raise ValueError("a JPEG scan ends early")
    for p, _, _ in planes:
        p.coefficients = np.zeros((high * p.down, wide * p.across, 64), np.int32)
    _scan(scan, planes, units, interval)


def frame_transform(data: bytes) -> int:
    """0 where a marker says that three colours are red, green and blue themselves."""
    return next((b[11] for m, _, b in _headers(data) if m == 0xEE and b[:5] == b"Adobe" and len(b) > 11), 1)


def _headers(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Segments before the first scan."""
    for segment in segments(data):
        if segment[0] == 0xDA:
            return
        yield segment


def _colours(frame: Frame, steps: dict[int, np.ndarray]) -> np.ndarray:
    across, down, _, _ = frame.units()
    out = []
    for p in frame.planes:
        if p.table not in steps:
            raise ValueError("a plane without a quantisation table")
        rows, columns, _ = p.coefficients.shape
        blocks = np.zeros((rows, columns, 64))
        blocks[..., ZIGZAG] = p.coefficients * steps[p.table]
        samples = COSINE.T @ blocks.reshape(rows, columns, 8, 8) @ COSINE + 128
        samples = np.clip(np.rint(samples), 0, 255).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        y, x = np.arange(frame.height) * p.down // down, np.arange(frame.width) * p.across // across
        out.append(samples[y][:, x])
    if len(out) == 1:
        return np.repeat(out[0].astype(np.uint8)[..., None], 3, axis=2)
    if frame.transform:
        y, cb, cr = out[0], out[1] - 128, out[2] - 128
        out = [y + 1.402 * cr, y - (0.114 * 1.772 * cb + 0.299 * 1.402 * cr) / 0.587, y + 1.772 * cb]
    return np.clip(np.rint(np.stack(out, axis=2)), 0, 255).astype(np.uint8)


# what lies beside the pixels


def _directory(body: bytes, at: int) -> dict[int, tuple[int, bytes]]:
    """Entries of the TIFF directory that ``body[at:]`` starts with: tag to (number, value or what its offset names), numbers big-endian or not."""
    tiff = body[at:]
    order = {b"MM": ">", b"II": "<"}.get(tiff[:2])
    if order is None or len(tiff) < 10:
        return {}
    first = struct.unpack(order + "I", tiff[4:8])[0]
    out: dict[int, tuple[int, bytes]] = {}
    count = struct.unpack(order + "H", tiff[first : first + 2])[0] if first + 2 <= len(tiff) else 0
    for i in range(first + 2, min(first + 2 + 12 * count, len(tiff) - 11), 12):
        tag, kind, n = struct.unpack(order + "HHI", tiff[i : i + 8])
        size = n * {3: 2, 4: 4}.get(kind, 1)
        value = tiff[i + 8 : i + 8 + size] if size <= 4 else tiff[(o := struct.unpack(order + "I", tiff[i + 8 : i + 12])[0]) : o + size]
        number = struct.unpack(order + ("H" if kind == 3 else "I"), tiff[i + 8 : i + (10 if kind == 3 else 12)])[0]
        out[tag] = (number, value if order == ">" else b"".join(value[j : j + 4][::-1] for j in range(0, len(value), 4)))
    return out


def orientation(data: bytes) -> int:
    """1 to 8 as stored, 1 where nothing is."""
    for marker, _, body in _headers(data):
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            way = _directory(body, 6).get(0x0112, (1, b""))[0]
            return way if 1 <= way <= 8 else 1
    return 1


#: Quarter turns to the left by stored orientation, and whether the picture is mirrored first.
TURNS = {1: (0, False), 2: (0, True), 3: (2, False), 4: (2, True), 5: (1, True), 6: (3, False), 7: (3, True), 8: (1, False)}


def upright(image: np.ndarray, way: int, mirror: bool) -> np.ndarray:
    """``image`` turned by its stored orientation, mirrored too if ``mirror``."""
    turns, mirrored = TURNS[way]
    return np.rot90(image[:, ::-1] if mirrored and mirror else image, turns)


@dataclass
class Depth:
    kind: str  # disparity or depth
    values: np.ndarray


def depths(data: bytes) -> list[Depth]:
    """Depth pictures behind the first one, disparity first, as numbers in the range that their description names (else 0 to 1), upright."""
    out = []
    way = orientation(data)
    for marker, at, body in _headers(data):
        if marker == 0xE2 and body[:4] == b"MPF\0":
            entries = _directory(body, 4).get(0xB002, (0, b""))[1]
            for i in range(16, len(entries) - 15, 16):
                _, size, offset = struct.unpack(">III", entries[i : i + 12])
                out += _depth(data[at + 4 + offset : at + 4 + offset + size], way)
    return sorted(out, key=lambda d: d.kind == "depth")


_KIND = re.compile(rb"AuxiliaryImageType\s*(?:=\s*[\"']|>)[^\"'<]*?(disparity|depth)")
_BOUND = {n: re.compile(rb"Float%sValue\s*(?:=\s*[\"']|>)\s*([-+0-9.eE]+)" % n) for n in (b"Min", b"Max")}


def _depth(part: bytes, way: int) -> list[Depth]:
    try:
        notes = b"".join(body for marker, _, body in _headers(part) if marker == 0xE1 and body.startswith(XMP))
        kind = _KIND.search(notes)
        if kind is None:
            return []
        lo, hi = (float(m[1]) if (m := _BOUND[n].search(notes)) else d for n, d in ((b"Min", 0.0), (b"Max", 1.0)))
        return [Depth(kind[1].decode(), upright(lo + pixels(part)[..., 0] / 255.0 * (hi - lo), way, True))]
    except (ValueError, struct.error):
        return []  # a picture that can't be read carries no depth


# writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_AC = [0x00, 0xF0] + [run << 4 | size for run in range(16) for size in range(1, 11)]


def encoded(image: np.ndarray, step: int = 1, extra: bytes = b"", interval: int = 0) -> bytes:
    """A baseline file of a (height, width) gray or (height, width, 3) colour picture; all coefficients are multiples of ``step``.

    Codes are of one length: 4 bits for the 12 sizes of means, 8 for the 162 symbols of the rest. ``extra`` holds segments to put in front.
    """
    image = np.asarray(image, np.float64)
    if image.ndim == 3:
        r, g, b = np.moveaxis(image, 2, 0)
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]
    else:
        planes = [image]
    h, w = image.shape[:2]
    blocks = []
    for p in planes:
        p = np.pad(p, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
        p = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3)
        blocks.append(np.rint(COSINE @ p @ COSINE.T / step).astype(np.int64).reshape(-1, 64)[:, ZIGZAG].tolist())
    ac = {s: i for i, s in enumerate(_AC)}
    parts, bits, before = [], [], [0] * len(planes)

    def put(value: int) -> str:
        size = abs(value).bit_length()
        return f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else ""

    for unit in range(len(blocks[0])):
        if interval and unit and unit % interval == 0:
            parts, bits, before = [*parts, "".join(bits)], [], [0] * len(planes)
        for c, of in enumerate(blocks):
            block = of[unit]
            difference, before[c] = block[0] - before[c], block[0]
            bits.append(f"{abs(difference).bit_length():04b}{put(difference)}")
            last = 0
            for i in (i for i in range(1, 64) if block[i]):
                run = i - last - 1
                bits.append(f"{ac[0xF0]:08b}" * (run // 16) + f"{ac[(run % 16) << 4 | abs(block[i]).bit_length()]:08b}{put(block[i])}")
                last = i
            if last < 63:
                bits.append(f"{ac[0]:08b}")
    scan = b""
    for k, part in enumerate([*parts, "".join(bits)]):
        part += "1" * (-len(part) % 8)
        scan += (struct.pack(">BB", 0xFF, 0xD0 + (k - 1) % 8) if k else b"") + int(part, 2).to_bytes(len(part) // 8).replace(b"\xff", b"\xff\0")
    n = len(planes)
    frame = struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([c + 1, 0x11, 0]) for c in range(n))
    huffman = bytes([0, 0, 0, 0, 12, *[0] * 12, *range(12)]) + bytes([16, *[0] * 7, len(_AC), *[0] * 8, *_AC])
    restarts = _segment(0xDD, struct.pack(">H", interval)) if interval else b""
    head = _segment(0xDB, bytes([0] + [step] * 64)) + _segment(0xC0, frame) + _segment(0xC4, huffman) + restarts
    return b"\xff\xd8" + extra + head + _segment(0xDA, bytes([n, *[v for c in range(n) for v in (c + 1, 0)], 0, 63, 0])) + scan + b"\xff\xd9"


def with_depth(image: np.ndarray, values: np.ndarray, kind: str = "disparity", low: float = 0.0, high: float = 1.0, way: int = 1, step: int = 1) -> bytes:
    """A file of ``image`` with a depth picture (bytes of ``low`` to ``high``) behind it and a stored orientation."""
    note = f'<d xmlns:a="a" a:AuxiliaryImageType="{kind}" a:FloatMinValue="{low!r}" a:FloatMaxValue="{high!r}"/>'.encode()
    behind = encoded(values, step, _segment(0xE1, XMP + note))
    exif = _segment(0xE1, b"Exif\0\0MM\0*" + struct.pack(">IHHHIHHI", 8, 1, 0x0112, 3, 1, way, 0, 0))

    def index(size: int, offset: int) -> bytes:
        tags = struct.pack(">IHHHI4sHHIIHHIII", 8, 3, 0xB000, 7, 4, b"0100", 0xB001, 4, 1, 2, 0xB002, 7, 32, 50, 0)
        return _segment(0xE2, b"MPF\0MM\0*" + tags + struct.pack(">IIIHHIIIHH", 0x20030000, size, 0, 0, 0, 0, len(behind), offset, 0, 0))

    size = len(encoded(image, step, exif + index(0, 0)))
    start = 2 + len(exif) + 4 + 4  # what offsets count from
    return encoded(image, step, exif + index(size, size - start)) + behind
