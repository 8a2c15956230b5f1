"""The parts of TIFF that rasters of one grid need: tags, blocks, and LZW or Deflate compression of blocks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: Tag numbers of the format and of its georeference.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT, PIXEL_SCALE, TIE_POINT, MATRIX, GEO_KEYS, NODATA = 317, 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
GEOGRAPHIC, PROJECTED = 2048, 3072  # keys of the reference system's code
#: Letters and sizes of the field types.
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
NAMES = {"none": NONE, "lzw": LZW, "deflate": DEFLATE}
CLEAR, END, LAST_CODE = 256, 257, 4094

Transform = tuple[float, float, float, float, float, float]


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; the table starts anew when it is full."""
    out, held, bits, width = bytearray(), 0, 0, 9
    table: dict[int, int] = {}
    free, word = 258, -1

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(CLEAR)
    for byte in data:
        if word < 0:
            word = byte
            continue
        key = word << 8 | byte
        known = table.get(key)
        if known is not None:
            word = known
            continue
        put(word)
        table[key], free, word = free, free + 1, byte
        if free == LAST_CODE:
            put(CLEAR)
            table.clear()
            free, width = 258, 9
        elif free >= 1 << width:
            width += 1
    if word >= 0:
        put(word)
        free += 1  # readers count the entry of this code too
        if free >= 1 << width and width < 12:
            width += 1
    put(END)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, at, held, bits, last, out = list(first), 9, 0, 0, 0, b"", []
    while True:
        while bits < width:
            if at == len(data):
                return b"".join(out)
            held, bits, at = (held << 8 | data[at]) & 0xFFFFFF, bits + 8, at + 1
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == END:
            return b"".join(out)
        if code == CLEAR:
            table, width, last = list(first), 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise ValueError("not an LZW stream of a TIFF file")
        out.append(word)
        if last:
            table.append(last + word[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        last = word


def compress(data: bytes, how: int) -> bytes:
    return {NONE: bytes, LZW: lzw_encode, DEFLATE: zlib.compress}[how](data)


def decompress(data: bytes, how: int) -> bytes:
    if how not in (NONE, LZW, DEFLATE, OLD_DEFLATE):
        raise ValueError(f"compression {how} is not read")
    return data if how == NONE else lzw_decode(data) if how == LZW else zlib.decompress(data)


@dataclass
class Raster:
    """What a file's tags say."""

    width: int
    height: int
    bands: int
    dtype: np.dtype
    compression: int
    block: tuple[int, int]  # rows, columns
    offsets: list[int]
    counts: list[int]
    transform: Transform | None = None
    nodata: float | None = None
    epsg: int | None = None
    predictor: int = 1
    extra: dict = field(default_factory=dict)

    @property
    def across(self) -> int:
        return -(-self.width // self.block[1])

    def place(self, k: int) -> tuple[int, int, int, int]:
        """First row and column, rows and columns of block k inside the raster."""
        r, c = k // self.across * self.block[0], k % self.across * self.block[1]
        return r, c, min(self.block[0], self.height - r), min(self.block[1], self.width - c)

    def values(self, k: int, data: bytes) -> np.ndarray:
        """(rows, columns, bands) of block k from its stored bytes; an absent block is nodata."""
        _, _, rows, cols = self.place(k)
        if not data:
            return np.full((rows, cols, self.bands), np.nan if self.nodata is None else self.nodata)
        raw = np.frombuffer(decompress(data, self.compression), self.dtype)
        x = raw[: len(raw) // (self.block[1] * self.bands) * self.block[1] * self.bands].reshape(-1, self.block[1], self.bands)
        if self.predictor == 2:
            x = np.cumsum(x, axis=1, dtype=self.dtype)
        return x[:rows, :cols]


def read_header(read: Callable[[int, int], bytes]) -> Raster:
    """read(offset, length) gives bytes of the file; only the tags are read."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    big = order and struct.unpack(order + "H", head[2:4])[0] == 43
    if not order or struct.unpack(order + "H", head[2:4])[0] not in (42, 43):
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    n = struct.unpack(order + ("Q" if big else "H"), read(at, 8 if big else 2))[0]
    entry, word = (20, 8) if big else (12, 4)
    body = read(at + (8 if big else 2), n * entry)
    tags = {}
    for k in range(n):
        own = body[k * entry : (k + 1) * entry]
        tag, kind = struct.unpack(order + "HH", own[:4])
        count = struct.unpack(order + ("Q" if big else "I"), own[4 : 4 + word])[0]
        if kind not in TYPES:
            continue
        letter, size = TYPES[kind]
        data = own[4 + word : 4 + word + count * size] if count * size <= word else read(struct.unpack(order + ("Q" if big else "I"), own[-word:])[0], count * size)
        tags[tag] = data.rstrip(b"\0").decode("ascii", "replace") if kind == 2 else list(struct.unpack(order + letter * count, data))
    one = lambda tag, other=None: tags.get(tag, [other])[0]
    if one(PLANAR, 1) != 1 or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError("only bands side by side, without a floating point predictor, are read")
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one(SAMPLE_FORMAT, 1)] }{one(BITS, 8) // 8}")
    tiled = TILE_OFFSETS in tags
    block = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, one(HEIGHT)), one(HEIGHT)), one(WIDTH))
    nodata = tags.get(NODATA, "").strip()
    return Raster(
        one(WIDTH), one(HEIGHT), one(SAMPLES, 1), dtype, one(COMPRESSION, 1), block, tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS],
        _transform(tags), float(nodata) if nodata else None, _epsg(tags.get(GEO_KEYS)), one(PREDICTOR, 1),
    )


def _transform(tags: dict) -> Transform | None:
    if MATRIX in tags:
        m = tags[MATRIX]
        return m[0], m[1], m[3], m[4], m[5], m[7]
    if PIXEL_SCALE in tags and TIE_POINT in tags:
        (sx, sy), (col, row, _, x, y) = tags[PIXEL_SCALE][:2], tags[TIE_POINT][:5]
        return sx, 0.0, x - col * sx, 0.0, -sy, y + row * sy
    return None


def _epsg(keys: list[int] | None) -> int | None:
    entries = [keys[k : k + 4] for k in range(4, len(keys), 4)] if keys else []
    return next((v for key, where, _, v in entries if key in (GEOGRAPHIC, PROJECTED) and where == 0), None)


def file_of(width: int, height: int, bands: int, dtype: str, how: int, side: int, blocks: dict[int, bytes], transform: Transform | None, nodata: float | None, epsg: int | None) -> bytes:
    """A file of square blocks from their compressed bytes; absent blocks take no room."""
    kind = np.dtype(dtype)
    n = -(-width // side) * -(-height // side)
    body, offsets = bytearray(), []
    for k in range(n):
        offsets.append(8 + len(body) if k in blocks else 0)
        body += blocks.get(k, b"")
        body += b"\0" * (len(body) % 2)
    tags: list[tuple[int, int, list | bytes]] = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [kind.itemsize * 8] * bands), (COMPRESSION, 3, [how]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [bands]), (PLANAR, 3, [1]),
        (TILE_WIDTH, 4, [side]), (TILE_HEIGHT, 4, [side]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, [len(blocks.get(k, b"")) for k in range(n)]), (SAMPLE_FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[kind.kind]] * bands),
    ]
    if transform:
        a, b, c, d, e, f = transform
        tags += [(MATRIX, 12, [a, b, 0, c, d, e, 0, f, 0, 0, 0, 0, 0, 0, 0, 1])] if b or d or e >= 0 else [(PIXEL_SCALE, 12, [a, -e, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, c, f, 0.0])]
    if epsg:
        model = 2 if 4000 <= epsg < 5000 else 1  # codes of geographic systems lie there
        tags.append((GEO_KEYS, 3, [1, 1, 0, 3, 1024, 0, 1, model, 1025, 0, 1, 1, GEOGRAPHIC if model == 2 else PROJECTED, 0, 1, epsg]))
    if nodata is not None:
        tags.append((NODATA, 2, f"{nodata:g}".encode() + b"\0"))
    at, entries, further = 8 + len(body) + 2 + 12 * len(tags) + 4, b"", b""
    for tag, code, values in sorted(tags, key=lambda t: t[0]):
        data = values if isinstance(values, bytes) else struct.pack("<" + TYPES[code][0] * len(values), *values)
        if len(data) > 4:
            own, further = struct.pack("<I", at + len(further)), further + data + b"\0" * (len(data) % 2)
        else:
            own = data.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, code, len(values)) + own
    if at + len(further) >= 1 << 32:
        raise ValueError("a sheet must stay below 4 GB: take a smaller sheet")
    return struct.pack("<2sHI", b"II", 42, 8 + len(body)) + bytes(body) + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + further
