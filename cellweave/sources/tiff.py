"""Baseline TIFF and GeoTIFF in NumPy: strips or tiles, no compression, Deflate or LZW, both byte orders, several bands."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

#: Fixed values of the TIFF 6.0 and GeoTIFF 1.1 formats.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, GEO_KEYS, NO_DATA = 33550, 33922, 34735, 42113
MODEL_TYPE, GEOGRAPHIC_TYPE, PROJECTED_TYPE = 1024, 2048, 3072
SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}


@dataclass
class Raster:
    """bands x rows x cols, its extent and coordinate system; no-data cells are NaN once asked for as doubles."""

    cells: np.ndarray
    xmin: float = 0.0
    ymin: float = 0.0
    xmax: float = 0.0
    ymax: float = 0.0
    epsg: int = 4326
    no_data: float | None = None

    @property
    def rows(self) -> int:
        return self.cells.shape[1]

    @property
    def cols(self) -> int:
        return self.cells.shape[2]

    def doubles(self, band: int = 0) -> np.ndarray:
        """A band row by row, no-data as NaN."""
        out = self.cells[band].astype(np.float64).ravel()
        if self.no_data is not None and not np.isnan(self.no_data):
            out[out == self.no_data] = np.nan
        return out


def _unlzw(data: bytes) -> bytes:
    out, table, width, previous = bytearray(), [], 9, None
    value = bits = 0
    for byte in data:
        value, bits = (value << 8) | byte, bits + 8
        while bits >= width:
            code = (value >> (bits - width)) & ((1 << width) - 1)
            bits -= width
            value &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, previous = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
                continue
            if code < len(table):
                entry = table[code]
            elif previous is not None and code == len(table):
                entry = previous + previous[:1]
            else:
                raise ValueError("broken LZW data")
            out += entry
            if previous is not None:
                table.append(previous + entry[:1])
            previous = entry
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
    return bytes(out)


@dataclass
class Header:
    """What a file says of itself: its tags, byte order and size, extent (xmin, ymin, xmax, ymax) and coordinate system."""

    tags: dict[int, tuple]
    order: str
    cols: int
    rows: int
    bands: int
    box: tuple[float, float, float, float]
    epsg: int
    no_data: float | None
    dtype: np.dtype

    def one(self, tag: int, default: int) -> int:
        return self.tags.get(tag, (default,))[0]


def header(data: bytes) -> Header:
    """Read what a classic TIFF says of itself, not its cells; BigTIFF and unknown samples are refused."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a classic TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if kind not in SIZES:
            continue
        form = order + (f"{count}s" if kind == 2 else SIZES[kind] * count)
        size = struct.calcsize(form)
        place = 8 if size <= 4 else None
        raw = entry[8 : 8 + size] if place else data[(o := struct.unpack(order + "I", entry[8:12])[0]) : o + size]
        tags[tag] = struct.unpack(form, raw)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, bands = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits, kind = set(tags.get(BITS, (1,))), one(FORMAT, 1)
    if len(bits) != 1 or bits & {8, 16, 32, 64} == set() or kind not in KINDS:
        raise ValueError(f"samples of {bits} bits, format {kind}, are not supported")
    dtype = np.dtype(f"{order}{KINDS[kind]}{bits.pop() // 8}")
    box = (0.0, 0.0, float(width), float(height))
    if PIXEL_SCALE in tags and TIEPOINT in tags:
        sx, sy = tags[PIXEL_SCALE][:2]
        i, j, _, x, y = tags[TIEPOINT][:5]
        left, top = x - i * sx, y + j * sy
        box = (left, top - height * sy, left + width * sx, top)
    keys = tags.get(GEO_KEYS, ())
    found = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
    raw = tags.get(NO_DATA)
    no_data = float(raw[0].split(b"\0")[0]) if raw else None
    return Header(tags, order, width, height, bands, box, found.get(PROJECTED_TYPE) or found.get(GEOGRAPHIC_TYPE) or 4326, no_data, dtype)


def decode(data: bytes) -> Raster:
    """Read a classic TIFF; BigTIFF, JPEG and other compressions are refused."""
    h = header(data)
    width, height, bands, dtype, tags = h.cols, h.rows, h.bands, h.dtype, h.tags
    compression, predictor, planar = h.one(COMPRESSION, 1), h.one(PREDICTOR, 1), h.one(PLANAR, 1)
    unpack = {1: bytes, 5: _unlzw, 8: zlib.decompress, 32946: zlib.decompress}.get(compression)
    if unpack is None or predictor not in (1, 2):
        raise ValueError(f"compression {compression} with predictor {predictor} is not supported")
    tiled = TILE_OFFSETS in tags
    part_w, part_h = (h.one(TILE_WIDTH, 0), h.one(TILE_HEIGHT, 0)) if tiled else (width, min(h.one(ROWS_PER_STRIP, height), height))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    across, down = -(-width // part_w), -(-height // part_h)
    per_part = bands if planar == 1 else 1
    out = np.zeros((bands, height, width), dtype.newbyteorder("="))
    for k, (o, n) in enumerate(zip(offsets, counts, strict=True)):
        plane, place = divmod(k, across * down)
        y, x = place // across * part_h, place % across * part_w
        rows = part_h if tiled else min(part_h, height - y)
        block = np.frombuffer(unpack(data[o : o + n]), dtype, rows * part_w * per_part).reshape(rows, part_w, per_part)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
        high, wide = min(rows, height - y), min(part_w, width - x)
        for b in range(per_part):
            out[plane + b, y : y + high, x : x + wide] = block[:high, :wide, b]
    return Raster(out, *h.box, h.epsg, h.no_data)


def encode(r: Raster, deflate: bool = True, tile: int | None = None, order: str = "<", predictor: int = 1, rows_per_strip: int = 64) -> bytes:
    """Write a raster; geographic EPSG codes (4000 to 4999) and projected ones are told apart."""
    bands, height, width = r.cells.shape
    kind = {v: k for k, v in KINDS.items()}[r.cells.dtype.kind]
    dtype = r.cells.dtype.newbyteorder(order)
    pw, ph = (tile, tile) if tile else (width, rows_per_strip)
    parts = []
    for y in range(0, height, ph):
        for x in range(0, width, pw):
            block = np.moveaxis(r.cells[:, y : y + ph, x : x + pw], 0, 2)
            if tile:
                block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1]), (0, 0)))
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1).astype(r.cells.dtype)
            raw = block.astype(dtype).tobytes()
            parts.append(zlib.compress(raw, 6) if deflate else raw)
    geographic = 4000 <= r.epsg < 5000
    keys = (1, 1, 0, 2, MODEL_TYPE, 0, 1, 2 if geographic else 1, GEOGRAPHIC_TYPE if geographic else PROJECTED_TYPE, 0, 1, r.epsg)
    tags = {
        WIDTH: ("I", (width,)), HEIGHT: ("I", (height,)), BITS: ("H", (dtype.itemsize * 8,) * bands), COMPRESSION: ("H", (8 if deflate else 1,)), PHOTOMETRIC: ("H", (1,)),
        SAMPLES: ("H", (bands,)), PLANAR: ("H", (1,)), PREDICTOR: ("H", (predictor,)), FORMAT: ("H", (kind,) * bands), GEO_KEYS: ("H", keys),
        PIXEL_SCALE: ("d", ((r.xmax - r.xmin) / width, (r.ymax - r.ymin) / height, 0.0)), TIEPOINT: ("d", (0.0, 0.0, 0.0, r.xmin, r.ymax, 0.0)),
    }
    if r.no_data is not None:
        tags[NO_DATA] = ("s", f"{r.no_data}".encode() + b"\0")
    if tile:
        tags |= {TILE_WIDTH: ("I", (tile,)), TILE_HEIGHT: ("I", (tile,))}
    else:
        tags[ROWS_PER_STRIP] = ("I", (rows_per_strip,))
    tags[TILE_OFFSETS if tile else STRIP_OFFSETS] = ("I", (0,) * len(parts))
    tags[TILE_COUNTS if tile else STRIP_COUNTS] = ("I", tuple(map(len, parts)))
    codes = {v: k for k, v in SIZES.items() if len(v) == 1}
    head = 8 + 2 + 12 * len(tags) + 4

    def pack(form: str, values) -> bytes:
        return values if form == "s" else struct.pack(f"{order}{len(values)}{form}", *values)

    size = head + sum(n + n % 2 for n in (len(pack(*tags[t])) for t in tags) if n > 4)
    starts = np.cumsum([size, *map(len, parts)])[:-1].tolist()
    tags[TILE_OFFSETS if tile else STRIP_OFFSETS] = ("I", tuple(starts))
    entries, extra = b"", b""
    for tag in sorted(tags):
        form, values = tags[tag]
        raw = pack(form, values)
        if len(raw) <= 4:
            field = raw.ljust(4, b"\0")
        else:
            field = struct.pack(order + "I", head + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        entries += struct.pack(order + "HHI", tag, codes[form], len(values)) + field
    start = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(tags))
    return start + entries + b"\0" * 4 + extra + b"".join(parts)
