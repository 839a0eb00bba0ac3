import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellweave.sources.tiff import Raster, _unlzw, decode, encode


@settings(max_examples=120, deadline=None)
@given(
    st.integers(1, 40), st.integers(1, 40), st.integers(1, 3), st.sampled_from(["u1", "i2", "i4", "u2", "f4", "f8"]), st.booleans(), st.sampled_from([None, 16, 32]),
    st.sampled_from("<>"), st.sampled_from([1, 2]), st.integers(1, 50),
)
def test_round_trip(rows, cols, bands, dtype, deflate, tile, order, predictor, strip):
    cells = np.random.default_rng(rows * cols).integers(0, 100, (bands, rows, cols)).astype(dtype)
    if cells.dtype.kind == "f":
        predictor = 1
    r = decode(encode(Raster(cells, -10, 20, 30, 60, 32633, 7), deflate, tile, order, predictor, strip))
    assert (r.cells == cells).all() and r.cells.dtype == cells.dtype
    assert np.allclose((r.xmin, r.ymin, r.xmax, r.ymax), (-10, 20, 30, 60)) and (r.epsg, r.no_data) == (32633, 7)
    assert np.isnan(r.doubles(0)[cells[0].ravel() == 7]).all()


def test_lzw():
    # Clear, 7, 258 (7 7), 8, 8, 258, 6, 6, end: nine-bit codes, high bits first.
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert _unlzw(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_refuses_what_it_cannot_read():
    good = encode(Raster(np.zeros((1, 2, 2))))
    with pytest.raises(ValueError):
        decode(b"II" + struct.pack("<H", 43) + good[4:])
    with pytest.raises(ValueError):
        decode(b"nothing")
    bad = bytearray(good)
    at = bad.index(struct.pack("<HHI", 259, 3, 1)) + 8
    bad[at : at + 2] = struct.pack("<H", 7)
    with pytest.raises(ValueError):
        decode(bytes(bad))
