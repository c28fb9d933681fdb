"""JPEG files: pixels, stored orientation, depth inside, damaged files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaframe.operators import depth
from chromaframe.sources import jpeg, raster

RANDOM = np.random.default_rng(7)


def noise(*shape):
    return RANDOM.integers(0, 256, shape).astype(np.uint8)


def smooth(h, w):
    y, x = np.mgrid[:h, :w]
    return np.stack((x * 255 // max(1, w - 1), y * 255 // max(1, h - 1), (x + y) * 255 // max(1, w + h - 2)), 2).astype(np.uint8)


@pytest.mark.parametrize("interval", [0, 1, 3])
@pytest.mark.parametrize("size", [(1, 1), (8, 8), (17, 33), (40, 9)])
def test_gray_within_one(size, interval):
    image = noise(*size)
    got = jpeg.pixels(jpeg.encoded(image, interval=interval))
    assert got.shape == (*size, 3) and np.abs(got.astype(int) - image[..., None]).max() <= 1


@pytest.mark.parametrize("image", [smooth(30, 50), noise(30, 50, 3)])
def test_colours(image):
    error = np.abs(jpeg.pixels(jpeg.encoded(image)).astype(int) - image)
    assert error.max() <= 4 and error.mean() < 0.6
    assert np.abs(jpeg.pixels(jpeg.encoded(smooth(30, 50), 6)).astype(int) - smooth(30, 50)).mean() < 6


def test_coarser_planes():
    """A file written by hand: 32 x 16 pixels, colours at half the width and height, flat blocks of known means, and a plane a scan."""
    y, cb, cr = [[40, 80, 120, 160], [60, 100, 140, 180]], [[100, 160]], [[150, 90]]

    def scan(order):
        before, bits = {}, ""
        for c, level in order:
            value = (level - 128) * 8
            d, before[c] = value - before.get(c, 0), value
            n = abs(d).bit_length()
            bits += f"{n:04b}" + (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "") + "00000000"
        bits += "1" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8).replace(b"\xff", b"\xff\0")

    def segment(marker, body):
        return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2) + body

    frame = bytes([8, 0, 16, 0, 32, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    codes = bytes([0, 0, 0, 0, 12, *[0] * 12, *range(12)]) + bytes([16, *[0] * 7, 1, *[0] * 8, 0])
    head = b"\xff\xd8" + segment(0xDB, bytes([0] + [1] * 64)) + segment(0xC0, frame) + segment(0xC4, codes)
    mixed = [o for k in range(2) for o in [(1, y[0][2 * k]), (1, y[0][2 * k + 1]), (1, y[1][2 * k]), (1, y[1][2 * k + 1]), (2, cb[0][k]), (3, cr[0][k])]]
    one = head + segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan(mixed) + b"\xff\xd9"
    many = head
    for c, plane in ((1, y), (2, cb), (3, cr)):
        many += segment(0xDA, bytes([1, c, 0, 0, 63, 0])) + scan([(c, v) for row in plane for v in row])
    want = np.zeros((16, 32, 3))
    for v in range(16):
        for u in range(32):
            l, b, r = y[v // 8][u // 8], cb[0][u // 16] - 128, cr[0][u // 16] - 128
            want[v, u] = l + 1.402 * r, l - 0.344136 * b - 0.714136 * r, l + 1.772 * b
    for data in (one, many + b"\xff\xd9"):
        assert np.array_equal(jpeg.pixels(data), np.clip(np.rint(want), 0, 255))


def test_damaged_files_raise_one_error():
    whole = jpeg.with_depth(noise(16, 24, 3), noise(8, 8))
    for i in range(0, len(whole), 3):
        for changed in (whole[:i], whole[:i] + bytes([whole[i] ^ 255]) + whole[i + 1 :], whole[:i] + whole[i + 1 :]):
            try:
                assert jpeg.pixels(changed).shape[2] == 3
                jpeg.orientation(changed), jpeg.depths(changed)
            except ValueError:
                pass
    with pytest.raises(ValueError, match="ends early"):
        jpeg.pixels(jpeg.encoded(noise(16, 16))[:-20])
    large = bytearray(jpeg.encoded(noise(8, 8)))
    at = bytes(large).index(b"\xff\xc0")
    large[at + 5 : at + 9] = b"\xff\xff\xff\xff"  # claims 65535 x 65535 pixels
    with pytest.raises(ValueError, match="ends early"):
        jpeg.pixels(bytes(large))
    large[at + 1] = 0xC2
    with pytest.raises(ValueError, match="only sequential"):
        jpeg.pixels(bytes(large))


@pytest.mark.parametrize("way", range(1, 9))
def test_orientation_of_pixels_and_depth(spark, way):
    image, values = smooth(6, 9), noise(3, 5)
    content = jpeg.with_depth(image, values, "depth", 0.5, 2.5, way)
    assert jpeg.orientation(content) == way
    shown = {1: image, 2: image, 3: image[::-1, ::-1], 4: image[::-1, ::-1], 5: np.rot90(image), 6: np.rot90(image, 3), 7: np.rot90(image, 3), 8: np.rot90(image)}[way]
    turned = {1: values, 2: values[:, ::-1], 3: values[::-1, ::-1], 4: values[::-1], 5: values.T, 6: values.T[:, ::-1], 7: values[::-1, ::-1].T, 8: values.T[::-1]}[way]
    files = spark.createDataFrame([(1, bytearray(content))], "image_id long, content binary")
    got = {(r.x, r.y): (r.r, r.g, r.b) for r in raster.decode(files).collect()}
    assert set(got) == {(x, y) for y in range(shown.shape[0]) for x in range(shown.shape[1])}
    assert all(max(abs(int(a) - int(b)) for a, b in zip(v, shown[y, x], strict=True)) <= 4 for (x, y), v in got.items())
    samples = {(r.x, r.y): r.v for r in raster.embedded_depth(files).collect()}
    assert set(samples) == {(x, y) for y in range(turned.shape[0]) for x in range(turned.shape[1])}
    assert all(abs(v - (0.5 + turned[y, x] / 255 * 2)) < 0.01 for (x, y), v in samples.items())
    assert raster.inspected(files).first()[1:] == ("jpeg", shown.shape[1], shown.shape[0], way, ["depth"], None)


def test_damaged_and_missing_content(spark):
    good = jpeg.encoded(noise(4, 5))
    rows = [(1, bytearray(good)), (2, bytearray(good[:-9])), (3, bytearray(b"text")), (4, None), (5, bytearray()), (6, bytearray(raster.png_bytes(noise(2, 3, 4))))]
    files = spark.createDataFrame(rows, "image_id long, content binary")
    assert {r.image_id: r.n for r in raster.decode(files, strict=False).groupBy("image_id").agg(F.count("*").alias("n")).collect()} == {1: 20, 6: 6}
    told = {r.image_id: (r.format, r.width, r.error is None) for r in raster.inspected(files).collect()}
    assert told == {1: ("jpeg", 5, True), 2: ("jpeg", None, False), 3: (None, None, False), 4: (None, None, False), 5: (None, None, False), 6: ("png", 3, True)}
    with pytest.raises(Exception, match="image 3"):
        raster.decode(files.where("image_id = 3")).collect()
    assert raster.embedded_depth(files).isEmpty() and raster.inspected(files.where("false")).isEmpty()


def test_depth_fills_the_pixels(spark):
    """Disparity comes first and is turned round; too few valid samples are passed over; images without any keep null."""
    values = (np.arange(48).reshape(6, 8) * 5 + 10).astype(np.uint8)
    few = np.zeros((6, 8), np.uint8)
    rows = [(1, bytearray(jpeg.with_depth(smooth(12, 16), values, "disparity", 0.0, 1.0))), (2, bytearray(jpeg.with_depth(smooth(12, 16), values, "depth", 0.0, 1.0)))]
    rows += [(3, bytearray(jpeg.with_depth(smooth(12, 16), few, "depth", 0.0, 1.0))), (4, bytearray(jpeg.encoded(smooth(12, 16))))]
    files = spark.createDataFrame(rows, "image_id long, content binary")
    pixels = raster.decode(files)
    samples = raster.embedded_depth(files)
    got = depth.with_embedded(pixels, samples)
    assert got.columns == pixels.columns and got.count() == 4 * 12 * 16
    shown = {(r.image_id, r.x, r.y): r.depth for r in got.collect()}
    assert all(v is None for (i, _, _), v in shown.items() if i > 2)
    for i, invert in ((1, True), (2, False)):
        v = np.array([[s.v for s in sorted(samples.where(f"image_id = {i}").collect(), key=lambda s: s.idx)]]).reshape(6, 8)
        lo, hi = np.sort(v.ravel())[[round(47 * 0.005), round(47 * 0.998)]]
        curved = np.clip((v - lo) / (hi - lo), 0, 1) ** 0.92
        own = np.floor((1 - curved if invert else curved) * 255 + 0.5)
        for y in range(12):
            for x in range(16):
                px, py = min(7, max(0, (x + 0.5) / 2 - 0.5)), min(5, max(0, (y + 0.5) / 2 - 0.5))
                x0, y0 = int(px), int(py)
                x1, y1 = min(7, x0 + 1), min(5, y0 + 1)
                want = (own[y0, x0] * (1 - px + x0) + own[y0, x1] * (px - x0)) * (1 - py + y0) + (own[y1, x0] * (1 - px + x0) + own[y1, x1] * (px - x0)) * (py - y0)
                assert abs(shown[i, x, y] - want) <= 1, (i, x, y)
    both = samples.where("image_id = 2").unionByName(samples.where("image_id = 1").withColumn("image_id", F.lit(2).cast("long")))
    assert depth.embedded(both).exceptAll(depth.embedded(samples.where("image_id = 1")).withColumn("image_id", F.lit(2).cast("long"))).isEmpty()
