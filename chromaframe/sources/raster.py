"""Pixel tables: from tables, from image files, and back to files.

A ``pixel`` row is (image_id, idx, x, y, r, g, b, alpha, depth); idx runs row by row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaframe.sources import jpeg

#: The raster that stands for photos in the sample tables: 50 x 30 pixels of consecutive order keys.
WIDTH, HEIGHT = 50, 30

PIXEL = "image_id bigint, idx int, x int, y int, r int, g int, b int, alpha int, depth int"


def pixels_of_orders(orders: DataFrame) -> DataFrame:
    """Integer-only pixels from orders, so any engine agrees on them."""
    n = WIDTH * HEIGHT
    placed = orders.select((F.col("o_orderkey") - F.col("o_orderkey") % n).alias("first"), F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust")).select(
        F.expr(f"key div {n}").alias("image_id"), (F.col("key") % n).cast("int").alias("idx"), "key", "cust"
    )
    x, y = (F.col("idx") % WIDTH).cast("int"), F.expr(f"cast(idx div {WIDTH} as int)")
    placed = placed.withColumns({"x": x, "y": y})
    return placed.select(
        "image_id", "idx", "x", "y",
        (F.col("x") * 5 + F.col("cust") % 8).cast("int").alias("r"),
        (F.col("y") * 8 + F.col("cust") % 16).cast("int").alias("g"),
        F.expr("cast(((x div 10) * 51 + (y div 10) * 17 + key % 5) % 256 as int)").alias("b"),
        F.lit(255).alias("alpha"),
        F.least(F.lit(255), (F.col("x") * 5 + F.col("cust") % 6).cast("int")).alias("depth"),
    )


def read_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels_of_orders(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def scaled_size(width: int, height: int, longest: int) -> tuple[int, int]:
    """Size with the longest side at most ``longest``; never larger than before."""
    scale = min(1.0, longest / max(width, height, 1))
    return max(1, int(width * scale + 0.5)), max(1, int(height * scale + 0.5))


def downscale(pixels: DataFrame, step: int) -> DataFrame:
    """Block means of ``step`` x ``step`` pixels."""
    mean = [F.floor(F.avg(c) + 0.5).cast("int").alias(c) for c in ("r", "g", "b", "alpha", "depth")]
    return pixels.groupBy("image_id", F.expr(f"cast(x div {step} as int)").alias("x"), F.expr(f"cast(y div {step} as int)").alias("y")).agg(*mean)


def crop(pixels: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Pixels inside a normalised rectangle, with new coordinates; sizes come from each image itself."""
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    ends = size.select(
        "image_id", *[F.floor(F.col(s) * v + 0.5).cast("int").alias(n) for n, s, v in (("left", "w", x0), ("top", "h", y0), ("right", "w", x1), ("bottom", "h", y1))]
    )
    inside = pixels.join(ends, "image_id").where("x >= left and x < right and y >= top and y < bottom")
    return inside.select(
        "image_id", ((F.col("y") - F.col("top")) * (F.col("right") - F.col("left")) + F.col("x") - F.col("left")).cast("int").alias("idx"),
        (F.col("x") - F.col("left")).alias("x"), (F.col("y") - F.col("top")).alias("y"), "r", "g", "b", "alpha", "depth",
    )


def orient(pixels: DataFrame, orientation: str) -> DataFrame:
    """Pixels turned upright: up, down, left or right (mirrored forms count like the plain ones)."""
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    nx, ny, nw = {"up": (x, y, w), "down": (w - 1 - x, h - 1 - y, w), "left": (y, w - 1 - x, h), "right": (h - 1 - y, x, h)}[orientation]
    turned = pixels.join(size, "image_id").select("image_id", nx.alias("nx"), ny.alias("ny"), nw.alias("nw"), "r", "g", "b", "alpha", "depth")
    return turned.select("image_id", (F.col("ny") * F.col("nw") + F.col("nx")).cast("int").alias("idx"), F.col("nx").alias("x"), F.col("ny").alias("y"), "r", "g", "b", "alpha", "depth")


def png_bytes(rgba: np.ndarray) -> bytes:
    """An (h, w, 4) byte array as a PNG file."""
    h, w, _ = rgba.shape
    raw = np.concatenate((np.zeros((h, 1), np.uint8), rgba.reshape(h, w * 4)), axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def rgba_of_png(data: bytes) -> np.ndarray:
    """An 8-bit gray, RGB or RGBA PNG without interlacing as an (h, w, 4) byte array."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, w, h, kind = 8, b"", 0, 0, 0
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            w, h, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlace or kind not in (0, 2, 6):
                raise ValueError("only 8-bit gray, RGB or RGBA without interlacing")
        elif name == b"IDAT":
            packed += body
        at += size + 12
    n = {0: 1, 2: 3, 6: 4}[kind]
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.uint8)
    above = np.zeros(w * n, np.int64)
    for y in range(h):
        how, line = lines[y, 0], lines[y, 1:].astype(np.int64)
        if how == 2:
            line = line + above
        elif how in (1, 3, 4):
            for i in range(w * n):
                left, up, corner = (line[i - n] if i >= n else 0), above[i], (above[i - n] if i >= n else 0)
                if how == 1:
                    add = left
                elif how == 3:
                    add = (left + up) // 2
                else:
                    p = left + up - corner
                    add = min((left, up, corner), key=lambda v: abs(p - v))
                line[i] = (line[i] + add) & 255
        above = line & 255
        out[y] = above
    pixels = out.reshape(h, w, n)
    if n == 1:
        pixels = np.repeat(pixels, 3, axis=2)
    return pixels if n == 4 else np.concatenate((pixels, np.full((h, w, 1), 255, np.uint8)), axis=2)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files under ``path``: path, modificationTime, length, content, and ``metadata`` with the type by suffix as fallback."""
    files = spark.read.format("binaryFile").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.withColumn("metadata", F.create_map(F.lit("type"), F.coalesce(F.nullif(kind, F.lit("")), F.lit("public.image")), F.lit("length"), F.col("length").cast("string")))


def _picture(content: bytes) -> np.ndarray:
    """(h, w, 4) bytes of a PNG or JPEG file, the right way up; mirrored forms count like the plain ones."""
    if content[:2] == b"\xff\xd8":
        rgb = jpeg.upright(jpeg.pixels(content), jpeg.orientation(content), False)
        return np.concatenate((rgb, np.full((*rgb.shape[:2], 1), 255, np.uint8)), axis=2)
    return rgba_of_png(content)


#: What a damaged file raises.
_DAMAGED = (ValueError, KeyError, IndexError, struct.error, zlib.error)


def decode(images: DataFrame, strict: bool = True) -> DataFrame:
    """Pixels of PNG and JPEG ``images`` (image_id, content), upright; alpha is forced opaque, depth is null (see ``with_embedded_depth``).

    A file that can't be read fails, or if not ``strict`` has no pixels; ``inspected`` tells why. A null content has none either way.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image_id, content in zip(batch["image_id"], batch["content"], strict=True):
                try:
                    rgba = _picture(bytes(content))
                except _DAMAGED as e:
                    if strict:
                        raise ValueError(f"image {image_id}: {e}") from e
                    continue
                h, w, _ = rgba.shape
                idx = np.arange(h * w, dtype=np.int32)
                flat = rgba.reshape(-1, 4).astype(np.int32)
                yield pd.DataFrame(
                    {"image_id": image_id, "idx": idx, "x": idx % w, "y": idx // w, "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2], "alpha": np.int32(255), "depth": pd.array([None] * (h * w), "Int32")}
                )

    return images.where("content IS NOT NULL").select("image_id", "content").mapInPandas(run, PIXEL)


def inspected(images: DataFrame) -> DataFrame:
    """Per file of ``images`` (image_id, content): format (null if neither PNG nor JPEG), upright width and height, stored orientation, kinds of depth, and error, if any."""

    def one(content: bytes | None) -> tuple:
        kind = None if content is None else "jpeg" if content[:2] == b"\xff\xd8" else "png" if content[:8] == b"\x89PNG\r\n\x1a\n" else None
        try:
            if kind is None:
                raise ValueError("no content" if content is None else "neither a PNG nor a JPEG file")
            h, w, _ = _picture(content).shape
            of_jpeg = (jpeg.orientation(content), [d.kind for d in jpeg.depths(content)]) if kind == "jpeg" else (1, [])
            return kind, w, h, *of_jpeg, None
        except _DAMAGED as e:
            return kind, None, None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(c.as_py()) for c in batch.column("content")]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), *columns], names=["image_id", "format", "width", "height", "orientation", "depths", "error"])

    return images.select(F.col("image_id").cast("long"), "content").mapInArrow(run, "image_id bigint, format string, width int, height int, orientation int, depths array<string>, error string")


def embedded_depth(images: DataFrame) -> DataFrame:
    """Samples (image_id, kind, idx, x, y, v) of the depth pictures inside JPEG ``images`` (image_id, content), kind being disparity or depth.

    They are turned as the picture is stored, mirrored ones mirrored. Other files, and damaged ones, have none; of two pictures of a kind the first counts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image_id, content in zip(batch["image_id"], batch["content"], strict=True):
                try:
                    found = {d.kind: d.values for d in reversed(jpeg.depths(bytes(content)))}
                except _DAMAGED:
                    continue
                for kind, values in found.items():
                    idx = np.arange(values.size, dtype=np.int32)
                    yield pd.DataFrame({"image_id": image_id, "kind": kind, "idx": idx, "x": idx % values.shape[1], "y": idx // values.shape[1], "v": values.reshape(-1)})

    return images.where("content IS NOT NULL").select("image_id", "content").mapInPandas(run, "image_id bigint, kind string, idx int, x int, y int, v double")


def encode(pixels: DataFrame) -> DataFrame:
    """PNG bytes per image; one image is one group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        w, h = int(group["x"].max()) + 1, int(group["y"].max()) + 1
        rgba = group[["r", "g", "b", "alpha"]].to_numpy(np.uint8).reshape(h, w, 4)
        return pd.DataFrame({"image_id": [group["image_id"].iloc[0]], "width": [w], "height": [h], "content": [png_bytes(rgba)]})

    return pixels.groupBy("image_id").applyInPandas(run, "image_id bigint, width int, height int, content binary")


def encode_jpeg(pixels: DataFrame, step: int = 1, depth: bool = False) -> DataFrame:
    """JPEG bytes per image, coefficients in multiples of ``step``, with ``depth`` as a disparity picture of 0 to 255 inside; one image is one group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        w, h = int(group["x"].max()) + 1, int(group["y"].max()) + 1
        rgb = group[["r", "g", "b"]].to_numpy(np.uint8).reshape(h, w, 3)
        content = jpeg.with_depth(rgb, group["depth"].to_numpy(np.uint8).reshape(h, w), "disparity", 0.0, 255.0, step=step) if depth else jpeg.encoded(rgb, step)
        return pd.DataFrame({"image_id": [group["image_id"].iloc[0]], "width": [w], "height": [h], "content": [content]})

    return pixels.groupBy("image_id").applyInPandas(run, "image_id bigint, width int, height int, content binary")
