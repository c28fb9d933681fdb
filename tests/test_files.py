"""Data sources: mix tables by ranges of entries, image files that appear when their write commits."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaframe.functions import color as C
from chromaframe.operators import spectral
from chromaframe.sources import imagefiles, mixfile, mixsource, raster

KEY = ["i0", "i1", "i2", "a0", "a1", "a2", "n_paints"]


@pytest.fixture(scope="module")
def mixes(spark):
    pigments = spark.createDataFrame([(i, [0.1 + (3 * i + j) % 11 / 3 for j in range(31)]) for i in range(6)], "pid int, k_over_s array<double>")
    return spectral.mix_table(pigments, 3)


def plain(df):
    return sorted(tuple(r[c] for c in KEY) for r in df.select(*KEY).collect())


@pytest.mark.parametrize("split", [100, 1 << 18])
@pytest.mark.parametrize("folder", [False, True])
def test_mix_table_as_a_source(spark, mixes, tmp_path, split, folder):
    path = str(tmp_path / "table")
    if folder:
        mixsource.write_mixes(mixes, 6, path)
        assert sorted(f for f in os.listdir(path) if not f.startswith("entries-")) == ["header.bin"]
    else:
        (tmp_path / "table").write_bytes(mixfile.encode(mixes, 6))
    got = mixsource.read_mixes(spark, path, split)
    assert plain(got) == plain(mixes) and got.rdd.getNumPartitions() >= (11 if split == 100 else 1)
    rows = {r.entry: r for r in got.collect()}
    assert sorted(rows) == list(range(15 * 9 + 20 * 45))
    by_key = {tuple(r[c] for c in KEY): r for r in mixes.collect()}
    assert all(np.allclose([r[c] for c in C.LAB], [by_key[tuple(r[c] for c in KEY)][c] for c in C.LAB], atol=1e-3) for r in rows.values())
    for where in ("i0 = 2", "i0 = 9", "entry = 140", "entry >= 100 and entry < 200 and a0 > 0", "i0 = 1 and entry > 300", "i0 = 1 and i0 = 2", "entry > 99999", "i0 is null"):
        assert sorted(r.entry for r in got.where(where).collect()) == sorted(r.entry for r in spark.createDataFrame(list(rows.values()), got.schema).where(where).collect()), where


def test_conditions_are_read_by_bytes(tmp_path, mixes):
    (tmp_path / "table").write_bytes(mixfile.encode(mixes, 6))
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

    reader = mixsource.MixReader(str(tmp_path / "table"))
    assert not list(reader.pushFilters([EqualTo(("i0",), 4), GreaterThanOrEqual(("entry",), 3)]))
    assert [(p.first, p.end) for p in reader.partitions()] == [(14 * 9, 15 * 9)]  # one pair begins with the last but one, no triple does
    left = EqualTo(("a0",), 1)
    assert list(reader.pushFilters([left])) == [left]


def test_damaged_mix_tables(spark, mixes, tmp_path):
    data = mixfile.encode(mixes, 6)
    for i, wrong in enumerate((b"", b"XXXX" + data[4:], data[:-1])):
        (tmp_path / str(i)).write_bytes(wrong)
        with pytest.raises(Exception, match="mix table"):
            mixsource.read_mixes(spark, str(tmp_path / str(i))).count()
    (tmp_path / "folder").mkdir()
    for nothing in ("folder", "missing"):
        with pytest.raises(Exception, match="no mix table"):
            mixsource.read_mixes(spark, str(tmp_path / nothing)).count()


def test_image_files(spark, tmp_path):
    rows = [(i, j, j % 4, j // 4, (i * 50 + j) % 256, j, 255 - j, 255, 0) for i in range(5) for j in range(12)]
    pixels = spark.createDataFrame(rows, raster.PIXEL)
    images = raster.encode(pixels).select(F.concat(F.lit("image "), F.col("image_id").cast("string"), F.lit(".png")).alias("name"), "content")
    path = str(tmp_path / "out")
    imagefiles.write_images(images.repartition(3), path)
    assert sorted(os.listdir(path)) == [f"image {i}.png" for i in range(5)]
    back = raster.read_images(spark, path).select(F.regexp_extract("path", "([0-9]+).png", 1).cast("long").alias("image_id"), "content")
    got = raster.decode(back).select("image_id", "idx", "x", "y", "r", "g", "b")
    assert sorted(map(tuple, got.collect())) == [r[:7] for r in rows]
    imagefiles.write_images(images.limit(1), path, "overwrite")
    assert len(os.listdir(path)) == 1


@pytest.mark.parametrize("bad", [(None, b"x"), ("a/b", b"x"), ("one", None), ("ok 1", b"twice"), ("_x", b"x")])
def test_an_aborted_write_leaves_no_files(spark, tmp_path, bad):
    rows = [(f"ok {i}", b"content") for i in range(20)] + [bad]
    path = str(tmp_path / "out")
    with pytest.raises(Exception):  # noqa: B017
        imagefiles.write_images(spark.createDataFrame(rows, "name string, content binary").repartition(4), path)
    assert not [f for _, _, files in os.walk(path) for f in files]


def test_abort_while_files_are_added(tmp_path):
    """Writers that go on during an abort fail, and nothing of theirs stays."""
    import threading

    from chromaframe.sources.staging import Staging

    for k in range(20):
        staging = Staging(str(tmp_path / str(k)))
        attempts = [staging.attempt() for _ in range(4)]

        def fill(files):
            with pytest.raises(OSError):
                for i in range(100_000):
                    files.add(f"f{i}", b"x")

        threads = [threading.Thread(target=fill, args=(a,)) for a in attempts]
        for t in threads:
            t.start()
        staging.abort()
        for t in threads:
            t.join()
        assert not os.listdir(tmp_path / str(k))
        staging.abort()
