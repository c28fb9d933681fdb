"""Results and sizes of the findings of round 4."""

import duckdb
import numpy as np
import pytest
from chromaframe.functions import color as C
from chromaframe.operators import export, lines, palette, spectral
from chromaframe.plans import registry
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.1"


def test_resized_depth_is_summed_as_its_sql_does_in_one_thread(spark, tmp_path):
    """Images with halves at nine places, which doubles put on one side and decimals on the other."""
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"COPY (SELECT * FROM '{DIR}/orders.parquet' WHERE o_orderkey // 1500 IN (16, 25, 34)) TO '{tmp_path}/orders.parquet'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    want = con.execute(registry.SQL["depth_resized"]).fetchall()
    got = registry.QUERIES["depth_resized"](spark, str(tmp_path)).select("image_id", "x", "y", "depth")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 4500
    assert {(r[0], r[1], r[2]): r[3] for r in want}[16, 37, 5] == 190


def rough(spark, *shapes):
    """Images with much noise in their depth, whose last row ends early and has no depth at its end; a pixel has no colour."""
    rng = np.random.default_rng(7)
    rows = []
    for image_id, (w, h) in enumerate(shapes):
        for i in range(w * h - 3):
            y, x = divmod(i, w)
            z = int(np.clip(255 * x / w + rng.integers(-60, 60), 0, 255))
            rows.append((image_id, i, x, y, *(None if c == 0 and i == 5 else int(rng.integers(0, 256)) for c in range(3)), 255, z if i < w * h - 5 else None))
    return spark.createDataFrame(rows, "image_id long, idx int, x int, y int, r int, g int, b int, alpha int, depth int")


def step_by_step(pixels, levels, cutoff, size):
    depth = pixels.where("depth is not null").select("image_id", "x", "y", (F.col("depth") / 255.0).alias("v"))
    span = depth.groupBy("image_id").agg(F.min("v").alias("lo"), F.least(F.max("v"), C.num(cutoff)).alias("hi")).where("hi > lo")
    edges = span.select("image_id", F.array(*[F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * ((i + 1) / (levels + 1)), 9) for i in range(levels)]).alias("levels"))
    field = lines.resampled(depth, size, size).join(edges, "image_id").withColumn("v", F.round("v", 9))
    chains = lines.contour_chains(lines.contour_segments(lines.contour_cells(field, F.col("levels"), cutoff), size - 1, size - 1))
    return lines.line_colors(lines.chain_segments(lines.smoothed(chains)), pixels)


def test_contours_in_one_group_are_those_of_all_steps(spark, monkeypatch):
    """Of images smaller and larger than the field, coloured in their groups and by joins; chains meet where noise crosses cells twice."""
    pixels = rough(spark, (11, 7), (40, 31), (1, 9), (200, 6))
    want = sorted(map(tuple, step_by_step(pixels, 3, 0.9, 15).collect()))
    columns = step_by_step(pixels.where("false"), 3, 0.9, 15).columns
    for whole in (export.WHOLE, 300, 0):
        monkeypatch.setattr(export, "WHOLE", whole)
        assert sorted(map(tuple, export.contour_lines(pixels, 3, 0.9, size=15).select(*columns).collect())) == want
    assert {r[0] for r in want} >= {0, 1, 3} and len({r[-1] for r in want}) == 2


def test_contours_take_few_jobs_and_no_joins_of_points(spark):
    """Jobs took most of the time of small tables, sorts and joins of 40401 points an image that of large ones."""
    pixels = rough(spark, (11, 7), (8, 9))
    spark.sparkContext.setJobGroup("contours", "contours")
    found = export.contour_lines(pixels, 3, 0.9, size=15)
    assert found.count() > 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("contours")) < 20
    plan = found._jdf.queryExecution().toString()
    assert "Window" not in plan and "Broadcast" not in plan


@pytest.mark.parametrize("paints", [1, 2, 3])
def test_tubes_of_all_pigments_have_no_swap(spark, paints):
    pigments = spectral.Pigments.of(spectral.pigment_fixture(spark).where("pid < 4"))
    minima = palette.SubsetMinima(pigments, np.array([(0.5, 0.1, 0.0)]), paints)
    whole = pigments.pid.tolist()
    assert palette.improve_tubes(whole, whole, minima, np.ones(1)) == whole
