"""Tiled rasters written and read, tile by tile."""

import numpy as np
import pytest

from cityweave.sources import rasters

R = np.random.default_rng(4)


@pytest.mark.parametrize("sample,predictor,deflate", [("<f4", 1, False), ("<f4", 3, True), (">f8", 3, True), ("<i2", 2, True), (">u2", 2, False), ("<f8", 1, True)])
def test_round_trip(spark, tmp_path, sample, predictor, deflate):
    values = np.round(R.random((37, 50)) * 200).astype(float)
    values[3, 4] = np.nan
    (tmp_path / "a.tif").write_bytes(rasters.encode(values, 16, sample, deflate, predictor, (100.0, 500.0), (2.0, 4.0), nodata=9999))
    t = rasters.tiles(rasters.files(spark, f"file://{tmp_path}"))
    assert t.count() == 3 * 4
    got = rasters.cells(t).collect()
    assert len(got) == values.size
    for c in got:
        want = values[c.row, c.col]
        assert (c.value is None) == np.isnan(want) and (c.value is None or c.value == want)
        assert (c.x, c.y) == (100.0 + 2 * (c.col + 0.5), 500.0 - 4 * (c.row + 0.5))


def test_strips_are_tiles_of_full_width():
    import struct

    body = np.arange(15, dtype="<u2")
    tags = [(256, 3, 1, 3), (257, 3, 1, 5), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 3, 200), (278, 3, 1, 2), (279, 4, 3, 212)]
    data = struct.pack("<2sHIH", b"II", 42, 8, len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    data = data.ljust(200, b"\0") + struct.pack("<6I", 224, 236, 248, 12, 12, 6) + body.tobytes()
    rows = [dict(zip([c.split()[0] for c in rasters.TILES.split(", ")][1:], t)) for t in rasters.cut(data)]
    assert [(t["row0"], t["tile_rows"]) for t in rows] == [(0, 2), (2, 2), (4, 1)]
    assert np.vstack([rasters.samples(t) for t in rows]).ravel().tolist() == body.tolist()


def test_faults_name_the_file(spark, tmp_path):
    whole = rasters.encode(np.ones((20, 20)), 16)
    for k, data in enumerate((b"MM\0*", b"II*\0", b"no file", whole[:-5])):
        (tmp_path / f"{k}.tif").write_bytes(data)
        with pytest.raises(Exception, match=f"{k}.tif"):
            rasters.tiles(rasters.files(spark, f"file://{tmp_path}/{k}.tif")).count()


def test_merged_heights(spark):
    ground = np.add.outer(np.arange(8.0) * 3, np.arange(8.0))
    ground[0, 0] = -9000.0
    # row 0 of a file is its northernmost
    df = spark.createDataFrame([("a", rasters.encode(ground[::-1][:, :5], 4, origin=(0.0, 8.0))), ("b", rasters.encode(ground[::-1][:, 4:], 4, origin=(4.0, 8.0)))], "path string, content binary")
    grid = rasters.merged(rasters.cells(rasters.tiles(df)), 1.0, 1.0)
    assert {(r.row, r.col): r.value for r in grid.collect()} == {(i, j): 0.0 if (i, j) == (0, 0) else ground[i, j] for i in range(8) for j in range(8)}
    points = spark.createDataFrame([(1, 2.75, 3.5), (2, 1.0, 1.0), (3, 0.2, 5.0), (4, 7.5, 7.5)], "id long, x double, y double")
    got = {r.id: r.z for r in rasters.heights(grid, points, 1.0, 1.0, "id").collect()}
    assert got == {1: 3.0 * 3 + 2.25, 2: (0 + 1 + 3 + 4) / 4, 3: None, 4: None}
