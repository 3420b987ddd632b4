import numpy as np
import pytest

from gridlode.operators import grid


@pytest.mark.parametrize(("size", "rows", "columns"), [(5, 23, 9), (4, 6, 17), (1, 3, 3)])
def test_a_moving_window_in_bands(spark, monkeypatch, size, rows, columns):
    """The same means whatever the bands, and more tasks for more cells."""
    monkeypatch.setattr(grid, "STRIPE", 4)
    monkeypatch.setattr(grid, "TASK_CELLS", 9 if size == 1 else 20)
    values = np.random.default_rng(size).integers(0, 100, (rows, columns)).astype(float)
    frame = spark.createDataFrame([(r, c, float(values[r, c])) for r in range(rows) for c in range(columns)], "r long, c long, v double")
    out = grid.window_mean(frame, "v", size, rows, columns)
    half = size // 2
    wide = np.pad(values, ((half, size - half - 1), (half, size - half - 1)), mode="symmetric")
    got = {(r.r, r.c): r.v for r in out.collect()}
    assert len(got) == rows * columns
    assert all(got[r, c] == pytest.approx(wide[r : r + size, c : c + size].mean()) for r, c in got)
    assert out.rdd.getNumPartitions() == max(4, -(-rows * columns // (9 if size == 1 else 20)))
