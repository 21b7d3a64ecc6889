import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.errors import ArrayError, ChunkNotFoundError
from chunkloom.model import ArrayFrame, from_numpy
from chunkloom.operators import writing as w


@pytest.mark.parametrize("sel", [slice(3, 8), (slice(None), 2), (slice(1, 12, 3), slice(0, 4, 2)), (4, 1), ...])
def test_assign_scalar(spark, sel):
    a = np.arange(60).reshape(12, 5)
    got = w.assign(from_numpy(spark, a, (5, 2)), sel, -7)
    a[sel] = -7
    assert np.array_equal(got.to_numpy(), a)


def test_assign_array_and_points(spark):
    a = np.arange(60).reshape(12, 5)
    f = from_numpy(spark, a, (5, 2))
    new = np.arange(100, 106).reshape(3, 2)
    got = w.assign(f, (slice(2, 8, 2), slice(1, 3)), from_numpy(spark, new, 2))
    a[2:8:2, 1:3] = new
    assert np.array_equal(got.to_numpy(), a)
    with pytest.raises(ArrayError):
        w.assign(f, slice(0, 2), from_numpy(spark, new, 2))
    points = spark.createDataFrame([(0, 1, 1, 5), (1, 1, 1, 6), (2, 11, 4, 9)], "ord int, d0 long, d1 long, nv long")
    a[1, 1], a[11, 4] = 6, 9
    assert np.array_equal(w.assign_points(got, points).to_numpy(), a)


def test_fill_resize_append_rechunk(spark):
    f = ArrayFrame.of(spark.createDataFrame([(1, 5.0), (4, 7.0)], "d0 long, v double"), [6], 2, fill=0.5)
    assert w.filled(f).to_numpy().tolist() == [0.5, 5, 0.5, 0.5, 7, 0.5]
    assert w.filled(w.resized(f, [3])).to_numpy().tolist() == [0.5, 5, 0.5]
    grown = w.resized(w.resized(f, [4]), [6])
    assert w.filled(grown).to_numpy().tolist() == [0.5, 5, 0.5, 0.5, 0.5, 0.5]
    kept = w.resized(w.resized(f, [5], keep_outside=True), [6])
    assert w.filled(kept).to_numpy().tolist() == [0.5, 5, 0.5, 0.5, 7, 0.5]
    both = w.appended(f, f)
    assert both.shape == (12,) and w.filled(both).to_numpy()[10] == 7
    assert w.rechunked(f, 3).spec.grid.n_chunks == 2
    with pytest.raises(ArrayError):
        w.appended(f, from_numpy(spark, np.zeros((2, 2)), 2))


def test_missing_chunks_in_strict_arrays(spark):
    f = ArrayFrame.of(spark.createDataFrame([(1, 5.0)], "d0 long, v double"), [6], 2, read_missing=False)
    with pytest.raises(ChunkNotFoundError):
        w.filled(f)


def test_empty_chunks_are_left_out(spark):
    values = [0.0, 0.0, -0.0, 0.0, float("nan"), 1.0]
    f = ArrayFrame.of(spark.createDataFrame(list(enumerate(values)), "d0 long, v double"), [6], 2, fill=0.0)
    assert {r.c0 for r in w.stored_chunks(f).collect()} == {1, 2}
    g = ArrayFrame.of(spark.createDataFrame([(0, float("nan")), (1, float("nan")), (2, 1.0), (3, float("nan"))], "d0 long, v double"), [4], 2, fill=float("nan"))
    assert {r.c0 for r in w.stored_chunks(g).collect()} == {1}
    assert w.n_initialized(f).first().n == 2
    assert w.describe(f)["nchunks"] == 3 and w.readable_size(2048) == "2.0K"


def test_saved_cells_come_back(spark, tmp_path):
    f = from_numpy(spark, np.arange(40).reshape(8, 5), (3, 5))
    w.save_cells(f, str(tmp_path / "x"))
    w.save_cells(w.assign(f, slice(0, 3), 0).replaced(w.assign(f, slice(0, 3), 0).cells.filter(F.col("d0") < 3)), str(tmp_path / "x"))
    want = np.arange(40).reshape(8, 5)
    want[:3] = 0
    assert np.array_equal(w.load_cells(spark, str(tmp_path / "x"), f.spec).to_numpy(), want)
