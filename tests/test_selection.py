import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.errors import BoundsError, NegativeStepError, SelectionError
from chunkloom.model import ArrayFrame, from_numpy
from chunkloom.operators import planning, selection as s
from chunkloom.grid import Grid


@pytest.fixture(scope="module")
def arrays(spark):
    made = {1: (np.arange(30), 7), 2: (np.arange(60).reshape(12, 5), (5, 2)), 3: (np.arange(420).reshape(7, 6, 10), (3, 2, 4))}
    out = {}
    for k, (a, c) in made.items():
        f = from_numpy(spark, a, c)
        out[k] = a, f.replaced(f.cells.cache())
    return out


def equal(frame, want):
    want = np.asarray(want)
    assert frame.shape == want.shape
    got = frame.to_numpy() if want.size else np.zeros(want.shape)
    assert np.array_equal(got, want)


@pytest.mark.parametrize("n,sel", [
    (1, 4), (1, -1), (1, slice(3, 20)), (1, slice(None, None, 7)), (1, slice(25, 99)), (1, slice(9, 3)), (1, slice(-5, None)), (1, ...),
    (2, (3, slice(1, 4))), (2, (..., 2)), (2, (slice(2, 11, 4), slice(None, None, 3))), (2, 7), (3, (slice(1, 6, 2), ..., -3)), (3, (2, 3, 4)), (3, (slice(0, 0), 1)),
])
def test_basic(arrays, n, sel):
    a, f = arrays[n]
    got, want = s.select(f, sel), np.asarray(a[sel])
    equal(got, want)
    if want.shape == ():
        assert s.scalar(got) == want


@pytest.mark.parametrize("n,sel", [(2, ([3, 1, 1], [4, 0])), (2, ([-1, 0], slice(1, 4))), (3, ([6, 0], 3, [9, 9, 0])), (2, (np.isin(np.arange(12), [0, 5, 11]), [2])), (3, (slice(1, 7, 3), [5, 5], slice(2, 4))), (2, ([], [1]))])
def test_orthogonal(arrays, n, sel):
    a, f = arrays[n]
    full = [np.arange(k)[x] if not isinstance(x, int) else np.array([x]) for x, k in zip(sel, a.shape)] if all(not (isinstance(x, list) and not x) for x in sel) else [np.array(x, int) for x in sel]
    want = a[np.ix_(*full)]
    want = want.reshape([n for n, x in zip(want.shape, sel) if not isinstance(x, int)])
    equal(s.orthogonal(f, sel), want)


@pytest.mark.parametrize("n,sel", [(1, ([29, 15, 8, 1],)), (1, ([5, 5, -1],)), (2, ([0, 11, 0], [4, 0, 4])), (3, (np.array([[0, 6], [3, 3]]), 2, np.array([[9, 0], [1, 1]])))])
def test_coordinates(arrays, n, sel):
    a, f = arrays[n]
    equal(s.coordinates(f, sel), a[tuple(np.asarray(x) for x in sel)])


@pytest.mark.parametrize("m", [np.zeros(30, bool), np.ones(30, bool), np.arange(30) % 2 == 1, np.arange(30) == 17])
def test_mask(arrays, m):
    a, f = arrays[1]
    equal(s.mask(f, m), a[m])
    equal(s.select(f, m), a[m])


def test_mask_by_condition_ranks_in_c_order(arrays):
    a, f = arrays[3]
    rows = s.mask(f, F.col("v") % 11 == 3).orderBy("o0").collect()
    want = a[a % 11 == 3]
    assert [r.o0 for r in rows] == list(range(len(want))) and [r.v for r in rows] == want.tolist()


def test_blocks(arrays):
    a, f = arrays[2]
    equal(s.blocks(f, (slice(1, 3), -1)), a[5:12, 4:5])
    equal(s.blocks(f, 2), a[10:12])
    with pytest.raises(BoundsError):
        s.blocks(f, 3)


def test_errors(arrays):
    _, f = arrays[2]
    with pytest.raises(BoundsError):
        s.select(f, 12)
    with pytest.raises(NegativeStepError):
        s.select(f, slice(None, None, -1))
    with pytest.raises(SelectionError):
        s.select(f, (1, 2, 3))
    with pytest.raises(SelectionError):
        s.orthogonal(f, ([True, False], slice(None)))


def test_fields(spark):
    rows = [(0, (b"aaa", 1, 4.2)), (1, (b"bbb", 2, 8.4)), (2, (b"ccc", 3, 12.6))]
    df = spark.createDataFrame(rows, "d0 long, v struct<foo:binary,bar:int,baz:double>")
    f = ArrayFrame.of(df, [3], 2)
    got = s.select(f, ("bar", "baz", slice(1, 3)))
    assert sorted(map(tuple, got.cells.collect())) == [(0, 2, 8.4), (1, 3, 12.6)]
    with pytest.raises(SelectionError):
        s.select(f, "nope")


@pytest.mark.parametrize("sel,want", [(slice(200, 400, 100), {4, 6}), (slice(0, 1070, 50), set(range(22))), (slice(1060, 1070), {21}), (slice(5, 5), set()), (51, {1})])
def test_only_needed_chunks(spark, sel, want):
    got = planning.chunk_projections(spark, Grid.of([1070], 50), sel)
    assert {r.c0 for r in got.collect()} == want


def test_projection_tiles_the_selection(spark):
    for start, stop, step in [(0, 100, 1), (3, 97, 7), (10, 90, 13), (9, 10, 1)]:
        rows = planning.chunk_projections(spark, Grid.of([100], 9), slice(start, stop, step)).orderBy("c0").collect()
        got = [r.c0 * 9 + i for r in rows for i in range(r.sel_start0, r.sel_stop0, step)]
        assert got == list(range(start, stop, step))
        assert [r.out_start0 for r in rows] == [0, *(r.out_stop0 for r in rows[:-1])]


def test_chunk_columns_prune_partitions(spark, tmp_path):
    from chunkloom.operators.writing import load_cells, save_cells

    f = from_numpy(spark, np.arange(100), 10)
    save_cells(f, str(tmp_path / "a"))
    back = load_cells(spark, str(tmp_path / "a"), f.spec)
    plan = s.select(back, slice(23, 47)).cells._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(c0" in plan and "PushedFilters: [IsNotNull(d0), GreaterThanOrEqual(d0,23)" in plan
    equal(s.select(back, slice(23, 47)), np.arange(23, 47))
