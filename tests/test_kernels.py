import numpy as np
import pytest

from tarn.functions import kernels as k
from tarn.operators import frames


def flood(a):
    lab, n = np.zeros(a.shape, int), 0
    for y, x in zip(*np.nonzero(a), strict=True):
        if lab[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        while stack:
            i, j = stack.pop()
            if 0 <= i < a.shape[0] and 0 <= j < a.shape[1] and a[i, j] and not lab[i, j]:
                lab[i, j] = n
                stack += [(i + p, j + q) for p in (-1, 0, 1) for q in (-1, 0, 1)]
    return lab


@pytest.mark.parametrize("p", [0.2, 0.45, 0.7])
def test_label(p):
    rng = np.random.default_rng(3)
    for _ in range(40):
        a = rng.random((rng.integers(1, 15), rng.integers(1, 15))) < p
        assert (k.label(a) == flood(a)).all()


def test_closing():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a = rng.random((9, 11)) < 0.3
        h, w = a.shape
        near = lambda m, y, x, f: f(m[max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2])
        d = np.array([[near(a, y, x, np.any) for x in range(w)] for y in range(h)])
        assert (k.closing(a) == np.array([[near(d, y, x, np.all) for x in range(w)] for y in range(h)])).all()


def lake():
    y, x = np.mgrid[:40, :40]
    a = (y - 15) ** 2 + (x - 15) ** 2 <= 100
    a[13:17, 13:18] = False  # a hole of 20
    a[30:36, 28:38] = True  # a pond of 60
    a[2:3, 36:39] = True  # noise
    return a


def test_clean_and_touch():
    a = lake()
    frame = np.where(a, 1, 0)
    before = frame.copy()
    lab = k.clean(frame)
    assert (frame == before).all() and lab.max() == 2
    burn = np.zeros((40, 40), int)
    burn[15, 8] = 1
    kept = k.touching(lab, burn)
    full = a.copy()
    full[13:17, 13:18] = True
    full[30:36, 28:38] = False
    full[2:3, 36:39] = False
    assert (kept == k.closing(full)).all()
    assert k.clean(np.where(a, 2, 0), 2).max() == 2 and k.clean(frame, 0).max() == 0


def test_limits():
    a = np.zeros((20, 20), bool)
    a[0, :] = a[5, :10] = True
    assert k.drop_small(a, 20).sum() == 20 and k.drop_small(a, 10).sum() == 30


def test_rasterise():
    ring = np.array([(2.5, 2.5), (7.5, 2.5), (7.5, 7.5), (2.5, 7.5)])
    inner = k.rasterise(ring, 10, 10, 0, 10, 1, all_touched=False)
    outer = k.rasterise(ring, 10, 10, 0, 10, 1)
    assert 16 <= inner.sum() <= 36 and outer.sum() == 36 and (outer >= inner).all()
    sliver = k.rasterise(np.array([(0.1, 5.2), (9.9, 5.2), (9.9, 5.3)]), 10, 10, 0, 10, 1)
    assert sliver.sum() == 10 and sliver[4].all()


def test_gaussian_keeps_sum():
    a = np.zeros((31, 31))
    a[15, 15] = 1
    g = k.gaussian(a, 2)
    assert g.sum() == pytest.approx(1) and g[15, 15] == g.max()


def test_frames(spark):
    a = lake()
    rows = [(t, y, x, int(a[y, x]), int(y == 15 and x == 8)) for t in (1, 2) for y in range(40) for x in range(40)]
    d = spark.createDataFrame(rows, "t int, y int, x int, mask int, burn int")
    got = {r.t: r.area for r in frames.cleaned_area(d, ["t"], "mask", "burn", resolution=10).collect()}
    lab = k.clean(np.where(a, 1, 0))
    want = k.touching(lab, np.where((np.arange(40)[:, None] == 15) & (np.arange(40) == 8), 1, 0)).sum() * 100
    assert got == {1: want, 2: want}
    comp = frames.components(d, ["t"])
    assert comp.where("t = 1").count() == (lab > 0).sum()
    kept = frames.on_burned(comp, d.where("burn = 1 and t = 1"), ["t"])
    assert kept.where("t = 2").count() * 100 == want
    ring = spark.createDataFrame([(1, [(2.5, 2.5), (7.5, 2.5), (7.5, 7.5), (2.5, 7.5)])], "area_id long, ring array<struct<x:double,y:double>>")
    assert frames.burned(ring, "area_id", 10, 10, 0, 10, 1).count() == 36
    smooth = frames.smoothed(d.where("t = 1").withColumn("mask", d["mask"].cast("double")), ["t"], "mask", 1.5)
    assert smooth.count() == 1600
