import numpy as np
import pytest

from plumbline.kernels import alignment as A
from plumbline.kernels import images as I
from plumbline.operators import matching as M
from plumbline.operators import similarity as S

RNG = np.random.default_rng(3)


def test_shift_gold():
    a = np.arange(1, 10).reshape(3, 3)
    assert I.shift(a, 1, 0).tolist() == [[2, 3, 0], [5, 6, 0], [8, 9, 0]]
    assert I.shift(a, -1, 0).tolist() == [[0, 1, 2], [0, 4, 5], [0, 7, 8]]
    assert I.shift(a, 0, 1).tolist() == [[4, 5, 6], [7, 8, 9], [0, 0, 0]]
    assert I.shift(a, 0, -1).tolist() == [[0, 0, 0], [1, 2, 3], [4, 5, 6]]
    assert I.shift(a, 1, 1).tolist() == [[5, 6, 0], [8, 9, 0], [0, 0, 0]]
    assert I.shift(a, 0, 0).tolist() == a.tolist()
    assert not I.shift(a, 5, 0).any()


def test_laplacian_by_brute_force():
    u = RNG.integers(0, 255, (12, 9)).astype(np.uint8)
    p = np.pad(u.astype(int), 1, mode="reflect")
    k = np.array([[2, 0, 2], [0, -8, 0], [2, 0, 2]])
    want = np.array([[(p[y : y + 3, x : x + 3] * k).sum() for x in range(9)] for y in range(12)]).clip(0, 255)
    assert (I.laplacian(u, 3) == want).all()
    assert I.laplacian(u, 7).shape == u.shape


def test_stretch_edges():
    assert not I.stretch(np.full((3, 3), 7.0)).any()
    u = np.array([[1, 2]], np.uint8)
    assert I.stretch(u) is u
    assert not I.stretch_percentile(np.full((2, 2), np.nan)).any()


def test_zncc_and_nmi():
    a = RNG.normal(size=(9, 9))
    assert S.zncc(a, a) == pytest.approx(1)
    assert S.zncc(a, -a) == pytest.approx(-1)
    assert np.isnan(S.zncc(a, np.ones((9, 9))))
    b = RNG.normal(size=(57, 57))
    assert S.nmi_studholme(b, b) == pytest.approx(2)
    assert S.nmi_sum(b, b) == pytest.approx(1)
    assert S.nmi_studholme(b, RNG.normal(size=(57, 57))) < 1.2
    assert S.nmi_studholme(b, np.ones((57, 57))) == pytest.approx(1)
    assert np.isnan(S.nmi_studholme(np.ones((57, 57)), np.ones((57, 57))))


def test_outliers_without_spread_are_all_removed():
    assert not M.without_outliers(np.ones(5), np.ones(5)).any()
    keep = M.without_outliers(np.append(RNG.normal(size=200), 100), np.append(RNG.normal(size=200), 0))
    assert keep[:200].sum() > 190 and not keep[200]


def test_track_recovers_a_shift():
    base = I.correlate(RNG.normal(size=(160, 160)), I.PYRAMID, I.PYRAMID)
    img = I.stretch(base)
    moved = np.roll(img, (3, 2), (0, 1))
    kp, n = M.track(img, moved, None, M.Settings(max_corners=200, quality=0.05, min_distance=5, window=15, block=7))
    assert n >= len(kp) > 30
    assert abs(kp["dx"].median() - 2) < 0.05 and abs(kp["dy"].median() - 3) < 0.05
    assert M.track(np.zeros((40, 40), np.uint8), img[:40, :40], None, M.Settings()) is None


def test_automatic_sizes_and_polarity():
    base = I.correlate(RNG.normal(size=(90, 90)), I.PYRAMID, I.PYRAMID)
    ref = I.stretch(base).astype(float)
    kp = M.match_tile(ref, 255 - ref, np.ones((90, 90)), M.Settings(max_corners=40, quality=0.05, min_distance=5, window=11, block=5, ksize="auto", invert="auto"))
    assert set(kp["polarity"]) == {"inverted"} and abs(kp["dx"].median()) < 0.05


def test_phase_peak():
    a = RNG.normal(size=(64, 48))
    assert I.phase_peak(np.roll(a, (5, -4), (0, 1)), a) == (-5, 4)


def test_homography_from_noisy_points():
    h = np.array([[1.02, 0.03, 5], [-0.02, 0.98, -7], [1e-5, 2e-5, 1]])
    a = RNG.uniform(0, 300, (80, 2))
    b = A.apply(h, a)
    b[:20] += RNG.uniform(20, 60, (20, 2))
    got, ok = A.ransac(a, b)
    assert ok.sum() == 60 and np.allclose(A.apply(got, a[20:]), b[20:], atol=1e-3)
    assert A.ransac(a[:3], b[:3])[0] is None


def test_ecc_recovers_a_warp():
    img = I.correlate(I.correlate(RNG.normal(size=(120, 120)), I.PYRAMID, I.PYRAMID), I.PYRAMID, I.PYRAMID)
    h = np.array([[1.005, 0.004, 1.5], [-0.003, 0.997, -1.0], [0, 0, 1]])
    fixed = A.warp(img, h, img.shape)
    known = A.warp(np.ones(img.shape), h, img.shape) > 1 - 1e-9
    got, rho = A.ecc(img, fixed, np.eye(3), known=known)
    corners = np.array([[0.0, 0], [119, 0], [0, 119], [119, 119], [60, 60]])
    assert rho > 0.95 and np.abs(A.apply(got, corners) - A.apply(h, corners)).max() < 0.1
    again, rho = A.ecc(img, fixed, h, known=known)  # the solution as the start: it stays there
    assert rho > 0.99 and np.abs(A.apply(again, corners) - A.apply(h, corners)).max() < 0.1


def test_ecc_does_not_follow_a_zero_border():
    img = I.stretch(I.correlate(I.correlate(RNG.normal(size=(140, 160)), I.PYRAMID, I.PYRAMID), I.PYRAMID, I.PYRAMID)).astype(float) + 1
    moved = I.shift(img, -2, -3)  # two columns and three rows of zeros come in
    h = np.array([[1, 0, 2], [0, 1, 3], [0, 0, 1.0]])
    for start in (h, h + [[0, 0, 0.6], [0, 0, -0.5], [0, 0, 0]]):
        got, rho = A.ecc(moved, img, start)
        corners = np.array([[0.0, 0], [159, 0], [0, 139], [159, 139]])
        assert rho > 0.99 and np.abs(A.apply(got, corners) - A.apply(h, corners)).max() < 0.1
    assert A.ecc(img[:10, :10], img[:10, :10], np.eye(3)) == (None, 0.0)


def test_sift_matches_a_moved_image():
    big = I.stretch(I.correlate(I.correlate(RNG.normal(size=(220, 220)), I.PYRAMID, I.PYRAMID), I.PYRAMID, I.PYRAMID))
    a, b = big[10:170, 10:170], big[14:174, 16:176]
    (pa, da), (pb, db) = A.sift(a), A.sift(b)
    m = A.match(da, db)
    d = pa[m[:, 0]] - pb[m[:, 1]]
    assert len(m) > 10 and np.abs(np.median(d, 0) - [6, 4]).max() < 0.6


def test_equalized_keeps_the_range():
    u = RNG.integers(0, 255, (64, 64)).astype(np.uint8)
    e = I.equalized(u)
    assert e.dtype == np.uint8 and e.shape == u.shape and e.max() > 200
