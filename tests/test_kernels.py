"""Raster kernels against closed forms."""

import numpy as np
import pytest

from grouploom.operators import kernels as N

RNG = np.random.default_rng(2)


def test_plain_resize():
    assert N.bilinear_weights(2, 4, False) @ [0, 1] == pytest.approx([0, 0.25, 0.75, 1])
    assert N.bilinear_weights(4, 2, False) @ [0, 1, 5, 9] == pytest.approx([0.5, 7])
    assert N.bilinear_weights(6, 6, False) == pytest.approx(np.eye(6))
    ramp = np.linspace(0.1, 0.9, 9)[None, :].repeat(9, axis=0)
    assert N.resize(ramp, 27)[:, 1:-1] == pytest.approx((0.1 + 0.1 * ((np.arange(1, 26) + 0.5) / 3 - 0.5))[None, :].repeat(27, axis=0))


def test_antialiased_resize():
    assert N.bilinear_weights(4, 2, True) == pytest.approx(np.array([[3, 3, 1, 0], [0, 1, 3, 3]]) / 7)
    assert N.resize(np.full((8, 8), 0.4), 3, True) == pytest.approx(np.full((3, 3), 0.4))
    assert N.bilinear_weights(3, 5, True).sum(axis=1) == pytest.approx(1)
    assert N.resize_mask(np.arange(16).reshape(4, 4), 2).tolist() == [[5, 7], [13, 15]]


def test_uniform_patterns():
    inner = np.zeros((5, 5), int)
    inner[1:-1, 1:-1] = 1
    one = np.zeros((5, 5), int)
    one[2, 2] = 1
    hist = lambda image, mask: N.lbp_histogram(np.asarray(image, float), mask).nonzero()[0].tolist()
    assert hist(np.zeros((5, 5)), inner) == [8]
    assert hist(np.eye(5)[2][:, None] * np.eye(5)[2][None, :], one) == [0]
    assert hist(np.array([0, 0, 1, 2, 2])[None, :].repeat(5, axis=0), one) == [5]
    cross = np.zeros((5, 5))
    cross[2, 1] = cross[2, 3] = 9
    cross[2, 2] = 4
    # left and right are above the centre, up and down below, and so are the diagonals
    assert hist(cross, one) == [9]


def test_wavelet():
    assert N.DB2.sum() == pytest.approx(np.sqrt(2)) and (N.DB2**2).sum() == pytest.approx(1) and N.DB2[:2] @ N.DB2[2:] == pytest.approx(0)
    flat = N.wavelet_bands(np.full((16, 16), 0.3))
    assert flat["l2_ll"] == pytest.approx(np.full(flat["l2_ll"].shape, 1.2)) and all(abs(c).max() < 1e-12 for k, c in flat.items() if k != "l2_ll")
    ramp = N.wavelet_bands(np.linspace(0, 1, 32)[None, :].repeat(32, axis=0))
    assert abs(ramp["l1_hl"][:, 2:-2]).max() < 1e-12 and abs(ramp["l1_lh"]).max() < 1e-12 and abs(ramp["l1_hl"][:, 0]).max() > 1e-4
    assert flat["l1_hh"].shape == (9, 9) and flat["l2_ll"].shape == (6, 6)
    got = N.wavelet_features(np.full((16, 16), 0.3))
    assert got["wavelet_l2_ll_energy"] == pytest.approx(1.44) and got["wavelet_l2_ll_std"] == pytest.approx(0, abs=1e-12) and got["wavelet_l1_hh_entropy"] == 0


def test_gabor_is_a_convolution_with_symmetric_edges():
    image = RNG.random((9, 11))
    got = N.gabor_features(image)
    for f in (0.1, 0.2, 0.3):
        for a in (0, 45, 90, 135):
            k = N.gabor_kernel(f, np.deg2rad(a))
            reach = k.shape[0] // 2
            padded = np.pad(image, reach, mode="symmetric")
            response = np.array([[(padded[r : r + 2 * reach + 1, c : c + 2 * reach + 1] * k[::-1, ::-1]).sum() for c in range(11)] for r in range(9)])
            name = f"gabor_f{round(f * 100):03d}_o{a:03d}"
            want = {"real_mean": response.real.mean(), "real_std": response.real.std(), "magnitude_mean": abs(response).mean(), "magnitude_std": abs(response).std(), "magnitude_energy": (abs(response) ** 2).mean()}
            assert {s: got[f"{name}_{s}"] for s in want} == pytest.approx(want, abs=1e-10)


def test_augmentation():
    image = RNG.random((8, 8)) * 0.5 + 0.25
    plain = dict(flip=False, degrees=0, shift_x=0, shift_y=0, scale=1, brightness=1, contrast=1)
    change = lambda **k: N.augmented(image, **(plain | k))
    assert change() == pytest.approx(image)
    assert change(flip=True) == pytest.approx(image[:, ::-1])
    assert change(degrees=90) == pytest.approx(np.rot90(image, -1)) and change(degrees=180) == pytest.approx(image[::-1, ::-1])
    moved = np.zeros_like(image)
    moved[2:, 1:] = image[:-2, :-1]
    assert change(shift_x=1 / 8, shift_y=2 / 8) == pytest.approx(moved)
    assert change(brightness=0.5) == pytest.approx(image / 2) and change(brightness=4) == pytest.approx(np.minimum(image * 4, 1))
    assert change(contrast=0) == pytest.approx(np.full((8, 8), image.mean()))
    zoomed = N.augmented(np.full((8, 8), 0.5), **(plain | {"scale": 0.5}))
    assert zoomed[3:5, 3:5] == pytest.approx(0.5) and zoomed[0, 0] == 0


def test_a_stack_gives_what_single_images_give(spark):
    r = np.random.default_rng(3)
    shapes = [(8, 8), (5, 9), (8, 8), (5, 9), (8, 8)]
    images = [r.random(s) for s in shapes]
    names = sorted(N.gabor_features(images[0]))
    rows = spark.createDataFrame([(k, *s, x.ravel().tolist()) for k, (s, x) in enumerate(zip(shapes, images, strict=True))], "sample_id long, height int, width int, x array<double>")
    got = {r.sample_id: r for r in N.per_stack(rows.coalesce(1), names, N.gabor_stacked, "x", 128).collect()}
    for k, x in enumerate(images):
        one = N.gabor_features(x)
        assert np.allclose([got[k][n] for n in names], [one[n] for n in names], rtol=1e-12, atol=1e-14)
