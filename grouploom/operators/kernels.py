"""NumPy kernels for raster jobs, one Arrow batch at a time under ``mapInPandas``."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship

#: Daubechies-2 scaling filter, in closed form.
_R3 = np.sqrt(3.0)
DB2 = np.array([1 + _R3, 3 + _R3, 3 - _R3, 1 - _R3]) / (4 * np.sqrt(2.0))
ENTROPY_BINS = 64


def bilinear_weights(n: int, out: int, antialias: bool) -> np.ndarray:
    """(out, n) weights of a separable resize with half-pixel centres."""
    scale = n / out
    centre = (np.arange(out) + 0.5) * scale
    if antialias:
        reach = max(scale, 1.0)
        w = np.maximum(0, 1 - np.abs(np.arange(n)[None, :] + 0.5 - centre[:, None]) / reach)
        return w / w.sum(axis=1, keepdims=True)
    at = np.clip(centre - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, n - 1)
    w = np.zeros((out, n))
    w[np.arange(out), low] += 1 - (at - low)
    w[np.arange(out), high] += at - low
    return w


def resize(image: np.ndarray, side: int, antialias: bool = False) -> np.ndarray:
    wr, wc = bilinear_weights(image.shape[0], side, antialias), bilinear_weights(image.shape[1], side, antialias)
    return np.clip(wr @ image @ wc.T, 0, 1)


def resize_mask(mask: np.ndarray, side: int) -> np.ndarray:
    pick = lambda n: np.minimum(np.floor((np.arange(side) + 0.5) * n / side).astype(int), n - 1)
    return mask[np.ix_(pick(mask.shape[0]), pick(mask.shape[1]))]


def lbp_histogram(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """10 bins of uniform patterns of 8 bilinear neighbours at radius 1, over the mask."""
    padded = np.pad(image, 1)
    h, w = image.shape
    signs = []
    for k in range(8):
        dr, dc = np.round(-np.sin(2 * np.pi * k / 8), 5), np.round(np.cos(2 * np.pi * k / 8), 5)
        r0, c0 = int(np.floor(dr)), int(np.floor(dc))
        fr, fc = dr - r0, dc - c0
        grid = lambda a, b: padded[1 + a : 1 + a + h, 1 + b : 1 + b + w] if -1 <= a <= 1 and -1 <= b <= 1 else 0.0
        value = (1 - fr) * (1 - fc) * grid(r0, c0) + (1 - fr) * fc * grid(r0, c0 + 1) + fr * (1 - fc) * grid(r0 + 1, c0) + fr * fc * grid(r0 + 1, c0 + 1)
        signs.append(value - image >= 0)
    bits = np.stack(signs)
    turns = (bits != np.roll(bits, 1, axis=0)).sum(axis=0)
    code = np.where(turns <= 2, bits.sum(axis=0), 9)[mask > 0]
    return np.bincount(code, minlength=10)[:10] / max(1, len(code))


def _analysis(x: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """One level along an axis with half-point symmetric edges: low and high band."""
    x = np.moveaxis(x, axis, -1)
    n, taps = x.shape[-1], len(DB2)
    padded = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(taps - 1, taps - 1)], mode="symmetric") if n >= taps - 1 else np.pad(x, [(0, 0)] * (x.ndim - 1) + [(taps - 1, taps - 1)], mode="edge")
    high = DB2[::-1] * np.array([-1, 1, -1, 1])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps, axis=-1)[..., 1::2, :]
    return tuple(np.moveaxis(windows @ f[::-1], -1, axis) for f in (DB2[::-1], high))


def wavelet_bands(image: np.ndarray) -> dict[str, np.ndarray]:
    out = {}
    current = image
    for level in (1, 2):
        low, high = _analysis(current, 0)
        ll, lh_ = _analysis(low, 1)
        hl_, hh = _analysis(high, 1)
        out |= {f"l{level}_lh": hl_, f"l{level}_hl": lh_, f"l{level}_hh": hh}
        current = ll
    return out | {"l2_ll": current}


def entropy(values: np.ndarray) -> float:
    x = values.ravel()
    if not len(x) or x.max() - x.min() < 1e-9:
        return 0.0
    p = np.histogram(x, bins=ENTROPY_BINS)[0] / len(x)
    p = p[p > 0]
    return float(-(p * np.log(p)).sum())


def wavelet_features(image: np.ndarray) -> dict[str, float]:
    out = {}
    for band, c in sorted(wavelet_bands(image).items()):
        out |= {f"wavelet_{band}_mean": c.mean(), f"wavelet_{band}_std": c.std(), f"wavelet_{band}_energy": (c**2).mean(), f"wavelet_{band}_entropy": entropy(c)}
    return out


def gabor_kernel(frequency: float, theta: float, n_stds: int = 3) -> np.ndarray:
    """Complex kernel of bandwidth 1 octave."""
    sigma = np.sqrt(np.log(2) / 2) * 3 / (np.pi * frequency)
    reach = int(np.ceil(max(abs(n_stds * sigma * np.cos(theta)), abs(n_stds * sigma * np.sin(theta)), 1)))
    y, x = np.mgrid[-reach : reach + 1, -reach : reach + 1]
    u, v = x * np.cos(theta) + y * np.sin(theta), -x * np.sin(theta) + y * np.cos(theta)
    return np.exp(-0.5 * (u**2 + v**2) / sigma**2) / (2 * np.pi * sigma**2) * np.exp(2j * np.pi * frequency * u)


@lru_cache(maxsize=256)
def _gabor_transform(frequency: float, angle: float, height: int, width: int) -> tuple[int, np.ndarray]:
    """Reach of a kernel, and its Fourier transform over a padded image of the given shape."""
    k = gabor_kernel(frequency, np.deg2rad(angle))
    reach = k.shape[0] // 2
    return reach, np.fft.fft2(k, (height + 2 * reach, width + 2 * reach))


def gabor_stacked(images: np.ndarray, frequencies=(0.1, 0.2, 0.3), angles=(0, 45, 90, 135)) -> dict[str, np.ndarray]:
    """The features of a stack of images of one shape, an array by name."""
    out, at, padded = {}, (1, 2), {}
    for f in frequencies:
        for a in angles:
            reach, kernel = _gabor_transform(f, a, *images.shape[1:])
            if reach not in padded:
                padded[reach] = np.fft.fft2(np.pad(images, ((0, 0), (reach, reach), (reach, reach)), mode="symmetric"))
            # convolution by Fourier transforms; what lies within the padding isn't wrapped round
            response = np.fft.ifft2(padded[reach] * kernel)[:, 2 * reach :, 2 * reach :]
            m, real = np.abs(response), response.real
            name = f"gabor_f{round(f * 100):03d}_o{a:03d}"
            out |= {f"{name}_real_mean": real.mean(at), f"{name}_real_std": real.std(at), f"{name}_magnitude_mean": m.mean(at), f"{name}_magnitude_std": m.std(at), f"{name}_magnitude_energy": (m**2).mean(at)}
    return out


def gabor_features(image: np.ndarray, frequencies=(0.1, 0.2, 0.3), angles=(0, 45, 90, 135)) -> dict[str, float]:
    return {n: x[0] for n, x in gabor_stacked(np.asarray(image, float)[None], frequencies, angles).items()}


def augmented(image: np.ndarray, flip: bool, degrees: float, shift_x: float, shift_y: float, scale: float, brightness: float, contrast: float) -> np.ndarray:
    """Flip, then affine (bilinear, zero fill), then brightness, contrast and clip."""
    if flip:
        image = image[:, ::-1]
    h, w = image.shape
    cy, cx = (h - 1) / 2, (w - 1) / 2
    y, x = np.mgrid[0:h, 0:w].astype(float)
    y, x = y - cy - shift_y * h, x - cx - shift_x * w
    t = np.deg2rad(degrees)
    sx, sy = (np.cos(t) * x + np.sin(t) * y) / scale + cx, (-np.sin(t) * x + np.cos(t) * y) / scale + cy
    padded = np.pad(image, 1)
    sx, sy = np.clip(sx + 1, 0, w + 1 - 1e-9), np.clip(sy + 1, 0, h + 1 - 1e-9)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0
    out = (1 - fy) * ((1 - fx) * padded[y0, x0] + fx * padded[y0, x0 + 1]) + fy * ((1 - fx) * padded[y0 + 1, x0] + fx * padded[y0 + 1, x0 + 1])
    out = np.clip(out * brightness, 0, 1)
    return np.clip(out.mean() + (out - out.mean()) * contrast, 0, 1)


def per_sample(rows: DataFrame, names: list[str], f, arrays: tuple[str, ...], extra: tuple[str, ...] = ()) -> DataFrame:
    """sample_id, extra keys and the named doubles that ``f`` makes of a sample's 2-D arrays."""
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                shape = (int(row.height), int(row.width))
                values = f(*[np.asarray(getattr(row, a), float).reshape(shape) for a in arrays], **{e: getattr(row, e) for e in extra if e != "epoch"})
                out.append([row.sample_id, *[getattr(row, e) for e in extra if e == "epoch"], *[float(values[n]) for n in names]])
            yield pd.DataFrame(out, columns=["sample_id", *[e for e in extra if e == "epoch"], *names])

    keys = "sample_id long" + ", epoch int" * ("epoch" in extra)
    return rows.select("sample_id", "height", "width", *arrays, *extra).mapInPandas(run, keys + "".join(f", {n} double" for n in names))


def per_stack(rows: DataFrame, names: list[str], f, array: str, pixels: int = 1 << 17) -> DataFrame:
    """sample_id and the named doubles that ``f`` makes of stacks of 2-D arrays of one shape, of about
    ``pixels`` in all."""
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            for (h, w), own in batch.groupby(["height", "width"], sort=False):
                step = max(1, pixels // max(1, h * w))
                for a in range(0, len(own), step):
                    part = own.iloc[a : a + step]
                    values = f(np.stack([np.asarray(x, float) for x in part[array]]).reshape(len(part), h, w))
                    yield pd.DataFrame({"sample_id": part["sample_id"].to_numpy()} | {n: values[n] for n in names})

    return rows.select("sample_id", "height", "width", array).mapInPandas(run, "sample_id long" + "".join(f", {n} double" for n in names))


def resized(rows: DataFrame, side: int, antialias: bool, image: str = "image_normalized", mask: str = "tumor_mask") -> DataFrame:
    """sample_id, image, mask, masked (row-major, side * side) of every sample."""
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                shape = (int(row.height), int(row.width))
                x = resize(np.asarray(getattr(row, image), float).reshape(shape), side, antialias)
                m = resize_mask(np.asarray(getattr(row, mask)).reshape(shape), side)
                out.append([row.sample_id, x.ravel().astype(np.float32), m.ravel().astype(np.int8), (x * m).ravel().astype(np.float32)])
            yield pd.DataFrame(out, columns=["sample_id", "image", "mask", "masked"])

    return rows.select("sample_id", "height", "width", image, mask).mapInPandas(run, "sample_id long, image array<float>, mask array<tinyint>, masked array<float>")
