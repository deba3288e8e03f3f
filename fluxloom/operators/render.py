"""Templates: profiles through the PSF. numpy kernels on small stamps, and point templates as expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gaussian_psf(fwhm_pix: float) -> np.ndarray:
    """A unit-sum Gaussian stamp of radius max(4, ceil(5 sigma))."""
    if not fwhm_pix > 0:
        raise ValueError("the PSF needs a positive width")
    s = fwhm_pix / (2 * math.sqrt(2 * math.log(2)))
    r = max(4, math.ceil(5 * s))
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    g = np.exp(-(x * x + y * y) / (2 * s * s))
    return g / g.sum()


def normalized(stamp: np.ndarray) -> np.ndarray:
    total = float(np.nansum(stamp))
    if not (np.isfinite(total) and total > 0):
        raise ValueError("the PSF has no positive sum")
    return np.nan_to_num(stamp) / total


def resized(stamp: np.ndarray, size: int) -> np.ndarray:
    """Cropped or padded about its centre to an odd size."""
    size += 1 - size % 2
    out, h = np.zeros((size, size)), stamp.shape
    n = [min(size, k) for k in h]
    o, i = [(size - k) // 2 for k in n], [(k - m) // 2 for k, m in zip(h, n, strict=True)]
    out[o[0] : o[0] + n[0], o[1] : o[1] + n[1]] = stamp[i[0] : i[0] + n[0], i[1] : i[1] + n[1]]
    return out


def shifted(stamp: np.ndarray, dx: float, dy: float) -> np.ndarray:
    """The stamp moved by a fraction of a pixel through its Fourier phases; total flux stays."""
    fy, fx = np.fft.fftfreq(stamp.shape[0])[:, None], np.fft.fftfreq(stamp.shape[1])[None, :]
    return np.fft.ifft2(np.fft.fft2(stamp) * np.exp(-2j * np.pi * (fx * dx + fy * dy))).real


def centroid(stamp: np.ndarray) -> tuple[float, float]:
    y, x = np.mgrid[: stamp.shape[0], : stamp.shape[1]]
    return float((stamp * x).sum() / stamp.sum()), float((stamp * y).sum() / stamp.sum())


def recentred(stamp: np.ndarray) -> np.ndarray:
    cx, cy = centroid(stamp)
    return shifted(stamp, (stamp.shape[1] - 1) / 2 - cx, (stamp.shape[0] - 1) / 2 - cy)


def core_radius(shape: tuple[int, int]) -> float:
    """Where a stamp's core ends: ten pixels, or a third of the shorter side."""
    return min(10.0, min(shape) / 3)


def core_fwhm(stamp: np.ndarray, radius: float | None = None) -> float:
    """Width of the Gaussian with the core's second moment about the stamp's centre; NaN without light there."""
    cy, cx = ((k - 1) / 2 for k in stamp.shape)
    y, x = np.mgrid[: stamp.shape[0], : stamp.shape[1]]
    r2 = (x - cx) ** 2 + (y - cy) ** 2
    w = np.where(r2 <= (radius or core_radius(stamp.shape)) ** 2, np.clip(stamp, 0, None), 0)
    return float(2 * math.sqrt(2 * math.log(2)) * math.sqrt((w * r2).sum() / w.sum() / 2)) if w.sum() > 0 else math.nan


def sersic_b(n: float) -> float:
    """The constant that makes re the half-light radius (Ciotti & Bertin 1999)."""
    return 2 * n - 1 / 3 + 4 / (405 * n) + 46 / (25515 * n * n) + 131 / (1148175 * n**3) if n > 0.36 else 0.01945 - 0.8902 * n + 10.95 * n * n - 19.67 * n**3 + 13.43 * n**4


def profile(re_pix: float, ab: float, pa_deg: float, n: float, half: int, over: int = 5) -> np.ndarray:
    """A unit-flux Sersic profile integrated over pixels by oversampling, finer at the centre. pa is from y towards -x."""
    k = 2 * half + 1
    fine = over if re_pix > 2 else over * 3
    c = (np.arange(k * fine) + 0.5) / fine - 0.5 - half
    x, y = np.meshgrid(c, c)
    t = math.radians(pa_deg)
    major, minor = -x * math.sin(t) + y * math.cos(t), x * math.cos(t) + y * math.sin(t)
    r = np.hypot(major, minor / ab) / re_pix
    f = np.exp(-sersic_b(n) * (np.maximum(r, 0.2 / fine / re_pix) ** (1 / n) - 1))
    total = 2 * math.pi * n * ab * re_pix**2 * math.exp(sersic_b(n)) * sersic_b(n) ** (-2 * n) * math.gamma(2 * n)
    return f.reshape(k, fine, k, fine).mean(axis=(1, 3)) / total


def convolved(image: np.ndarray, psf: np.ndarray) -> np.ndarray:
    shape = tuple(a + b - 1 for a, b in zip(image.shape, psf.shape, strict=True))
    full = np.fft.irfft2(np.fft.rfft2(image, shape) * np.fft.rfft2(psf, shape), shape)
    oy, ox = ((b - 1) // 2 for b in psf.shape)
    return full[oy : oy + image.shape[0], ox : ox + image.shape[1]]


#: Radius and index of each model's parts: (weight column or share, index).
PARTS = {"ExpGalaxy": 1.0, "SimpleGalaxy": 1.0, "DevGalaxy": 4.0}


def template(model: str, x: float, y: float, psf: np.ndarray, re_pix: float | None = None, ab: float = 1.0, pa: float = 0.0, n: float | None = None, frac_dev: float = 0.5, half: int | None = None) -> tuple[int, int, np.ndarray]:
    """(x0, y0, stamp): the source's unit flux through the PSF, the stamp's corner at an integer pixel."""
    ix, iy = int(np.rint(x)), int(np.rint(y))
    if model == "PointSource" or not re_pix:
        size = max(psf.shape) if half is None else 2 * half + 1
        stamp = resized(psf, size)
    else:
        half = half or max(psf.shape) // 2 + max(4, math.ceil(2 * re_pix))
        if model == "CompositeGalaxy":
            image = (1 - frac_dev) * profile(re_pix, ab, pa, 1.0, half) + frac_dev * profile(re_pix, ab, pa, 4.0, half)
        else:
            image = profile(re_pix, ab, pa, PARTS.get(model, n or 1.0), half)
        stamp = convolved(image, psf)
    stamp = shifted(stamp, x - ix, y - iy)
    return ix - stamp.shape[1] // 2, iy - stamp.shape[0] // 2, stamp


def point_templates(sources: DataFrame, sigma_pix: float, half: int, width: int, height: int, cols: tuple = ()) -> DataFrame:
    """(tile, id, x, y, t, and the sources' cols): Gaussian point templates of sources (tile, id, x, y) by expressions alone; unit sum on the full plane."""
    span = lambda c, n: F.sequence(F.greatest(F.rint(c).cast("int") - half, F.lit(0)), F.least(F.rint(c).cast("int") + half, F.lit(n - 1)))
    inside = F.col("x").between(-half, width - 1 + half) & F.col("y").between(-half, height - 1 + half)
    s = sources.where(inside).select("tile", "id", F.col("x").alias("sx"), F.col("y").alias("sy"), *cols)
    p = s.withColumn("x", F.explode(span(F.col("sx"), width))).withColumn("y", F.explode(span(F.col("sy"), height)))
    d2 = (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy"))
    return p.select("tile", "id", "x", "y", (F.exp(-d2 / (2 * sigma_pix**2)) / (2 * math.pi * sigma_pix**2)).alias("t"), *cols)
