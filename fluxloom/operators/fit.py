"""Nonlinear fits of small groups: shapes, positions and the model tree. One group (a blob) is one kernel call."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FREE_PARAMETERS, RADIUS_ARCSEC, SERSIC_N
from ..functions.cut import cut
from ..functions.small import small
from .components import roots
from .detect import wing_window
from .render import template
from .solve import solve_component


@dataclass(frozen=True)
class Source:
    """A model in pixels: re_pix, ab, pa as the profile wants them."""

    id: int
    x: float
    y: float
    model: str = "PointSource"
    re: float = 0.0
    ab: float = 1.0
    pa: float = 0.0
    n: float = 1.0
    frac: float = 0.5
    flux: float = 1.0

    def plane(self, shape: tuple[int, int], psf: np.ndarray) -> np.ndarray:
        """The unit-flux template on the image."""
        x0, y0, stamp = template(self.model, self.x, self.y, psf, self.re or None, self.ab, self.pa, self.n, self.frac)
        out = np.zeros(shape)
        h, w = stamp.shape
        a, b = max(0, -y0), max(0, -x0)
        c, d = min(h, shape[0] - y0), min(w, shape[1] - x0)
        if a < c and b < d:
            out[y0 + a : y0 + c, x0 + b : x0 + d] = stamp[a:c, b:d]
        return out


#: Free shape parameters of each model besides flux.
SHAPE = {"PointSource": (), "SimpleGalaxy": (), "ExpGalaxy": ("re", "ab", "pa"), "DevGalaxy": ("re", "ab", "pa"), "CompositeGalaxy": ("re", "ab", "pa", "frac"), "SersicGalaxy": ("re", "ab", "pa", "n")}
STEP = {"re": 0.05, "ab": 0.02, "pa": 2.0, "n": 0.05, "frac": 0.05, "x": 0.05, "y": 0.05}


def limits(scale: float, re_cap: float = RADIUS_ARCSEC[1]) -> dict[str, tuple[float, float]]:
    return {"re": (RADIUS_ARCSEC[0] / scale, re_cap / scale), "ab": (0.05, 1.0), "pa": (-1e9, 1e9), "n": SERSIC_N, "frac": (0.0, 1.0)}


def flux_solve(data: np.ndarray, weight: np.ndarray, planes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fluxes, their information, and the residual."""
    ok = weight.ravel() > 0
    a = np.array([p.ravel()[ok] for p in planes]).T
    w = weight.ravel()[ok]
    n = a.T @ (a * w[:, None])
    f = solve_component(n, a.T @ (w * data.ravel()[ok]))[0]
    return f, np.diag(n), data - sum((k * p for k, p in zip(f, planes, strict=True)), np.zeros_like(data))


def fit(data: np.ndarray, weight: np.ndarray, sources: list[Source], psf: np.ndarray, free: dict[int, tuple[str, ...]], bounds: dict[str, tuple[float, float]], steps: int = 50, stop: float = 1e-3, shift: float | None = None) -> tuple[list[Source], float]:
    """Levenberg-Marquardt over the free parameters with bounds; fluxes are solved linearly at every step. Returns sources with fluxes, and chi2. shift bounds x and y to a circle about the start."""
    start = {s.id: (s.x, s.y) for s in sources}

    def solved(src):
        planes = [s.plane(data.shape, psf) for s in src]
        f, _, r = flux_solve(data, weight, planes)
        return [replace(s, flux=float(k)) for s, k in zip(src, f, strict=True)], planes, r, float((r * r * weight).sum())

    def moved(src, delta):
        out, k = [], 0
        for s in src:
            new = {}
            for p in free.get(s.id, ()):
                v = getattr(s, p) + delta[k]
                lo, hi = bounds.get(p, (-math.inf, math.inf))
                new[p] = float(min(max(v, lo), hi))
                k += 1
            if shift and ("x" in new or "y" in new):
                x0, y0 = start[s.id]
                dx, dy = new.get("x", s.x) - x0, new.get("y", s.y) - y0
                if (d := math.hypot(dx, dy)) > shift:
                    new |= {"x": x0 + dx * shift / d, "y": y0 + dy * shift / d}
            out.append(replace(s, **new))
        return out

    src, planes, r, chi2 = solved(sources)
    names = [(i, p) for i, s in enumerate(src) for p in free.get(s.id, ())]
    damp = 1e-2
    for _ in range(steps if names else 0):
        sw = np.sqrt(weight.ravel())
        cols = []
        for i, p in names:
            h = STEP[p] if p not in ("re",) else STEP[p] * max(getattr(src[i], p), 0.5)
            lo, hi = bounds.get(p, (-math.inf, math.inf))
            h = -h if getattr(src[i], p) + h > hi else h
            cols.append(src[i].flux * (replace(src[i], **{p: getattr(src[i], p) + h}).plane(data.shape, psf) - planes[i]) / h)
        j = np.array([c.ravel() * sw for c in cols + planes]).T
        g, m = j.T @ (r.ravel() * sw), j.T @ j
        better = False
        for _ in range(8):
            diag = np.diag(m) * damp
            diag[len(names) :] = 0
            step = np.linalg.lstsq(m + np.diag(diag + 1e-12 * max(np.diag(m).max(), 1e-300)), g, rcond=None)[0]
            new, new_planes, new_r, new_chi2 = solved(moved(src, step[: len(names)]))
            if new_chi2 < chi2:
                better, gain = True, (chi2 - new_chi2) / 2
                src, planes, r, chi2, damp = new, new_planes, new_r, new_chi2, max(damp / 5, 1e-8)
                break
            damp *= 5
        if not better or gain < stop:
            break
    return src, chi2


def reduced(data: np.ndarray, weight: np.ndarray, sources: list[Source], psf: np.ndarray, segment: np.ndarray, k: int) -> float:
    r = data - sum((s.flux * s.plane(data.shape, psf) for s in sources), np.zeros_like(data))
    use = segment & (weight > 0)
    return float((r[use] ** 2 * weight[use]).sum() / max(use.sum() - k, 1))


def tree(data: np.ndarray, weight: np.ndarray, members: list[Source], segments: dict[int, np.ndarray], psf: np.ndarray, scale: float, limit: float = 1.5, point_gain: float = 0.05, tie: float = 0.15, simple_re: float = 0.30, full_ladder_snr: float = 0.0, max_shift: float | None = None, wings: bool = False) -> tuple[list[Source], list[tuple]]:
    """The chi2 tree of one blob: (fitted members, trials as (id, stage, model, rchi2)).

    Stages: simple galaxies, points (and the point lock), exponentials, de
    Vaucouleurs, composites; then a joint refit, the guarded Sersic tier and a last
    flux-only solve. Positions stay fixed; with max_shift (pixels) the joint refit frees
    them, and what moves farther goes back. Members that are settled keep their model in
    later stages. With wings, members of the full ladder are scored on their segment grown by
    twice its radius.
    """
    b = limits(scale)
    snr = {}
    for s in members:
        use = segments[s.id] & (weight > 0)
        snr[s.id] = float(data[use].sum() / math.sqrt((1 / weight[use]).sum())) if use.any() else 0.0
    seen = {i: wing_window(g) if wings and snr[i] >= full_ladder_snr else g for i, g in segments.items()}
    chi: dict[int, dict[str, float]] = {s.id: {} for s in members}
    best: dict[int, dict[str, Source]] = {s.id: {} for s in members}
    settled: dict[int, Source] = {}
    trials: list[tuple] = []

    def stage(number: int, model: str):
        src = []
        for s in members:
            if s.id in settled:
                src.append(settled[s.id])
                continue
            seed = best[s.id].get("ExpGalaxy", s)
            re = simple_re / scale if model == "SimpleGalaxy" else 0.0 if model == "PointSource" else max(seed.re, b["re"][0])
            src.append(replace(seed, model=model, re=re, ab=1.0 if model in ("SimpleGalaxy", "PointSource") else seed.ab))
        out, _ = fit(data, weight, src, psf, {s.id: SHAPE[s.model] for s in src if s.id not in settled}, b)
        for s in out:
            if s.id in settled:
                settled[s.id] = s
                continue
            c = reduced(data, weight, out, psf, seen[s.id], FREE_PARAMETERS[model])
            chi[s.id][model], best[s.id][model] = c, s
            trials.append((s.id, number, model, c))

    stage(1, "SimpleGalaxy")
    stage(2, "PointSource")
    for s in members:
        p, g = chi[s.id]["PointSource"], chi[s.id]["SimpleGalaxy"]
        if p <= g + point_gain and p <= limit:
            settled[s.id] = best[s.id]["PointSource"]
        elif g <= limit and snr[s.id] < full_ladder_snr:
            settled[s.id] = best[s.id]["SimpleGalaxy"]
    for number, model in ((3, "ExpGalaxy"), (4, "DevGalaxy")):
        if len(settled) < len(members):
            stage(number, model)
    for s in members:
        if s.id in settled or snr[s.id] >= full_ladder_snr:
            continue
        g, e, d = (chi[s.id][m] for m in ("SimpleGalaxy", "ExpGalaxy", "DevGalaxy"))
        if not (e > limit and d > limit):
            if g <= min(e, d) and g <= limit:
                settled[s.id] = best[s.id]["SimpleGalaxy"]
            elif abs(e - d) >= tie and min(e, d) <= limit:
                settled[s.id] = best[s.id]["ExpGalaxy" if e <= d else "DevGalaxy"]
    if len(settled) < len(members):
        stage(5, "CompositeGalaxy")
    order = ("PointSource", "SimpleGalaxy", "ExpGalaxy", "DevGalaxy", "CompositeGalaxy")
    for s in members:
        if s.id not in settled:
            c = chi[s.id]
            pick = min(order, key=lambda m: (c.get(m, math.inf), order.index(m)))  # noqa: B023
            if snr[s.id] < full_ladder_snr:
                pick = next((m for m in ("ExpGalaxy", "DevGalaxy") if c[m] <= c["CompositeGalaxy"] and c[m] <= limit), "CompositeGalaxy" if c["CompositeGalaxy"] <= limit else pick)
            settled[s.id] = best[s.id][pick]
    place = ("x", "y") if max_shift is not None else ()
    src, _ = fit(data, weight, [settled[s.id] for s in members], psf, {i: (*SHAPE[s.model], *place) for i, s in settled.items()}, b)
    if max_shift is not None:
        src = clamped(data, weight, src, {s.id: s for s in members}, psf, max_shift)
    for k, s in enumerate(src):
        if s.model in ("ExpGalaxy", "DevGalaxy", "CompositeGalaxy") and snr[s.id] >= 20:
            before = fit(data, weight, src, psf, {}, b, 0)[1]
            tries = [fit(data, weight, [*src[:k], replace(s, model="SersicGalaxy", n=n), *src[k + 1 :]], psf, {s.id: SHAPE["SersicGalaxy"]}, b) for n in (1.0, 4.0)]
            new, after = min(tries, key=lambda t: t[1])
            trials.append((s.id, 6, "SersicGalaxy", after))
            if before - after > 25:
                src = new
    return fit(data, weight, src, psf, {}, b, 0)[0], trials


def clamped(data: np.ndarray, weight: np.ndarray, sources: list[Source], prior: dict[int, Source], psf: np.ndarray, max_shift: float) -> list[Source]:
    """Sources that lie more than max_shift pixels from their prior place go back to it, shapes kept; then all fluxes are solved again, if any went."""
    out = [replace(s, x=prior[s.id].x, y=prior[s.id].y) if math.hypot(s.x - prior[s.id].x, s.y - prior[s.id].y) > max_shift else s for s in sources]
    return fit(data, weight, out, psf, {}, {}, 0)[0] if out != sources else out


def select_models(members: DataFrame, pixels: DataFrame, psf: np.ndarray, scale: float, margin: int = 20, **settings) -> DataFrame:
    """The tree over all blobs: (id, blob, model, re, ab, pa, n, frac, flux, trials) in pixels.

    members: tile, blob, id, x, y, re, segment; pixels: tile, blob, x, y, d, w,
    segment (its blob's pixels and the margin around). The PSF stamp is of fixed
    size. Each blob is a group of its own, hashed over all tasks.
    """
    out = "id long, tile long, blob long, model string, re double, ab double, pa double, n double, frac double, flux double, trials array<struct<stage:int,model:string,rchi2:double>>"

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[c.split()[0] for c in out.split(", ", 9)])
        x0, y0 = int(right.x.min()), int(right.y.min())
        shape = (int(right.y.max()) - y0 + 1, int(right.x.max()) - x0 + 1)
        d, w, seg = np.zeros(shape), np.zeros(shape), np.zeros(shape, int)
        at = (right.y.to_numpy() - y0, right.x.to_numpy() - x0)
        d[at], w[at], seg[at] = right.d, right.w, right.segment
        src = [Source(int(r.id), r.x - x0, r.y - y0, re=float(r.re) if r.re == r.re and r.re else 1.0) for r in left.sort_values("id").itertuples()]
        own = {int(r.id): seg == r.segment if r.segment and (seg == r.segment).any() else np.ones(shape, bool) for r in left.itertuples()}
        got, trials = tree(d, w, src, own, psf, scale, **settings)
        rows = [(s.id, int(key[0]), int(key[1]), s.model, s.re, s.ab, s.pa, s.n, s.frac, s.flux, [(st, m, c) for i, st, m, c in trials if i == s.id]) for s in got]
        return pd.DataFrame(rows, columns=["id", "tile", "blob", "model", "re", "ab", "pa", "n", "frac", "flux", "trials"])

    pixels = pixels.toDF(*pixels.columns)  # both sides may come from one table
    return members.groupBy("tile", "blob").cogroup(pixels.groupBy("tile", "blob")).applyInPandas(run, out)


def interior(x, y, width: int, height: int):
    """Strictly inside the margin min(50, max(1, least side // 4)): only such sources get free shapes or positions."""
    m = min(50, max(1, min(width, height) // 4))
    return (x > m) & (x < width - m) & (y > m) & (y < height - m)


def boxes(sources: DataFrame, images: DataFrame, psf: np.ndarray, grow: float) -> DataFrame:
    """sources (tile, id, x, y, re, ...) that reach their image, with lx, ly, hx, hy: where their template may be (grown by a factor of the radius, or by pixels for points), half open, within the image (tile, height, width)."""
    reach = max(psf.shape) // 2 + 2
    half = reach + F.when(F.coalesce("re", F.lit(0.0)) > 0, F.greatest(F.lit(16), F.ceil(2 * F.col("re") * max(grow, 1.0)))).otherwise(math.ceil(grow))
    s = sources.join(small(images), "tile").withColumn("_half", half)
    low = lambda c: F.greatest(F.floor(F.col(c) - F.col("_half")), F.lit(0)).cast("int")
    high = lambda c, n: F.least(F.ceil(F.col(c) + F.col("_half")) + 1, F.col(n)).cast("int")
    return s.withColumns({"lx": low("x"), "ly": low("y"), "hx": high("x", "width"), "hy": high("y", "height")}).drop("_half").where("lx < hx and ly < hy")


def in_cells(b: DataFrame, size: int) -> DataFrame:
    """b (lx, ly, hx, hy) once for each cell of the size that its box touches."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size).cast("int"), F.floor((F.col(hi) - 1) / size).cast("int"))
    return b.withColumn("_ci", F.explode(span("lx", "hx"))).withColumn("_cj", F.explode(span("ly", "hy")))


def grouped(b: DataFrame, size: int = 64) -> DataFrame:
    """b (tile, id, box) with group, the least id of the sources that it is tied to by boxes that meet. Boxes meet in cells; links are joined up in tables."""
    c = in_cells(b.select("tile", "id", "lx", "ly", "hx", "hy"), size)
    other = c.select("tile", "_ci", "_cj", F.col("id").alias("b"), F.col("lx").alias("mx"), F.col("ly").alias("my"), F.col("hx").alias("nx"), F.col("hy").alias("ny"))
    meet = c.join(other, ["tile", "_ci", "_cj"]).where("id < b and lx < nx and mx < hx and ly < ny and my < hy")
    tied = roots(meet.select("tile", F.col("id").alias("a"), "b").distinct(), ["tile"])
    return b.join(tied, ["tile", "id"], "left").withColumn("group", F.coalesce("root", "id")).drop("root")


def refit(sources: DataFrame, pixels: DataFrame, psf: np.ndarray, scale: float, what: str, flux_floor: float = 10.0, max_shift_arcsec: float = 0.2, steps: int = 30) -> DataFrame:
    """Free "shapes" or "positions" of an image's interior sources (tile, id, x, y, model, re, ab, pa, n, flux), joint with all fluxes.

    Radii that run to a bound go back to their start, and so do positions that move
    too far; positions are freed for sources over the flux floor. Sources whose boxes
    meet are one group; a group is sent the pixels under its boxes alone, and groups are
    dealt over all tasks, so none holds an image. Sources off the image have no row.
    """
    cols = ["tile", "id", "x", "y", "model", "re", "ab", "pa", "n", "flux", "moved"]
    kind = dict(sources.dtypes)["tile"]
    grow = 1 + max_shift_arcsec / scale if what == "positions" else 3.0
    images = cut(pixels.groupBy("tile").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width")))
    placed = sources.select("tile", "id", "x", "y", "model", *[F.col(c).cast("double").alias(c) for c in ("re", "ab", "pa", "n", "flux")])
    b = cut(grouped(cut(boxes(placed, images, psf, grow))))
    size = 64
    under = in_cells(b.select("tile", "group", "lx", "ly", "hx", "hy"), size)
    near = pixels.select("tile", "x", "y", "d", "w").withColumns({"_ci": F.floor(F.col("x") / size).cast("int"), "_cj": F.floor(F.col("y") / size).cast("int")}).join(under, ["tile", "_ci", "_cj"])
    mine = near.where("x >= lx and x < hx and y >= ly and y < hy").select("tile", "group", "x", "y", "d", "w").dropDuplicates(["tile", "group", "x", "y"])

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=cols)
        x0, y0 = int(right.x.min()), int(right.y.min())
        d = np.zeros((int(right.y.max()) - y0 + 1, int(right.x.max()) - x0 + 1))
        wt = np.zeros_like(d)
        d[right.y - y0, right.x - x0], wt[right.y - y0, right.x - x0] = right.d, right.w
        num = lambda v, z: z if v is None or v != v else float(v)
        here = [Source(int(r.id), r.x - x0, r.y - y0, r.model, num(r.re, 0.0), num(r.ab, 1.0), num(r.pa, 0.0), num(r.n, 1.0), flux=num(r.flux, 1.0)) for r in left.sort_values("id").itertuples()]
        b, w, h = limits(scale), int(left.width.iloc[0]), int(left.height.iloc[0])
        inside = {s.id for s in here if interior(s.x + x0, s.y + y0, w, h)}
        free = {s.id: SHAPE[s.model] for s in here if s.id in inside} if what == "shapes" else {s.id: ("x", "y") for s in here if s.id in inside and s.flux > flux_floor}
        out, _ = fit(d, wt, here, psf, free, b, steps, stop=0.1 if what == "shapes" else 1e-3)
        old = {s.id: s for s in here}
        railed = lambda s: s.id in free and s.re and (s.re <= b["re"][0] * 1.001 or s.re >= b["re"][1] * 0.999)
        far = lambda s: math.hypot(s.x - old[s.id].x, s.y - old[s.id].y) * scale > max_shift_arcsec
        back = {s.id for s in out if (what == "shapes" and railed(s)) or (what == "positions" and far(s))}
        out, _ = fit(d, wt, [old[s.id] if s.id in back else s for s in out], psf, {}, b, 0)
        rows = [(key[0], s.id, s.x + x0, s.y + y0, s.model, s.re, s.ab, s.pa, s.n, s.flux, s.id in free and s.id not in back) for s in out]
        return pd.DataFrame(rows, columns=cols)

    return b.groupBy("tile", "group").cogroup(mine.toDF(*mine.columns).groupBy("tile", "group")).applyInPandas(run, f"tile {kind}, id long, x double, y double, model string, re double, ab double, pa double, n double, flux double, moved boolean")


def bounded_positions(data: np.ndarray, weight: np.ndarray, sources: list[Source], psf: np.ndarray, shift_pix: float) -> list[Source]:
    """Positions free within a circle about their start, jointly with fluxes."""
    return fit(data, weight, sources, psf, {s.id: ("x", "y") for s in sources}, {}, 30, shift=shift_pix)[0]
