"""Background, detection and blobs: numpy kernels for tiles with halos, tables of links for what crosses their borders, joins for what crosses catalogs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..functions.cut import cut
from ..functions.small import small
from .components import roots
from .solve import whole_groups

# -- kernels -----------------------------------------------------------------------------


def valid_for_background(data: np.ndarray, mask: np.ndarray, clip_mad: float | None) -> np.ndarray:
    """Unmasked finite pixels, not over median + clip * MAD (unscaled)."""
    ok = ~mask & np.isfinite(data)
    if clip_mad and ok.any():
        m = np.median(data[ok])
        ok &= data <= m + clip_mad * np.median(np.abs(data[ok] - m))
    return ok


def clipped_mode(v: np.ndarray) -> tuple[float, float]:
    """Level and rms of one mesh: clipped at 3 sigma; 2.5 median - 1.5 mean unless the mesh is crowded."""
    if not len(v):
        return math.nan, math.nan
    before = v.std()
    for _ in range(20):
        m, s = np.median(v), v.std()
        keep = np.abs(v - m) <= 3 * s
        if keep.all() or not keep.any():
            break
        v = v[keep]
    m, mean, s = float(np.median(v)), float(v.mean()), float(v.std())
    if s == 0 or abs(mean - m) < 0.3 * s and s >= 0.8 * before:
        return mean if s and abs(mean - m) < 0.3 * s else m, s
    return 2.5 * m - 1.5 * mean if abs(mean - m) < 0.3 * s else m, s


def background_map(data: np.ndarray, mask: np.ndarray, mesh: int, filter_size: int = 3, clip_mad: float | None = None) -> tuple[np.ndarray, float, float]:
    """Background plane, global level and rms. A plane no larger than one mesh gets a constant. Meshes without pixels take the median of the others."""
    ok = valid_for_background(data, mask, clip_mad)
    if not ok.any():
        raise ValueError("no usable pixel for a background")
    h, w = data.shape
    if max(h, w) <= mesh:
        level, rms = clipped_mode(data[ok])
        return np.full(data.shape, level), level, rms
    ny, nx = math.ceil(h / mesh), math.ceil(w / mesh)
    cells = np.array([[clipped_mode(data[j * mesh : (j + 1) * mesh, i * mesh : (i + 1) * mesh][ok[j * mesh : (j + 1) * mesh, i * mesh : (i + 1) * mesh]]) for i in range(nx)] for j in range(ny)])
    level, rms = np.nanmedian(cells[..., 0]), np.nanmedian(cells[..., 1])
    grid = filtered(cells[..., 0], filter_size)
    return bicubic(grid, (np.arange(h) + 0.5) / mesh - 0.5, (np.arange(w) + 0.5) / mesh - 0.5), float(level), float(rms)


def filtered(levels: np.ndarray, size: int = 3) -> np.ndarray:
    """A grid of mesh levels whose holes have the others' median, smoothed by medians of size x size."""
    grid, k = np.where(np.isnan(levels), np.nanmedian(levels), levels), size // 2
    padded = np.pad(grid, k, mode="reflect" if min(grid.shape) > k else "edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, (size, size)), axis=(2, 3))


def natural_spline(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through y[0], y[1], ... (first axis) at real places, held constant outside."""
    n, at = len(y), np.clip(at, 0, len(y) - 1)
    if n == 1:
        return np.repeat(y, len(at), axis=0)
    m = np.zeros_like(y, float)
    if n > 2:
        a = np.diag(np.full(n - 2, 4.0)) + np.diag(np.ones(n - 3), 1) + np.diag(np.ones(n - 3), -1)
        m[1:-1] = np.linalg.solve(a, 6 * (y[2:] - 2 * y[1:-1] + y[:-2]))
    i = np.minimum(at.astype(int), n - 2)
    t = (at - i).reshape(-1, *[1] * (y.ndim - 1))
    a, b = 1 - t, t
    return a * y[i] + b * y[i + 1] + ((a**3 - a) * m[i] + (b**3 - b) * m[i + 1]) / 6


def bicubic(grid: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    return natural_spline(natural_spline(grid, rows).T, cols).T


def matched(data: np.ndarray, weight: np.ndarray, kernel: np.ndarray, top: float | None = None) -> np.ndarray:
    """S/N plane of a matched filter under pixel-wise noise; 0 where next to no weight is under the kernel. top: the image's largest weight."""
    from .render import convolved

    flip = kernel[::-1, ::-1]
    num, den = convolved(np.where(weight > 0, data, 0) * weight, flip), convolved(weight, flip**2)
    least = 1e-12 * max((weight.max(initial=0) if top is None else top) * (kernel**2).sum(), 1e-300)
    return np.where(den > least, num / np.sqrt(np.maximum(den, 1e-300)), 0.0)


def label(mask: np.ndarray) -> np.ndarray:
    """8-connected regions, numbered from 1 in reading order."""
    h, w = mask.shape
    ids = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        p = np.pad(ids, 1)
        low = ids.copy()
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                n = p[dy : dy + h, dx : dx + w]
                low = np.where(mask & (n > 0) & (n < low), n, low)
        flat = low.ravel()
        low = np.where(mask, flat[np.maximum(flat[np.maximum(low, 1) - 1], 1) - 1], 0).reshape(h, w)  # pointer jumping
        if (low == ids).all():
            break
        ids = low
    _, out = np.unique(ids, return_inverse=True)
    return out.reshape(h, w) + (0 if (ids == 0).any() else 1)


def squared_distance(mask: np.ndarray, most: int) -> np.ndarray:
    """Squared distance of every pixel from the nearest true one; beyond `most` pixels, any larger number. Distances down the columns first, then the lower envelope along the rows."""
    h, w = mask.shape
    far, rows = most + 1, np.arange(h)[:, None]
    last = np.maximum.accumulate(np.where(mask, rows, -far), axis=0)
    following = np.minimum.accumulate(np.where(mask, rows, h + far)[::-1], axis=0)[::-1]
    down = np.minimum(np.minimum(rows - last, following - rows), far).astype(np.int64) ** 2
    out = np.full((h, w), 2 * far * far, np.int64)
    for k in range(-min(most, w - 1), min(most, w - 1) + 1):
        a, b = max(0, k), min(w, w + k)
        np.minimum(out[:, a:b], down[:, a - k : b - k] + k * k, out=out[:, a:b])
    return out


def dilated(mask: np.ndarray, radius: float) -> np.ndarray:
    """Pixels within the radius of a true one."""
    return squared_distance(mask, int(radius)) <= radius * radius


def wing_window(segment: np.ndarray, radius: float | None = None) -> np.ndarray:
    """A segment grown by twice its radius (that of a disc of its area, if none is given): fixed values, 10 to 40 pixels."""
    r = math.sqrt(segment.sum() / math.pi) if radius is None else radius
    return dilated(segment, int(min(max(2 * r, 10), 40)))


def deblended(values: np.ndarray, seg: np.ndarray, levels: int = 32, contrast: float = 0.005, minarea: int = 5) -> np.ndarray:
    """Segments split at exponentially spaced levels: a branch of enough area and share of the segment's flux becomes a segment of its own; the other pixels go to the nearest branch by flux over distance squared."""
    out, nxt = np.zeros_like(seg), 1
    for s in range(1, int(seg.max()) + 1):
        ys, xs = np.nonzero(seg == s)
        y0, x0, y1, x1 = ys.min(), xs.min(), ys.max() + 1, xs.max() + 1
        own = seg[y0:y1, x0:x1] == s
        v = np.where(own, values[y0:y1, x0:x1], 0)
        top, base, total = v.max(), max(v[own].min(), 1e-12), v[own].sum()
        seeds = [own]
        for k in range(1, levels):
            split = []
            for seed in seeds:
                parts = label(seed & (v > base * (top / base) ** (k / levels)))
                branches = [parts == j for j in range(1, int(parts.max()) + 1)]
                good = [b for b in branches if b.sum() >= max(1, minarea // 2) and (v[b] - base).sum() > contrast * total]
                split += good if len(good) > 1 else [seed]
            seeds = split
        if len(seeds) == 1:
            out[y0:y1, x0:x1][own] = nxt
            nxt += 1
            continue
        yy, xx = np.mgrid[: own.shape[0], : own.shape[1]]
        pull = []
        for b in seeds:
            cy, cx = (v * yy)[b].sum() / v[b].sum(), (v * xx)[b].sum() / v[b].sum()
            pull.append(np.where(b, np.inf, v[b].sum() / ((yy - cy) ** 2 + (xx - cx) ** 2 + 1)))
        out[y0:y1, x0:x1][own] = (np.argmax(pull, axis=0) + nxt)[own]
        nxt += len(seeds)
    return out


def detect(data: np.ndarray, weight: np.ndarray, kernel: np.ndarray | None = None, threshold: float = 1.5, minarea: int = 5, dilate_pix: int = 4, mesh: int = 64, contrast: float = 0.005, levels: int = 32) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """(segments, blobs, detections). Blobs are the dilated segments' connected regions."""
    usable = weight > 1e-6 * np.median(weight[weight > 0]) if (weight > 0).any() else weight > 0
    if not usable.any():
        return np.zeros(data.shape, int), np.zeros(data.shape, int), pd.DataFrame(columns=["segment", "x", "y", "flux", "a", "b", "theta", "npix", "blob"])
    sub = np.where(usable, data - background_map(data, ~usable, mesh)[0], 0)
    w = np.where(usable, weight, 0)
    seg = label((matched(sub, w, kernel) if kernel is not None else sub * np.sqrt(w)) > threshold)
    sizes = np.bincount(seg.ravel())
    seg[sizes[seg] < minarea] = 0
    _, seg = np.unique(seg, return_inverse=True)
    seg = seg.reshape(data.shape)
    seg = deblended(np.maximum(sub, 0), seg, levels, contrast, minarea) if contrast < 1 else seg
    blobs = label(dilated(seg > 0, dilate_pix))
    rows = []
    for s in range(1, int(seg.max()) + 1):
        y, x = np.nonzero(seg == s)
        v = np.maximum(sub[y, x], 1e-12)
        cx, cy = (v * x).sum() / v.sum(), (v * y).sum() / v.sum()
        xx, yy, xy = (v * (x - cx) ** 2).sum() / v.sum(), (v * (y - cy) ** 2).sum() / v.sum(), (v * (x - cx) * (y - cy)).sum() / v.sum()
        root = math.hypot((xx - yy) / 2, xy)
        rows.append((s, cx, cy, float(sub[y, x].sum()), math.sqrt(max((xx + yy) / 2 + root, 1 / 12)), math.sqrt(max((xx + yy) / 2 - root, 1 / 12)), math.degrees(0.5 * math.atan2(2 * xy, xx - yy)), len(x), int(blobs[y[0], x[0]])))
    return seg, blobs, pd.DataFrame(rows, columns=["segment", "x", "y", "flux", "a", "b", "theta", "npix", "blob"])


# -- tables ---------------------------------------------------------------------------------

#: Side of the tiles in which an image's pixels are worked on; results do not depend on it.
TILE = 1024
#: A region is named by its first pixel in reading order: its row times this, its column and one.
ROW = 1 << 32
WORK = ["tile", "_ty", "_tx"]


def name_of(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    return y.astype(np.int64) * ROW + x.astype(np.int64) + 1


def dealt(pixels: DataFrame, size: int, halo: int = 0) -> DataFrame:
    """pixels (tile: the image, x, y, ...) with _ty and _tx, sent to every tile of the size whose halo holds them."""
    if not halo:
        return pixels.withColumns({"_ty": F.floor(F.col("y") / size).cast("int"), "_tx": F.floor(F.col("x") / size).cast("int")})
    near = lambda c: F.sequence(F.greatest(F.floor((F.col(c) - halo) / size), F.lit(0)).cast("int"), F.floor((F.col(c) + halo) / size).cast("int"))
    return pixels.withColumn("_ty", F.explode(near("y"))).withColumn("_tx", F.explode(near("x")))


def patch(pdf: pd.DataFrame, *cols: str) -> tuple[int, int, list[np.ndarray]]:
    """Corner and dense planes of a tile's pixel rows; what is missing is 0."""
    y0, x0 = int(pdf.y.min()), int(pdf.x.min())
    shape = (int(pdf.y.max()) - y0 + 1, int(pdf.x.max()) - x0 + 1)
    at, out = (pdf.y.to_numpy() - y0, pdf.x.to_numpy() - x0), []
    for c in cols:
        a = np.zeros(shape)
        a[at] = pdf[c].to_numpy(float)
        out.append(a)
    return y0, x0, out


def extents(pixels: DataFrame) -> DataFrame:
    """(tile, height, width, least, top): the image's size, the weight from which its pixels count, and the largest weight. One row an image."""
    size = pixels.groupBy("tile").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.max("w").cast("double").alias("top"))
    middle = stats.medians(pixels.where("w > 0"), F.col("w"), ["tile"], "_m").select("tile", (1e-6 * F.col("_m")).alias("least"))
    return size.join(middle, "tile", "left").select("tile", "height", "width", F.coalesce("least", F.lit(0.0)).alias("least"), "top")


def background_grids(usable: DataFrame, images: DataFrame, mesh: int, filter_size: int = 3) -> DataFrame:
    """(tile, ny, nx, grid, level, rms) of each image with usable pixels (tile, x, y, d): its meshes' levels, each from the pixels of one mesh, filtered. A task holds one mesh's pixels, or one number a mesh."""
    kind = dict(usable.dtypes)["tile"]

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        level, rms = clipped_mode(pdf.d.to_numpy(float))
        return pd.DataFrame({"tile": [pdf.tile.iloc[0]], "j": [pdf.j.iloc[0]], "i": [pdf.i.iloc[0]], "v": [level], "s": [rms]})

    at = usable.select("tile", F.floor(F.col("y") / mesh).alias("j"), F.floor(F.col("x") / mesh).alias("i"), "d")
    cells = at.groupBy("tile", "j", "i").applyInPandas(cell, f"tile {kind}, j long, i long, v double, s double").join(small(images.select("tile", F.ceil(F.col("height") / mesh).alias("ny"), F.ceil(F.col("width") / mesh).alias("nx"))), "tile")

    def grid(pdf: pd.DataFrame) -> pd.DataFrame:
        ny, nx = int(pdf.ny.iloc[0]), int(pdf.nx.iloc[0])
        v, s = np.full((ny, nx), np.nan), np.full((ny, nx), np.nan)
        v[pdf.j, pdf.i], s[pdf.j, pdf.i] = pdf.v, pdf.s
        out = filtered(v, filter_size)
        return pd.DataFrame({"tile": [pdf.tile.iloc[0]], "ny": [ny], "nx": [nx], "grid": [out.ravel().tolist()], "level": [np.nanmedian(v)], "rms": [np.nanmedian(s)]})

    return cells.groupBy("tile").applyInPandas(grid, f"tile {kind}, ny int, nx int, grid array<double>, level double, rms double")


def with_grid(work: DataFrame, grids: DataFrame):
    """The tiles of work, each grouped with its image's grid."""
    widest = grids.agg(F.max(F.col("ny") * F.col("nx"))).head()[0] or 1
    tiles = work.select(*WORK).distinct().join(small(grids, (32 << 20) // (8 * widest)), "tile")
    return work.groupBy(*WORK).cogroup(tiles.toDF(*tiles.columns).groupBy(*WORK))  # both sides come from one table


def grid_plane(right: pd.DataFrame, mesh: int, y0: int, x0: int, shape: tuple[int, int]) -> np.ndarray:
    g = np.reshape(right.grid.iloc[0], (right.ny.iloc[0], right.nx.iloc[0]))
    return bicubic(g, (y0 + np.arange(shape[0]) + 0.5) / mesh - 0.5, (x0 + np.arange(shape[1]) + 0.5) / mesh - 0.5)


def regions(work: DataFrame, mask, size: int, cols: str = "", grids: DataFrame | None = None) -> DataFrame:
    """(tile, y, x, region, and cols) of the pixels that mask marks: 8-connected over all tiles of an image.

    mask(rows, grid) gives, of a tile's rows, its corner, a boolean plane and planes of
    cols. A tile labels its own pixels; labels that meet across a border are links, whose
    components (in tables) give each region the least of its names.
    """
    more = cols.split(", ") if cols else []
    names = ["tile", "y", "x", "region", *[c.split()[0] for c in more]]

    def run(key, left: pd.DataFrame, right: pd.DataFrame | None = None) -> pd.DataFrame:
        found = mask(left, right) if len(left) else None
        if found is None:
            return pd.DataFrame(columns=names)
        y0, x0, on, planes = found
        own = on.copy()
        ys, xs = y0 + np.arange(on.shape[0]), x0 + np.arange(on.shape[1])
        own[ys // size != key[1]] = False
        own[:, xs // size != key[2]] = False
        y, x = np.nonzero(own)
        labels = label(own)[y, x] if len(y) else np.zeros(0, int)
        first = np.unique(labels, return_index=True)[1]  # labels run in reading order, as their first pixels do
        region = name_of(y[first] + y0, x[first] + x0)[labels - 1] if len(y) else np.zeros(0, np.int64)
        return pd.DataFrame({"tile": key[0], "y": y + y0, "x": x + x0, "region": region} | {n: p[y, x] for n, p in zip(names[4:], planes, strict=True)}, columns=names)

    schema = ", ".join(["tile long, y int, x int, region long", *more])
    if grids is None:
        def many(frames):
            for f in whole_groups(frames, WORK, 10_000):  # small tiles: many a batch
                keys = f[WORK].to_numpy(np.int64)
                turns = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
                got = [run(tuple(keys[lo]), f.iloc[lo:hi].reset_index(drop=True)) for lo, hi in zip([0, *turns], [*turns, len(f)], strict=True)]
                got = [g for g in got if len(g)]
                if got:
                    yield pd.concat(got, ignore_index=True)

        tasks = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        local = work.repartition(tasks, *WORK).sortWithinPartitions(*WORK).mapInPandas(many, schema)
    else:
        local = with_grid(work, grids).applyInPandas(run, schema)
    local = cut(local)
    edge = (F.col("y") % size).isin(0, size - 1) | (F.col("x") % size).isin(0, size - 1)
    border = local.where(edge).select("tile", "y", "x", F.col("region").alias("a"))
    steps = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j, i in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    beside = border.withColumn("k", steps).select("tile", (F.col("y") + F.col("k.j")).alias("y"), (F.col("x") + F.col("k.i")).alias("x"), "a")
    links = beside.join(border.withColumnRenamed("a", "b"), ["tile", "y", "x"]).where("a <> b").select("tile", "a", "b").distinct()
    names_ = roots(links, ["tile"]).select("tile", F.col("id").alias("region"), "root")
    return local.join(small(names_), ["tile", "region"], "left").withColumn("region", F.coalesce("root", "region")).drop("root")


def found(pixels: DataFrame, kernel: np.ndarray | None = None, threshold: float = 1.5, minarea: int = 5, dilate_pix: int = 4, mesh: int = 64, contrast: float = 0.005, levels: int = 32, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(detections, segments) of the images' pixels (tile: the image, x, y, d, w), the same for any tile size.

    detections: tile, segment, x, y, flux, a, b, theta, npix, blob; segments: tile, x, y,
    segment (0 off all of them), blob, of every pixel in a blob. Segments and blobs are
    named by their first pixel. A task holds a tile and its halo, one mesh, or the
    segments that begin in a tile.
    """
    px = cut(pixels.select("tile", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("d").cast("double").alias("d"), F.col("w").cast("double").alias("w")).withColumn("tile", F.col("tile").cast("long")))
    images = cut(extents(px))
    flagged = px.join(small(images.select("tile", "least", "top")), "tile")
    grids = cut(background_grids(flagged.where((F.col("w") > F.col("least")) & (F.col("w") > 0)), images, mesh))
    reach = max(kernel.shape) // 2 if kernel is not None else 0

    def significant(left: pd.DataFrame, right: pd.DataFrame):
        if not len(right):
            return None
        y0, x0, (d, w) = patch(left, "d", "w")
        usable = (w > left.least.iloc[0]) & (w > 0)
        sub = np.where(usable, d - grid_plane(right, mesh, y0, x0, d.shape), 0)
        w = np.where(usable, w, 0)
        s = matched(sub, w, kernel, left.top.iloc[0]) if kernel is not None else sub * np.sqrt(w)
        return y0, x0, s > threshold, [sub]

    raw = regions(dealt(flagged, tile, reach), significant, tile, "v double", grids)
    large = raw.groupBy("tile", "region").count().where(F.col("count") >= minarea).select("tile", "region")
    segs = raw.join(large, ["tile", "region"], "left_semi").withColumnRenamed("region", "segment")
    if contrast < 1:
        begin = {"_ty": F.floor(F.floor((F.col("segment") - 1) / ROW) / tile).cast("int"), "_tx": F.floor(((F.col("segment") - 1) % ROW) / tile).cast("int")}

        def parted(key, pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for _, s in pdf.groupby("segment", sort=True):
                y0, x0, (own, v) = patch(s.assign(one=1.0), "one", "v")
                parts = deblended(np.maximum(v, 0), own.astype(int), levels, contrast, minarea)
                y, x = np.nonzero(parts)
                k, first, inverse = np.unique(parts[y, x], return_index=True, return_inverse=True)
                out.append(pd.DataFrame({"tile": key[0], "y": y + y0, "x": x + x0, "segment": name_of(y[first] + y0, x[first] + x0)[inverse], "v": v[y, x]}))
            return pd.concat(out)

        segs = segs.withColumns(begin).groupBy(*WORK).applyInPandas(parted, "tile long, y int, x int, segment long, v double")
    segs = cut(segs.select("tile", "y", "x", "segment", "v"))

    def grown(left: pd.DataFrame, _):
        y0, x0 = int(left.y.min()) - dilate_pix, int(left.x.min()) - dilate_pix
        on = np.zeros((int(left.y.max()) + dilate_pix + 1 - y0, int(left.x.max()) + dilate_pix + 1 - x0), bool)
        on[left.y - y0, left.x - x0] = True
        on = dilated(on, dilate_pix)
        cy, cx = max(0, -y0), max(0, -x0)
        on = on[cy : int(left.height.iloc[0]) - y0, cx : int(left.width.iloc[0]) - x0]
        return y0 + cy, x0 + cx, on, []

    blobs = cut(regions(dealt(segs.join(small(images.select("tile", "height", "width")), "tile"), tile, dilate_pix), grown, tile).withColumnRenamed("region", "blob"))
    every = blobs.join(segs.select("tile", "y", "x", "segment"), ["tile", "y", "x"], "left").select("tile", "x", "y", F.coalesce("segment", F.lit(0)).alias("segment"), "blob")
    kind = dict(pixels.dtypes)["tile"]
    return detections_of(segs, blobs).withColumn("tile", F.col("tile").cast(kind)), every.withColumn("tile", F.col("tile").cast(kind))


def detections_of(segs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Moments of each segment (tile, y, x, segment, v) by sums about its first pixel."""
    v, dx, dy = F.greatest("v", F.lit(1e-12)), F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    s = segs.withColumns({"_y": F.floor((F.col("segment") - 1) / ROW), "_x": (F.col("segment") - 1) % ROW})
    sums = s.groupBy("tile", "segment", "_y", "_x").agg(F.sum(v).alias("s"), *[(F.sum(v * c) / F.sum(v)).alias(n) for n, c in (("mx", dx), ("my", dy), ("xx", dx * dx), ("yy", dy * dy), ("xy", dx * dy))], F.sum("v").alias("flux"), F.count("*").alias("npix"))
    xx, yy, xy = F.col("xx") - F.col("mx") * F.col("mx"), F.col("yy") - F.col("my") * F.col("my"), F.col("xy") - F.col("mx") * F.col("my")
    mean, root = (xx + yy) / 2, F.hypot((xx - yy) / 2, xy)
    axis = lambda c: F.sqrt(F.greatest(c, F.lit(1 / 12)))
    shape = sums.select("tile", "segment", (F.col("_x") + F.col("mx")).alias("x"), (F.col("_y") + F.col("my")).alias("y"), "flux", axis(mean + root).alias("a"), axis(mean - root).alias("b"), F.degrees(0.5 * F.atan2(2 * xy, xx - yy)).alias("theta"), "npix", "_y", "_x")
    home = blobs.select("tile", F.col("y").alias("_y"), F.col("x").alias("_x"), "blob")
    return shape.join(home, ["tile", "_y", "_x"]).select("segment", "x", "y", "flux", "a", "b", "theta", "npix", "blob", "tile")


def detections(pixels: DataFrame, **settings) -> DataFrame:
    """(tile, segment, x, y, flux, a, b, theta, npix, blob) of pixels (tile, x, y, d, w); see found."""
    return found(pixels, **settings)[0]


def segments(pixels: DataFrame, **settings) -> DataFrame:
    """(tile, x, y, segment, blob) of every pixel in a blob; see found."""
    return found(pixels, **settings)[1]


def with_background(pixels: DataFrame, mesh: int = 64, tile: int = TILE) -> DataFrame:
    """pixels with background and the image's rms; NaN in an image without weight. The same for any tile size."""
    images = cut(pixels.groupBy("tile").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width")))
    grids = cut(background_grids(pixels.where("w > 0").select("tile", "x", "y", "d"), images, mesh))
    schema = ", ".join(f"{n} {t}" for n, t in pixels.dtypes) + ", background double, background_rms double"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.drop(columns=["_ty", "_tx"])
        if not len(right):
            return left.assign(background=math.nan, background_rms=math.nan)
        y0, x0, _ = patch(left)
        plane = grid_plane(right, mesh, y0, x0, (int(left.y.max()) - y0 + 1, int(left.x.max()) - x0 + 1))
        return left.assign(background=plane[left.y - y0, left.x - x0], background_rms=right.rms.iloc[0])

    return with_grid(dealt(pixels, tile), grids).applyInPandas(run, schema)


def without_background(pixels: DataFrame, method: str = "mesh", mesh: int = 64) -> DataFrame:
    """pixels with their background taken from d: none, or that of a mesh."""
    if method == "none":
        return pixels
    if method != "mesh":
        raise ValueError(f"background method {method!r}")
    out = with_background(pixels, mesh)
    return out.withColumn("d", F.col("d") - F.coalesce(F.nanvl("background", F.lit(0.0)), F.lit(0.0))).select(*pixels.columns)


def assign_to_blobs(cat: DataFrame, segs: DataFrame, dets: DataFrame) -> DataFrame:
    """cat (id, tile, x, y) with blob and segment: those of the pixel; in a blob but off its segments, the segment with the nearest centroid. Rows off all blobs have null."""
    spot = cat.withColumns({"_x": F.rint("x").cast("int"), "_y": F.rint("y").cast("int")})
    here = segs.select("tile", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("segment").alias("_s"), "blob")
    j = spot.join(here, ["tile", "_x", "_y"], "left").drop("_x", "_y")
    lost = j.where("blob is not null and _s = 0").select("id", "tile", "x", "y", "blob")
    near = lost.join(dets.select("tile", "blob", "segment", F.col("x").alias("cx"), F.col("y").alias("cy")), ["tile", "blob"])
    d2 = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    best = near.groupBy("id").agg(F.min(F.struct(d2.alias("d2"), "segment")).alias("m")).select("id", F.col("m.segment").alias("_near"))
    return j.join(best, "id", "left").withColumn("segment", F.coalesce(F.nullif("_s", F.lit(0)), "_near")).drop("_s", "_near")


def unlisted(dets: DataFrame, assigned: DataFrame, segs: DataFrame, pixels: DataFrame, masked: DataFrame, min_distance: float = 3.0, min_snr: float = 5.0, grow: float = 3.0) -> DataFrame:
    """Detections in a blob of a listed source that no source owns: at least min_distance from every source, significant, and clear of masked pixels grown by `grow`."""
    listed = assigned.where("blob is not null")
    d = dets.join(listed.select("tile", "blob").distinct(), ["tile", "blob"], "left_semi").join(listed.select("tile", "segment").distinct(), ["tile", "segment"], "left_anti")
    size = max(min_distance, 1.0)
    cell = lambda c: F.floor(F.col(c) / size).cast("int")
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    src = assigned.select("tile", F.col("x").alias("sx"), F.col("y").alias("sy"), around.alias("k")).select("tile", "sx", "sy", (cell("sx") + F.col("k.i")).alias("_i"), (cell("sy") + F.col("k.j")).alias("_j"))
    close = d.withColumns({"_i": cell("x"), "_j": cell("y")}).join(src, ["tile", "_i", "_j"]).where(F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")) < min_distance).select("tile", "segment").distinct()
    own = segs.where("segment > 0").join(pixels.where("w > 0").select("tile", "x", "y", "d", "w"), ["tile", "x", "y"])
    snr = own.groupBy("tile", "segment").agg((F.sum("d") / F.sqrt(F.sum(1 / F.col("w")))).alias("snr"))
    r = int(grow)
    disc = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-r, r + 1) for j in range(-r, r + 1) if i * i + j * j <= grow * grow))
    grown = masked.select("tile", "x", "y", F.explode(disc).alias("k")).select("tile", (F.col("x") + F.col("k.i")).alias("x"), (F.col("y") + F.col("k.j")).alias("y")).distinct()
    touched = segs.where("segment > 0").join(grown, ["tile", "x", "y"], "left_semi").select("tile", "segment").distinct()
    return d.join(close, ["tile", "segment"], "left_anti").join(touched, ["tile", "segment"], "left_anti").join(snr, ["tile", "segment"]).where(F.col("snr") >= min_snr)


def top_blobs(gains: DataFrame, n: int = 3) -> DataFrame:
    """The n blobs with the largest chi2 gain, ties by id."""
    return gains.orderBy(F.desc("gain"), "blob").limit(n)


def blob_gain(chi_a: DataFrame, chi_b: DataFrame) -> DataFrame:
    """tile, blob, chi2_a, chi2_b, gain from two tables of (tile, blob, chi)."""
    total = lambda df, c: df.groupBy("tile", "blob").agg(F.sum(F.col("chi") * F.col("chi")).alias(c))
    return total(chi_a, "chi2_a").join(total(chi_b, "chi2_b"), ["tile", "blob"]).withColumn("gain", F.col("chi2_a") - F.col("chi2_b"))


def pair_blob(assigned: DataFrame, most: float = 50.0) -> DataFrame:
    """Per tile the brightest blob of exactly two members, both under `most`."""
    g = assigned.where("blob is not null").groupBy("tile", "blob").agg(F.count("*").alias("n"), F.max("flux").alias("top"), F.sum("flux").alias("total")).where((F.col("n") == 2) & (F.col("top") < most))
    return g.withColumn("_k", F.row_number().over(Window.partitionBy("tile").orderBy(F.desc("total"), "blob"))).where("_k = 1").drop("_k")
