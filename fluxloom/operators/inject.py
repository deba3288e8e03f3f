"""Injected sources, empty positions and error calibration."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, units
from ..functions.cut import cut
from .render import normalized, template


def truth_table(spark: SparkSession, n: int, width: int, height: int, flux_ranges: dict[str, tuple[float, float]], seed: int = 1, tile: int = 0, edge: int = 10, point_share: float = 1.0) -> DataFrame:
    """n injected sources of negative ids: positions uniform off the edge, log-uniform fluxes per band, shapes null for points. The same seed gives the same rows."""
    i = F.col("i")
    u = lambda k, lo, hi, log=False: units.bounded_uniform(F.concat_ws(":", F.lit(seed), F.lit(k), i), lo, hi, log)
    point = u("kind", 0, 1) < point_share
    shape = lambda c: F.when(~point, c)
    return spark.range(n).select(F.col("id").alias("i")).select(
        (-1 - i - seed * 1_000_000).alias("id"),
        F.lit(tile).cast("long").alias("tile"),
        u("x", edge, width - edge).alias("x"),
        u("y", edge, height - edge).alias("y"),
        F.when(point, "PointSource").otherwise("SersicGalaxy").alias("model"),
        shape(u("re", 2, 6, True)).alias("re"),
        shape(u("ab", 0.3, 1)).alias("ab"),
        shape(u("pa", -90, 90)).alias("pa"),
        shape(u("n", 0.8, 4)).alias("n"),
        *[u(b, lo, hi, True).alias(f"flux_{b.lower()}") for b, (lo, hi) in flux_ranges.items()],
    )


def rendered(sources: DataFrame, psf: np.ndarray, width: int, height: int) -> DataFrame:
    """(tile, id, x, y, t): unit templates of any model through the PSF (a stamp of fixed size; or a source's own, of psf.with_stamps()), by Arrow batches."""
    kind = dict(sources.dtypes)["tile"]
    own = [c for c in ("psf", "psf_width") if c in sources.columns]

    def run(batches):
        for pdf in batches:
            parts = []
            for r in pdf.itertuples():
                num = lambda v, z: z if v is None or v != v else float(v)
                through = normalized(np.asarray(r.psf, float).reshape(-1, int(r.psf_width))) if own and r.psf is not None else psf
                x0, y0, stamp = template(r.model, r.x, r.y, through, num(r.re, 0.0) or None, num(r.ab, 1.0), num(r.pa, 0.0), num(r.n, 1.0))
                y, x = np.mgrid[y0 : y0 + stamp.shape[0], x0 : x0 + stamp.shape[1]]
                ok = (x >= 0) & (x < width) & (y >= 0) & (y < height) & (stamp != 0)
                parts.append(pd.DataFrame({"tile": r.tile, "id": r.id, "x": x[ok], "y": y[ok], "t": stamp[ok]}))
            yield pd.concat(parts) if parts else pd.DataFrame({"tile": [], "id": [], "x": [], "y": [], "t": []})

    return sources.select("tile", "id", "x", "y", "model", "re", "ab", "pa", "n", *own).mapInPandas(run, f"tile {kind}, id long, x int, y int, t double")


def derivatives(sources: DataFrame, psf: np.ndarray, width: int, height: int, step: float = 0.01) -> DataFrame:
    """(tile, id, x, y, tx, ty): how unit templates change with their source's place, by central differences."""
    moved = lambda dx, dy: rendered(sources.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy}), psf, width, height)
    parts = [moved(k * step * (c == "tx"), k * step * (c == "ty")).select("tile", "id", "x", "y", *[(F.col("t") * (k / (2 * step) if c == own else 0.0)).alias(own) for own in ("tx", "ty")]) for c in ("tx", "ty") for k in (1, -1)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return both.groupBy("tile", "id", "x", "y").agg(F.sum("tx").alias("tx"), F.sum("ty").alias("ty"))


def inject(pixels: DataFrame, templates: DataFrame, truth: DataFrame, flux: str) -> DataFrame:
    """pixels with the truth's light added to d."""
    light = templates.join(truth.select("id", F.col(flux).alias("_f")), "id").groupBy("tile", "x", "y").agg(F.sum(F.col("t") * F.col("_f")).alias("_l"))
    return pixels.join(light, ["tile", "x", "y"], "left").withColumn("d", F.col("d") + F.coalesce("_l", F.lit(0.0))).drop("_l")


def empty_positions(pixels: DataFrame, cat: DataFrame, n: int = 200, avoid: float = 15.0, edge: int = 20, seed: int = 0, draws: int = 4) -> DataFrame:
    """Up to n positions (tile, id, x, y) per tile on usable pixels, more than `avoid` pixels from catalog rows and from one another.

    Candidates are the tile's usable pixels in hash order, in batches: first some
    draws * n of them per tile (at least 64), then twice as many each time, until each
    tile has its n or all its pixels were tried. A batch is what a task holds of a tile.
    """
    usable = pixels.where("w > 0").join(F.broadcast(pixels.agg(F.max("x").alias("_w"), F.max("y").alias("_h"))))  # one row
    usable = usable.where(F.col("x").between(edge, F.col("_w") - edge) & F.col("y").between(edge, F.col("_h") - edge)).select("tile", "x", "y", F.xxhash64(F.lit(seed), "tile", "x", "y").alias("h"))
    size = max(avoid, 1.0)
    cell = lambda c: F.floor(F.col(c) / size).cast("int")
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    src = cat.select("tile", F.col("x").alias("sx"), F.col("y").alias("sy"), around.alias("k")).select("tile", "sx", "sy", (cell("sx") + F.col("k.i")).alias("_i"), (cell("sy") + F.col("k.j")).alias("_j"))
    near = usable.withColumns({"_i": cell("x"), "_j": cell("y")}).join(src, ["tile", "_i", "_j"]).where(F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")) <= avoid).select("tile", "x", "y").distinct()
    free = usable.join(near, ["tile", "x", "y"], "left_anti")
    kind = dict(pixels.dtypes)["tile"]

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["q", "h", "x", "y"])
        had = pdf.q.to_numpy() < 0
        got = np.empty((n, 2))
        m = min(int(had.sum()), n)
        got[:m] = pdf[["x", "y"]].to_numpy(float)[had][:m]
        for at in pdf[["x", "y"]].to_numpy(float)[~had]:
            if m == n:
                break
            if not m or ((got[:m] - at) ** 2).sum(axis=1).min() > avoid * avoid:
                got[m] = at
                m += 1
        return pd.DataFrame({"tile": pdf.tile.iloc[0], "id": np.arange(m), "x": got[:m, 0], "y": got[:m, 1]})

    most = max(draws * n, 64)
    share = free.groupBy("tile").agg(F.count("*").alias("_n"))
    ranked = cut(free.withColumn("q", F.pmod("h", F.lit(1 << 30)) / float(1 << 30)).join(share, "tile").withColumn("batch", F.floor(F.log2(1 + F.col("q") * F.col("_n") / most)).cast("int")).drop("_n"))
    last = ranked.agg(F.max("batch")).head()[0]
    got = None
    for k in range((last if last is not None else -1) + 1):
        batch = ranked.where(F.col("batch") == k).select("tile", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "h", "q")
        if got is not None:  # the order among those accepted stays: their number stands for it
            done = got.groupBy("tile").agg(F.count("*").alias("m")).where(F.col("m") >= n).select("tile")
            batch = batch.join(done, "tile", "left_anti")
            if not batch.head(1):
                if not ranked.join(done, "tile", "left_anti").where(F.col("batch") > k).head(1):
                    break
                continue
            batch = batch.unionByName(got.select("tile", "x", "y", F.lit(0).cast("long").alias("h"), (F.col("id") - 1.0 - n).alias("q")))
        got = cut(batch.groupBy("tile").applyInPandas(greedy, f"tile {kind}, id long, x double, y double"))
    return got if got is not None else ranked.limit(0).select("tile", F.lit(0).cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def empty_inflation(fluxes: DataFrame, keys: list[str], least: int = 20) -> DataFrame:
    """keys, factor: max(1, mad_std(flux / err)) of fits at empty positions; 1 for fewer than `least` of them."""
    spread = stats.mad_std(fluxes.where("err > 0"), F.col("flux") / F.when(F.col("err") > 0, F.col("err")), keys, "spread")
    return spread.select(*keys, F.when(F.col("n") >= least, F.greatest(F.lit(1.0), "spread")).otherwise(1.0).alias("factor"), "n")


def union_of_runs(runs: list[DataFrame], stride: int = 1_000_000) -> DataFrame:
    """Runs of an experiment with their ids set apart."""
    out = None
    for k, r in enumerate(runs):
        r = r.withColumns({"id": F.col("id") - k * stride, "run": F.lit(k)})
        out = r if out is None else out.unionByName(r)
    if out is None:
        raise ValueError("no runs")
    return out


def log_edges(lo: float, hi: float, n: int) -> list[float]:
    return [math.exp(math.log(lo) + math.log(hi / lo) * k / n) for k in range(n + 1)]
