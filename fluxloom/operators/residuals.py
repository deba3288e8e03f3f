"""Statistics of residuals, stamps and offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.small import small
from ..functions.units import finite


def statistics(pixels: DataFrame, keys: list[str], least_outside: int = 100) -> DataFrame:
    """keys, residual_std, formal_sigma, chi_std, chi_mad, pct_chi_gt_3 of pixels (keys, data, model, weight, inside).

    residual_std is clipped at 3 sigma over the pixels off the footprint (inside is
    false) if there are more than least_outside of them, else over all. formal_sigma is
    1 / sqrt(median weight). chi counts pixels with weight alone.
    """
    p = pixels.withColumn("_r", F.col("data") - F.col("model")).where(finite(F.col("_r")))
    off = p.groupBy(*keys).agg(F.count(F.when(~F.coalesce("inside", F.lit(False)), 1)).alias("_off"))
    use = stats.met(p, off, keys).where((F.col("_off") <= least_outside) | ~F.coalesce("inside", F.lit(False)))
    std = stats.sigma_clipped(use, F.col("_r"), keys).select(*keys, F.col("clipped_std").alias("residual_std"))
    w = p.where("weight > 0").withColumn("_chi", F.col("_r") * F.sqrt("weight"))
    sigma = stats.medians(w, F.col("weight"), keys, "_w").select(*keys, (1 / F.sqrt("_w")).alias("formal_sigma"))
    sums = w.groupBy(*keys).agg(F.stddev_pop("_chi").alias("chi_std"), (100 * F.avg((F.abs("_chi") > 3).cast("double"))).alias("pct_chi_gt_3"))
    mad = stats.mad_std(w, F.col("_chi"), keys, "chi_mad").drop("n")
    out = std
    for more in (sums, sigma, mad):
        out = out.join(small(more), keys, "left") if keys else out.crossJoin(F.broadcast(more))  # one row
    return out.withColumn("formal_sigma", F.coalesce("formal_sigma", "residual_std"))


def central_fraction(stamps: DataFrame, half: int = 9) -> DataFrame:
    """id, fraction of the stamp (row-major array, width) in the square of 2 half + 1 pixels about its centre."""
    px = stamps.select("id", "width", F.posexplode("stamp").alias("k", "v"), F.floor(F.size("stamp") / F.col("width") / 2).alias("_cy"), F.floor(F.col("width") / 2).alias("_cx"))
    near = (F.abs(F.col("k") % F.col("width") - F.col("_cx")) <= half) & (F.abs(F.floor(F.col("k") / F.col("width")) - F.col("_cy")) <= half)
    total = F.sum(F.col("v").cast("double"))
    return px.groupBy("id").agg((F.sum(F.when(near, F.col("v").cast("double")).otherwise(0.0)) / F.when(total != 0, total)).alias("fraction"))


def median_offsets(offsets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, and the median dx and dy of rows with both."""
    ok = offsets.where(finite(F.col("dx")) & finite(F.col("dy")))
    return stats.met(stats.medians(ok, F.col("dx"), keys, "dx"), stats.medians(ok, F.col("dy"), keys, "dy").drop("n"), keys).select(*keys, "n", "dx", "dy")


def aperture_gains(sources: DataFrame, pixels: DataFrame, core: float, radius: float) -> DataFrame:
    """Per source (id, tile, x, y) the sums of gain over the pixels (tile, x, y, gain, difference) within radius, within core and between, and the largest |difference| within radius (pixels). Pixels meet sources in cells of the radius."""
    size = max(radius, 1.0)
    cell = lambda c: F.floor(F.col(c) / size).cast("int")
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    s = sources.select("id", "tile", F.col("x").alias("sx"), F.col("y").alias("sy")).withColumns({"_i": cell("sx"), "_j": cell("sy"), "_k": around})
    s = s.select("id", "tile", "sx", "sy", (F.col("_i") + F.col("_k.i")).alias("_i"), (F.col("_j") + F.col("_k.j")).alias("_j"))
    near = s.join(pixels.withColumns({"_i": cell("x"), "_j": cell("y")}), ["tile", "_i", "_j"]).withColumn("_r", F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))).where(F.col("_r") <= radius)
    part = lambda c: F.sum(F.when(c, F.col("gain")).otherwise(0.0))
    got = near.groupBy("id").agg(F.sum("gain").alias("gain"), part(F.col("_r") <= core).alias("gain_core"), part(F.col("_r") > core).alias("gain_ring"), F.max(F.abs("difference")).alias("max_difference"))
    return sources.select("id").join(got, "id", "left").na.fill(0.0, ["gain", "gain_core", "gain_ring"])
