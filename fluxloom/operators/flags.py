"""Quality and blend flags, star masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import STAR_PROBABILITY, STARSIGNAL_BIT
from ..functions.small import small
from ..functions.units import finite, known
from . import matching


def probable_stars(cat: DataFrame, p: str = "point_like_prob", psf: str = "flux_psf", sersic: str = "flux_sersic"):
    """Probability over 0.96; without one (the brightest stars), a PSF flux no less than the Sersic flux."""
    return F.when(finite(F.col(p)), F.col(p) > STAR_PROBABILITY).otherwise(F.coalesce(F.col(psf) >= F.col(sersic), F.lit(False)))


def blend_flags(cat: DataFrame, radius_arcsec: float = 1.0, flux_ratio: float = 0.1) -> DataFrame:
    """cat (id, ra, dec, flux, re) with n_neighbors, nearest_arcsec (infinity if none) and blended.

    Blended: another row within the radius has more than flux_ratio of the row's
    flux (a missing flux counts as 0), or another lies inside the row's own
    effective radius. Rows of larger radii are joined octave by octave, so one large
    radius does not make the others meet rows far away.
    """
    n = matching.others(cat, radius_arcsec, ("flux", "re"))
    bright, within = known(F.col("right_flux"), 0.0) > flux_ratio * known(F.col("left_flux"), 0.0), F.coalesce(F.col("sep") < F.col("left_re"), F.lit(False))
    near = n.groupBy(F.col("left_id").alias("id")).agg(F.count("*").alias("n_neighbors"), F.min("sep").alias("nearest_arcsec"), F.bool_or(bright).alias("bright"), F.bool_or(within).alias("inside"))
    large = cat.where(finite(F.col("re")) & (F.col("re") > radius_arcsec)).withColumn("_octave", F.floor(F.log2(F.col("re") / radius_arcsec)).cast("int"))
    out = cat.join(near.hint("merge"), "id", "left")
    for k in sorted(r[0] for r in large.select("_octave").distinct().collect()):  # of a float, at most some two thousand
        own = matching.settled(large.where(F.col("_octave") == k), cat, min(radius_arcsec * 2.0 ** (k + 1), 180 * 3600.0), [F.lit(True).alias("_far")], left_cols=("re",), where="left_id <> right_id and sep < left_re")
        out = out.join(own.hint("merge"), "id", "left").withColumn("inside", F.coalesce("inside", F.lit(False)) | F.coalesce("_far", F.lit(False))).drop("_far")
    return out.withColumns(
        {
            "n_neighbors": F.coalesce("n_neighbors", F.lit(0)).cast("int"),
            "nearest_arcsec": F.coalesce("nearest_arcsec", F.lit(float("inf"))),
            "blended": F.coalesce("bright", F.lit(False)) | F.coalesce("inside", F.lit(False)),
        }
    ).drop("bright", "inside")


def source_flags(cat: DataFrame, bad_pixels: DataFrame, width: int, height: int, bright_ujy: float = 80.0, near_arcsec: float = 6.0, edge: int = 10, box: int = 3) -> DataFrame:
    """cat (id, ra, dec, x, y, flux, is_star, tile) with bright_star, near_bright_star, masked, edge, reliable.

    masked: a bad pixel (tile, x, y) within `box` of the rounded position. Bad
    pixels meet sources in cells of the box's size.
    """
    star = F.coalesce(F.col("is_star") & (F.col("flux") > bright_ujy), F.lit(False))
    c = cat.withColumn("bright_star", star)
    near = matching.settled(c, c.where("bright_star"), near_arcsec, [F.lit(True).alias("near")], strict=True, where="left_id <> right_id")
    size = 2 * box + 1
    spots = c.select("id", "tile", F.rint("x").cast("int").alias("px"), F.rint("y").cast("int").alias("py"))
    cell = lambda v: F.floor(F.col(v) / size).cast("int")
    reach = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    spots = spots.withColumn("d", reach).select("id", "tile", "px", "py", (cell("px") + F.col("d.i")).alias("cx"), (cell("py") + F.col("d.j")).alias("cy"))
    bad = bad_pixels.select("tile", F.col("x").alias("bx"), F.col("y").alias("by")).withColumns({"cx": cell("bx"), "cy": cell("by")})
    hit = spots.join(small(bad, merge=True), ["tile", "cx", "cy"]).where((F.abs(F.col("px") - F.col("bx")) <= box) & (F.abs(F.col("py") - F.col("by")) <= box)).select("id").distinct().withColumn("hit", F.lit(True))
    out = c.join(near.hint("merge"), "id", "left").join(hit.hint("merge"), "id", "left")
    out = out.withColumns(
        {
            "near_bright_star": F.coalesce("near", F.lit(False)) & ~F.col("bright_star"),
            "masked": F.coalesce("hit", F.lit(False)),
            "edge": ~F.coalesce((F.col("x") >= edge) & (F.col("x") < width - edge) & (F.col("y") >= edge) & (F.col("y") < height - edge), F.lit(False)),
        }
    ).drop("near", "hit")
    return out.withColumn("reliable", ~(F.col("bright_star") | F.col("near_bright_star") | F.col("masked") | F.col("edge")))


def star_mask(pixels: DataFrame, stars: DataFrame, scale_arcsec: float, core_arcsec: float = 0.3, spike_arcsec: float | None = None, spike_width_arcsec: float = 0.5) -> DataFrame:
    """pixels (tile, x, y) under the annulus core < r <= min(1.5 sqrt(flux / 80), 6) arcsec of a star (tile, x, y, flux), or its spikes."""
    radius = F.least(1.5 * F.sqrt(F.greatest(F.col("flux"), F.lit(0.0)) / 80), F.lit(6.0)) / scale_arcsec
    reach = F.greatest(radius, F.lit((spike_arcsec or 0.0) / scale_arcsec))
    span = lambda c: F.sequence(F.ceil(F.col(c) - F.col("reach")).cast("int"), F.floor(F.col(c) + F.col("reach")).cast("int"))
    s = stars.select("tile", F.col("x").alias("sx"), F.col("y").alias("sy"), radius.alias("r"), reach.alias("reach")).where("reach >= 0.5")
    p = s.withColumn("x", F.explode(span("sx"))).withColumn("y", F.explode(span("sy")))
    d = F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))
    hit = (d > core_arcsec / scale_arcsec) & (d <= F.col("r"))
    if spike_arcsec:
        w, n = spike_width_arcsec / 2 / scale_arcsec, spike_arcsec / scale_arcsec
        dx, dy = F.abs(F.col("x") - F.col("sx")), F.abs(F.col("y") - F.col("sy"))
        hit = hit | ((dx <= w) & (dy <= n)) | ((dy <= w) & (dx <= n))
    return pixels.join(p.where(hit).select("tile", "x", "y").distinct(), ["tile", "x", "y"], "left_semi")


def star_signal(flag):
    """The star-signal bit of a flag plane."""
    return F.getbit(flag, F.lit(STARSIGNAL_BIT)) == 1


def usable_detections(dets: DataFrame, least_ratio: float = 0.6) -> DataFrame:
    """Detections (flag, a, b) without a flag that are not badly elongated."""
    return dets.where((F.col("flag") == 0) & (F.col("a") > 0) & (F.col("b") / F.when(F.col("a") > 0, F.col("a")) > least_ratio))


def registration_stars(cat: DataFrame, width: int, height: int, least_flux: float = 1.0, edge: float = 10.0) -> DataFrame:
    """Stars (is_star, flux, x, y) bright enough and off the image's edge."""
    inside = (F.col("x") > edge) & (F.col("x") < width - edge) & (F.col("y") > edge) & (F.col("y") < height - edge)
    return cat.where(F.col("is_star") & (F.col("flux") > least_flux) & F.coalesce(inside, F.lit(False)))


def star_signal_pixels(pixels: DataFrame, band: str) -> DataFrame | None:
    """Pixels (tile, x, y) with the star-signal bit of a VIS flag plane; None without a plane. Other bands have no such bit, and are an error."""
    if band.upper() != "VIS":
        raise ValueError(f"{band} has no star-signal bit")
    return pixels.where(star_signal(F.col("flag"))).select("tile", "x", "y") if "flag" in pixels.columns else None
