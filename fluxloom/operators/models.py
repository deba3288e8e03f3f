"""Source models as Column expressions: one struct per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FREE_PARAMETERS, MODELS, RADIUS_ARCSEC, SERSIC_N, STAR_PROBABILITY
from ..functions.small import small
from ..functions.units import finite, known


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(c, F.lit(hi)))


def from_catalog(cat: DataFrame, psf_fwhm_arcsec: float = 0.16, force_model: str | None = None) -> DataFrame:
    """cat (point_like_prob, sersic_re, sersic_n, sersic_ab, sersic_angle, semimajor, ellipticity, position_angle, pixel_scale) with model, re, ab, pa, n.

    Points: probable stars, and radii under half the PSF's width. Otherwise a Sersic
    profile with clipped parameters; without one, an exponential from the isophote,
    or a point if that is missing or small too.
    """
    p, re = known(F.col("point_like_prob"), 0.0), F.col("sersic_re")
    sersic = finite(re) & (re > 0) & finite(F.col("sersic_n")) & finite(F.col("sersic_ab"))
    iso = F.col("semimajor") * F.col("pixel_scale")
    has_iso = finite(iso) & (iso >= psf_fwhm_arcsec / 2) & finite(F.col("ellipticity"))
    model = F.when(p > STAR_PROBABILITY, "PointSource").when(sersic & (re < psf_fwhm_arcsec / 2), "PointSource").when(sersic, "SersicGalaxy").when(has_iso, "ExpGalaxy").otherwise("PointSource")
    if force_model:
        if force_model not in MODELS:
            raise ValueError(f"model {force_model!r}")
        model = F.lit(force_model)
    out = cat.withColumn("model", model)
    point, is_sersic = F.col("model") == "PointSource", sersic & (F.col("model") != "ExpGalaxy") | (F.lit(force_model is not None) & sersic)
    shape = lambda a, b: F.when(~point, F.when(is_sersic, a).otherwise(b))
    return out.withColumns(
        {
            "re": shape(clip(re, *RADIUS_ARCSEC), clip(F.coalesce(iso, F.lit(psf_fwhm_arcsec)), *RADIUS_ARCSEC)),
            "ab": shape(clip(F.col("sersic_ab"), 0.05, 1.0), clip(1 - F.coalesce(F.col("ellipticity"), F.lit(0.0)), 0.05, 1.0)),
            "pa": shape(-F.coalesce("sersic_angle", F.lit(0.0)), F.coalesce("position_angle", F.lit(0.0))),
            "n": F.when(F.col("model") == "SersicGalaxy", clip(F.coalesce("sersic_n", F.lit(1.0)), *SERSIC_N)),
        }
    )


def from_coords(coords: DataFrame, model: str = "PointSource", flux: float = 1.0, re: float | None = None, ab: float = 1.0, pa: float = 0.0, n: float = 1.0) -> DataFrame:
    """coords (ra, dec and optional flux, re, ab, pa, n, under any of their names) with model columns; scalars fill what is missing. Galaxies need a radius."""
    names = {"flux": ("flux_ujy", "flux_guess_ujy", "flux"), "re": ("re_arcsec", "re"), "ab": ("axis_ratio", "ab"), "pa": ("position_angle_deg", "position_angle", "pa"), "n": ("sersic_n", "n")}
    low = {c.lower(): c for c in coords.columns}
    if not {"ra", "dec"} <= set(low):
        raise ValueError("coordinates need ra and dec")
    if model not in MODELS:
        raise ValueError(f"model {model!r}")
    given = {k: [F.col(low[a]).cast("double") for a in v if a in low] for k, v in names.items()}
    if model not in ("PointSource", "SimpleGalaxy") and re is None and not given["re"]:
        raise ValueError(f"{model} needs re_arcsec")
    fill = {"flux": flux, "re": re, "ab": ab, "pa": pa, "n": n}
    value = lambda k: F.coalesce(*given[k], F.lit(fill[k]).cast("double"))
    ident = F.col(low["id"]) if "id" in low else F.xxhash64(F.col(low["ra"]), F.col(low["dec"]))
    point = model == "PointSource"
    return coords.select(ident.alias("id"), F.col(low["ra"]).cast("double").alias("ra"), F.col(low["dec"]).cast("double").alias("dec"), value("flux").alias("flux"), F.lit(model).alias("model"), *[(F.lit(None).cast("double") if point else value(k)).alias(k) for k in ("re", "ab", "pa", "n")])


def clones(sources: DataFrame, bands: DataFrame, point: bool = False) -> DataFrame:
    """Every source in every band (band, seed_nmgy, psf_half_pix, scale_arcsec: a row per band), with the half-size of its stamp."""
    out = sources.crossJoin(small(bands))
    if point:
        out = out.withColumns({"model": F.lit("PointSource"), "re": F.lit(None).cast("double")})
    return out.withColumn("half_pix", F.col("psf_half_pix") + F.greatest(F.lit(4), F.ceil(2 * F.coalesce("re", F.lit(0.0)) / F.col("scale_arcsec"))).cast("int"))


def free_parameters(model: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, k in FREE_PARAMETERS.items():
        out = F.when(model == name, F.lit(k)).otherwise(out)
    return out


def best_tier(trials: DataFrame) -> DataFrame:
    """source_id, model, chi2 of the least chi2; ties go to the simpler model."""
    order = F.lit(len(MODELS))
    for k, m in enumerate(MODELS):
        order = F.when(F.col("model") == m, F.lit(k)).otherwise(order)
    return trials.where(finite(F.col("chi2"))).groupBy("source_id").agg(F.min(F.struct("chi2", order.alias("tier"), "model")).alias("m")).select("source_id", "m.model", "m.chi2")


def tree_decision(c: DataFrame, limit: float = 1.5, point_gain: float = 0.05, tie: float = 0.15) -> DataFrame:
    """Model of each source from its reduced chi2 per tier (simple, point, exp, dev, comp) and full_ladder.

    A point that beats the simple galaxy (less point_gain) within the limit is kept;
    a full-ladder member then takes the least chi2 of all tiers, others stop at the
    first tier that is good enough.
    """
    s, p, e, d, m = (F.coalesce(F.col(k), F.lit(float("inf"))) for k in ("simple", "point", "exp", "dev", "comp"))
    tiers = [("PointSource", p), ("SimpleGalaxy", s), ("ExpGalaxy", e), ("DevGalaxy", d), ("CompositeGalaxy", m)]
    least = F.least(*(c for _, c in tiers))
    argmin = F.lit(None).cast("string")
    for name, c_ in reversed(tiers):
        argmin = F.when(c_ == least, F.lit(name)).otherwise(argmin)
    lock = (p <= s + point_gain) & (p <= limit)
    early = ~((p > limit) & (s > limit)) & (s < p) & (s <= limit)
    stage4 = (
        F.when((e > limit) & (d > limit), F.lit(None).cast("string"))
        .when((s <= e) & (s <= d) & (s <= limit), F.lit("SimpleGalaxy"))
        .when(F.abs(e - d) < tie, F.lit(None).cast("string"))
        .when(F.least(e, d) <= limit, F.when(e <= d, F.lit("ExpGalaxy")).otherwise(F.lit("DevGalaxy")))
    )
    stage5 = F.when((e <= m) & (e <= limit), F.lit("ExpGalaxy")).when((d <= m) & (d <= limit), F.lit("DevGalaxy")).when(m <= limit, F.lit("CompositeGalaxy")).otherwise(argmin)
    return c.withColumns({"stage2_simple": early, "model": F.when(lock, F.lit("PointSource")).when(F.coalesce(F.col("full_ladder"), F.lit(False)), argmin).otherwise(F.coalesce(stage4, stage5))}).drop("stage2_simple")


def sersic_kept(chi2_before: Column, chi2_after: Column, snr: Column, model: Column) -> Column:
    """The Sersic tier is tried for resolved winners of S/N 20 and kept if total chi2 falls by more than 25."""
    return F.coalesce(model.isin("ExpGalaxy", "DevGalaxy", "CompositeGalaxy") & (snr >= 20) & (chi2_before - chi2_after > 25), F.lit(False))


def unphysical(flux: Column, reference: Column) -> Column:
    """A fitted flux that is negative, or over 100 times a positive reference."""
    return F.coalesce(flux < 0, F.lit(False)) | F.coalesce((reference > 0) & (F.abs(flux) > 100 * reference), F.lit(False)) | ~finite(flux)


def initial_flux(flux: Column) -> Column:
    """The flux that a trial of a model starts from: 1 where there is none, or none that is positive."""
    return F.when(finite(flux) & (flux > 0), flux).otherwise(1.0)
