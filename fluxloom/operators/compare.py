"""Comparisons with published catalogs: matches, what is accepted of them, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import UJY_PER_NMGY, UNWISE_FWHM
from ..functions.cut import cut
from ..functions.units import finite
from . import matching


def _sure(flux: str, err: str, snr: float, strict: bool = False):
    """Finite, with a positive error and a S/N of at least snr (over it if strict)."""
    f, e = F.col(flux), F.col(err)
    ratio = f / F.when(e > 0, e)
    return F.coalesce(finite(f) & finite(e) & (e > 0) & ((ratio > snr) if strict else (ratio >= snr)), F.lit(False))


def sdss(measured: DataFrame, reference: DataFrame, max_sep_arcsec: float = 0.7, snr: float = 3.0) -> DataFrame:
    """reference with match_id, sep, fluxes of both in microjanskys and accepted.

    reference: id, ra, dec, type (6 star, 3 galaxy), clean, and psf_flux, psf_ivar,
    cmodel_flux, cmodel_ivar in nanomaggies: stars compare their PSF flux, others
    their model flux. measured: id, ra, dec, flux, err, in_image. Each measured row
    goes to the reference row nearest to it.
    """
    star = F.col("type") == 6
    ivar = F.when(star, F.col("psf_ivar")).otherwise(F.col("cmodel_ivar"))
    ref = reference.withColumns({"flux": F.when(star, F.col("psf_flux")).otherwise(F.col("cmodel_flux")) * UJY_PER_NMGY, "err": UJY_PER_NMGY / F.sqrt(F.when(ivar > 0, ivar))})
    m = matching.nearest_greedy(ref.select("id", "ra", "dec"), measured, max_sep_arcsec, cols=("flux", "err", "in_image")).select("id", "match_id", "sep", "match_flux", "match_err", "match_in_image")
    out = ref.join(m, "id", "left")
    good = F.col("match_id").isNotNull() & F.col("type").isin(3, 6) & (F.col("clean") == 1) & F.col("match_in_image")
    return out.withColumn("accepted", F.coalesce(good & _sure("flux", "err", snr, True) & _sure("match_flux", "match_err", snr, True), F.lit(False)))


def dawn(measured: DataFrame, reference: DataFrame, radius_arcsec: float = 1.0, isolation_arcsec: float = 5.0, snr: float = 5.0) -> DataFrame:
    """Unshared matches with neighbour_sep, ratio and selected: significant in both, valid there, and no other measured row within the isolation. reference: id, ra, dec, flux, err, valid."""
    alone = matching.second_nearest(measured, isolation_arcsec)
    m = matching.nearest_unshared(alone, reference, radius_arcsec, ("flux", "err", "valid"))
    ok = _sure("flux", "err", snr) & _sure("match_flux", "match_err", snr) & F.coalesce("match_valid", F.lit(True)) & (F.col("neighbour_sep") >= isolation_arcsec)
    return m.withColumns({"ratio": F.col("flux") / F.when(F.col("match_flux") != 0, F.col("match_flux")), "selected": ok})


def two_bands(cat: DataFrame, a: str, b: str, isolation_arcsec: float = 2 * UNWISE_FWHM, snr: float = 5.0, flux_fraction: float = 1 / 3) -> DataFrame:
    """cat (id, ra, dec, flux of the prior band, flux_<a>, err_<a>, flux_<b>, err_<b>) with isolated, ratio of a to b and selected."""
    iso = matching.isolated(cat, isolation_arcsec, flux_fraction)
    ok = F.col("isolated") & _sure(f"flux_{a}", f"err_{a}", snr) & _sure(f"flux_{b}", f"err_{b}", snr)
    return iso.withColumns({"ratio": F.col(f"flux_{a}") / F.when(F.col(f"flux_{b}") != 0, F.col(f"flux_{b}")), "selected": ok})


def unwise(measured: DataFrame, reference: DataFrame, psf_fraction: float, radius_arcsec: float = 1.0, snr: float = 5.0, isolation_arcsec: float = 2 * UNWISE_FWHM) -> DataFrame:
    """measured with its fluxes in the catalog's convention (those of the central part of the PSF), the match, selected, isolated and clean.

    measured: id, ra, dec, flux (prior band), wise_flux, wise_err, quality. reference:
    id, ra, dec, flux, err, primary, flags.
    """
    iso = matching.isolated(measured, isolation_arcsec).withColumns({c: F.col(c) * psf_fraction for c in ("wise_flux", "wise_err")})
    m = matching.nearest_unshared(measured.select("id", "ra", "dec"), reference, radius_arcsec, ("flux", "err", "primary", "flags"))
    out = cut(iso).join(cut(m.drop("ra", "dec")).hint("merge"), "id", "left").withColumn("snr", F.coalesce(F.col("wise_flux") / F.when(F.col("wise_err") > 0, F.col("wise_err")), F.lit(0.0)))
    positive = lambda c: finite(F.col(c)) & (F.col(c) > 0)
    ok = F.col("match_id").isNotNull() & (F.col("match_primary") == 1) & (F.col("match_flags") == 0) & F.coalesce("quality", F.lit(True))
    for c in ("wise_flux", "wise_err", "match_flux", "match_err"):
        ok = ok & positive(c)
    out = out.withColumn("selected", F.coalesce(ok, F.lit(False)))
    return out.withColumn("clean", F.col("selected") & F.col("isolated") & (F.col("snr") > snr))
