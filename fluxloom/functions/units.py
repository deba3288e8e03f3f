"""Fluxes, magnitudes and masks as Column expressions. Undefined values are null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EXTINCTION, IRAC_FLUX_CORRECTION, IRAC_SYSTEMATIC, UJY_PER_NMGY, VEGA_AB, WARM_MJD, ZP_NMGY, ZP_UJY


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def known(c: Column, default: float | None = None) -> Column:
    """c, or the default where it is null, NaN or infinite."""
    return F.when(finite(c), c).otherwise(F.lit(default))


def nmgy_to_data(zero_point: Column) -> Column:
    return F.pow(F.lit(10.0), 0.4 * (zero_point - ZP_NMGY))


def flux_to_ab_mag(f: Column) -> Column:
    return F.when(finite(f) & (f > 0), ZP_UJY - 2.5 * F.log10(f))


def flux_err_to_mag_err(f: Column, e: Column) -> Column:
    return F.when(finite(f) & finite(e) & (f > 0), 2.5 / math.log(10) * e / F.when(f > 0, f))


def vega_mag_to_ujy(m: Column, band: Column) -> Column:
    offset = F.when(band == "W1", VEGA_AB["W1"]).when(band == "W2", VEGA_AB["W2"])
    return F.pow(F.lit(10.0), (ZP_UJY - m - offset) / 2.5)


def vega_nmgy_to_ujy(f: Column, band: str) -> Column:
    return f * (UJY_PER_NMGY * 10 ** (-0.4 * VEGA_AB[band]))


def ujy_per_image_unit(zero_point: Column) -> Column:
    return UJY_PER_NMGY / nmgy_to_data(zero_point)


def flux_errors_ujy(information: Column, inflation: Column) -> Column:
    return F.when(information > 0, inflation / F.sqrt(F.when(information > 0, information)) * UJY_PER_NMGY)


def flux_ujy(flux_by_band: Column, band: str) -> Column:
    return F.try_element_at(flux_by_band, F.lit(band)) * UJY_PER_NMGY


def invvar_from_rms(rms: Column, data: Column | None = None) -> Column:
    ok = finite(rms) & (rms > 0)
    if data is not None:
        ok = ok & finite(data)
    return F.when(ok, 1 / F.when(rms > 0, rms * rms)).otherwise(0.0)


def apply_bitmask(weight: Column, flag: Column, bits: int | None) -> Column:
    """0 where the flag has one of the bits (any bit if None)."""
    hit = flag != 0 if bits is None else flag.bitwiseAND(F.lit(bits)) != 0
    return F.when(F.coalesce(hit, F.lit(False)), 0.0).otherwise(weight)


def quality_masked(flag: Column) -> Column:
    """Bits 7 or 8 of the detection quality flag."""
    return flag.bitwiseAND(F.lit(0b11 << 7)) != 0


def field_id(c: Column) -> dict[str, Column]:
    """rerun, run, camcol and field packed in one long."""
    cut = lambda at, bits: F.shiftright(c, at).bitwiseAND(F.lit((1 << bits) - 1))
    return {"rerun": cut(48, 11), "run": cut(32, 16), "camcol": cut(29, 3), "field": cut(16, 12)}


def sdss_variance(data: Column, calib: Column, sky: Column, gain: Column, dark: Column) -> Column:
    return ((data / calib + sky) / gain + dark) * calib * calib


def extinction(ebv: Column, band: str) -> Column:
    return ebv * EXTINCTION[band] if band in EXTINCTION else F.lit(None).cast("double")


def irac_flux(f: Column, e: Column, channel: str) -> tuple[Column, Column]:
    """Corrected flux, and its error with the systematic part in quadrature."""
    out = f * IRAC_FLUX_CORRECTION[channel]
    return out, F.hypot(e * IRAC_FLUX_CORRECTION[channel], IRAC_SYSTEMATIC * out)


def mjy_sr_to_ujy(value: Column, pixel_area_sr: Column) -> Column:
    return value * 1e12 * pixel_area_sr


def log_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.abs(F.log10(F.when(b > 0, a / F.when(b > 0, b)))))


def difference_sigma(a: Column, b: Column, ea: Column, eb: Column) -> Column:
    s = F.hypot(ea, eb)
    return F.when(s > 0, (a - b) / F.when(s > 0, s))


def effective_radius(*parts: Column) -> Column:
    """The largest finite positive radius, else 0."""
    return F.coalesce(F.greatest(*[F.when(finite(p) & (p > 0), p) for p in parts], F.lit(0.0)), F.lit(0.0))


def isophotal_seed(a: Column, b: Column, theta_deg: Column, scale: Column) -> dict[str, Column]:
    """Shape seed from a detection: radius (arcsec), axis ratio, position angle, largest log-radius."""
    re = F.sqrt(a * b) * scale
    return {"re": re, "ab": b / F.when(a > 0, a), "pa": 90 - theta_deg, "re_cap": F.greatest(F.lit(2.72), F.least(5 * re, F.lit(20.0)))}


def bounded_uniform(key: Column, lo: float, hi: float, log: bool = False) -> Column:
    """A draw for each key by hash: the same on every run and engine of this package."""
    u = F.pmod(F.xxhash64(key), F.lit(1 << 40)) / float(1 << 40)
    return F.exp(math.log(lo) + u * math.log(hi / lo)) if log else lo + u * (hi - lo)


def irac_mission(channel: Column, mjd: Column) -> Column:
    """cryo or warm of a channel (1 to 4) at a date; channels 3 and 4 have cryogenic data alone, and an unknown date counts as cryogenic."""
    return F.when(channel >= 3, "cryo").when(mjd >= WARM_MJD, "warm").otherwise("cryo")


def mag_difference(a: Column, b: Column, ea: Column, eb: Column) -> dict[str, Column]:
    """Magnitude difference of two fluxes, and its error if theirs are independent."""
    both = (a > 0) & (b > 0)
    ra, rb = ea / F.when(a > 0, a), eb / F.when(b > 0, b)
    return {"dmag": F.when(both, 2.5 * F.log10(F.when(b > 0, b) / F.when(a > 0, a))), "dmag_err": F.when(both, 2.5 / math.log(10) * F.hypot(ra, rb))}
