"""Angles on the sphere, tangent-plane coordinates and sky cells as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrapped(d: Column) -> Column:
    """An angle difference in [-180, 180)."""
    return F.pmod(d + 180, F.lit(360.0)) - 180


def separation_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance (haversine)."""
    s, t = F.sin(F.radians(dec2 - dec1) / 2), F.sin(F.radians(ra2 - ra1) / 2)
    h = s * s + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * t * t
    return F.degrees(2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))) * 3600


def tangent_offsets_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> dict[str, Column]:
    """Small offsets of the second position from the first."""
    dx, dy = wrapped(ra2 - ra1) * F.cos(F.radians(dec1)) * 3600, (dec2 - dec1) * 3600
    return {"dx": dx, "dy": dy, "total": F.hypot(dx, dy)}


def unit_vector(ra: Column, dec: Column) -> dict[str, Column]:
    c = F.cos(F.radians(dec))
    return {"ux": c * F.cos(F.radians(ra)), "uy": c * F.sin(F.radians(ra)), "uz": F.sin(F.radians(dec))}


def position_angle_deg(cd12: Column, cd22: Column) -> Column:
    return F.degrees(F.atan2(cd12, cd22))


def ra_within(ra: Column, centre: float, half: float) -> Column:
    """|ra - centre| <= half across the 0/360 seam, as ranges that a scan can use."""
    if half >= 180:
        return F.lit(True)
    lo, hi = (centre - half) % 360, (centre + half) % 360
    return ra.between(lo, hi) if lo <= hi else (ra >= lo) | (ra <= hi)


def box(ra: Column, dec: Column, centre_ra: float, centre_dec: float, half_deg: float) -> Column:
    """A square of the tangent plane's size: the RA range is widened by 1 / cos(dec)."""
    import math

    c = math.cos(math.radians(min(89.999999, abs(centre_dec) + half_deg)))
    return ra_within(ra, centre_ra, min(180.0, half_deg / c)) & dec.between(centre_dec - half_deg, centre_dec + half_deg)


def in_circle(ra: Column, dec: Column, centre_ra: float, centre_dec: float, radius_arcsec: float) -> Column:
    """Box first (pushed to the scan), then the exact distance."""
    r = radius_arcsec / 3600
    return box(ra, dec, centre_ra, centre_dec, r) & (separation_arcsec(F.lit(centre_ra), F.lit(centre_dec), ra, dec) <= radius_arcsec)


# -- tangent projection ---------------------------------------------------------------

WCS_FIELDS = ("crval1", "crval2", "crpix1", "crpix2", "cd11", "cd12", "cd21", "cd22")


def wcs(crval1, crval2, crpix1, crpix2, cd11, cd12, cd21, cd22) -> dict[str, Column]:
    """0-based reference pixel, degrees."""
    return {k: F.lit(float(v)) if not isinstance(v, Column) else v for k, v in zip(WCS_FIELDS, (crval1, crval2, crpix1, crpix2, cd11, cd12, cd21, cd22), strict=True)}


def sky_to_pixel(ra: Column, dec: Column, w: dict[str, Column]) -> dict[str, Column]:
    """Pixel of a position; null on the far side of the tangent point."""
    a, d, a0, d0 = F.radians(ra), F.radians(dec), F.radians(w["crval1"]), F.radians(w["crval2"])
    cos_c = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(a - a0)
    near = F.when(cos_c > 0, cos_c)
    xi = F.degrees(F.cos(d) * F.sin(a - a0) / near)
    eta = F.degrees((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(a - a0)) / near)
    det = w["cd11"] * w["cd22"] - w["cd12"] * w["cd21"]
    return {"x": w["crpix1"] + (w["cd22"] * xi - w["cd12"] * eta) / det, "y": w["crpix2"] + (w["cd11"] * eta - w["cd21"] * xi) / det}


def pixel_to_sky(x: Column, y: Column, w: dict[str, Column]) -> dict[str, Column]:
    dx, dy = x - w["crpix1"], y - w["crpix2"]
    xi, eta = F.radians(w["cd11"] * dx + w["cd12"] * dy), F.radians(w["cd21"] * dx + w["cd22"] * dy)
    a0, d0 = F.radians(w["crval1"]), F.radians(w["crval2"])
    den = F.cos(d0) - eta * F.sin(d0)
    ra = F.pmod(F.degrees(F.atan2(xi, den) + a0), F.lit(360.0))
    return {"ra": ra, "dec": F.degrees(F.atan2(F.sin(d0) + eta * F.cos(d0), F.hypot(xi, den)))}


def pixel_scale_arcsec(w: dict[str, Column]) -> Column:
    return F.sqrt(F.abs(w["cd11"] * w["cd22"] - w["cd12"] * w["cd21"])) * 3600


def footprint(x: Column, y: Column, width: int, height: int, margin: float = 0.0) -> Column:
    """Inside the image widened by margin pixels (a negative margin shrinks it)."""
    return F.coalesce((x >= -margin) & (x < width + margin) & (y >= -margin) & (y < height + margin), F.lit(False))


# -- cells for sky joins ----------------------------------------------------------------


def band_of(dec: Column, r_deg: float) -> Column:
    return F.floor(dec / r_deg).cast("long")


def cells_in_band(band: Column, r_deg: float) -> Column:
    """How many cells of equal RA width a declination band has: each at least as wide as the radius reaches anywhere in the band."""
    top = F.greatest(F.abs(band * r_deg), F.abs((band + 1) * r_deg))
    reach = F.degrees(F.asin(F.sin(F.radians(F.lit(r_deg))) / F.cos(F.radians(F.when(top + r_deg < 90, top).otherwise(0.0)))))
    return F.when(top + r_deg < 89.999, F.greatest(F.floor(360 / reach), F.lit(1))).otherwise(1).cast("long")


def cell_of(ra: Column, cells: Column) -> Column:
    return F.least(F.floor(F.pmod(ra, F.lit(360.0)) / 360 * cells).cast("long"), cells - 1)
