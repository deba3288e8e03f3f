"""Scans of catalogs, exposure lists and products, and user input, all from files that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import STAR_PROBABILITY, UJY_PER_NMGY, VEGA_AB
from ..functions import sky, stats, units
from ..operators import flags, models
from ..operators.tiles import standard_columns
from ..functions.cut import cut

def source_catalog(catalogue: DataFrame, morphology: DataFrame, ra: float, dec: float, half_deg: float, brightness_cut_ujy: float = 0.0, require_band: str | None = None, most: int | None = None) -> DataFrame:
    """Left join on object_id, circle and box, flux cut, brightest first, is_star. `most` is a cap that the caller asks for."""
    inside = sky.in_circle(F.col("ra"), F.col("dec"), ra, dec, half_deg * 3600) & sky.box(F.col("ra"), F.col("dec"), ra, dec, half_deg)
    c = catalogue.where(inside & (F.col("flux_vis_psf") > brightness_cut_ujy))
    if require_band:
        c = c.where(F.col(f"flux_{require_band.lower()}_templfit") > 0)
    out = c.join(morphology, "object_id", "left").withColumn("is_star", units.known(F.col("point_like_prob"), 0.0) > STAR_PROBABILITY).orderBy(F.desc("flux_vis_psf"), "object_id")
    return out.limit(most) if most else out


def unwise_catalog(cat: DataFrame, ra: float, dec: float, radius_arcsec: float) -> DataFrame:
    """Primary rows in a circle, with AB microjansky columns from Vega nanomaggies."""
    out = cat.where(sky.in_circle(F.col("ra"), F.col("dec"), ra, dec, radius_arcsec) & ((F.col("primary_1") == 1) | (F.col("primary_2") == 1)))
    cols = {}
    for k, b in ((1, "W1"), (2, "W2")):
        cols |= {f"{b.lower()}_ujy": units.vega_nmgy_to_ujy(F.col(f"flux_{k}"), b), f"{b.lower()}_err_ujy": units.vega_nmgy_to_ujy(F.col(f"dflux_{k}"), b)}
    return out.withColumns(cols)


def dawn_region(cat: DataFrame, ra: float, dec: float, radius_arcsec: float) -> DataFrame:
    """Box, then circle; only the standard columns, found under any case."""
    names = {"dawn_id": ("ID", "dawn_id"), "dawn_ra": ("RA", "dawn_ra"), "dawn_dec": ("DEC", "dawn_dec")} | {f"dawn_{q}_IRAC{k}_ujy": (f"{q}_IRAC{k}", f"dawn_{q}_IRAC{k}_ujy") for k in (1, 2) for q in ("flux", "flux_err")}
    return standard_columns(cat, names).where(sky.in_circle(F.col("dawn_ra"), F.col("dawn_dec"), ra, dec, radius_arcsec))


def ebv_column(cat: DataFrame, field_value: float | None = None) -> DataFrame:
    """cat with ebv: the source's own (missing ones take the median), else the field's value, else null."""
    if "gal_ebv" not in cat.columns:
        return cat.withColumn("ebv", F.lit(field_value).cast("double"))
    own = F.when(units.finite(F.col("gal_ebv")), F.col("gal_ebv"))
    (middle,) = stats.whole_quantiles(cat, F.col("gal_ebv"), [0.5])
    return cat.withColumn("ebv", F.coalesce(own, F.lit(middle).cast("double"), F.lit(field_value).cast("double")))


def synthetic_catalog(coords: DataFrame) -> DataFrame:
    """User coordinates as a catalog: stable ids, flux 1 where none is given."""
    return models.from_coords(coords).select("id", "ra", "dec", "flux")


def outside_neighbours(cat: DataFrame, prior: DataFrame, ra: float, dec: float, half_deg: float, buffer_arcsec: float, band: str) -> DataFrame:
    """Point models (flux 1 where unknown, is_neighbour) of the ring around a field, as the wide-PSF fits take along."""
    from ..operators.matching import ring_neighbours

    ring = ring_neighbours(cat, prior, ra, dec, half_deg, buffer_arcsec)
    return ring.select("id", "ra", "dec", units.known(F.col(f"{band.lower()}_ujy"), 1.0).alias("flux"), F.lit("PointSource").alias("model"), F.lit(True).alias("is_neighbour"))


# -- exposure lists ------------------------------------------------------------------------


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def reference_pointings(rows: DataFrame, ra: float, dec: float, radius_deg: float) -> DataFrame:
    """Exposures (filename, exptime, wcs) of a table with Filename, EXPTIME, RARFND, DECRFND and a CD matrix in any case."""
    t = standard_columns(rows, {"filename": ("Filename",), "exptime": ("EXPTIME",), "crval1": ("RARFND",), "crval2": ("DECRFND",), "cd11": ("CD11RFND",), "cd12": ("CD12RFND",), "cd21": ("CD21RFND",), "cd22": ("CD22RFND",)})
    t = t.select("filename", *[F.col(c).cast("double").alias(c) for c in t.columns if c != "filename"])
    ok = F.col("exptime") > 0
    for c in ("crval1", "crval2", "cd11", "cd12", "cd21", "cd22"):
        ok = ok & units.finite(F.col(c))
    return t.where(ok & sky.in_circle(F.col("crval1"), F.col("crval2"), ra, dec, radius_deg * 3600))


def exposure_table(spark: SparkSession, path: str, ra: float, dec: float, radius_deg: float, scale_arcsec: float = 1.22) -> DataFrame:
    """White-space columns MJD RA DEC PA EXPTIME (# comments): exposures with the CD matrix of their position angle."""
    p = F.split("line", r"\s+")
    t = _text(spark, path).where(~F.col("line").startswith("#")).select(*[F.try_element_at(p, F.lit(k + 1)).try_cast("double").alias(n) for k, n in enumerate(("mjd", "crval1", "crval2", "pa", "exptime"))]).where("exptime is not null")
    a, s = F.radians("pa"), scale_arcsec / 3600
    t = t.withColumns({"cd11": -s * F.cos(a), "cd12": s * F.sin(a), "cd21": s * F.sin(a), "cd22": s * F.cos(a), "mission": F.when(F.col("mjd") >= 54966, "warm").otherwise("cryo")})
    return t.where(sky.in_circle(F.col("crval1"), F.col("crval2"), ra, dec, radius_deg * 3600))


def exposure_files(spark: SparkSession, path: str) -> DataFrame:
    """A list of exposure file names, one a line: name, AOR and exposure number from it, first occurrence alone."""
    t = _text(spark, path).where(~F.col("line").startswith("\\") & ~F.col("line").startswith("|")).select(F.regexp_extract("line", r"(\S+\.fits)", 1).alias("filename")).where("filename <> ''")
    return t.select("filename", F.regexp_extract("filename", r"_(\d{5,9})_", 1).alias("aor"), F.regexp_extract("filename", r"_(\d{4})_\d+_", 1).alias("exposure")).distinct()


def covered(sources: DataFrame, exposures: DataFrame, width: int = 256, height: int = 256, margin: float = 0.0) -> DataFrame:
    """Rows of sources (ra, dec) on the detector of one exposure at least, from edge to edge of its pixels less a margin (pixels). Sources meet the exposures whose centre is within a detector's diagonal, by cells."""
    from ..operators import matching

    fields = ("crval1", "crval2", "cd11", "cd12", "cd21", "cd22")
    e = exposures.select(F.monotonically_increasing_id().alias("id"), F.col("crval1").cast("double").alias("ra"), F.col("crval2").cast("double").alias("dec"), *[F.col(c).cast("double").alias(c) for c in fields])
    scale = F.max(F.sqrt(F.abs(F.col("cd11") * F.col("cd22") - F.col("cd12") * F.col("cd21"))))
    widest = e.agg(scale).head()[0]
    if widest is None:
        return sources.limit(0)
    s = cut(sources.withColumn("_row", F.monotonically_increasing_id()))
    near = matching.pairs(s.select(F.col("_row").alias("id"), "ra", "dec"), cut(e), 0.75 * max(width, height) * widest * 3600, left_cols=("ra", "dec"), right_cols=fields)
    w = {k: F.col(f"right_{k}") for k in fields} | {"crpix1": F.lit((width - 1) / 2), "crpix2": F.lit((height - 1) / 2)}
    p = sky.sky_to_pixel(F.col("left_ra"), F.col("left_dec"), w)
    hit = near.where(p["x"].between(margin - 0.5, width - 0.5 - margin) & p["y"].between(margin - 0.5, height - 0.5 - margin)).select(F.col("left_id").alias("_row")).distinct()
    return s.join(hit, "_row", "left_semi").drop("_row")


def prior_square(images: DataFrame, padding_arcsec: float = 5.0) -> DataFrame:
    """id, ra, dec (four decimals) and size_arcsec (full tens): the square on the sky about the centre of an image (id, width, height, crval1 .. cd22) that holds its edge, however it is turned, and a margin."""
    w = {k: F.col(k) for k in sky.WCS_FIELDS}
    centre = sky.pixel_to_sky((F.col("width") - 1) / 2, (F.col("height") - 1) / 2, w)
    share = [k / 4 for k in range(5)]
    edge = F.explode(F.array(*(F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u in share for v in share if u in (0, 1) or v in (0, 1))))
    p = images.withColumns({"_ra": F.round(centre["ra"], 10), "_dec": centre["dec"], "_e": edge})
    at = sky.pixel_to_sky(F.col("_e.u") * F.col("width") - 0.5, F.col("_e.v") * F.col("height") - 0.5, w)
    p = p.withColumns({"_a": F.radians(at["ra"] - F.col("_ra")), "_d": F.radians(at["dec"]), "_d0": F.radians("_dec")})
    east = F.atan2(F.cos("_d") * F.sin("_a"), F.sin("_d0") * F.sin("_d") + F.cos("_d0") * F.cos("_d") * F.cos("_a"))
    north = F.asin(F.cos("_d0") * F.sin("_d") - F.sin("_d0") * F.cos("_d") * F.cos("_a"))
    reach = F.max(F.greatest(F.abs(F.degrees(east)), F.abs(F.degrees(north)))) * 3600
    return p.groupBy("id", F.round("_ra", 4).alias("ra"), F.round("_dec", 4).alias("dec")).agg((10.0 * F.ceil(F.round(2 * (reach + padding_arcsec), 6) / 10)).alias("size_arcsec"))


def without_keys(headers: DataFrame, *names: str, column: str = "header") -> DataFrame:
    """headers with map entries of these names (in any case) left out, as readers of a projection want it."""
    low = [n.lower() for n in names]
    return headers.withColumn(column, F.map_filter(column, lambda k, v: ~F.lower(k).isin(low)))


def cutout_request(ra, dec, size_pix, bands, base: str):
    """The address of a cutout service's answer for a position, a size in pixels and bands."""
    return F.format_string(base + "?ra=%.5f&dec=%.5f&size=%d&bands=%s", ra, dec, size_pix, bands)


# -- products -----------------------------------------------------------------------------------


def cutout_urls(xml: DataFrame) -> DataFrame:
    """(field, url, kind) of a cutout service's answers (column xml): one row per image node."""
    node = F.explode(F.expr("xpath(xml, '//image/@url')")).alias("url")
    return xml.select(F.expr("xpath_string(xml, '//field/@name')").alias("field"), node).withColumn("kind", F.regexp_extract("url", r"_(\w+)\.fits", 1))


def basic_products(urls: DataFrame) -> DataFrame:
    """Mosaic products with all four kinds, by distance, AOR and root."""
    from ..operators.tiles import grouped_products

    g = grouped_products(urls, r"(SPITZER_I\d_\d+_\d+_\d+_E\d+)_(maic|munc|mcov|mmsk)\.fits", ["maic", "munc", "mcov", "mmsk"])
    return g.withColumn("aor", F.regexp_extract("root", r"SPITZER_I\d_(\d+)_", 1)).orderBy("sep", "aor", "root")


def manifest(products: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON line per product and a SHA-256 key over the named columns."""
    return products.select(F.sha2(F.concat_ws("|", *keys), 256).alias("key"), F.to_json(F.struct(*products.columns)).alias("json"))


def user_image(pixels: DataFrame, unit_ujy: float) -> DataFrame:
    """Science and 1-sigma uncertainty in microjanskys; weight 0 where the uncertainty is not positive and finite."""
    d, s = F.col("d") * unit_ujy, F.col("sigma") * unit_ujy
    return pixels.withColumns({"d": d, "sigma": s, "w": units.invvar_from_rms(s, d)})


def first_of(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


WISE_NMGY = {b: UJY_PER_NMGY * 10 ** (-0.4 * v) for b, v in VEGA_AB.items()}
probable_stars = flags.probable_stars


def scene(cat: DataFrame, wcs: dict, width: int, height: int, margin_arcsec: float = 5.0) -> DataFrame:
    """Rows of positive finite flux on the image or within a margin around it, with x and y, brightest first."""
    w = sky.wcs(**wcs)
    p = sky.sky_to_pixel(F.col("ra"), F.col("dec"), w)
    out = cat.where(units.finite(F.col("flux")) & (F.col("flux") > 0)).withColumns({"x": p["x"], "y": p["y"], "_m": margin_arcsec / sky.pixel_scale_arcsec(w)})
    inside = (F.col("x") >= -F.col("_m")) & (F.col("x") < width + F.col("_m")) & (F.col("y") >= -F.col("_m")) & (F.col("y") < height + F.col("_m"))
    return out.where(F.coalesce(inside, F.lit(False))).drop("_m").orderBy(F.desc("flux"), "id")
