"""Command line: python -m fluxloom.cli run CATALOG IMAGE OUTPUT --ra --dec ..."""

from __future__ import annotations

import argparse

#: Microjanskys of a unit of an image's pixels: fixed values.
UNITS = {"uJy": 1.0, "nanomaggy": 3.631, "mJy": 1e3, "Jy": 1e6}
#: What a band of its own may state beside its image.
OF_BAND = ("rms", "rms_image", "variance_image", "psf", "psf_fwhm", "unit")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fluxloom")
    run = p.add_subparsers(dest="command", required=True).add_parser("run", help="forced photometry of one field")
    run.add_argument("catalog", help="parquet, or FITS table, with id, ra, dec, flux and shape columns; - with --coords")
    run.add_argument("image", help="FITS image")
    run.add_argument("output", help="catalog; the format (parquet, csv, json, orc, ecsv, fits) follows from the name")
    for name in ("ra", "dec", "size"):
        run.add_argument(f"--{name}", type=float, required=name != "size", default=50.0)
    run.add_argument("--rms", type=float, default=1.0, help="noise of a pixel")
    noise = run.add_mutually_exclusive_group()
    noise.add_argument("--rms-image", help="FITS image of each pixel's noise")
    noise.add_argument("--variance-image", help="FITS image of each pixel's variance")
    shape = run.add_mutually_exclusive_group()
    shape.add_argument("--psf-fwhm", type=float, default=2.0, help="pixels")
    shape.add_argument("--psf", help="FITS image of the PSF")
    run.add_argument("--unit", default="uJy", help=f"of the image: {', '.join(UNITS)} or a number of microjanskys")
    run.add_argument("--background", choices=("none", "mesh"), default="none", help="taken from each image before the fit")
    run.add_argument("--calibrate", action="store_true", help="scale errors by fits at empty positions")
    run.add_argument("--band", default="VIS")
    run.add_argument("--prior", choices=("catalog", "tree"), default="catalog")
    run.add_argument("--no-flags", action="store_true")
    run.add_argument("--tile", type=int, default=1024, help="side of the tiles in which detections are searched")
    run.add_argument("--more", action="append", default=[], metavar="BAND=IMAGE[;KEY=VALUE...]", help=f"another band; keys are {', '.join(OF_BAND)}, and what is not stated is as in the first band. May be repeated")
    run.add_argument("--coords", help="parquet, CSV, JSON or FITS table of ra and dec in the catalog's place")
    return p


def of_band(text: str, a: argparse.Namespace) -> tuple[str, str, dict]:
    """Name, image and settings of a --more; noise and PSF are taken from the first band only where none is stated."""
    (name, image), *pairs = (part.split("=", 1) for part in text.split(";"))
    stated = dict(pairs)
    if wrong := set(stated) - set(OF_BAND):
        raise SystemExit(f"--more {name}: unknown {', '.join(sorted(wrong))}")
    s = {k: getattr(a, k) for k in OF_BAND}
    for group in (("rms", "rms_image", "variance_image"), ("psf", "psf_fwhm")):
        if set(group) & set(stated):
            s |= dict.fromkeys(group)
    return name, image, s | stated


def microjanskys(unit: str) -> float:
    try:
        return UNITS[unit] if unit in UNITS else float(unit)
    except ValueError:
        raise SystemExit(f"unit {unit!r}") from None


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .config import RunConfig
    from .functions import units
    from .operators import detect, psf
    from .plans import pipeline
    from .sources import fits, fits_tables, sinks

    spark = SparkSession.builder.getOrCreate()
    fits.register(spark)

    def size(image: str) -> tuple[int, int]:
        with fits.open_input(image) as f:
            return fits.size_of(fits.image_unit(f)[0])

    def band(name: str, image: str, s: dict) -> pipeline.Band:
        with fits.open_input(image) as f:
            head, _ = fits.image_unit(f)
        wcs, unit = fits.wcs_of(head), microjanskys(s["unit"])
        rows = spark.read.format("fits_image").load(image)
        noise, value = s["rms_image"] or s["variance_image"], F.col("p.values")
        if noise:
            if size(noise) != size(image):
                raise SystemExit(f"{noise} is not of the size of {image}")
            rows = rows.join(spark.read.format("fits_image").load(noise).select("y", F.col("values").alias("noise")), "y")
            rms = F.col("p.noise") if s["rms_image"] else F.sqrt(F.greatest("p.noise", F.lit(0.0)))
        else:
            rows, rms = rows.withColumn("noise", F.array().cast("array<double>")), F.lit(float(s["rms"]))
        px = rows.select(F.lit(0).cast("long").alias("tile"), "y", F.posexplode(F.arrays_zip("values", "noise")).alias("x", "p"))
        px = px.select("tile", "x", "y", value.alias("d"), units.invvar_from_rms(rms, value).alias("w")).withColumn("d", units.known(F.col("d"), 0.0))
        stamp = pipeline.gaussian_psf(float(s["psf_fwhm"])) if not s["psf"] else psf.odd_trimmed(fits.rows_of(s["psf"], None, 0, size(s["psf"])[1])[1])
        scale = abs(wcs["cd11"] * wcs["cd22"] - wcs["cd12"] * wcs["cd21"]) ** 0.5 * 3600
        return pipeline.Band(name, detect.without_background(px, a.background), stamp, wcs, *fits.size_of(head), scale, unit, inflate="empty" if a.calibrate else "none")

    def rows_of(path: str):
        kind = path.rsplit(".", 1)[-1].lower()
        read = spark.read.option("header", True).option("inferSchema", True)
        return read.csv(path) if kind == "csv" else spark.read.json(path) if kind == "json" else fits_tables.read_table(spark, path) if kind in ("fits", "fit") else spark.read.parquet(path)

    bands = [band(a.band, a.image, {k: getattr(a, k) for k in OF_BAND}), *(band(*of_band(more, a)) for more in a.more)]
    cfg = RunConfig(a.ra, a.dec, a.size, tuple(b.name for b in bands), {"mode": "coords" if a.coords else a.prior}, with_flags=not a.no_flags)
    coords = rows_of(a.coords) if a.coords else None
    rows = None if a.coords else rows_of(a.catalog)
    out = pipeline.run(cfg, bands, rows, coords, calibrate=a.calibrate, tile=a.tile).table(cfg.with_flags)
    sinks.write_catalog(out, a.output, {"ra": a.ra, "dec": a.dec, "size_arcsec": a.size, "band": a.band, "bands": list(cfg.bands), "prior": cfg.prior["mode"]})


if __name__ == "__main__":
    main()
