"""One call: source list, prior fit, other bands, calibration, catalog. Each stage is a DataFrame; stages that others join or repeat are cut from their lineage by checkpoints."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import sky, stats, units
from ..operators import catalog, detect, fit, flags, inject, matching, models, psf, render, solve
from ..operators.tiles import weighted
from ..functions.cut import cut


@dataclass
class Band:
    """One band's pixels (tile, x, y, d, rms, flag or d, w), PSF stamp, geometry and scale."""

    name: str
    pixels: DataFrame
    psf: np.ndarray
    wcs: dict
    width: int
    height: int
    scale_arcsec: float = 0.1
    ujy_per_unit: float = 1.0
    sky: bool = False
    inflate: str = "none"  # none, residuals or empty
    extra_mask: DataFrame | None = None
    psf_samples: DataFrame | None = None  # id, x, y, stamp, width: the PSF by place; psf is then where there is none

    def weights(self) -> DataFrame:
        px = self.pixels if "w" in self.pixels.columns else weighted(self.pixels.withColumn("band", F.lit(self.name)), self.extra_mask)
        return px.select("tile", "x", "y", "d", "w")


@dataclass
class Result:
    sources: DataFrame
    measurements: DataFrame  # id, band, flux, err, factor
    neighbours: DataFrame
    trials: DataFrame | None = None
    bands: dict[str, Band] = field(default_factory=dict)

    def table(self, with_flags: bool = True) -> DataFrame:
        """The wide catalog."""
        names = list(self.bands)
        out = catalog.wide_catalog(self.measurements, names).join(self.sources.select("id", "tile", "ra", "dec", "x", "y", "model", "is_star", F.col("re").alias("re_pix")), "id")
        if with_flags:  # flags join the catalog with itself: solve once
            out = cut(out)
            b = self.bands[names[0]]
            f = out.withColumns({"flux": F.col(f"flux_{names[0].lower()}_ujy"), "re": F.coalesce("re_pix", F.lit(0.0)) * b.scale_arcsec})
            bad = b.weights().where("w <= 0").select("tile", "x", "y")
            out = flags.source_flags(cut(flags.blend_flags(f)), bad, b.width, b.height).drop("flux", "re")
        return out


    def images(self, name: str) -> DataFrame:
        """A band's pixels with model, residual and chi, in microjanskys."""
        b = self.bands[name]
        first = next(iter(self.bands.values()))
        src = self.sources if b is first else place(self.sources.drop("x", "y"), b).withColumn("re", F.col("re") * first.scale_arcsec / b.scale_arcsec)
        t = inject.rendered(src, b.psf, b.width, b.height)
        f = self.measurements.where(F.col("band") == name).select("id", (F.col("flux") / b.ujy_per_unit).alias("flux")).join(src.select("id", "tile"), "id")
        out = solve.residuals(b.weights(), solve.model_image(t, f))
        return out.withColumns({c: F.col(c) * b.ujy_per_unit for c in ("d", "model", "residual")}).withColumn("w", F.col("w") / b.ujy_per_unit**2)


def prior_unless_known(src: DataFrame, existing: DataFrame | None, make) -> DataFrame:
    """existing, if it has a row for just the ids of src; else make(src)."""
    if existing is not None:
        both = src.select("id").withColumn("_a", F.lit(1)).join(existing.select("id").withColumn("_b", F.lit(1)), "id", "full_outer")
        if not both.where("_a is null or _b is null").head(1):
            return existing
    return make(src)


def place(sources: DataFrame, band: Band, margin: float = -1.0) -> DataFrame:
    """Sources on the image with pixel positions; those off it (or closer than -margin to its edge) are dropped."""
    p = sky.sky_to_pixel(F.col("ra"), F.col("dec"), sky.wcs(**band.wcs))
    out = sources.withColumns({"x": p["x"], "y": p["y"]}).where(sky.footprint(F.col("x"), F.col("y"), band.width, band.height, margin))
    return out if "tile" in sources.columns else out.withColumn("tile", F.lit(0).cast("long"))


def prior_sources(cfg: RunConfig, catalog_rows: DataFrame | None, coords: DataFrame | None, band: Band) -> DataFrame:
    """Source models of the prior band: from catalog rows, from coordinates, or from detections refined by the tree (see run)."""
    if cfg.prior["mode"] == "coords":
        if coords is None:
            raise ValueError("mode coords needs coordinates")
        src = models.from_coords(coords, cfg.prior["force_model"] or "PointSource").withColumn("is_star", F.lit(False))
    else:
        if catalog_rows is None:
            raise ValueError(f"mode {cfg.prior['mode']} needs a catalog")
        c = catalog_rows.where(sky.box(F.col("ra"), F.col("dec"), cfg.ra, cfg.dec, cfg.size_arcsec / 7200) & (F.col("flux") > cfg.brightness_cut_ujy))
        if cfg.max_rows is not None:  # a cap that the settings ask for
            c = c.orderBy(F.desc("flux"), "id").limit(cfg.max_rows)
        src = models.from_catalog(c, force_model=cfg.prior["force_model"]).withColumn("is_star", units.known(F.col("point_like_prob"), 0.0) > 0.96)
    src = place(src, band).withColumn("re", F.col("re") / band.scale_arcsec)
    if cfg.prior["mode"] == "coords" and not src.head(1):
        raise ValueError("no coordinate lies on the image")
    return src.select("id", "tile", "ra", "dec", "x", "y", "model", "re", "ab", "pa", "n", "flux", "is_star")


def solve_band(src: DataFrame, band: Band) -> DataFrame:
    """(id, band, flux, err, factor) in microjanskys for every source on the band's image. A flux that is negative or absurd against the prior keeps its row, with null error. Sky and inflation are those of the whole image, whatever its size."""
    px = band.weights()
    px = cut(px)
    if band.psf_samples is not None:
        src = cut(psf.with_stamps(src, band.psf_samples))
    t = cut(inject.rendered(src, band.psf, band.width, band.height))  # the solve reads both several times
    f = solve.solve_fluxes(t, px, sky=band.sky)
    own = f.where(F.col("id") != solve.SKY)
    factor = F.lit(1.0)
    if band.inflate == "residuals":
        light = solve.model_image(t, own)
        level = f.where(F.col("id") == solve.SKY).select("tile", F.col("flux").alias("sky")) if band.sky else px.select("tile").distinct().withColumn("sky", F.lit(0.0))
        res = px.join(light, ["tile", "x", "y"], "left").join(level, "tile").select("tile", F.col("d").alias("data"), (F.coalesce("model", F.lit(0.0)) + F.col("sky")).alias("model"), F.col("w").alias("weight"), "sky")
        own = own.join(stats.chi_inflation(res, ["tile"]).select("tile", "inflation"), "tile", "left")
        factor = F.coalesce("inflation", F.lit(1.0))
    err = F.when(F.col("information") > 0, factor / F.sqrt(F.when(F.col("information") > 0, F.col("information"))))
    m = own.join(src.select("id", F.col("flux").alias("prior_flux")).distinct(), "id")
    flux = F.col("flux") * band.ujy_per_unit
    bad = models.unphysical(flux, F.col("prior_flux"))
    return m.select("id", F.lit(band.name).alias("band"), flux.alias("flux"), F.when(~bad, err * band.ujy_per_unit).alias("err"), factor.alias("factor"))


def empty_factors(band: Band, src: DataFrame, n: int = 200, avoid: float = 15.0) -> DataFrame:
    """(band, factor) from point fits at empty positions."""
    px = band.weights()
    spots = inject.empty_positions(px, src, n, avoid, edge=min(20, band.width // 8))
    blank = {"model": F.lit("PointSource"), "re": F.lit(None).cast("double"), "ab": F.lit(None).cast("double"), "pa": F.lit(None).cast("double"), "n": F.lit(None).cast("double")}
    both = spots.select("tile", "id", "x", "y").withColumns(blank)
    f = solve.solve_fluxes(inject.rendered(both, band.psf, band.width, band.height), px, sky=band.sky).where(F.col("id") != solve.SKY)
    m = f.where("information > 0").select(F.lit(band.name).alias("band"), "flux", (1 / F.sqrt("information")).alias("err"))
    return inject.empty_inflation(m, ["band"]).select("band", "factor")


def tree_models(src: DataFrame, band: Band, tile: int) -> tuple[DataFrame, DataFrame]:
    """Models of the sources chosen by the tree, and its trials. Sources in no blob keep their own."""
    px = band.weights()
    dets, segs = detect.found(px, tile=tile)
    where = detect.assign_to_blobs(src, segs, dets).where("blob is not null").select("tile", "blob", "id", "x", "y", "re", "segment")
    near = px.join(segs, ["tile", "x", "y"]).select("tile", "blob", "x", "y", "d", "w", "segment")
    chosen = cut(fit.select_models(where, near, band.psf, band.scale_arcsec))
    new = chosen.select("id", *[F.col(c).alias(f"_{c}") for c in ("model", "re", "ab", "pa", "n")])
    out = src.join(new, "id", "left")
    out = out.withColumns({c: F.coalesce(f"_{c}", c) for c in ("model", "re", "ab", "pa", "n")}).drop(*[f"_{c}" for c in ("model", "re", "ab", "pa", "n")])
    return out, chosen.select("id", F.explode("trials").alias("t")).select(F.col("id").alias("source_id"), "t.stage", "t.model", F.col("t.rchi2").alias("chi2"))


def run(cfg: RunConfig, bands: list[Band], catalog_rows: DataFrame | None = None, coords: DataFrame | None = None, neighbours: dict[str, DataFrame] | None = None, calibrate: bool = False, tile: int | None = 1024, at_once: int = 4, known: DataFrame | None = None) -> Result:
    """Forced photometry of one field (or of many images of equal geometry, which their column tile tells).

    Images are searched for detections in tiles of `tile` pixels; no result depends on it.
    `at_once` bands are solved at a time.

    The first band is the prior band. Positions and shapes are fixed there; other
    bands solve fluxes alone, with the outside neighbours (id, ra, dec, flux) they
    are given, which are not reported. known: the sources of an earlier run (its result's
    `sources`); they are taken as they are, without another fit, if they are just these.
    """
    if not bands or {b.name for b in bands} - set(cfg.bands):
        raise ValueError("bands and settings differ")
    prior, trials = bands[0], None
    src = prior_sources(cfg, catalog_rows, coords, prior)
    def fitted(src: DataFrame) -> DataFrame:
        nonlocal trials
        if cfg.prior["mode"] == "tree":
            src, trials = tree_models(src, prior, tile or detect.TILE)
        for what in [w for w, on in (("shapes", cfg.prior["free_shapes"]), ("positions", cfg.prior["refine_positions"])) if on]:
            moved = fit.refit(src, prior.weights(), prior.psf, prior.scale_arcsec, what, cfg.prior["flux_floor_ujy"])
            src = src.drop("x", "y", "model", "re", "ab", "pa", "n", "flux").join(moved.select("id", "x", "y", "model", "re", "ab", "pa", "n", "flux"), "id")
        return src

    src = prior_unless_known(src, known, fitted)
    src = cut(src)  # every band renders from it

    def one(b: Band) -> tuple[DataFrame, DataFrame | None]:
        """A band's measurements, and those of its neighbours."""
        own = src if b is prior else place(src.drop("x", "y"), b).withColumn("re", F.col("re") * prior.scale_arcsec / b.scale_arcsec)
        extra, rows, lost = (neighbours or {}).get(b.name), own, None
        if extra is not None:
            e = place(extra, b, margin=4 * b.psf.shape[0])
            e = e.select("id", "tile", "x", "y", "flux").withColumns({"model": F.lit("PointSource"), "is_neighbour": F.lit(True)})
            rows = catalog.outer_union(own, e)
        m = solve_band(rows, b)
        if extra is not None:
            m, lost = (part.drop("is_neighbour") for part in catalog.split_neighbours(m.join(rows.select("id", "is_neighbour"), "id")))
        if calibrate and b.inflate == "empty":
            m = catalog.recalibrated(m, empty_factors(b, own))
        return cut(m), lost

    measured, outside = None, None
    with ThreadPoolExecutor(at_once) as pool:  # bands wait for one another's jobs no more than Spark's scheduler does
        for m, lost in pool.map(one, bands):
            measured = m if measured is None else measured.unionByName(m)
            if lost is not None:
                outside = lost if outside is None else outside.unionByName(lost)
    if outside is None:
        outside = measured.limit(0)
    return Result(src, measured, outside, trials, {b.name: b for b in bands})


def injection_recovery(cfg: RunConfig, bands: list[Band], catalog_rows: DataFrame, n: int, flux_range: tuple[float, float], seeds: list[int], n_bins: int = 4) -> DataFrame:
    """Recovery per flux bin of the prior band over seeded runs with injected points."""
    b = bands[0]
    spark, lo, hi = b.pixels.sparkSession, *flux_range
    truths, found = [], []
    for seed in seeds:
        truth = inject.truth_table(spark, n, b.width, b.height, {b.name: flux_range}, seed)
        p = sky.pixel_to_sky(F.col("x"), F.col("y"), sky.wcs(**b.wcs))
        truth = cut(truth.withColumns({"ra": p["ra"], "dec": p["dec"], "flux": F.col(f"flux_{b.name.lower()}")}))
        px = cut(inject.inject(b.weights(), inject.rendered(truth, b.psf, b.width, b.height), truth.withColumn("flux", F.col("flux") / b.ujy_per_unit), "flux"))
        rows = catalog.outer_union(catalog_rows, truth.select("id", "ra", "dec", "flux", F.lit(1.0).alias("point_like_prob")))
        got = run(cfg, [Band(**(b.__dict__ | {"pixels": px}))], rows)
        truths.append(truth.select("id", "flux"))
        found.append(got.measurements.join(truth.select("id"), "id", "left_semi"))
    return catalog.recovery(inject.union_of_runs(truths, 0), inject.union_of_runs(found, 0), lo, hi, n_bins)


def pixel_tiles(px: DataFrame, width: int, height: int, tile: int, halo: int) -> DataFrame:
    """Pixels sent to every tile whose halo holds them; places stay those of the image."""
    nx, ny = -(-width // tile), -(-height // tile)
    span = lambda c, n: F.sequence(F.greatest(F.floor((F.col(c) - halo) / tile), F.lit(0)).cast("int"), F.least(F.floor((F.col(c) + halo) / tile), F.lit(n - 1)).cast("int"))
    t = px.withColumn("_tx", F.explode(span("x", nx))).withColumn("_ty", F.explode(span("y", ny)))
    return t.withColumn("tile", (F.col("tile") * (nx * ny) + F.col("_ty") * nx + F.col("_tx")).cast("long")).drop("_tx", "_ty")


def ground_tiles(src: DataFrame, width: int, height: int, tile: int, halo: int) -> DataFrame:
    """Sources sent to every tile whose halo (grown by one more) holds them; core marks the one tile that reports each (half-open cores). With a column tile, an image's number, tiles are numbered through all images."""
    nx, ny = -(-width // tile), -(-height // tile)
    reach = 2 * halo
    span = lambda c, n: F.sequence(F.greatest(F.floor((F.col(c) - reach) / tile), F.lit(0)).cast("int"), F.least(F.floor((F.col(c) + reach) / tile), F.lit(n - 1)).cast("int"))
    s = src.where(sky.footprint(F.col("x"), F.col("y"), width, height, reach)).withColumn("tx", F.explode(span("x", nx))).withColumn("ty", F.explode(span("y", ny)))
    core = (F.least(F.floor(F.col("x") / tile), F.lit(nx - 1)) == F.col("tx")) & (F.least(F.floor(F.col("y") / tile), F.lit(ny - 1)) == F.col("ty"))
    image = F.col("tile") * (nx * ny) if "tile" in src.columns else F.lit(0)
    return s.withColumns({"tile": (image + F.col("ty") * nx + F.col("tx")).cast("long"), "core": core}).drop("tx", "ty")


def compare_catalogs(measured: DataFrame, reference: DataFrame, radius_arcsec: float, isolation_arcsec: float, snr: float = 5.0) -> DataFrame:
    """Nearest unshared matches of isolated, significant sources: ratio and difference in sigma (id, ra, dec, flux, err on both sides)."""
    iso = matching.isolated(measured, isolation_arcsec).where("isolated").drop("isolated")
    m = matching.nearest_unshared(iso, reference, radius_arcsec, ("flux", "err"))
    ok = m.where((F.col("flux") > snr * F.col("err")) & (F.col("match_flux") > snr * F.col("match_err")))
    return ok.withColumns({"ratio": F.col("flux") / F.col("match_flux"), "n_sigma": units.difference_sigma(F.col("flux"), F.col("match_flux"), F.col("err"), F.col("match_err"))})


def register_offsets(stars: DataFrame, dets: DataFrame, scale_arcsec: float, max_pix: float = 3.0, isolation_pix: float = 12.0) -> dict:
    """Median offset of detections from catalog stars, after a robust cut at max(0.3, 4 * 1.4826 * MAD) pixels. Positions in pixels; (n, dx, dy)."""
    as_sky = lambda df: df.select("id", (F.col("x") * scale_arcsec / 3600).alias("ra"), (F.col("y") * scale_arcsec / 3600).alias("dec"), "x", "y")
    alone = matching.second_nearest(as_sky(stars), isolation_pix * scale_arcsec).where("neighbour_sep = double('infinity')")
    m = matching.nearest_greedy(alone.drop("neighbour_sep"), as_sky(dets), max_pix * scale_arcsec, cols=("x", "y"))
    m = m.select((F.col("match_x") - F.col("x")).alias("dx"), (F.col("match_y") - F.col("y")).alias("dy"))
    m = cut(m)
    m = m.withColumn("r", F.hypot(F.col("dx") - middle_of(m, "dx"), F.col("dy") - middle_of(m, "dy")))
    kept = cut(m.where(F.col("r") <= F.greatest(F.lit(0.3), 4 * 1.4826 * middle_of(m, "r"))))
    if not (n := kept.count()):
        return {"n": 0, "dx": None, "dy": None}
    return {"n": n, "dx": stats.whole_quantiles(kept, F.col("dx"), [0.5])[0], "dy": stats.whole_quantiles(kept, F.col("dy"), [0.5])[0]}


def middle_of(m: DataFrame, value: str | Column) -> Column:
    """The whole table's median as a number (null of none), found without gathering it."""
    return F.lit(stats.whole_quantiles(m, F.col(value) if isinstance(value, str) else value, [0.5])[0]).cast("double")


def register_image(stars: DataFrame, dets: DataFrame, wcs: dict, width: int, height: int, least_flux: float = 1.0, max_pix: float = 3.0, least: int = 20, rounds: int = 6) -> dict:
    """A tangent projection refitted to detected centroids: wcs (crpix kept), n, and the median distance before and after (arcsec).

    stars: id, ra, dec, is_star, flux; dets: id, x, y, flag, a, b. Isolated stars on the
    image claim the usable detection nearest to where the given projection puts them; a
    robust common shift drops false matches. Each round solves the plane's six
    coefficients from sums over the matches, and moves the reference place by the
    constant terms.
    """
    p = sky.sky_to_pixel(F.col("ra"), F.col("dec"), sky.wcs(**wcs))
    s = flags.registration_stars(stars.withColumns({"x": p["x"], "y": p["y"]}), width, height, least_flux)
    flat = lambda df, *more: df.select("id", F.pmod(F.col("x") / 3600, F.lit(360.0)).alias("ra"), (F.col("y") / 3600).alias("dec"), *more)
    alone = matching.second_nearest(flat(s, F.col("ra").alias("a"), F.col("dec").alias("d"), "x", "y"), 12.0).where("neighbour_sep = double('infinity')")
    usable = flags.usable_detections(dets)
    m = matching.nearest_greedy(alone, flat(usable, "x", "y"), max_pix, cols=("x", "y")).select("a", "d", "x", "y", F.col("match_x").alias("mx"), F.col("match_y").alias("my"))
    m = cut(m)
    if m.count() < least:
        raise ValueError("too few isolated stars match detections")
    dx, dy = F.col("mx") - F.col("x"), F.col("my") - F.col("y")
    m = m.withColumn("r", F.hypot(dx - middle_of(m, dx), dy - middle_of(m, dy)))
    m = m.withColumn("off", F.abs(F.col("r") - middle_of(m, "r")))
    # fixed values: a common shift is cut at four robust deviations, 0.3 pixels at least
    m = cut(m.where(F.col("r") < F.greatest(F.lit(0.3), 4 * 1.4826 * middle_of(m, "off"))).select("a", "d", "x", "y", "mx", "my"))
    n = m.count()
    if n < least:
        raise ValueError("too few consistent matches")
    new = dict(wcs)
    for _ in range(rounds):
        unit = new | {"crpix1": 0.0, "crpix2": 0.0, "cd11": 1.0, "cd12": 0.0, "cd21": 0.0, "cd22": 1.0}
        q = sky.sky_to_pixel(F.col("a"), F.col("d"), sky.wcs(**unit))  # degrees on the plane
        t = m.select((F.col("mx") - wcs["crpix1"]).alias("u"), (F.col("my") - wcs["crpix2"]).alias("v"), q["x"].alias("xi"), q["y"].alias("eta"))
        names = ("uu", "uv", "vv", "u", "v", "uxi", "vxi", "xi", "ueta", "veta", "eta")
        one = {"uu": "u*u", "uv": "u*v", "vv": "v*v", "uxi": "u*xi", "vxi": "v*xi", "ueta": "u*eta", "veta": "v*eta"}
        g = t.agg(*[F.sum(F.expr(one.get(k, k))).alias(k) for k in names]).head()
        a = np.array([[g.uu, g.uv, g.u], [g.uv, g.vv, g.v], [g.u, g.v, n]])
        (c11, c12, e1), (c21, c22, e2) = (np.linalg.solve(a, np.array(b)) for b in ((g.uxi, g.vxi, g.xi), (g.ueta, g.veta, g.eta)))
        new |= {"cd11": float(c11), "cd12": float(c12), "cd21": float(c21), "cd22": float(c22)}
        back = m.sparkSession.range(1).select(*[c.alias(k) for k, c in sky.pixel_to_sky(F.lit(0.0), F.lit(0.0), sky.wcs(**(unit | {"crpix1": -float(e1), "crpix2": -float(e2)}))).items()]).head()
        new |= {"crval1": back.ra, "crval2": back.dec}
        if abs(e1) + abs(e2) < 1e-12:
            break
    after = sky.sky_to_pixel(F.col("a"), F.col("d"), sky.wcs(**new))
    scale = abs(new["cd11"] * new["cd22"] - new["cd12"] * new["cd21"]) ** 0.5 * 3600
    before, now = (stats.whole_quantiles(m, F.hypot(F.col("mx") - x, F.col("my") - y), [0.5])[0] for x, y in ((F.col("x"), F.col("y")), (after["x"], after["y"])))
    return {"wcs": new, "n": n, "before_arcsec": before * scale, "after_arcsec": now * scale}


gaussian_psf = render.gaussian_psf
