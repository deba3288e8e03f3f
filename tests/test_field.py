"""Detection, fits, PSFs, files and the one-call pipeline on synthetic fields."""

import gzip
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxloom import cli
from fluxloom.config import RunConfig
from fluxloom.functions import sky
from fluxloom.operators import detect, fit, inject, psf, render, solve
from fluxloom.plans import pipeline
from fluxloom.sources import catalogs, fits, sinks, tilezip

WCS = dict(crval1=269.5, crval2=67.3, crpix1=31.5, crpix2=31.5, cd11=-0.1 / 3600, cd12=0.0, cd21=0.0, cd22=0.1 / 3600)
PSF = render.gaussian_psf(2.5)
CATALOG = "id long, ra double, dec double, flux double, point_like_prob double, sersic_re double, sersic_n double, sersic_ab double, sersic_angle double, semimajor double, ellipticity double, position_angle double, pixel_scale double"


def image(sources, size=64, noise=0.3, seed=1, level=0.0):
    d = np.random.default_rng(seed).normal(level, noise, (size, size))
    for s in sources:
        d += s.flux * s.plane((size, size), PSF)
    return d


def pixel_table(spark, d, w):
    y, x = np.mgrid[: d.shape[0], : d.shape[1]]
    pdf = pd.DataFrame({"tile": 0, "x": x.ravel().astype("int32"), "y": y.ravel().astype("int32"), "d": d.ravel(), "w": np.broadcast_to(w, d.shape).ravel()})
    return spark.createDataFrame(pdf).withColumn("tile", F.col("tile").cast("long"))


def as_catalog(spark, sources):
    df = spark.createDataFrame([(s.id, s.x, s.y, s.flux, 0.99 if s.model == "PointSource" else 0.1, s.re * 0.1 or None, s.n if s.re else None, s.ab if s.re else None, -s.pa if s.re else None) for s in sources], "id long, x double, y double, flux double, point_like_prob double, sersic_re double, sersic_n double, sersic_ab double, sersic_angle double")
    p = sky.pixel_to_sky(F.col("x"), F.col("y"), sky.wcs(**WCS))
    return df.select("id", p["ra"].alias("ra"), p["dec"].alias("dec"), "flux", "point_like_prob", "sersic_re", "sersic_n", "sersic_ab", "sersic_angle", *[F.lit(None).cast("double").alias(c) for c in ("semimajor", "ellipticity", "position_angle")], F.lit(0.1).alias("pixel_scale"))


POINTS = [fit.Source(1, 20.3, 22.7, flux=60.0), fit.Source(2, 24.1, 23.0, flux=35.0), fit.Source(3, 45.6, 40.2, flux=80.0)]
GALAXY = fit.Source(4, 42.0, 15.0, "ExpGalaxy", re=4.0, ab=0.6, pa=30.0, flux=300.0)


def test_background_follows_a_gradient():
    y, x = np.mgrid[:200, :200]
    rng = np.random.default_rng(0)
    d = 5 + 0.01 * x + rng.normal(0, 1, (200, 200))
    plane, level, rms = detect.background_map(d, np.zeros(d.shape, bool), 50)
    assert abs(level - 6) < 0.2 and abs(rms - 1) < 0.1 and np.abs(plane - 5 - 0.01 * x)[20:-20, 20:-20].max() < 0.7
    assert np.ptp(detect.background_map(d, np.zeros(d.shape, bool), 300)[0]) == 0
    with pytest.raises(ValueError):
        detect.background_map(d, np.ones(d.shape, bool), 50)


def test_labels_and_dilation():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 0]], bool)
    assert detect.label(m).tolist() == [[1, 0, 0, 2], [0, 1, 0, 2], [0, 0, 0, 0], [3, 3, 0, 0]]
    assert detect.label(np.ones((2, 2), bool)).tolist() == [[1, 1], [1, 1]] and detect.label(np.zeros((2, 2), bool)).max() == 0
    one = np.zeros((7, 7), bool)
    one[3, 3] = True
    assert detect.dilated(one, 2).sum() == 13


def test_detection_finds_and_deblends(spark):
    d = image([*POINTS, GALAXY])
    px = pixel_table(spark, d, 1 / 0.09)
    found = detect.detections(px, kernel=PSF, threshold=4.0).toPandas()
    for s in [*POINTS, GALAXY]:
        assert np.hypot(found.x - s.x, found.y - s.y).min() < 1.0
    segs, src = detect.segments(px, kernel=PSF, threshold=4.0), spark.createDataFrame([(s.id, 0, s.x, s.y) for s in POINTS] + [(9, 0, 5.0, 55.0)], "id long, tile long, x double, y double")
    got = {r.id: r for r in detect.assign_to_blobs(src, segs, detect.detections(px, kernel=PSF, threshold=4.0)).collect()}
    assert got[1].blob == got[2].blob != got[3].blob and got[1].segment != got[2].segment and got[9].blob is None
    dets = detect.detections(px, kernel=PSF, threshold=4.0)
    some = detect.assign_to_blobs(src.where("id in (1, 3)"), segs, dets)
    extra = detect.unlisted(dets, some, segs, px, px.limit(0)).toPandas()
    assert len(extra) == 2  # the second point, and the galaxy whose light reaches the blob
    assert all(np.hypot(extra.x - s.x, extra.y - s.y).min() < 1 for s in (POINTS[1], GALAXY))


def test_tree_tells_points_from_galaxies():
    for true, model in ((fit.Source(1, 30.2, 31.4, flux=200.0), "PointSource"), (fit.Source(1, 31.0, 30.5, "ExpGalaxy", re=5.0, ab=0.5, pa=20.0, flux=900.0), "ExpGalaxy")):
        d = image([true], noise=0.2)
        seg = np.hypot(*(np.mgrid[:64, :64] - np.array([true.y, true.x])[:, None, None])) < 14
        got, trials = fit.tree(d, np.full(d.shape, 25.0), [fit.Source(1, true.x, true.y, re=3.0)], {1: seg}, PSF, 0.1)
        assert got[0].model in ((model,) if model == "PointSource" else ("ExpGalaxy", "SersicGalaxy", "CompositeGalaxy")) and abs(got[0].flux / true.flux - 1) < 0.1
        assert {t[1] for t in trials} >= {1, 2}


def test_free_shapes_and_positions(spark):
    d = image([GALAXY, POINTS[2]], noise=0.2)
    px = pixel_table(spark, d, 25.0)
    start = spark.createDataFrame([(0, 4, 42.0, 17.5, "ExpGalaxy", 2.5, 0.9, 10.0, 1.0, 250.0), (0, 3, 45.3, 40.0, "PointSource", None, None, None, None, 70.0)], "tile long, id long, x double, y double, model string, re double, ab double, pa double, n double, flux double")
    moved = {r.id: r for r in fit.refit(start, px, PSF, 0.1, "positions").collect()}
    assert moved[3].moved and abs(moved[3].x - 45.6) < 0.05 and abs(moved[3].y - 40.2) < 0.05
    assert not moved[4].moved and moved[4].y == 17.5  # not inside the margin
    out = fit.bounded_positions(d, np.full(d.shape, 25.0), [fit.Source(3, 44.0, 40.2), GALAXY], PSF, 0.5)
    assert math.hypot(out[0].x - 44.0, out[0].y - 40.2) <= 0.5 + 1e-9


def test_pipeline_recovers_fluxes(spark):
    src = [*POINTS, GALAXY]
    d, w = image(src), 1 / 0.09
    band = pipeline.Band("VIS", pixel_table(spark, d, w), PSF, WCS, 64, 64, inflate="residuals", sky=True)
    second = pipeline.Band("H", pixel_table(spark, image([fit.Source(**(s.__dict__ | {"flux": 2 * s.flux})) for s in src], seed=5), w), PSF, WCS, 64, 64)
    cfg = RunConfig(269.5, 67.3, 20.0, ("VIS", "H"))
    got = {r.id: r for r in pipeline.run(cfg, [band, second], as_catalog(spark, src)).table().collect()}
    assert set(got) == {1, 2, 3, 4}
    for s in src:
        assert abs(got[s.id].flux_vis_ujy - s.flux) < 5 * got[s.id].flux_err_vis_ujy + 0.02 * s.flux
        assert abs(got[s.id].flux_h_ujy - 2 * s.flux) < 5 * got[s.id].flux_err_h_ujy + 0.02 * s.flux
    assert got[1].blended and got[2].blended and not got[3].blended
    with pytest.raises(ValueError):
        pipeline.run(RunConfig(1, 1), [second], as_catalog(spark, src))


def test_tree_mode_and_neighbours(spark):
    src = [*POINTS, GALAXY]
    band = pipeline.Band("VIS", pixel_table(spark, image(src), 1 / 0.09), PSF, WCS, 64, 64)
    cfg = RunConfig(269.5, 67.3, 20.0, ("VIS",), {"mode": "tree"})
    r = pipeline.run(cfg, [band], as_catalog(spark, src))
    kinds = {x.id: x.model for x in r.sources.collect()}
    assert kinds[3] == "PointSource" and kinds[4] != "PointSource" and r.trials.count() > 4
    few = as_catalog(spark, [POINTS[0]])
    beside = as_catalog(spark, [POINTS[1]]).select("id", "ra", "dec", "flux")
    plain = RunConfig(269.5, 67.3, 20.0)
    alone = pipeline.run(plain, [band], few).measurements.head().flux
    both = pipeline.run(plain, [band], few, neighbours={"VIS": beside})
    assert [m.id for m in both.measurements.collect()] == [1] and [m.id for m in both.neighbours.collect()] == [2]
    assert abs(both.measurements.head().flux - 60) < abs(alone - 60)


def test_injection_recovery(spark):
    band = pipeline.Band("VIS", pixel_table(spark, image(POINTS), 1 / 0.09), PSF, WCS, 64, 64)
    out = {r.bin: r for r in pipeline.injection_recovery(RunConfig(269.5, 67.3, 20.0), [band], as_catalog(spark, POINTS), 12, (20, 100), [1, 2], 2).collect()}
    assert out[-1].n == 24 and out[-1].completeness > 0.8 and abs(out[-1].ratio_median - 1) < 0.1 and 0.4 < out[-1].pull_width < 2.5


def test_empty_positions(spark):
    d = image(POINTS, noise=0.3)
    px = pixel_table(spark, d, 1 / 0.15**2)
    src = spark.createDataFrame([(s.id, 0, s.x, s.y) for s in POINTS], "id long, tile long, x double, y double")
    at = inject.empty_positions(px, src, 30, 5.0, edge=6).toPandas()
    assert len(at) >= 20 and at.equals(inject.empty_positions(px, src, 30, 5.0, edge=6).toPandas())
    xy = at[["x", "y"]].to_numpy()
    assert min(np.hypot(*(a - b)) for i, a in enumerate(xy) for b in xy[:i]) > 5 and all(np.hypot(*(a - [s.x, s.y])) > 5 for a in xy for s in POINTS)
    band = pipeline.Band("VIS", px, PSF, WCS, 64, 64)
    assert abs(pipeline.empty_factors(band, src, 30, 5.0).head().factor - 2) < 0.7  # errors half as large as they should be


def test_ground_tiles_have_one_core(spark):
    s = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(np.random.default_rng(0).uniform(0, 99.9, (50, 2)))], "id long, x double, y double")
    t = pipeline.ground_tiles(s, 100, 100, 32, 5).toPandas()
    assert (t.groupby("id").core.sum() == 1).all() and len(t) > 50


def test_registration(spark):
    rng = np.random.default_rng(2)
    xy = rng.uniform(0, 1000, (40, 2))
    stars = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double")
    dets = spark.createDataFrame([(i, float(a + 0.7 + rng.normal(0, 0.05)), float(b - 0.4 + rng.normal(0, 0.05))) for i, (a, b) in enumerate(xy)], "id long, x double, y double")
    r = pipeline.register_offsets(stars, dets, 0.3)
    assert r["n"] > 20 and abs(r["dx"] - 0.7) < 0.05 and abs(r["dy"] + 0.4) < 0.05


def test_psf_tools(spark):
    g = render.resized(render.gaussian_psf(4.0), 41)
    assert abs(psf.resampled(g, 0.5, 61).sum() - 1) < 0.02 and abs(psf.integrated(g, 2.0, 21).sum() - 1) < 0.02
    assert np.abs(psf.rotated(g, 33) - g).max() < 5e-3 and psf.odd_trimmed(np.ones((4, 5))).shape == (3, 5)
    stars = lambda *images: spark.createDataFrame([(t, k, x, y, im.ravel().tolist()) for t, im, places in images for k, (x, y) in enumerate(places)], "tile long, id long, x double, y double, stamp array<double>")
    narrow, places = render.resized(render.gaussian_psf(3.0), 41), [(float(x), float(y)) for x in (10, 50, 90) for y in (10, 50, 90)]
    nothing = stars()
    scores = {r.tile: r.score for r in psf.comparison_scores(stars((0, g, [(0.0, 0.0)]), (1, narrow, [(0.0, 0.0)])), psf.as_table(nothing, g), 41, ["tile", "id"], 6).collect()}
    assert scores[0] < 1e-9 < scores[1] and psf.comparison_scores(nothing, psf.as_table(nothing, g), 41, ["tile", "id"]).count() == 0
    table = stars((0, g, places), (1, g, places[:3]), (2, g, places[:3]), (2, narrow, places[3:]))
    table = table.withColumn("id", F.col("x") * 100 + F.col("y"))
    assert {r.tile: r.verdict for r in psf.assess(table, g, 100, 100).collect()} == {0: "supplied", 1: "unverified", 2: "spatial"}
    assert {r.tile: r.verdict for r in psf.assess(table, render.resized(render.gaussian_psf(6.0), 41), 100, 100).collect()}[0] == "empirical"
    samples = spark.createDataFrame([(1, 10.0, 0.0, 2.0, [0.0, 1.0, 1.0]), (2, 10.0, 0.001, 3.0, [1.0, 1.0, 0.0]), (3, 11.0, 0.0, 9.0, [1.0, 1.0, 1.0]), (4, 10.0, 0.0, 2.0, [0.0, 0.0, 0.0])], "id long, ra double, dec double, fwhm double, stamp array<double>")
    near = psf.near_samples(samples, 10.0, 0.0, drop_blank=True)
    s = psf.summary(near).head()
    assert s.n == 2 and s.fwhm == 2.5 and [round(v, 6) for v in s.stamp] == [0.25, 0.5, 0.25]
    prfs = {(c, r): psf.comb_normalized(render.resized(render.gaussian_psf(9.0), 41)) for c in (25, 129, 233) for r in (25, 129, 233)}
    nodes = spark.createDataFrame([(1, 10.0, 0.0), (2, 40.0, 0.0)], "node long, ra double, dec double")
    exposures = spark.createDataFrame([(10.0, 0.0, 15.0, 30.0, 256, 256, 1.2), (10.01, 0.01, 80.0, 100.0, 256, 256, 1.2)], "ra0 double, dec0 double, pa double, exptime double, width int, height int, detector_scale double")
    grid = psf.stacked_grid(nodes, exposures, prfs, 0.6, 21).collect()
    assert [g.node for g in grid] == [1] and grid[0].n_exposures == 2 and abs(sum(grid[0].stamp) - 1) < 1e-9


def riced(values, size, block=32):
    """A Rice-coded tile, bit by bit as text; each block takes its cheapest selector."""
    select, most = tilezip._RICE[size]
    whole = 8 * size
    bits = [format(int(values[0]) % (1 << whole), f"0{whole}b")]
    last = int(values[0])
    for at in range(0, len(values), block):
        steps = []
        for v in map(int, values[at : at + block]):
            d = (v - last + (1 << (whole - 1))) % (1 << whole) - (1 << (whole - 1))
            steps.append(2 * d if d >= 0 else -2 * d - 1)
            last = v
        if not any(steps):
            bits.append("0" * select)
            continue
        costs = {low: sum((x >> low) + 1 + low for x in steps) for low in range(most)}
        low = min(costs, key=costs.get)
        if costs[low] >= whole * len(steps):
            bits += [format(most + 1, f"0{select}b"), *(format(x, f"0{whole}b") for x in steps)]
        else:
            bits += [format(low + 1, f"0{select}b"), *("0" * (x >> low) + "1" + (format(x & ((1 << low) - 1), f"0{low}b") if low else "") for x in steps)]
    text = "".join(bits)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def compressed_file(path, w, h, bitpix, method, cells, more, columns=(), deep=1):
    """A FITS file whose second unit is tile-compressed. cells: bytes of each tile; columns: (name, letter, values)."""
    wide = 8 + 8 * len(columns)
    table, heap = b"", b""
    for k, data in enumerate(cells):
        table += np.array([len(data), len(heap)], ">i4").tobytes() + b"".join(np.array([v[k]], ">f8").tobytes() for _, _, v in columns)
        heap += data
    cards = ["XTENSION= 'BINTABLE'".ljust(80)] + [fits.card(k, v) for k, v in {"BITPIX": 8, "NAXIS": 2, "NAXIS1": wide, "NAXIS2": len(cells), "PCOUNT": len(heap), "GCOUNT": 1, "TFIELDS": 1 + len(columns), "TTYPE1": "COMPRESSED_DATA", "TFORM1": "1PB(9)"}.items()]
    cards += [fits.card(k, v) for n, (name, letter, _) in enumerate(columns, 2) for k, v in ((f"TTYPE{n}", name), (f"TFORM{n}", f"1{letter}"))]
    cards += [fits.card(k, v) for k, v in {"ZIMAGE": True, "ZBITPIX": bitpix, "ZNAXIS": 2, "ZNAXIS1": w, "ZNAXIS2": h, "ZTILE1": w, "ZTILE2": deep, "ZCMPTYPE": method, "EXTNAME": "PACKED", **more}.items()]
    head = fits.padded("".join([*cards, "END".ljust(80)]).encode(), b" ")
    with open(path, "wb") as f:
        f.write(fits.padded((fits.card("SIMPLE", True) + fits.card("BITPIX", 8) + fits.card("NAXIS", 0) + "END".ljust(80)).encode(), b" ") + head + fits.padded(table + heap, b"\0"))


def test_rice_tiles():
    rng = np.random.default_rng(1)
    for size, kind in ((4, "i4"), (2, "i2"), (1, "u1")):
        top = np.iinfo(kind).max
        for values in (rng.normal(0, 20, 500).astype(kind), np.zeros(70, kind), rng.integers(np.iinfo(kind).min, top, 333, dtype=kind, endpoint=True), np.array([5], kind), np.repeat(rng.integers(0, 9, 40), 7).astype(kind), np.array([top, np.iinfo(kind).min] * 40, kind)):
            assert (tilezip.unrice(riced(values, size), len(values), size) == values).all()


def test_compressed_units_are_their_plain_twins(spark, tmp_path):
    rng = np.random.default_rng(2)
    w, h = 50, 23
    image_ = np.cumsum(rng.integers(-9, 9, (h, w)), axis=1).astype(np.int32)
    gz = lambda b: gzip.compress(b)
    files = {}
    for name, method, deep, pack in (
        ("rice", "RICE_1", 1, lambda t: riced(t.ravel(), 4)),
        ("rows", "RICE_1", 5, lambda t: riced(t.ravel(), 4)),
        ("gzip", "GZIP_1", 2, lambda t: gz(t.astype(">i4").tobytes())),
        ("turned", "GZIP_2", 1, lambda t: gz(t.astype(">i4").view(np.uint8).reshape(-1, 4).T.tobytes())),
    ):
        files[name] = str(tmp_path / f"{name}.fits")
        compressed_file(files[name], w, h, 32, method, [pack(image_[k : k + deep]) for k in range(0, h, deep)], {"BSCALE": 0.5, "BZERO": 3.0, "ZNAME1": "BLOCKSIZE", "ZVAL1": 32, "ZNAME2": "BYTEPIX", "ZVAL2": 4}, deep=deep)
    for path in files.values():
        assert (fits.rows_of(path, None, 0, h)[1] == image_ * 0.5 + 3).all() and (fits.rows_of(path, "PACKED", 7, 12, 3, 9)[1] == image_[7:12, 3:9] * 0.5 + 3).all()
    fits.register(spark)
    got = spark.read.format("fits_image").option("rows", 6).load(files["rows"]).orderBy("y").collect()
    assert [r["values"] for r in got] == (image_ * 0.5 + 3).tolist()
    scale, zero = rng.uniform(0.5, 2, h), rng.normal(0, 5, h)
    for how in ("NO_DITHER", "SUBTRACTIVE_DITHER_1", "SUBTRACTIVE_DITHER_2"):
        path = str(tmp_path / f"{how}.fits")
        own = image_.copy()
        own[3, 4], own[5, 6] = -2147483647, -2147483646
        compressed_file(path, w, h, -32, "RICE_1", [riced(own[k], 4) for k in range(h)], {"ZQUANTIZ": how, "ZDITHER0": 9998, "ZBLANK": -2147483647}, (("ZSCALE", "D", scale), ("ZZERO", "D", zero)))
        got = fits.rows_of(path, None, 2, h)[1]
        r = np.full((h, w), 0.5)
        if how != "NO_DITHER":
            for k in range(h):
                at = int(tilezip.dither()[(k + 9997) % 10_000] * 500)
                r[k] = tilezip.dither()[at : at + w]
        want = (own - r + 0.5) * scale[:, None] + zero[:, None]
        if how == "SUBTRACTIVE_DITHER_2":
            want[5, 6] = 0
        want[3, 4] = np.nan
        assert np.allclose(got, want[2:], equal_nan=True, rtol=1e-12)
    assert tilezip.dither()[0] == 16807 / 2147483647 and int(tilezip.dither()[-1] * 2147483647 + 0.5) == 1043618065  # the standard's own check


def test_a_box_reads_its_own_bytes(spark, tmp_path, monkeypatch):
    a = np.random.default_rng(0).normal(0, 1, (300, 4000)).astype("f4").astype(float)
    path = str(tmp_path / "wide.fits")
    fits.write_image(path, a)
    read = []

    class Counting:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def __getattr__(self, name):
            return getattr(self.f, name)

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    opened = fits.open_input
    monkeypatch.setattr(fits, "open_input", lambda p: Counting(opened(p)))
    _, box = fits.rows_of(path, None, 100, 140, 700, 760)
    assert (box == a[100:140, 700:760]).all() and sum(read) == 2880 + 40 * 60 * 4
    monkeypatch.undo()
    fits.register(spark)
    rows = spark.read.format("fits_image").option("rows", 10).option("x", "700,760").load(path)
    some = rows.where("y >= 100 and y < 140")
    assert rows.rdd.getNumPartitions() == 30 and some.rdd.getNumPartitions() == 4
    assert [r["values"] for r in some.orderBy("y").collect()] == a[100:140, 700:760].tolist()
    assert [r.y for r in rows.where("y = 7").collect()] == [7] and rows.where("y > 400").count() == 0 and rows.where("y > 5 and y <= 12 and path = 'none'").count() == 0
    assert {r.y for r in rows.where("y > 5 and y <= 12").collect()} == set(range(6, 13))


def test_planes_are_written_by_tasks(spark, tmp_path):
    rng = np.random.default_rng(1)
    planes = {n: rng.normal(0, 1, (17, 33)).astype("f4") for n in ("SCI", "RMS", "MODEL", "RESID", "CHI")}
    y, x = np.mgrid[:17, :33]
    px = spark.createDataFrame(pd.DataFrame({"x": x.ravel(), "y": y.ravel()} | {n: p.ravel().astype(float) for n, p in planes.items()})).repartition(5)
    path = f"{tmp_path}/fit.fits"
    fits.write_planes(px.where("not (x = 3 and y = 4) and y <> 9"), path, list(planes), 33, 17, {"CRVAL1": 10.5})
    for name, p in planes.items():
        head, got = fits.rows_of(path, name, 0, 17)
        want = p.astype(float)
        want[4, 3], want[9] = np.nan, np.nan
        assert np.array_equal(got, want, equal_nan=True) and (name != "SCI" or head["CRVAL1"] == 10.5)
    with pytest.raises(Exception, match="exists"):
        fits.write_planes(px, path, list(planes), 33, 17)
    bad = px.withColumn("SCI", F.when(F.col("y") == 12, F.raise_error(F.lit("lost"))).otherwise(F.col("SCI")))
    with pytest.raises(Exception, match="lost"):
        fits.write_planes(bad, f"{tmp_path}/bad.fits", list(planes), 33, 17)
    with pytest.raises(Exception, match="rows of"):
        rows = spark.createDataFrame([("SCI", 0, [0.0] * 4)], "plane string, y int, values array<double>")
        rows.write.format("fits_planes").mode("append").option("planes", "SCI").option("width", 4).option("height", 2).save(f"{tmp_path}/short.fits")
    assert sorted(p.name for p in tmp_path.iterdir() if "fits" in p.name) == ["fit.fits"]


def test_fits_source(spark, tmp_path):
    a = np.arange(600, dtype=float).reshape(20, 30)
    path = str(tmp_path / "a.fits")
    fits.write_image(path, a, {"CRVAL1": 10.5, "OBJECT": "it's", "FLAG": True}, [("RMS", a + 1)])
    fits.register(spark)
    rows = spark.read.format("fits_image").option("rows", 7).load(path).orderBy("y").collect()
    assert [r["values"] for r in rows] == a.tolist() and rows[0].header["CRVAL1"] == "10.5" and rows[0].header["OBJECT"] == "it's"
    assert spark.read.format("fits_image").option("hdu", "RMS").load(path).where("y = 3").head()["values"] == (a[3] + 1).tolist()
    with pytest.raises(Exception, match="no 2-D image"):
        spark.read.format("fits_image").option("hdu", "none").load(path).collect()


def test_fits_tables_come_back(spark, tmp_path):
    from datetime import date
    from decimal import Decimal

    from fluxloom.sources import fits_tables

    kinds = "id long, n int, s short, ok boolean, f float, d double, name string, v array<double>, w array<int>, day date, dec decimal(8,2), c0 int"
    rows = [(i, i * 3 if i % 5 else None, i % 7, None if i % 3 == 0 else i % 2 == 0, i / 2, None if i % 4 == 0 else i / 3, None if i % 6 == 0 else "é" * (i % 5) + "x", [i * 1.5] * (i % 4), None if i % 9 == 0 else [i, i + 1], date(2024, 1, 1 + i % 28), Decimal(i) / 4, -i) for i in range(300)]
    df = spark.createDataFrame(rows, kinds).repartition(7)
    path = f"{tmp_path}/t.fits"
    fits_tables.write_table(df, path, ["id"], {"BAND": "VIS", "SIZE": 50.0})
    raw = open(path, "rb").read()
    assert len(raw) % 2880 == 0 and raw[2880:2888] == b"XTENSION"
    back = fits_tables.read_table(spark, path)
    assert dict(back.dtypes) == {"id": "bigint", "n": "int", "s": "int", "ok": "boolean", "f": "float", "d": "double", "name": "string", "v": "array<double>", "w": "array<int>", "day": "string", "dec": "double", "c0": "int"}
    got = back.collect()  # in order, as written
    assert [r.id for r in got] == list(range(300))
    for r, (i, n, s, ok, f, d, name, v, w, day, dec, c0) in zip(got, rows):
        assert (r.n, r.s, r.ok, r.f, r.name, r.day, r.dec, r.c0) == (n, s, ok, f, name or "", str(day), float(dec), c0)
        assert np.isnan(r.d) if d is None else r.d == d
        assert len(r.v) == 3 and r.v[: len(v)] == v and np.isnan(r.v[len(v) :]).all()
        assert r.w == (w or [None] * 2)
    some = spark.read.format("fits_table").option("rows", 40).option("columns", "name,id").load(f"{path},{path}")
    assert some.columns == ["name", "id"] and some.rdd.getNumPartitions() == 16 and some.count() == 600 and some.agg(F.sum("id")).head()[0] == 2 * sum(range(300))
    fits_tables.write_table(df.limit(0), f"{tmp_path}/none.fits", ["id"])
    assert fits_tables.read_table(spark, f"{tmp_path}/none.fits").count() == 0
    fits_tables.write_table(df.where("id < 3"), path, ["id"], mode="overwrite")
    assert fits_tables.read_table(spark, path).count() == 3


def test_fits_tables_refuse_what_they_cannot_hold(spark, tmp_path):
    from fluxloom.sources import fits_tables

    path = f"{tmp_path}/t.fits"
    fits_tables.write_table(spark.range(4), path)
    with pytest.raises(Exception, match="exists"):
        fits_tables.write_table(spark.range(4), path)
    with pytest.raises(ValueError, match="no form"):
        fits_tables.write_table(spark.range(2).select(F.create_map("id", "id").alias("m")), f"{tmp_path}/m.fits")
    with pytest.raises(ValueError, match="stands for null"):
        fits_tables.write_table(spark.range(1).select(F.lit(-(1 << 31)).alias("a")), f"{tmp_path}/n.fits")
    with pytest.raises(Exception, match="no column nothing"):
        fits_tables.read_table(spark, path, columns=["nothing"])
    with pytest.raises(Exception, match="no table X"):
        fits_tables.read_table(spark, path, "X")
    lost = spark.range(9).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        fits_tables.write_table(lost, f"{tmp_path}/lost.fits")
    assert sorted(p.name for p in tmp_path.iterdir() if "fits" in p.name) == ["t.fits"]


def test_fits_tables_of_other_writers(spark, tmp_path):
    """Scaled integers, null values, forms that are passed over, and a table behind another unit."""
    from fluxloom.sources import fits_tables

    kind = np.dtype([("u", ">i2"), ("t", ">i4"), ("x", "u1", (2,)), ("p", ">i4", (2,)), ("k", ">i2"), ("l", "u1"), ("a", "S6")])
    rows = np.zeros(5, kind)
    rows["u"], rows["t"], rows["k"], rows["l"], rows["a"] = [-32768, 0, 1, 2, 32767], [1, -9, 3, -9, 5], [0, 10, 20, 30, 40], [84, 70, 0, 84, 70], [b"ab", b"c d ", b"", b"x\0y", b"abcdef"]
    own = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": kind.itemsize, "NAXIS2": 5, "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": 7, "EXTNAME": "CAT"}
    own |= {f"TFORM{k}": v for k, v in enumerate(("I", "1J", "11X", "1PE(3)", "1I", "L", "6A"), 1)} | {f"TTYPE{k}": v for k, v in enumerate("utxpkla", 1)}
    own |= {"TZERO1": 32768, "TNULL2": -9, "TSCAL5": 0.5, "TZERO5": 1.0}
    first = {"SIMPLE": True, "BITPIX": 8, "NAXIS": 0}
    with open(f"{tmp_path}/o.fits", "wb") as f:
        for head in (first, own):
            f.write(fits.padded("".join([fits.card(k, v) for k, v in head.items()] + ["END".ljust(80)]).encode(), b" "))
        f.write(fits.padded(rows.tobytes(), b"\0"))
    got = fits_tables.read_table(spark, f"{tmp_path}/o.fits", "CAT")
    assert got.columns == ["u", "t", "k", "l", "a"]
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1.0, True, "ab"), (32768, None, 6.0, False, "c d"), (32769, 3, 11.0, None, ""), (32770, None, 16.0, True, "x"), (65535, 5, 21.0, False, "abcdef")]
    with pytest.raises(Exception, match="form X is not read"):
        fits_tables.read_table(spark, f"{tmp_path}/o.fits", columns=["x"])


def test_command_line_and_sinks(spark, tmp_path):
    at = str(tmp_path)
    d = image(POINTS)
    fits.write_image(f"{at}/i.fits", d, {"CRVAL1": 269.5, "CRVAL2": 67.3, "CRPIX1": 32.5, "CRPIX2": 32.5, "CD1_1": -0.1 / 3600, "CD1_2": 0.0, "CD2_1": 0.0, "CD2_2": 0.1 / 3600})
    as_catalog(spark, POINTS).write.parquet(f"{at}/c.parquet")
    cli.main(["run", f"{at}/c.parquet", f"{at}/i.fits", f"{at}/out.csv", "--ra", "269.5", "--dec", "67.3", "--size", "20", "--rms", "0.3", "--psf-fwhm", "2.5"])
    got = spark.read.option("header", True).csv(f"{at}/out.csv").collect()
    assert {int(r.id) for r in got} == {1, 2, 3} and sinks.read_metadata(spark, f"{at}/out.csv")["band"] == "VIS"
    with pytest.raises(ValueError):
        sinks.write_catalog(spark.range(1), f"{at}/x.xyz")
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert sinks.cached(spark, f"{at}/cache", "SELECT  1", make).count() == sinks.cached(spark, f"{at}/cache", "SELECT 1", make).count() == 3 and len(made) == 1


def test_command_line_takes_images_of_noise_and_psf(spark, tmp_path):
    """Noise, variance and PSF from files, in another unit: the fluxes and errors of the plain run; FITS and ECSV catalogs hold the same rows."""
    from fluxloom.sources import fits_tables

    at, d, wcs = str(tmp_path), image(POINTS), {"CRVAL1": 269.5, "CRVAL2": 67.3, "CRPIX1": 32.5, "CRPIX2": 32.5, "CD1_1": -0.1 / 3600, "CD1_2": 0.0, "CD2_1": 0.0, "CD2_2": 0.1 / 3600}
    fits.write_image(f"{at}/i.fits", d, wcs)
    fits.write_image(f"{at}/n.fits", d / 3.631, wcs)
    fits.write_image(f"{at}/rms.fits", np.full(d.shape, 0.3))
    fits.write_image(f"{at}/var.fits", np.full(d.shape, (0.3 / 3.631) ** 2))
    fits.write_image(f"{at}/psf.fits", pipeline.gaussian_psf(2.5))
    fits_tables.write_table(as_catalog(spark, POINTS), f"{at}/c.fits", ["id"])
    common = ["--ra", "269.5", "--dec", "67.3", "--size", "20", "--no-flags"]
    cli.main(["run", f"{at}/c.fits", f"{at}/i.fits", f"{at}/a.fits", *common, "--rms", "0.3", "--psf-fwhm", "2.5"])
    cli.main(["run", f"{at}/c.fits", f"{at}/i.fits", f"{at}/b.ecsv", *common, "--rms-image", f"{at}/rms.fits", "--psf", f"{at}/psf.fits", "--more", f"Y={at}/n.fits;variance_image={at}/var.fits;unit=nanomaggy"])
    want = {r.id: r for r in fits_tables.read_table(spark, f"{at}/a.fits").collect()}
    lines = [line for p in sorted(tmp_path.glob("b.ecsv/part-*")) for line in p.read_text().splitlines()]
    assert lines[0] == "# %ECSV 1.0" and "# - {name: \"id\", datatype: int64}" in lines
    names, *rows = [line.split(",") for line in lines if not line.startswith("#")]
    got = {int(r["id"]): r for r in (dict(zip(names, row)) for row in rows)}
    assert set(got) == set(want) == {1, 2, 3}
    for i, r in got.items():
        for band in ("vis", "y"):
            assert np.isclose(float(r[f"flux_{band}_ujy"]), want[i].flux_vis_ujy, rtol=1e-4)
            assert np.isclose(float(r[f"flux_err_{band}_ujy"]), want[i].flux_err_vis_ujy, rtol=1e-4)
    with pytest.raises(SystemExit):
        cli.main(["run", f"{at}/c.fits", f"{at}/i.fits", f"{at}/x.csv", *common, "--unit", "parsec"])
    with pytest.raises(SystemExit):
        cli.main(["run", f"{at}/c.fits", f"{at}/i.fits", f"{at}/x.csv", *common, "--more", "Y=i.fits;colour=red"])
    with pytest.raises(ValueError, match="no ECSV type"):
        sinks.write_ecsv(spark.range(1).select(F.array("id").alias("v")), f"{at}/v.ecsv")


def test_exposure_lists(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# mjd ra dec pa t\n54000 10.0 1.0 30 100\n55000 10.01 1.0 0 30\n55000 50 1 0 30\nbad line\n")
    e = catalogs.exposure_table(spark, str(tmp_path / "e.txt"), 10.0, 1.0, 0.5)
    assert sorted(r.mission for r in e.collect()) == ["cryo", "warm"]
    src = spark.createDataFrame([(1, 10.0, 1.0), (2, 10.3, 1.0), (3, 10.0, 1.02)], "id long, ra double, dec double")
    assert sorted(r.id for r in catalogs.covered(src, e).collect()) == [1, 3]
    ref = spark.createDataFrame([("f", 12.0, 10.0, 1.0, 1e-4, 0.0, 0.0, 1e-4), ("g", 0.0, 10.0, 1.0, 1e-4, 0.0, 0.0, 1e-4)], "filename string, exptime double, RARFND double, DecRFND double, CD11RFND double, CD12RFND double, CD21RFND double, CD22RFND double")
    assert [r.filename for r in catalogs.reference_pointings(ref, 10.0, 1.0, 0.1).collect()] == ["f"]
    xml = spark.createDataFrame([('<r><field name="N"/><image url="u/a_mosaic.fits"/><image url="u/a_unc.fits"/></r>',)], "xml string")
    assert [(r.field, r.kind) for r in catalogs.cutout_urls(xml).collect()] == [("N", "mosaic"), ("N", "unc")]


def test_one_result_whatever_the_tiles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    src = [fit.Source(k, float(x), float(y), flux=float(f)) for k, (x, y, f) in enumerate(zip(rng.uniform(3, 157, 60), rng.uniform(3, 157, 60), rng.uniform(20, 90, 60)))]
    band = pipeline.Band("VIS", pixel_table(spark, image(src, size=160, level=4.0), 1 / 0.09), PSF, WCS, 160, 160, sky=True, inflate="residuals")
    rows = as_catalog(spark, src)
    cfg = RunConfig(269.5, 67.3, 40.0)
    whole = {r.id: r for r in pipeline.run(cfg, [band], rows, tile=None).measurements.collect()}
    assert len(whole) > 50 and all(abs(whole[s.id].flux - s.flux) < 6 * whole[s.id].err for s in src if s.id in whole)
    monkeypatch.setattr(solve, "TRIPLETS", 0)  # components in tables
    for tile in (40, 64):
        got = {r.id: r for r in pipeline.run(cfg, [band], rows, tile=tile).measurements.collect()}
        assert got.keys() == whole.keys()
        for k, r in got.items():
            assert abs(r.flux / whole[k].flux - 1) < 1e-6 and abs(r.err / whole[k].err - 1) < 1e-6 and abs(r.factor / whole[k].factor - 1) < 1e-6


def test_positions_too_far_go_back():
    d, w = image([POINTS[2]]), np.full((64, 64), 1 / 0.09)
    wrong = fit.Source(3, 44.0, 40.2, flux=1.0)
    near = fit.Source(3, 45.4, 40.1, flux=1.0)
    for start, stays in ((wrong, False), (near, True)):
        got = fit.clamped(d, w, fit.fit(d, w, [start], PSF, {3: ("x", "y")}, {})[0], {3: start}, PSF, 0.5)[0]
        assert (math.hypot(got.x - 45.6, got.y - 40.2) < 0.1) == stays and math.hypot(got.x - start.x, got.y - start.y) <= 0.5


def test_registration_refits_the_projection(spark):
    rng = np.random.default_rng(6)
    true = WCS | {"crpix1": 500.0, "crpix2": 400.0}
    t = math.radians(0.05)
    cd = [true["cd11"], 0.0, 0.0, true["cd22"]]
    off = true | {"crval1": true["crval1"] + 0.08 / 3600, "crval2": true["crval2"] - 0.05 / 3600, "cd11": cd[0] * math.cos(t), "cd12": cd[3] * math.sin(t), "cd21": -cd[0] * math.sin(t), "cd22": cd[3] * math.cos(t)}
    xy = rng.uniform(20, 780, (120, 2))
    at = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double")
    p = sky.pixel_to_sky(F.col("x"), F.col("y"), sky.wcs(**true))
    stars = at.select("id", p["ra"].alias("ra"), p["dec"].alias("dec"), F.lit(True).alias("is_star"), F.lit(5.0).alias("flux"))
    dets = at.select("id", "x", "y", (F.col("id") % 17 == 0).cast("int").alias("flag"), F.lit(2.0).alias("a"), F.lit(1.8).alias("b"))
    got = pipeline.register_image(stars, dets, off, 800, 800)
    assert got["n"] > 60 and got["before_arcsec"] > 0.05 and got["after_arcsec"] < 1e-5
    q = sky.sky_to_pixel(F.col("ra"), F.col("dec"), sky.wcs(**got["wcs"]))
    err = stars.join(at, "id").select(F.hypot(q["x"] - F.col("x"), q["y"] - F.col("y")).alias("e")).agg(F.max("e")).head()[0]
    assert err < 1e-4
    with pytest.raises(ValueError):
        pipeline.register_image(stars.limit(5), dets, off, 800, 800)


def test_caps_drop_nothing(spark):
    from fluxloom.operators import catalog, models

    m = spark.range(41).select("id", F.col("id").cast("string").alias("band"), F.lit(1.0).alias("flux"), F.lit(1.0).alias("err"), F.lit(None).cast("double").alias("factor"))
    assert {r.err for r in catalog.recalibrated(m, m.select("band", F.lit(2.0).alias("factor"))).collect()} == {2.0}
    b = spark.range(65).select(F.col("id").alias("band"), F.lit(1.0).alias("seed_nmgy"), F.lit(4).alias("psf_half_pix"), F.lit(0.1).alias("scale_arcsec"))
    assert models.clones(spark.range(3).withColumn("re", F.lit(1.0)), b).count() == 195
    n = 200_001
    cat = spark.range(n).select(F.col("id").alias("object_id"), F.lit(10.0).alias("ra"), F.lit(0.0).alias("dec"), (F.col("id") + 1.0).alias("flux_vis_psf"))
    assert catalogs.source_catalog(cat, cat.select("object_id", F.lit(0.5).alias("point_like_prob")), 10.0, 0.0, 0.1).count() == n


def test_empty_positions_until_none_is_left(spark):
    px = pixel_table(spark, np.zeros((60, 60)), 1.0)
    src = spark.createDataFrame([(k, 0, float(10 * (k % 6)), float(10 * (k // 6))) for k in range(36)], "id long, tile long, x double, y double")
    at = inject.empty_positions(px, src, 500, 4.5, edge=4).toPandas()[["x", "y"]].to_numpy()
    left = [(x, y) for x in range(4, 56) for y in range(4, 56) if min(np.hypot(x - 10 * (k % 6), y - 10 * (k // 6)) for k in range(36)) > 4.5]
    assert len(left) > len(at) > 10 and len(at) < 500
    assert all(np.hypot(*(at - p).T).min() <= 4.5 for p in left)  # no room is left


def test_psf_by_place(spark):
    wide = render.resized(render.gaussian_psf(4.5), 2 * (PSF.shape[0] // 2) + 7)
    left, right = fit.Source(1, 15.2, 30.0, flux=80.0), fit.Source(2, 50.4, 33.0, flux=80.0)
    d = np.random.default_rng(2).normal(0, 0.05, (64, 64)) + left.flux * left.plane((64, 64), PSF) + right.flux * right.plane((64, 64), wide)
    samples = spark.createDataFrame([(1, 10.0, 30.0, PSF.ravel().tolist(), PSF.shape[1]), (2, 55.0, 30.0, wide.ravel().tolist(), wide.shape[1])], "id long, x double, y double, stamp array<double>, width int")
    band = pipeline.Band("VIS", pixel_table(spark, d, 1 / 0.05**2), PSF, WCS, 64, 64, psf_samples=samples)
    plain = pipeline.Band("VIS", pixel_table(spark, d, 1 / 0.05**2), PSF, WCS, 64, 64)
    got, without = ({r.id: r.flux for r in pipeline.run(RunConfig(269.5, 67.3, 20.0), [b], as_catalog(spark, [left, right])).measurements.collect()} for b in (band, plain))
    assert abs(got[1] - 80) < 1 and abs(got[2] - 80) < 1 and abs(without[2] - 80) > 10
    with pytest.raises(ValueError):
        psf.place_of_psf(samples, samples, "average")


def test_stars_against_the_psf(spark):
    g = render.resized(render.gaussian_psf(3.0), 41)
    image, weight = np.random.default_rng(0).normal(2.0, 0.01, (80, 80)), np.full((80, 80), 1e4)
    star = fit.Source(1, 40.3, 39.6, flux=500.0)
    image += star.flux * star.plane((80, 80), g)
    masked = weight.copy()
    masked[40, 41] = 0
    rows = [(t, x, y, float(image[y, x]), float(w[y, x])) for t, w in ((0, weight), (1, masked)) for y in range(80) for x in range(80)]
    px = spark.createDataFrame(rows, "tile long, x int, y int, d double, w double")
    stars = spark.createDataFrame([(t, k, x, y) for t in (0, 1) for k, (x, y) in enumerate([(40.3, 39.6), (10.0, 40.0), (25.0, 25.0)])], "tile long, id long, x double, y double")
    stamps = psf.star_stamps(stars, px, 20).cache()
    r = psf.stars_and_psf(stamps, g).collect()
    assert [(s.tile, s.id) for s in r] == [(0, 0)]  # else near the edge, faint or masked
    own, given = (np.reshape(v, (41, 41)) for v in (r[0].stamp, r[0].reference))
    assert np.abs(own - given).max() < 2e-3 and abs(render.core_fwhm(own) - render.core_fwhm(g)) < 0.1
    assert abs(psf.widths(stamps, 41, ["tile", "id"]).head().fwhm - render.core_fwhm(own)) < 1e-9
    wings = np.reshape(psf.radial_wings(stamps.select("id", "stamp"), 41).head().stamp, (41, 41))
    assert abs(wings.sum() - 1) < 1e-9 and (wings >= 0).all() and np.ptp(wings[20, [8, 32]]) < 1e-12
    ring = np.floor(np.hypot(*(np.mgrid[:41, :41] - 20))).astype(int)
    want = np.clip(np.array([np.median(own[ring == k]) for k in range(30)])[ring], 0, None)
    want[ring < 8] = np.clip(own, 0, None)[ring < 8]
    assert np.abs(wings - want / want.sum()).max() < 1e-12
    with pytest.raises(Exception, match="no light"):
        psf.radial_wings(psf.as_table(stamps, -g), 41).collect()
    assert psf.grid_settings(None, None, {"Warm", "cryo"})["label"] == "cryo+warm" and psf.grid_settings("a", "b", set())["source"] == "files"
    with pytest.raises(ValueError):
        psf.grid_settings("a", None, set())


def test_template_derivatives(spark):
    s = spark.createDataFrame([(0, 1, 20.3, 22.7, "PointSource", None, None, None, None)], "tile long, id long, x double, y double, model string, re double, ab double, pa double, n double")
    got = inject.derivatives(s, PSF, 64, 64).toPandas()
    h = 1e-3
    want = (fit.Source(1, 20.3 + h, 22.7).plane((64, 64), PSF) - fit.Source(1, 20.3 - h, 22.7).plane((64, 64), PSF)) / (2 * h)
    plane = np.zeros((64, 64))
    plane[got.y, got.x] = got.tx
    assert np.abs(plane - want).max() < 1e-4 and abs(got.ty.sum()) < 1e-6


def test_images_and_known_priors(spark):
    band = pipeline.Band("VIS", pixel_table(spark, image(POINTS), 1 / 0.09), PSF, WCS, 64, 64, ujy_per_unit=2.0)
    r = pipeline.run(RunConfig(269.5, 67.3, 20.0), [band], as_catalog(spark, POINTS))
    px = r.images("VIS").toPandas()
    assert len(px) == 64 * 64 and abs(px.residual.std() - 2 * 0.3) < 0.05 and abs(px.chi.std() - 1) < 0.1 and np.allclose(px.d - px.model, px.residual)
    cfg = RunConfig(269.5, 67.3, 20.0, prior={"mode": "catalog", "refine_positions": True})
    first = pipeline.run(cfg, [band], as_catalog(spark, POINTS))
    moved = first.sources.withColumn("x", F.col("x") + 0.125)
    again = pipeline.run(cfg, [band], as_catalog(spark, POINTS), known=moved)
    assert {r.id: r.x for r in again.sources.collect()} == {r.id: r.x for r in moved.collect()}
    fewer = pipeline.run(cfg, [band], as_catalog(spark, POINTS), known=moved.where("id > 1"))
    assert {r.id: r.x for r in fewer.sources.collect()} == {r.id: r.x for r in first.sources.collect()}
    a, b = spark.range(3), spark.range(4)
    assert pipeline.prior_unless_known(a, a, lambda x: b) is a and pipeline.prior_unless_known(a, b, lambda x: x.limit(1)).count() == 1 and pipeline.prior_unless_known(a, None, lambda x: b) is b
    with pytest.raises(ValueError):
        pipeline.run(RunConfig(269.5, 67.3, 20.0, prior={"mode": "coords"}), [band], coords=spark.createDataFrame([(10.0, 10.0)], "ra double, dec double"))


def test_backgrounds_and_bits(spark):
    from fluxloom.operators import flags

    px = pixel_table(spark, image([], level=5.0), 1 / 0.09)
    assert detect.without_background(px, "none") is px
    assert abs(detect.without_background(px, "mesh", 32).agg(F.avg("d")).head()[0]) < 0.05
    with pytest.raises(ValueError):
        detect.without_background(px, "other")
    assert flags.star_signal_pixels(px, "VIS") is None
    with pytest.raises(ValueError):
        flags.star_signal_pixels(px, "H")


def test_sources_apart_are_fitted_apart(spark):
    far = [fit.Source(1, 20.3, 22.7, flux=60.0), fit.Source(2, 24.1, 23.0, flux=35.0), fit.Source(3, 80.6, 85.2, "ExpGalaxy", re=2.0, ab=0.7, pa=20.0, flux=200.0), fit.Source(9, 500.0, 5.0)]
    d = image(far[:3], size=120)
    px = pixel_table(spark, d, 1 / 0.09)
    table = spark.createDataFrame([(0, s.id, s.x, s.y, s.model, s.re or None, s.ab, s.pa, s.n, s.flux) for s in far], "tile long, id long, x double, y double, model string, re double, ab double, pa double, n double, flux double")
    images = spark.createDataFrame([(0, 120, 120)], "tile long, height int, width int")
    assert {r.id: r.group for r in fit.grouped(fit.boxes(table, images, PSF, 3.0), 16).collect()} == {1: 1, 2: 1, 3: 3}
    whole = {s.id: s for s in fit.fit(d, np.full((120, 120), 1 / 0.09), far[:3], PSF, {3: fit.SHAPE["ExpGalaxy"]}, fit.limits(0.1))[0]}
    got = {r.id: r for r in fit.refit(table, px, PSF, 0.1, "shapes").collect()}
    assert got.keys() == {1, 2, 3} and got[3].moved
    for k, s in whole.items():
        assert abs(got[k].flux / s.flux - 1) < 0.01 and abs(got[k].re - s.re) < 0.05
    assert fit.refit(table.limit(0), px, PSF, 0.1, "positions").count() == 0


def chained(n):
    """Links of a long path, a star, and pairs."""
    path, star = [(0, k, k + 1) for k in range(100, 100 + n)], [(0, 50, k) for k in range(300, 330)]
    return path + star + [(1, 7, 3), (1, 3, 7), (1, 9, 9)]


def test_components_in_tables(spark):
    from fluxloom.operators import components

    got = {(r.tile, r.id): r.root for r in components.roots(spark.createDataFrame(chained(40), "tile long, a long, b long"), ["tile"]).collect()}
    assert got == {(0, k): 100 for k in range(100, 141)} | {(0, k): 50 for k in (50, *range(300, 330))} | {(1, 3): 3, (1, 7): 3}


def by_brute_force(mask, radius):
    y, x = np.nonzero(mask)
    yy, xx = np.mgrid[: mask.shape[0], : mask.shape[1]]
    return ((yy[..., None] - y) ** 2 + (xx[..., None] - x) ** 2).min(axis=2, initial=10**9) <= radius * radius


def test_windows_grow_by_distance():
    rng = np.random.default_rng(0)
    for shape, share in (((40, 55), 0.01), ((30, 7), 0.05), ((9, 60), 0.3), ((20, 20), 0.0)):
        mask = rng.random(shape) < share
        for radius in (0, 1, 2, 4.5, 13):
            assert (detect.dilated(mask, radius) == by_brute_force(mask, radius)).all()
    one = np.zeros((120, 120), bool)
    one[55:65, 50:70] = True
    for radius, grown in ((None, 15), (1.0, 10), (13.4, 26), (90.0, 40)):
        assert (detect.wing_window(one, radius) == by_brute_force(one, grown)).all()


def test_detection_is_the_same_in_any_tiles(spark):
    rng = np.random.default_rng(3)
    many = [fit.Source(k, float(x), float(y), flux=float(f)) for k, (x, y, f) in enumerate(zip(rng.uniform(2, 157, 40), rng.uniform(2, 97, 40), rng.uniform(20, 200, 40)))]
    many += [fit.Source(99, 64.0, 32.0, "ExpGalaxy", re=9.0, ab=0.4, pa=45.0, flux=3000.0)]  # over a corner of four tiles
    d = rng.normal(3.0, 0.3, (100, 160)) + 0.01 * np.mgrid[:100, :160][1] + sum(s.flux * s.plane((100, 160), PSF) for s in many)
    w = np.full(d.shape, 1 / 0.09)
    w[40:44, 20:90] = 0
    seg, blobs, want = detect.detect(d, w, PSF, 3.0, dilate_pix=3, mesh=32)
    first = lambda plane, k: tuple(np.argwhere(plane == k)[0])
    names = {k: first(seg, k)[0] * detect.ROW + first(seg, k)[1] + 1 for k in range(1, seg.max() + 1)}
    homes = {k: first(blobs, k)[0] * detect.ROW + first(blobs, k)[1] + 1 for k in range(1, blobs.max() + 1)}
    assert len(names) > 20 and len(homes) > 5
    px = pixel_table(spark, d, w)
    px = px.unionByName(px.withColumn("tile", F.lit(5).cast("long")).where("x < 50"))
    for tile in (32, 1024):
        dets, segs = detect.found(px, PSF, 3.0, dilate_pix=3, mesh=32, tile=tile)
        got = segs.where("tile = 0").toPandas()
        plane, home = np.zeros(d.shape, np.int64), np.zeros(d.shape, np.int64)
        plane[got.y, got.x], home[got.y, got.x] = got.segment, got.blob
        assert (plane == np.vectorize(lambda k: names.get(k, 0))(seg)).all() and (home == np.vectorize(lambda k: homes.get(k, 0))(blobs)).all()
        rows = dets.where("tile = 0").toPandas().set_index("segment")
        for r in want.itertuples():
            g = rows.loc[names[r.segment]]
            assert np.allclose([g[c] for c in ("x", "y", "flux", "a", "b", "npix")], [getattr(r, c) for c in ("x", "y", "flux", "a", "b", "npix")], rtol=1e-6) and g.blob == homes[r.blob]
            assert abs((g.theta - r.theta + 90) % 180 - 90) < 1e-3
        assert len(rows) == len(want) and dets.where("tile = 5").count() > 0
    plane, _, rms = detect.background_map(d, w <= 0, 32)
    got = detect.with_background(px, 32, 48).where("tile = 0").toPandas()
    assert np.abs(got.background - plane[got.y, got.x]).max() < 1e-9 and np.abs(got.background_rms - rms).max() < 1e-9
    assert detect.found(px.withColumn("w", F.lit(0.0)), PSF)[0].count() == 0


def test_prf_grids_from_files(spark, tmp_path):
    from fluxloom.sources import prf_grids

    (tmp_path / "more").mkdir()
    made = {}
    for node, fwhm, name in ((1, 3.0, "mosaic_gp000001.fits"), (2, 4.0, "mosaic_gp000002.fits"), (3, 5.0, "more/own.fits")):
        made[node] = render.resized(render.gaussian_psf(fwhm), 31) * 7
        fits.write_image(str(tmp_path / name), made[node], {"NFRAMES": node, "SAMP_NEW": 4.07})
    packed = tmp_path / "mosaic_gp000002.fits"
    (tmp_path / "mosaic_gp000002.fits.gz").write_bytes(gzip.compress(packed.read_bytes()))
    packed.unlink()
    table = spark.createDataFrame([(1, 11.0, 11.0, None), (2, 41.0, 11.0, ""), (3, 11.0, 51.0, "some/where/own.fits"), (4, float("nan"), 1.0, None)], "id_gridpt int, X double, y double, filename string")
    grid = prf_grids.nodes(table, WCS)
    assert {(r.node, r.x, r.y) for r in grid.collect()} == {(1, 10.0, 10.0), (2, 40.0, 10.0), (3, 10.0, 50.0)}
    settings = psf.grid_settings("grid", str(tmp_path), set())
    same = {r.id: r for r in prf_grids.samples(settings, WCS, 0.3, 21, table, str(tmp_path), channel=1).collect()}  # 1.221 / 4.07 = 0.3
    fine = {r.id: r for r in prf_grids.samples(settings, WCS, 0.15, 41, table, str(tmp_path), input_scale=0.3).collect()}
    for k, own in made.items():
        own = own.astype("f4").astype(float)
        assert same[k].width == 21 and same[k].n_frames == k and np.allclose(np.reshape(same[k].stamp, (21, 21)), render.normalized(render.resized(own, 21)), atol=1e-12)
        assert np.allclose(np.reshape(fine[k].stamp, (41, 41)), render.normalized(psf.resampled(own, 0.5, 41)), atol=1e-12) and abs(sum(fine[k].stamp) - 1) < 1e-12
    store = prf_grids.samples(settings, WCS, 0.3, 21, table, str(tmp_path), channel=1)
    src = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate([(12.0, 8.0), (30.0, 10.0), (9.0, 45.0)])], "id long, x double, y double")
    got = {r.id: r.psf for r in psf.with_stamps(src, store).collect()}
    assert got == {0: same[1].stamp, 1: same[2].stamp, 2: same[3].stamp}
    with pytest.raises(FileNotFoundError, match="000009"):
        prf_grids.stamps(grid.withColumns({"node": F.lit(9), "file": F.lit("mosaic_gp000009.fits")}), str(tmp_path), 0.3)
    with pytest.raises(ValueError):
        prf_grids.nodes(table.drop("id_gridpt"), WCS)
    sky_table = spark.createDataFrame([(7, 269.5, 67.3)], "ID_GRIDPT int, ra double, DEC_CEN double")
    at = prf_grids.nodes(sky_table, WCS).head()
    assert abs(at.x - 31.5) < 1e-6 and abs(at.y - 31.5) < 1e-6 and at.file == "mosaic_gp000007.fits"
    one = {"cryo": {(c, r): psf.comb_normalized(render.resized(render.gaussian_psf(9.0), 41)) for c in (25, 129, 233) for r in (25, 129, 233)}}
    exposures = spark.createDataFrame([(269.5, 67.3, 15.0, 30.0, 256, 256, 1.2)], "ra0 double, dec0 double, pa double, exptime double, width int, height int, detector_scale double")
    positions = spark.createDataFrame([(1, 269.5, 67.3)], "node long, ra double, dec double")
    stacked = prf_grids.samples(psf.grid_settings(None, None, {"cryo"}), WCS, 0.6, 21, positions=positions, exposures=exposures, prfs=one["cryo"]).collect()
    assert [(r.id, r.width, r.n_frames) for r in stacked] == [(1, 21, 1)] and abs(sum(stacked[0].stamp) - 1) < 1e-9


def test_planes_are_aligned_by_their_reference_pixels(spark, tmp_path):
    a = np.arange(150 * 200, dtype=float).reshape(150, 200)
    head = {"CRVAL1": 10.0, "CRVAL2": 2.0, "CRPIX1": 90.3, "CRPIX2": 80.6, "CD1_1": -1e-4, "CD1_2": 0.0, "CD2_1": 0.0, "CD2_2": 1e-4}
    path = str(tmp_path / "mosaic.fits")
    fits.write_image(path, a, head)
    image_ = fits.wcs_of(head) | {"crpix1": 89.3 - 30.2, "crpix2": 79.6 - 40}
    rows, wcs = fits.aligned(spark, path, image_, 50, 25)
    assert [r["values"] for r in rows.orderBy("y").collect()] == a[40:65, 30:80].tolist() and [r.y for r in rows.orderBy("y").collect()] == list(range(25))
    assert abs(wcs["crpix1"] - 59.3) < 1e-9 and abs(wcs["crpix2"] - 39.6) < 1e-9
    for wrong, size in ((image_ | {"cd11": -1.1e-4}, 25), (image_ | {"crpix1": 95.0}, 25), (image_, 140)):
        with pytest.raises(ValueError):
            fits.aligned(spark, path, wrong, 50, size)
