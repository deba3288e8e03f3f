"""Kernels against numpy and against properties of the problem."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom import config
from fluxloom.functions import sky, stats
from fluxloom.operators import catalog, flags, matching, models, render, solve, tiles


def test_settings_are_checked():
    assert config.normalize_channel("ch2") == config.normalize_channel(2) == "IRAC2"
    assert config.mission(3, mjd=60000) == "cryo" and config.mission(1, mjd=54966) == "warm"
    assert config.RunConfig(1, 2, prior={"mode": "coords"}).psf_product == "grid"
    for bad in ({"prior": {"x": 1}}, {"bands": ("R",)}, {"prior": {"psf_product": "?"}}, {"size_arcsec": 0}):
        with pytest.raises(ValueError):
            config.RunConfig(1.0, 2.0, **bad)


def test_profiles_hold_their_flux_and_half_light_radius():
    for n in (0.5, 1.0, 2.5, 4.0):
        p = render.profile(3.0, 0.7, 30.0, n, 60)
        assert 0.85 < p.sum() < 1.01
        y, x = np.mgrid[-60:61, -60:61]
        t = math.radians(30)
        r = np.hypot(-x * math.sin(t) + y * math.cos(t), (x * math.cos(t) + y * math.sin(t)) / 0.7)
        assert abs(p[r <= 3.0].sum() - 0.5) < 0.05
    with pytest.raises(ValueError):
        render.normalized(np.zeros((3, 3)))


def test_shift_and_centroid():
    g = render.resized(render.gaussian_psf(4.0), 31)
    cx, cy = render.centroid(render.shifted(g, 0.3, -0.4))
    assert abs(cx - 15.3) < 1e-3 and abs(cy - 14.6) < 1e-3
    assert abs(render.centroid(render.recentred(render.shifted(g, 0.3, -0.4)))[0] - 15) < 1e-3
    assert abs(render.core_fwhm(render.resized(render.gaussian_psf(3.0), 41), 12) - 3.0) < 0.1


def scene(spark, n=25, size=40, seed=3):
    rng = np.random.default_rng(seed)
    src = [(0, i, float(x), float(y), float(f)) for i, (x, y, f) in enumerate(zip(rng.uniform(2, size - 3, n), rng.uniform(2, size - 3, n), rng.uniform(5, 50, n), strict=True))]
    s = spark.createDataFrame(src, "tile int, id long, x double, y double, flux double")
    t = render.point_templates(s, 1.5, 8, size, size)
    y, x = np.mgrid[:size, :size]
    d = 3.0 + rng.normal(0, 1, (size, size))
    for *_, sx, sy, f in src:
        d += f * np.where((abs(x - np.rint(sx)) <= 8) & (abs(y - np.rint(sy)) <= 8), np.exp(-((x - sx) ** 2 + (y - sy) ** 2) / 4.5) / (2 * math.pi * 2.25), 0)
    w = (rng.random((size, size)) > 0.02).astype(float)
    px = spark.createDataFrame([(0, int(a), int(b), float(d[b, a]), float(w[b, a])) for b in range(size) for a in range(size)], "tile int, x int, y int, d double, w double")
    return s, t, px, src, d, w


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_joint_solve_equals_least_squares(spark, monkeypatch, most):
    monkeypatch.setattr(solve, "TRIPLETS", most)  # all in one task, or components in tables
    s, t, px, src, d, w = scene(spark)
    rows = t.toPandas()
    a = np.zeros((d.size, len(src) + 1))
    a[rows.y * d.shape[1] + rows.x, rows.id] = rows.t
    a[:, -1] = 1
    sw = np.sqrt(w.ravel())
    want = np.linalg.lstsq(a * sw[:, None], d.ravel() * sw, rcond=None)[0]
    got = {r.id: r for r in solve.solve_fluxes(t, px, sky=True).collect()}
    assert max(abs(got[i].flux - want[i]) for i in range(len(src))) < 1e-8
    assert abs(got[solve.SKY].flux - want[-1]) < 1e-8
    info = (a[:, :-1] ** 2 * w.ravel()[:, None]).sum(axis=0)
    assert all(abs(got[i].information - info[i]) < 1e-9 for i in range(len(src)))
    cov = np.linalg.inv((a * w.ravel()[:, None]).T @ a)
    assert all(abs(got[i].variance - cov[i, i]) < 1e-6 * cov[i, i] for i in range(len(src)))


def test_masked_pixels_and_row_order_do_not_count(spark):
    s, t, px, *_ = scene(spark, n=8, size=24)
    base = {r.id: r.flux for r in solve.solve_fluxes(t, px).collect()}
    junk = spark.createDataFrame([(0, 3, 3, 1e9, 0.0)], px.schema)
    again = {r.id: r.flux for r in solve.solve_fluxes(t.orderBy(F.rand(1)), px.union(junk).orderBy(F.rand(2))).collect()}
    assert all(abs(base[k] - again[k]) < 1e-8 for k in base)


def test_dependent_templates(spark):
    s = spark.createDataFrame([(0, 1, 10.0, 10.0), (0, 2, 10.0, 10.0)], "tile int, id long, x double, y double")
    t = render.point_templates(s, 1.5, 6, 21, 21)
    px = t.select("tile", "x", "y").distinct().select("*", F.lit(1.0).alias("d"), F.lit(1.0).alias("w"))
    assert [r.rank_ok for r in solve.solve_fluxes(t, px).collect()] == [False, False]
    with pytest.raises(Exception, match="depend on each other"):
        solve.solve_fluxes(t, px, strict=True).collect()


def field_matrix(n, seed, step=3.0):
    """Triplets of a crowded field's normal matrix: overlaps of points that fall off with distance."""
    rng = np.random.default_rng(seed)
    side = math.sqrt(n) * step
    at = rng.uniform(0, side, (n, 2))
    order = np.argsort(at[:, 0])
    at, i, j = at[order], [], []
    for k in range(n):
        m = np.arange(k, np.searchsorted(at[:, 0], at[k, 0] + 6.0))
        m = m[np.hypot(*(at[m] - at[k]).T) < 6.0]
        i.append(np.full(len(m), k))
        j.append(m)
    i, j = np.concatenate(i), np.concatenate(j)
    weight = rng.uniform(0.5, 4.0, n)
    v = np.exp(-((at[i] - at[j]) ** 2).sum(axis=1) / 3.0) * weight[i] * weight[j]
    v[i == j] += 0.05
    return i, j, v, rng.normal(0, 50, n)


def test_large_components_have_fluxes_and_variances():
    i, j, v, b = field_matrix(5000, 1)
    part = solve.connected(5000, i, j)
    big = np.bincount(part).argmax()
    keep, place = part[i] == big, np.cumsum(part == big) - 1
    i, j, v, b = place[i[keep]], place[j[keep]], v[keep], b[part == big]
    n = len(b)
    a = np.zeros((n, n))
    a[i, j] = a[j, i] = v
    inverse = np.linalg.inv(a)
    x, var, rank = solve.solve_levels(i, j, v, b)
    assert n > 4000 and rank == n and np.allclose(x, inverse @ b, rtol=1e-7, atol=1e-7 * np.abs(x).max()) and np.allclose(var, np.diag(inverse), rtol=1e-7)


def test_levels_without_information():
    i, j, v, b = field_matrix(300, 2)
    part = solve.connected(300, i, j)
    own = np.flatnonzero(part == np.bincount(part).argmax())
    a = np.zeros((300, 300))
    a[i, j] = a[j, i] = v
    a, b = a[np.ix_(own, own)], b[own]
    n = len(own)
    more = np.zeros((n + 2, n + 2))  # two templates that stand twice
    more[:n, :n] = a
    for k, m in ((n, 5), (n + 1, n // 2)):
        more[k, :k] = more[:k, k] = more[m, :k]
        more[k, k] = more[m, m]
    rhs = np.concatenate([b, b[[5, n // 2]]])
    p, q = np.nonzero(np.triu(more))
    x, var, rank = solve.solve_levels(p, q, more[p, q], np.column_stack([rhs, 2 * rhs]))
    want, lost, full = solve.solve_component(more, rhs)
    assert rank == full == n and np.allclose(x[:, 0], want, rtol=1e-6, atol=1e-6) and np.allclose(x[:, 1], 2 * x[:, 0])
    assert (np.isinf(var) == np.isinf(lost)).all() and np.isinf(var).sum() == 4 and np.allclose(var[np.isfinite(var)], lost[np.isfinite(lost)], rtol=1e-6)


@pytest.mark.parametrize("n,seed", [(1, 0), (2, 1), (60, 2), (700, 3)])
def test_bounded_fluxes_meet_the_conditions_of_the_least(n, seed):
    i, j, v, b = field_matrix(n, seed, 2.0)
    rng = np.random.default_rng(seed)
    lower, upper = np.where(rng.random(n) < 0.7, 0.0, -np.inf), np.where(rng.random(n) < 0.3, 4.0, np.inf)
    a = np.zeros((n, n))
    a[i, j] = a[j, i] = v
    x, var, side, met = solve.bounded(i, j, v, b, lower, upper)
    slope = a @ x - b
    assert met and (x >= lower - 1e-9).all() and (x <= upper + 1e-9).all()
    assert np.abs(slope[side == 0]).max(initial=0) < 1e-6 and (slope[side < 0] > -1e-6).all() and (slope[side > 0] < 1e-6).all()
    assert (x[side < 0] == lower[side < 0]).all() and (x[side > 0] == upper[side > 0]).all() and (np.isnan(var) == (side != 0)).all()
    free = side == 0
    assert np.allclose(var[free], np.diag(np.linalg.inv(a[np.ix_(free, free)])), rtol=1e-6)


def test_bounded_solve_of_tables(spark, monkeypatch):
    s, t, px, src, d, w = scene(spark, n=14, size=30)
    free = {r.id: r.flux for r in solve.solve_fluxes(t, px, sky=True).collect()}
    limits = s.selectExpr("tile", "id", "if(id % 2 = 0, 20.0D, null) as lower", "if(id = 3, 1.0D, null) as upper")
    got = {r.id: r for r in solve.SOLVERS["bounded"](t, px, limits, sky=True).collect()}
    assert got.keys() == free.keys() and all(r.met for r in got.values()) and got[3].flux <= 1 and all(got[k].flux >= 20 for k in range(0, 14, 2))
    assert {r.side for r in got.values()} >= {0, -1} and all((r.variance is None) == (r.side != 0) for r in got.values())
    open_ = {r.id: r.flux for r in solve.solve_bounded(t, px, limits.where("id < 0"), sky=True).collect()}
    assert all(abs(open_[k] - free[k]) < 1e-7 for k in free)
    monkeypatch.setattr(solve, "TRIPLETS", 0)
    apart = {r.id: r.flux for r in solve.solve_bounded(t, px, limits).collect()}
    monkeypatch.undo()
    assert all(abs(r.flux - apart[r.id]) < 1e-8 for r in solve.solve_bounded(t, px, limits).collect())


@pytest.mark.parametrize("ra0,dec0", [(269.5, 67.3), (0.0, 0.0), (180.0, 89.95), (359.999, -89.9)])
def test_pairs_are_all_pairs(spark, ra0, dec0):
    rng = np.random.default_rng(5)
    c = 1 / max(math.cos(math.radians(dec0)), 1e-3)
    rows = [(i, float((ra0 + rng.uniform(-0.02, 0.02) * c) % 360), float(np.clip(dec0 + rng.uniform(-0.02, 0.02), -90, 90)), float(i)) for i in range(300)]
    cat = spark.createDataFrame(rows + [(900, None, 1.0, 1.0), (901, float("nan"), 2.0, 1.0)], "id long, ra double, dec double, flux double")
    got = {(r.left_id, r.right_id) for r in matching.others(cat, 12.0).collect()}
    want = set()
    for a in rows:
        for b in rows:
            s, t = math.sin(math.radians(b[2] - a[2]) / 2), math.sin(math.radians(b[1] - a[1]) / 2)
            if a[0] != b[0] and 2 * math.asin(min(1, math.sqrt(s * s + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * t * t))) * 206264.80624709636 <= 12.0:
                want.add((a[0], b[0]))
    assert got == want and want


def test_wcs_roundtrip_and_far_side(spark):
    w = sky.wcs(10.0, -30.0, 100.0, 80.0, -2e-5, 1e-6, 1e-6, 2e-5)
    df = spark.createDataFrame([(10.01, -30.01), (190.0, 30.0)], "ra double, dec double").withColumns(sky.sky_to_pixel(F.col("ra"), F.col("dec"), w))
    back = sky.pixel_to_sky(F.col("x"), F.col("y"), w)
    a, b = df.select("ra", "dec", back["ra"].alias("r"), back["dec"].alias("d")).collect()
    assert abs(a.r - a.ra) < 1e-10 and abs(a.d - a.dec) < 1e-10 and b.r is None


def test_planes_masks_and_sizes(spark):
    t = spark.createDataFrame([(1, "VIS", 2, [1.0, 2.0, float("nan"), 4.0], [1.0, 0.0, 1.0, 2.0], [0, 0, 0, 1])], "tile int, band string, width int, data array<double>, rms array<double>, flag array<long>")
    rows = {(r.x, r.y): r.w for r in tiles.weighted(tiles.pixels(t)).collect()}
    assert rows == {(0, 0): 1.0, (1, 0): 0.0, (0, 1): 0.0, (1, 1): 0.0}


def test_models_from_coordinates(spark):
    c = spark.createDataFrame([(1.0, 2.0, 0.5)], "RA double, Dec double, re_arcsec double")
    r = models.from_coords(c, "ExpGalaxy").head()
    assert r.re == 0.5 and r.flux == 1.0
    with pytest.raises(ValueError):
        models.from_coords(c.drop("re_arcsec"), "SersicGalaxy")
    with pytest.raises(ValueError):
        models.from_coords(c.drop("Dec"))


def test_calibration_twice_is_once(spark):
    m = spark.createDataFrame([(1, "VIS", 2.0, 1.0)], "id long, band string, err double, factor double")
    f = spark.createDataFrame([("VIS", 1.5)], "band string, factor double")
    once = catalog.recalibrated(m, f)
    assert once.head().err == 3.0 and catalog.recalibrated(once, f).head().err == 3.0


def test_flags(spark):
    c = spark.createDataFrame([(1, 10.0, 0.0, 50.0, 50.0, 100.0, True, 0), (2, 10.0005, 0.0, 5.0, 50.0, 1.0, False, 0), (3, 10.1, 0.0, 30.0, 30.0, 1.0, False, 0)], "id long, ra double, dec double, x double, y double, flux double, is_star boolean, tile int")
    bad = spark.createDataFrame([(0, 33, 27)], "tile int, x int, y int")
    f = {r.id: r for r in flags.source_flags(c, bad, 100, 100).collect()}
    assert f[1].bright_star and not f[1].near_bright_star
    assert f[2].near_bright_star and f[2].edge and f[3].masked and not any(f[k].reliable for k in f)


def test_quantiles_of_a_whole_table(spark):
    from fluxloom.functions import stats

    rng = np.random.default_rng(3)
    shares = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    for x in (rng.normal(size=5000), np.repeat([1.0, 2.0, 7.0], [3000, 1, 1999]), rng.integers(0, 40, 5000).astype(float)):
        df = spark.createDataFrame([(float(v),) for v in x], "v double").unionByName(spark.createDataFrame([(None,), (float("nan"),)], "v double")).repartition(3)
        for most in (100_000, 50):
            assert np.allclose(stats.whole_quantiles(df, F.col("v"), shares, most), np.quantile(x, shares), atol=1e-12)
    assert stats.whole_quantiles(df.limit(0), F.col("v"), [0.5]) == [None]


@pytest.mark.parametrize("most", [1_000_000, 600])
def test_statistics_of_groups_of_any_size(spark, monkeypatch, most):
    monkeypatch.setattr(stats, "MOST", most)
    rng = np.random.default_rng(4)
    groups = {"big": np.concatenate([rng.normal(0, 1, 3000), rng.normal(0, 1e9, 40)]), "ties": np.array([1.0] * 900 + [2.0] * 100), "all one": np.full(500, 7.0), "few": np.array([3.0, -1.0, 2.0, 50.0]), "one": np.array([5.0])}
    odd = [("big", None), ("big", float("nan")), ("few", float("inf")), ("none", None)]
    df = spark.createDataFrame([(k, float(x)) for k, xs in groups.items() for x in xs] + odd, "k string, v double").repartition(5)
    for share in (0.0, 0.999) if most > 600 else (0.25,):
        v = df.select("k", F.col("v").alias("_v")).where("_v is not null and abs(_v) < double('infinity')")
        got = {r.k: (r.q, r.n) for r in stats.quantiles(v, ["k"], share, "q").collect()}
        assert got.keys() == groups.keys() and all(np.isclose(got[k][0], np.quantile(x, share), rtol=1e-12) and got[k][1] == len(x) for k, x in groups.items())

    rounds = 5 if most > 600 else 1

    def clipped(x, sigma, n=5):
        for _ in range(n):
            x = x[np.abs(x - np.median(x)) <= sigma * x.std()]
        return x

    mad = {r.k: (r.mad_std, r.n) for r in stats.mad_std(df, F.col("v"), ["k"]).collect()}
    left = {r.k: (r.clipped_std, r.clipped_median, r.n) for r in stats.sigma_clipped(df, F.col("v"), ["k"], 2.5, rounds).collect()}
    for k, x in groups.items():
        c = clipped(x, 2.5, rounds)
        assert np.isclose(mad[k][0], 1.4826 * np.median(np.abs(x - np.median(x))), rtol=1e-4, atol=1e-12) and mad[k][1] == len(x)
        assert np.isclose(left[k][0], c.std(), rtol=1e-9, atol=1e-9) and left[k][1:] == (np.median(c), len(c))
    whole = stats.mad_std(df, F.col("v"), []).head()
    x = np.concatenate(list(groups.values()))
    assert np.isclose(whole.mad_std, 1.4826 * np.median(np.abs(x - np.median(x))), rtol=1e-4) and whole.n == len(x)
    if most == 600:
        return
    px = df.where("k in ('big', 'ties')").selectExpr("k", "v as data", "0D as model", "4D as weight", "if(k = 'big', 1e6D, 1D) as sky")
    chi = {r.k: (r.inflation, r.pool, r.n) for r in stats.chi_inflation(px, ["k"]).collect()}
    c = clipped(groups["big"] * 2, 3.0)
    assert np.isclose(chi["big"][0], max(1, 1.4826 * np.median(np.abs(c - np.median(c)))), rtol=1e-4) and chi["big"][1:] == (None, len(c)) and chi["ties"] == (1.0, 3.0, 1000)
    b = stats.equal_population_bins(df.where("k in ('big', 'ties')").withColumn("y", F.col("v") * 3 + 1), F.col("v"), F.col("y"), 7).collect()
    x = np.concatenate([groups["big"], groups["ties"]])
    edges = np.quantile(x, np.arange(8) / 7)
    for r in b:
        own = x[(x >= edges[r.bin]) & (x <= edges[r.bin + 1])] * 3 + 1
        assert np.isclose([r.lo, r.hi], edges[r.bin : r.bin + 2], rtol=1e-12).all() and r.n == len(own) and np.isclose(r.median_y, np.median(own), rtol=1e-9) and np.isclose(r.nmad, 1.4826 * np.median(np.abs(own - np.median(own))), rtol=1e-4)
    assert len(b) == 7 and stats.equal_population_bins(df.limit(0), F.col("v"), F.col("v"), 3).count() == 0
