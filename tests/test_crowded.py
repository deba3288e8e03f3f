"""Crowded fields, and results that small tables do not tell apart."""

import math

import pytest

from fluxloom.operators import matching


@pytest.fixture(scope="module")
def crowd(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(i, 10.0 + float(a), 20.0 + float(b), float(f)) for i, (a, b, f) in enumerate(zip(rng.uniform(0, 0.02, 1400), rng.uniform(0, 0.02, 1400), rng.uniform(-50, 100, 1400)))]
    rows += [(i + 2000, 10.1 + 0.01 * i, 20.0, 5.0) for i in range(5)]  # alone
    rows += [(3000, 10.0, 20.0, 1.0), (3001, 10.0, 20.0, 2.0)]  # at one place

    def sep(a, b):
        s, t = math.sin(math.radians(b[2] - a[2]) / 2), math.sin(math.radians(b[1] - a[1]) / 2)
        return math.degrees(2 * math.asin(math.sqrt(s * s + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * t * t))) * 3600

    near = {a[0]: [(sep(a, b), b) for b in rows if a[0] != b[0] and abs(a[2] - b[2]) < 0.01] for a in rows}
    return spark.createDataFrame(rows, "id long, ra double, dec double, flux double").repartition(3), rows, {k: [(d, b) for d, b in v if d <= 30] for k, v in near.items()}


def test_growing_circles_find_what_the_whole_circle_holds(crowd):
    cat, rows, near = crowd
    assert len(matching.growing(30.0, matching.crowding(cat, 30.0))) > 2
    want = {r[0]: min((d for d, _ in near[r[0]]), default=math.inf) for r in rows}
    got = {r.id: r.neighbour_sep for r in matching.second_nearest(cat, 30.0).collect()}
    assert got == {k: pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in want.items()}
    alone = {r[0]: not any(d > 0 and (b[3] > r[3] / 3 if r[3] > 0 else True) for d, b in near[r[0]]) for r in rows}
    assert {r.id: r.isolated for r in matching.isolated(cat, 30.0).collect()} == alone
    bright = {r[0]: min(((-b[3], b[0]) for d, b in near[r[0]] if b[3] > 0), default=(None, None))[1] for r in rows}
    assert {r.id: r.neighbour_id for r in matching.brightest_neighbour(cat, 30.0).collect()} == bright
    few = cat.where("id % 3 = 0")
    best = {r[0]: min(((d, b[0]) for d, b in [*near[r[0]], (0.0, r)] if b[0] % 3 == 0 and d <= 30), default=(None, None))[1] for r in rows if r[0] != 3001}
    assert {r.id: r.match_id for r in matching.nearest(cat, few, 30.0).where("id <> 3001").collect()} == best
    assert {r.id for r in matching.away_from(cat, few, 30.0).collect()} == {r[0] for r in rows if not any(b[0] % 3 == 0 for _, b in [*near[r[0]], (0, r)])}


def test_positional_joins_broadcast_only_what_is_counted(crowd):
    cat = crowd[0]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(matching.pairs(cat, cat, 1.0))
    assert "BroadcastHashJoin" in plan(matching.pairs(cat, cat.where("id < 9"), 1.0))


def test_positional_joins_shuffle_ids_and_positions_alone(crowd):
    """What is worked out of a position would be stored nine times."""
    lines = matching.pairs(crowd[0], crowd[0], 1.0)._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [k for k, line in enumerate(lines) if "Exchange hashpartitioning(_band" in line]
    assert len(dealt) == 2 and all("_ux" in lines[k - 1] and "_ux" not in lines[k + 1] for k in dealt)


@pytest.mark.parametrize("few", [0, 1_000])
def test_pairs_at_the_rim(spark, monkeypatch, few):
    """Only there is the exact distance asked; a pair just as far as the radius is one, unless it is to be nearer."""
    monkeypatch.setattr(matching, "FEW", few)
    cat = spark.createDataFrame([(0, 0.0, 89.9995), (1, 180.0, 89.9995), (2, 10.0, 0.0), (3, 10.0 + 1 / 3600, 0.0), (4, 10.0, 1e-9), (5, 10.0, 0.0), (6, 190.0, 0.0)], "id long, ra double, dec double")
    sep = {(r.left_id, r.right_id): r.sep for r in matching.pairs(cat, cat, 180 * 3600.0).collect()}
    assert len(sep) == 49 and sep[2, 6] == pytest.approx(180 * 3600) and sep[2, 4] == pytest.approx(3.6e-6)
    for radius in (0.0, sep[2, 4], sep[2, 3], sep[0, 1], sep[0, 2], 180 * 3600.0):
        for strict in (False, True):
            want = {k: v for k, v in sep.items() if (v < radius if strict else v <= radius)}
            assert {(r.left_id, r.right_id): r.sep for r in matching.pairs(cat, cat, radius, strict).collect()} == want


def test_distances_are_rounded_as_sql_does(spark):
    import numpy as np

    duckdb = pytest.importorskip("duckdb")
    from fluxloom.plans import queries

    rng = np.random.default_rng(1)
    x = [0.0, 5e-6, 1.000005, 4.999995, *rng.uniform(0, 5, 3000), *((rng.integers(0, 500_000, 3000) + 0.5) / 1e5)]  # halves, as near as doubles are
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double")
    t = df.toPandas()  # noqa: F841
    got = {r.i: r.y for r in df.select("i", queries.places(df.x, 5).alias("y")).collect()}
    assert got == dict(duckdb.sql("select i, round(x, 5) from t").fetchall())


def test_covered_sources_end_at_the_edge(spark):
    from fluxloom.sources import catalogs

    e = spark.createDataFrame([(10.0, 0.0, -1e-4, 0.0, 0.0, 1e-4)], "crval1 double, crval2 double, cd11 double, cd12 double, cd21 double, cd22 double")
    src = spark.createDataFrame([(1, 10.0, 31.9e-4), (2, 10.0, 32.4e-4), (3, 10.0, -31.9e-4), (4, 10.0, -32.6e-4), (5, 10.0 - 32.6e-4, 0.0)], "id long, ra double, dec double")
    assert sorted(r.id for r in catalogs.covered(src, e, 65, 65).collect()) == [1, 2, 3]
    assert sorted(r.id for r in catalogs.covered(src, e, 65, 65, margin=0.5).collect()) == [1, 3]


@pytest.mark.parametrize("few", [64, 2])
def test_nearest_on_the_plane(spark, few):
    import numpy as np

    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 40, (200, 2)) * 0.5, [*(rng.integers(0, 12, (30, 2)) * 1.5).tolist(), [90.0, 80.0]]  # many ties
    cat = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)] + [(500, 200.0, 0.0), (501, None, 1.0)], "id long, x double, y double")
    sam = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)], "id long, x double, y double")
    want = {i: min((round((x - u) ** 2 + (y - v) ** 2, 6), k) for k, (u, v) in enumerate(b))[1] for i, (x, y) in [*enumerate(a.tolist()), (500, (200.0, 0.0))]}
    assert {r.id: r.sample_id for r in matching.nearest_on_plane(cat, sam, few).collect()} == want


def test_field_ids_beyond_64_bits(spark, tmp_path):
    from fluxloom.plans import queries

    rows = [(k, c) for k, c in ((1, 2), (4_300_000, 17), (8_999_999, 899_999), (10**12, 5))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    want = {k: ((v := (k * 1000003 + c) * 2147483) >> 48 & 2047, v >> 32 & 65535, v >> 29 & 7, v >> 16 & 4095) for k, c in rows}
    assert {r[0]: tuple(r[1:]) for r in queries.QUERIES["field_id_decode"](spark, str(tmp_path)).collect()} == want


def test_pixel_sums_of_sparse_and_of_crowded_cells(spark):
    import numpy as np

    from fluxloom.operators import solve

    rng, base = np.random.default_rng(2), (1 << 60) + 1
    px = [(1, x, y, float(rng.normal()), float(rng.uniform(-0.2, 1))) for x in range(8) for y in range(4)]
    t = [(1, base + k, x, y, float(rng.uniform(0, 1))) for k in range(150) for x in range(8) for y in range(4)]  # 150 templates on a pixel
    px += [(2, 40 * k, 0, float(k), 2.0) for k in range(600)]  # about one pixel a cell
    t += [(2, base + k % 7 + m, 40 * k, 0, 0.5 + m) for k in range(650) for m in (0, 1)]
    n, light = {}, {(p, x, y): (d, w) for p, x, y, d, w in px if w > 0}
    at = {}
    for p, i, x, y, v in t:
        if (p, x, y) in light:
            at.setdefault((p, x, y), []).append((i, v))
    for k, own in at.items():
        for i, v in own:
            for j, u in own:
                if i <= j:
                    n[k[0], i, j] = n.get((k[0], i, j), 0) + u * v * light[k][1]
    rows = solve.pixel_sums(spark.createDataFrame(t, "tile int, id long, x int, y int, t double"), spark.createDataFrame(px, "tile int, x int, y int, d double, w double")).collect()
    assert len(rows) == len(n) and all(r.v == pytest.approx(n[r.tile, r.i, r.j], rel=1e-9) for r in rows)
    b = {(p, i): sum(v * light[k][0] * light[k][1] for k, own in at.items() if k[0] == p for j, v in own if j == i) for p, i in {(r.tile, r.i) for r in rows}}
    assert all(r.b == pytest.approx(b[r.tile, r.i], rel=1e-9, abs=1e-9) for r in rows if r.i == r.j)


def test_a_solve_of_tables_dealt_by_tile_moves_no_pixels(spark):
    """Templates and pixels that stand together by tile meet without a shuffle; few images a batch are told apart."""
    import numpy as np

    from fluxloom.operators import render, solve
    from fluxloom.plans import queries

    src, px, t = queries.field(spark, "/root/testdata/sf0.001")
    plan = solve.pixel_sums(t, px, full=True, sky=True)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and ("_ci" in x or " x#" in x or "(x#" in x)]
    assert not dealt and "SortMergeJoin" not in plan
    both = [{(r.tile, r.id): (r.flux, r.variance, r.information) for r in solve.solve_fluxes(t, px, sky=True, full=f).collect()} for f in (True, False)]
    assert both[0].keys() == both[1].keys() and all(both[0][k] == pytest.approx(both[1][k], rel=1e-7, abs=1e-7) for k in both[0])
    one = px.where("tile = 2").toPandas()
    own = t.where("tile = 2").toPandas()
    place = {(x, y): k for k, (x, y) in enumerate(zip(one.x, one.y))}
    ids = sorted(own.id.unique())
    a = np.zeros((len(one), len(ids) + 1))
    a[:, -1] = 1
    for r in own.itertuples():
        a[place[r.x, r.y], ids.index(r.id)] = r.t
    best = np.linalg.lstsq(a, one.d, rcond=None)[0]
    assert [both[0][2, i][0] for i in [*ids, solve.SKY]] == pytest.approx(best.tolist(), rel=1e-6)
    few = render.point_templates(src.where("id < 5"), 1.5, 8, 64, 64, ("flux",))
    assert few.columns == ["tile", "id", "x", "y", "t", "flux"]


@pytest.mark.parametrize("most", [40, 1_000_000])
def test_medians_of_joined_rows_do_not_join_again(spark, monkeypatch, most):
    """Groups beyond what is gathered: no step of the medians repeats the join, and no task holds a group's values."""
    import numpy as np

    from fluxloom.functions import stats
    from fluxloom.operators import catalog

    monkeypatch.setattr(stats, "MOST", most)
    rng = np.random.default_rng(4)
    f, g = rng.uniform(10, 900, 700), rng.normal(1, 0.1, 700)
    a = spark.createDataFrame([(i, float(x), 1.0, i % 3) for i, x in enumerate(f)], "id long, flux double, err double, colour int")
    b = spark.createDataFrame([(i, float(x * y), 1.0) for i, (x, y) in enumerate(zip(f, g))], "id long, flux double, err double")
    out = catalog.flux_ratio_bins(a, b, [0, 1, 2])
    rec = catalog.recovery(a.select("id", "flux"), b, 10, 1000)
    for df in (out, rec):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "[id#" not in plan and (most > 40 or "percentile(" not in plan)
    use = (f > 5) & (f * g > 5)
    for r in out.collect():
        x = (f * g / f)[use & (np.arange(700) % 3 == r.bin)]
        assert (r.n, r.n_off) == (len(x), int((abs(x - 1) > 0.05).sum())) and (r.ratio_median, r.nmad) == pytest.approx((np.median(x), 1.482602218505602 * np.median(abs(x - np.median(x)))), rel=1e-6)
    got = {r.bin: r for r in rec.collect()}
    assert got[-1].n == 700 and got[-1].ratio_median == pytest.approx(np.median(f * g / f)) and sum(r.n for k, r in got.items() if k >= 0) == 700


def test_nearest_vectors_in_groups_of_bounded_size(spark):
    """Many groups on both sides, copies of vectors and distances that differ by less than is told."""
    import numpy as np

    rng = np.random.default_rng(6)
    a, b = rng.normal(0, 1, (300, 5)), rng.normal(0, 1, (260, 5))
    b[200:] = b[3]  # one large group of copies
    b[150] = b[20] + 1e-12
    a[7] = b[3] + 0.01
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id long, v array<double>")
    s = spark.createDataFrame([(1000 - i, v.tolist()) for i, v in enumerate(b)], "id long, v array<double>")
    counts = {}
    out = matching.nearest_vector(q, s, "v", rows=8, landmarks=5, counts=counts, values=300)  # groups of 60 rows
    d = np.round(np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)), 9)
    want = {i: min((x, 1000 - k) for k, x in enumerate(d[i]))[1] for i in range(300)}
    assert {r.id: r.sample_id for r in out.collect()} == want
    assert want[7] == 1000 - 259 and counts["first"] + counts["rest"] < 0.9 * counts["all"]


def test_regions_of_small_tiles_are_labelled_many_a_batch(spark):
    import numpy as np

    from fluxloom.operators import detect

    calls = spark.sparkContext.accumulator(0)
    px = spark.createDataFrame([(t, y, 0) for t in (1, 2) for y in range(0, 400) if y % 50], "tile long, y int, x int")

    def lit(rows, _):
        calls.add(1)
        on = np.zeros((int(rows.y.max() - rows.y.min()) + 1, 1), bool)
        on[rows.y - rows.y.min(), 0] = True
        return int(rows.y.min()), 0, on, []

    out = detect.regions(detect.dealt(px, 4), lit, 4)
    got = {(r.tile, r.region): r["count"] for r in out.groupBy("tile", "region").count().collect()}
    assert len(got) == 16 and set(got.values()) == {49} and calls.value == 200


def test_the_catalog_leaves_no_join_to_estimates_of_size(spark, monkeypatch):
    """Tables this small are broadcast wherever Spark chooses: whatever is not counted to be few must be merged, or the driver gathers it."""
    from functools import partial

    from fluxloom.functions.small import small
    from fluxloom.operators import flags, solve
    from fluxloom.plans import queries

    want = sorted(queries.flagship(spark, "/root/testdata/sf0.001").collect())
    plans, cut = [], queries.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    for module in (queries, matching, solve):
        monkeypatch.setattr(module, "cut", seen)
    for module in (flags, solve):
        monkeypatch.setattr(module, "small", partial(small, rows=0))
    monkeypatch.setattr(matching, "FEW", 0)
    out = queries.flagship(spark, "/root/testdata/sf0.001")
    masked = flags.source_flags(out.withColumn("flux", matching.F.lit(1.0)).drop("bright_star", "near_bright_star", "masked", "edge", "reliable"), out.select("tile", matching.F.col("x").cast("int").alias("x"), matching.F.col("y").cast("int").alias("y")), 64, 64)
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (out, masked)]
    assert len(plans) > 6 and not [line for p in plans for line in p.splitlines() if "Broadcast" in line]
    assert sorted(out.collect()) == want and all(r.masked for r in masked.collect())
