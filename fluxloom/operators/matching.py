"""Positional joins. A catalog has columns id, ra, dec (degrees) and any others.

Both sides are cut into declination bands as high as the radius, and each band into
cells of right ascension at least as wide as the radius reaches there; one side is
sent to the three neighbours of its cell in each of three bands, and an equi-join on
(band, cell) is followed by the chord and, at the circle's rim, by the exact distance. Bands
near a pole have one cell. Every pair is found once. Rows without a finite position match
nothing. Ids and positions are shuffled; what follows from them is worked out where they arrive.

Where one neighbour settles a row (the nearest, any at all, the brightest), crowded
fields are searched in growing circles, or from the brightest down: no row meets all
that its circle holds.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sky
from ..functions.units import finite
from ..functions.cut import cut


def _placed(df: DataFrame) -> DataFrame:
    return df.where(finite(F.col("ra")) & finite(F.col("dec")))


def _side(df: DataFrame, side: str, n: str, r: float, spread: bool, cols: tuple) -> DataFrame:
    """A side of a positional join by band and cell: rows with their position; with spread in the nine cells about their own."""
    band, ra, dec = sky.band_of(F.col("dec"), r), F.col("ra"), F.col("dec")
    own = [F.col("id").alias(f"{side}_id"), ra.alias(f"_ra{n}"), dec.alias(f"_dec{n}"), *[F.col(c).alias(f"{side}_{c}") for c in cols]]
    if not spread:
        return _placed(df).select(*own, band.alias("_band"), sky.cell_of(ra, sky.cells_in_band(band, r)).alias("_cell"))
    dealt = _placed(df).select("id", "ra", "dec", *[c for c in cols if c not in ("id", "ra", "dec")]).repartition(tasks_of(df), "id")  # a small file is one task's, nine times its rows are not
    out = dealt.select(*own, F.explode(F.array(*(band + k for k in (-1, 0, 1)))).alias("_band"))
    cells = F.col("_cells")
    out = out.withColumn("_cells", sky.cells_in_band(F.col("_band"), r)).withColumn("_own", sky.cell_of(F.col(f"_ra{n}"), cells))
    return out.withColumn("_cell", F.explode(F.array_distinct(F.array(*(F.pmod(F.col("_own") + k, cells) for k in (-1, 0, 1)))))).drop("_cells", "_own")


def _vectors(rows: DataFrame, n: str) -> DataFrame:
    """A side's rows with their unit vector and cosine."""
    ra, dec = F.col(f"_ra{n}"), F.col(f"_dec{n}")
    return rows.select("*", F.cos(F.radians(dec)).alias(f"_cos{n}"), *[c.alias(f"_{k}{n}") for k, c in sky.unit_vector(ra, dec).items()])


def tasks_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pairs(left: DataFrame, right: DataFrame, radius_arcsec: float, strict: bool = False, left_cols: tuple = (), right_cols: tuple = (), spread: str = "right") -> DataFrame:
    """left_id, right_id, sep (arcsec) of all pairs with sep <= radius (< if strict), and the named columns as left_*, right_*.

    spread: the side that is sent to nine cells. The right side is broadcast only if it is
    counted to be small; else both are dealt by cell to as many tasks as shuffles have, as
    sizes in bytes tell nothing of the pairs that a task will make.
    """
    r = max(radius_arcsec, 1e-6) / 3600 * (1 + 1e-9)
    a = _side(left, "left", "", r, spread == "left", left_cols)
    b = _side(right, "right", "2", r, spread == "right", right_cols)
    if right.limit(FEW + 1).count() <= FEW:
        both = _vectors(a, "").join(F.broadcast(_vectors(b, "2")), ["_band", "_cell"])
    else:
        a, b = (x.repartition(tasks_of(left), "_band", "_cell") for x in (a, b))
        both = _vectors(a, "").join(_vectors(b, "2").hint("merge"), ["_band", "_cell"])
    apart = [F.col(f"_{k}") - F.col(f"_{k}2") for k in ("ux", "uy", "uz")]
    chord = apart[0] * apart[0] + apart[1] * apart[1] + apart[2] * apart[2]
    reach = 2 * math.sin(math.radians(min(r, 180.0)) / 2) + 1e-14  # a little over the radius, for rounding
    inner = max(2 * math.sin(math.radians(min(radius_arcsec / 3600, 180.0)) / 2) - 1e-14, 0.0)  # a little under it
    s, t = F.sin(F.radians(F.col("_dec2") - F.col("_dec")) / 2), F.sin(F.radians(F.col("_ra2") - F.col("_ra")) / 2)
    h = s * s + F.col("_cos") * F.col("_cos2") * t * t  # as sky.separation_arcsec
    sep = F.degrees(2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))) * 3600
    within = (chord < inner * inner * (1 - 1e-9)) | (sep < radius_arcsec if strict else sep <= radius_arcsec)
    out = both.where((chord <= reach * reach * (1 + 1e-9)) & within)
    return out.select("left_id", "right_id", sep.alias("sep"), *[f"left_{c}" for c in left_cols], *[f"right_{c}" for c in right_cols])


#: Rows of the right side that a positional join may broadcast (nine times).
FEW = 1_000
#: Rows of a cell, as the mean row meets them, up to which all that a circle holds is looked at.
CROWD = 32


def crowding(cat: DataFrame, radius_arcsec: float) -> float:
    """How many rows the cell of a row holds, in the mean over rows."""
    r = max(radius_arcsec, 1e-6) / 3600 * (1 + 1e-9)
    band = sky.band_of(F.col("dec"), r)
    n = _placed(cat).groupBy(band.alias("b"), sky.cell_of(F.col("ra"), sky.cells_in_band(band, r)).alias("c")).agg(F.count("*").cast("double").alias("n"))
    return n.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).head()[0] or 0.0


def growing(radius_arcsec: float, crowd: float) -> list[float]:
    """Radii up to the asked one, each twice the last; in the first a cell has some four rows."""
    k = 0 if crowd <= CROWD else min(20, math.ceil(math.log(crowd / 4, 4)))
    return [radius_arcsec / 2**i for i in range(k, 0, -1)] + [radius_arcsec]


def settled(left: DataFrame, right: DataFrame, radius_arcsec: float, aggs: list[Column], strict: bool = False, left_cols: tuple = (), right_cols: tuple = (), where: str | Column | None = None) -> DataFrame:
    """id and aggs of each left row's pairs within the first of growing circles that holds one (of those with where); rows without any are missing.

    The nearest pair, and whether there is one, are those of the whole circle.
    """
    cols = ["id", "ra", "dec"]
    radii = growing(radius_arcsec, crowding(right, radius_arcsec))
    rest, found = left, None
    if len(radii) > 1:
        rest, right = cut(_placed(left).select(*dict.fromkeys([*cols, *left_cols]))), cut(_placed(right).select(*dict.fromkeys([*cols, *right_cols])))
    for radius in radii:
        p = pairs(rest, right, radius, strict and radius == radius_arcsec, left_cols, right_cols, spread="left")
        got = (p if where is None else p.where(where)).groupBy(F.col("left_id").alias("id")).agg(*aggs)
        if len(radii) == 1:
            return got
        got = cut(got)
        found = got if found is None else found.unionByName(got)
        if radius < radius_arcsec:
            rest = cut(rest.join(got.select("id").hint("merge"), "id", "left_anti"))
            if not rest.head(1):
                break
    return found


def others(cat: DataFrame, radius_arcsec: float, cols: tuple = ()) -> DataFrame:
    """Pairs within one catalog without a row's pair with itself (by id)."""
    return pairs(cat, cat, radius_arcsec, left_cols=cols, right_cols=cols).where("left_id <> right_id")


def nearest(left: DataFrame, right: DataFrame, radius_arcsec: float, cols: tuple = (), strict: bool = False) -> DataFrame:
    """left with match_id, sep and right's cols (as match_*) of its nearest right row; null without one. Ties go to the smaller id."""
    best = settled(left, right, radius_arcsec, [F.min(F.struct("sep", "right_id", *[f"right_{c}" for c in cols])).alias("m")], strict, right_cols=cols)
    got = best.select("id", F.col("m.right_id").alias("match_id"), F.col("m.sep").alias("sep"), *[F.col(f"m.right_{c}").alias(f"match_{c}") for c in cols])
    return left.join(got.hint("merge"), "id", "left")


def nearest_unshared(left: DataFrame, right: DataFrame, radius_arcsec: float, cols: tuple = ()) -> DataFrame:
    """Nearest matches (sep < radius) whose right row no other left row has."""
    m = nearest(left, right, radius_arcsec, cols, strict=True).where("match_id is not null")
    return m.join(m.groupBy("match_id").agg(F.count("*").alias("claims")).where("claims = 1").select("match_id").hint("merge"), "match_id", "left_semi")


def nearest_greedy(left: DataFrame, right: DataFrame, radius_arcsec: float, claim_arcsec: float | None = None, cols: tuple = ()) -> DataFrame:
    """One-to-one: of the left rows with one nearest right row, the closest claims it; then sep < radius is asked. Claims reach out to claim_arcsec."""
    m = nearest(left, right, claim_arcsec or radius_arcsec, cols).where("match_id is not null")
    first = m.groupBy("match_id").agg(F.min(F.struct("sep", "id")).alias("w")).select("match_id", F.col("w.id").alias("id"))
    return m.join(first.hint("merge"), ["match_id", "id"], "left_semi").where(F.col("sep") < radius_arcsec)


def second_nearest(cat: DataFrame, radius_arcsec: float) -> DataFrame:
    """cat with neighbour_sep, the distance to the nearest other row (infinity if none is within the radius)."""
    sep = settled(cat, cat, radius_arcsec, [F.min("sep").alias("neighbour_sep")], where="left_id <> right_id")
    return cat.join(sep.hint("merge"), "id", "left").withColumn("neighbour_sep", F.coalesce("neighbour_sep", F.lit(float("inf"))))


def away_from(left: DataFrame, right: DataFrame, radius_arcsec: float) -> DataFrame:
    """Rows of left with no right row at sep < radius."""
    return left.join(settled(left, right, radius_arcsec, [F.lit(True).alias("hit")], strict=True).select("id").hint("merge"), "id", "left_anti")


def ring_neighbours(cat: DataFrame, existing: DataFrame, ra: float, dec: float, half_deg: float, buffer_arcsec: float, clear_arcsec: float = 3.0) -> DataFrame:
    """Rows of the ring around a square field that are not within clear_arcsec of an existing source, by (ra, dec) so that solves repeat."""
    ring = cat.where(sky.box(F.col("ra"), F.col("dec"), ra, dec, half_deg + buffer_arcsec / 3600) & ~sky.box(F.col("ra"), F.col("dec"), ra, dec, half_deg))
    return away_from(ring, existing, clear_arcsec).orderBy("ra", "dec", "id")


def isolated(cat: DataFrame, radius_arcsec: float, flux_fraction: float = 1 / 3) -> DataFrame:
    """cat with isolated: no other position within the radius has more than the fraction of the row's flux. A row without positive flux is isolated only without neighbours; exact coincidences don't count."""
    own = F.when(finite(F.col("left_flux")) & (F.col("left_flux") > 0), F.col("left_flux"))
    hit = (F.col("left_id") != F.col("right_id")) & (F.col("sep") > 0) & F.when(own.isNull(), F.lit(True)).otherwise(F.coalesce(F.col("right_flux") > flux_fraction * own, F.lit(False)))
    bad = settled(cat, cat, radius_arcsec, [F.lit(True).alias("bad")], left_cols=("flux",), right_cols=("flux",), where=hit)
    return cat.join(bad.hint("merge"), "id", "left").withColumn("isolated", ~F.coalesce("bad", F.lit(False))).drop("bad")


def brightest_neighbour(cat: DataFrame, radius_arcsec: float) -> DataFrame:
    """cat with neighbour_id and neighbour_flux of the brightest other row of positive flux within the radius.

    In crowded fields the brightest rows are asked first, four times as many in each round;
    what has one of them within the radius is settled, as any brighter row was among them.
    """
    right, rest, found = cat.where("flux > 0"), cat, None
    crowd = crowding(right, radius_arcsec)
    levels = [None]
    if crowd > CROWD:
        right, rest = cut(_placed(right).select("id", "ra", "dec", "flux")), cut(_placed(cat).select("id", "ra", "dec"))
        shares = [4 * 4**k / crowd for k in range(math.ceil(math.log(crowd / 4, 4)))]
        levels = [*right.agg(F.percentile_approx("flux", [1 - x for x in shares], 10_000)).head()[0], None]
    for level in levels:
        n = pairs(rest, right if level is None else right.where(F.col("flux") >= level), radius_arcsec, right_cols=("flux",), spread="left").where("left_id <> right_id")
        got = n.groupBy(F.col("left_id").alias("id")).agg(F.max(F.struct(F.col("right_flux"), (-F.col("right_id")).alias("k"))).alias("m"))
        if len(levels) > 1:
            got = cut(got)
        found = got if found is None else found.unionByName(got)
        if level is not None:
            rest = cut(rest.join(got.select("id").hint("merge"), "id", "left_anti"))
            if not rest.head(1):
                break
    return cat.join(found.select("id", (-F.col("m.k")).alias("neighbour_id"), F.col("m.right_flux").alias("neighbour_flux")).hint("merge"), "id", "left")


def nearest_sample(cat: DataFrame, samples: DataFrame, keys: tuple = (), first_arcsec: float = 30.0, flat: bool = False) -> DataFrame:
    """cat with sample_id of the nearest PSF sample by chord length (safe across RA 0), or with flat by tangent offsets at the row, no interpolation; samples share keys (such as band) with cat.

    Rows meet the samples within a radius by cells; those that find none are asked again
    with four times the radius, up to the whole sky, so no row meets all samples unless
    they are all that near. Ties go to the smaller id; a row without a position, or
    whose keys have no sample, has none.
    """
    u, v = (sky.unit_vector(F.col(f"left_{p}"), F.col(f"left_{q}")) if k == 0 else sky.unit_vector(F.col(f"right_{p}"), F.col(f"right_{q}")) for k, p, q in ((0, "ra", "dec"), (1, "ra", "dec")))
    d2 = sum(((u[k] - v[k]) * (u[k] - v[k]) for k in ("ux", "uy", "uz")), F.lit(0.0))
    if flat:
        o = sky.tangent_offsets_arcsec(F.col("left_ra"), F.col("left_dec"), F.col("right_ra"), F.col("right_dec"))
        d2 = o["dx"] * o["dx"] + o["dy"] * o["dy"]
    rest, found, radius = _placed(cat).select("id", "ra", "dec", *keys), None, first_arcsec
    known = samples.select(*keys).distinct() if keys else None
    if known is not None:
        rest = rest.join(known, list(keys), "left_semi")
    while samples.head(1) and rest.head(1):
        near = pairs(rest, samples, radius, left_cols=("ra", "dec", *keys), right_cols=("ra", "dec", *keys))
        for k in keys:
            near = near.where(F.col(f"left_{k}") == F.col(f"right_{k}"))
        if flat and radius < 180 * 3600:  # the plane and the sphere differ a little at the circle's rim
            near = near.where(d2 <= (0.98 * radius) ** 2)
        best = cut(near.groupBy(F.col("left_id").alias("id")).agg(F.min(F.struct(F.round(d2, 15).alias("d2"), F.col("right_id").alias("sample_id"))).alias("m")).select("id", "m.sample_id"))
        found = best if found is None else found.unionByName(best)
        if radius >= 180 * 3600:
            break
        rest, radius = cut(rest.join(best, "id", "left_anti")), min(4 * radius, 180 * 3600.0)
    none = cat.withColumn("sample_id", F.lit(None).cast(samples.schema["id"].dataType))
    return none if found is None else cat.join(found, "id", "left")


def nearest_on_plane(cat: DataFrame, samples: DataFrame, few: int = 64) -> DataFrame:
    """id and sample_id of the sample (id, x, y) nearest to each row (id, x, y) in the plane; squared distances are rounded to six decimals, and ties go to the smaller id. Rows without a finite position are missing.

    Up to `few` samples are compared in place, as one broadcast array. More of them meet rows
    in square cells that double; what a circle of the cell's side holds is settled.
    """
    spot = lambda df: df.where(finite(F.col("x")) & finite(F.col("y"))).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rest, known, found = spot(cat), spot(samples), None
    d2 = lambda x, y: F.round((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y), 6)
    if known.limit(few + 1).count() <= few:
        every = F.broadcast(known.agg(F.collect_list(F.struct("id", "x", "y")).alias("s")))  # one row
        best = F.array_min(F.transform("s", lambda s: F.struct(d2(s["x"], s["y"]).alias("d2"), s["id"].alias("id"))))
        return rest.repartition(tasks_of(cat), "id").crossJoin(every).select("id", best["id"].alias("sample_id"))
    rest, known = cut(rest), cut(known)
    n, *ends = known.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).head()
    own = rest.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).head()
    if own[0] is None:
        return rest.select("id", F.lit(None).cast(samples.schema["id"].dataType).alias("sample_id"))
    spans = [max(ends[k + 1], own[k + 1]) - min(ends[k], own[k]) for k in (0, 2)]
    whole = max(math.hypot(*spans), 1e-9) * (1 + 1e-9) + 1e-3
    side = min(whole, max(2 * math.sqrt(max((ends[1] - ends[0]) * (ends[3] - ends[2]), 0.0) / n), whole / 2**20))
    while True:
        cell = lambda c: F.floor(F.col(c) / side).cast("long")  # noqa: B023, E731
        around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
        a = rest.withColumns({"_i": cell("x"), "_j": cell("y")})
        b = known.select(F.col("id").alias("sample_id"), F.col("x").alias("_x"), F.col("y").alias("_y"), cell("x").alias("_a"), cell("y").alias("_b"), around.alias("k")).select("sample_id", "_x", "_y", (F.col("_a") + F.col("k.i")).alias("_i"), (F.col("_b") + F.col("k.j")).alias("_j"))
        met = a.repartition(tasks_of(cat), "_i", "_j").join(b.repartition(tasks_of(cat), "_i", "_j").hint("merge"), ["_i", "_j"]).withColumn("d2", d2(F.col("_x"), F.col("_y")))
        got = cut(met.where(F.col("d2") <= side * side * (1 - 1e-9) - 1e-6).groupBy("id").agg(F.min(F.struct("d2", "sample_id")).alias("m")).select("id", "m.sample_id"))
        found = got if found is None else found.unionByName(got)
        rest = cut(rest.join(got.select("id").hint("merge"), "id", "left_anti"))
        if side > 1.01 * whole or not rest.head(1):
            return found
        side *= 2


#: Landmarks in feature space, rings of samples about each by distance, and rows of a block of a ring.
LANDMARKS, RINGS, BLOCK = 64, 8, 256
#: Numbers of a group of vectors (32 MB), and groups of queries that are made of fewer, for tasks to share.
VALUES, SHARED = 1 << 22, 32


def nearest_vector(queries: DataFrame, samples: DataFrame, column: str, rows: int = BLOCK, landmarks: int = LANDMARKS, counts: dict | None = None, values: int = VALUES) -> DataFrame:
    """id, sample_id, distance: the nearest of all samples of each query in feature space; distances are compared to nine decimals, and ties go to the smaller id.

    Both sides are dealt into groups of up to some `values` numbers, and each group of queries
    meets each of samples, so a task holds two groups, however many rows there are. In a
    group samples stand in blocks of `rows` by their nearest landmark (some of the samples,
    a bounded number) and their distance from it. By the triangle inequality a query is
    no nearer to any sample of a block than its distance from the landmark tells; it is compared
    with the most promising blocks first, and not with those whose bound exceeds what it has
    found. Products of blocks tell which samples may be the nearest; those are compared exactly.
    Equal samples are one. Vectors match those of their own length; a query that is null or not
    finite has no sample (null), and no such sample is found. counts: gets the pairs of rows
    that are compared (first: those of queries' first blocks), and all pairs.
    """
    import pyarrow as pa

    kinds = {side: df.schema["id"].dataType.simpleString() for side, df in (("q", queries), ("s", samples))}

    def finite_rows(df: DataFrame) -> DataFrame:
        single = df.schema[column].dataType.simpleString() == "array<float>"
        v = df.select("id", F.col(column).cast("array<float>" if single else "array<double>").alias("v")).where("v is not null")
        return v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).withColumn("size", F.size("v"))

    q, known = cut(finite_rows(queries)), finite_rows(samples)
    s = cut(known.groupBy("v", "size").agg(F.min("id").alias("id")))
    (n_queries, widest), n_samples = q.agg(F.count("*"), F.max("size")).head(), s.count()
    if not n_queries or not n_samples:
        return queries.select("id", F.lit(None).cast(kinds["s"]).alias("sample_id"), F.lit(None).cast("double").alias("distance"))
    share = max(1, n_samples // (4 * landmarks))
    marks: dict[int, np.ndarray] = {}
    for r in s.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).groupBy("size").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("v").alias("h"), "v"))), 1, landmarks)["v"].alias("m")).collect():
        marks[r["size"]] = np.array(r.m, float).reshape(len(r.m), r["size"])  # some four times the landmarks are looked at

    most = max(rows, values // max(widest, 1))  # rows of a group
    of_q, of_s = max(-(-n_queries // most), min(SHARED, -(-n_queries // 1024))), -(-n_samples // most)

    def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T), 0)

    def plane(t, size: int) -> tuple[np.ndarray, np.ndarray]:
        return t.column("id").to_numpy(), t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(t), size)

    def least(key, left, right):
        if not len(left) or not len(right):
            return None
        size = key[0].as_py()
        (q_ids, x), (s_ids, y) = plane(left, size), plane(right, size)
        m = marks.get(size, y[:1])
        own = np.sqrt(squares(y, m))
        mark = own.argmin(axis=1)
        far = own[np.arange(len(y)), mark]
        order = np.lexsort((far, mark))
        s_ids, y, mark, far = s_ids[order], y[order], mark[order], far[order]
        yy = (y * y).sum(axis=1)
        turns = np.flatnonzero(mark[1:] != mark[:-1]) + 1
        blocks = [(k, min(k + n, hi)) for lo, hi in zip([0, *turns], [*turns, len(y)], strict=True) for n in [min(rows, -(-(hi - lo) // RINGS))] for k in range(lo, hi, n)]
        at = np.array([mark[lo] for lo, _ in blocks])
        near, away = np.array([far[lo] for lo, _ in blocks]), np.array([far[hi - 1] for _, hi in blocks])
        seen = np.concatenate([squares(x[k : k + 4096], m).argmin(axis=1) for k in range(0, len(x), 4096)])
        order = np.argsort(seen, kind="stable")
        q_ids, x, seen = q_ids[order], x[order], seen[order]
        turns = np.flatnonzero(seen[1:] != seen[:-1]) + 1
        parts = [(k, min(k + 2048, hi)) for lo, hi in zip([0, *turns], [*turns, len(x)], strict=True) for k in range(lo, hi, 2048)]
        slack = yy.max(initial=0)
        told, exact, best = np.full(len(x), np.inf), np.full(len(x), np.inf), np.zeros(len(x), s_ids.dtype)
        first, rest = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for k, end in parts:  # queries about one landmark
            rows_ = slice(k, end)
            mine = x[rows_]
            xx = (mine * mine).sum(axis=1)
            off = 1e-12 * (xx + slack) + 1e-300  # of a square, by rounding
            d = np.sqrt(squares(mine, m))[:, at]
            wide = np.sqrt(1e-12 * (xx + slack))[:, None]  # of a distance from a landmark
            bound = np.maximum(0, np.maximum(d - away, near - d) - 2 * wide - 1e-9)
            for c in np.lexsort((d.sum(axis=0), bound.sum(axis=0))):
                use = np.flatnonzero(bound[:, c] <= told[rows_] + 2e-9)
                if not len(use):
                    continue
                lo, hi = blocks[c]
                fresh = np.isinf(told[k + use])
                first[k + use[fresh]] += hi - lo
                rest[k + use[~fresh]] += hi - lo
                a = mine if len(use) == len(mine) else mine[use]
                d2 = xx[use][:, None] + yy[lo:hi] - 2 * (a @ y[lo:hi].T)
                limit = (np.sqrt(np.maximum(d2.min(axis=1), 0) + off[use]) + 2e-9) ** 2 + off[use]
                limit = np.minimum(limit, (told[k + use] + 2e-9) ** 2 + off[use])
                p, z = np.nonzero(d2 <= limit[:, None])
                for e in range(0, len(p), 1 << 16):
                    i, j = k + use[p[e : e + (1 << 16)]], lo + z[e : e + (1 << 16)]
                    found = np.sqrt(((x[i] - y[j]) ** 2).sum(axis=1))
                    short = np.round(found, 9)
                    by = np.lexsort((s_ids[j], short, i))
                    i, j, found, short = i[by], j[by], found[by], short[by]
                    top = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                    i, j, found, short = i[top], j[top], found[top], short[top]
                    win = (short < told[i]) | ((short == told[i]) & (s_ids[j] < best[i]))
                    i, j = i[win], j[win]
                    told[i], exact[i], best[i] = short[win], found[win], s_ids[j]
        return pa.table({"id": q_ids, "told": told, "sample_id": best, "distance": exact, "first": first, "rest": rest})

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.select("id", "v", "size", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    def run(key, left, right):
        out = least(key, left, right)
        return empty if out is None else out.cast(empty.schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = f"id {kinds['q']}, told double, sample_id {kinds['s']}, distance double, first long, rest long"
    empty = to_arrow_schema(StructType.fromDDL(kind)).empty_table()
    key = ["size", "i", "j"]
    met = dealt(q, "i", of_q, "j", of_s).groupBy(*key).cogroup(dealt(s, "j", of_s, "i", of_q).groupBy(*key)).applyInArrow(run, kind)
    found = cut(met.groupBy("id").agg(F.min(F.struct("told", "sample_id", "distance")).alias("m"), F.sum("first").alias("first"), F.sum("rest").alias("rest")))
    if counts is not None:
        counts["first"], counts["rest"] = found.agg(F.sum("first"), F.sum("rest")).head()
        counts["all"] = n_queries * known.count()
    return queries.select("id").distinct().join(found.hint("merge"), "id", "left").select("id", "m.sample_id", "m.distance")


def grid_node(x: Column, step: float) -> Column:
    """The node of a regular grid, halves to even."""
    return F.rint(x / step).cast("long")


def detector_node(x: Column) -> Column:
    """The nearest of the five detector positions where PRFs are tabulated."""
    nodes = (25, 77, 129, 181, 233)
    return F.array_min(F.array(*(F.struct(F.abs(x - n).alias("d"), F.lit(n).alias("n")) for n in nodes)))["n"]


def top_of_group(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group by the order, with a partial sort only."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
