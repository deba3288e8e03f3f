"""The joint flux solve: normal equations by relational sums, exact solves by component.

For each band minimise sum w (d - sum f_i t_i - sky)^2 over pixels of weight w > 0.
N[i, j] = sum t_i t_j w and b[i] = sum t_i d w are summed over cells of pixels, in which
templates and pixels meet, and only for sources that overlap. The cells' sums combine before
the shuffle, so no task holds an image's pixels. An image's triplets go to
one kernel while they are few; beyond that each connected component goes to its own. The
sky, one more unknown that all of an image's sources share, is solved from sums over their
components (a Schur complement), so the result does not depend on how sources are dealt.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import UJY_PER_NMGY
from ..functions import units
from ..functions.cut import cut
from ..functions.small import small
from .components import roots

PIXEL = ["tile", "x", "y"]
SKY = -(1 << 62)  # the id of the constant template
#: Side of the cells in which templates and pixels meet.
CELL = 64
#: Pixels of a cell, in the mean, beyond which each cell is a group of its own.
FULL = 256
#: Triplets of an image that one task solves; beyond it components are told apart in tables.
TRIPLETS = 2_000_000


def pixel_sums(templates: DataFrame, pixels: DataFrame, full: bool | None = None, sky: bool = False) -> DataFrame:
    """(tile, i, j, v, b, u) with i <= j: sums of t_i t_j w; on the diagonal also those of t d w and t w.

    templates: tile, id, x, y, t (a pixel of a source once); pixels: tile, x, y, d, w. Both meet
    in cells of CELL pixels, whose products are small dense matrices if they are full. Of sparse
    ones, with few pixels each, a task takes many in one batch, in order. Sums are added up in each task before they meet.
    Tables that are dealt by tile already are not shuffled for full cells. full: whether cells
    are, if that is known; it is counted otherwise, and the sums are the same. With sky there
    is a row more of each image, i = j = SKY: the sums of w (v) and of d w (b) of its pixels.
    """
    kind, spot = dict(templates.dtypes)["tile"], {"_ci": F.floor(F.col("x") / CELL), "_cj": F.floor(F.col("y") / CELL)}
    at = (F.col("x") - F.floor(F.col("x") / CELL) * CELL + CELL * (F.col("y") - F.floor(F.col("y") / CELL) * CELL)).cast("int").alias("at")
    key = ["tile", "_ci", "_cj"]
    double = lambda c: F.col(c).cast("double")
    t = templates.select("tile", *[c.alias(n) for n, c in spot.items()], at, F.col("id").cast("long").alias("id"), double("t").alias("t"), F.lit(0.0).alias("d"), F.lit(0.0).alias("w"), F.lit(False).alias("lit"))
    px = pixels.where("w > 0").select("tile", *[c.alias(n) for n, c in spot.items()], at, F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("t"), double("d").alias("d"), double("w").alias("w"), F.lit(True).alias("lit"))

    if full is None:
        full = (px.groupBy(*key).count().agg(F.avg("count")).head()[0] or 0) > FULL
    if full:
        left = t.select(*key, "at", "id", "t", "w")  # w is 0, and t a pixel's d where it is not
        right = px.select(*key, "at", "id", F.col("d").alias("t"), "w")

        def one(key, rows: pd.DataFrame) -> pd.DataFrame:
            lit, at, t = rows.w.to_numpy() > 0, rows["at"].to_numpy(), rows.t.to_numpy()
            place, d, w = np.full(CELL * CELL, -1), t[lit], rows.w.to_numpy()[lit]
            place[at[lit]] = np.arange(len(d))
            where = place[at[~lit]]
            seen = where >= 0
            where, t = where[seen], t[~lit][seen]
            ids, own = np.unique(rows.id.to_numpy(np.int64)[~lit][seen], return_inverse=True)
            b, u = (np.bincount(own, t * w[where] * q, len(ids)) for q in (d[where], 1.0))
            plane = np.zeros((len(w), len(ids)))
            plane[where, own] = t
            heavy, i, j, v = plane * w[:, None], [], [], []
            for k in range(0, len(ids), 256):  # some columns at a time
                n = plane.T @ heavy[:, k : k + 256]
                p, q = np.nonzero(n)
                use = p <= q + k
                i.append(p[use]), j.append(q[use] + k), v.append(n[p[use], q[use]])
            every, fill = np.arange(len(ids)), np.zeros(sum(map(len, v)))
            i, j, v = np.concatenate([*i, every]), np.concatenate([*j, every]), np.concatenate([*v, np.zeros(len(ids))])
            out = {"i": ids[i], "j": ids[j], "v": v, "b": np.concatenate([fill, b]), "u": np.concatenate([fill, u])}
            if sky:
                out = {c: np.append(x, y) for (c, x), y in zip(out.items(), (SKY, SKY, w.sum(), (d * w).sum(), 0.0), strict=True)}
            return pd.DataFrame({"tile": key[0]} | out)

        cells = left.unionByName(right).groupBy(*key).applyInPandas(one, f"tile {kind}, i long, j long, v double, b double, u double")
        return cells.groupBy("tile", "i", "j").agg(*[F.sum(c).alias(c) for c in ("v", "b", "u")])

    def sums(f: pd.DataFrame) -> pd.DataFrame:
        """Of whole cells, in order."""
        new = (f[key] != f[key].shift()).any(axis=1).to_numpy()
        cell = np.cumsum(new) - 1
        place, lit = cell * np.int64(CELL * CELL) + f["at"].to_numpy(np.int64), f.lit.to_numpy(bool)
        order = np.argsort(place[lit], kind="stable")
        pixel, d, w = place[lit][order], f.d.to_numpy()[lit][order], f.w.to_numpy()[lit][order]
        where = np.searchsorted(pixel, place)
        seen = ~lit & (where < len(pixel))
        seen[seen] = pixel[where[seen]] == place[seen]
        where, t, cell, tiles = where[seen], f.t.to_numpy()[seen], cell[seen], f.tile.to_numpy()[new]
        ids, own = np.unique(f.id[seen].to_numpy(np.int64), return_inverse=True)
        order = np.lexsort((own, where))
        where, t, cell, own = where[order], t[order], cell[order], own[order]
        parts = [(cell, own, own, np.zeros(len(t)), t * w[where] * d[where], t * w[where])]
        first = np.searchsorted(where, where, "left")
        met, held = np.bincount(cell, minlength=len(tiles)), np.bincount(cell, np.searchsorted(where, where, "right") - first, len(tiles))
        dense = held > 64 * np.maximum(met, 1)  # a pixel has many templates
        ends = np.searchsorted(cell, np.arange(len(tiles) + 1))
        for c in np.flatnonzero(dense):
            rows = slice(ends[c], ends[c + 1])
            spots, r = np.unique(where[rows], return_inverse=True)
            mine, q = np.unique(own[rows], return_inverse=True)
            plane = np.zeros((len(spots), len(mine)))
            plane[r, q] = t[rows]
            for k in range(0, len(mine), 256):  # some columns at a time
                n = plane.T @ (plane[:, k : k + 256] * w[spots][:, None])
                i, j = np.nonzero(n)
                use = i <= j + k
                i, j = i[use], j[use]
                parts.append((np.full(len(i), c), mine[i], mine[j + k], n[i, j], np.zeros(len(i)), np.zeros(len(i))))
        sparse = ~dense[cell]
        step = 0
        while sparse.any():  # each template with itself, the next on its pixel, and so on
            a = np.flatnonzero(sparse[: len(t) - step])
            a = a[where[a] == where[a + step]]
            if not len(a):
                break
            parts.append((cell[a], own[a], own[a + step], t[a] * t[a + step] * w[where[a]], np.zeros(len(a)), np.zeros(len(a))))
            step += 1
        cell, i, j, v, b, u = (np.concatenate([p[k] for p in parts]) for k in range(6))
        image, named = pd.factorize(tiles, use_na_sentinel=False)
        code, back = np.unique((image[cell] * len(ids) + i) * len(ids) + j, return_inverse=True)
        v, b, u = (np.bincount(back, x, len(code)) for x in (v, b, u))
        i, j = code // max(len(ids), 1) % max(len(ids), 1), code % max(len(ids), 1)
        use = (v != 0) | (i == j)
        return pd.DataFrame({"tile": named[code // max(len(ids), 1) ** 2], "i": ids[i], "j": ids[j], "v": v, "b": b, "u": u})[use]

    def run(frames):
        for f in whole_groups(frames, key, 100_000):
            yield sums(f)

    tasks = int(templates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = t.unionByName(px).repartition(tasks, *key).sortWithinPartitions(*key).mapInPandas(run, f"tile {kind}, i long, j long, v double, b double, u double")
    if sky:
        cells = cells.unionByName(sky_sums(pixels).select("tile", F.lit(SKY).alias("i"), F.lit(SKY).alias("j"), F.col("v").cast("double").alias("v"), F.col("b").cast("double").alias("b"), F.lit(0.0).alias("u")))
    return cells.groupBy("tile", "i", "j").agg(*[F.sum(c).alias(c) for c in ("v", "b", "u")])


def normal_matrix(templates: DataFrame, pixels: DataFrame, sky: bool = False) -> tuple[DataFrame, DataFrame]:
    """(tile, i, j, v) with i <= j, and (tile, i, b); with sky its rows too. See pixel_sums."""
    rows = pixel_sums(templates, pixels)
    one = rows.where("i = j")
    n, b = rows.select("tile", "i", "j", "v"), one.select("tile", "i", "b")
    if sky:
        own = sky_sums(pixels)
        n = n.unionByName(one.select("tile", F.lit(SKY).alias("i"), F.col("i").alias("j"), F.col("u").alias("v"))).unionByName(own.select("tile", F.lit(SKY).alias("i"), F.lit(SKY).alias("j"), "v"))
        b = b.unionByName(own.select("tile", F.lit(SKY).alias("i"), "b"))
    return n, b


def sky_sums(pixels: DataFrame) -> DataFrame:
    return pixels.where("w > 0").groupBy("tile").agg(F.sum("w").alias("v"), F.sum(F.col("d") * F.col("w")).alias("b"))


def connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A component number for each of n nodes."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


#: Share of a component's largest eigenvalue under which a direction holds no information.
RANK_TOL = 1e-12


def solve_component(a: np.ndarray, b: np.ndarray, rank_tol: float = RANK_TOL) -> tuple[np.ndarray, np.ndarray, int]:
    """Fluxes (for each column of b), covariance diagonal and rank, with columns scaled to unit length. Directions without information get no flux and infinite variance."""
    scale = 1 / np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    m = a * scale[:, None] * scale[None, :]
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    keep = values > rank_tol * max(values.max(initial=0), 1e-300)
    inv = (vectors[:, keep] / values[keep]) @ vectors[:, keep].T
    var = np.diag(inv) * scale**2
    lost = (vectors[:, ~keep] ** 2).sum(axis=1) > 1e-9
    wide = scale[:, None] if b.ndim > 1 else scale
    return inv @ (b * wide) * wide, np.where(lost, np.inf, var), int(keep.sum())


#: Unknowns of a component that are solved by one dense matrix; the result is the same.
DENSE = 400


def level_sets(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distance, in links, of each node of a connected graph from one at its rim. Links join equal or neighbouring levels."""
    ends, others = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.argsort(ends, kind="stable")
    others, first = others[order], np.searchsorted(ends[order], np.arange(n + 1))
    start, level = 0, None
    for _ in range(3):  # from the farthest node found, again
        level = np.full(n, -1)
        level[start] = 0
        front, depth = np.array([start]), 0
        while len(front):
            counts = first[front + 1] - first[front]
            at = np.repeat(first[front] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            depth += 1
            front = np.unique(others[at])
            front = front[level[front] < 0]
            level[front] = depth
        start = int(level.argmax())
    return level


def solve_levels(i: np.ndarray, j: np.ndarray, v: np.ndarray, b: np.ndarray, rank_tol: float = RANK_TOL) -> tuple[np.ndarray, np.ndarray, int]:
    """As solve_component, of a connected component's triplets (i <= j), without its dense matrix.

    Ordered by levels of a breadth-first search the matrix is block tridiagonal: blocks are
    eliminated in turn, and the inverse's diagonal blocks come back from the last to the
    first. Time and memory grow with the unknowns and the widths of levels.
    """
    n, wide = len(b), b if b.ndim > 1 else b[:, None]
    diag = np.bincount(i[i == j], v[i == j], n)
    scale = 1 / np.sqrt(np.where(diag > 0, diag, 1.0))
    u, off = v * scale[i] * scale[j], i != j
    level = level_sets(n, i[off], j[off])
    order = np.argsort(level, kind="stable")
    starts = np.searchsorted(level[order], np.arange(level.max() + 2))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n) - starts[level[order]]
    sizes = np.diff(starts)
    inside, lower = [np.zeros((k, k)) for k in sizes], [np.zeros((sizes[k + 1], sizes[k])) for k in range(len(sizes) - 1)]
    turn = level[i] > level[j]
    p, q = np.where(turn, j, i), np.where(turn, i, j)  # p stands in the lower level
    by = np.argsort(level[p], kind="stable")
    for k, (s, e) in enumerate(zip(*(np.searchsorted(level[p][by], np.arange(len(sizes)) + d) for d in (0, 1)), strict=True)):
        rows = by[s:e]
        same = level[q[rows]] == k
        r = rows[same]
        inside[k][place[p[r]], place[q[r]]] = u[r]
        inside[k][place[q[r]], place[p[r]]] = u[r]
        r = rows[~same]
        if len(r):
            lower[k][place[q[r]], place[p[r]]] = u[r]
    least = rank_tol * max(float(np.bincount(i, np.abs(u), n).max() + np.bincount(j[off], np.abs(u[off]), n).max()), 1e-300)
    y, inverse, null, rank = [], [], [], 0
    for k, block in enumerate(inside):
        r = (wide * scale[:, None])[order[starts[k] : starts[k + 1]]]
        if k:
            back = lower[k - 1] @ inverse[-1]
            block = block - back @ lower[k - 1].T
            r = r - back @ y[-1]
        values, vectors = np.linalg.eigh((block + block.T) / 2)
        keep = values > least
        inverse.append((vectors[:, keep] / values[keep]) @ vectors[:, keep].T)
        rank += int(keep.sum())
        null += [(k, z) for z in vectors[:, ~keep].T]
        y.append(r)
    x, var = np.zeros((n, wide.shape[1])), np.zeros(n)
    for k in range(len(sizes) - 1, -1, -1):
        own = order[starts[k] : starts[k + 1]]
        if k == len(sizes) - 1:
            x[own], g = inverse[k] @ y[k], inverse[k]
        else:
            up = inverse[k] @ lower[k].T
            x[own] = inverse[k] @ y[k] - up @ x[order[starts[k + 1] : starts[k + 2]]]
            g = inverse[k] + up @ g @ up.T
        var[own] = np.diag(g)
    if null:  # directions without information: none of the flux, and no bound on it
        empty = np.zeros((n, len(null)))
        for c, (k, z) in enumerate(null):
            for m in range(k, -1, -1):
                empty[order[starts[m] : starts[m + 1]], c] = z
                z = -inverse[m - 1] @ lower[m - 1].T @ z if m else z
        span = np.linalg.qr(empty)[0]
        x = x - span @ (span.T @ x)
        var = np.where((span**2).sum(axis=1) > 1e-9, np.inf, var)
    x = x * scale[:, None]
    return x if b.ndim > 1 else x[:, 0], var * scale**2, rank


def solve_any(i: np.ndarray, j: np.ndarray, v: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    if len(b) > DENSE:
        return solve_levels(i, j, v, b)
    a = np.zeros((len(b), len(b)))
    a[i, j] = a[j, i] = v
    return solve_component(a, b)


def by_component(ids: np.ndarray, i: np.ndarray, j: np.ndarray):
    """For each component of the links: its unknowns' places, and its triplets' places with i and j counted within it."""
    part = connected(len(ids), i, j)
    place = np.empty(len(ids), np.int64)
    own_order, order = np.argsort(part, kind="stable"), np.argsort(part[i], kind="stable")
    names, first = np.unique(part[own_order], return_index=True)
    lo, hi = (np.searchsorted(part[i][order], names, side) for side in ("left", "right"))
    for k, own in enumerate(np.split(own_order, first[1:])):
        place[own] = np.arange(len(own))
        rows = order[lo[k] : hi[k]]
        yield own, rows, place[i[rows]], place[j[rows]]


def in_parts(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows (tile, i, ...) with part: 0 while an image's triplets are few, else the least id of the component."""
    if (rows.groupBy("tile").count().agg(F.max("count")).head()[0] or 0) <= TRIPLETS:
        return rows.withColumn("part", F.lit(0).cast("long"))
    names = roots(links.select("tile", F.col("i").alias("a"), F.col("j").alias("b")), ["tile"])
    return rows.join(names.select("tile", F.col("id").alias("i"), "root"), ["tile", "i"], "left").withColumn("part", F.coalesce("root", "i")).drop("root")


def triplets(templates: DataFrame, pixels: DataFrame) -> DataFrame:
    """(tile, i, j, v, b, u, part): an image's triplets; those of the diagonal carry b and u."""
    rows = cut(pixel_sums(templates, pixels))
    return in_parts(rows, rows.where("i <> j"))


def whole_groups(frames, key: list[str], least: int):
    """Frames of `least` rows or more, each of whole groups, of batches that are sorted by key."""
    kept, n = [], 0
    for f in frames:
        kept.append(f)
        n += len(f)
        if n < least:
            continue
        f = pd.concat(kept, ignore_index=True) if len(kept) > 1 else f
        last = (f[key] == f[key].iloc[-1]).all(axis=1).to_numpy()  # may go on in the next batch
        if not last.all():
            yield f[~last]
            f = f[last].reset_index(drop=True)
        kept, n = [f], len(f)
    if n:
        yield pd.concat(kept, ignore_index=True)


def solve_fluxes(templates: DataFrame, pixels: DataFrame, sky: bool = False, strict: bool = False, full: bool | None = None) -> DataFrame:
    """(tile, id, flux, information, variance, rank_ok). information is the template's own (the reported error ignores blending); variance is the full one. strict raises on dependent templates. With sky the image's constant is solved with all its sources and has the id SKY."""
    every = cut(pixel_sums(templates, pixels, full, sky))
    rows = every.where(F.col("i") != SKY)
    rows = in_parts(rows, rows.where("i <> j"))
    kind = dict(templates.dtypes)["tile"]

    def solved_groups(f: pd.DataFrame) -> pd.DataFrame:
        """Of whole (tile, part) groups, in order; a group's links are within it."""
        group = np.cumsum((f[["tile", "part"]] != f[["tile", "part"]].shift()).any(axis=1).to_numpy())
        i, j = f.i.to_numpy(np.int64), f.j.to_numpy(np.int64)
        known = np.unique(i[i == j])
        i, j = (group * len(known) + np.searchsorted(known, x) for x in (i, j))
        one = np.flatnonzero(i == j)
        own = f.iloc[one[np.argsort(i[one])]]
        nodes = np.sort(i[one])
        i, j, v = np.searchsorted(nodes, i), np.searchsorted(nodes, j), f.v.to_numpy(float)
        ids, rhs = own.i.to_numpy(np.int64), own[["b", "u"]].to_numpy(float) * [1.0, sky]
        x, var, ok = np.zeros(rhs.shape), np.zeros(len(ids)), np.ones(len(ids), bool)
        for mine, at, a, b in by_component(ids, i, j):
            x[mine], var[mine], rank = solve_any(a, b, v[at], rhs[mine])
            ok[mine] = rank == len(mine)
        if strict and not ok.all():
            first = own.tile.to_numpy()[~ok][0]
            raise ValueError(f"templates of tile {first} depend on each other: {ids[~ok & (own.tile.to_numpy() == first)][:5].tolist()}")
        return pd.DataFrame({"tile": own.tile.to_numpy(), "id": ids, "flux": x[:, 0], "g": x[:, 1], "information": own.v.to_numpy(float), "variance": var, "rank_ok": ok, "ub": rhs[:, 1] * x[:, 0], "ug": rhs[:, 1] * x[:, 1]})

    def run(frames):
        for f in whole_groups(frames, ["tile", "part"], 10_000):
            yield solved_groups(f)

    names = ["tile", "id", "flux", "information", "variance", "rank_ok"]
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tile", "part").sortWithinPartitions("tile", "part")
    solved = dealt.mapInPandas(run, f"tile {kind}, id long, flux double, g double, information double, variance double, rank_ok boolean, ub double, ug double")
    if not sky:
        return solved.select(*names)
    solved = cut(solved)
    own = every.where(F.col("i") == SKY).select("tile", "v", "b").join(solved.groupBy("tile").agg(F.sum("ub").alias("ub"), F.sum("ug").alias("ug")).hint("merge"), "tile", "left").na.fill(0.0, ["ub", "ug"])
    rest = F.col("v") - F.col("ug")
    clear = rest > 1e-10 * F.col("v")  # else the templates make up a constant
    level = own.select("tile", F.when(clear, (F.col("b") - F.col("ub")) / rest).otherwise(0.0).alias("s"), F.col("v").alias("of_sky"), F.when(clear, 1 / rest).otherwise(float("inf")).alias("s_var"), clear.alias("clear"))
    if strict:
        level = level.withColumn("clear", F.when(F.col("clear"), F.col("clear")).otherwise(F.raise_error(F.lit("templates make up the sky")).cast("boolean")))
    level = cut(level)
    moved = solved.join(small(level, merge=True), "tile")
    g2 = F.when(F.col("g") == 0, 0.0).otherwise(F.col("g") * F.col("g") * F.col("s_var"))
    own_rows = moved.select("tile", "id", (F.col("flux") - F.col("s") * F.col("g")).alias("flux"), "information", (F.col("variance") + g2).alias("variance"), (F.col("rank_ok") & F.col("clear")).alias("rank_ok"))
    return own_rows.unionByName(level.select("tile", F.lit(SKY).alias("id"), F.col("s").alias("flux"), F.col("of_sky").alias("information"), F.col("s_var").alias("variance"), F.col("clear").alias("rank_ok")))


def bounded(i: np.ndarray, j: np.ndarray, v: np.ndarray, b: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Least squares within bounds: x, variance of the free ones (NaN at a bound), side (-1, 0, 1), and whether the conditions of the least are met.

    Sets of free and bound unknowns are exchanged, all that break a condition at once (a free
    one beyond its bound, a bound one whose gradient points inwards); when that gains
    nothing for ten rounds, only the last of them, which ends in any case.
    """
    n = len(b)
    off = i != j
    times = lambda x: np.bincount(i, v * x[j], n) + np.bincount(j[off], v[off] * x[i[off]], n)
    side, fewest, patience = np.zeros(n, int), n + 1, 10
    scale = np.sqrt(np.maximum(np.bincount(i[~off], v[~off], n), 1e-300))
    for _ in range(20 * n + 100):
        x = np.where(side < 0, lower, np.where(side > 0, upper, 0.0))
        var, free = np.full(n, np.nan), np.flatnonzero(side == 0)
        if len(free):
            rhs = b - times(x)
            place = np.full(n, -1)
            place[free] = np.arange(len(free))
            use = (place[i] >= 0) & (place[j] >= 0)
            for own, rows, p, q in by_component(free, place[i[use]], place[j[use]]):
                x[free[own]], var[free[own]], _ = solve_any(p, q, v[use][rows], rhs[free[own]])
        slope = (times(x) - b) / scale
        tol = 1e-9 * (1 + np.abs(b / scale).max(initial=0))
        low = (side == 0) & (x < lower - tol / scale)
        high = (side == 0) & (x > upper + tol / scale)
        inward = ((side < 0) & (slope < -tol)) | ((side > 0) & (slope > tol))
        wrong = np.flatnonzero(low | high | inward)
        if not len(wrong):
            return x, var, side, True
        if len(wrong) < fewest:
            fewest, patience = len(wrong), 10
        else:
            patience -= 1
        if patience < 0:
            wrong = wrong[-1:]
        side[wrong] = np.where(low[wrong], -1, np.where(high[wrong], 1, 0))
    return x, var, side, False


def solve_bounded(templates: DataFrame, pixels: DataFrame, limits: DataFrame, sky: bool = False) -> DataFrame:
    """(tile, id, flux, information, variance, side, met): fluxes within the limits (tile, id, lower, upper; null or no row: none).

    side: -1 or 1 at a bound (variance is null there), else 0; met: the conditions of the
    least hold. With sky the image's constant, id SKY, has no bound, and an image is solved in
    one task; without, a component is.
    """
    rows = triplets(templates, pixels)
    if sky:
        own = sky_sums(pixels)
        cross = rows.where("i = j").select("tile", F.lit(SKY).alias("i"), "j", F.col("u").alias("v"), F.lit(0.0).alias("b"))
        rows = rows.select("tile", "i", "j", "v", "b").unionByName(cross).unionByName(own.select("tile", F.lit(SKY).alias("i"), F.lit(SKY).alias("j"), "v", "b")).withColumn("part", F.lit(0).cast("long"))
    kind = dict(templates.dtypes)["tile"]
    ends = limits.select("tile", F.col("id").alias("i"), F.col("id").alias("j"), F.col("lower").cast("double").alias("lower"), F.col("upper").cast("double").alias("upper"))
    rows = rows.select("tile", "part", "i", "j", "v", "b").join(ends, ["tile", "i", "j"], "left")

    def part(key, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.i == pdf.j].sort_values("i")
        ids, rhs = own.i.to_numpy(np.int64), own.b.to_numpy(float)
        lower, upper = np.nan_to_num(own.lower.to_numpy(float), nan=-np.inf), np.nan_to_num(own.upper.to_numpy(float), nan=np.inf)
        i, j, v = np.searchsorted(ids, pdf.i.to_numpy(np.int64)), np.searchsorted(ids, pdf.j.to_numpy(np.int64)), pdf.v.to_numpy(float)
        x, var, side, met = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), int), np.ones(len(ids), bool)
        for mine, at, a, b in by_component(ids, i, j):
            x[mine], var[mine], side[mine], met[mine] = bounded(a, b, v[at], rhs[mine], lower[mine], upper[mine])
        return pd.DataFrame({"tile": key[0], "id": ids, "flux": x, "information": own.v.to_numpy(float), "variance": [None if k else float(s) for k, s in zip(side, var, strict=True)], "side": side, "met": met})

    return rows.groupBy("tile", "part").applyInPandas(part, f"tile {kind}, id long, flux double, information double, variance double, side int, met boolean")


#: Solvers by name: free is exact with scaled columns; bounded keeps limits.
SOLVERS = {"free": solve_fluxes, "scaled": solve_fluxes, "bounded": solve_bounded}


def with_errors(fluxes: DataFrame, inflation: float = 1.0) -> DataFrame:
    """flux_ujy and flux_err_ujy (null without information) from nanomaggies."""
    return fluxes.withColumns({"flux_ujy": F.col("flux") * UJY_PER_NMGY, "flux_err_ujy": units.flux_errors_ujy(F.col("information"), F.lit(inflation))})


def template_errors(templates: DataFrame, pixels: DataFrame) -> DataFrame:
    """(tile, id, information, err): 1 / sqrt(sum t^2 w) of each source, other sources held."""
    t = templates.join(pixels.where("w > 0"), PIXEL)
    info = t.groupBy("tile", "id").agg(F.sum(F.col("t") * F.col("t") * F.col("w")).alias("information"))
    return info.withColumn("err", F.when(F.col("information") > 0, 1 / F.sqrt(F.when(F.col("information") > 0, F.col("information")))))


def model_image(templates: DataFrame, fluxes: DataFrame) -> DataFrame:
    """(tile, x, y, model) summed over sources."""
    return templates.join(fluxes.select("tile", "id", "flux"), ["tile", "id"]).groupBy(*PIXEL).agg(F.sum(F.col("t") * F.col("flux")).alias("model"))


def residuals(pixels: DataFrame, model: DataFrame) -> DataFrame:
    """pixels with model (0 where no source reaches), residual and chi."""
    out = pixels.join(model, PIXEL, "left").withColumn("model", F.coalesce("model", F.lit(0.0)))
    return out.withColumns({"residual": F.col("d") - F.col("model"), "chi": (F.col("d") - F.col("model")) * F.sqrt(F.greatest("w", F.lit(0.0)))})


def recentre_step(pixels: DataFrame, keys: list[str], flux: str = "flux", min_snr: float = 10.0, min_pixels: int = 9, max_shift: float = 0.5, min_gain: float = 9.0, max_condition: float = 1e8) -> DataFrame:
    """One Gauss-Newton step of a source's position. pixels: keys, flux, err, residual r, derivatives tx, ty of the unit template, weight w.

    Five sums and a closed 2 x 2 solve. The step is 0 unless the source is
    significant, has enough pixels, is well conditioned, and chi2 falls by min_gain.
    """
    p = pixels.where("w > 0")
    gx, gy = F.col(flux) * F.col("tx"), F.col(flux) * F.col("ty")
    s = p.groupBy(*keys).agg(F.count("*").alias("n"), F.max(flux).alias("f"), F.max("err").alias("e"), F.sum(gx * gx * F.col("w")).alias("xx"), F.sum(gx * gy * F.col("w")).alias("xy"), F.sum(gy * gy * F.col("w")).alias("yy"), F.sum(gx * F.col("r") * F.col("w")).alias("bx"), F.sum(gy * F.col("r") * F.col("w")).alias("by"))
    det, tr = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"), F.col("xx") + F.col("yy")
    root = F.sqrt(F.greatest(tr * tr / 4 - det, F.lit(0.0)))
    low = tr / 2 - root
    good = (F.col("f") >= min_snr * F.col("e")) & (F.col("n") >= min_pixels) & (low > 0) & (det > 0) & ((tr / 2 + root) <= max_condition * low)
    safe = F.when(det > 0, det)
    cut = lambda c: F.greatest(F.lit(-max_shift), F.least(c, F.lit(max_shift)))
    dx, dy = cut((F.col("yy") * F.col("bx") - F.col("xy") * F.col("by")) / safe), cut((F.col("xx") * F.col("by") - F.col("xy") * F.col("bx")) / safe)
    s = s.withColumns({"dx": dx, "dy": dy})
    gain = 2 * (F.col("dx") * F.col("bx") + F.col("dy") * F.col("by")) - (F.col("dx") * F.col("dx") * F.col("xx") + 2 * F.col("dx") * F.col("dy") * F.col("xy") + F.col("dy") * F.col("dy") * F.col("yy"))
    moved = F.coalesce(good & (gain >= min_gain), F.lit(False))
    return s.withColumns({"gain": gain, "moved": moved}).select(*keys, "n", F.when(F.col("moved"), F.col("dx")).otherwise(0.0).alias("dx"), F.when(F.col("moved"), F.col("dy")).otherwise(0.0).alias("dy"), "gain", "moved")


def segment_scores(pixels: DataFrame, keys: list[str], k: str = "n_params") -> DataFrame:
    """Reduced chi2 (chi, at least one degree of freedom) and S/N (data over summed variance) of each segment."""
    p = pixels.where("w > 0")
    snr = F.sum("d") / F.sqrt(F.sum(1 / F.when(F.col("w") > 0, F.col("w"))))
    return p.groupBy(*keys).agg((F.sum(F.col("chi") * F.col("chi")) / F.greatest(F.count("*") - F.max(k), F.lit(1))).alias("rchi2"), snr.alias("snr"), F.count("*").alias("n"))
