"""Robust statistics over groups. Medians are exact (linear between neighbours); NaN and infinities are left out as nulls are."""

from __future__ import annotations

import bisect
import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import MAD_SCALE
from .cut import cut
from .small import small
from .units import finite


def median(c: Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def whole_quantiles(df: DataFrame, value: Column, shares: list[float], most: int = 400_000) -> list[float | None]:
    """Exact quantiles (linear between neighbours) of a whole table; None of no rows.

    A quantile's rank is bracketed by approximate ones, and the bracket narrowed until
    it has `most` rows at most, whose counts per value come to the driver. No task holds
    the table's values.
    """
    v = df.select(value.cast("double").alias("_v")).where(finite(F.col("_v")))
    n = v.count()
    if not n:
        return [None] * len(shares)
    if n <= most:
        return list(v.agg(F.percentile("_v", F.lit(shares))).head()[0])
    ranks = [(n - 1) * share for share in shares]
    ends, below, rows = [(-math.inf, math.inf)] * len(shares), [0] * len(shares), [n] * len(shares)
    while max(rows) > most:
        wide = [k for k, m in enumerate(rows) if m > most]
        inside = [(F.col("_v") >= ends[k][0]) & (F.col("_v") <= ends[k][1]) for k in wide]
        at = [(ranks[k] - below[k]) / rows[k] for k in wide]
        got = v.agg(*[F.percentile_approx(F.when(c, F.col("_v")), [max(0.0, p - 2e-3), min(1.0, p + 2e-3)], 10_000) for c, p in zip(inside, at, strict=True)]).head()
        near = [(e[0] if p > 2e-3 else ends[k][0], e[1] if p < 1 - 2e-3 else ends[k][1]) for k, p, e in zip(wide, at, got, strict=True)]
        counts = v.agg(*[c for lo, hi in near for c in (F.count_if(F.col("_v") < lo), F.count_if((F.col("_v") >= lo) & (F.col("_v") <= hi)))]).head()
        moved = False
        for k, e, less, m in zip(wide, near, counts[::2], counts[1::2], strict=True):
            if less <= math.floor(ranks[k]) and math.ceil(ranks[k]) < less + m < less + rows[k]:
                ends[k], below[k], rows[k], moved = e, less, m, True
        if not moved:  # one value fills a bracket
            break
    some = F.lit(False)
    for lo, hi in set(ends):
        some = some | ((F.col("_v") >= lo) & (F.col("_v") <= hi))
    held = [(r["_v"], r["count"]) for r in v.where(some).groupBy("_v").count().orderBy("_v").toLocalIterator()]
    out = []
    for (lo, hi), rank, first in zip(ends, ranks, below, strict=True):
        own = [(x, m) for x, m in held if lo <= x <= hi]
        past = list(itertools.accumulate((m for _, m in own), initial=first))[1:]
        a, b = (own[bisect.bisect_right(past, k)][0] for k in (math.floor(rank), math.ceil(rank)))
        out.append(a + (b - a) * (rank - math.floor(rank)))
    return out


#: Values of a group that one task may gather (8 MB of them). The groups are counted first; beyond it nothing is gathered.
MOST = 1_000_000
#: Parts into which a round of the search splits a group, and the share on either side of the one asked for in the first.
PARTS, NEAR = 64, 2e-3


def largest(v: DataFrame, keys: list[str]) -> int:
    return v.groupBy(*keys).count().agg(F.max("count")).head()[0] or 0


def gathered(v: DataFrame, keys: list[str]) -> DataFrame:
    """keys and _a, the group's values (_v) in order; for groups of MOST values at most."""
    return v.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_a"))


def let(x: Column, f) -> Column:
    """f of x, with x worked out once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def middle(a: Column) -> Column:
    """Median of a sorted array; null of an empty one."""
    return let(a, lambda v: F.when(F.size(v) > 0, (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2))


def array_deviation(a: Column) -> Column:
    """Population deviation of an array's values."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    return let(mean(a), lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a)))


def array_deviation_robust(a: Column) -> Column:
    """1.4826 times the median distance of a sorted array's values from their median."""
    return MAD_SCALE * let(middle(a), lambda m: middle(F.sort_array(F.transform(a, lambda x: F.abs(x - m)))))


def met(v: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """v with its group's columns: one row for all, or a join that broadcasts the groups if they are few."""
    return v.join(small(groups), keys) if keys else v.crossJoin(F.broadcast(groups))  # one row


def quantiles(v: DataFrame, keys: list[str], share: float, name: str = "_q") -> DataFrame:
    """keys, name, n: the exact quantile (linear between neighbours) of the finite values _v of each group.

    Groups of up to MOST values are gathered as counts. Of larger ones the rank is
    bracketed by approximate quantiles, for all groups at once (first by two about the share,
    then by a grid); values below and in the bracket are counted in each task before they meet, and the bracket is narrowed until
    it holds MOST values or one value fills it.
    """
    if largest(v, keys) <= MOST:
        return v.groupBy(*keys).agg(F.percentile("_v", F.lit(share)).alias(name), F.count("*").alias("n"))
    rank = (F.col("n") - 1) * share
    infinity = F.lit(math.inf)
    ends = F.percentile_approx("_v", [max(0.0, share - NEAR), min(1.0, share + NEAR)], 10_000)
    first = cut(v.groupBy(*keys).agg(F.count("*").alias("n"), ends.alias("e")).where("n > 0").select(*keys, "n", rank.alias("rank"), (F.get("e", F.lit(0)) if share > NEAR else -infinity).alias("a"), (F.get("e", F.lit(1)) if share < 1 - NEAR else infinity).alias("b")))
    inside = F.col("_v").between(F.col("a"), F.col("b"))
    counted = met(v, first, keys).groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("n", "rank", "a", "b")], F.count_if(F.col("_v") < F.col("a")).alias("less"), F.count_if(inside).alias("m"))
    holds = (F.col("less") <= F.floor("rank")) & (F.ceil("rank") < F.col("less") + F.col("m"))
    state = cut(counted.select(*keys, "n", "rank", *[F.when(holds, F.col(x)).otherwise(y).alias(z) for x, y, z in (("a", -infinity, "lo"), ("b", infinity, "hi"), ("less", F.lit(0).cast("long"), "below"), ("m", F.col("n"), "rows"))]))
    while (state.agg(F.max("rows")).head()[0] or 0) > MOST:
        wide = state.where(F.col("rows") > MOST)
        inside = met(v, wide, keys).where(F.col("_v").between(F.col("lo"), F.col("hi")))
        grid = inside.groupBy(*keys).agg(F.percentile_approx("_v", [k / PARTS for k in range(PARTS + 1)], 10_000).alias("grid"))
        at = F.floor((F.col("rank") - F.col("below")) / F.col("rows") * PARTS).cast("int")
        near = met(wide, grid, keys).withColumns({"a": F.when(at >= 1, F.get("grid", at - 1)).otherwise(F.col("lo")), "b": F.when(at + 2 <= PARTS, F.get("grid", at + 2)).otherwise(F.col("hi"))})
        near = cut(near.select(*keys, "a", "b"))
        counts = met(v, near, keys).groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b"), F.count_if(F.col("_v") < F.col("a")).alias("less"), F.count_if(F.col("_v").between(F.col("a"), F.col("b"))).alias("m"))
        holds = (F.col("less") <= F.floor("rank")) & (F.ceil("rank") < F.col("less") + F.col("m")) & (F.col("m") < F.col("rows"))
        both = state.join(counts, keys, "left") if keys else state.crossJoin(F.broadcast(counts))  # one row
        new = cut(both.select(*keys, "n", "rank", *[F.when(holds, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("a", "lo"), ("b", "hi"), ("less", "below"), ("m", "rows"))], F.coalesce(holds, F.lit(False)).alias("moved")))
        state, moved = new.drop("moved"), new.where("moved").count()
        if not moved:  # one value fills a bracket
            break
    held = met(v, state, keys).where(F.col("_v").between(F.col("lo"), F.col("hi"))).groupBy(*keys, "n", "rank", "below", "_v").agg(F.count("*").alias("c"))
    past = F.col("below") + F.sum("c").over(Window.partitionBy(*keys).orderBy("_v"))  # of a bracket's values
    placed = held.withColumn("past", past).withColumn("first", F.col("past") - F.col("c"))
    of = lambda k: F.max(F.when((F.col("first") <= k) & (k < F.col("past")), F.col("_v")))
    ends = placed.groupBy(*keys, "n", "rank").agg(of(F.floor("rank")).alias("a"), of(F.ceil("rank")).alias("b"))
    return ends.select(*keys, (F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))).alias(name), "n")


def medians(df: DataFrame, value: Column, keys: list[str], name: str = "median") -> DataFrame:
    """keys, name, n: the median of each group's finite values."""
    return quantiles(df.select(*keys, value.cast("double").alias("_v")).where(finite(F.col("_v"))), keys, 0.5, name)


def mad_std(df: DataFrame, value: Column, keys: list[str], name: str = "mad_std") -> DataFrame:
    """keys, name, n: 1.4826 times the median distance from the median."""
    v = df.select(*keys, value.cast("double").alias("_v")).where(finite(F.col("_v")))
    if largest(v, keys) <= MOST:
        return mad_of(gathered(v, keys), keys, name)
    off = met(v, quantiles(v, keys, 0.5, "_m"), keys).select(*keys, F.abs(F.col("_v") - F.col("_m")).alias("_v"))
    return quantiles(off, keys, 0.5, "_d").select(*keys, (MAD_SCALE * F.col("_d")).alias(name), "n")


def mad_of(groups: DataFrame, keys: list[str], name: str, *more: str) -> DataFrame:
    told = let(F.col("_a"), lambda a: F.struct(array_deviation_robust(a).alias(name), F.size(a).cast("long").alias("n")))
    return groups.select(*keys, *more, F.inline(F.array(told)))


def clipped_array(a: Column, sigma: float, iterations: int) -> Column:
    """A sorted array without, round by round, what lies over sigma population deviations from its median."""
    near = lambda v: let(middle(v), lambda m: let(array_deviation(v), lambda s: F.filter(v, lambda x: F.abs(x - m) <= sigma * s)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), a, lambda v, _: near(v))


def clip_limits(v: DataFrame, keys: list[str], sigma: float = 3.0, iterations: int = 5) -> DataFrame:
    """keys, lo and hi: the span that the rounds of clipping leave of each group, from sums and medians alone."""
    s = v.groupBy(*keys).agg(F.lit(-math.inf).alias("lo"), F.lit(math.inf).alias("hi"))
    for _ in range(iterations):
        s = cut(s)
        inside = met(v, s, keys).where(F.col("_v").between(F.col("lo"), F.col("hi"))).select(*keys, "_v")
        spread = inside.groupBy(*keys).agg(F.stddev_pop("_v").alias("_s"))
        now = met(quantiles(inside, keys, 0.5, "_m"), spread, keys)
        s = met(s, now, keys).select(*keys, F.greatest("lo", F.col("_m") - sigma * F.col("_s")).alias("lo"), F.least("hi", F.col("_m") + sigma * F.col("_s")).alias("hi"))
    return cut(s)


def within(v: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    return met(v, limits, keys).where(F.col("_v").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def sigma_clipped(df: DataFrame, value: Column, keys: list[str], sigma: float = 3.0, iterations: int = 5) -> DataFrame:
    """keys, clipped_std, clipped_median, n after rounds that drop what lies over sigma population deviations from the median."""
    v = df.select(*keys, value.cast("double").alias("_v")).where(finite(F.col("_v")))
    if largest(v, keys) <= MOST:
        told = let(clipped_array(F.col("_a"), sigma, iterations), lambda a: F.struct(array_deviation(a).alias("clipped_std"), middle(a).alias("clipped_median"), F.size(a).cast("long").alias("n")))
        return gathered(v, keys).select(*keys, F.inline(F.array(told)))
    left = within(v, clip_limits(v, keys, sigma, iterations), keys)
    spread = left.groupBy(*keys).agg(F.stddev_pop("_v").alias("clipped_std"))
    return met(quantiles(left, keys, 0.5, "clipped_median"), spread, keys).select(*keys, "clipped_std", "clipped_median", "n")


def chi_inflation(pixels: DataFrame, keys: list[str], least: int = 50) -> DataFrame:
    """Error inflation from residuals. pixels: keys, data, model, weight, sky.

    chi of pixels with weight is pooled where |model - sky| is under 1, 2, 3, 5
    deviations of the pixel: the first pool of `least` pixels counts, else all
    pixels, clipped at three deviations in five rounds (pool is null then). The factor
    is max(1, mad_std of the pool).
    """
    p = pixels.where((F.col("weight") > 0) & finite(F.col("data")) & finite(F.col("model"))).select(*keys, ((F.col("data") - F.col("model")) * F.sqrt("weight")).cast("double").alias("_v"), (F.abs(F.col("model") - F.col("sky")) * F.sqrt("weight")).alias("depth"))
    counts = p.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count(F.when(F.col("depth") < k, 1)).alias(f"n{k}") for k in (1, 2, 3, 5)])
    limit = F.when(F.col("n1") >= least, 1.0).when(F.col("n2") >= least, 2.0).when(F.col("n3") >= least, 3.0).when(F.col("n5") >= least, 5.0)
    pools = cut(counts.where("n > 0").select(*keys, "n", limit.alias("pool")))
    most, open_ = pools.agg(F.max("n"), F.count_if(F.col("pool").isNull())).head()
    v = met(p, pools.drop("n"), keys).where(F.col("pool").isNull() | (F.col("depth") < F.col("pool"))).select(*keys, "pool", "_v").where(finite(F.col("_v")))
    if (most or 0) <= MOST:
        a = gathered(v, [*keys, "pool"])
        if open_:
            a = a.select(*keys, "pool", F.when(F.col("pool").isNull(), clipped_array(F.col("_a"), 3.0, 5)).otherwise(F.col("_a")).alias("_a"))
        spread = mad_of(a, keys, "spread", "pool")
    else:
        if open_:
            rest = v.where("pool is null").select(*keys, "_v")
            rest = within(rest, clip_limits(rest, keys), keys)
            v = v.where("pool is not null").unionByName(rest.withColumn("pool", F.lit(None).cast("double")))
        spread = met(mad_std(v, F.col("_v"), keys, "spread"), pools.drop("n"), keys)
    return spread.select(*keys, F.greatest(F.lit(1.0), "spread").alias("inflation"), "pool", "n")


def bisected(x: Column, edges: list[float], lo: int, hi: int, test) -> Column:
    """The first k from lo to hi for which test(x, edges[k]) holds (hi if for none before), by a tree of comparisons."""
    if lo == hi:
        return F.lit(lo)
    k = (lo + hi) // 2
    return F.when(test(x, F.lit(edges[k])), bisected(x, edges, lo, k, test)).otherwise(bisected(x, edges, k + 1, hi, test))


def equal_population_bins(df: DataFrame, x: Column, y: Column, n_bins: int) -> DataFrame:
    """bin, lo, hi, n, median_y, nmad: bins between quantiles of x, both ends included, so edge rows count in two."""
    v = df.select(x.cast("double").alias("x"), y.cast("double").alias("y")).where(finite(F.col("x")) & finite(F.col("y")))
    edges = whole_quantiles(v, F.col("x"), [k / n_bins for k in range(n_bins + 1)])
    if edges[0] is None:
        return v.where(F.lit(False)).select(F.lit(0).alias("bin"), F.col("x").alias("lo"), F.col("x").alias("hi"), F.lit(0).cast("long").alias("n"), F.col("y").alias("median_y"), F.col("y").alias("nmad"))
    first = bisected(F.col("x"), edges[1:], 0, n_bins - 1, lambda a, e: a <= e)
    past = bisected(F.col("x"), edges[1:], 0, n_bins - 1, lambda a, e: a < e)  # the last bin that begins at x or before
    b = v.select(F.explode(F.sequence(first, past)).alias("bin"), F.col("y").alias("_v"))
    ends = lambda k: F.get(F.array(*map(F.lit, edges)), k)
    if largest(b, ["bin"]) <= MOST:
        g = gathered(b, ["bin"]).select("bin", "_a", middle(F.col("_a")).alias("median_y"))
        out = mad_of(g, ["bin"], "nmad", "median_y")
    else:
        out = quantiles(b, ["bin"], 0.5, "median_y").drop("n").join(mad_std(b, F.col("_v"), ["bin"], "nmad"), "bin")
    return out.select("bin", ends(F.col("bin")).alias("lo"), ends(F.col("bin") + 1).alias("hi"), "n", "median_y", "nmad")


def log_bin(x: Column, lo: float, hi: float, n: int) -> Column:
    """0 .. n-1 for half-open bins of equal log width; null outside."""
    import math

    k = F.floor((F.log(F.when(x > 0, x)) - math.log(lo)) / math.log(hi / lo) * n).cast("int")
    return F.when((x >= lo) & (x < hi), F.least(F.greatest(k, F.lit(0)), F.lit(n - 1)))
