"""Catalog assembly, comparisons and recovery summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EXTINCTION, MAD_SCALE
from ..functions import stats, units
from ..functions.cut import cut
from ..functions.small import small
from ..functions.units import finite


def wide_catalog(measurements: DataFrame, bands: list[str]) -> DataFrame:
    """One row per id from long (id, band, flux, err): fluxes (null where the error is), errors, magnitudes. Bands are stated, so the pivot is one aggregation."""
    ok = finite(F.col("err"))
    m = measurements.withColumns({"flux": F.when(ok & finite(F.col("flux")), F.col("flux")), "err": F.when(ok, F.col("err"))})
    aggs = []
    for b in bands:
        mine = lambda c: F.max(F.when(F.col("band") == b, F.col(c)))  # noqa: B023, E731
        aggs += [mine("flux").alias(f"flux_{b.lower()}_ujy"), mine("err").alias(f"flux_err_{b.lower()}_ujy")]
    out = m.groupBy("id").agg(*aggs)
    f, e = (lambda b: F.col(f"flux_{b.lower()}_ujy")), (lambda b: F.col(f"flux_err_{b.lower()}_ujy"))
    mags = {}
    for b in bands:
        mags |= {f"mag_{b.lower()}_ab": units.flux_to_ab_mag(f(b)), f"mag_err_{b.lower()}_ab": units.flux_err_to_mag_err(f(b), e(b))}
    return out.withColumns(mags)


def with_extinction(cat: DataFrame, bands: list[str], ebv: str = "ebv") -> DataFrame:
    """cat with a_<band>_mag and mag_<band>_ab_extcorr; bands without a coefficient are left out. A missing E(B-V) takes the catalog's median."""
    (middle,) = stats.whole_quantiles(cat, F.col(ebv), [0.5])
    filled = cat.withColumn(ebv, F.coalesce(F.when(finite(F.col(ebv)), F.col(ebv)), F.lit(middle).cast("double")))
    cols = {}
    for b in bands:
        if b in EXTINCTION:
            a = units.extinction(F.col(ebv), b)
            cols |= {f"a_{b.lower()}_mag": a, f"mag_{b.lower()}_ab_extcorr": F.col(f"mag_{b.lower()}_ab") - a}
    return filled.withColumns(cols)


def depth(measurements: DataFrame) -> DataFrame:
    """band, depth_ab, n: the magnitude of five times the median finite positive error."""
    ok = measurements.where(finite(F.col("err")) & (F.col("err") > 0))
    return stats.medians(ok, F.col("err"), ["band"], "err").select("band", units.flux_to_ab_mag(5 * F.col("err")).alias("depth_ab"), "n")


def recovery(truth: DataFrame, measured: DataFrame, lo: float, hi: float, n_bins: int = 4, snr_min: float = 5.0) -> DataFrame:
    """Per log-spaced flux bin (and bin -1 for all): n, completeness, median ratio, pull width (null for two rows or fewer). Joined on id; what is not measured counts as missed."""
    j = truth.select("id", F.col("flux").alias("true_flux")).join(measured.select("id", "flux", "err"), "id", "left")
    j = j.withColumn("found", F.coalesce(finite(F.col("flux")) & (F.col("err") > 0) & (F.col("flux") > snr_min * F.col("err")), F.lit(False)))
    both = j.withColumn("bin", F.explode(F.array_compact(F.array(F.lit(-1), stats.log_bin(F.col("true_flux"), lo, hi, n_bins)))))
    good = finite(F.col("flux")) & (F.col("err") > 0)
    both = both.withColumns({"ratio": F.when(good & (F.col("true_flux") > 0), F.col("flux") / F.when(F.col("true_flux") > 0, F.col("true_flux"))), "pull": F.when(good, (F.col("flux") - F.col("true_flux")) / F.when(F.col("err") > 0, F.col("err")))})
    both = cut(both.select("bin", "found", "ratio", "pull"))  # joined once, read by each step of the medians
    base = both.groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.col("found").cast("double")).alias("completeness"))
    ratio = stats.medians(both, F.col("ratio"), ["bin"], "ratio_median").drop("n")
    pull = stats.mad_std(both, F.col("pull"), ["bin"], "pull_width").select("bin", F.when(F.col("n") > 2, F.col("pull_width")).alias("pull_width"))
    return base.join(ratio, "bin", "left").join(pull, "bin", "left")


def disagreements(cmp: DataFrame, a: str, b: str, ea: str, eb: str, minimum_snr: float = 5.0, top_n: int = 20) -> DataFrame:
    """The top_n rows by |log10(a / b)| among those significant in both; ties by id."""
    ok = cmp.where((F.col(a) > minimum_snr * F.col(ea)) & (F.col(b) > minimum_snr * F.col(eb)))
    out = ok.withColumns({"dex": units.log_ratio(F.col(a), F.col(b)), "n_sigma": units.difference_sigma(F.col(a), F.col(b), F.col(ea), F.col(eb))})
    return out.orderBy(F.desc("dex"), "id").limit(top_n)


def outer_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; what a side lacks is null."""
    return a.unionByName(b, allowMissingColumns=True)


def split_neighbours(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reported, neighbours fitted along with them)."""
    n = F.coalesce(F.col("is_neighbour"), F.lit(False))
    return rows.where(~n), rows.where(n)


def recalibrated(measurements: DataFrame, factors: DataFrame) -> DataFrame:
    """Errors times new / applied factor of their band, so that applying twice is applying once. factors: band, factor (a row per band, however many bands)."""
    f = small(factors.select("band", F.col("factor").alias("_f")))
    new = F.coalesce(F.col("_f"), F.col("factor"), F.lit(1.0))
    return measurements.join(f, "band", "left").withColumns({"err": F.col("err") * new / F.coalesce("factor", F.lit(1.0)), "factor": new}).drop("_f")


def flux_ratio_bins(a: DataFrame, b: DataFrame, edges: list[float], snr: float = 5.0, least: int = 5) -> DataFrame:
    """Flux ratio of two runs (id, flux, err; colour in a) by colour bin: n, median, NMAD; bins under `least` rows are left out."""
    j = a.select("id", "flux", "err", "colour").join(b.select("id", F.col("flux").alias("flux_b"), F.col("err").alias("err_b")), "id").where((F.col("flux") > snr * F.col("err")) & (F.col("flux_b") > snr * F.col("err_b")))
    bin_ = F.lit(None).cast("int")
    for k, (lo, hi) in reversed(list(enumerate(zip(edges, edges[1:], strict=False)))):
        bin_ = F.when((F.col("colour") >= lo) & (F.col("colour") < hi), F.lit(k)).otherwise(bin_)
    r = j.select((F.col("flux_b") / F.col("flux")).alias("ratio"), bin_.alias("bin")).where("bin is not null")
    r = cut(r)  # joined once, read by each step of the medians
    base = r.groupBy("bin").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("ratio") - 1) > 0.05).alias("n_off")).where(F.col("n") >= least)
    return base.join(stats.medians(r, F.col("ratio"), ["bin"], "ratio_median").drop("n"), "bin", "left").join(stats.mad_std(r, F.col("ratio"), ["bin"], "nmad").drop("n"), "bin", "left")


def stage_lookup(trials: DataFrame) -> DataFrame:
    """chi2 of each stage of a source in one row: (source_id, chi2_1 .. chi2_5)."""
    return trials.groupBy("source_id").agg(*[F.max(F.when(F.col("stage") == k, F.col("chi2"))).alias(f"chi2_{k}") for k in range(1, 6)])


def held_out(rows: DataFrame, by: str = "x", every: int = 4, group: str = "tile") -> DataFrame:
    """rows with test: every fourth by x within its tile (ties by id)."""
    w = Window.partitionBy(group).orderBy(by, "id")
    return rows.withColumn("test", (F.row_number().over(w) - 1) % every == 0)


def model_counts(models: DataFrame) -> DataFrame:
    """Sources per model; those without one count as unblobbed."""
    return models.groupBy(F.coalesce("model", F.lit("unblobbed")).alias("model")).agg(F.count("*").alias("n"))


def ebv_filled(cat: DataFrame) -> DataFrame:
    return with_extinction(cat, [])


NMAD = MAD_SCALE


def aligned(full: DataFrame, fitted: DataFrame, key: str = "id") -> DataFrame:
    """Every row of full with the columns of its fit, null where there is none."""
    return full.join(fitted, key, "left")


def median_ratios(cmp: DataFrame, a: str, b: str, ea: str, eb: str) -> DataFrame:
    """One row: n, and the medians of a / b and of their errors' ratio over rows where all are positive."""
    ok = cmp
    for c in (a, b, ea, eb):
        ok = ok.where(finite(F.col(c)) & (F.col(c) > 0))
    return stats.met(stats.medians(ok, F.col(a) / F.col(b), [], "flux_ratio"), stats.medians(ok, F.col(ea) / F.col(eb), [], "error_ratio").drop("n"), []).select("n", "flux_ratio", "error_ratio")
