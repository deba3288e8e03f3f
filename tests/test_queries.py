"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import glob
import math
import os

import pandas as pd
import pytest

from fluxloom.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(df, cols):
    def cell(v):
        if v is None or not hasattr(v, "__len__") and pd.isna(v):
            return "null"
        return str(v) if isinstance(v, (bool, str)) or not hasattr(v, "__float__") else repr(round(float(v), 9))

    return sorted(tuple(cell(v) for v in row) for row in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert plain(got, cols) == plain(want, cols)


def test_flagship(spark):
    rows = queries.flagship(spark, SF).collect()
    assert rows and all(r.flux_vis_ujy is None or math.isfinite(r.flux_vis_ujy) for r in rows)


def test_the_whole_catalog_is_in_order(spark):
    got = [(r.id, r.flux) for r in queries.QUERIES["brightest_first"](spark, SF).collect()]
    want = [(r.id, r.flux) for r in queries.stars(spark, SF).collect()]
    assert len(want) > 50 and got == sorted(want, key=lambda r: (-r[1], r[0]))


def test_nearest_of_all_samples(spark):
    import numpy as np

    rows = [(r.vec_id, np.array(r.embedding, float), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    samples = sorted((i, v) for i, v, label in rows if label == 0)
    assert len(samples) > 25
    ids, vectors = [i for i, _ in samples], np.stack([v for _, v in samples])
    want = {i: ids[int(((vectors - v) ** 2).sum(axis=1).argmin())] for i, v, _ in rows}
    assert {r.id: r.sample_id for r in queries.QUERIES["nearest_vector"](spark, SF).collect()} == want
    # beyond the 25 smallest ids
    assert any(k not in ids[:25] for k in want.values())


def test_nearest_vector_in_blocks(spark):
    import numpy as np

    from fluxloom.operators import matching

    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 4, (90, 3)).astype(float), rng.integers(0, 4, (70, 3)).astype(float)  # many ties
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)] + [(90, None)], "id long, v array<double>").repartition(3)
    s = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)] + [(70, None), (71, [1.0]), (72, [float("nan")] * 3)], "id long, v array<double>").repartition(3)
    out = matching.nearest_vector(q, s, "v", rows=7, landmarks=9)
    assert "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    assert {r.id: (r.sample_id, r.distance) for r in out.collect()} == {i: (int(d[i].argmin()), d[i].min()) for i in range(90)} | {90: (None, None)}


def test_nearest_vector_compares_fewer_blocks_of_clustered_vectors(spark):
    import numpy as np

    from fluxloom.operators import matching

    rng = np.random.default_rng(8)
    centres = rng.normal(0, 50, (25, 6))
    a, b = (centres[rng.integers(0, 25, n)] + rng.normal(0, 1, (n, 6)) for n in (400, 900))
    q, s = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>") for x in (a, b))
    counts = {}
    got = {r.id: (r.sample_id, r.distance) for r in matching.nearest_vector(q, s, "v", counts=counts).collect()}
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    assert got == {i: (int(d[i].argmin()), pytest.approx(d[i].min(), rel=1e-12)) for i in range(400)}
    assert counts["all"] == 360_000 and counts["first"] + counts["rest"] < 0.25 * counts["all"]
    none = matching.nearest_vector(q.limit(3), s.limit(0), "v").collect()
    assert len(none) == 3 and all(r.sample_id is None for r in none)
