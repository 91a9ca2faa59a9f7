"""Windows and quantiles over range slices against pandas, with groups cut by slice borders."""

import numpy as np
import pandas as pd
import pytest

from frameatlas.operators import slices as SL


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 400
    g = np.where(rng.random(n) < 0.5, 1, rng.integers(2, 8, n)).astype(float)
    v = np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 50, n))
    return pd.DataFrame({"g": pd.array(np.where(rng.random(n) < 0.05, np.nan, g), "Int64"), "i": rng.permutation(n), "v": v})


@pytest.fixture(scope="module")
def df(spark, frame):
    rows = [(None if pd.isna(g) else int(g), int(i), None if np.isnan(v) else float(v)) for g, i, v in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "g long, i long, v double")


def got(x, col):
    return {r["i"]: r[col] for r in x.collect()}


def test_positions_previous_and_last_known(df, frame):
    f = frame.sort_values("i")
    by = f.groupby("g", dropna=False)
    place = dict(zip(f.i, by.cumcount() + 1))
    assert got(SL.grouped_positions(df, "g", ["i"], per_slice=37), "position") == place
    none = lambda d: {k: None if pd.isna(x) else x for k, x in d.items()}
    assert got(SL.previous(df, "g", ["i"], "v", "before", per_slice=37), "before") == none(dict(zip(f.i, by.v.shift(1))))
    assert got(SL.last_known(df, "g", ["i"], "v", "known", per_slice=37), "known") == none(dict(zip(f.i, by.v.ffill())))


@pytest.mark.parametrize("nearest", [True, False])
def test_quantiles(df, frame, nearest):
    rows = {r["g"]: r for r in SL.exact_quantiles(df, "g", "v", {"a": 0.25, "b": 0.9}, nearest, per_slice=37).collect()}
    for g, x in frame.dropna(subset=["v"]).groupby("g", dropna=False):
        for q, c in ((0.25, "a"), (0.9, "b")):
            want = np.quantile(x.v, q, method="inverted_cdf" if nearest else "linear")
            assert rows[None if pd.isna(g) else g][c] == pytest.approx(want)
    whole = SL.exact_quantiles(df, None, "v", {"m": 0.5}, per_slice=37).collect()
    assert len(whole) == 1 and whole[0]["m"] == pytest.approx(frame.v.median())


def test_empty_and_null_only(spark):
    e = spark.createDataFrame([(1, None)], "g long, v double")
    assert SL.exact_quantiles(e, "g", "v", {"m": 0.5}).count() == 0 and SL.exact_quantiles(e.limit(0), None, "v", {"m": 0.5}).count() == 0
    assert SL.grouped_positions(e.limit(0), "g", ["v"]).count() == 0 and SL.last_known(e, "g", ["g"], "v", "k").collect()[0]["k"] is None
