"""Order statistics by cells and the order-based normality test."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest

from tablelab.functions import stats as S
from tablelab.operators import eda as E


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.RandomState(5)
    flat, skewed, hot = rng.random_sample(6000), np.exp(rng.normal(0, 6, 6000)), np.where(rng.random_sample(6000) < 0.4, 7.0, rng.normal(0, 1, 6000))
    rows = [(float(flat[i]), float(skewed[i]), float(hot[i]), 3.0, float(i % 3), math.inf if i == 5 else float(i), None, None if i % 2 else -float(i))
            for i in range(6000)]
    return spark.createDataFrame(rows, "flat double, skewed double, hot double, same double, few double, odd double, none double, half double").cache()


@pytest.mark.parametrize("share", [-1.0, 0.0, 0.05, 1.0])
def test_quantiles_by_cells(table, monkeypatch, share):
    monkeypatch.setattr(S, "FEW_VALUES", max(share, 0.0))
    monkeypatch.setattr(S, "RANKED_BELOW", 10**9 if share < 0 else 0)
    probs = [i / 150 for i in range(151)]
    got = {(r["column"], r["prob"]): r["qv"] for r in S.quantiles_by_cells(table, table.columns, probs).collect()}
    pdf = table.toPandas()
    for c in table.columns:
        values = pdf[c].dropna().to_numpy(float)
        if not len(values):
            assert not [k for k in got if k[0] == c]
            continue
        for p in probs[:-2] if c == "odd" else probs:   # beside infinity a quantile isn't defined
            assert got[c, p] == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-12), (c, p)
    assert S.quantiles_by_cells(table.limit(0), ["flat"], probs).count() == 0


def test_wanted_cells_shuffle_few_values(table, monkeypatch):
    seen = []
    monkeypatch.setattr(S, "RANKED_BELOW", 0)
    monkeypatch.setattr(S, "prefix_sums", lambda vc, *a, **k: seen.append(vc.count()) or prefix(vc, *a, **k))
    S.quantiles_by_cells(table, ["skewed"], [0.25, 0.5, 0.75]).collect()
    assert seen and seen[0] < 6000   # the first cells hold nearly all of them


prefix = S.prefix_sums


def test_normal_quantiles(spark):
    ps = [1e-9, 1e-4, 0.01, 0.02424, 0.02426, 0.3, 0.5, 0.77, 0.99, 1 - 1e-6]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").selectExpr("p", f"{S.normal_quantile_sql('p')} AS z").collect()
    assert all(r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-8, abs=1e-8) for r in rows)


def test_normality_by_order(spark):
    rng = np.random.RandomState(1)
    normal, other = rng.normal(50, 4, 800), rng.exponential(1, 800)
    df = spark.createDataFrame([(float(a), float(b), 1.0, float(i) if i < 4 else None) for i, (a, b) in enumerate(zip(normal, other))],
                               "normal double, other double, same double, short double")
    got = {r["column"]: r for r in E.normality_order(df, df.columns).collect()}
    assert set(got) == {"normal", "other"} and got["normal"]["is_normal"] and not got["other"]["is_normal"]
    scores = np.array([NormalDist().inv_cdf((i + 1 - 0.375) / 800.25) for i in range(800)])
    assert got["other"]["w_prime"] == pytest.approx(np.corrcoef(np.sort(other), scores)[0, 1] ** 2, abs=1e-6)


def test_spearman_counts_a_column_once_for_all_pairs(spark, monkeypatch):
    """running sums per column, not twice per pair; values of many rows beside rare ones, missing ones and NaN."""
    import numpy as np
    import pandas as pd
    from tablelab.operators import eda

    rng = np.random.RandomState(5)
    pdf = pd.DataFrame({"a": np.where(rng.random_sample(3000) < 0.4, 7.0, rng.random_sample(3000)), "b": rng.randint(0, 9, 3000) * 1.0,
                        "c": rng.normal(0, 1, 3000), "d": rng.random_sample(3000).round(2)})
    pdf["c"] += pdf["a"]
    pdf.loc[::7, "b"], pdf.loc[::5, "c"], pdf.loc[3, "d"] = None, None, np.nan
    rows = [tuple(None if v != v and j < 3 else float(v) for j, v in enumerate(r)) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3)
    calls, plain = [], eda.prefix_sums
    monkeypatch.setattr(eda, "prefix_sums", lambda *a, **k: calls.append(1) or plain(*a, **k))
    want = {(x, y): r for x, col in pdf.corr("spearman").to_dict().items() for y, r in col.items()}
    for few in (50_000, 20):   # ranks broadcast, and joined
        monkeypatch.setattr(eda, "BROADCAST_RANKS", few)
        got = {(r["col_a"], r["col_b"]): r["rho"] for r in eda.spearman_matrix(df, list("abcd")).collect()}
        assert len(got) == 16 and all(abs(got[k] - want[k]) < 2e-6 for k in want), (few, got, want)
    assert len(calls) == 8


def test_bivariate_density_rows_are_not_multiplied_by_pairs(spark, monkeypatch):
    """ranges cost two numbers a column in the scan, and a task's counts leave it, not a row per row and pair."""
    from tablelab.operators import eda

    rows = [(float(i % 13), None if i % 3 == 0 else float(i % 7), None if i % 4 == 0 else float(i * i % 101)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    kinds, plain = [], type(df).agg
    monkeypatch.setattr(type(df), "agg", lambda self, *a: kinds.append(self.columns) or plain(self, *a))
    out = eda.bivariate_density(df, ["a", "b", "c"], 4)
    assert df.columns not in kinds and "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {tuple(r)[:4]: r["cnt"] for r in out.collect()}
    want: dict = {}
    for i, j in ((0, 1), (0, 2), (1, 2)):
        both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
        ends = [(min(v), max(v)) for v in zip(*both)]
        for r in both:
            cell = tuple(min(3, int((v - lo) / (hi - lo) * 4)) for v, (lo, hi) in zip(r, ends))
            want["abc"[i], "abc"[j], *cell] = want.get(("abc"[i], "abc"[j], *cell), 0) + 1
    assert got == want


def test_bivariate_density_of_nan_and_infinite_values(spark):
    from tablelab.operators import eda

    inf, nan = math.inf, math.nan
    df = spark.createDataFrame([(1.0, 1.0), (2.0, inf), (3.0, 2.0), (4.0, 3.0), (5.0, 0.0), (6.0, None)], "a double, b double")
    assert sorted((r["by"], r["cnt"]) for r in eda.bivariate_density(df, ["a", "b"], 2).collect()) == [(0, 2), (0, 3)]
    df = spark.createDataFrame([(1.0, 1.0), (2.0, nan), (3.0, 2.0), (4.0, 3.0), (5.0, 0.0)], "a double, b double")
    assert sorted((r["bx"], r["by"], r["cnt"]) for r in eda.bivariate_density(df, ["a", "b"], 2).collect()) == [(0, 0, 2), (1, 0, 3)]
