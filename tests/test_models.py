import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foreband.models import arma as A
from foreband.models import boost as B
from foreband.models import dist, ets
from foreband.models import garch as G
from foreband.models import linear as L
from foreband.models import passes as P
from foreband.models import recursion as R
from foreband.models import stl as S
from foreband.operators.ordered import with_position

START = dt.datetime(2022, 1, 1)


def hourly(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for s in ("a", "b"):
        for i in range(n):
            x = rng.normal()
            y = 3 + 2 * x + rng.standard_t(4) * (1 + (i % 2))
            rows.append((s, START + dt.timedelta(hours=i), i % 2, float(x), float(y)))
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, g int, x double, y double")


def test_quantile_regression_saturated_is_group_quantile(spark):
    df = hourly(spark)
    cols = [F.lit(1.0), *L.dummies(F.col("g"), [0, 1])]
    blocks = P.run(P.feature_blocks(df, ["series_id"], "ts", "y", cols, 3))
    fit = {r["series_id"]: np.array(r["coefs"]).reshape(5, 2) for r in L.quantile_regression(blocks, ["series_id"], 2, rounds=30).collect()}
    pdf = df.toPandas()
    for s, part in pdf.groupby("series_id"):
        for g in (0, 1):
            y = part.y[part.g == g].to_numpy()
            for j, tau in enumerate((0.025, 0.25, 0.5, 0.75, 0.975)):
                q = fit[s][j, 0] + g * fit[s][j, 1]
                score = lambda v: np.maximum(tau * (y - v), (tau - 1) * (y - v)).mean()
                assert score(q) <= score(np.quantile(y, tau, method="inverted_cdf")) * 1.001


def test_ols_and_stepwise(spark):
    df = hourly(spark)
    blocks = P.run(P.feature_blocks(df, ["series_id"], "ts", "y", [F.lit(1.0), F.col("x"), F.col("g")], 3))
    fit = L.ols(blocks, ["series_id"], ["one", "x", "g"]).filter("series_id = 'a'").toPandas().set_index("term").coef
    pdf = df.filter("series_id = 'a'").toPandas()
    want = np.linalg.lstsq(np.column_stack([np.ones(len(pdf)), pdf.x, pdf.g]), pdf.y, rcond=None)[0]
    assert fit[["one", "x", "g"]].to_numpy() == pytest.approx(want, abs=1e-8)
    steps = L.stepwise(blocks, ["series_id"], {"x": [1], "g": [2]}, 3).toPandas()
    assert all("x" in k for k in steps.kept)
    for _, part in steps.sort_values("step").groupby("series_id"):
        assert (np.diff(part.aic) <= 0).all()


def test_scan_equals_plain_loop_and_transition():
    rng = np.random.default_rng(1)
    a, u, s0 = rng.normal(size=(3, 2)) * 0.4, rng.normal(size=(50, 3)), rng.normal(size=(3, 2))
    out, last = R.scan(a, u, s0)
    h = [s0[:, 1], s0[:, 0]]
    for t in range(50):
        h.append(u[t] + a[:, 0] * h[-1] + a[:, 1] * h[-2])
    assert out == pytest.approx(np.array(h[2:]))
    _, forced = R.scan(a, u, np.zeros((3, 2)))
    chained = np.einsum("cij,cj->ci", R.transition(a, 50), s0) + forced
    assert chained == pytest.approx(last)


def simulated_returns(spark, n=1500, seed=5):
    rng = np.random.default_rng(seed)
    rows, e, s2, y = [], 0.0, 1.0, 0.0
    for i in range(n):
        s2 = 0.05 + 0.1 * e * e + 0.85 * s2
        last, e = e, math.sqrt(s2) * rng.standard_t(8) * math.sqrt(6 / 8)
        y = 0.4 * y + e + 0.2 * last
        rows.append(("s", (START + dt.timedelta(days=i)).date(), y))
    return spark.createDataFrame(rows, "series_id string, date date, ret1 double")


def test_garch_finds_the_process_at_any_block_size(spark):
    keys, results = ["series_id", "h"], []
    for size in (4096, 200):
        blocks = A.return_blocks(simulated_returns(spark), ["series_id"], (1,), block_rows=size)
        fits = P.run(A.fit_orders(A.orders(blocks, keys), keys, [1], [1]))
        residuals = P.run(A.residual_blocks(blocks, fits, keys))
        vol = P.run(G.search_orders(residuals, keys, 1, 1))
        results.append((fits.first()["p"], vol.first(), G.forecast(residuals, vol, keys).orderBy("step").toPandas(), G.paths(residuals, vol, keys)))
    p = results[0][0]
    assert p[A.PHI] == pytest.approx(0.4, abs=0.12) and p[A.THETA] == pytest.approx(0.2, abs=0.15)
    g = results[0][1]["g"]
    assert g[G.ALPHA] + g[G.BETA] == pytest.approx(0.95, abs=0.05) and 4 < g[1] < 30
    assert results[1][0] == pytest.approx(p) and results[1][1]["g"] == pytest.approx(g, rel=1e-4)
    for c in ("mean", "sigma"):
        assert results[0][2][c].to_numpy() == pytest.approx(results[1][2][c].to_numpy(), abs=1e-4)
    path = [r[3].orderBy("date").toPandas() for r in results]
    assert path[0].sigma.to_numpy() == pytest.approx(path[1].sigma.to_numpy(), abs=1e-4)
    z = (path[0].y - path[0].fitted) / path[0].sigma
    assert z.std() == pytest.approx(1, abs=0.1)
    fc = G.quantile_forecasts(spark.createDataFrame([(0.0, 1.0, 5.0)], "mean double, sigma double, shape double"), standardized=True)
    assert fc.first()["q"][4] == pytest.approx(2.5705818 * math.sqrt(3 / 5), abs=1e-5)


@pytest.fixture(scope="module")
def second_order(spark):
    """Residual blocks of a GARCH(2,1) process whose second lag counts most, and of one without any volatility."""
    rng, rows = np.random.default_rng(8), []
    for name, a1, a2, b in (("garch21", 0.05, 0.45, 0.3), ("none", 0.0, 0.0, 0.0)):
        e, e1, s2 = 0.0, 0.0, 1.0
        for i in range(1500):
            s2 = 0.2 + a1 * e * e + a2 * e1 * e1 + b * s2
            e1, e = e, math.sqrt(s2) * rng.standard_t(9) * math.sqrt(7 / 9)
            rows.append((name, (START + dt.timedelta(days=i)).date(), e))
    keys = ["series_id", "h"]
    blocks = A.return_blocks(spark.createDataFrame(rows, "series_id string, date date, ret1 double"), ["series_id"], (1,))
    return P.run(A.residual_blocks(blocks, A.given_parameters(blocks, keys, 0.0, 0.0, 0.0), keys)), keys


def test_volatility_orders_are_nested_and_chosen(second_order):
    residuals, keys = second_order
    found = G.search_orders(residuals, keys, 3, 2).toPandas()
    for name, part in found.groupby("series_id"):
        at = {(r.garch_p, r.garch_q): r for r in part.itertuples()}
        assert all(r.converged and r.rounds > 1 for r in at.values())
        for (p, q), r in at.items():
            assert all(r.loglik >= o.loglik for (a, b), o in at.items() if a <= p and b <= q)
            free = p + q + 2
            assert r.bic - r.aic == pytest.approx(free * (math.log(1500) - 2))
        best = part.loc[part.bic.idxmin()]
        if name == "garch21":
            assert (best.garch_p, best.garch_q) == (2, 1) and best.g[G.ALPHA + 1] == pytest.approx(0.45, abs=0.2)
            assert at[2, 1].loglik > at[1, 1].loglik + 10


def test_volatility_fits_are_at_their_maximum(second_order):
    """No nearby point of a fine grid around the estimate is more likely, by a likelihood written out in a loop."""
    residuals, keys = second_order
    e = np.asarray(residuals.filter("series_id = 'garch21'").first()["e"])
    fit = G.search_orders(residuals, keys, 1, 1).filter("series_id = 'garch21'").first()

    def loglik(omega, nu, alpha, beta):
        s2, past, total = np.var(e) + np.mean(e) ** 2, np.var(e) + np.mean(e) ** 2, 0.0
        c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
        for x in e:
            s2 = omega + alpha * past + beta * s2
            total += c - 0.5 * math.log(s2) - (nu + 1) / 2 * math.log1p(x * x / s2 / (nu - 2))
            past = x * x
        return total

    g = fit["g"]
    at = [g[0], g[1], g[G.ALPHA], g[G.BETA]]
    best = loglik(*at)
    assert best == pytest.approx(fit["loglik"], abs=1e-6)
    for i in range(4):
        for f in (0.97, 0.995, 1.005, 1.03):
            assert loglik(*[v * (f if j == i else 1) for j, v in enumerate(at)]) < best + 1e-3


@pytest.mark.parametrize("few", [1000, 0])
def test_volatility_fits_in_passes_agree_with_those_of_one_stage(second_order, monkeypatch, few):
    residuals, keys = second_order
    residuals = residuals.filter("series_id = 'garch21'")
    want = G.search_orders(residuals, keys, 1, 1).first()
    monkeypatch.setattr(R, "AT_ONCE", False)
    monkeypatch.setattr(P, "FEW_MODELS", few)
    got = G.search_orders(residuals, keys, 1, 1).first()
    assert got["converged"] and got["loglik"] == pytest.approx(want["loglik"], abs=1e-6) and got["g"] == pytest.approx(want["g"])


@pytest.mark.parametrize("fan", [2, 3, 32])
def test_starts_go_down_a_tree_of_any_width(spark, monkeypatch, fan):
    """Starting values of every block, against one run over the whole series."""
    monkeypatch.setattr(R, "FAN", fan)
    rng = np.random.default_rng(6)
    a, values = np.array([[0.5, 0.2], [0.9, -0.3]]), rng.normal(size=(2, 90))
    rows = [(s, b, v[9 * b : 9 * b + 9].tolist()) for s, v in zip("xy", values) for b in range(10)] + [("short", 0, [1.0, 2.0])]
    blocks = spark.createDataFrame(rows, "series_id string, block int, u array<double>").repartition(4)
    inputs = lambda block, p: (a * p[0], np.repeat(np.asarray(block["u"])[:, None], 2, axis=1))
    initial = lambda p: np.full((2, 2), p[0])
    got = {(r.series_id, r.block): r.s0 for r in R.starts(blocks, [0.8], ["series_id"], inputs, initial, 2, R.last_block(blocks)).collect()}
    assert len(got) == 21 and got["short", 0] == [0.8] * 4
    for s, v in zip("xy", values):
        out, _ = R.scan(a * 0.8, np.repeat(v[:, None], 2, axis=1), initial([0.8]))
        for b in range(1, 10):
            assert got[s, b] == pytest.approx(out[[9 * b - 1, 9 * b - 2]].T.ravel())


def test_t_quantiles_match_closed_forms():
    p = np.array([0.025, 0.25, 0.5, 0.75, 0.975])
    assert G.t_quantile(1, p) == pytest.approx(np.tan(np.pi * (p - 0.5)), abs=1e-5)
    assert G.t_quantile(2, p) == pytest.approx((2 * p - 1) / np.sqrt(2 * p * (1 - p)), abs=1e-6)
    assert G.t_quantile(math.inf, [0.975])[0] == pytest.approx(1.959964, abs=1e-6)


def test_distribution_fits(spark):
    rng = np.random.default_rng(2)
    rows = [("s", (START + dt.timedelta(days=i)).date(), float(v)) for i, v in enumerate(2 + 3 * rng.standard_cauchy(3000))]
    blocks = A.return_blocks(spark.createDataFrame(rows, "series_id string, date date, ret1 double"), ["series_id"], (1,), block_rows=512)
    fit = dist.fit_distributions(blocks, ["series_id", "h"], rounds=24).toPandas().set_index("distribution")
    assert fit.estimate1["cauchy"] == pytest.approx(2, abs=0.3) and fit.estimate2["cauchy"] == pytest.approx(3, abs=0.3)
    assert fit.bic["cauchy"] < fit.bic["normal"]


def daily(spark, n=400, seed=4):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    y = 100 + 0.2 * t + 10 * np.sin(2 * np.pi * t / 7) + rng.normal(size=n)
    rows = [("s", (START + dt.timedelta(days=int(i))).date(), float(v)) for i, v in zip(t, y)]
    return with_position(spark.createDataFrame(rows, "series_id string, date date, value double"), ["series_id"], "date")


def test_stl_recovers_trend_in_any_block_size(spark):
    frames = [S.stl(daily(spark), ["series_id"], "date", "value", block_rows=b).orderBy("date").toPandas() for b in (4096, 170)]
    for c in ("trend", "season"):
        assert frames[0][c].to_numpy() == pytest.approx(frames[1][c].to_numpy(), abs=1e-9)
    t = np.arange(400)
    assert np.abs(frames[0].trend - (100 + 0.2 * t)).mean() < 0.6
    assert np.abs(frames[0].season - 10 * np.sin(2 * np.pi * t / 7)).mean() < 0.8
    assert (frames[0].value - frames[0].trend - frames[0].season - frames[0].remainder).abs().max() < 1e-9


def test_loess_is_exact_on_lines():
    v = 3 + 2.0 * np.arange(40)
    assert S.loess(v, 11, 1, np.arange(-1, 41, dtype=float)) == pytest.approx(3 + 2.0 * np.arange(-1, 41))


def test_ets_follows_a_line(spark):
    trend = daily(spark).withColumn("value", F.lit(5.0) + F.col("pos") * 0.5)
    for size in (4096, 64):
        blocks = ets.trend_blocks(trend, ["series_id"], "value", size)
        fit = P.run(ets.fit(blocks, ["series_id"], rounds=6))
        ahead = ets.forecast(blocks, fit, ["series_id"]).orderBy("step").toPandas()
        assert fit.first()["form"] == "A"
        assert ahead.value.to_numpy() == pytest.approx(205 + 0.5 * np.arange(1, 4), abs=1e-6)


@pytest.fixture(scope="module")
def boosted(spark):
    df = hourly(spark, 500)
    cols = [F.col("x"), F.col("g")]
    edges = B.feature_edges(df, ["series_id"], cols)
    clock = F.unix_date(F.to_date("ts"))
    blocks = B.coded_blocks(df, ["series_id"], "ts", "y", clock, cols, edges, 3)
    specs = [B.Spec(t, 2, 0.3, 19008.0, 19020.0) for t in (0.25, 0.5, 0.75)]
    return blocks, specs, B.fit(blocks, ["series_id"], ["x", "g"], specs, 6, keep_at=(1, 6))


def test_boosting_lowers_the_training_score(boosted):
    blocks, specs, model = boosted
    train = [B.Spec(s.tau, 2, 0.3, -1.0, s.train_upto) for s in specs]
    first = B.test_losses(model.snapshots[1], ["series_id"], train).orderBy("series_id", "model_no").toPandas()
    last = B.test_losses(model.snapshots[6], ["series_id"], train).orderBy("series_id", "model_no").toPandas()
    assert (last.loss < first.loss).all()
    imp = B.importance(model).toPandas()
    assert imp.groupby(["series_id", "model_no"]).importance.sum().to_numpy() == pytest.approx(1.0)
    assert imp[imp.feature == "x"].importance.min() > 0.5


@pytest.mark.parametrize("outlier", [None, 1e6])
def test_boosting_finds_group_quantiles_far_from_zero_and_beside_an_outlier(spark, outlier):
    rng = np.random.default_rng(5)
    values = [(i % 2, 100.0 + 20 * (i % 2) + float(rng.normal())) for i in range(400)]
    rows = [("a", START + dt.timedelta(hours=i), g, outlier if outlier and i == 7 else y) for i, (g, y) in enumerate(values)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, g int, y double")
    cols = [F.col("g")]
    blocks = B.coded_blocks(df, ["series_id"], "ts", "y", F.lit(0), cols, B.feature_edges(df, ["series_id"], cols), 3)
    specs = [B.Spec(t, 1, 1.0) for t in (0.25, 0.5, 0.75)]
    model = B.fit(blocks, ["series_id"], ["g"], specs, 1)
    got = B.prediction_rows(model.blocks, ["series_id"], specs, test_only=False).toPandas()
    got["g"] = got.ts.dt.hour % 2
    for (tau, g), part in got.groupby(["tau", "g"]):
        ys = np.sort([r[3] for r in rows if r[2] == g])
        assert part.q.to_numpy() == pytest.approx(np.quantile(ys, tau, method="inverted_cdf"), abs=0.05)


def test_boosted_predictions_cover_and_survive_saving(spark, boosted, tmp_path):
    blocks, specs, model = boosted
    rows = B.prediction_rows(model.blocks, ["series_id"], specs)
    assert rows.agg(F.min(F.to_date("ts"))).first()[0] > dt.date(2022, 1, 16)
    share = {r[0]: r[1] for r in rows.groupBy("tau").agg(F.avg((F.col("y") <= F.col("q")).cast("double"))).collect()}
    for tau, got in share.items():
        assert got == pytest.approx(tau, abs=0.15)
    B.save(model, str(tmp_path / "m"))
    again = B.predict(B.load(blocks, ["series_id"], str(tmp_path / "m")), blocks)
    one = model.blocks.orderBy("series_id", "block").toPandas().f
    two = again.orderBy("series_id", "block").toPandas().f
    for a, b in zip(one, two):
        assert np.asarray(a) == pytest.approx(np.asarray(b))


def test_long_series_in_passes_grow_the_trees_of_whole_ones(spark, boosted, monkeypatch):
    blocks, _, _ = boosted
    specs = [B.Spec(t, d, 0.3, u, 19020.0) for t in (0.1, 0.5) for d, u in ((1, 19008.0), (3, 19006.0))]
    fit = lambda: B.fit(blocks, ["series_id"], ["x", "g"], specs, 7, keep_at=(2,))
    whole = fit()
    monkeypatch.setattr(B, "LOCAL_ROWS", 0)
    passes = fit()
    order = ["series_id", "model_no", "round"]
    one, two = (m.trees.orderBy(*order).toPandas() for m in (whole, passes))
    assert len(one) == len(two) == 8 * 4 * one.series_id.nunique() and (one[order] == two[order]).all(axis=None)
    assert np.allclose(np.stack(one.tree), np.stack(two.tree), atol=1e-5)
    for r in (2, 7):
        a, b = (m.snapshots[r].orderBy("series_id", "block").toPandas().f for m in (whole, passes))
        assert all(np.allclose(x, y, atol=1e-4) for x, y in zip(a, b))


def test_siblings_follow_from_their_parent():
    rng = np.random.default_rng(3)
    left, right = rng.integers(0, 9, (4, 6)), rng.integers(0, 9, (4, 6))
    small = np.array([False, True, True, False])
    every = B.children(left + right, np.where(small[:, None], right, left), small)
    assert (every[::2] == left).all() and (every[1::2] == right).all()


def test_best_split_against_all_splits():
    rng = np.random.default_rng(4)
    for _ in range(30):
        codes, under, tau = rng.integers(0, 5, (40, 3)), rng.random(40) < 0.4, float(rng.choice([0.025, 0.5, 0.75]))
        n = np.stack([np.bincount(c, minlength=5) for c in codes.T]).ravel()
        below = np.stack([np.bincount(c[under], minlength=5) for c in codes.T]).ravel()
        feature, cls, gain, right_small = B.best_splits(n[None], below[None], tau, np.array([0, 5, 10]))
        g = tau - under
        score = lambda rows: g[rows].sum() ** 2 / (rows.sum() + B.RIDGE)
        gains = {(j, c): score(codes[:, j] <= c) + score(codes[:, j] > c) - score(codes[:, j] >= 0) for j in range(3) for c in range(4) if min((codes[:, j] <= c).sum(), (codes[:, j] > c).sum()) >= B.MIN_ROWS}
        assert gain[0] == pytest.approx(max(gains.values())) and gains[feature[0], cls[0]] == pytest.approx(gain[0])
        assert right_small[0] == ((codes[:, feature[0]] > cls[0]).sum() <= 20)


def test_codes_put_missing_values_first():
    codes = B.encode(np.array([[np.nan], [0.5], [1.5], [9.0]]), [[1.0, 2.0]])
    assert codes[:, 0].tolist() == [0, 1, 2, 3]


@pytest.mark.parametrize("limits", [{"FEW_MODELS": 0}, {"DIRECT_TASKS": 0}, {"FEW_MODELS": 0, "FAN_IN": 1}])
def test_every_way_of_adding_sums_agrees(spark, monkeypatch, limits):
    df = hourly(spark, 200)
    blocks = P.run(P.feature_blocks(df, ["series_id"], "ts", "y", [F.lit(1.0), F.col("x")], 2))
    fit = lambda: [r["coefs"] for r in L.quantile_regression(blocks, ["series_id"], 2, rounds=3).orderBy("series_id").collect()]
    want = fit()
    for name, value in limits.items():
        monkeypatch.setattr(P, name, value)
    for a, b in zip(want, fit()):
        assert b == pytest.approx(a)
