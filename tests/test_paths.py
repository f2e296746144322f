"""Recursions through time, done by blocks of dates, against the loops that go day by day."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palisand.operators import backtest, blocks, correlation, factors, rebalance, regimes, robust
from test_portfolio import days, long, sample


@pytest.fixture(params=[7, 64, 10_000])
def block(request, monkeypatch):
    """Blocks of a few dates, of some, and one of all."""
    monkeypatch.setattr(blocks, "BLOCK", request.param)


def test_rows_are_numbered_in_order(spark, block):
    df = spark.createDataFrame([(d, k) for k, d in enumerate(reversed(days(100)))], "date date, k int")
    got = blocks.numbered(df, "date").orderBy("date").collect()
    assert [r.i for r in got] == list(range(100)) and [r.k for r in got] == list(range(99, -1, -1))
    assert [r.block for r in got] == sorted(r.block for r in got)
    assert blocks.numbered(df.limit(0), "date").count() == 0


# --- dynamic correlations


def standardised(n=150, k=3):
    x = sample(n, k)
    return (x - x.mean(axis=0)) / x.std(axis=0)


def residuals(spark, z):
    return long(spark, z).withColumnRenamed("r", "z")


def day_by_day(z, rho, a, b):
    q = rho.copy()
    for row in z:
        d = np.sqrt(np.diag(q))
        yield q / np.outer(d, d)
        q = (1 - a - b) * rho + a * np.outer(row, row) + b * q


def test_correlations_are_the_day_by_day_loop(spark, block):
    z, p = standardised(), 0.5 ** (np.arange(150)[::-1] / 40)
    rows = correlation.ordered(residuals(spark, z))
    rho = correlation.target(rows, 40.0)
    c = np.cov(z.T, aweights=p, ddof=0)
    assert np.allclose(rho, c / np.sqrt(np.outer(np.diag(c), np.diag(c))), atol=1e-12)
    assert np.allclose(correlation.target(rows), np.corrcoef(z.T), atol=1e-12)
    i, j = np.triu_indices(3, 1)
    got = correlation.path(rows, rho, 0.07, 0.85).toPandas().sort_values(["date", "i", "j"])
    assert np.allclose(got["rho"], np.stack([m[i, j] for m in day_by_day(z, rho, 0.07, 0.85)]).ravel(), atol=1e-9)
    points = [(0.05, 0.9), (0.2, 0.3), (0.01, 0.3)]
    got = {r.k: r.v for r in correlation.likelihoods(rows, rho, points).collect()}
    for k, (a, b) in enumerate(points):
        want = sum(-0.5 * (np.linalg.slogdet(m)[1] + e @ np.linalg.solve(m, e)) for m, e in zip(day_by_day(z, rho, a, b), z, strict=True))
        assert got[k] == pytest.approx(want, abs=1e-9)
    weighted = correlation.likelihoods(rows, rho, points[:1], 40.0).first().v
    assert weighted == pytest.approx(sum(-0.5 * w * (np.linalg.slogdet(m)[1] + e @ np.linalg.solve(m, e)) for w, m, e in zip(p, day_by_day(z, rho, 0.05, 0.9), z, strict=True)), abs=1e-9)


def test_correlations_are_the_likeliest(spark):
    rng, rho = np.random.default_rng(5), np.array([[1, 0.5], [0.5, 1]])
    q, z = rho.copy(), []
    for _ in range(700):
        d = np.sqrt(np.diag(q))
        z.append(np.linalg.cholesky(q / np.outer(d, d)) @ rng.normal(size=2))
        q = 0.15 * rho + 0.15 * np.outer(z[-1], z[-1]) + 0.7 * q
    rows = correlation.ordered(residuals(spark, np.array(z)))
    own = correlation.target(rows)
    a, b = correlation.fit(rows, own)
    assert abs(a - 0.15) < 0.08 and abs(b - 0.7) < 0.15
    near = [(a, b), *((a + x, b + y) for x in (-2e-4, 0, 2e-4) for y in (-2e-4, 0, 2e-4))]
    score = {r.k: r.v for r in correlation.likelihoods(rows, own, near).collect()}
    assert max(score.values()) - score[0] < 1e-9
    assert correlation.fit(rows, own, bounds=((0.001, 0.05), (0.5, 0.6)), rounds=2) == pytest.approx((0.05, 0.6))  # the bounds hold


def test_correlations_of_the_last_dates(spark):
    z = standardised(200)
    got = correlation.dcc(residuals(spark, z), half_life=60.0, lookback=90, bounds=((0.001, 0.3), (0.5, 0.999))).toPandas()
    assert len(got) == 270 and got["date"].min() == days(200)[110] and got["rho"].abs().max() <= 1
    assert (got["a"] + got["b"]).max() <= correlation.MOST and got["a"].between(0.001, 0.3).all() and got["b"].between(0.5, 0.999).all()


# --- regimes


def test_regimes_are_the_day_by_day_model(spark, block):
    rng = np.random.default_rng(8)
    truth = np.repeat([0, 1, 0], [70, 50, 60])
    r = rng.normal(0.001, np.where(truth, 0.03, 0.008))
    rows = regimes.ordered(long(spark, r[:, None]))
    for k in (1, 2, 3):
        model, seen = regimes.fit(rows, k, steps=6, tol=0.0)
        path, post, move, mean, sd = factors.regimes(r, k, steps=6)
        assert np.allclose(model.sd, sd, rtol=1e-8) and np.allclose(model.mean, mean, atol=1e-9) and np.allclose(model.move, move, atol=1e-8)
        assert all(b >= a - 1e-9 for a, b in zip(seen, seen[1:], strict=False))  # never falls
        got = regimes.posteriors(rows, model).orderBy("i").collect()
        assert np.allclose([x.post for x in got], post, atol=1e-7)
        assert [x.state for x in regimes.states(rows, model).orderBy("i").collect()] == path.tolist()


def test_regimes_are_described(spark):
    rng = np.random.default_rng(8)
    truth = np.repeat([0, 1, 0], [150, 80, 150])
    x = long(spark, rng.normal(0, np.where(truth, 0.03, 0.008))[:, None])
    got = regimes.market_regimes(x, 2).toPandas().sort_values("date")
    assert ((got["regime"] == "Panic").to_numpy() == truth).mean() > 0.95
    assert got["p"].between(0.2, 1 + 1e-9).all() and got["p_next"].between(0, 1 + 1e-9).all() and (got["stay"] >= 1).all()
    flat = regimes.market_regimes(long(spark, np.zeros((60, 1))), 2)
    assert flat.count() == 60  # nothing to tell apart


# --- rebalancing


def walked(r, target, drift, flagged, cost=0.001):
    """Net, gross and turnover, going day by day."""
    w, net, gross, out = target.copy(), 1.0, 1.0, []
    for t, x in enumerate(r):
        change = 1 + w @ x
        net, gross, w, turnover = net * change, gross * change, w * (1 + x), None
        w = w / w.sum() if w.sum() > 0 else target.copy()
        if (drift is not None and np.abs(w - target).max() > drift) or t in flagged:
            turnover = np.abs(w - target).sum()
            net, w = net * (1 - turnover * cost), target.copy()
        out.append((net, gross, np.nan if turnover is None else turnover))
    return np.array(out)


@pytest.mark.parametrize(("drift", "every"), [(0.01, None), (0.03, None), (0.5, None), (0.0, None), (0.02, 21), (0.5, 21), (None, 21), (None, None)])
def test_simulation_is_the_day_by_day_loop(spark, monkeypatch, drift, every):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    x = sample(130, 3)
    r = long(spark, x)
    w = {"a": [0.5, 0.3, 0.2], "b": [1 / 3] * 3, "c": [1.0, 0.0, 0.0]}
    weights = spark.createDataFrame([(s, f"A{j}", v) for s, ws in w.items() for j, v in enumerate(ws)], "strategy string, asset string, w double")
    flagged = set(range(20, 130, every)) if every else set()
    on = spark.createDataFrame([(days(130)[t],) for t in sorted(flagged)], "date date") if every else None
    got = rebalance.simulate(r, weights, drift, on).toPandas().sort_values("date")
    for s, ws in w.items():
        own = got[got["strategy"] == s]
        assert np.allclose(own[["net", "gross", "turnover"]].to_numpy(dtype=float), walked(x, np.array(ws), drift, flagged), atol=1e-12, equal_nan=True)


def test_a_portfolio_that_loses_everything(spark):
    x = np.array([[0.1, -0.1], [-1.0, -1.0], [0.1, 0.2], [0.3, 0.1]])
    weights = spark.createDataFrame([("s", "A0", 0.5), ("s", "A1", 0.5)], "strategy string, asset string, w double")
    got = rebalance.simulate(long(spark, x), weights, 0.01).toPandas().sort_values("date")
    assert got["net"].tolist()[1:] == [0, 0, 0] and got["gross"].tolist()[1:] == [0, 0, 0]


def test_chains_are_followed(spark):
    jumps = spark.createDataFrame([("a", s, s + 3 if s < 50 else None) for s in range(-1, 60)] + [("b", -1, None), ("b", 0, 5)], "strategy string, s long, next long")
    got = {(r.strategy, r.s) for r in rebalance.chain(jumps).collect()}
    assert got == {("a", s) for s in range(2, 53, 3)}


def test_drags_name_ties_in_order(spark):
    rows = [("b", 0.02, 1.0, 3), ("a", 0.02, 2.0, 4), ("c", 0.01, 3.0, 5), ("d", 0.01, 0.0, 0)]
    got = {r.kind: (r.strategy, r.cost_drag, r.n_rebalances) for r in rebalance.cost_drags(spark.createDataFrame(rows, "strategy string, cost_drag double, turnover_a_year double, n_rebalances long")).collect()}
    assert got == {"average": (None, pytest.approx(0.015), 3.0), "most affected": ("a", 0.02, 4.0), "least affected": ("c", 0.01, 5.0)}


# --- reweighting


def student(x, p, nu, steps, normalised):
    mu = p @ x
    sigma = (x - mu).T @ ((x - mu) * p[:, None]) * (nu - 2) / nu
    for _ in range(steps):
        w = p * (nu + x.shape[1]) / (nu + ((x - mu) @ np.linalg.inv(sigma) * (x - mu)).sum(axis=1))
        m = w @ x / (w.sum() if normalised else 1)
        sigma = (x - m).T @ ((x - m) * w[:, None]) / (w.sum() if normalised else 1)
        mu = m / (1 if normalised else w.sum())
    return mu, sigma


@pytest.mark.parametrize("normalised", [False, True])
def test_location_and_dispersion_are_the_loop(spark, block, normalised):
    x = np.random.default_rng(2).standard_t(5, (400, 3)) * 0.02 + [0.01, 0.02, 0.0]
    p = 0.5 ** (np.arange(400)[::-1] / 90)
    mu, sigma = student(x, p / p.sum(), 5.0, 4, normalised)
    got = robust.mlfp(long(spark, x), 90.0, 5.0, steps=4, tol=0.0, normalised=normalised).toPandas().sort_values(["i", "j"])
    assert np.allclose(got["dispersion"], sigma.ravel(), atol=1e-12) and np.allclose(got["location"], np.repeat(mu, 3), atol=1e-12)


def lasso(x, y, p, penalty, steps=2000):
    b, size = np.zeros(x.shape[1]), p @ x**2
    for _ in range(steps):
        for k in range(len(b)):
            rest = (p * x[:, k]) @ (y - x @ b + x[:, k] * b[k])
            b[k] = math.copysign(max(abs(rest) - penalty, 0.0), rest) / size[k]
    return b


def by_rows(x, z, p, nu, penalty, rescale, steps):
    """The factor model with all dates at hand."""
    sx, sz = (np.sqrt(np.diag(np.cov(v.T, aweights=p))) for v in (x, z)) if rescale else (np.ones(x.shape[1]), np.ones(z.shape[1]))
    x, z, q = x / sx, z / sz, p
    for step in range(steps + 1):
        mx, mz = q @ x, q @ z
        b = np.stack([lasso(z - mz, x[:, i] - mx[i], q, penalty) for i in range(x.shape[1])])
        a = mx - b @ mz
        e = x - a - z @ b.T
        sigma = np.cov(e.T, aweights=q) * ((nu - 2) / nu if not step else (w @ q))  # noqa: F821  w is known from the second round on
        if step == steps:
            return a * sx, b / sz * sx[:, None], sigma * np.outer(sx, sx)
        w = (nu + x.shape[1]) / (nu + (e * np.linalg.solve(sigma, e.T).T).sum(axis=1))
        q = w * p / (w @ p)


@pytest.mark.parametrize(("penalty", "rescale"), [(0.0, False), (0.0, True), (0.05, True)])
def test_factor_model_is_the_loop(spark, penalty, rescale):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(300, 2)) * [0.02, 0.1]
    x = z @ np.array([[0.5, 1.0, 0.0], [0.2, 0.0, -0.3]]) + 0.001 + rng.standard_t(4, (300, 3)) * 0.01
    p = 0.5 ** (np.arange(300)[::-1] / 120.0)
    a, b, sigma = by_rows(x, z, p / p.sum(), 4.0, penalty, rescale, 5)
    frame = spark.createDataFrame(pd.DataFrame({"date": days(300), "f": z.tolist()}), "date date, f array<double>")
    got = robust.factor_model(long(spark, x), frame, 120.0, 4.0, penalty, rescale, steps=5, tol=0.0).toPandas().sort_values(["asset", "factor"])
    assert np.allclose(got["beta"], b.ravel(), atol=1e-8) and np.allclose(got["alpha"], np.repeat(a, 2), atol=1e-9)
    assert np.allclose(got["sigma"], np.repeat(np.diag(sigma), 2), atol=1e-10)


def test_slopes_shrink():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3))
    y = x @ [1.0, 0.0, -0.5]
    zz, zx = x.T @ x / 500, (x.T @ y / 500)[:, None]
    assert np.allclose(robust.slopes(zz, zx, 0.0).ravel(), [1, 0, -0.5])
    small = robust.slopes(zz, zx, 0.2).ravel()
    assert small[1] == 0 and 0.7 < small[0] < 0.9 and -0.4 < small[2] < -0.2


# --- the back-test


@pytest.mark.parametrize("window", [40, 80])
def test_backtest_with_regimes_is_the_day_by_day_loop(spark, monkeypatch, window):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    x = sample(130)
    configs = [
        backtest.Config(run_id="hmm", window=window, n_components=3, z_entry=0.5, reestimation_freq=10, rebalance_freq=4),
        backtest.Config(run_id="plain", window=60, n_components=2, z_entry=0.8, reestimation_freq=25, rebalance_freq=2, use_hmm=False, cost_bps=30.0),
    ]
    rows = backtest.ordered(long(spark, x))
    learned = backtest.estimates(spark, rows, configs).toPandas()
    got = backtest.run(spark, long(spark, x), configs).toPandas().sort_values("date")
    for c in configs:
        known = {p.t: p for p in learned[learned["run_id"] == c.run_id].itertuples(index=False)}
        w, p, out = np.full(4, 0.25), None, []
        for t in range(c.window, 130):
            p = known.get(t, p)
            load, recent = np.array(p.loadings).reshape(-1, 4), x[t - c.window : t]
            f = ((recent - p.mean) / p.sd @ load.T).cumsum(axis=0)[-factors.RECENT :]
            z = (f[-1] - f.mean(axis=0)) / f.std(axis=0)
            regime, turnover, active = "Calm", 0.0, {}
            if c.use_hmm:
                regime = factors.NAMES[2][backtest.regime_now(recent.mean(axis=1), np.array(p.move).reshape(2, 2), np.array(p.centre), np.array(p.spread))]
            if (t - c.window) % (c.rebalance_freq + 1) == 0:
                new, active = backtest.target(z, load, p.reverting, regime, c)
                turnover, w = np.abs(new - w).sum(), new
            out.append((w @ x[t] - turnover * c.cost_bps / 1e4, x[t].mean(), regime, turnover, active, z))
            w = w * np.exp(x[t])
            w /= w.sum()
        own = got[got["run_id"] == c.run_id]
        r, b, regime, turnover, active, z = zip(*out, strict=True)
        assert np.allclose(own["r"], r, atol=1e-11) and np.allclose(own["b"], b, atol=1e-12) and np.allclose(own["turnover"], turnover, atol=1e-11)
        assert own["regime"].tolist() == list(regime) and np.allclose(np.stack(own["z"]), np.stack(z), atol=1e-8)
        assert [set(s) for s in own["signals"]] == [set(s) for s in active]


def test_no_plan_has_one_partition_of_all_dates(spark):
    """What is handed out groups by block, not by a constant."""
    r = long(spark, sample(100, 3))
    for df in (correlation.path(correlation.ordered(residuals(spark, standardised(100))), np.eye(3), 0.1, 0.8), regimes.posteriors(regimes.ordered(r), regimes.Model(np.array([1.0]), np.array([[1.0]]), np.array([0.0]), np.array([0.01])))):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
    assert rebalance.rebalancing_days(r, spark.createDataFrame([("s", f"A{j}", 1 / 3) for j in range(3)], "strategy string, asset string, w double"), 0.02).groupBy("strategy").agg(F.count("*")).count() == 1
