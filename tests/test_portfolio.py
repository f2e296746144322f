"""Solvers, models and path rules against brute force, closed forms and hand-made cases."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palisand.functions import distributions as dist
from palisand.operators import backtest, factors, metrics, optimize, panel, rebalance, series
from palisand.sources import prices, quotes


def days(n: int) -> list[dt.date]:
    out, d = [], dt.date(2020, 1, 1)
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


def sample(n: int = 300, k: int = 4, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.normal(0.0006, 0.01, (n, k)) * np.linspace(0.7, 1.6, k) + rng.normal(0, 0.006, (n, 1)) + np.linspace(0, 0.0008, k)


def long(spark, x: np.ndarray):
    rows = [(d, f"A{j}", float(v)) for d, r in zip(days(len(x)), x, strict=True) for j, v in enumerate(r)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["date", "asset", "r"]), "date date, asset string, r double")


def one(spark, r: list[float]):
    return spark.createDataFrame([("s", d, float(v)) for d, v in zip(days(len(r)), r, strict=True)], "strategy string, date date, r double")


def simplex(k: int, n: int, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).dirichlet(np.ones(k) * 0.7, n)


@pytest.fixture(scope="module")
def problem():
    x = sample()
    return x, x.mean(axis=0) * 252, np.cov(x.T) * 252


def test_min_vol_and_targets_beat_random_portfolios(problem):
    _, mean, cov = problem
    w = simplex(4, 40_000)
    vol = np.sqrt(((w @ cov) * w).sum(axis=1))
    best = optimize.min_vol(mean, cov, 0.02)
    assert best.sum() == pytest.approx(1, abs=1e-9) and best.min() > -1e-9
    assert math.sqrt(best @ cov @ best) <= vol.min() + 1e-9
    t = float(mean.mean())
    at = optimize.at_target(mean, cov, t)
    assert at @ mean == pytest.approx(t, abs=1e-8)
    near = vol[np.abs(w @ mean - t) < 1e-3]
    assert math.sqrt(at @ cov @ at) <= near.min() + 1e-3
    with pytest.raises(ValueError):
        optimize.at_target(mean, cov, float(mean.max()) + 1)


def test_max_sharpe_beats_random_portfolios(problem):
    _, mean, cov = problem
    w = simplex(4, 40_000)
    ratio = lambda v: (v @ mean - 0.02) / np.sqrt(((v @ cov) * v).sum(axis=-1))
    assert ratio(optimize.max_sharpe(mean, cov, 0.02)) >= ratio(w).max() - 1e-9
    high = float(mean.max()) + 0.1
    worse = (w @ mean - high) / np.sqrt(((w @ cov) * w).sum(axis=1))
    got = optimize.max_sharpe(mean, cov, high)
    assert (got @ mean - high) / math.sqrt(got @ cov @ got) >= worse.max() - 1e-9


def test_risk_parity_shares_are_equal(problem):
    _, mean, cov = problem
    w = optimize.risk_parity(mean, cov, 0.0)
    share = w * (cov @ w) / (w @ cov @ w)
    assert np.abs(share - 0.25).max() < 1e-8


def test_least_cvar_beats_random_portfolios(problem):
    x, mean, _ = problem

    def cvar(w: np.ndarray, alpha: float = 0.95) -> float:
        loss = np.sort(-(x @ w))[::-1]
        k = (1 - alpha) * len(loss)
        whole = int(k + 1e-9)
        return (loss[:whole].sum() + (k - whole) * loss[whole]) / k

    best = optimize.least_cvar(x)
    assert best.sum() == pytest.approx(1) and cvar(best) <= min(cvar(w) for w in simplex(4, 4000)) + 1e-7
    floor = float(np.quantile(mean, 0.8))
    held = optimize.least_cvar(x, floor=floor)
    assert held @ mean >= floor - 1e-6
    assert cvar(held) <= min(cvar(w) for w in simplex(4, 4000) if w @ mean >= floor) + 1e-6
    with pytest.raises(ValueError):
        optimize.least_cvar(x[:20])
    with pytest.raises(ValueError):
        optimize.least_cvar(x, floor=float(mean.max()) + 1)


def test_tree_of_assets_with_ties():
    cov = np.array([[1, 1, 0.2], [1, 1, 0.2], [0.2, 0.2, 1.0]])  # two identical assets
    merges = optimize.linkage(optimize.distances(cov))
    assert merges[0][:2] == (0, 1) and merges[0][2] == 0
    w = optimize.hrp(np.zeros(3), cov, 0.0)
    assert w.sum() == pytest.approx(1) and (w > 0).all()


def test_weights_of_all_strategies_and_unknown_ones(spark, problem):
    r = long(spark, problem[0])
    got = optimize.weights(r).toPandas()
    assert set(got["strategy"]) == set(optimize.STRATEGIES) and (got["status"] == "ok").all()
    assert np.allclose(got.groupby("strategy")["w"].sum(), 1)
    short = optimize.weights(r.filter(F.col("date") < F.lit("2020-01-20")), ["cvar"]).toPandas()
    assert (short["status"] != "ok").all() and np.allclose(short["w"], 0.25)
    with pytest.raises(ValueError):
        optimize.weights(r, ["nonsense"])


def test_rebalancing_on_no_day_is_holding(spark, problem):
    r = long(spark, problem[0])
    w = spark.createDataFrame([("s", f"A{j}", 0.25) for j in range(4)], "strategy string, asset string, w double")
    none = rebalance.calendar(r, w, rebalance.schedule(r, "M").filter("false")).toPandas().sort_values("date")
    held = rebalance.hold(r, w).toPandas().sort_values("date")
    assert np.allclose(none["net"], held["value"]) and np.allclose(none["gross"], held["value"]) and none["turnover"].isna().all()
    free = rebalance.calendar(r, w, r.select("date").distinct(), 0.0).toPandas().sort_values("date")
    assert np.allclose(free["net"], np.cumprod(1 + problem[0].mean(axis=1)))  # every day: equal weights each day


def test_month_ends_on_weekends_do_not_fire_by_label(spark):
    r = long(spark, sample(260))
    label = rebalance.schedule(r, "M", "calendar_end").count()
    assert rebalance.schedule(r, "M").count() > label > 0


def test_metrics_of_edge_series(spark):
    up = metrics.robust(one(spark, [0.01, 0.02, 0.01])).first()
    assert up["sortino"] == math.inf and up["calmar"] == math.inf
    assert metrics.target_sortino(one(spark, [0.01, 0.02])).first()["sortino"] == math.inf
    single = metrics.robust(one(spark, [0.01, -0.02, 0.03])).first()
    assert single["sortino"] is None
    assert metrics.basic(one(spark, [0.01, -0.02, 0.03])).first()["sortino"] == 0
    flat = metrics.basic(one(spark, [0.0, 0.0, 0.0])).first()
    assert flat["sharpe"] == 0 and flat["max_drawdown"] == 0 and flat["calmar"] == 0
    assert metrics.basic(one(spark, [0.01]).filter("false")).count() == 0


def test_dates_with_a_missing_asset_go(spark):
    rows = [("2020-01-01", "A", 1.0), ("2020-01-01", "B", None), ("2020-01-02", "A", 1.0), ("2020-01-02", "B", 2.0), ("2020-01-03", "A", float("nan")), ("2020-01-03", "B", 1.0)]
    df = spark.createDataFrame(rows, "date string, asset string, price double").withColumn("date", F.to_date("date"))
    assert [str(x["date"]) for x in panel.complete_dates(df).select("date").distinct().collect()] == ["2020-01-02"]


def test_distributions():
    assert dist.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert dist.t_two_sided(0.0, 5) == pytest.approx(1)
    assert dist.t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert dist.binomial_two_sided(5, 10) == pytest.approx(1)
    assert dist.binomial_two_sided(9, 10) == pytest.approx(22 / 1024)
    assert dist.kolmogorov(0.0, 50) == 1 and dist.kolmogorov(0.9, 50) < 1e-9
    rng = np.random.default_rng(1)
    assert dist.shapiro(rng.normal(size=400))[1] > 0.01 and dist.shapiro(rng.exponential(size=400))[1] < 1e-6
    low = dist.simplex_search(lambda p: float((p[0] - 3) ** 2 + 10 * (p[1] + 1) ** 2), np.zeros(2), 1.0)
    assert np.allclose(low, [3, -1], atol=1e-3)


def test_garch_finds_its_parameters():
    rng = np.random.default_rng(5)
    h, r = 1e-4, []
    for _ in range(3000):
        e = rng.normal() * math.sqrt(h)
        r.append(e)
        h = 5e-6 + 0.10 * e * e + 0.85 * h
    _, _, alpha, beta = series.fit_garch(np.array(r))
    assert abs(alpha - 0.10) < 0.04 and abs(beta - 0.85) < 0.08


def test_vector_models_find_their_parameters(spark):
    rng, b = np.random.default_rng(2), np.array([[0.5, 0.2], [0.0, 0.3]])
    x = [np.zeros(2)]
    for _ in range(3000):
        x.append(b @ x[-1] + rng.normal(size=2))
    got = series.var1(long(spark, np.array(x))).toPandas().sort_values(["i", "j"])
    assert np.allclose(got["b"], b.ravel(), atol=0.06) and got["radius"].max() < 1
    walk = rng.normal(size=1500).cumsum()
    pair = np.c_[walk, walk + rng.normal(size=1500)]
    found = series.cointegration(long(spark, pair), 0.9).toPandas()
    assert found["k"].nunique() == 1 and abs(found["loading"].sum()) < 0.05


def test_components_and_regimes():
    x = sample()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    v, share = factors.components(np.corrcoef(x.T), 4)
    assert np.allclose(v.T @ v, np.eye(4)) and share.sum() == pytest.approx(1) and np.all(np.diff(share) <= 0)
    assert np.allclose((z @ v[:, 0]).var(), share[0] * 4)
    rng = np.random.default_rng(8)
    truth = np.repeat([0, 1, 0], [300, 150, 300])
    path, post, move, _, sd = factors.regimes(rng.normal(0, np.where(truth, 0.03, 0.008)), 2)
    assert (path == truth).mean() > 0.95 and sd[0] < sd[1] and np.allclose(post.sum(axis=1), 1) and np.allclose(move.sum(axis=1), 1)


def test_backtest_is_the_day_by_day_loop(spark):
    x = sample(150)
    c = backtest.Config(window=80, n_components=3, z_entry=0.8, use_hmm=False, reestimation_freq=10, rebalance_freq=4)
    got = backtest.run(spark, long(spark, x), [c]).toPandas().sort_values("date")
    w, since, again, r = np.full(4, 0.25), c.rebalance_freq, c.reestimation_freq, []
    for t in range(80, 150):
        past = x[t - 80 : t]
        if again >= c.reestimation_freq:
            m, s = past.mean(axis=0), past.std(axis=0)
            v, _ = factors.components(np.corrcoef(past.T), 3)
            f = ((past - m) / s @ v).cumsum(axis=0)
            beta = [np.polyfit(f[:-1, k], f[1:, k], 1)[0] for k in range(3)]
            again = 0
        else:
            again += 1
        f = ((past - m) / s @ v).cumsum(axis=0)[-60:]
        z = (f[-1] - f.mean(axis=0)) / f.std(axis=0)
        cost = 0.0
        if since >= c.rebalance_freq:
            ok = [0 < b < 0.99 and math.log(2) / -math.log(b) < 60 for b in beta]
            new, _ = backtest.target(z, v.T, ok, "Calm", c)
            cost, w, since = np.abs(new - w).sum() * 10 / 1e4, new, 0
        else:
            since += 1
        r.append(w @ x[t] - cost)
        w = w * np.exp(x[t])
        w /= w.sum()
    assert np.allclose(got["r"], r, atol=1e-12)
    assert backtest.summary(backtest.run(spark, long(spark, x), [c])).first()["n"] == 70
    for wrong in ([backtest.Config(min_weight=0.5, max_weight=0.1)], [backtest.Config(), backtest.Config(z_entry=1.0)]):  # the second: two runs of one name
        with pytest.raises(ValueError):
            backtest.run(spark, long(spark, x), wrong)


def test_splits_embargo_and_overfitting(spark):
    r = long(spark, sample(200))
    last = backtest.splits(r, 5, 2, 0.05).toPandas()
    each = backtest.splits(r, 5, 2, 0.05, "all_folds").toPandas()
    assert last["split_id"].nunique() == 10 and len(each) < len(last)
    assert len(last[(last["split_id"] == 0) & (last["role"] == "test")]) == 80
    rows = [("a", 0, "train", 2.0), ("b", 0, "train", 1.0), ("a", 0, "test", 0.1), ("b", 0, "test", 0.5), ("a", 1, "train", 2.0), ("b", 1, "train", 1.0), ("a", 1, "test", 0.5), ("b", 1, "test", 0.5)]
    got = backtest.overfitting(spark.createDataFrame(rows, "method string, split_id int, role string, sharpe double")).first()
    assert got["n_splits"] == 2 and got["pbo"] == 0.5  # a tie ranks in the middle


def test_splits_and_their_parts_must_be_long_enough(spark):
    with pytest.raises(ValueError):
        backtest.splits(long(spark, sample(99)), 5)
    assert backtest.splits(long(spark, sample(110)), 5, 3).count() == 0  # 44 training dates
    assert backtest.splits(long(spark, sample(100)), 5, 2).select("split_id").distinct().count() == 10


def test_assets_without_variance():
    flat = np.zeros((4, 4))
    assert np.allclose(optimize.hrp(np.zeros(4), flat, 0.0), 0.25)


def test_frontier_says_how_each_target_ended(spark, problem):
    got = optimize.frontier(long(spark, problem[0]), 5).toPandas()
    assert len(got) == 5 and (got["status"] == "ok").all()


def test_forms_of_a_vector_model_agree_with_least_squares(spark):
    x = sample(200, 3).cumsum(axis=0)
    past = np.c_[np.ones(199), x[:-1]]
    want = np.linalg.lstsq(past, x[1:], rcond=None)[0]
    got = series.var1(long(spark, x)).toPandas().sort_values(["i", "j"])
    assert np.allclose(got["b"].to_numpy().reshape(3, 3), want[1:].T, atol=1e-5) and np.allclose(got["c"].to_numpy()[::3], want[0], atol=1e-5)
    diff = series.var1(long(spark, x), form="differences").toPandas().sort_values(["i", "j"])
    assert np.allclose(diff["b"].to_numpy().reshape(3, 3), want[1:].T - np.eye(3), atol=1e-5)
    with pytest.raises(ValueError):
        series.var1(long(spark, x), form="else")


def test_garch_of_a_flat_series_is_standardised(spark):
    got = series.garch(long(spark, np.zeros((40, 1)))).toPandas()
    assert (got["z"] == 0).all() and (got["alpha"] == 0).all()


def test_votes_for_normality(spark):
    rng = np.random.default_rng(1)
    r = long(spark, np.c_[rng.normal(size=400), rng.standard_t(2, 400)])
    jb = metrics.moments(r.withColumnRenamed("asset", "strategy")).select(F.col("strategy").alias("asset"), "p")
    votes = {x["asset"]: x["votes"] for x in series.normality_votes(r, jb).collect()}
    assert votes == {"A0": 3, "A1": 0}


def test_quotes_behind_a_url(spark, tmp_path):
    dates = days(40)
    (tmp_path / "AAA.csv").write_text("Date,Open,Adj Close,Close\n" + "".join(f"{d},1,2,{i}\n" for i, d in enumerate(dates)))
    (tmp_path / "BBB.csv").write_text("Date,X Close\n" + "".join(f"{d} 00:00:00,{i}\n" for i, d in enumerate(dates)))
    (tmp_path / "CCC.csv").write_text("Date,Close\n2020-01-01,3\n")
    spark.dataSource.register(quotes.QuoteSource)
    spark.dataSource.register(quotes.QuoteStatus)
    options = {"url": f"file://{tmp_path}/{{symbol}}.csv", "schemes": "file"}
    read = spark.read.format("quotes").options(**options)
    got = read.option("symbols", "aaa, BBB,CCC,DDD,AAA").load().groupBy("asset").agg(F.count("*").alias("n"), F.max("price").alias("p")).collect()
    assert sorted(map(tuple, got)) == [("AAA", 40, 39.0), ("BBB", 40, 39.0)]
    status = {r.asset: (r.n, r.error) for r in spark.read.format("quote_status").options(**options).option("symbols", "AAA,CCC,DDD").load().collect()}
    assert status["AAA"] == (40, None) and status["CCC"] == (1, "fewer than 30 prices") and status["DDD"][0] == 0 and status["DDD"][1]
    for wrong in ({"schemes": "https"}, {"url": f"file://{tmp_path}/AAA.csv"}):
        with pytest.raises(Exception, match="followed|needed"):
            spark.read.format("quotes").options(**{**options, **wrong}).option("symbols", "AAA").load().collect()
    assert quotes.price_column(["Date", "Adj Close"]) == 1
    with pytest.raises(ValueError):
        quotes.parsed("Date,Open\n2020-01-01,1\n")


def test_sales_are_scanned_once(spark):
    from palisand.plans import catalog

    for name in ("met_basic", "fac_stability", "reb_cost_tables"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "lineitem" not in plan  # it reads the stored panel


def test_bootstrap_is_repeatable(spark):
    s = one(spark, sample(120, 1)[:, 0].tolist())
    a, b = (backtest.bootstrap(spark, s, np.mean, 200, seed=7).first() for _ in range(2))
    assert a == b and a["low"] < a["point"] < a["high"]


def test_price_files(spark, tmp_path):
    (tmp_path / "prices_data.csv").write_text("Date,A.X,asset\n2020-01-01,1.5,2\n2020-01-02,,3\n")
    got = sorted(tuple(x) for x in prices.load(spark, str(tmp_path)).collect())
    assert got == [(dt.date(2020, 1, 1), "A.X", 1.5), (dt.date(2020, 1, 1), "asset", 2.0), (dt.date(2020, 1, 2), "asset", 3.0)]
    with pytest.raises(ValueError):
        prices.load(spark, "x.pkl")
    with pytest.raises(FileNotFoundError):
        prices.load(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        prices.validated(prices.load(spark, str(tmp_path)))


def test_bars_of_a_stream(spark, tmp_path):
    from palisand.streaming.bars import bars

    src = str(tmp_path / "in")
    spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), "A", 1.0), (dt.datetime(2024, 1, 1, 9), "A", 3.0), (dt.datetime(2024, 1, 3), "A", 5.0)], "ts timestamp, asset string, value double").write.parquet(src)
    q = bars(spark.readStream.schema("ts timestamp, asset string, value double").parquet(src)).writeStream.format("memory").queryName("bars_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((x["price"], x["n"]) for x in spark.table("bars_out").collect()) == [(2.0, 2), (5.0, 1)]


def test_normal_quantiles(spark):
    from statistics import NormalDist

    from palisand.functions import scalars

    ps = [1e-300, 1e-12, 1e-4, 0.05, 0.075, 0.25, 0.5, 0.6, 0.925, 0.99, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, -0.5, None]], "p double").select("p", scalars.normal_ppf(F.col("p")).alias("z")).collect()
    for r in got:
        assert r.z is None if r.p not in ps else r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-13, abs=1e-15)


def test_the_most_volatile_portfolio_is_in_no_bucket(spark):
    top = next(x / 7 for x in range(1, 1000) if x / 7 / (x / 7 / 50) < 50)  # the division rounds down
    cloud = spark.createDataFrame([(0.1, 0.0), (0.2, top / 2 + top / 1000), (9.0, top)], "ret double, vol double")
    assert {(r.bucket, r.ret) for r in optimize.risk_buckets(cloud).collect()} == {(0, 0.1), (25, 0.2)}


def test_buckets_are_of_one_cloud(spark):
    def made(frames):
        import random

        shift = random.SystemRandom().uniform(0, 1000)  # another one whenever the cloud is made
        for x in frames:
            yield pd.DataFrame({"ret": x["id"] * 1.0, "vol": shift + x["id"] / 101})

    cloud = spark.range(0, 102, 1, 1).mapInPandas(made, "ret double, vol double")
    assert {r.bucket for r in optimize.risk_buckets(cloud).collect()} == set(range(50))
