"""Market regimes: a Gaussian hidden Markov model by scans over blocks of dates.

The step of a date is a k x k matrix in logarithms; products of such matrices (sums of exponentials, or maxima for the most likely
path) are associative.  Blocks of dates are multiplied out in tasks, their k x k products (at most blocks.BLOCKS of them) are put together
forwards and backwards on the driver, and each block then knows what enters it from either side: posteriors
and the most likely states follow from its own dates.  A round of the fit is one such pass.  No task holds all dates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisand.operators.blocks import numbered
from palisand.operators.factors import NAMES, log_sum
from palisand.storage import staged


@dataclass(frozen=True)
class Model:
    """Probabilities of the first state and of moves, means and deviations of each state."""

    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    sd: np.ndarray

    def like(self, r: np.ndarray) -> np.ndarray:
        return -0.5 * ((r[:, None] - self.mean) / self.sd) ** 2 - np.log(self.sd) - 0.5 * np.log(2 * np.pi)

    @property
    def logs(self) -> np.ndarray:
        return np.log(np.maximum(self.move, 1e-300))

    @property
    def first(self) -> np.ndarray:
        return np.log(np.maximum(self.start, 1e-300))

    def by_deviation(self) -> Model:
        o = np.argsort(self.sd, kind="stable")
        return Model(self.start[o], self.move[np.ix_(o, o)], self.mean[o], self.sd[o])


def products(rows: DataFrame, m: Model, plus) -> dict[int, np.ndarray]:
    """By block, in order: the product of its dates' matrices, plus(x, axis) being the sum of the semiring.  The first date of all has no move."""
    k = len(m.sd)

    def product(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        like, logs = m.like(frame["r"].to_numpy()), m.logs
        out = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)
        for t, row in enumerate(like):
            if t or frame["i"].iloc[0]:
                out = plus(out[:, :, None] + logs[None], 1)
            out = out + row
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "m": [out.ravel()]})

    with np.errstate(divide="ignore"):
        found = rows.groupBy("block").applyInPandas(product, "block int, m array<double>").collect()
    return {r.block: np.array(r.m).reshape(k, k) for r in sorted(found)}


def largest(x: np.ndarray, axis: int) -> np.ndarray:
    return x.max(axis=axis)


def total(x: np.ndarray, axis: int) -> np.ndarray:
    """log_sum that bears an axis of minus infinities only."""
    top = np.maximum(x.max(axis=axis, keepdims=True), -1e300)
    return (top + np.log(np.maximum(np.exp(x - top).sum(axis=axis, keepdims=True), 1e-300))).squeeze(axis)


def sides(rows: DataFrame, m: Model) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], float]:
    """By block, logarithms of what enters it from before (joint with all dates before) and from behind, and the log-likelihood."""
    found = products(rows, m, total)
    state, before = m.first, {}
    for b, p in found.items():
        before[b] = state
        state = log_sum(state[:, None] + p, 0)
    after, behind = np.zeros(len(m.sd)), {}
    for b in reversed(found):
        behind[b] = after
        after = log_sum(found[b] + after[None, :], 1)
    return {b: (before[b], behind[b]) for b in found}, float(log_sum(state, 0))


def _both(frame: pd.DataFrame, m: Model, side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """like, and logarithms of forward and backward variables of a block's dates."""
    like, logs = m.like(frame["r"].to_numpy()), m.logs
    fwd, bwd = np.empty_like(like), np.empty_like(like)
    state = side[0]
    for t, row in enumerate(like):
        state = row + (log_sum(state[:, None] + logs, 0) if t or frame["i"].iloc[0] else state)
        fwd[t] = state
    bwd[-1] = side[1]
    for t in range(len(like) - 2, -1, -1):
        bwd[t] = log_sum(logs + (like[t + 1] + bwd[t + 1])[None, :], 1)
    return like, fwd, bwd


def expected(rows: DataFrame, m: Model, centre: float) -> tuple[float, np.ndarray]:
    """The log-likelihood, and expected counts of moves (k x k), of states, and their sums of r - centre and its squares, and of first states.

    One job: a block tells its product and, for each pair of a state before it and a state at its end, what it would count if these were the ones;
    how likely they are is known when the products are put together."""
    k = len(m.sd)

    def conditional(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        r, opens = frame["r"].to_numpy(), not frame["i"].iloc[0]
        like, logs, never = m.like(r), m.logs, np.where(np.eye(k, dtype=bool), 0.0, -np.inf)
        fwd, bwd = np.empty((len(r), k, k)), np.empty((len(r), k, k))  # by the state before, by the state at the end
        state = never
        for t, row in enumerate(like):
            state = row + (state if opens and not t else total(state[:, :, None] + logs[None], 1))
            fwd[t] = state
        bwd[-1] = never
        for t in range(len(r) - 2, -1, -1):
            bwd[t] = total(logs[None] + (like[t + 1] + bwd[t + 1])[:, None, :], 2)
        product = fwd[-1]
        base = np.where(np.isfinite(product), product, np.inf)
        post = np.exp(fwd[:, :, None, :] + bwd[:, None, :, :] - base[None, :, :, None])
        ahead = like[:, None, :] + bwd
        pair = np.exp(fwd[:-1, :, None, :, None] + logs[None, None, None] + ahead[1:, None, :, None, :] - base[None, :, :, None, None]).sum(axis=0)
        if not opens:  # the move into the block
            into = np.exp(logs[:, None, :] + ahead[0][None, :, :] - base[:, :, None])
            pair[np.arange(k), :, np.arange(k), :] += into
        x = r - centre
        counts = np.concatenate([pair.reshape(k, k, k * k), post.sum(axis=0), np.tensordot(x, post, 1), np.tensordot(x**2, post, 1), post[0] * opens], axis=2)
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "m": [product.ravel()], "counts": [counts.ravel()]})

    found = sorted(rows.groupBy("block").applyInPandas(conditional, "block int, m array<double>, counts array<double>").collect())
    maps = [np.array(x.m).reshape(k, k) for x in found]
    before, state = [], m.first
    for p in maps:
        before.append(state)
        state = log_sum(state[:, None] + p, 0)
    like_all, after, sums = float(log_sum(state, 0)), np.zeros(k), 0.0
    for x, p, enter in zip(reversed(found), reversed(maps), reversed(before), strict=True):
        share = np.exp(enter[:, None] + p + after[None, :] - like_all)
        sums = sums + np.tensordot(share, np.array(x.counts).reshape(k, k, -1), 2)
        after = log_sum(p + after[None, :], 1)
    return like_all, sums


def learned(m: Model, counts: np.ndarray, centre: float) -> Model:
    """The model of the next round."""
    k = len(m.sd)
    pair, (size, one, two, start) = counts[: k * k].reshape(k, k), counts[k * k :].reshape(4, k)
    return Model(start / start.sum(), pair / pair.sum(axis=1, keepdims=True), centre + one / size, np.sqrt(np.maximum(two / size - (one / size) ** 2, 1e-12)))


def began(rows: DataFrame, k: int) -> tuple[Model, float]:
    """The model to start from, deviations being those of k equal groups by distance from the mean; and the mean."""
    n, centre = rows.agg(F.count("*"), F.avg("r")).first()
    ranked = numbered(rows.select("date", "r", F.abs(F.col("r") - centre).alias("far")), "far", "date")
    small, extra = divmod(n, k)
    split = extra * (small + 1)
    group = F.when(F.col("i") < split, F.floor(F.col("i") / (small + 1))).otherwise(extra + F.floor((F.col("i") - split) / max(small, 1)))
    sd = {r.g: r.s for r in ranked.groupBy(group.alias("g")).agg(F.stddev_pop("r").alias("s")).collect()}
    move = np.full((k, k), 0.1 / max(k - 1, 1))
    np.fill_diagonal(move, 0.9 if k > 1 else 1.0)
    return Model(np.full(k, 1 / k), move, np.full(k, centre), np.array([max(sd.get(g, 0.0), 1e-6) for g in range(k)])), centre


def fit(rows: DataFrame, k: int, steps: int = 100, tol: float = 0.01) -> tuple[Model, list[float]]:
    """The model by expectation and maximisation, states in ascending order of deviation, and the log-likelihood of each round;
    it ends when a round gains less than tol."""
    m, centre = began(rows, k)
    seen: list[float] = []
    for step in range(steps + 1):
        like_all, counts = expected(rows, m, centre)
        seen.append(like_all)
        if step == steps or step and abs(seen[-1] - seen[-2]) < tol:
            break
        m = learned(m, counts, centre)
    return m.by_deviation(), seen


def posteriors(rows: DataFrame, m: Model) -> DataFrame:
    """i, date, post: probabilities of the states on each date, given all dates."""
    known, like_all = sides(rows, m)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        _, fwd, bwd = _both(frame, m, known[frame["block"].iloc[0]])
        return frame[["i", "date"]].assign(post=list(np.exp(fwd + bwd - like_all)))

    return rows.groupBy("block").applyInPandas(one, "i long, date date, post array<double>")


def states(rows: DataFrame, m: Model) -> DataFrame:
    """i, date, state: the most likely path.  Blocks are entered with the best values of all dates before; each says from which
    state before it every state at its end comes, and these maps, followed from the last block back, give every block its last state."""
    k, state, before = len(m.sd), m.first, {}
    for b, p in products(rows, m, largest).items():
        before[b] = state
        state = (state[:, None] + p).max(axis=0)

    def steps_back(frame: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray], np.ndarray]:
        frame = frame.sort_values("i")
        best, back = before[frame["block"].iloc[0]], []
        for t, row in enumerate(m.like(frame["r"].to_numpy())):
            if t or frame["i"].iloc[0]:
                reach = best[:, None] + m.logs
                back.append(reach.argmax(axis=0))
                best = reach.max(axis=0)
            else:
                back.append(np.arange(k))
            best = best + row
        return frame, back, best

    def through(frame: pd.DataFrame) -> pd.DataFrame:
        frame, back, best = steps_back(frame)
        at = np.arange(k)
        for step in reversed(back):
            at = step[at]
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "came": [at], "last": [int(best.argmax())]})

    came = sorted(rows.groupBy("block").applyInPandas(through, "block int, came array<int>, last int").collect())
    ends, at = {}, came[-1].last if came else 0
    for r in reversed(came):
        ends[r.block] = at
        at = r.came[at]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame, back, _ = steps_back(frame)
        path = [ends[frame["block"].iloc[0]]]
        for step in reversed(back[1:]):
            path.append(int(step[path[-1]]))
        return frame[["i", "date"]].assign(state=path[::-1])

    return rows.groupBy("block").applyInPandas(one, "i long, date date, state int")


def described(rows: DataFrame, m: Model) -> DataFrame:
    """date, regime, p (its posterior), stay (expected dates in it) and p_next (its probability on the next date)."""
    k = len(m.sd)
    name, stay = F.array(*map(F.lit, NAMES[k])), F.array(*[F.lit(float(1 / max(1 - m.move[s, s], 1e-12))) for s in range(k)])
    to = F.array(*[F.array(*[F.lit(float(m.move[s, e])) for s in range(k)]) for e in range(k)])  # moves into each state
    x = posteriors(rows, m).join(states(rows, m).select("i", "state"), "i")
    at = lambda a: F.get(a, F.col("state"))
    following = F.aggregate(F.zip_with(F.col("post"), at(to), lambda p, q: p * q), F.lit(0.0), lambda a, v: a + v)
    return x.select("date", at(name).alias("regime"), at(F.col("post")).alias("p"), at(stay).alias("stay"), following.alias("p_next"))


def ordered(returns: DataFrame) -> DataFrame:
    """block, i, date, r: the mean return of all assets."""
    return numbered(returns.groupBy("date").agg(F.avg("r").alias("r")), "date")


def market_regimes(returns: DataFrame, k: int = 2, steps: int = 100, tol: float = 0.01) -> DataFrame:
    """described() of the mean return of all assets under the model that fits it."""
    rows = ordered(returns)
    return staged(described(rows, fit(rows, k, steps, tol)[0]), "regimes")
