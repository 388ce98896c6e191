"""Calibration, strategies, thresholds, null shuffles and controls.

Sequential operators take ``keys``: each key is one strategy whose rows are in one order. Products, peaks,
sums and ranks are associative, so :mod:`afterbell.operators.scans` spreads a key of any size over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from afterbell.operators.asof import asof_forward
from afterbell.operators.scans import drawdown, numbered, ranged, running, scan
from afterbell.sources.shared import written


def calibration(preds: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Equal-width bins (a, b], the first with 0; empty bins have n = 0. ``gap`` is |mean p - mean y|, ``ece`` its weighted mean."""
    clipped = F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0))
    number = F.greatest(F.lit(1), F.ceil(F.round(clipped * bins, 9))).cast("int")
    rows = preds.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(number.alias("bin"), clipped.alias("_p"), F.col(y).cast("double").alias("_y"))
    stats = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("_p").alias("mean_p"), F.avg("_y").alias("mean_y"))
    every = preds.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    out = every.join(stats, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("gap", F.abs(F.col("mean_p") - F.col("mean_y")))
    total = Window.partitionBy(F.lit(1))  # as many rows as bins
    return out.withColumn("ece", F.sum(F.coalesce(F.col("n") * F.col("gap"), F.lit(0.0))).over(total) / F.sum("n").over(total))


def classification_metrics(preds: DataFrame, p: str, y: str, by: Sequence[str], clip: float = 1e-6) -> DataFrame:
    """n, accuracy, balanced accuracy, Brier score, log loss and ROC-AUC (ties count half) by group.

    The AUC runs over distinct scores: counts by score are summed first, and the running count of
    negatives below a score is a two-level scan.
    """
    # two passes read them: what is behind them is computed once
    rows = written(preds.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(p).alias("_p"), F.col(y).cast("int").alias("_y")), "scores")
    q = F.least(F.greatest(F.col("_p"), F.lit(clip)), F.lit(1 - clip))
    hit = ((F.col("_p") >= 0.5).cast("int") == F.col("_y")).cast("double")
    plain = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(hit).alias("accuracy"),
        ((F.avg(F.when(F.col("_y") == 1, hit)) + F.avg(F.when(F.col("_y") == 0, hit))) / 2).alias("balanced_accuracy"),
        F.avg((F.col("_p") - F.col("_y")) ** 2).alias("brier"),
        F.avg(-F.when(F.col("_y") == 1, F.ln(q)).otherwise(F.ln(1 - q))).alias("log_loss"),
    )
    scores = rows.groupBy(*by, "_p").agg(F.sum("_y").alias("_pos"), F.sum(1 - F.col("_y")).alias("_neg"))
    area = (
        running(scores, by, ["_p"], {"_below": ("sum", F.col("_neg"))}, inclusive=False)
        .withColumn("_wins", F.col("_pos") * (F.col("_below") + F.col("_neg") / 2))
        .groupBy(*by)
        .agg(F.try_divide(F.sum("_wins"), F.sum("_pos").cast("double") * F.sum("_neg")).alias("roc_auc"))
    )
    return plain.join(area, list(by))


def positions(p: Column, long: Column, short: Column | None = None) -> Column:
    """1 at or above the long threshold, -1 at or below the short one if shorts are allowed; a missing p is 0."""
    out = F.when(p.isNull(), 0).when(p >= long, 1)
    return (out if short is None else out.when(p <= short, -1)).otherwise(0)


def strategy(preds: DataFrame, p: str, ret: str, keys: list[str], order: list[str], long: float = 0.6, shorts: bool = True, cost_bps: float = 10.0) -> DataFrame:
    """Every trade with gross, net, equity, peak and drawdown. ret is a log return; cost is charged once per trade."""
    side = positions(F.col(p), F.lit(long), F.lit(1 - long) if shorts else None)
    rows = preds.withColumn("position", side).withColumn("gross", F.expm1(ret))
    rows = rows.withColumn("net", F.col("position") * F.col("gross") - cost_bps / 1e4).where((F.col("position") != 0) & F.col("net").isNotNull())
    return drawdown(rows, "net", keys, order)


def strategy_summary(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trades, means, hit rate, event Sharpe (mean / deviation * sqrt n) and worst drawdown."""
    n, mean, std = F.count("*"), F.avg("net"), F.stddev_samp("net")
    return trades.groupBy(*keys).agg(
        n.alias("trades"), F.avg("gross").alias("mean_gross"), mean.alias("mean_net"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"),
        F.when(n > 1, F.try_divide(mean, std) * F.sqrt(n)).alias("event_sharpe"), F.min("drawdown").alias("max_drawdown"),
    )


def cost_grid(preds: DataFrame, p: str, ret: str, keys: list[str], order: list[str], costs: Sequence[float] = (5, 25, 50, 100), long: float = 0.6, shorts: bool = True) -> DataFrame:
    """Summary of the strategy at each all-in cost; costs are columns of one scan, not copies of the rows."""
    rows = preds.withColumn("position", positions(F.col(p), F.lit(long), F.lit(1 - long) if shorts else None)).where("position != 0")
    rows = ranged(rows.withColumn("gross", F.expm1(ret)).where("gross is not null").select(*dict.fromkeys([*keys, *order]), "position", "gross"), keys, order)
    net = [F.col("position") * F.col("gross") - float(c) / 1e4 for c in costs]
    rows = written(scan(rows, keys, order, {f"_equity{i}": ("product", 1 + n) for i, n in enumerate(net)}), "equity")
    rows = scan(rows, keys, order, {f"_peak{i}": ("max", F.col(f"_equity{i}")) for i in range(len(net))})
    each = [
        F.struct(F.lit(float(c)).alias("cost_bps"), n.alias("net"), (F.col(f"_equity{i}") / F.greatest(F.col(f"_peak{i}"), F.lit(1.0)) - 1).alias("drawdown"))
        for i, (c, n) in enumerate(zip(costs, net, strict=True))
    ]
    return strategy_summary(rows.select(*keys, "gross", F.explode(F.array(*each)).alias("c")).select(*keys, "gross", "c.*"), [*keys, "cost_bps"])


def nested_thresholds(
    preds: DataFrame, p: str, ret: str, keys: list[str], order: list[str], candidates: Sequence[float] = (0.5, 0.55, 0.6, 0.65, 0.7), default: float = 0.6,
    least_prior: int = 30, cost_bps: float = 10.0, shorts: bool = True,
) -> DataFrame:
    """For each row the candidate threshold that did best on the rows before it.

    Best is the largest mean net return, then more trades, then the lower threshold. Fewer than
    ``least_prior`` rows with a score before, or no trades, give the default. Running sums per
    candidate replace the simulation of every prefix; candidates are columns of one scan, not copies of the rows.
    """
    values = {"_prior": ("count", F.col(p))}
    for i, t in enumerate(candidates):
        side = positions(F.col(p), F.lit(float(t)), F.lit(1 - float(t)) if shorts else None)
        net = F.when(side != 0, side * F.expm1(ret) - cost_bps / 1e4)
        values |= {f"_n{i}": ("count", net), f"_sum{i}": ("sum", F.coalesce(net, F.lit(0.0)))}
    rows = running(preds.select(*dict.fromkeys([*keys, *order, p, ret])), keys, order, values, inclusive=False)
    each = F.array(*[F.when(F.col(f"_n{i}") > 0, F.struct(F.round(F.col(f"_sum{i}") / F.col(f"_n{i}"), 12).alias("mean"), F.col(f"_n{i}").alias("n"), F.lit(-float(t)).alias("less"))) for i, t in enumerate(candidates)])
    best, enough = F.array_max(each), F.col("_prior") >= least_prior
    return rows.select(
        *keys, *[c for c in order if c not in keys], F.col("_prior").alias("prior_rows"),
        F.when(enough & best.isNotNull(), -best["less"]).otherwise(default).alias("threshold"),
        F.when(~enough, "default_not_enough_prior_rows").when(best.isNull(), "default_no_candidate_trades").otherwise("selected").alias("status"),
    )


#: Of the keyed permutation: rounds, steps of the walk, and the numbers of its round function.
ROUNDS, WALK = 4, 16
PRIME, TIMES, BY_KEY, BY_ROUND = 2_147_483_647, 48_271, 16_807, 69_621


def _mixed(x: np.ndarray, key: np.ndarray, turn: int) -> np.ndarray:
    """A number below :data:`PRIME` from a place, a key and a round; squared, so that it isn't linear."""
    t = (x * TIMES + key * BY_KEY + turn * BY_ROUND + 1) % PRIME
    return (t * t + x) % PRIME


def permuted(place: Column, key: Column, n: Column) -> Column:
    """The place (from 0) that a permutation of 0 to n - 1 drawn by ``key`` moves ``place`` to, worked out from the row alone.

    Places are pairs of a number below a, the root of n, and one below b, with a * b at least n; rounds add a mix of one to the other in turn,
    as in a Feistel network, so each round can be undone. Few pairs are places beyond n; from those the walk goes on, which
    again can be undone. It ends within a few steps, or the row fails. Worked out for a batch of rows at once.
    """
    once = F.pandas_udf(_permuted, "long").asNondeterministic()  # else a filter that a join infers works it out anew
    return once(place.cast("long"), key.cast("long"), n.cast("long"))


def _permuted(place: pd.Series, key: pd.Series, n: pd.Series) -> pd.Series:
    x, key, n = (c.to_numpy(np.int64) for c in (place, key, n))
    a = np.maximum(np.floor(np.sqrt(n)).astype(np.int64), 1)
    b = -(-n // a)
    x, left = x.copy(), np.arange(len(x))
    for _ in range(WALK):
        k, high = key[left], b[left]
        low, r = np.divmod(x[left], high)
        for turn in range(1, ROUNDS + 1):
            if turn % 2:
                low = (low + _mixed(r, k, turn)) % a[left]
            else:
                r = (r + _mixed(low, k, turn)) % high
        x[left] = low * high + r
        left = left[x[left] >= n[left]]
        if not len(left):
            return pd.Series(x)
    raise ValueError("the walk of a permutation did not end")


def null_shuffle(preds: DataFrame, p: str, ret: str, row_id: str, keys: list[str], iterations: int = 500, long: float = 0.6, shorts: bool = True, cost_bps: float = 10.0) -> DataFrame:
    """Mean net return of the strategy against shuffled returns: actual, mean and deviation of the nulls, z and one-sided p.

    Rows are numbered once (by id, in a scan). Iteration k gives a trading row the return of the row that :func:`permuted` names, so
    nothing is sorted for an iteration and rows that don't trade are never copied; returns wait in blocks of 1,024 by number, so
    each trade of an iteration is looked up in one block and summed where it is. Spark takes trades for as few as the file they come
    from, however many iterations are drawn, and would broadcast them; so joins are told to shuffle them, and their means, and to hash the other side.
    """
    rows = preds.where(F.col(ret).isNotNull()).withColumn("_side", positions(F.col(p), F.lit(long), F.lit(1 - long) if shorts else None))
    rows = rows.select(*keys, row_id, "_side", F.expm1(ret).alias("_g"))
    net = F.avg(F.when(F.col("_side") != 0, F.col("_side") * F.col("_g") - cost_bps / 1e4))
    ranked = written(running(rows, keys, [row_id], {"_r": ("count", F.lit(1))}), "shuffle-rows")
    actual = ranked.groupBy(*keys).agg(F.count("*").alias("n"), net.alias("actual"))
    block = F.floor((F.col("_r") - 1) / 1024)
    values = ranked.groupBy(*keys, block.alias("_b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_g"))), lambda x: x["_g"]).alias("_gs"))
    n = int(preds.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, and much is drawn from each: dealt to that many tasks
    trades = ranked.where("_side <> 0").join(actual.select(*keys, "n"), keys).repartition(n, *keys, "_r")
    trades = trades.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    drawn = trades.select(*keys, "_k", "_side", permuted(F.col("_r") - 1, F.col("_k"), F.col("n")).alias("_to"))
    met = drawn.withColumn("_b", F.floor(F.col("_to") / 1024)).join(values.hint("shuffle_hash"), [*keys, "_b"])
    given = F.get("_gs", (F.col("_to") % 1024).cast("int"))
    nulls = met.groupBy(*keys, "_k").agg(F.avg(F.col("_side") * given - cost_bps / 1e4).alias("_null"))
    both = nulls.join(actual.hint("shuffle_hash"), keys)
    return both.groupBy(*keys, "n", "actual").agg(
        F.avg("_null").alias("null_mean"),
        F.stddev_samp("_null").alias("null_std"),
        F.try_divide(F.col("actual") - F.avg("_null"), F.stddev_samp("_null")).alias("z"),
        ((F.sum((F.round("_null", 12) >= F.round("actual", 12)).cast("int")) + 1) / (F.count("*") + 1)).alias("p_value"),
    )


def ring_peers(tickers: DataFrame) -> DataFrame:
    """Each ticker with the next one in sorted order, the last with the first: numbers from a scan, joined to their successors."""
    placed = written(numbered(tickers.distinct(), ["ticker"], "_k"), "ring")
    n = placed.agg(F.max("_k").alias("_n"))
    after = placed.select(F.col("ticker").alias("peer"), (F.col("_k") - 1).alias("_k"))
    ring = placed.join(F.broadcast(n)).withColumn("_k", F.col("_k") % F.col("_n"))  # one row
    return ring.join(after, "_k").select("ticker", "peer")


def peer_controls(events: DataFrame, peers: DataFrame) -> DataFrame:
    """Each event moved to its peer (peers that are the ticker itself are left out), marked as a control."""
    moved = events.join(peers, "ticker").where("peer <> ticker")
    return moved.select(F.concat_ws("__peer_", F.col("event_id").cast("string"), F.col("peer").cast("string")).alias("event_id"), F.col("peer").alias("ticker"), "event_time", F.lit("peer_control").alias("event_type"))


def free_days(bars: DataFrame, events: DataFrame, margin: int = 10) -> DataFrame:
    """Bars of days that are more than ``margin`` days from every event of their ticker.

    The distance to the nearest event on either side comes from one union and sort per ticker, not
    from a range join.
    """
    e = events.select("ticker", F.col("event_time").cast("date").alias("d"), F.lit(1).alias("_e"))
    both = bars.select("ticker", "d", F.lit(0).alias("_e")).unionByName(e)
    event = F.when(F.col("_e") == 1, F.col("d"))
    running = (Window.unboundedPreceding, Window.currentRow)
    before = F.last(event, ignorenulls=True).over(Window.partitionBy("ticker").orderBy("d").rangeBetween(*running))
    after = F.last(event, ignorenulls=True).over(Window.partitionBy("ticker").orderBy(F.desc("d")).rangeBetween(*running))
    near = F.least(F.date_diff("d", before), F.date_diff(after, "d"))
    return both.withColumn("_near", near).where((F.col("_e") == 0) & (F.col("_near").isNull() | (F.col("_near") > margin))).select("ticker", "d")


def random_placebos(events: DataFrame, free: DataFrame, seed: int = 42) -> DataFrame:
    """Each event at a free day of its ticker: events and days are ranked by hash and paired; events beyond the days start over."""
    day = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("ticker").cast("string"), F.col("d").cast("string")))
    days = free.withColumn("_r", F.row_number().over(Window.partitionBy("ticker").orderBy(day, "d")) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("ticker")))
    own = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("event_id").cast("string")))
    asked = events.withColumn("_k", F.row_number().over(Window.partitionBy("ticker").orderBy(own, "event_id")) - 1)
    sizes = days.groupBy("ticker").agg(F.max("_n").alias("_n"))
    asked = asked.join(sizes, "ticker").withColumn("_r", F.col("_k") % F.col("_n")).drop("_n")
    return asked.join(days.select("ticker", "_r", F.col("d").alias("placebo_day")), ["ticker", "_r"]).select(
        F.concat(F.col("event_id").cast("string"), F.lit("__placebo01")).alias("event_id"), "ticker", "placebo_day", F.lit("placebo").alias("event_type"), F.lit("non_event_control").alias("event_subtype")
    )


def chronological_split(df: DataFrame, keys: list[str], order: list[str], share: float = 0.7) -> DataFrame:
    """train for the first round-half-even(n * share) rows of a key, test for the rest."""
    w = Window.partitionBy(*keys)
    place = F.row_number().over(w.orderBy(*order))
    return df.withColumn("split", F.when(place <= F.bround(F.count("*").over(w) * F.lit(share)), "train").otherwise("test"))


def fit_logistic(x: np.ndarray, y: np.ndarray, strength: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Coefficients (intercept last) of a class-balanced, L2-regularised logistic model, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    w, ridge = np.zeros(x.shape[1]), strength * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (p - y)) + strength * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


Fit = Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray], np.ndarray]]


def logistic(x: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The standard model: from training rows to a function of probabilities."""
    w = fit_logistic(x, y)
    return lambda z: 1 / (1 + np.exp(-(z @ w[:-1] + w[-1])))


class Preparation:
    """Numbers: median-imputed and standardised; categories: missing is ``unknown``, one column for each seen one, unseen ones give none. Learned on training rows."""

    def __init__(self, x: np.ndarray, c: np.ndarray):
        self.middle = np.array([np.median(v[np.isfinite(v)]) if np.isfinite(v).any() else 0.0 for v in x.T])
        filled = self._filled(x)
        self.mean, spread = filled.mean(axis=0), filled.std(axis=0)
        self.spread = np.where(filled.max(axis=0) > filled.min(axis=0), spread, 1)  # of equal values it may be above 0 by rounding
        self.levels = [sorted(set(v)) for v in c.T]

    def _filled(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(x), x, self.middle)

    def __call__(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        z = (self._filled(x) - self.mean) / self.spread
        return np.hstack([z, *[(v[:, None] == np.array(levels, object)[None, :]).astype(float) for v, levels in zip(c.T, self.levels, strict=True)]])


#: Training rows times fits of one task, and the rows and fits that are worked on at a time.
PART_WORK, TILE_ROWS, TILE_FITS = 20_000_000, 2_048, 64


def walk_logistic(x: np.ndarray, c: np.ndarray, y: np.ndarray, sizes: np.ndarray, ends: np.ndarray, strength: float = 1.0, rounds: int = 30) -> np.ndarray:
    """What :class:`Preparation` and :func:`logistic`, learned on the first ``sizes[k]`` rows, give for rows ``ends[k, 0]`` to ``ends[k, 1]``, one after the other; many fits at once.

    All fits read the same columns: numbers in the units of all rows (0 where missing), marks of missing ones, marks of levels, and 1. What a fit's
    own median, mean and spread make of them is a matrix, so the sums of a Newton step are products of matrices over tiles of rows and fits, and
    the step is that of the single fit. A level without training rows has coefficient 0. Targets are 0 or 1. The few fits that don't settle,
    or whose spread is too small for sums of squares, are made one at a time.
    """
    n, d = x.shape
    known = np.isfinite(x)
    count = np.maximum(known.sum(axis=0), 1)
    filled = np.where(known, x, 0.0)
    middle = filled.sum(axis=0) / count
    unit = np.sqrt((np.where(known, x - middle, 0.0) ** 2).sum(axis=0) / count)
    unit = np.where(unit > 0, unit, 1.0)
    v = np.where(known, (filled - middle) / unit, 0.0)
    gaps = np.flatnonzero(~known.all(axis=0))
    marks = [(col[:, None] == np.array(sorted(set(col)), object)[None, :]).astype(float) for col in c.T]
    z = np.hstack([v, ~known[:, gaps], *marks, np.ones((n, 1))]).astype(float)
    width, levels = z.shape[1], z.shape[1] - d - len(gaps) - 1
    one, two = np.triu_indices(width)
    upto = lambda a: np.vstack([np.zeros((1, a.shape[1])), np.cumsum(a, axis=0)])[sizes]
    # of each fit: the median where something is missing, mean and spread
    fill = np.zeros((len(sizes), d))
    for j in gaps:
        own, held = v[known[:, j], j], np.concatenate(([0], np.cumsum(known[:, j])))[sizes]
        fill[:, j] = [np.median(own[:m]) if m else -middle[j] / unit[j] for m in held]
    missing = upto(~known)
    mean = (upto(v) + missing * fill) / sizes[:, None]
    variance = (upto(v * v) + missing * fill**2) / sizes[:, None] - mean**2
    varies = np.maximum.accumulate(np.where(known, v, -np.inf))[sizes - 1] > np.minimum.accumulate(np.where(known, v, np.inf))[sizes - 1]
    single = (varies & (variance < 1e-9)).any(axis=1)
    spread = np.where(varies, np.sqrt(np.maximum(variance, 1e-9)), 1.0)
    ones = np.concatenate(([0.0], np.cumsum(y)))[sizes]
    heavy = np.stack((sizes / (2 * np.maximum(1, sizes - ones)), sizes / (2 * np.maximum(1, ones))))  # weight of a row of each class
    kind = (y == 1).astype(int)
    out = []
    for at in range(0, len(sizes), TILE_FITS):
        here = slice(at, at + TILE_FITS)
        m, k = sizes[here], len(sizes[here])
        own = np.zeros((k, d + levels + 1, width))
        own[:, range(d), range(d)] = 1 / spread[here]
        own[:, gaps, range(d, d + len(gaps))] = (fill[here] / spread[here])[:, gaps]
        own[:, :d, -1] = -mean[here] / spread[here]
        own[:, range(d, d + levels + 1), range(d + len(gaps), width)] = 1
        w = np.zeros((k, d + levels + 1))
        for _ in range(rounds):
            to_rows = np.einsum("kpq,kp->qk", own, w)
            gradient, hessian = np.zeros((width, k)), np.zeros((len(one), k))
            for a in range(0, int(m.max()), TILE_ROWS):
                tile = z[a : min(a + TILE_ROWS, int(m.max()))]
                of = kind[a : a + len(tile)]
                p = 1 / (1 + np.exp(-np.clip(tile @ to_rows, -30, 30)))
                weight = heavy[:, here][of]
                if a + len(tile) > m.min():
                    weight = weight * (np.arange(a, a + len(tile))[:, None] < m)
                gradient += tile.T @ (weight * (p - of[:, None]))
                hessian += (tile[:, one] * tile[:, two]).T @ (weight * p * (1 - p))
            full = np.empty((k, width, width))
            full[:, one, two] = full[:, two, one] = hessian.T
            slope = np.einsum("kpq,qk->kp", own, gradient) + strength * w
            step = np.linalg.solve(own @ full @ own.transpose(0, 2, 1) + strength * np.eye(w.shape[1]), slope[:, :, None])[:, :, 0]
            w -= step
            if (settled := np.abs(step).max(axis=1) < 1e-9).all():
                break
        to_rows = np.einsum("kpq,kp->kq", own, w)
        for i, (first, last) in enumerate(ends[here]):
            if settled[i] and not single[at + i]:
                out.append(1 / (1 + np.exp(-(z[first:last] @ to_rows[i]))))
            else:
                prepare = Preparation(x[: m[i]], c[: m[i]])
                out.append(logistic(prepare(x[: m[i]], c[: m[i]]), y[: m[i]])(prepare(x[first:last], c[first:last])))
    return np.concatenate(out) if out else np.zeros(0)


def purged_walk_forward(
    df: DataFrame, key: str, at: str, row_id: str, features: list[str], y: str, least_train: int = 40, purge_days: int = 5, categorical: Sequence[str] = (), fit: Fit = logistic
) -> DataFrame:
    """Expanding model per key: each row is predicted from the rows more than ``purge_days`` before it.

    Rows of one day share a fit. :class:`Preparation` is learned on the training rows; ``fit`` makes a model of
    them, the standard one of many days at once (:func:`walk_logistic`). Too few training rows, or one class, give the baseline: the mean of the targets before.

    A key's days are dealt into parts of at most about :data:`PART_WORK` training rows times fits, each with all rows up to its last day, so keys
    are independent and a large one is worked on by many tasks. A task holds the rows of one key (a fit needs them together).
    """
    types, together = dict(df.dtypes), fit is logistic
    schema = f"{key} {types[key]}, {row_id} {types[row_id]}, train_n long, probability double, target double, status string"

    def result(own: pa.Table, n: Sequence[int], p: Sequence[float], status: Sequence[str]) -> pa.Table:
        columns = [own.column(key), own.column(row_id), pa.array(n, pa.int64()), pa.array(p, pa.float64(), from_pandas=True), own.column(y), pa.array(status, pa.string())]
        return pa.table(columns, names=[key, row_id, "train_n", "probability", "target", "status"])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_day", "ascending"), (row_id, "ascending")])
        column = lambda name: table.column(name).cast(pa.float64()).to_numpy()
        days, target = table.column("_day").to_numpy(), column(y)
        x = np.stack([column(f) for f in features], axis=1) if features else np.zeros((len(days), 0))
        c = np.empty((len(days), len(categorical)), object)
        for j, name in enumerate(categorical):
            c[:, j] = ["unknown" if v is None or v != v else str(v) for v in table.column(name).to_pylist()]
        asked = np.flatnonzero(table.column("_part").to_numpy() == table.column("_of").to_numpy())  # the days at the end
        if not len(asked):  # a day may reach past a whole part
            return result(table.slice(0, 0), [], [], [])
        every, first = np.unique(days[asked], return_index=True)
        first = first + asked[0]
        ends = np.stack((first, np.append(first[1:], len(days))), axis=1)
        sizes = np.searchsorted(days, every - purge_days)
        binary = np.isin(target, (0.0, 1.0)).all()
        before = np.concatenate(([0.0], np.cumsum(target)))
        if binary:
            mixed = (before[sizes] > 0) & (before[sizes] < sizes)
        else:
            mixed = np.array([len(np.unique(target[:m])) == 2 for m in sizes])
        status = np.where(sizes < least_train, "skipped_not_enough_train", np.where(mixed, "ok", "one_class"))
        length = ends[:, 1] - ends[:, 0]
        p = np.repeat(np.divide(before[first], first, out=np.full(len(first), np.nan), where=first > 0), length)
        fitted = (status == "ok") & (sizes > 0)
        if together and binary:
            p[np.repeat(fitted, length)] = walk_logistic(x, c, target, sizes[fitted], ends[fitted])
        else:
            for m, (a, b) in zip(sizes[fitted], ends[fitted], strict=True):
                prepare = Preparation(x[:m], c[:m])
                p[a - asked[0] : b - asked[0]] = fit(prepare(x[:m], c[:m]), target[:m])(prepare(x[a:b], c[a:b]))
        return result(table.slice(int(asked[0])), np.repeat(sizes, length), p, np.repeat(status, length))

    rows = df.where(F.col(at).isNotNull()).select(key, F.unix_date(F.col(at).cast("date")).alias("_day"), row_id, *features, *categorical, F.col(y).cast("double").alias(y))
    days = Window.partitionBy(key).orderBy("_day")
    # days so far times rows so far: equal within a day, and at least the work of the days so far
    rows = rows.withColumn("_part", F.floor(F.dense_rank().over(days).cast("long") * F.rank().over(days) / PART_WORK))
    rows = rows.withColumn("_last", F.max("_part").over(Window.partitionBy(key))).withColumn("_of", F.explode(F.sequence("_part", "_last")))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: parts stay spread over tasks
    return rows.repartition(n, key, "_of").groupBy(key, "_of").applyInArrow(run, schema)


def shifted_placebos(events: DataFrame, bars: DataFrame, shifts: Sequence[int] = (30, 60, 90, -30, -60, -90), margin: int = 10) -> DataFrame:
    """Each event moved by the next of the cycling shifts (per ticker, in id order), to the first bar from there on; days near an event are dropped."""
    k = F.row_number().over(Window.partitionBy("ticker").orderBy("event_id")) - 1
    days = F.element_at(F.array(*[F.lit(s) for s in shifts]), (k % len(shifts)).cast("int") + 1)
    probes = events.select("event_id", "ticker", "event_time").withColumn("_day", F.date_add(F.col("event_time").cast("date"), days))
    moved = asof_forward(probes, bars.select("ticker", F.col("d").alias("placebo_day")), ["ticker"], F.col("_day"), F.col("placebo_day"), ["placebo_day"]).where("placebo_day is not null")
    free = free_days(bars, events, margin).withColumnRenamed("d", "placebo_day")
    return moved.join(free, ["ticker", "placebo_day"], "left_semi").select(F.concat(F.col("event_id").cast("string"), F.lit("__placebo01")).alias("event_id"), "ticker", "placebo_day")


def research_backtest(preds: DataFrame, p: str, y: str, ret: str, keys: list[str], order: list[str], long: float = 0.6, cost_bps: float = 10.0) -> dict[str, DataFrame]:
    """The parts of a backtest report over scored events: metrics, calibration, trades, summary and cost grid."""
    preds = written(preds.select(*dict.fromkeys([*keys, *order, p, y, ret])), "backtest")  # every part reads them
    trades = strategy(preds, p, ret, keys, order, long, cost_bps=cost_bps)
    return {
        "metrics": classification_metrics(preds, p, y, keys),
        "calibration": calibration(preds, p, y),
        "trades": trades,
        "summary": strategy_summary(trades, keys),
        "costs": cost_grid(preds, p, ret, keys, order, long=long),
    }
