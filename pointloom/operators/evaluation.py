"""Matching against truth, reports, sweeps, and statistics of chains."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..exprs import phi_cdf
from .clusters import emitters
from .neighbors import match_positions, nearest


def match_metrics(matched: DataFrame, n_estimates: DataFrame, n_truth: DataFrame) -> DataFrame:
    """n_matched, jaccard, precision, recall, f1, rmse."""
    m = matched.agg(F.count("*").alias("m"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"))
    c = m.crossJoin(n_estimates.agg(F.count("*").alias("e"))).crossJoin(n_truth.agg(F.count("*").alias("t")))
    k, e, t = F.col("m"), F.col("e"), F.col("t")
    return c.select(k.alias("n_matched"), (k / (e + t - k)).alias("jaccard"), (k / e).alias("precision"), (k / t).alias("recall"), (2.0 * k / (e + t)).alias("f1"), "rmse")


def mahalanobis(matched: DataFrame, est: DataFrame, truth: DataFrame) -> DataFrame:
    """Squared distance of matched pairs in units of the estimate's covariance."""
    j = matched.join(est, "emitter_id").join(truth.select("true_id", F.col("x").alias("tx"), F.col("y").alias("ty")), "true_id")
    a, b, c = F.col("sigma_x") ** 2, F.col("sigma_xy"), F.col("sigma_y") ** 2
    det, dx, dy = a * c - b * b, F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    return j.filter(det > 0).select("emitter_id", "true_id", ((c * dx * dx - 2.0 * b * dx * dy + a * dy * dy) / det).alias("d2"))


def calibration(d2: DataFrame) -> DataFrame:
    """Scale of the sigmas, and the share of pairs within 1, 2 and 3 sigmas (0.39, 0.86 and 0.99 are expected)."""
    share = lambda k: F.avg(F.when(F.col("d2") <= k, 1.0).otherwise(0.0))
    cols = [F.sqrt(F.avg("d2") / 2.0).alias("scale")]
    for k in (1, 4, 9):
        cols += [share(k).alias(f"cover_{k}"), F.lit(1.0 - math.exp(-k / 2)).alias(f"expect_{k}")]
    return d2.agg(*cols)


def oracle_rmse(locs: DataFrame, truth: DataFrame, threshold: float = 0.020) -> DataFrame:
    """Error of the best possible grouping: by the rows' true ids. Null without ids."""
    e = emitters(locs.filter(F.col("track_id") > 0), ["track_id"]).withColumnRenamed("track_id", "emitter_id")
    return match_positions(e, truth, threshold).agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"))


def empirical_counts(locs: DataFrame) -> DataFrame:
    return locs.filter(F.col("track_id") != 0).groupBy("track_id").agg(F.count("*").alias("n"))


def partition_k(em: DataFrame) -> DataFrame:
    """Median, least and most emitters per partition."""
    return em.groupBy("partition_id").agg(F.count("*").alias("k")).agg(F.median("k").alias("median"), F.min("k").alias("least"), F.max("k").alias("most"))


def report(locs: DataFrame, em: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """One record: counts, ratio, neighbour distances, emitters per partition, and the match with truth if there is one."""
    nn = nearest(em, em.withColumnRenamed("emitter_id", "_other"), "emitter_id", "_other", 1, skip_self=True)
    out = locs.agg(F.count("*").alias("n_locs")).crossJoin(em.agg(F.count("*").alias("n_emitters")))
    out = out.withColumn("ratio", F.col("n_locs") / F.col("n_emitters")).crossJoin(nn.agg(F.median("d").alias("nn_median")))
    out = out.crossJoin(partition_k(em).withColumnsRenamed({"median": "k_median", "least": "k_least", "most": "k_most"}))
    if truth is not None:
        out = out.crossJoin(match_metrics(match_positions(em, truth), em, truth))
    return out


def sweep_curves(trials: DataFrame) -> DataFrame:
    """Per (n, mu, sep): recovery rate and its error, mean ratio of rmse to the oracle's over usable trials, and the
    rates of the numbers found without a hierarchy (``k_flat``) and from counts alone (``k_count``)."""
    ok = F.col("rmse").isNotNull() & ~F.isnan("rmse") & (F.col("oracle") > 0)
    rate = lambda k: F.avg(F.when(F.col(k) == F.col("n"), 1.0).otherwise(0.0))
    g = trials.groupBy("n", "mu", "sep").agg(rate("k").alias("rate"), rate("k_flat").alias("rate_flat"), rate("k_count").alias("rate_count"), F.count("*").alias("trials"), F.avg(F.when(ok, F.col("rmse") / F.col("oracle"))).alias("rmse_ratio"))
    return g.withColumn("rate_err", F.sqrt(F.col("rate") * (1.0 - F.col("rate")) / F.col("trials")))


#: Fixed values of the rules: share of the counts' rate, rate when resolved and its separation, separation at which
#: positions help, largest drop, scale of the sigmas, error against the oracle's.
FLOOR, RESOLVED, FAR, HELPED, DROP, SCALE, ERROR = 0.85, 0.90, 10.0, 5.0, 0.05, (0.7, 1.3), 1.3


def sweep_scorecard(curves: DataFrame, trials: DataFrame) -> DataFrame:
    """Six rules on the curves and on the trials' squared distances ``d2`` in units of their covariances: rule, passed.

    A rule without a cell that it speaks of passes; without any distance, the calibration fails.
    """
    cell = Window.partitionBy("n", "mu")
    at = lambda sep: F.max(F.when(F.col("sep") == sep, F.col("rate"))).over(cell)
    c = curves.withColumns({"before": F.lag("rate").over(cell.orderBy("sep")), "touching": at(0.0), "apart": at(HELPED)})
    every = lambda cond: F.coalesce(F.min(F.coalesce(cond, F.lit(True))), F.lit(True))
    rules = {
        "floor against counts": every((F.col("rate_count") <= 0) | (F.col("rate_flat") >= FLOOR * F.col("rate_count"))),
        "resolved pairs are recovered": every((F.col("sep") != FAR) | (F.col("rate") >= RESOLVED)),
        "positions help": every(F.col("apart") > F.col("touching")),
        "rates don't drop": every(F.col("rate") >= F.col("before") - DROP),
        "errors are near the oracle's": every((F.col("sep") < HELPED) | F.isnan("rmse_ratio") | (F.col("rmse_ratio") <= ERROR)),
    }
    one = c.agg(*[v.alias(f"r{i}") for i, v in enumerate(rules.values())])
    scale = F.sqrt(F.avg(F.when(~F.isnan("d2"), F.col("d2"))) / 2.0)
    one = one.crossJoin(trials.agg(F.coalesce(scale.between(*SCALE), F.lit(False)).alias("scale")))
    found = [F.struct(F.lit(k).alias("rule"), F.col(f"r{i}").alias("passed")) for i, k in enumerate(rules)]
    return one.select(F.explode(F.array(*found, F.struct(F.lit("sigmas are calibrated").alias("rule"), F.col("scale").alias("passed")))).alias("s")).select("s.*")


def throughput(runs: DataFrame) -> DataFrame:
    """Median seconds and rows a second by number of rows, from a table of timings."""
    return runs.groupBy("rows", "partitions").agg(F.median("seconds").alias("seconds")).withColumn("rows_per_s", F.col("rows") / F.col("seconds"))


CHAIN = ["partition_id", "chain_id"]


#: Values of chains that are worked on at a time.
ENTRIES = 1 << 20


def _chains(trace: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, c: each chain's iterations and values, in order; a chain has few rows beside the number of chains."""
    return trace.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("iter", F.col(value).cast("double").alias("x")))).alias("c"))


def _rho(x: np.ndarray, at: np.ndarray, known: np.ndarray, top: int) -> np.ndarray:
    """Autocorrelations at lags 0 to top of chains of one length (chains x rows): sums over rows that are lag iterations
    apart, which the chain's length and variance divide; ones for a chain that doesn't move."""
    n = x.shape[1]
    with np.errstate(all="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore")  # a chain without values
        d = x - np.nanmean(x, 1, keepdims=True)
        v, still = np.nanmean(d * d, 1), np.nanmax(x, 1) == np.nanmin(x, 1)
    d = np.where(np.isnan(d) | ~known, 0.0, d)
    sums = np.stack([(d[:, : n - k] * d[:, k:]).sum(1) for k in range(top + 1)], 1)
    for c in np.flatnonzero(~(known.all(1) & (at == at[:, :1] + np.arange(n)).all(1))):  # with gaps or twins
        u, inv = np.unique(at[c][known[c]], return_inverse=True)
        s = np.bincount(inv, d[c][known[c]], len(u))
        for k in range(top + 1):
            to = np.minimum(np.searchsorted(u, u + k), max(0, len(u) - 1))
            sums[c, k] = (s * np.where(u[to] == u + k, s[to], 0.0)).sum() if len(u) else 0.0
    with np.errstate(all="ignore"):
        return np.where(still[:, None], 1.0, sums / (n * v)[:, None])


def _per_chain(chains: DataFrame, by: list[str], work: Callable[[np.ndarray, int], pa.Array], most: int, share: int, kind: str) -> DataFrame:
    """by, v: what ``work`` makes of the autocorrelations of chains of one length."""
    schema = ", ".join([*[f"`{c}` {chains.schema[c].dataType.simpleString()}" for c in by], f"v {kind}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column("c")
            size, flat = c.value_lengths().to_numpy(), c.flatten()
            start = np.cumsum(size) - size
            it, x = flat.field("iter"), flat.field("x").to_numpy(zero_copy_only=False)
            known, at = pc.is_valid(it).to_numpy(zero_copy_only=False), pc.fill_null(it.cast(pa.int64()), 0).to_numpy()
            for n in np.unique(size).tolist():
                alike, step = np.flatnonzero(size == n), max(1, ENTRIES // n)
                for lo in range(0, len(alike), step):
                    own = alike[lo : lo + step]
                    k = start[own][:, None] + np.arange(n)
                    found = work(_rho(x[k], at[k], known[k], min(n // share, most)), n)
                    yield pa.RecordBatch.from_arrays([*[b.column(g).take(pa.array(own)) for g in by], found], names=[*by, "v"])

    return chains.select(*by, "c").mapInArrow(run, schema)


def autocorrelation(trace: DataFrame, by: list[str], value: str, most: int = 500, share: int = 4) -> DataFrame:
    """lag, rho for lags 0 to min(n div share, most) of each chain; all ones for a chain that doesn't move."""

    def work(rho: np.ndarray, n: int) -> pa.Array:
        return pa.array(list(rho), pa.list_(pa.float64()))

    r = _per_chain(_chains(trace.dropna(subset=by), by, value), by, work, most, share, "array<double>")
    return r.select(*by, F.posexplode("v").alias("lag", "rho"))


def _ess(chains: DataFrame, by: list[str]) -> DataFrame:
    def work(rho: np.ndarray, n: int) -> pa.Array:
        if n < 4:
            return pa.array(np.full(len(rho), float(n)))
        m = (rho.shape[1] - 1) // 2
        s = np.round(rho[:, 1 : 2 * m : 2] + rho[:, 2 : 2 * m + 1 : 2], 12)
        kept = np.where(np.minimum.accumulate(s, 1) >= 0, s, 0.0).sum(1) if m else np.zeros(len(rho))
        return pa.array(np.maximum(1.0, np.minimum(float(n), n / (1.0 + 2.0 * kept))))

    return _per_chain(chains, by, work, 1 << 30, 2, "double").withColumnRenamed("v", "ess")


def ess(trace: DataFrame, by: list[str], value: str) -> DataFrame:
    """Effective sample size n / tau, 1 to n: tau is 1 and twice the autocorrelations of lags 1 + 2, 3 + 4, ... up to
    half of n, as far as no such sum is negative. A chain that doesn't move is worth about one row; one of fewer than
    four rows, its rows."""
    return _ess(_chains(trace, by, value), by)


def split_rhat(trace: DataFrame, by: list[str], value: str) -> DataFrame:
    """Split R-hat over chains: each is halved. 1 if nothing varies, infinite if only the halves' means do."""
    n = trace.groupBy(*by, "chain_id").agg(F.count("*").alias("_n"), F.min("iter").alias("_lo"))
    half = trace.join(n, [*by, "chain_id"])
    rank = F.row_number().over(Window.partitionBy(*by, "chain_id").orderBy("iter"))
    half = half.withColumn("_r", rank).withColumn("_h", F.floor(F.col("_n") / 2)).filter(F.col("_r") <= 2 * F.col("_h")).withColumn("_half", F.col("_r") > F.col("_h"))
    m = half.groupBy(*by, "chain_id", "_half").agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count("*").alias("h"))
    g = m.groupBy(*by).agg(F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.avg("h").alias("h"))
    total = F.col("w") * (F.col("h") - 1) / F.col("h") + F.col("b")
    return g.select(*by, F.when(F.col("w") > 0, F.sqrt(total / F.col("w"))).when(F.coalesce("b", F.lit(0.0)) > 0, F.lit(float("inf"))).otherwise(1.0).alias("rhat"))


def indicator_ess(trace: DataFrame, by: list[str], reach: int = 2) -> DataFrame:
    """Effective sample size of [K = k] for k around the mode (the smallest of equal modes)."""
    mode = trace.groupBy("k").agg(F.count("*").alias("c")).agg(F.max_by("k", F.struct("c", -F.col("k"))).alias("mode"))
    ks = mode.select(F.explode(F.sequence(F.col("mode") - reach, F.col("mode") + reach)).alias("value"))
    # a chain is gathered once, and its indicators are made of that
    hit = F.transform("c", lambda c: F.struct(c["iter"].alias("iter"), F.when(c["x"] == F.col("value"), 1.0).otherwise(0.0).alias("x")))
    return _ess(_chains(trace, by, "k").crossJoin(F.broadcast(ks)).select(*by, "value", hit.alias("c")), [*by, "value"])


def mixing_report(trace: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """partition_id, chain_id (null for all chains), statistic, value: mean, variance and effective sizes of K and of
    [K = k] around the mode for each chain, and the split R-hat of a partition's chains.

    With ``moves`` (partition_id, chain_id, move, accepted, total) also each chain's acceptance of each move, summed
    over its rows; 0 where it was never tried. Rows without a move are left out.
    """
    s = trace.groupBy(*CHAIN).agg(F.avg("k").alias("mean"), F.var_samp("k").alias("variance"))
    rows = [s.select(*CHAIN, F.lit(c).alias("statistic"), F.col(c).cast("double").alias("value")) for c in ("mean", "variance")]
    rows.append(ess(trace, CHAIN, "k").select(*CHAIN, F.lit("ess").alias("statistic"), F.col("ess").alias("value")))
    rows.append(indicator_ess(trace, CHAIN).select(*CHAIN, F.concat(F.lit("ess of k = "), F.col("value").cast("string")).alias("statistic"), F.col("ess").alias("value")))
    rows.append(split_rhat(trace, ["partition_id"], "k").select("partition_id", F.lit(None).cast("int").alias("chain_id"), F.lit("rhat").alias("statistic"), F.col("rhat").alias("value")))
    if moves is not None:
        sums = moves.filter("move is not null").groupBy(*CHAIN, "move").agg(F.sum("accepted").alias("accepted"), F.sum("total").alias("total"))
        rate = F.when(F.col("total") > 0, F.coalesce(F.col("accepted"), F.lit(0)) / F.col("total")).otherwise(0.0)
        rows.append(sums.select(*CHAIN, F.concat(F.lit("acceptance of "), F.col("move")).alias("statistic"), rate.alias("value")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def k_marginal_test(trace: DataFrame, given: DataFrame, alpha: float = 0.05, min_ess: float = 30.0, min_expected: float = 5.0) -> DataFrame:
    """Does each K come up as often as a given probability says?

    z with the effective sample size (all rows where the indicator doesn't vary), two-sided p, Bonferroni over a
    partition's testable K. A K with a smaller effective size, or with fewer effective counts expected for it or for
    the others, is inconclusive; one of a probability under 1e-6 is left out.
    """
    by = ["partition_id"]
    known = given.filter("prob >= 1e-6").select(F.col("k").alias("value"), "prob")
    t = trace.crossJoin(F.broadcast(known)).withColumn("hit", F.when(F.col("k") == F.col("value"), 1.0).otherwise(0.0))
    varies = t.groupBy(*CHAIN, "value").agg((F.min("hit") != F.max("hit")).alias("varies"), F.count("*").alias("n"))
    e = ess(t, [*CHAIN, "value"], "hit").join(varies, [*CHAIN, "value"])
    e = e.groupBy(*by, "value").agg(F.sum(F.when(F.col("varies"), F.col("ess")).otherwise(F.col("n").cast("double"))).alias("ess"))
    f = t.groupBy(*by, "value").agg(F.avg("hit").alias("freq"), F.first("prob").alias("prob"))
    few = (F.col("ess") < min_ess) | (F.col("ess") * F.least(F.col("prob"), 1.0 - F.col("prob")) < min_expected)
    z = (F.col("freq") - F.col("prob")) / F.sqrt(F.col("prob") * (1.0 - F.col("prob")) / F.col("ess"))
    j = f.join(e, [*by, "value"]).withColumn("z", F.when(~few, z)).withColumn("p", 2.0 * (1.0 - phi_cdf(F.abs(F.col("z")))))
    j = j.withColumn("adjusted", F.least(F.lit(1.0), F.count("z").over(Window.partitionBy(*by)) * F.col("p")))
    verdict = F.when(F.col("z").isNull(), "inconclusive").when(F.col("adjusted") < alpha, "fail").otherwise("pass")
    return j.select(*by, F.col("value").alias("k"), "freq", "prob", "ess", "z", "p", "adjusted", verdict.alias("verdict"))


def k_marginal_verdict(tests: DataFrame) -> DataFrame:
    """One row for each partition of ``k_marginal_test``: how many K were tested, inconclusive and rejected, and the
    verdict: inconclusive without a testable K, fail with a rejected one, else pass."""
    of = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    c = tests.groupBy("partition_id").agg(F.count("z").alias("n_tested"), of("inconclusive").alias("n_inconclusive"), of("fail").alias("n_rejected"))
    return c.withColumn("verdict", F.when(F.col("n_tested") == 0, "inconclusive").when(F.col("n_rejected") > 0, "fail").otherwise("pass"))


def canonical_labels(samples: DataFrame, by: list[str]) -> DataFrame:
    """Clusters of each sample renamed 1, 2, ... in the order of their first rows."""
    first = samples.groupBy(*by, "cluster").agg(F.min("loc_id").alias("_f"))
    named = first.withColumn("label", F.row_number().over(Window.partitionBy(*by).orderBy("_f"))).drop("_f")
    return samples.join(named, [*by, "cluster"]).select(*by, "loc_id", "label")


def labelling_frequencies(labels: DataFrame, by: list[str], sample: list[str]) -> DataFrame:
    """How often each labelling is visited: its key is the labels in the order of rows."""
    key = labels.groupBy(*by, *sample).agg(F.sort_array(F.collect_list(F.struct("loc_id", "label"))).alias("s"), F.max("label").alias("k"))
    key = key.select(*by, "k", F.array_join(F.transform("s", lambda s: s["label"].cast("string")), ",").alias("labelling"))
    return key.groupBy(*by, "k", "labelling").agg(F.count("*").alias("n"))


def conditional_tv(exact: DataFrame, empirical: DataFrame, by: list[str], mass: float = 0.05) -> DataFrame:
    """Total variation inside each K of two tables (k, labelling, p), for K with enough exact mass."""
    e, f = exact.select(*by, "k", "labelling", F.col("p").alias("pe")), empirical.select(*by, "k", "labelling", F.col("p").alias("pf"))
    j = e.join(f, [*by, "k", "labelling"], "full").withColumns({"pe": F.coalesce("pe", F.lit(0.0)), "pf": F.coalesce("pf", F.lit(0.0))})
    t = j.groupBy(*by, "k").agg(F.sum("pe").alias("te"), F.sum("pf").alias("tf"))
    d = j.join(t, [*by, "k"]).filter(F.col("te") >= mass)
    share = F.when(F.col("tf") > 0, F.col("pf") / F.col("tf")).otherwise(0.0)
    return d.groupBy(*by, "k").agg((0.5 * F.sum(F.abs(F.col("pe") / F.col("te") - share))).alias("tv"))
