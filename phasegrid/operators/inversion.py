"""Inversion for time series, linear rates and robust stacked rates.

A pixel's answer is a fixed matrix times its observations, and the matrix
depends only on which observations it has. Workers keep the matrix of each
pattern they meet and apply it to all pixels of a batch with that pattern; no
pixel is shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.functions import kernels
from phasegrid.model import Network
from phasegrid.operators.network import PATTERNS, epochs, intervals, spanning_tree


def velocities(stack: DataFrame, network: Network, *, method: int = 2, least: int = 3, vcm=None, smooth_order: int = 1, smooth_factor: float = -1.0) -> DataFrame:
    """stack (row, col, phase and, if it has it, mst) with velocity: an array
    with one value for each interval between epochs. method 2: least norm; 1:
    smoothed by differences of smooth_order times 10^smooth_factor, weighted
    by vcm. Null where fewer than `least` observations are used, or an
    interval can't be had."""
    if method not in (1, 2):
        raise ValueError("method must be 1 or 2")
    if not 0 <= least <= 1000:
        raise ValueError("the least number of observations must be from 0 to 1000")
    import numpy as np

    index, spans = network.index(), np.array(network.spans())
    matrix = kernels.design([index[i.first] for i in network.ifgs], [index[i.second] for i in network.ifgs], np.diff(spans))
    one_tree = spanning_tree(network).is_tree
    weights = np.eye(len(matrix)) if vcm is None else np.asarray(vcm, float)
    known: dict = {}

    def operator(use):
        key = use.tobytes()
        if key not in known:
            if len(known) >= PATTERNS:
                known.clear()
            rows, found = np.flatnonzero(use), None
            if len(rows) >= max(least, 1):
                b = matrix[rows]
                found = kernels.svd_operator(b, one_tree) if method == 2 else kernels.laplacian_operator(b, one_tree, smooth_order, 10.0**smooth_factor, weights[np.ix_(rows, rows)])
            known[key] = None if found is None else (found[0], rows[found[1]], found[2])
        return known[key]

    def invert(phase, mst):
        import pyarrow as pa

        n, m = matrix.shape
        flat = phase.flatten()
        y = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
        use = ~np.isnan(y) & mst.flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(-1, n)
        out = np.full((len(y), m), np.nan)
        patterns, which = np.unique(use, axis=0, return_inverse=True)
        for p, own in enumerate(patterns):
            found = operator(own)
            if found is not None:
                at = np.flatnonzero(which.ravel() == p)
                out[np.ix_(at, np.flatnonzero(found[0]))] = y[np.ix_(at, found[1])] @ found[2].T
        ends = np.arange(0, m * (len(y) + 1), m, dtype=np.int32)
        # Exact zeros stand for intervals without information.
        values = out.ravel()
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, mask=np.isnan(values) | (values == 0)))

    mst = F.col("mst") if "mst" in stack.columns else F.transform("phase", lambda x: x.isNotNull())
    return stack.withColumn("velocity", F.arrow_udf(invert, "array<double>")("phase", mst))


def increments(velocity: DataFrame, network: Network) -> DataFrame:
    """(row, col, epoch_idx, velocity, tsincr, tscuml) for epochs from 1 on.
    A missing increment makes the cumulative sum missing from there on."""
    spans = network.spans()
    steps = F.array(*[F.lit(b - a) for a, b in zip(spans, spans[1:])])
    rows = velocity.select("row", "col", F.posexplode("velocity").alias("at", "velocity"))
    rows = rows.select("row", "col", (F.col("at") + 1).alias("epoch_idx"), "velocity", (F.col("velocity") * F.get(steps, F.col("at"))).alias("tsincr"))
    return rows.withColumn("tscuml", cumulated("tsincr"))


def cumulated(value: str, order: str = "epoch_idx"):
    """The running sum of a pixel's values; null from the first null on."""
    w = Window.partitionBy("row", "col").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.max(F.col(value).isNull()).over(w), None).otherwise(F.sum(value).over(w))


def with_zero_epoch(series: DataFrame, value: str = "tscuml") -> DataFrame:
    """The cumulative series with a zero at the first epoch."""
    start = series.select("row", "col").distinct().select("row", "col", F.lit(0).alias("epoch_idx"), F.lit(0.0).alias(value))
    return start.unionByName(series.select("row", "col", "epoch_idx", value))


def linear_rate(series: DataFrame, epoch: DataFrame, *, value: str = "tscuml", nsig: float = 1.0, by: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """rate, intercept, r2, error (times nsig) and samples of a line through
    each pixel's series; null for fewer than two values. Built-in regression
    aggregates, so only sums are shuffled."""
    rows = series.join(F.broadcast(epoch.select("epoch_idx", "span")), "epoch_idx")
    y, t = F.col(value), F.col("span")
    sums = rows.groupBy(*by).agg(F.regr_slope(y, t).alias("rate"), F.regr_intercept(y, t).alias("intercept"), F.regr_r2(y, t).alias("r2"), F.regr_sxx(y, t).alias("sxx"), F.regr_syy(y, t).alias("syy"), F.regr_sxy(y, t).alias("sxy"), F.regr_count(y, t).alias("n"))
    left = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    error = F.when(F.col("n") > 2, F.sqrt(left / F.col("sxx") / (F.col("n") - 2)) * nsig).when(F.col("n") == 2, F.lit(0.0))
    r2 = F.when(F.col("syy") == 0, F.lit(0.0)).otherwise(F.col("r2"))
    ok = F.col("n") > 1
    return sums.select(*by, *[F.when(ok, c).alias(n) for n, c in (("rate", F.col("rate")), ("intercept", F.col("intercept")), ("r2", r2), ("error", error), ("samples", F.col("n")))])


def stacked_rate(stack: DataFrame, network: Network, vcm, *, nsig: float = 2.0, least: int = 3, error_nsig: float = 1.0) -> DataFrame:
    """stack's pixels with rate, error (times error_nsig) and samples of the
    robust weighted fit. Missing observations never take part."""
    import numpy as np

    span, weights = np.array([i.years for i in network.ifgs]), np.asarray(vcm, float)

    def fit(phase, mst):
        import pyarrow as pa

        y = phase.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(span))
        use = ~np.isnan(y) & mst.flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(-1, len(span))
        rows = []
        for own, which in zip(y, use):
            at = np.flatnonzero(which)
            rate, error, n = kernels.robust_rate(own[at], span[at], weights[np.ix_(at, at)], nsig, least)
            bad = np.isnan(rate)
            rows.append({"rate": None if bad else float(rate), "error": None if bad else float(error) * error_nsig, "samples": n})
        return pa.array(rows, pa.struct([("rate", pa.float64()), ("error", pa.float64()), ("samples", pa.int32())]))

    mst = F.col("mst") if "mst" in stack.columns else F.transform("phase", lambda x: x.isNotNull())
    return stack.withColumn("fit", F.arrow_udf(fit, "rate double, error double, samples int")("phase", mst)).select("row", "col", "fit.*")


def weighted_rate(phase: DataFrame, ifgs: DataFrame) -> DataFrame:
    """The first round of the stacked rate for independent interferograms: a
    weighted line through the origin, by sums. ifgs: time_span, variance."""
    near = phase.filter(F.col("phase").isNotNull()).join(F.broadcast(ifgs.select("ifg_id", "time_span", "variance")), "ifg_id")
    sums = near.groupBy("row", "col").agg(F.sum(F.col("time_span") * F.col("phase") / F.col("variance")).alias("sy"), F.sum(F.col("time_span") * F.col("time_span") / F.col("variance")).alias("ss"), F.count(F.lit(1)).cast("int").alias("samples"))
    return sums.select("row", "col", (F.col("sy") / F.col("ss")).alias("rate"), (1 / F.sqrt("ss")).alias("error"), "samples")


MODELS = {
    "linear": lambda t: [F.lit(1.0), t],
    "quadratic": lambda t: [F.lit(1.0), t, t * t],
    "annual_linear": lambda t: [F.lit(1.0), t, F.sin(2 * F.pi() * t), F.cos(2 * F.pi() * t)],
    "annual_quadratic": lambda t: [F.lit(1.0), t, t * t, F.sin(2 * F.pi() * t), F.cos(2 * F.pi() * t)],
}


def trend(series: DataFrame, epoch: DataFrame, name: str, *, value: str = "tscuml", by: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Coefficients of a trend model of each pixel, by normal equations: sums
    in one aggregate, then one small solve for each pixel. Null where there
    are fewer values than coefficients."""
    import numpy as np

    terms = MODELS[name](F.col("span"))
    k = len(terms)
    rows = series.filter(F.col(value).isNotNull()).join(F.broadcast(epoch.select("epoch_idx", "span")), "epoch_idx")
    # Columns of the model are few; products of them are summed by pixel.
    products = [F.sum(a * b) for i, a in enumerate(terms) for b in terms[: i + 1]] + [F.sum(a * F.col(value)) for a in terms]
    sums = rows.groupBy(*by).agg(F.array(*products).alias("sums"), F.count(F.lit(1)).alias("n"))

    def solve(column, n):
        import pyarrow as pa

        out = []
        for x, m in zip(column.to_pylist(), n.to_pylist()):
            if m < k:
                out.append(None)
                continue
            a = np.zeros((k, k))
            a[np.tril_indices(k)] = x[: k * (k + 1) // 2]
            a = a + np.tril(a, -1).T
            size = np.sqrt(np.diag(a))
            size[size == 0] = 1
            out.append((np.linalg.pinv(a / np.outer(size, size), hermitian=True) @ (np.array(x[-k:]) / size) / size).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return sums.select(*by, F.arrow_udf(solve, "array<double>")("sums", "n").alias("coefficients"))


def epoch_table(ifgs: DataFrame) -> DataFrame:
    """Epochs with their increments."""
    own = epochs(ifgs)
    return own.join(intervals(own).select("epoch_idx", "increment"), "epoch_idx")
