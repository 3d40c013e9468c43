"""Orbital ramps by normal equations.

A design matrix with a row for each pixel never exists. Its products with
itself and with the phase are sums over pixels, one aggregate with a row for
each interferogram; the small systems are solved on the driver, and the model
is a column expression on the way back.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.model import Grid, Network
from phasegrid.operators.network import spanning_tree

DEGREES = {"planar": ("x", "y"), "quadratic": ("xx", "yy", "xy", "x", "y"), "part_cubic": ("xyy", "xx", "yy", "xy", "x", "y")}


def terms(grid: Grid, degree: str, intercept: bool = True, scale: float = 1.0) -> list[Column]:
    """The model's terms at a pixel: products of its distances from the
    corner in metres (coordinates count from 1), and 1."""
    if scale < 1:
        raise ValueError("scale must be 1 or more")
    axis = {"x": (F.col("col") + 1) * F.lit(grid.x_size / scale), "y": (F.col("row") + 1) * F.lit(grid.y_size / scale)}
    out = [reduce(lambda a, b: a * b, [axis[c] for c in name]) for name in DEGREES[degree]]
    return out + [F.lit(1.0)] * intercept


def normal_equations(phase: DataFrame, parts: list[Column]) -> dict[int, tuple]:
    """For each interferogram, sums of products of terms, of terms and phase."""
    import numpy as np

    k = len(parts)
    valid = phase.filter(F.col("phase").isNotNull()).select("ifg_id", "phase", *[p.alias(f"t{i}") for i, p in enumerate(parts)])
    sums = [F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(F.col(f"t{i}") * F.col("phase")).alias(f"b{i}") for i in range(k)]
    out = {}
    for r in valid.groupBy("ifg_id").agg(*sums).collect():  # a row for each interferogram
        a = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                a[i, j] = a[j, i] = r[f"s{i}_{j}"]
        out[r["ifg_id"]] = a, np.array([r[f"b{i}"] for i in range(k)])
    return out


def solve(a, b):
    """Least squares of minimum norm from normal equations, columns scaled."""
    import numpy as np

    size = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    return np.linalg.pinv(a / np.outer(size, size), rcond=1e-12, hermitian=True) @ (b / size) / size


def model(phase: DataFrame, parts: list[Column], coefficients: dict[int, list[float]], offset: bool = False) -> DataFrame:
    """(ifg_id, row, col, phase, orbit): the model at each pixel; with offset,
    less the median of phase minus model."""
    rows = [(i, [float(x) for x in c]) for i, c in coefficients.items()]
    table = F.broadcast(phase.sparkSession.createDataFrame(rows, "ifg_id int, c array<double>"))
    value = reduce(add, [p * F.col("c")[i] for i, p in enumerate(parts)])
    out = phase.join(table, "ifg_id").select("ifg_id", "row", "col", "phase", value.alias("orbit"))
    if offset:
        shift = out.groupBy("ifg_id").agg(F.median(F.col("phase") - F.col("orbit")).alias("shift"))
        out = out.join(F.broadcast(shift), "ifg_id").withColumn("orbit", F.col("orbit") - F.col("shift")).drop("shift")
    return out


def corrected(fitted: DataFrame) -> DataFrame:
    return fitted.select("ifg_id", "row", "col", (F.col("phase") - F.col("orbit")).alias("phase"))


def independent(phase: DataFrame, grid: Grid, degree: str = "planar", *, intercept: bool = True, offset: bool = False, coarse: DataFrame | None = None, coarse_grid: Grid | None = None) -> DataFrame:
    """A ramp fitted to each interferogram by itself; fitted to the coarse
    (multi-looked) phase where one is given, applied at full resolution."""
    fit = terms(coarse_grid or grid, degree, intercept)
    found = {i: solve(*s) for i, s in normal_equations(phase if coarse is None else coarse, fit).items()}
    return model(phase, terms(grid, degree, intercept), found, offset)


def network_coefficients(phase: DataFrame, grid: Grid, network: Network, degree: str, *, intercept: bool = True, scale: float = 100.0):
    """Coefficients of each epoch, from the interferograms of the spanning
    tree: each is its second epoch's ramp less its first's."""
    import numpy as np

    tree = spanning_tree(network).ifgs
    ids = [i.ifg_id for i in tree]
    parts = terms(grid, degree, intercept, scale)
    sums, index, k = normal_equations(phase.filter(F.col("ifg_id").isin(*ids)), parts), network.index(), len(parts)
    a, b = np.zeros((k * len(index),) * 2), np.zeros(k * len(index))
    for i in tree:
        if i.ifg_id not in sums:
            continue
        own, rhs = sums[i.ifg_id]
        f, s = (slice(k * index[d], k * index[d] + k) for d in (i.first, i.second))
        a[f, f] += own
        a[s, s] += own
        a[f, s] -= own
        a[s, f] -= own
        b[f] -= rhs
        b[s] += rhs
    return solve(a, b).reshape(len(index), k)


def by_network(phase: DataFrame, grid: Grid, network: Network, degree: str = "planar", *, intercept: bool = True, offset: bool = False, scale: float = 100.0, coarse: DataFrame | None = None, coarse_grid: Grid | None = None) -> DataFrame:
    """Ramps of the epochs fitted jointly, applied to every interferogram."""
    c = network_coefficients(phase if coarse is None else coarse, coarse_grid or grid, network, degree, intercept=intercept, scale=scale)
    index = network.index()
    return model(phase, terms(grid, degree, intercept, scale), {i.ifg_id: c[index[i.second]] - c[index[i.first]] for i in network.ifgs}, offset)
