"""Small dense kernels in NumPy: what SQL can't express for one pixel or one
image. All take and return arrays; missing values are NaN here and only here."""

from __future__ import annotations

import math

import numpy as np


def pivoted_qr(a):
    """Column order of a QR factorisation with pivoting (the column of largest
    remaining norm first, the first of equals), and R."""
    r, n = a.astype(float).copy(), a.shape[1]
    order = np.arange(n)
    for k in range(min(a.shape)):
        norms = (r[k:, k:] ** 2).sum(0)
        j = k + int(np.argmax(norms > norms.max() * (1 - 1e-12)))
        r[:, [k, j]], order[[k, j]] = r[:, [j, k]], order[[j, k]]
        x = r[k:, k]
        size = np.linalg.norm(x)
        if size == 0:
            continue
        v = x.copy()
        v[0] += math.copysign(size, x[0])
        v /= np.linalg.norm(v)
        r[k:, k:] -= 2 * np.outer(v, v @ r[k:, k:])
    return order, np.triu(r[: min(a.shape)])


def independent_rows(b):
    """Rows of a design matrix left when those that touch a dependent column
    are removed, again and again until there is none; None if one row is left
    to begin a round with."""
    rows = np.arange(len(b))
    while True:
        if len(rows) <= 1:
            return None
        order, _ = pivoted_qr(b[rows])
        loose = order[np.linalg.matrix_rank(b[rows]) : b.shape[1]]
        bad = (b[rows][:, loose] != 0).any(1)
        if not bad.any():
            return rows
        rows = rows[~bad]


def design(first, second, increments):
    """A row for each interferogram: the increments of the epochs it spans."""
    out = np.zeros((len(first), len(increments)))
    for i, (f, s) in enumerate(zip(first, second)):
        out[i, f:s] = increments[f:s]
    return out


def svd_operator(b, is_tree: bool):
    """(velocities, rows, operator): which velocities can be had, from which
    rows, and the matrix that gives them; None where there is no answer."""
    rows = np.arange(len(b))
    if is_tree is False:
        columns = np.ones(b.shape[1], bool)
    else:
        rows = independent_rows(b)
        if rows is None:
            return None
        columns = ~np.isclose(np.abs(b[rows]).sum(0), 0.0)
    return columns, rows, np.linalg.pinv(b[rows][:, columns])


def laplacian_operator(b, is_tree: bool, order: int, factor: float, vcm):
    """The same with velocities smoothed: rows of first or second differences
    times the factor, two rows that tie the ends to the mean, and weights from
    the observations' covariance."""
    n = b.shape[1]
    rows = np.arange(len(b))
    if is_tree:
        rows = independent_rows(b)
        if rows is None:
            return None
    columns = ~np.isclose(np.abs(b[rows]).sum(0), 0.0, atol=1e-8) if is_tree else np.ones(n, bool)
    left = int(columns.sum())
    if left < 2:
        return None
    stencil = [-1.0, 1.0] if order == 1 else [1.0, -2.0, 1.0]
    smooth = np.zeros((max(0, left - order), left))
    for i in range(len(smooth)):
        smooth[i, i : i + len(stencil)] = stencil
    ends = np.full((2, left), -1.0 / (left - 1))
    ends[0, 0] = ends[1, -1] = 1.0
    full = np.vstack([b[rows][:, columns], ends[:1], smooth * factor, ends[1:]])
    weight = np.eye(len(full))
    weight[: len(rows), : len(rows)] = vcm[np.ix_(rows, rows)]
    w = np.linalg.cholesky(np.linalg.pinv(weight)).T
    return columns, rows, (np.linalg.pinv(w @ full, rcond=1e-8) @ w)[:, : len(rows)]


def robust_rate(y, span, vcm, nsig: float, least: int):
    """(rate, error, samples) by weighted least squares through the origin:
    while the worst whitened residual exceeds nsig its observation goes; NaN
    and the first number of observations when fewer than `least` are left."""
    kept, n = np.arange(len(y)), len(y)
    while len(kept) >= max(least, 1):
        v, s = vcm[np.ix_(kept, kept)], span[kept]
        inverse = np.linalg.inv(v)
        norm = s @ inverse @ s
        rate = (s @ inverse @ y[kept]) / norm
        # The upper factor of the inverse whitens residuals.
        w = np.linalg.cholesky(inverse).T
        worst = np.abs(w @ (s * rate - y[kept]))
        if worst.max() <= nsig:
            return rate, math.sqrt(1 / norm), len(kept)
        kept = np.delete(kept, worst.argmax())
    return math.nan, math.nan, n


def weighted_least_squares(a, b, v):
    """x of a x = b where b has independent variances v; of fewer equations
    than unknowns the solution of least norm."""
    w = 1 / np.sqrt(np.asarray(v, float).ravel())
    return np.linalg.lstsq(np.asarray(a, float) * w[:, None], np.asarray(b, float).ravel() * w, rcond=None)[0]


def minimise(f, x0: float, xtol: float = 1e-6, ftol: float = 1e-6, most: int = 200):
    """One-dimensional simplex search (reflect, expand, contract, shrink)."""
    a, b = x0, x0 * 1.05 if x0 else 0.00025
    fa, fb = f(a), f(b)
    for _ in range(most):
        if fb < fa:
            a, b, fa, fb = b, a, fb, fa
        if abs(b - a) <= xtol and abs(fb - fa) <= ftol:
            break
        x = 2 * a - b
        fx = f(x)
        if fx < fa:
            far = 3 * a - 2 * b
            ff = f(far)
            b, fb = (far, ff) if ff < fx else (x, fx)
            continue
        near = 1.5 * a - 0.5 * b if fx < fb else 0.5 * (a + b)
        fn = f(near)
        if fn <= min(fx, fb):
            b, fb = near, fn
        else:
            b = a + 0.5 * (b - a)
            fb = f(b)
    return a if fa <= fb else b


def autocorrelation(image):
    """Autocorrelation of an image (NaN as 0) about its centre, divided by its
    number of non-zero cells."""
    x = np.nan_to_num(image)
    power = np.abs(np.fft.fft2(x)) ** 2
    return np.fft.fftshift(np.fft.ifft2(power).real) / max(1, np.count_nonzero(x))


def lag_distances(nrows: int, ncols: int, x_size: float, y_size: float):
    """Kilometres from the centre cell, columns first, the first half of the
    cells and one more column."""
    row, col = np.mgrid[:nrows, :ncols]
    d = np.hypot((col - ncols // 2) * x_size, (row - nrows // 2) * y_size) / 1000
    return d.ravel(order="F")[: math.ceil(nrows * ncols / 2) + nrows]


def covariance_with_distance(image, x_size: float, y_size: float, alpha: bool = True):
    """(maxvar, alpha): the greatest autocorrelation within the shorter half
    axis, and the decay (1/km) of maxvar * exp(-alpha * r) fitted to its means
    in bins of two cells."""
    nrows, ncols = image.shape
    lag = lag_distances(nrows, ncols, x_size, y_size)
    values = autocorrelation(image).ravel(order="F")[: len(lag)]
    cx, cy = ncols // 2, nrows // 2
    reach = ((cx + 1) * x_size if cx * x_size < cy * y_size else (cy + 1) * y_size) / 1000
    keep = lag < reach
    lag, values = lag[keep], values[keep]
    if not alpha:
        return float(values.max()), None
    width = max(x_size, y_size) * 2 / 1000
    bins = np.ceil(lag / width).astype(int)
    last = max(1, bins.max() - 1)
    r = np.arange(last + 1) * width
    means = np.array([values[bins == b].mean() for b in range(last + 1)])
    return float(values.max()), minimise(lambda a: float(np.linalg.norm(means - means[0] * np.exp(-a * r))), 2 / (last * width))


def fill_nearest(image):
    """NaN cells take the value of the nearest valid cell (the first in row
    order of equals)."""
    bad = np.isnan(image)
    if not bad.any() or bad.all():
        return np.nan_to_num(image) if bad.all() else image
    out, at, known = image.copy(), np.argwhere(~bad), image[~bad]
    holes = np.argwhere(bad)
    for i in range(0, len(holes), 512):
        part = holes[i : i + 512]
        nearest = np.concatenate([((part[j : j + 64, None, :] - at[None]) ** 2).sum(2).argmin(1) for j in range(0, len(part), 64)])
        out[tuple(part.T)] = known[nearest]
    return out


def fill_linear(image):
    """NaN cells take the value of a line between the nearest valid cells of
    their row and of their column (the mean of the two); without either, 0."""
    out, total, n = image.copy(), np.zeros(image.shape), np.zeros(image.shape)
    for axis in (0, 1):
        rows = image if axis else image.T
        for i, line in enumerate(rows):
            good = np.flatnonzero(~np.isnan(line))
            if len(good) < 2:
                continue
            x = np.arange(good[0], good[-1] + 1)
            at = (i, x) if axis else (x, i)
            total[at] += np.interp(x, good, line[good])
            n[at] += 1
    holes = np.isnan(image)
    out[holes] = np.where(n[holes] > 0, total[holes] / np.maximum(n[holes], 1), 0.0)
    return out


FILLS = {"nearest": fill_nearest, "linear": fill_linear}


def gaussian_lowpass(image, cutoff: float, x_size: float, y_size: float, fill: str | None = "nearest", pad: int = 4096):
    """Gaussian low-pass in the Fourier domain over the image padded with
    zeros to pad x pad; NaNs are filled before and put back after."""
    mask = np.isnan(image)
    if mask.all():
        return image
    if fill is not None and fill not in FILLS:
        raise ValueError(f"no such fill: {fill}")
    x = FILLS[fill](image) if fill else image
    pad = max(pad, *image.shape)
    c = pad // 2
    a = (np.arange(pad) - c) / 1000
    d2 = (a[None, :] * x_size) ** 2 + (a[:, None] * y_size) ** 2
    sigma = math.sqrt(d2.mean() - np.sqrt(d2).mean() ** 2) / cutoff
    weight = np.fft.ifftshift(np.exp(-0.5 * d2 / sigma**2))[:, : pad // 2 + 1]
    out = np.fft.irfft2(np.fft.rfft2(x, (pad, pad)) * weight, (pad, pad))[: image.shape[0], : image.shape[1]].copy()
    out[mask] = np.nan
    return out


def vincenty_azimuth(lat1, lon1, lat2, lon2, major: float, minor: float):
    """Azimuth in radians from 0 to 2 pi of the geodesic from point 1 to 2 on
    an ellipsoid, to nine decimals; 0 where the points are the same."""
    f = (major - minor) / major
    u1, u2 = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    same = (lat1 == lat2) & (lon1 == lon2)
    omega = lon2 - lon1
    lam = omega.copy()
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(1000):
            sin_s = np.hypot(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
            cos_s = s1 * s2 + c1 * c2 * np.cos(lam)
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0, c1 * c2 * np.sin(lam) / sin_s)
            cos2_a = 1 - sin_a**2
            middle = np.where(cos2_a == 0, 0, cos_s - 2 * s1 * s2 / cos2_a)
            c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
            new = omega + (1 - c) * f * sin_a * (sigma + c * sin_s * (middle + c * cos_s * (2 * middle**2 - 1)))
            done = np.nanmax(np.abs(new - lam), initial=0) < 1e-12
            lam = new
            if done:
                break
        out = np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
    return np.where(same, 0.0, np.round(np.where(out < 0, out + 2 * np.pi, out), 9))


def cell_size(lat: float, lon: float, x_step: float, y_step: float) -> tuple[float, float]:
    """Metres of a cell east and north, through transverse Mercator (WGS 84,
    the zone of the longitude). Latitudes from -80 to 84."""
    if not -80 <= lat <= 84:
        raise ValueError("latitude must be from -80 to 84")
    zone = 60 if lon == 180 else int((lon + 180) // 6) + 1
    x0, y0 = mercator(lat, lon, zone)
    x1, y1 = mercator(lat + y_step, lon + x_step, zone)
    return abs(x1 - x0), abs(y1 - y0)


def mercator(lat: float, lon: float, zone: int) -> tuple[float, float]:
    """Easting and northing by the series in the third flattening."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996  # WGS 84 and UTM: fixed values
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = math.radians(lat), math.radians(lon - (zone * 6 - 183))
    e = 2 * math.sqrt(n) / (1 + n)
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.sqrt(1 + t * t))
    x = eta + sum(c * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, c in enumerate(series, 1))
    y = xi + sum(c * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, c in enumerate(series, 1))
    return 500_000 + k0 * radius * x, k0 * radius * y + (10_000_000 if lat < 0 else 0)


def is_square(a) -> bool:
    return np.ndim(a) == 2 and a.shape[0] == a.shape[1]
