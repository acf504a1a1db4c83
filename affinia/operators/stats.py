"""Statistics on sums that tasks can merge."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.operators.ordered import numbered
from affinia.session import stored

# Fixed values of Acklam's rational approximation of the inverse normal distribution.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution function, to about 1e-9."""
    if p <= 0 or p >= 1:
        return float("-inf") if p <= 0 else float("inf")
    if min(p, 1 - p) < 0.02425:
        q = np.sqrt(-2 * np.log(min(p, 1 - p)))
        x = np.polyval(_C, q) / np.polyval(_D, q)
        return float(x if p < 0.5 else -x)
    q = p - 0.5
    return float(np.polyval(_A, q * q) * q / np.polyval(_B, q * q))


def normal_cdf(x: float) -> float:
    from math import erf, sqrt

    return 0.5 * (1 + erf(x / sqrt(2)))


#: Groups whose draws are made together. A resample's draws are dealt to ranges of so many groups down a binary tree.
LEAF = 4096
#: Resamples that a task draws at a time.
AT_ONCE = 64
# Fixed odd numbers that tell seed, resample, range and draw apart, and those of the mixing of their sum.
_SEED, _RESAMPLE, _RANGE, _DRAW = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5
_MIX_1, _MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _draws_of(resamples: np.ndarray, draws: np.ndarray, leaf: int, size: int, seed: int) -> np.ndarray:
    """counts[i, g]: how often resample i draws the g-th group of a range, of draws[i] draws in it.

    A draw is a mix of the seed, the resample, the range and its number, so a rerun, any cluster and SQL draw alike.
    """
    row = np.repeat(np.arange(len(draws)), draws)
    i = np.arange(len(row)) - np.repeat(np.cumsum(draws) - draws, draws)
    start = np.uint64((seed * _SEED + leaf * _RANGE) % (1 << 64))
    x = start + resamples[row].astype(np.uint64) * np.uint64(_RESAMPLE) + i.astype(np.uint64) * np.uint64(_DRAW)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX_2)
    at = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) % np.uint64(size)
    return np.bincount(row * size + at.astype(np.int64), minlength=len(draws) * size).reshape(len(draws), size)


def _dealt(leaf: int, groups: int, resamples: int, seed: int, span: int) -> np.ndarray:
    """Draws of each resample that fall into a range: from the root on, a node's draws are dealt to its halves by a binomial
    that the seed and the node fix."""
    lo, hi = 0, -(-groups // span)
    n = np.full(resamples, groups, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left, whole = (min(x * span, groups) - lo * span for x in (mid, hi))
        some = np.random.Generator(np.random.Philox(key=[seed, (lo << 32) + hi])).binomial(n, left / whole)
        n, lo, hi = (some, lo, mid) if leaf < mid else (n - some, mid, hi)
    return n


def _resampled(cells: DataFrame, groups: int, width: int, resamples: int, seed: int) -> DataFrame:
    """(b, s, n): for each resample the sums of s and n over the groups that it draws, by level 0 .. width - 1.

    cells has at (the group's place from 1), level, s and n. A task keeps the sums of all resamples over its ranges and gives
    one row a resample; no draw is a row.
    """
    span, once = LEAF, AT_ONCE  # the tasks' own modules needn't have these values
    parts = max(1, min(-(-groups // span), int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    t = cells.select(F.floor((F.col("at") - 1) / span).cast("int").alias("leaf"), ((F.col("at") - 1) % span).cast("int").alias("g"), F.col("level").cast("int").alias("level"), F.col("s").cast("double").alias("s"), F.col("n").cast("double").alias("n"))

    def run(frames):
        import pandas as pd

        s, n = np.zeros((resamples, width)), np.zeros((resamples, width))

        def add(leaf, f):
            size = min(span, groups - leaf * span)
            draws = _dealt(leaf, groups, resamples, seed, span)
            g, level = f["g"].to_numpy(), f["level"].to_numpy()
            by = np.argsort(level, kind="stable")
            g, level, fs, fn = g[by], level[by], f["s"].to_numpy()[by], f["n"].to_numpy()[by]
            cut = np.flatnonzero(np.diff(level, prepend=-1))
            for a in range(0, resamples, once):
                counts = _draws_of(np.arange(a, min(a + once, resamples)), draws[a : a + once], leaf, size, seed)[:, g]
                s[a : a + once, level[cut]] += np.add.reduceat(counts * fs, cut, axis=1)
                n[a : a + once, level[cut]] += np.add.reduceat(counts * fn, cut, axis=1)

        held, any_rows = None, False
        for f in frames:
            if len(f):
                any_rows = True
                f = f if held is None else pd.concat([held, f], ignore_index=True)
                last = f["leaf"].iloc[-1]
                for leaf, part in f[f["leaf"] != last].groupby("leaf", sort=False):
                    add(int(leaf), part)
                held = f[f["leaf"] == last]
        if held is not None:
            add(int(held["leaf"].iloc[0]), held)
        for a in range(0, resamples if any_rows else 0, 256):
            yield pd.DataFrame({"b": np.arange(a, min(a + 256, resamples)), "s": list(s[a : a + 256]), "n": list(n[a : a + 256])})

    return t.repartition(parts, "leaf").sortWithinPartitions("leaf", "g", "level").mapInPandas(run, "b long, s array<double>, n array<double>")


def cluster_bootstrap(rows: DataFrame, value: str, group: str, resamples: int = 10_000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Bias-corrected and accelerated interval of a mean, resampling whole groups with replacement.

    Groups enter by their sum and count alone, and are drawn by their place in order, so no row moves twice; the driver
    sees one mean a resample.
    """
    spark = rows.sparkSession
    g = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count("*").alias("n"))
    g = stored(numbered(g, [F.col("_g")], "at"), "clusters")
    whole = g.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.count("*").alias("groups")).first()
    if not whole.n:
        return spark.createDataFrame([], "point double, low double, high double, n_groups long, n long")
    sums = _resampled(g.withColumn("level", F.lit(0)), whole.groups, 1, resamples, seed).groupBy("b").agg((F.sum(F.get("s", F.lit(0))) / F.sum(F.get("n", F.lit(0)))).alias("m"))
    boot = np.sort(np.round([r.m for r in sums.collect()], 12))  # as many as resamples
    point = round(whole.s / whole.n, 12)
    left = (F.lit(whole.s) - F.col("s")) / F.nullif(F.lit(whole.n) - F.col("n"), F.lit(0))
    mean = g.agg(F.avg(left)).first()[0] if whole.groups > 1 else point
    j = g.agg(F.sum(F.pow(mean - left, F.lit(3))).alias("c"), F.sum(F.pow(mean - left, F.lit(2))).alias("q")).first()
    accel = j.c / (6 * j.q**1.5) if j.q else 0.0
    z0 = normal_quantile(min(max(float((boot < point).mean()), 1e-9), 1 - 1e-9))

    def at(z):
        p = normal_cdf(z0 + (z0 + z) / (1 - accel * (z0 + z)))
        return float(boot[min(len(boot) - 1, max(0, round(p * (len(boot) - 1))))])

    low, high = sorted((at(normal_quantile(alpha / 2)), at(normal_quantile(1 - alpha / 2))))
    return spark.createDataFrame([(float(point), low, high, whole.groups, whole.n)], "point double, low double, high double, n_groups long, n long")


def brier(rows: DataFrame, p: str, y: str) -> DataFrame:
    return rows.agg(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("brier"))


def calibration_error(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins of probability, the last one closed."""
    b = rows.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n"), F.abs(F.avg(p) - F.avg(F.col(y).cast("double"))).alias("gap"))
    return b.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def _pool(lo, hi, s, n) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring blocks (from, to, sum, count) pooled until their means rise."""
    out: list[list[float]] = []
    for a, b, u, m in zip(lo, hi, s, n):
        out.append([a, b, u, m])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, b, u, m = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = b, out[-1][2] + u, out[-1][3] + m
    return tuple(np.array(out, float).reshape(-1, 4).T)


Fit = tuple[np.ndarray, np.ndarray]


def isotonic_fits(rows: DataFrame, x: str, y: str, by: list[str]) -> dict[tuple, Fit]:
    """Edges and values of the rising least-squares fit of each group of ``by``.

    Values are summed by distinct x first; each task pools one stretch of x, which the whole fit would pool as well, and
    only the stretches' blocks meet on the driver.
    """
    t = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_s"), F.lit(1.0).alias("_n"))
    return _fits_of_sums(t, by)


def _fits_of_sums(rows: DataFrame, by: list[str]) -> dict[tuple, Fit]:
    """isotonic_fits() of rows (by, _x, _s, _n) that already are sums."""
    import pandas as pd

    levels = rows.groupBy(*by, "_x").agg(F.sum("_s").alias("_s"), F.sum("_n").cast("double").alias("_n"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = levels.repartitionByRange(n, *by, "_x").sortWithinPartitions(*by, "_x")
    kept = levels.select(*by).schema

    def pool(frames):
        held = None  # blocks of the group that the last frame ended in
        for f in frames:
            f = f.assign(_to=f["_x"])
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            parts = [(k, g) for k, g in f.groupby(by, sort=False, dropna=False)] if by else [((), f)]
            done = []
            for k, g in parts:
                got = pd.DataFrame(dict(zip(("_x", "_to", "_s", "_n"), _pool(g["_x"], g["_to"], g["_s"], g["_n"]))))
                done.append(got.assign(**dict(zip(by, k)))[[*by, "_x", "_to", "_s", "_n"]])
            held = done.pop()
            yield from done
        if held is not None:
            yield held

    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "_x double, _to double, _s double, _n double"])
    got = stretch.select(*by, "_x", "_s", "_n").mapInPandas(pool, fields).toPandas()
    out = {}
    for k, g in got.groupby(by, sort=False, dropna=False) if by else [((), got)]:
        g = g.sort_values("_x")
        lo, hi, s, m = _pool(g["_x"], g["_to"], g["_s"], g["_n"])
        out[k] = (np.stack([lo, hi], 1).ravel(), np.repeat(s / m, 2))
    return out


def isotonic(rows: DataFrame, x: str, y: str) -> Fit:
    """Edges and values of the rising fit, which clips at its ends."""
    return isotonic_fits(rows, x, y, []).get((), (np.zeros(0), np.zeros(0)))


def apply_fits(rows: DataFrame, x: str, fits: dict[tuple, Fit], by: list[str], name: str = "calibrated") -> DataFrame:
    """rows plus the fit of their group at x: linear between edges, constant beyond them; null for null x or no fit."""

    import pandas as pd

    def at(frames):
        for cols in frames:
            v, out = cols[0].to_numpy(float), np.full(len(cols[0]), np.nan)
            codes, keys = pd.factorize(pd.MultiIndex.from_arrays(list(cols[1:])), use_na_sentinel=False) if by else (np.zeros(len(v), int), [()])
            order = np.argsort(codes, kind="stable")
            ends = np.cumsum(np.bincount(codes, minlength=len(keys)))
            for k, stop, n in zip(keys, ends, np.diff(ends, prepend=0)):
                edges, values = fits.get(tuple(k), ((), ()))
                if len(edges):
                    mine = order[stop - n : stop]
                    out[mine] = np.interp(v[mine], edges, values)
            yield pd.Series(out)

    f = F.pandas_udf(at, "double", F.PandasUDFType.SCALAR_ITER)
    got = f(F.col(x).cast("double"), *[F.col(c) for c in by] or [F.lit(0)])
    return rows.withColumn(name, F.nanvl(got, F.lit(None).cast("double")))


def apply_isotonic(rows: DataFrame, x: str, fit: Fit, name: str = "calibrated") -> DataFrame:
    """rows plus the fit at x: linear between edges, constant beyond them."""
    return apply_fits(rows, x, {(): fit}, [], name)


def isotonic_band(rows: DataFrame, x: str, y: str, group: str, grid: list[float], resamples: int = 2000, seed: int = 42, bins: int = 1000) -> DataFrame:
    """(x, fitted, low, high): the fit on a grid with the 2.5 and 97.5 percentiles of fits to resampled groups.

    Where x has over ``bins`` values it is put into as many equal bins first and enters by its bin's mean. Tasks add up each
    resample's sums by level over their groups; the fit of a resample is pooled in one task, of as many rows as levels. The
    driver sees the levels alone.
    """
    import pandas as pd

    spark = rows.sparkSession
    t = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(group).alias("_g"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    ends = t.agg(F.count_distinct("_x").alias("k"), F.min("_x").alias("lo"), F.max("_x").alias("hi")).first()
    if ends.k > bins:
        b = F.least(F.floor((F.col("_x") - ends.lo) / ((ends.hi - ends.lo) / bins)), F.lit(bins - 1))
        t = stored(t.withColumn("_b", b), "binned")
        t = t.join(F.broadcast(t.groupBy("_b").agg(F.avg("_x").alias("_m"))), "_b").withColumn("_x", F.col("_m"))
    levels = np.array(sorted(r["_x"] for r in t.select("_x").distinct().collect()))  # ``bins`` at most
    named = spark.createDataFrame([(float(v), i) for i, v in enumerate(levels)], "_x double, level int")
    g = stored(numbered(t.select("_g").distinct(), [F.col("_g")], "at"), "groups").withColumnRenamed("_g", "_h")
    cells = t.groupBy("_g", "_x").agg(F.sum("_y").alias("s"), F.count("*").alias("n")).join(F.broadcast(named), "_x")
    cells = stored(cells.join(g, F.col("_g").eqNullSafe(F.col("_h"))).select("at", "level", "s", "n"), "cells")
    sums = _resampled(cells, g.count(), len(levels), resamples, seed)

    def curve(frame: pd.DataFrame) -> pd.DataFrame:
        u, m = np.sum(frame["s"].tolist(), 0), np.sum(frame["n"].tolist(), 0)
        some = m > 0
        lo, hi, u, m = _pool(levels[some], levels[some], u[some], m[some])
        return pd.DataFrame({"at": range(len(grid)), "v": np.interp(grid, np.stack([lo, hi], 1).ravel(), np.repeat(u / m, 2))})

    every = cells.groupBy("level").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("level").toPandas()
    fitted = curve(pd.DataFrame({"s": [every["s"].to_numpy(float)], "n": [every["n"].to_numpy(float)]}))["v"].tolist()
    told = spark.createDataFrame([(i, float(v), f) for i, (v, f) in enumerate(zip(grid, fitted))], "at int, x double, fitted double")
    band = sums.groupBy("b").applyInPandas(curve, "at int, v double").groupBy("at").agg(F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high"))
    return F.broadcast(told).join(band, "at").select("x", "fitted", "low", "high")


def out_of_fold_calibration(rows: DataFrame, x: str, y: str, fold: str, band: str, least: int = 30) -> DataFrame:
    """rows with a calibrated x: each fold by a fit of the others in its band, or of all bands where those have too few.

    Every fold's fits, with and without bands, come from one pass over the sums by fold, band and x.
    """
    t = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(fold, band, F.col(x).cast("double").alias("_x")).agg(F.sum(F.col(y).cast("double")).alias("_s"), F.count("*").alias("_n"))
    sums = stored(t, "levels")
    counts = {(r[fold], r[band]): r["n"] for r in sums.groupBy(fold, band).agg(F.sum("_n").alias("n")).collect()}
    folds = sorted({f for f, _ in counts})
    # The other folds' sums: those of all folds less the own.
    total = sums.groupBy(band, "_x").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n")).withColumn("_of", F.explode(F.array(*[F.lit(f) for f in folds]) if folds else F.array().cast("array<int>")))
    own = sums.select(F.col(fold).alias("_of"), band, "_x", F.col("_s").alias("_os"), F.col("_n").alias("_on"))
    others = total.join(own, ["_of", band, "_x"], "left").select("_of", band, "_x", (F.col("_s") - F.coalesce("_os", F.lit(0.0))).alias("_s"), (F.col("_n") - F.coalesce("_on", F.lit(0))).alias("_n")).where("_n > 0")
    near, every = _fits_of_sums(others.select("_of", band, "_x", "_s", "_n"), ["_of", band]), _fits_of_sums(others.select("_of", "_x", "_s", "_n"), ["_of"])
    fits = {(f, b): near[f, b] if sum(m for (g, c), m in counts.items() if g != f and c == b) >= least else every.get((f,), (np.zeros(0), np.zeros(0))) for f, b in counts}
    return apply_fits(rows, x, fits, [fold, band])


#: Steps of the iterated fits. They are fixed, so that a rerun, any cluster and SQL take the same ones.
CURVE_STEPS, NEWTON_STEPS = 30, 12


def logistic_curve(rows: DataFrame, x: str, y: str, steps: int = CURVE_STEPS) -> dict[str, float]:
    """midpoint, width, floor and ceiling of floor + (ceiling - floor) / (1 + exp(-(x - midpoint) / width)) by least squares.

    Each step is one sum over all rows: floor and ceiling by regression on the curve's shape, then a Gauss-Newton step of
    midpoint and width, a quarter of x's range at most. Rows with a null take no part; without rows all are NaN.
    """
    t = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    r = t.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).first()
    if not r.n or r.lo == r.hi:
        return dict.fromkeys(("midpoint", "width", "floor", "ceiling"), float("nan"))
    span, mid, width, floor, rise = r.hi - r.lo, r.mean, r.sd / 2, 0.0, 0.0
    for _ in range(steps):
        z = 1 / (1 + F.exp(-(F.col("x") - mid) / width))
        v = t.select("y", z.alias("z"), (z * (1 - z)).alias("a"), (z * (1 - z) * (F.col("x") - mid)).alias("b"))
        pairs = [(p, q) for i, p in enumerate("yzab") for q in "yzab"[i:]]
        g = v.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "yzab"], *[F.sum(F.col(p) * F.col(q)).alias(p + q) for p, q in pairs]).first()
        rise = (g.n * g.yz - g.y * g.z) / (g.n * g.zz - g.z * g.z)
        floor = (g.y - rise * g.z) / g.n
        # Residuals times the derivatives -rise / width * a and -rise / width ** 2 * b.
        k = -rise / width
        ra, rb = k * (g.ya - floor * g.a - rise * g.za), k / width * (g.yb - floor * g.b - rise * g.zb)
        aa, ab, bb = k * k * g.aa, k * k / width * g.ab, k * k / width**2 * g.bb
        aa, bb = aa * 1.001 + 1e-12, bb * 1.001 + 1e-12
        det = aa * bb - ab * ab
        bounded = lambda d: min(max(d, -span / 4), span / 4)
        mid, width = min(max(mid + bounded((bb * ra - ab * rb) / det), r.lo), r.hi), min(max(width + bounded((aa * rb - ab * ra) / det), span / 1000), 2 * span)
    return {"midpoint": mid, "width": width, "floor": floor, "ceiling": floor + rise}


def stacker(rows: DataFrame, features: list[str], label: str, fold: str, key: list[str], l2: float = 1.0, steps: int = NEWTON_STEPS) -> DataFrame:
    """(key, p): out-of-fold probability of a logistic model with the classes weighted alike and the squares of all weights
    but the constant's added, l2 / 2 times.

    A Newton step is one sum over all rows, for the models of all folds at once; each is learned on the other folds. Rows with
    a null feature or label teach nothing, and with a null feature have no p. A fold whose others lack a class has no p.
    """
    names = ["1", *features]
    col = lambda c: F.lit(1.0) if c == "1" else F.col(c).cast("double")
    known = rows
    for c in (*features, label, fold):
        known = known.where(F.col(c).isNotNull())
    counts: dict = {}
    for r in known.groupBy(fold, (F.col(label) == 1).alias("y")).agg(F.count("*").alias("n")).collect():  # two rows a fold
        counts[r[fold], r.y] = r.n
    folds = sorted({f for f, _ in counts})
    rest = {f: {y: sum(n for (g, v), n in counts.items() if g != f and v == y) for y in (True, False)} for f in folds}
    folds = [f for f in folds if all(rest[f].values())]
    t = known.select(F.col(fold).alias("_f"), (F.col(label) == 1).alias("_y"), *[col(c).alias(f"_x{i}") for i, c in enumerate(names)])
    k = len(names)
    beta = {f: np.zeros(k) for f in folds}
    dot = lambda b, cols: sum((float(v) * c for v, c in zip(b, cols)), F.lit(0.0))
    for _ in range(steps if folds else 0):
        models = []
        for j, f in enumerate(folds):
            n = sum(rest[f].values())
            fixed = {"j": j, "f": f, "yes": n / (2 * rest[f][True]), "no": n / (2 * rest[f][False])}
            models.append(F.struct(*[F.lit(v).alias(c) for c, v in fixed.items()], *[F.lit(float(v)).alias(f"b{i}") for i, v in enumerate(beta[f])]))
        every = t.withColumn("_m", F.explode(F.array(*models))).where(F.col("_m.f") != F.col("_f"))
        line = sum((F.col(f"_m.b{i}") * F.col(f"_x{i}") for i in range(1, k)), F.col("_m.b0"))
        every = every.withColumns({"_p": 1 / (1 + F.exp(-line)), "_w": F.when(F.col("_y"), F.col("_m.yes")).otherwise(F.col("_m.no")), "_j": F.col("_m.j")})
        error, bend = F.col("_w") * (F.col("_y").cast("double") - F.col("_p")), F.col("_w") * F.col("_p") * (1 - F.col("_p"))
        x = [F.col(f"_x{i}") for i in range(k)]
        got = every.groupBy("_j").agg(*[F.sum(error * x[i]).alias(f"g{i}") for i in range(k)], *[F.sum(bend * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).collect()
        for r in got:
            f = folds[r["_j"]]
            pull = np.full(k, l2)
            pull[0] = 0.0
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + np.diag(pull)
            beta[f] = beta[f] + np.linalg.solve(h, np.array([r[f"g{i}"] for i in range(k)]) - pull * beta[f])
    p = F.lit(None).cast("double")
    for f in folds:
        p = F.when(F.col(fold) == f, 1 / (1 + F.exp(-dot(beta[f], [col(c) for c in names])))).otherwise(p)
    return rows.select(*key, p.alias("p"))


def power_law(rows: DataFrame, x: str, y: str) -> DataFrame:
    """y = scale * x ** exponent by least squares on logarithms, with R squared."""
    lx, ly = F.ln(x), F.ln(y)
    return rows.agg(F.exp(F.regr_intercept(ly, lx)).alias("scale"), F.regr_slope(ly, lx).alias("exponent"), F.regr_r2(ly, lx).alias("r2"))


def ols(rows: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(term, estimate, se, t, p, r2): least squares from one pass of cross products; p by the normal law."""
    names = ["1", *xs]
    col = lambda c: F.lit(1.0) if c == "1" else F.col(c).cast("double")
    sums = [F.sum(col(a) * col(b)).alias(f"x{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)]
    r = rows.dropna(subset=[y, *xs]).agg(*sums, *[F.sum(col(a) * col(y)).alias(f"y{i}") for i, a in enumerate(names)], F.sum(col(y) * col(y)).alias("yy"), F.sum(col(y)).alias("sy"), F.count("*").alias("n")).first()
    k = len(names)
    xx = np.array([[r[f"x{i}_{j}"] for j in range(k)] for i in range(k)])
    xy = np.array([r[f"y{i}"] for i in range(k)])
    inv = np.linalg.inv(xx)
    beta = inv @ xy
    rss = r.yy - beta @ xy
    se = np.sqrt(np.diag(inv) * rss / (r.n - k))
    tss = r.yy - r.sy**2 / r.n
    out = [(a, float(b), float(s), float(b / s), float(2 * (1 - normal_cdf(abs(b / s)))), float(1 - rss / tss)) for a, b, s in zip(["intercept", *xs], beta, se)]
    return rows.sparkSession.createDataFrame(out, "term string, estimate double, se double, t double, p double, r2 double")


def cluster_design(rows: DataFrame, value: str, group: str, margins: tuple[float, ...] = (0.01, 0.02, 0.05), alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """(margin, icc, design_effect, required_n) for a paired comparison of grouped values."""
    v = F.col(value).cast("double")
    g = rows.groupBy(group).agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.count("*").alias("n"))
    t = g.agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    mean, m = F.col("s") / F.col("n"), F.col("n") / F.col("k")
    between, total = F.col("b") - F.col("n") * mean * mean, F.col("q") - F.col("n") * mean * mean
    msb, msw = between / F.greatest(F.col("k") - 1, F.lit(1)), (total - between) / F.greatest(F.col("n") - F.col("k"), F.lit(1))
    icc = F.when(msb + (m - 1) * msw > 0, F.greatest(F.lit(0.0), (msb - msw) / (msb + (m - 1) * msw))).otherwise(0.0)
    z = (normal_quantile(1 - alpha / 2) + normal_quantile(power)) ** 2
    var = total / (F.col("n") - 1)
    t = t.select(icc.alias("icc"), (1 + (m - 1) * icc).alias("design_effect"), var.alias("v"), F.explode(F.array(*[F.lit(x) for x in margins])).alias("margin"))
    return t.select("margin", "icc", "design_effect", (F.lit(z) * F.col("v") / (F.col("margin") * F.col("margin")) * F.col("design_effect")).alias("required_n"))


def ordinal_spearman(rows: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Pearson correlation of places (ties broken by key, not averaged)."""
    t = numbered(numbered(rows.select(a, b, key), [F.col(a), F.col(key)], "_a"), [F.col(b), F.col(key)], "_b")
    return t.agg(F.corr(F.col("_a").cast("double"), F.col("_b").cast("double")).alias("rho"))
