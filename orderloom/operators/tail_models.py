"""Competing models of a tail: power law, exponential, lognormal and power law with an exponential cut-off.

With y = ln(x / xmin), each model's density of y >= 0 is proportional to exp(a y - b T(y)): T = y^2 makes the lognormal,
T = e^y - 1 the cut-off power law (and, with a = 1, the exponential), b = 0 the plain power law. So the sums of y, y^2 and
e^y - 1 over a tail are all that an estimate needs, and the likelihood, concave in (a, b), is climbed by Newton's method for
each of the few tails. A second pass over the rows adds up the differences of the models' log-likelihoods and their squares.
"""

from math import inf, log, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.tails import two_sided_normal

POINTS = 20_001  # of the integrals, over 60 means of y
MODELS = {"power_law": 1, "exponential": 1, "lognormal": 2, "truncated_power_law": 2}  # free parameters


def _shape(a: float, b: float, y: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray]:
    """ln of the integral of exp(a y - b t), and the weights of the points (Simpson's rule)."""
    rule = np.full(len(y), 2.0)
    rule[1::2], rule[0], rule[-1] = 4.0, 1.0, 1.0
    e = a * y - b * t
    top = e.max()
    w = np.exp(e - top) * rule
    return top + log(w.sum() * (y[1] - y[0]) / 3), w / w.sum()


def most_likely(mean_y: float, mean_t: float, plain_t: float, cut: bool) -> tuple[float, float, float]:
    """(a, b, ln of the integral) of the greatest likelihood, given the tail's means of y and T.

    plain_t is the mean of T under the plain power law: where the tail's own is not below it, b = 0 is the maximum.
    """
    if mean_t >= plain_t:
        return -1 / mean_y, 0.0, log(mean_y)
    y = np.linspace(0.0, 60 * mean_y, POINTS)
    t = np.expm1(np.minimum(y, 300.0)) if cut else y * y
    a, b = -1 / mean_y, 0.1 / mean_t
    z, w = _shape(a, b, y, t)
    for _ in range(200):
        my, mt = float(w @ y), float(w @ t)
        gradient = np.array([mean_y - my, mt - mean_t])
        yy, yt, tt = float(w @ (y - my) ** 2), float(w @ ((y - my) * (t - mt))), float(w @ (t - mt) ** 2)
        step = np.linalg.solve(np.array([[yy, -yt], [-yt, tt]]) + 1e-12 * np.diag([yy, tt]), gradient)
        size, now = 1.0, a * mean_y - b * mean_t - z
        while size > 1e-12:
            a2, b2 = a + size * step[0], b + size * step[1]
            if b2 > 0:
                z2, w2 = _shape(a2, b2, y, t)
                if a2 * mean_y - b2 * mean_t - z2 >= now - 1e-14:
                    break
            size /= 2
        else:
            break
        a, b, z, w = float(a2), float(b2), float(z2), w2
        if abs(gradient @ step) < 1e-13:
            break
    return a, b, z


def tail_models(rows: DataFrame, tails: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, xmin, model, n_tail, a, b, ll, aic, bic, best, lr, z, p: one row per tail and model.

    rows has the values, tails one row per key with its xmin (a few dozen at most: they reach the driver, each as four sums).
    a and b are, by model: alpha; the rate; mu and sigma of ln x; alpha and the rate of the cut-off. b is NULL where a model
    has one parameter; for a lognormal that degenerates to the power law, both are NULL. ll is the log-likelihood, best the
    least aic (at a tie the model of fewer parameters, then by name). lr is the power law's ll less the model's, z its
    standardised value (Vuong), p the normal two-sided odds of it; z and p are NULL where the two do not differ, as for the
    power law itself. Values below xmin, NULL, NaN or infinite don't count. Keys with fewer than two such values, or with all
    equal to xmin, give no row, and NULL keys none either.
    """
    x = F.col(value).cast("double")
    joined = rows.select(*key, x.alias("_x")).join(F.broadcast(tails.select(*key, F.col("xmin").cast("double").alias("xmin"))), key)
    own = joined.filter("_x >= xmin and xmin > 0 and _x < double('infinity')").withColumn("_y", F.ln(F.col("_x") / F.col("xmin"))).withColumn("_u", F.col("_x") / F.col("xmin") - 1)
    sums = own.groupBy(*key, "xmin").agg(F.count("*").alias("n"), F.sum("_y").alias("sy"), F.sum(F.expr("_y * _y")).alias("syy"), F.sum("_u").alias("su"))
    spark, found = rows.sparkSession, []
    for r in sums.filter("n >= 2 and sy > 0").collect():
        n, xmin = r["n"], r["xmin"]
        my, myy, mu = r["sy"] / n, r["syy"] / n, r["su"] / n
        plain_u = my / (1 - my) if my < 1 else inf
        fits = {"power_law": (-1 / my, 0.0, log(my)), "exponential": (1.0, 1 / mu, log(mu)), "lognormal": most_likely(my, myy, 2 * my * my, False), "truncated_power_law": most_likely(my, mu, plain_u, True)}
        best = min(MODELS, key=lambda m: (MODELS[m] - (fits[m][0] * my - fits[m][1] * (myy if m == "lognormal" else mu) - fits[m][2]) * n, MODELS[m], m))
        for m, (a, b, z) in fits.items():
            ll = n * (a * my - b * (myy if m == "lognormal" else mu) - z - my - log(xmin))
            shown = {"power_law": (1 - a, None), "exponential": (b / xmin, None), "truncated_power_law": (1 - a, b / xmin)}.get(m)
            if m == "lognormal":
                shown = (a / (2 * b) + log(xmin), sqrt(1 / (2 * b))) if b > 0 else (None, None)
            k = MODELS[m]
            found.append((*[r[c] for c in key], xmin, m, n, *shown, ll, 2 * k - 2 * ll, k * log(n) - 2 * ll, m == best, a, b, z, -1 / my, log(my)))
    fields = [f"{rows.schema[c].name} {rows.schema[c].dataType.simpleString()}" for c in key]
    schema = ", ".join([*fields, "xmin double, model string, n_tail bigint, a double, b double, ll double, aic double, bic double, best boolean, _a double, _b double, _z double, _pa double, _pz double"])
    fitted = spark.createDataFrame(found, schema)
    # the differences row by row
    term = F.when(F.col("model") == "lognormal", F.expr("_y * _y")).otherwise(F.col("_u"))
    d = (F.col("_pa") * F.col("_y") - F.col("_pz")) - (F.col("_a") * F.col("_y") - F.col("_b") * term - F.col("_z"))
    apart = own.drop("xmin").join(F.broadcast(fitted.select(*key, "model", "_a", "_b", "_z", "_pa", "_pz")), key).groupBy(*key, "model").agg(F.avg(d).alias("_m"), F.stddev_pop(d).alias("_s"))
    out = fitted.drop("_a", "_b", "_z", "_pa", "_pz").join(apart, [*key, "model"])
    differs = F.col("_s") > 1e-9
    z = F.when(differs, F.col("_m") * F.sqrt(F.col("n_tail")) / F.col("_s"))
    out = out.withColumn("lr", F.col("_m") * F.col("n_tail")).withColumn("z", z).drop("_m", "_s")
    return out.withColumn("p", two_sided_normal(F.col("z"))).select(*key, "xmin", "model", "n_tail", "a", "b", "ll", "aic", "bic", "best", "lr", "z", "p")


def power_density(x: Column, alpha: Column, xmin: Column) -> Column:
    """Density of a continuous power law; NULL below xmin."""
    return F.when(x >= xmin, (alpha - 1) / xmin * F.pow(x / xmin, -alpha))


def power_survival(x: Column, alpha: Column, xmin: Column) -> Column:
    """Odds of at least x under a continuous power law; NULL below xmin."""
    return F.when(x >= xmin, F.pow(x / xmin, 1 - alpha))
