"""Columns' ordered values against fitted families: densities and distribution functions over arrays, summed up in tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.functions import arrays, special
from relspan.functions.workers import importable
from relspan.operators import distributions as D

JUDGED = "key string, family string, different long, n long, ll double, ks double"


def cdf(family: str, p: dict, x: np.ndarray) -> np.ndarray:
    """distributions.cdf() of an array."""
    out = np.zeros(len(x))
    match family:
        case "normal":
            return arrays.normal_cdf((x - p["mean"]) / p["std"])
        case "lognormal":
            inside = x > 0
            out[inside] = arrays.normal_cdf((np.log(x[inside]) - p["mu"]) / p["sigma"])
        case "poisson":
            inside = x >= 0
            above = np.floor(x[inside]) + 1
            out[inside] = 1 - arrays.gamma_cdf(above, np.full(len(above), float(p["lambda"])), p["lambda"])
        case "zipf":
            inside = x >= 1
            out[inside] = 1 - arrays.zeta(p["a"], np.floor(x[inside]) + 1) / special.zeta(p["a"])
        case "exponential":
            inside = x >= 0
            out[inside] = -np.expm1(-p["rate"] * x[inside])
        case "uniform":
            return np.clip((x - p["low"]) / (p["high"] - p["low"]), 0.0, 1.0)
        case "beta":
            return arrays.beta_cdf(p["alpha"], p["beta"], x)
        case "gamma":
            return arrays.gamma_cdf(p["shape"], p["rate"] * x, p["shape"])
        case _:
            raise ValueError(f"no family {family}")
    return out


def log_density(family: str, p: dict, x: np.ndarray, least: float) -> np.ndarray:
    """distributions.log_density() of an array, at least `least`."""
    k = np.rint(x)
    inside = {"lognormal": x > 0, "gamma": x > 0, "poisson": k >= 0, "zipf": k >= 1, "exponential": x >= 0, "beta": (x > 0) & (x < 1)}.get(family, np.ones(len(x), bool))
    out, v, k = np.full(len(x), -math.inf), x[inside], k[inside]
    match family:
        case "normal":
            found = -0.5 * ((v - p["mean"]) / p["std"]) ** 2 - math.log(p["std"] * math.sqrt(2 * math.pi))
        case "lognormal":
            log = np.log(v)
            found = -0.5 * ((log - p["mu"]) / p["sigma"]) ** 2 - math.log(p["sigma"] * math.sqrt(2 * math.pi)) - log
        case "poisson":
            found = k * math.log(p["lambda"]) - p["lambda"] - arrays.each(lambda z: math.lgamma(z) if z < 1e300 else math.inf, k + 1)
        case "zipf":
            found = -p["a"] * np.log(k) - math.log(special.zeta(p["a"]))
        case "exponential":
            found = math.log(p["rate"]) - p["rate"] * v
        case "uniform":
            found = np.where((v >= p["low"]) & (v <= p["high"]), -math.log(p["high"] - p["low"]), -math.inf)
        case "beta":
            a, b = p["alpha"], p["beta"]
            found = (a - 1) * np.log(v) + (b - 1) * np.log1p(-v) + (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
        case "gamma":
            shape, rate = p["shape"], p["rate"]
            found = (shape - 1) * np.log(v) - rate * v + (shape * math.log(rate) - math.lgamma(shape))
        case _:
            raise ValueError(f"no family {family}")
    out[inside] = found
    return np.maximum(out, least)


def judge(at: DataFrame, of: dict[str, dict], least: float, most: int) -> DataFrame:
    """JUDGED, a row a key and family of `of`: over rows of columns.cumulated(), the log likelihood and the greatest difference of both distribution functions.

    A column with over `most` different values has no discrete family, so it has no row of one.
    A task judges discrete families by no more values of a column than that, and adds up what it judged before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list] = {}  # of each key how many different values, of how many rows, and by family likelihood and gap
        for batch in batches:
            coded = batch.column("key").dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            x, n, upto, total = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "n", "upto", "total"))
            for i, key in enumerate(coded.dictionary.to_pylist()):
                own = np.flatnonzero(codes == i)
                here = seen.setdefault(key, [0, 0, {}])
                here[0] += len(own)
                here[1] = int(total[own[0]])
                v, often = x[own], n[own]
                after, before = upto[own] / total[own], (upto[own] - often) / total[own]
                for family, p in of[key].items():
                    if family in D.DISCRETE and here[0] > most:
                        here[2][family] = 0.0, 0.0
                        continue
                    ll, ks = here[2].get(family, (0.0, -math.inf))
                    f = cdf(family, p, v)
                    here[2][family] = ll + float(np.sum(log_density(family, p, v, least) * often)), float(np.maximum(ks, np.max(np.maximum(after - f, f - before))))
        rows = [(key, family, different, n, *told) for key, (different, n, by) in seen.items() for family, told in by.items()]
        names = ("key", "family", "different", "n", "ll", "ks")
        yield pa.RecordBatch.from_pydict({c: pa.array([r[j] for r in rows], kind) for j, (c, kind) in enumerate(zip(names, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))})

    importable(at.sparkSession)
    told = at.select("key", "x", "n", "upto", "total").mapInArrow(run, JUDGED).groupBy("key", "family")
    told = told.agg(F.sum("different").alias("different"), F.max("n").alias("n"), F.sum("ll").alias("ll"), F.max("ks").alias("ks"))
    return told.where(~F.col("family").isin(sorted(D.DISCRETE)) | (F.col("different") <= most))
