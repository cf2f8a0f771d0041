"""Distributions of columns: estimates from sufficient statistics, distances, scores and mining."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspan.functions import expressions as E
from relspan.functions import special
from relspan.functions.search import prefix_sums

FAMILIES = ("normal", "lognormal", "poisson", "zipf", "exponential", "uniform", "beta", "gamma")
DISCRETE = {"poisson", "zipf"}
_TINY = 1e-9


def clean(c: Column) -> Column:
    """The value as a double, null if it is no finite number."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def label(c: Column) -> Column:
    """A value's canonical label: whole numbers without a point, so 1, 1.0 and '1' agree."""
    text, x = c.cast("string"), c.try_cast("double")
    whole = (x == F.rint(x)) & (F.abs(x) < F.lit(1e15))
    plain = F.when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), F.regexp_replace(F.regexp_replace(x.cast("decimal(38,18)").cast("string"), "0+$", ""), "\\.$", ""))
    shown = F.when(x.cast("string").contains("E"), F.coalesce(plain, F.lower(x.cast("string")))).otherwise(x.cast("string"))
    return F.when(x.isNull(), text).when(F.isnan(x), F.lit(None)).when(whole, x.cast("long").cast("string")).otherwise(shown)


#: What the estimate of each family needs of statistics().
NEEDS = {
    "normal": ("mean", "std"),
    "lognormal": ("n_positive", "mean_log", "std_log"),
    "poisson": ("mean",),
    "zipf": ("mean_rounded",),
    "exponential": ("n_positive", "mean_positive"),
    "uniform": ("low", "high"),
    "beta": ("n_unit", "mean_unit", "var_unit", "log_unit", "log1m_unit"),
    "gamma": ("n_positive", "mean_positive", "mean_log"),
}


def statistics(name: str, wanted: set[str] | None = None) -> list[Column]:
    """What families' estimates need of a column, all of it or what is wanted; of many columns in one scan."""
    x = clean(F.col(name))
    positive, r = F.when(x > 0, x), F.rint(x)
    unit = F.when((x > 0) & (x < 1), x)
    of = {
        "n": F.count(x),
        "rows": F.count("*"),
        "mean": F.avg(x),
        "std": F.stddev_pop(x),
        "low": F.min(x),
        "high": F.max(x),
        "n_positive": F.count(positive),
        "mean_positive": F.avg(positive),
        "mean_log": F.avg(F.ln(positive)),
        "std_log": F.stddev_samp(F.ln(positive)),
        "n_unit": F.count(unit),
        "mean_unit": F.avg(unit),
        "var_unit": F.var_pop(unit),
        "log_unit": F.avg(F.ln(unit)),
        "log1m_unit": F.avg(F.ln(F.lit(1.0) - unit)),
        "mean_rounded": F.avg(F.when(r >= 1, r)),
        "share_whole": F.avg((x == r).cast("double")),
    }
    return [c.alias(f"{name}__{k}") for k, c in of.items() if wanted is None or k in wanted]


def summarize(rows: DataFrame, names: list[str], families: tuple[str, ...] | None = None) -> dict[str, dict[str, float]]:
    """The statistics of the columns, those that the families need or all: one job, one row."""
    wanted = None if families is None else {"n"}.union(*(NEEDS[f] for f in families))
    got = rows.agg(*(c for n in names for c in statistics(n, wanted))).first().asDict()
    return {n: {k.split("__")[-1]: v for k, v in got.items() if k.startswith(f"{n}__")} for n in names}


def distinct_up_to(rows: DataFrame, name: str, most: int = 500) -> int:
    """How many different numbers a column has; most + 1 stands for any more, and no more than that reach one task."""
    return counts(rows, name).limit(most + 1).count()


def estimate(family: str, s: dict) -> dict[str, float]:
    """Parameters from statistics(). Deviations: of normal over n, of lognormal over n - 1."""
    match family:
        case "normal":
            return {"mean": s["mean"] or 0.0, "std": max(s["std"] or 0.0, _TINY)}
        case "lognormal":
            if not s["n_positive"]:
                return {"mu": 0.0, "sigma": 1.0}
            return {"mu": s["mean_log"], "sigma": 1.0 if s["n_positive"] == 1 else max(s["std_log"], _TINY)}
        case "poisson":
            return {"lambda": max(s["mean"] or 0.0, _TINY)}
        case "zipf":
            m = s["mean_rounded"]
            return {"a": 2.0 if m is None or m <= 1 else max(1 + 1 / math.log(m), 1.01)}
        case "exponential":
            return {"rate": 1 / s["mean_positive"] if s["n_positive"] else 1.0}
        case "uniform":
            lo, hi = s["low"] or 0.0, s["high"] if s["high"] is not None else 1.0
            return {"low": lo, "high": hi if hi > lo else lo + 1}
        case "beta":
            if s["n_unit"] < 2:
                return {"alpha": 1.0, "beta": 1.0}
            a, b = special.fit_beta(s["log_unit"], s["log1m_unit"], s["mean_unit"], s["var_unit"])
            return {"alpha": a, "beta": b}
        case "gamma":
            if s["n_positive"] < 2:
                return {"shape": 1.0, "rate": 1.0}
            k, rate = special.fit_gamma(s["mean_positive"], s["mean_log"])
            return {"shape": k, "rate": rate}
    raise ValueError(f"no family {family}")


def cdf(family: str, p: dict, x: float) -> float:
    match family:
        case "normal":
            return 0.5 * math.erfc((p["mean"] - x) / (p["std"] * math.sqrt(2)))
        case "lognormal":
            return 0.0 if x <= 0 else cdf("normal", {"mean": p["mu"], "std": p["sigma"]}, math.log(x))
        case "poisson":
            return 0.0 if x < 0 else 1 - special.gamma_cdf(math.floor(x) + 1, p["lambda"])
        case "zipf":
            return 0.0 if x < 1 else 1 - special.zeta(p["a"], math.floor(x) + 1) / special.zeta(p["a"])
        case "exponential":
            return 0.0 if x < 0 else -math.expm1(-p["rate"] * x)
        case "uniform":
            return min(1.0, max(0.0, (x - p["low"]) / (p["high"] - p["low"])))
        case "beta":
            return special.beta_cdf(p["alpha"], p["beta"], x)
        case "gamma":
            return special.gamma_cdf(p["shape"], p["rate"] * x)
    raise ValueError(f"no family {family}")


def log_density(family: str, p: dict, x: float) -> float:
    """-inf outside the support; poisson and zipf take the nearest whole number."""
    match family:
        case "normal":
            return -0.5 * ((x - p["mean"]) / p["std"]) ** 2 - math.log(p["std"] * math.sqrt(2 * math.pi))
        case "lognormal":
            return -math.inf if x <= 0 else log_density("normal", {"mean": p["mu"], "std": p["sigma"]}, math.log(x)) - math.log(x)
        case "poisson":
            k = round(x)
            return -math.inf if k < 0 else k * math.log(p["lambda"]) - p["lambda"] - math.lgamma(k + 1)
        case "zipf":
            k = round(x)
            return -math.inf if k < 1 else -p["a"] * math.log(k) - math.log(special.zeta(p["a"]))
        case "exponential":
            return -math.inf if x < 0 else math.log(p["rate"]) - p["rate"] * x
        case "uniform":
            return -math.log(p["high"] - p["low"]) if p["low"] <= x <= p["high"] else -math.inf
        case "beta":
            a, b = p["alpha"], p["beta"]
            return (a - 1) * math.log(x) + (b - 1) * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) if 0 < x < 1 else -math.inf
        case "gamma":
            k, r = p["shape"], p["rate"]
            return (k - 1) * math.log(x) - r * x + k * math.log(r) - math.lgamma(k) if x > 0 else -math.inf
    raise ValueError(f"no family {family}")


def likeliest(family: str, p: dict) -> float:
    """Where the density is greatest; a point inside the support where it has no bound."""
    match family:
        case "normal":
            return p["mean"]
        case "lognormal":
            return math.exp(p["mu"] - p["sigma"] ** 2)
        case "poisson":
            return float(math.floor(p["lambda"]))
        case "zipf":
            return 1.0
        case "exponential":
            return 0.0
        case "uniform":
            return (p["low"] + p["high"]) / 2
        case "beta":
            a, b = p["alpha"], p["beta"]
            return (a - 1) / (a + b - 2) if a > 1 and b > 1 else 0.5 if a == b else 1e-6 if a < b else 1 - 1e-6
        case "gamma":
            return (p["shape"] - 1) / p["rate"] if p["shape"] >= 1 else 1e-6
    raise ValueError(f"no family {family}")


def counts(rows: DataFrame, name: str) -> DataFrame:
    """x, n: how often each number occurs. What follows works on distinct values, not on rows."""
    return rows.select(clean(F.col(name)).alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("n"))


def cumulated(values: DataFrame) -> DataFrame:
    """x, n, upto (count of values up to x), total."""
    out, total = prefix_sums(values, "x", "n")
    return out.withColumn("total", F.lit(total))


def _cdf_column(family: str, p: dict) -> Column:
    x = F.col("x")
    match family:
        case "uniform":
            return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - F.lit(p["low"])) / F.lit(p["high"] - p["low"])))
        case "exponential":
            return F.when(x < 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.exp(F.lit(-p["rate"]) * x))
        case "normal":
            return E.normal_cdf((x - F.lit(p["mean"])) / F.lit(p["std"]))
        case "lognormal":
            return F.when(x > 0, E.normal_cdf((F.ln(x) - F.lit(p["mu"])) / F.lit(p["sigma"]))).otherwise(F.lit(0.0))
        case "poisson":
            a = F.floor(x).cast("double") + F.lit(1.0)
            return F.when(x >= 0, F.lit(1.0) - E.gamma_cdf(a, F.lit(float(p["lambda"])), log_gamma(F.greatest(a, F.lit(1.0))), p["lambda"])).otherwise(F.lit(0.0))
        case "zipf":
            return F.when(x >= 1, F.lit(1.0) - E.zeta(p["a"], F.floor(x).cast("double") + F.lit(1.0)) / F.lit(special.zeta(p["a"]))).otherwise(F.lit(0.0))
        case "gamma":
            return E.gamma_cdf(F.lit(float(p["shape"])), F.lit(p["rate"]) * x, F.lit(math.lgamma(p["shape"])), p["shape"])
        case "beta":
            return E.beta_cdf(p["alpha"], p["beta"], x)
    raise ValueError(f"no family {family}")


def gap(family: str, p: dict, plain: bool = False) -> Column:
    """Of a row of cumulated(): the difference of both distribution functions there."""
    at = _cdf_column(family, p)
    above = F.col("upto") / F.col("total") - at
    below = at - (F.col("upto") - F.col("n")) / F.col("total")
    return F.abs(above) if family in DISCRETE and not plain else F.greatest(above, below)


def ks(rows: DataFrame, name: str, family: str, p: dict, plain: bool = False) -> DataFrame:
    """distance: Kolmogorov-Smirnov statistic against a distribution; 1 for fewer than two values.

    Discrete families are compared at the values only, unless plain; others
    from both sides of each step.
    """
    at = cumulated(counts(rows, name))
    return at.agg(F.when(F.max("total") >= 2, F.max(gap(family, p, plain))).otherwise(F.lit(1.0)).alias("distance"))


def pmf(rows: DataFrame, name: str) -> DataFrame:
    """label, share: of the labels that are not null."""
    n = rows.select(label(F.col(name)).alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("label", (F.col("n") / F.col("total")).alias("share"))


def tvd(a: DataFrame, b: DataFrame) -> DataFrame:
    """distance: half the sum of the differences of two pmfs, 0 to 1; 1 if either is empty."""
    both = a.select("label", F.col("share").alias("p")).join(b.select("label", F.col("share").alias("q")), "label", "full")
    half = F.lit(0.5) * F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0))))
    return both.agg(F.when((F.count("p") > 0) & (F.count("q") > 0), F.least(F.lit(1.0), half)).otherwise(F.lit(1.0)).alias("distance"))


def mre(found: dict[str, float], wanted: dict[str, float], scoreable=lambda _: True) -> float | None:
    """Mean relative error over the scoreable parameters that both have; a wanted 0 is a divisor of 1; none shared: None."""
    shared = [k for k, v in wanted.items() if k in found and isinstance(v, (int, float)) and scoreable(k)]
    return sum(abs(found[k] - wanted[k]) / (abs(wanted[k]) or 1.0) for k in shared) / len(shared) if shared else None


#: Stirling's series: the coefficients of 1/z, 1/z^3 and so on.
_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def log_gamma(z: Column) -> Column:
    """Of z from 1 on: Stirling's series seven places further, less the logarithm of the factors between."""
    far = z + F.lit(7.0)
    between = z
    for i in range(1, 7):
        between = between * (z + F.lit(float(i)))
    series = sum((F.lit(c) / F.pow(far, F.lit(2.0 * i + 1)) for i, c in enumerate(_SERIES)), F.lit(0.0))
    return (far - F.lit(0.5)) * F.ln(far) - far + F.lit(0.5 * math.log(2 * math.pi)) + series - F.ln(between)


def log_densities(family: str, p: dict, least: float = -math.inf) -> Column:
    """log_density() of column x, at least `least`, as an expression."""
    x = F.col("x")
    k = F.bround(x)
    low = F.lit(least)
    match family:
        case "normal":
            out = F.lit(-0.5) * F.pow((x - F.lit(p["mean"])) / F.lit(p["std"]), F.lit(2.0)) - F.lit(math.log(p["std"] * math.sqrt(2 * math.pi)))
        case "lognormal":
            z = (F.ln(x) - F.lit(p["mu"])) / F.lit(p["sigma"])
            out = F.when(x > 0, F.lit(-0.5) * z * z - F.lit(math.log(p["sigma"] * math.sqrt(2 * math.pi))) - F.ln(x))
        case "poisson":
            out = F.when(k >= 0, k * F.lit(math.log(p["lambda"])) - F.lit(p["lambda"]) - log_gamma(k + F.lit(1.0)))
        case "zipf":
            out = F.when(k >= 1, F.lit(-p["a"]) * F.ln(k) - F.lit(math.log(special.zeta(p["a"]))))
        case "exponential":
            out = F.when(x >= 0, F.lit(math.log(p["rate"])) - F.lit(p["rate"]) * x)
        case "uniform":
            out = F.when(x.between(p["low"], p["high"]), F.lit(-math.log(p["high"] - p["low"])))
        case "beta":
            a, b = p["alpha"], p["beta"]
            out = F.when((x > 0) & (x < 1), F.lit(a - 1) * F.ln(x) + F.lit(b - 1) * F.log1p(-x) + F.lit(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)))
        case "gamma":
            shape, rate = p["shape"], p["rate"]
            out = F.when(x > 0, F.lit(shape - 1) * F.ln(x) - F.lit(rate) * x + F.lit(shape * math.log(rate) - math.lgamma(shape)))
        case _:
            raise ValueError(f"no family {family}")
    return F.greatest(F.coalesce(out, F.lit(-math.inf)), low)


def nll_score(rows: DataFrame, name: str, family: str, p: dict) -> DataFrame:
    """score: exp of the mean of log density over its greatest, of values in the support; 1 is best, 0 if there is none."""
    best = log_density(family, p, likeliest(family, p))
    at = counts(rows, name).withColumn("d", log_densities(family, p) - F.lit(best)).where(F.abs("d") < F.lit(float("inf")))
    return at.agg(F.coalesce(F.exp(F.sum(F.col("d") * F.col("n")) / F.sum("n")), F.lit(0.0)).alias("score"))


#: Other names that specifications use.
_RENAME = {"std_dev": "std", "lam": "lambda", "min": "low", "max": "high", "min_value": "low", "max_value": "high"}


def parse_spec(spec: dict) -> tuple[str, dict]:
    """Family and parameters of a specification in any of the vocabularies in use."""
    family = str(spec.get("distribution") or spec.get("family")).lower().replace("gaussian", "normal").replace("log_normal", "lognormal")
    p = {_RENAME.get(k, k): v for k, v in (spec.get("params") or {}).items()}
    if family == "lognormal":
        if "variance" in p:
            p["sigma"] = math.sqrt(p.pop("variance"))
        p = {{"mean": "mu", "std": "sigma"}.get(k, k): v for k, v in p.items()}
    if family == "exponential" and "lambda" in p:
        p["rate"] = p.pop("lambda")
    return family, p
