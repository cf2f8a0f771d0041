"""Scores of rows against stated distributions: by parameter, by density, by distance, and by case.

A specification is {"distribution", "params", and maybe "scoring" and
"free_params"}. scoring: {parameter: {"tier": "point" or another}}: parameters
of another tier are free, so they are not compared, and neither density nor
distance of their column means anything. free_params: {parameter: {"min",
"max"}}: bands in which a free parameter is plausible, counted apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relspan.operators import columns as C
from relspan.operators import distributions as D
from relspan.operators import rules as R

# Kinds of distance, the worst scores, and what specifications call the parameters of some families.
KS, TVD, UNSCOREABLE, NONE = "ks", "tvd", "unscoreable_free_params", "none"
WORST = {"mre": 1.0, "nll": 0.0, "distance": 1.0, "kind": NONE}
SPELLED = {("lognormal", "mu"): "mean", ("lognormal", "sigma"): "variance", ("exponential", "rate"): "lambda", ("uniform", "low"): "min", ("uniform", "high"): "max"}


def spelled(family: str, parameter: str) -> str:
    """What a specification calls a parameter."""
    return SPELLED.get((family, parameter), "weights" if parameter.startswith("p_") else parameter)


def free(spec: dict) -> set[str]:
    """The parameters, as the specification calls them, of another tier than point; without a scoring block none."""
    stated = spec.get("scoring") or {}
    return {k for k, v in stated.items() if isinstance(v, dict) and isinstance(v.get("tier"), str) and v["tier"] != "point"}


def shares(p: dict) -> dict[str, float]:
    """Of each canonical label the share that weights, or probabilities of categories, give it."""
    weights = p.get("weights")
    if weights is None and "categories" in p:
        names = p["categories"]
        weights = dict(zip(names, p.get("probabilities") or [1 / len(names)] * len(names), strict=True))
    total = sum(float(w) for w in (weights or {}).values())
    return {_label(k): float(w) / total for k, w in (weights or {}).items()} if total > 0 else {}


def _label(v: object) -> str:
    try:
        x = float(v)
    except (TypeError, ValueError):
        return str(v)
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def bands(found: dict[str, float], family: str, spec: dict) -> tuple[int, int]:
    """How many estimated parameters have a band, and how many lie in it. A lognormal's spread is banded as a variance."""
    stated, n, inside = spec.get("free_params") or {}, 0, 0
    for name, value in found.items():
        band = stated.get(spelled(family, name))
        ends = (band.get("min"), band.get("max")) if isinstance(band, dict) else (None, None)
        if all(isinstance(e, (int, float)) for e in ends):
            value = value**2 if (family, name) == ("lognormal", "sigma") else value
            n += 1
            inside += ends[0] <= value <= ends[1]
    return n, inside


SCORES = "spec string, mre double, nll double, distance double, kind string, band_applicable long, band_satisfied long"


def _categorical(tables: dict[str, DataFrame], wanted: list[C.Wanted], specs: dict[str, dict], spark: SparkSession) -> DataFrame:
    """By labels: mean relative error of shares, exp of the mean log share over the greatest one, total variation distance.

    Labels that are not expected have no log share and are left out of the
    mean. The worst scores where no label is there.
    """
    expected = {k: shares(specs[k].get("params") or {}) for k, _, _ in wanted}
    rows = [(k, x, q) for k, of in expected.items() for x, q in of.items()]
    stated = spark.createDataFrame(rows, "key string, label string, q double")
    n = C.tall(tables, wanted, D.label).where("x is not null").groupBy("key", F.col("x").alias("label")).agg(F.count("*").alias("n"))
    total = n.groupBy(F.col("key").alias("k")).agg(F.sum("n").alias("total"))  # a row a column
    seen = n.join(F.broadcast(total), F.col("key") == F.col("k")).select("key", "label", (F.col("n") / F.col("total")).alias("p"))
    both = seen.join(stated, ["key", "label"], "full")
    known = F.when(F.col("p").isNotNull() & (F.col("q") > 0), F.col("p"))
    found = both.groupBy("key").agg(
        F.sum("p").alias("seen"),
        F.avg(F.when(F.col("p").isNotNull() & F.col("q").isNotNull(), F.abs(F.col("p") - F.col("q")) / F.when(F.col("q") == 0, 1.0).otherwise(F.col("q")))).alias("mre"),
        F.try_divide(F.sum(known * F.ln("q")), F.sum(known)).alias("log"),
        (F.lit(0.5) * F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0))))).alias("tvd"),
        F.max("q").alias("most"),
    )
    loose = [k for k, _, _ in wanted if "weights" in free(specs[k])]
    pinned, none = ~F.col("key").isin(loose) if loose else F.lit(True), F.col("seen").isNull()

    def score(worst: float, value: Column) -> Column:
        return F.when(none, F.lit(worst)).when(pinned, value)

    return found.select(
        F.col("key").alias("spec"),
        score(WORST["mre"], F.least(F.col("mre"), F.lit(1.0))).alias("mre"),
        score(WORST["nll"], F.coalesce(F.exp("log") / F.col("most"), F.lit(0.0))).alias("nll"),
        score(WORST["distance"], F.least(F.col("tvd"), F.lit(1.0))).alias("distance"),
        F.when(none, NONE).when(pinned, TVD).otherwise(UNSCOREABLE).alias("kind"),
        F.lit(None).cast("long").alias("band_applicable"),
        F.lit(None).cast("long").alias("band_satisfied"),
    )


def _numeric(tables: dict[str, DataFrame], wanted: list[C.Wanted], specs: dict[str, dict], spark: SparkSession) -> DataFrame:
    """By parameters, density and distance: the columns' statistics in one job, and one pass over their ordered values for all that have a distance."""
    of = {k: D.parse_spec(specs[k]) for k, _, _ in wanted}
    values = C.tall(tables, wanted)
    stats = C.summaries(values, {"n"}.union(*(D.NEEDS[family] for family, _ in of.values())))
    rows, gaps, densities = [], {}, {}
    for key, (family, p) in of.items():
        s = stats.get(key)
        if s is None or s["n"] < 2:
            rows.append((key, WORST["mre"], WORST["nll"], WORST["distance"], NONE, None, None))
            continue
        found, loose = D.estimate(family, s), free(specs[key])
        point = lambda k, family=family, loose=loose: spelled(family, k) not in loose
        error = D.mre(found, p, point)
        kind = UNSCOREABLE
        if all(map(point, p)):
            try:
                d = D.log_densities(family, p) - F.lit(D.log_density(family, p, D.likeliest(family, p)))
                gaps[key], densities[key] = D.gap(family, p), F.when(F.abs(d) < F.lit(math.inf), d)
                kind = KS
            except (KeyError, ValueError, ZeroDivisionError):
                rows.append((key, WORST["mre"], WORST["nll"], WORST["distance"], NONE, None, None))
                continue
        n, inside = bands(found, family, specs[key])
        rows.append((key, None if error is None else min(error, 1.0), None, None, kind, n or None, inside if n else None))
    out = spark.createDataFrame(rows, SCORES)
    if not gaps:
        return out
    at = C.cumulated(values.where(F.col("key").isin(list(gaps))))
    at = at.withColumn("gap", C.each_key(gaps)).withColumn("d", C.each_key(densities))
    by = at.groupBy("key").agg(F.max("gap").alias("ks"), F.try_divide(F.sum(F.col("d") * F.col("n")), F.sum(F.when(F.col("d").isNotNull(), F.col("n")))).alias("log"))
    both = out.join(F.broadcast(by), F.col("spec") == F.col("key"), "left")
    measured = F.col("kind") == KS
    nll, distance = F.when(measured, F.coalesce(F.exp("log"), F.lit(0.0))).otherwise(F.col("nll")), F.when(measured, F.least(F.col("ks"), F.lit(1.0))).otherwise(F.col("distance"))
    return both.select("spec", "mre", nll.alias("nll"), distance.alias("distance"), "kind", "band_applicable", "band_satisfied")


def score_case(tables: dict[str, DataFrame], specs: dict[str, dict], spark: SparkSession) -> DataFrame:
    """spec, mre, nll, distance, kind, band_applicable, band_satisfied of each "TABLE.column", or "TABLE.column (note)".

    A metric that says nothing is null, and so are bands where none is stated.
    The worst scores for tables and columns that are not there, unknown
    families, weights that expect nothing, fewer than two numbers, and
    parameters that make no distribution. The number of jobs depends neither on
    columns nor on rows.
    """
    worst, wanted = [], {True: [], False: []}
    for key, spec in specs.items():
        table, _, name = key.split(" (")[0].partition(".")
        table = table if table in tables else table.lower()
        family = D.parse_spec(spec)[0]
        known = bool(shares(spec.get("params") or {})) if family == "categorical" else family in D.FAMILIES
        if name and table in tables and name in tables[table].columns and known:
            wanted[family == "categorical"].append((key, table, name))
        else:
            worst.append((key, WORST["mre"], WORST["nll"], WORST["distance"], NONE, None, None))
    out = spark.createDataFrame(worst, SCORES)
    for labels, score in ((True, _categorical), (False, _numeric)):
        if wanted[labels]:
            out = out.union(score(tables, wanted[labels], specs, spark))
    return out


def score_column(rows: DataFrame, name: str, spec: dict) -> dict:
    """score_case() of one column: mre, nll, distance, kind, and bands where some are stated."""
    got = score_case({"T": rows}, {f"T.{name}": spec}, rows.sparkSession).first().asDict()
    return {k: v for k, v in got.items() if k != "spec" and not (k.startswith("band") and v is None)}


def case_report(scores: DataFrame) -> DataFrame:
    """Means over the columns that each metric can score, each with its own denominator, and what kinds of distance are among them.

    The share of bands that hold is told apart, so that a vague specification
    gains nothing by it. Without columns: the worst scores.
    """
    missing = (F.col("mre") == WORST["mre"]) & (F.col("nll") == WORST["nll"]) & (F.col("distance") == WORST["distance"])
    some = F.count("*") > 0
    kinds = F.array_sort(F.collect_list("kind"))  # a word a column
    return scores.agg(
        *(F.when(some, F.avg(k)).otherwise(F.lit(WORST[k])).alias(k) for k in ("mre", "nll", "distance")),
        F.count("distance").alias("n_scoreable"),
        F.count_if(F.col("kind") == UNSCOREABLE).alias("n_unscoreable"),
        F.try_divide(F.sum("band_satisfied").cast("double"), F.sum("band_applicable").cast("double")).alias("plausibility_rate"),
        F.coalesce(F.sum("band_applicable"), F.lit(0)).alias("n_band_applicable"),
        F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k))))).alias("distance_kinds"),
        F.count_if(~F.coalesce(missing, F.lit(False))).alias("n_evaluated"),
        F.count_if(F.coalesce(missing, F.lit(False))).alias("n_missing"),
    )


def case_metrics(tables: dict[str, DataFrame], case: dict, spark: SparkSession) -> DataFrame:
    """One row of what rows of a case are worth: the fidelity of its distributions, and how far its constraints hold.

    Without distributions, or tables, fidelity is the worst; without constraints
    nothing is satisfied or violated: csr is null.
    """
    specs = case.get("ground_truth_distributions") or {}
    fidelity = case_report(score_case(tables, specs if tables else {}, spark))
    constraints = (case.get("ground_truth_constraints") or []) if tables else []
    held = R.satisfaction(R.verdicts(constraints, tables, spark))
    names = {"csr": "csr", "n_evaluated": "csr_n_evaluated", "n_vacuous": "csr_n_vacuous", "n_unevaluable": "csr_n_unevaluable", "applicable_rows": "csr_applicable_rows", "violated_rows": "csr_violated_rows"}
    return fidelity.crossJoin(held.select(*(F.col(k).alias(v) for k, v in names.items())))  # a row each
