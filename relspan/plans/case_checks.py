"""Whether the cases of a data set hold together: JSON lines shredded to tables of columns, links, distributions, conditions and moments, and joined.

Lines are parsed once to VARIANT, and each part of cases is read from them once, to a table of its own. Every part that a case may refer to a column
from becomes rows of one table of references, and what refers to nothing is
found by two joins with the tables and columns that the same case declares.
Condition trees are flattened depth by depth. No row visits Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspan.sources.shared import stored

# Fixed values of the format: fields, types, families with their parameters and bounds, kinds, and how a quote must read.
SCHEMA, DISTRIBUTIONS, CONSTRAINTS, MOMENTS, DEPENDENCIES, TEXT = "ground_truth_schema", "ground_truth_distributions", "ground_truth_constraints", "ground_truth_moments", "functional_dependencies", "nl_description"
REQUIRED = ("id", "domain", "profile", TEXT, SCHEMA, DISTRIBUTIONS, CONSTRAINTS)
TYPES = ("INTEGER", "VARCHAR", "FLOAT", "DECIMAL", "BOOLEAN", "DATE", "DATETIME", "TIMESTAMP", "TIME", "TEXT", "UUID")
NUMERIC = ("INTEGER", "FLOAT", "DECIMAL")
PARAMETERS = {"normal": ("mean", "std"), "lognormal": ("mean", "variance"), "uniform": ("max", "min"), "poisson": ("lambda",), "exponential": ("lambda",), "zipf": ("a",), "categorical": ("weights",)}
ABOVE = {("normal", "std"): 0, ("lognormal", "variance"): 0, ("poisson", "lambda"): 0, ("exponential", "lambda"): 0, ("zipf", "a"): 1}
AGGREGATES = ("avg", "count", "sum")
SHORTEST, WEIGHT_SLACK = 80, 0.01

FINDING = ["case_id", "level", "subject", "detail"]
ERROR, WARNING = "error", "warning"


def at(of: str | Column, path: str, kind: str = "variant") -> Column:
    """What is at a field of a VARIANT: null if it is missing or of another kind. A JSON null is a VARIANT that is not null."""
    return F.try_variant_get(of, f"$.{path}", kind)


def missing(v: Column) -> Column:
    """Whether a field is missing or a JSON null."""
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(True))


def is_kind(v: Column, kind: str) -> Column:
    """Whether a VARIANT is an OBJECT, an ARRAY or a STRING."""
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def text(of: str | Column, path: str) -> Column:
    """The text at a field, null if it is no text or an empty one."""
    v = at(of, path)
    return F.when(is_kind(v, "STRING") & (at(of, path, "string") != ""), at(of, path, "string"))


def shown(of: str | Column, path: str) -> Column:
    return F.coalesce(at(of, path, "string"), F.lit("null"))


def _said(rows: DataFrame, *checks: tuple) -> DataFrame:
    """Findings of rows (row, case_id, ...): for each check (level, subject, detail, condition) that is true, one. One pass for all checks."""
    found = [F.when(condition, F.struct(F.lit(level).alias("level"), _lit(subject).alias("subject"), _lit(detail).alias("detail"))) for level, subject, detail, condition in checks]
    return rows.select("case_id", F.explode(F.array_compact(F.array(*found))).alias("f")).select("case_id", "f.level", "f.subject", "f.detail")


def _lit(x: str | Column) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def _glued(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts))


def _numbered(rows: DataFrame, list_: Column, label: str, *keep: str) -> DataFrame:
    """Each element of a list as a row: subject `label[i]` and one."""
    got = rows.select("row", "case_id", *keep, F.posexplode(list_).alias("i", "one"))
    return got.withColumn("subject", _glued(label, "[", F.col("i"), "]")).drop("i")


class Shredded:
    """The cases of JSON lines (value) as relations. Lines are parsed once; what all checks read is written to the shared folder, and stays there."""

    def __init__(self, lines: DataFrame):
        parsed = lines.where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("row"), F.try_parse_json("value").alias("v"))
        self.lines = stored(parsed, "case-lines")
        cases = self.lines.where(is_kind(F.col("v"), "OBJECT")).select("row", F.coalesce(at("v", "id", "string"), F.lit("?")).alias("case_id"), "v")
        tables = at("v", f"{SCHEMA}.tables", "array<variant>")
        self.entries = stored(_numbered(cases, tables, "tables").select("row", "case_id", "subject", "one", text("one", "name").alias("table"), at("one", "columns", "array<variant>").alias("columns")), "case-entries")
        columns = _numbered(self.entries.where(F.col("table").isNotNull()).drop("subject", "one"), F.col("columns"), "columns", "table")
        self.columns = stored(columns.select("row", "case_id", "table", is_kind(F.col("one"), "OBJECT").alias("is_object"), text("one", "name").alias("column"), at("one", "data_type", "string").alias("type")), "case-column-entries")
        self.known = stored(self.entries.where(F.col("table").isNotNull() & (F.size("columns") > 0)).select("row", "table").distinct(), "case-tables")
        self.names = stored(self.columns.where(F.col("column").isNotNull()).groupBy("row", "table", "column").agg(F.max("type").alias("type")), "case-columns")
        held = self.known.groupBy("row").agg(F.count("*").alias("tables"))
        self.cases = stored(cases.join(held, "row", "left").withColumn("tables", F.coalesce("tables", F.lit(0))), "cases")
        #: Cases with a table; only their other parts are looked at.
        self.whole = self.cases.where("tables > 0")

    def unknown(self, refs: DataFrame) -> DataFrame:
        """Findings of references (row, case_id, subject, table, column) to what their case has not."""
        r = refs.select("row", "case_id", "subject", F.col("table").alias("t"), F.col("column").alias("c"))
        k = self.known.select(F.col("row").alias("kr"), F.col("table").alias("kt"))
        n = self.names.select(F.col("row").alias("nr"), F.col("table").alias("nt"), F.col("column").alias("nc"))
        both = r.join(k, (F.col("row") == F.col("kr")) & (F.col("t") == F.col("kt")), "left").join(n, (F.col("row") == F.col("nr")) & (F.col("t") == F.col("nt")) & (F.col("c") == F.col("nc")), "left")
        return _said(both, (ERROR, F.col("subject"), _glued("no table ", F.col("t")), F.col("kr").isNull()), (ERROR, F.col("subject"), _glued("no column ", F.col("t"), ".", F.col("c")), F.col("kr").isNotNull() & F.col("nr").isNull()))


def _dotted(rows: DataFrame, ref: str = "ref") -> tuple[DataFrame, DataFrame]:
    """References written TABLE.column, cut in two, and findings of those that are not."""
    good = F.coalesce(F.regexp_like(F.col(ref), F.lit(r"^[^.]*\.[^.]*$")), F.lit(False))
    cut = F.split(F.col(ref), r"\.")
    return rows.where(good).select("row", "case_id", "subject", cut[0].alias("table"), cut[1].alias("column")), _said(rows, (ERROR, F.col("subject"), _glued(F.col(ref), " is not TABLE.column"), ~good))


def case_findings(s: Shredded) -> list[DataFrame]:
    """Of lines and of fields of the case itself."""
    bad = s.lines.withColumn("case_id", F.lit(None).cast("string"))
    lines = _said(bad, (ERROR, "line", "no JSON", F.col("v").isNull()), (ERROR, "line", "no object", F.col("v").isNotNull() & ~is_kind(F.col("v"), "OBJECT")))
    checks = [(ERROR, f, "missing", at("v", f).isNull()) for f in REQUIRED]
    checks.append((ERROR, TEXT, "too short", F.coalesce(F.length(F.trim(text("v", TEXT))), F.lit(0)) < SHORTEST))
    checks += [(ERROR, f, "no text", text("v", f).isNull()) for f in ("domain", "profile")]
    schema = at("v", SCHEMA)
    checks.append((ERROR, SCHEMA, "no object", ~is_kind(schema, "OBJECT")))
    checks.append((ERROR, SCHEMA, "no tables", is_kind(schema, "OBJECT") & (F.coalesce(F.size(at("v", f"{SCHEMA}.tables", "array<variant>")), F.lit(0)) < 1)))
    for field, kind in ((DISTRIBUTIONS, "OBJECT"), (CONSTRAINTS, "ARRAY"), (DEPENDENCIES, "ARRAY"), (MOMENTS, "ARRAY")):
        checks.append((ERROR, field, f"no {kind.lower()}", ~missing(at("v", field)) & ~is_kind(at("v", field), kind) & (F.col("tables") > 0)))
    ids = s.cases.groupBy("case_id").agg(F.count("*").alias("n"))
    return [lines, _said(s.cases, *checks), _said(ids, (ERROR, "dataset", _glued("id ", F.col("case_id"), " ", F.col("n"), " times"), F.col("n") > 1))]


def schema_findings(s: Shredded) -> list[DataFrame]:
    t, c = F.col("table"), F.col("column")
    is_object = is_kind(F.col("one"), "OBJECT")
    empty = F.coalesce(F.size("columns"), F.lit(0)) < 1
    key = at("one", "pk")
    entries = _said(
        s.entries,
        (ERROR, F.col("subject"), "no object", ~is_object),
        (ERROR, F.col("subject"), "no name", is_object & t.isNull()),
        (ERROR, t, "not in upper snake case", ~F.regexp_like(t, F.lit("^[A-Z][A-Z0-9_]*$"))),
        (ERROR, t, "no columns", t.isNotNull() & empty),
        (ERROR, t, "no key", t.isNotNull() & ~empty & missing(key)),
    )
    dotted = _glued(t, ".", c)
    columns = _said(
        s.columns,
        (ERROR, t, "a column is no object", ~F.col("is_object")),
        (ERROR, t, "a column has no name", F.col("is_object") & c.isNull()),
        (ERROR, dotted, "not in lower snake case", ~F.regexp_like(c, F.lit("^[a-z][a-z0-9_]*$"))),
        (ERROR, dotted, _glued("no type ", F.col("type")), c.isNotNull() & ~F.coalesce(F.col("type").isin(*TYPES), F.lit(False))),
    )
    again = s.columns.where(c.isNotNull()).groupBy("row", "case_id", "table", "column").agg(F.count("*").alias("n"))
    tables = s.entries.where(t.isNotNull()).groupBy("row", "case_id", "table").agg(F.count("*").alias("n"))
    keys = s.entries.where(t.isNotNull() & ~empty & ~missing(key)).select("row", "case_id", "table", F.explode(F.coalesce(at("one", "pk", "array<string>"), F.array(at("one", "pk", "string")))).alias("column"))
    lost = keys.join(s.names, ["row", "table", "column"], "left_anti")
    times = _glued(F.col("n"), " times")
    return [entries, columns, _said(again, (ERROR, dotted, times, F.col("n") > 1)), _said(tables, (ERROR, t, times, F.col("n") > 1)), _said(lost, (ERROR, t, _glued("no key column ", c), F.lit(True)))]


def link_findings(s: Shredded) -> tuple[list[DataFrame], DataFrame]:
    links = at("v", f"{SCHEMA}.relationships")
    own = _said(s.whole, (WARNING, SCHEMA, _glued(F.col("tables"), " tables and no relationships"), missing(links) & (F.col("tables") > 1)), (ERROR, SCHEMA, "relationships is no array", ~missing(links) & ~is_kind(links, "ARRAY")))
    rows = stored(_numbered(s.whole, at("v", f"{SCHEMA}.relationships", "array<variant>"), "relationships"), "case-links")
    sides = [rows.where(is_kind(F.col("one"), "OBJECT")).select("row", "case_id", _glued(F.col("subject"), f".{side}").alias("subject"), at("one", f"{side}_table", "string").alias("table"), at("one", f"{side}_column", "string").alias("column")) for side in ("referencing", "referred")]
    return [own, _said(rows, (ERROR, F.col("subject"), "no object", ~is_kind(F.col("one"), "OBJECT")))], sides[0].union(sides[1])


def distribution_findings(s: Shredded) -> tuple[list[DataFrame], DataFrame]:
    """Of keys, families, parameters and their values; references to columns apart."""
    each = stored(s.whole.select("row", "case_id", F.explode(at("v", DISTRIBUTIONS, "map<string,variant>")).alias("ref", "one")).withColumn("subject", F.col("ref")), "case-distributions")
    refs, odd = _dotted(each)
    cut = F.split("ref", r"\.")
    typed = each.where(F.size(cut) == 2).withColumn("table", cut[0]).withColumn("column", cut[1]).join(s.names, ["row", "table", "column"])
    family = F.coalesce(at("one", "distribution", "string"), at("one", "family", "string"))
    p = typed.withColumn("family", family).withColumn("p", at("one", "params", "map<string,variant>"))
    takes = F.create_map(*(x for f, names in PARAMETERS.items() for x in (F.lit(f), F.array(*map(F.lit, names)))))
    p = p.withColumn("takes", takes[F.col("family")]).withColumn("lacks", F.array_sort(F.array_except("takes", F.map_keys("p")))).withColumn("more", F.array_sort(F.array_except(F.map_keys("p"), F.col("takes"))))
    is_object, subject = is_kind(F.col("one"), "OBJECT"), F.col("subject")
    known = is_object & F.col("takes").isNotNull()
    fits = F.coalesce(known & (F.size("lacks") == 0) & (F.size("more") == 0), F.lit(False))
    number = {name: F.try_variant_get(F.col("p")[name], "$", "double") for names in PARAMETERS.values() for name in names if name != "weights"}
    checks = [
        (ERROR, subject, "no object", ~is_object),
        (ERROR, subject, _glued("no family ", F.col("family")), is_object & F.col("takes").isNull()),
        (ERROR, subject, "no params", known & F.col("p").isNull()),
        (ERROR, subject, _glued("lacks ", F.array_join("lacks", ", ")), known & (F.size("lacks") > 0)),
        (ERROR, subject, _glued("does not take ", F.array_join("more", ", ")), known & (F.size("more") > 0)),
        (WARNING, subject, _glued(F.col("family"), " over ", F.col("type")), fits & (F.col("family") != "categorical") & ~F.col("type").isin(*NUMERIC)),
    ]
    for (f, name), bound in ABOVE.items():
        of = fits & (F.col("family") == f)
        checks += [(ERROR, subject, f"{name} is no number", of & number[name].isNull()), (ERROR, subject, f"{name} is not above {bound}", of & (number[name] <= bound))]
    flat = fits & (F.col("family") == "uniform")
    checks += [(ERROR, subject, f"{n} is no number", flat & number[n].isNull()) for n in ("min", "max")]
    checks.append((ERROR, subject, "max is not above min", flat & (number["max"] <= number["min"])))
    weights = F.try_variant_get(F.col("p")["weights"], "$", "map<string,variant>")
    labels = p.where(fits & (F.col("family") == "categorical"))
    spread = labels.select("row", "case_id", "subject", F.explode_outer(weights).alias("label", "w")).withColumn("x", F.try_variant_get("w", "$", "double"))
    totals = spread.groupBy("row", "case_id", "subject").agg(
        F.count("label").alias("n"), F.count_if(F.col("label").isNotNull() & F.col("x").isNull()).alias("odd"), F.count_if(F.col("x") < 0).alias("negative"), F.sum("x").alias("sum"), F.count_if(F.col("label").try_cast("double").isNull() & F.col("label").isNotNull()).alias("words")
    )
    sound = (F.col("n") > 0) & (F.col("odd") == 0)
    mass = _said(
        totals,
        (ERROR, subject, "no weights", F.col("n") == 0),
        (ERROR, subject, "a weight is no number", F.col("odd") > 0),
        (ERROR, subject, "a weight is negative", sound & (F.col("negative") > 0)),
        (ERROR, subject, _glued("weights add up to ", F.format_number("sum", 4)), sound & (F.abs(F.col("sum") - 1) > WEIGHT_SLACK)),
        (WARNING, subject, "nominal labels", sound & (F.col("words") > 0)),
    )
    return [odd, _said(p, *checks), mass], refs


def _nodes(roots: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Of condition trees (row, case_id, subject, home, one): findings of inner nodes, and the leaves. A depth at a time, as long as there is one."""
    found, leaves = [], []
    level, kind, subject = roots, at("one", "type", "string"), F.col("subject")
    while not level.isEmpty():
        level = stored(level, "nodes")
        is_object = is_kind(F.col("one"), "OBJECT")
        branch, negated = is_object & F.coalesce(kind.isin("and", "or"), F.lit(False)), is_object & F.coalesce(kind == "not", F.lit(False))
        parts, inner = at("one", "conditions", "array<variant>"), at("one", "condition")
        column = at("one", "column", "string")
        leaf = is_object & ~branch & ~negated
        found.append(
            _said(
                level,
                (ERROR, subject, "no object", ~is_object),
                (ERROR, subject, _glued(kind, " has no conditions"), branch & (F.coalesce(F.size(parts), F.lit(0)) < 1)),
                (ERROR, subject, "not has no condition", negated & missing(inner)),
                (ERROR, subject, _glued("a leaf of type ", kind, " names no column"), leaf & column.isNull()),
            )
        )
        leaves.append(level.where(leaf & column.isNotNull()).withColumn("table", F.coalesce(text("one", "table_ref"), F.col("home"))))
        below = F.when(branch, parts).when(negated & ~missing(inner), F.array(inner))
        level = level.select("row", "case_id", "subject", "home", F.explode(below).alias("one"))
    return found, reduce(DataFrame.union, leaves) if leaves else roots.withColumn("table", F.col("home"))


def _ends(rows: DataFrame, join: Column, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Both ends of a join, whichever field it stands in."""
    there = rows.withColumn("j", join).where(~missing(F.col("j")))
    ends = there.where(is_kind(F.col("j"), "OBJECT")).select("row", "case_id", "subject", F.explode(F.array(*(F.struct(F.lit(e).alias("end"), text("j", e).alias("ref")) for e in ("from", "to")))).alias("e"))
    refs, odd = _dotted(ends.select("row", "case_id", _glued(F.col("subject"), f".{name}.", F.col("e.end")).alias("subject"), "e.ref"))
    return [_said(there, (ERROR, F.col("subject"), f"{name} is no object", ~is_kind(F.col("j"), "OBJECT"))), odd], refs


def constraint_findings(s: Shredded) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of constraints, their conditions down to the leaves, and what these compare with; references apart."""
    each = _numbered(s.whole, at("v", CONSTRAINTS, "array<variant>"), "constraint").withColumn("kind", at("one", "type", "string")).withColumn("table", at("one", "table", "string"))
    each = stored(each, "case-constraints")
    is_object, subject = is_kind(F.col("one"), "OBJECT"), F.col("subject")
    typed = is_object & F.coalesce(F.col("kind").isin("ifthen", "range"), F.lit(False))
    homes = stored(each.where(typed).join(s.known, ["row", "table"]).select("row", "case_id", "subject", "kind", "table", "one"), "constraints")
    low, high = (F.try_variant_get("one", f"$.{e}", "double") for e in ("min", "max"))
    has = {e: ~missing(at("one", e)) for e in ("min", "max", "condition", "result")}
    ranges, rules = F.col("kind") == "range", F.col("kind") == "ifthen"
    both = ranges & has["min"] & has["max"]
    found = [
        _said(each, (ERROR, subject, "no object", ~is_object), (ERROR, subject, _glued("no type ", F.col("kind")), is_object & ~typed)),
        _said(
            homes,
            (ERROR, subject, "neither min nor max", ranges & ~has["min"] & ~has["max"]),
            (ERROR, subject, "min or max is no number", both & (low.isNull() | high.isNull())),
            (ERROR, subject, "max is below min", both & (high < low)),
            (ERROR, subject, "no condition", rules & ~has["condition"]),
            (ERROR, subject, "no result", rules & ~has["result"]),
        ),
    ]
    refs = [homes.where(ranges).select("row", "case_id", "subject", "table", at("one", "column", "string").alias("column"))]
    lost = each.where(typed).join(s.known, ["row", "table"], "left_anti")
    found.append(_said(lost, (ERROR, subject, _glued("no table ", F.col("table")), F.lit(True))))
    roots = [homes.where(w & has[f]).select("row", "case_id", _glued(subject, suffix).alias("subject"), F.col("table").alias("home"), at("one", f).alias("one")) for w, f, suffix in ((ranges, "condition", ""), (rules, "condition", ".condition"), (rules, "result", ".result"))]
    inner, leaves = _nodes(reduce(DataFrame.union, roots))
    refs.append(leaves.select("row", "case_id", "subject", "table", at("one", "column", "string").alias("column")))
    sound = stored(leaves.join(s.known, ["row", "table"]).select("row", "case_id", "subject", "table", "one"), "leaves")
    forms = F.array_compact(F.array(*(F.when(at("one", f).isNotNull(), F.lit(f)) for f in ("value", "rhs_column", "rhs_expr"))))
    sound = sound.withColumn("forms", forms)
    found += [*inner, _said(sound, (ERROR, subject, "no right side", F.size("forms") == 0), (ERROR, subject, _glued("several right sides: ", F.array_join("forms", ", ")), F.size("forms") > 1))]
    columns = sound.where((F.size("forms") == 1) & (F.col("forms")[0] == "rhs_column"))
    refs.append(columns.select("row", "case_id", _glued(subject, ".rhs").alias("subject"), F.coalesce(text("one", "rhs_table_ref"), F.col("table")).alias("table"), at("one", "rhs_column", "string").alias("column")))
    steps = sound.where((F.size("forms") == 1) & (F.col("forms")[0] == "rhs_expr")).withColumn("e", at("one", "rhs_expr"))
    is_step = is_kind(F.col("e"), "OBJECT")
    operands = F.array_compact(F.array(*(F.when(at("e", f).isNotNull(), F.lit(f)) for f in ("value", "rhs_column"))))
    found.append(
        _said(
            steps,
            (ERROR, subject, "rhs_expr is no object", ~is_step),
            (ERROR, subject, _glued("no arithmetic operator ", at("e", "op", "string")), is_step & ~F.coalesce(at("e", "op", "string").isin("+", "-", "*", "/"), F.lit(False))),
            (ERROR, subject, "rhs_expr needs a value or a rhs_column", is_step & (F.size(operands) != 1)),
        )
    )
    steps = steps.where(is_step).withColumn("et", F.coalesce(text("e", "table_ref"), F.col("table")))
    refs.append(steps.select("row", "case_id", _glued(subject, ".rhs_expr").alias("subject"), F.col("et").alias("table"), at("e", "column", "string").alias("column")))
    other = steps.where((F.size(operands) == 1) & (operands[0] == "rhs_column"))
    refs.append(other.select("row", "case_id", _glued(subject, ".rhs_expr.rhs").alias("subject"), F.coalesce(text("e", "rhs_table_ref"), F.col("et")).alias("table"), at("e", "rhs_column", "string").alias("column")))
    for rows, join, name in ((sound, at("one", "join"), "join"), (columns, at("one", "rhs_join"), "rhs_join"), (steps, at("e", "join"), "rhs_expr.join")):
        more, ends = _ends(rows, join, name)
        found += more
        refs.append(ends)
    return found, refs


def dependency_findings(s: Shredded) -> tuple[list[DataFrame], DataFrame]:
    each = stored(_numbered(s.whole, at("v", DEPENDENCIES, "array<variant>"), DEPENDENCIES), "case-dependencies")
    sides = F.explode(F.array(*(F.struct(F.lit(e).alias("side"), at("one", e, "array<variant>").alias("refs")) for e in ("determinant", "dependent")))).alias("x")
    is_object = is_kind(F.col("one"), "OBJECT")
    named = each.where(is_object).select("row", "case_id", "subject", sides).select("row", "case_id", _glued(F.col("subject"), ".", F.col("x.side")).alias("subject"), "x.refs")
    listed = named.select("row", "case_id", "subject", F.explode("refs").alias("r"))
    refs, odd = _dotted(listed.select("row", "case_id", "subject", F.when(is_kind(F.col("r"), "STRING"), F.try_variant_get("r", "$", "string")).alias("ref")))
    return [_said(each, (ERROR, F.col("subject"), "no object", ~is_object)), _said(named, (ERROR, F.col("subject"), "no list of columns", F.coalesce(F.size("refs"), F.lit(0)) < 1)), odd], refs


def moment_findings(s: Shredded) -> tuple[list[DataFrame], DataFrame]:
    """A moment needs a number and a quote that the text holds, save for case and white space, and the quote must be read right."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    said = s.whole.withColumn("said", plain(F.coalesce(text("v", TEXT), F.lit(""))))
    each = _numbered(said, at("v", MOMENTS, "array<variant>"), MOMENTS, "said")
    each = each.select("*", at("one", "aggregate", "string").alias("fn"), at("one", "column", "string").alias("column"), at("one", "table", "string").alias("table"), at("one", "value", "string").alias("value"), text("one", "evidence").alias("quote"))
    told = F.contains(F.col("said"), plain(F.col("quote")))  # where there is a quote
    each = stored(each.withColumn("told", told).drop("said"), "case-moments")
    is_object, subject = is_kind(F.col("one"), "OBJECT"), F.col("subject")
    number = F.regexp_like(F.coalesce(F.schema_of_variant(at("one", "value")), F.lit("")), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
    quoted = is_object & (F.trim(F.coalesce("quote", F.lit(""))) != "")
    held = quoted & F.col("told")
    low = F.lower("quote")
    logs = F.contains(low, F.lit("log-mean")) | F.contains(low, F.lit("log mean")) | (F.contains(low, F.lit("log space")) & F.contains(low, F.lit("mean")))
    percent = F.contains(low, F.lit("per cent")) | F.contains(low, F.lit("percent"))
    digits = F.regexp_replace(F.regexp_replace("value", "0+$", ""), r"\.$", "")
    own = _said(
        each,
        (ERROR, subject, "no object", ~is_object),
        (ERROR, subject, _glued("no aggregate ", F.col("fn")), is_object & ~F.coalesce(F.col("fn").isin(*AGGREGATES), F.lit(False))),
        (ERROR, subject, "value is no number", is_object & ~number),
        (ERROR, subject, "no evidence", is_object & ~quoted),
        (ERROR, subject, "evidence is not in the text", quoted & ~held),
        (ERROR, subject, "a parameter of logarithms read as an average", held & logs),
        (ERROR, subject, "a percentage read as a count", held & (F.col("fn") == "count") & percent & ~F.contains(F.regexp_replace(low, ",", ""), F.coalesce(digits, F.lit("none")))),
        (ERROR, subject, "an average of ids", held & (F.col("fn") == "avg") & F.lower("column").endswith("_id")),
    )
    of = _glued(F.col("fn"), "(", F.col("table"), ".", F.col("column"), ")")
    several = each.where(is_object).groupBy("row", "case_id", of.alias("of")).agg(F.count_distinct(F.coalesce("value", F.lit("null"))).alias("n"))
    return [own, _said(several, (ERROR, MOMENTS, _glued(F.col("of"), " has ", F.col("n"), " values"), F.col("n") > 1))], each.where(is_object).select("row", "case_id", "subject", "table", "column")


def validate(lines: DataFrame) -> DataFrame:
    """case_id, level, subject, detail: the findings of JSON lines (value), a case each. Blank lines are none; no lines, no findings.

    Lines that are no JSON or no object have a null case_id, cases without an id
    have `?`. Rows that repeat are cases of their own, with an id that repeats.
    """
    s = Shredded(lines)
    found = [*case_findings(s), *schema_findings(s)]
    refs = []
    for part in (link_findings, distribution_findings, dependency_findings, moment_findings):
        more, own = part(s)
        found += more
        refs.append(own)
    more, own = constraint_findings(s)
    found += [*more, s.unknown(reduce(DataFrame.union, [*refs, *own]))]
    return reduce(DataFrame.union, found).select(*FINDING)
