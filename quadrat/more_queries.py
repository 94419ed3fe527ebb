"""Further queries of the linear-model operators, each with SQL that solves the same problem another way."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from . import oracles as o
from .functions import distributions
from .operators.absorb import absorb
from .operators.akm import akm_kss, bipartite, leave_out_set, matches
from .operators.decompose import decompose
from .operators.graph import absorbed, largest_pair, mobility_profile
from .operators.groups import fit_groups, shared_singletons
from .operators.model import feols, fit, partial_out
from .operators.sample import collapse
from .queries import Y, _lines, _table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _six(x):
    return x if x is None or isinstance(x, (str, bool, int)) else float(f"{x:.6g}") if math.isfinite(x) else None


def _rows(spark, rows: list[tuple], schema: str):
    return spark.createDataFrame([tuple(map(_six, r)) for r in rows], schema)


def _terms(r, names: list[str] | None = None):
    """Terms with their standard errors, by default all but the constant."""
    rows = [(t["term"], t["coef"], t["se"], r.n) for t in r.tidy() if (t["term"] in names if names else t["term"] != "_cons")]
    return _rows(r.sample.sparkSession, rows, "term string, coef double, se double, n long")


# formulas and designs

_WITHIN = "{0} - avg({0}) OVER p"


@query(
    o.least_squares(
        f"SELECT {_WITHIN.format('l_extendedprice')} AS y, {_WITHIN.format('l_quantity')} AS x1, {_WITHIN.format('l_discount')} AS x2, {_WITHIN.format('(l_quantity * l_discount)')} AS x3, 1.0 AS w FROM (SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_partkey) > 1) WINDOW p AS (PARTITION BY l_partkey)",
        3, "3 + (SELECT count(*) FROM (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) > 1))", "robust",
    )
    + o.terms(["l_quantity", "l_discount", "l_quantity:l_discount"])
)
def formula_interaction(spark, d):
    return _terms(feols("l_extendedprice ~ l_quantity*l_discount | l_partkey", _lines(spark, d), se_type="robust"))


_CATEGORY = "CASE WHEN l_returnflag = '{}' THEN 1.0 ELSE 0.0 END"


@query(
    o.least_squares(
        f"SELECT {_WITHIN.format('l_extendedprice')} AS y, {_WITHIN.format('l_quantity')} AS x1, {_WITHIN.format(_CATEGORY.format('N'))} AS x2, {_WITHIN.format(_CATEGORY.format('R'))} AS x3, 1.0 AS w FROM (SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_suppkey, l_linestatus) > 1) WINDOW p AS (PARTITION BY l_suppkey, l_linestatus)".replace("CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END - avg(", "CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END - avg("),
        3, "3 + (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_suppkey, l_linestatus HAVING count(*) > 1))",
    )
    + o.terms(["l_quantity", "l_returnflag[N]", "l_returnflag[R]"])
)
def formula_categorical(spark, d):
    df = _table(spark, d, "lineitem").select("l_extendedprice", "l_quantity", "l_returnflag", "l_suppkey", "l_linestatus")
    return _terms(feols("l_extendedprice ~ l_quantity + C(l_returnflag) | l_suppkey^l_linestatus", df))


_LOGS = o.least_squares("SELECT ln(l_extendedprice) AS y, pow(l_quantity, 2)::DOUBLE AS x1, l_tax AS x2, l_discount AS x3, 1.0 AS x4, 1.0 AS w FROM lineitem", 4, "4")


@query(_LOGS + " UNION ALL ".join(f"SELECT '{t}' AS term, {o.sig(f'b{i}')} AS coef, {o.sig(f'b{i} / sqrt(c{i}_{i})')} AS t, {o.sig(f'b{i} - {o.student_quantile('(n - 4)')} * sqrt(c{i}_{i})')} AS low, {o.sig(f'b{i} + {o.student_quantile('(n - 4)')} * sqrt(c{i}_{i})')} AS high, round(greatest({o.student_tail(f'b{i} / sqrt(c{i}_{i})', '(n - 4)')}, 0.0), 6) + 0.0 AS p FROM s" for i, t in enumerate(["I(l_quantity**2)", 'Q("l_tax")', "l_discount", "_cons"], 1)))
def formula_inference(spark, d):
    r = feols('log(l_extendedprice) ~ I(l_quantity**2) + Q("l_tax") + l_discount', _lines(spark, d).withColumn("log(l_extendedprice)", F.log("l_extendedprice")))
    return _rows(spark, [(t["term"], t["coef"], t["t"], t["low"], t["high"], round(t["p"], 6) + 0.0) for t in r.tidy()], "term string, coef double, t double, low double, high double, p double")


@query(
    o.least_squares(
        "SELECT l_extendedprice - avg(l_extendedprice) OVER p AS y, l_quantity - avg(l_quantity) OVER p AS x1, 1.0 AS w FROM (SELECT * FROM lineitem WHERE l_tax <> 0.08 AND l_linenumber < 6 QUALIFY count(*) OVER (PARTITION BY l_partkey) > 1) WINDOW p AS (PARTITION BY l_partkey)",
        1, "1 + (SELECT count(*) FROM (SELECT 1 FROM lineitem WHERE l_tax <> 0.08 AND l_linenumber < 6 GROUP BY l_partkey HAVING count(*) > 1))",
    )
    + o.terms(["l_quantity"])
)
def missing_and_subset(spark, d):
    df = _lines(spark, d).withColumn("l_extendedprice", F.when(F.col("l_tax") != 0.08, F.col("l_extendedprice")))
    return _terms(feols("l_extendedprice ~ l_quantity | l_partkey", df, subset="l_linenumber < 6", na_action="drop"))


@query(
    o.least_squares("SELECT l_extendedprice - avg(l_extendedprice) OVER p AS y, l_quantity - avg(l_quantity) OVER p AS x1, l_discount - avg(l_discount) OVER p AS x2, 1.0 AS w FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WINDOW p AS (PARTITION BY l_suppkey)", 2, "2 + (SELECT count(DISTINCT l_suppkey) FROM lineitem)")
    + f"SELECT 'l_quantity' AS term, {o.sig('b1')} AS coef, {o.sig('sqrt(c1_1)')} AS se, '' AS omitted FROM s UNION ALL SELECT 's_acctbal', 0.0, NULL, 'explained by the effects' FROM s UNION ALL SELECT 'l_discount', {o.sig('b2')}, {o.sig('sqrt(c2_2)')}, '' FROM s UNION ALL SELECT 'both', 0.0, NULL, 'collinear' FROM s"
)
def omitted_columns(spark, d):
    df = _lines(spark, d).join(_table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("both", F.col("l_quantity") - 3 * F.col("l_discount") + F.col("s_acctbal"))
    r = fit(df, Y, ["l_quantity", "s_acctbal", "l_discount", "both"], ["l_suppkey"])
    return _rows(spark, [(t["term"], t["coef"], t["se"], r.omitted.get(t["term"], "")) for t in r.tidy() if t["term"] != "_cons"], "term string, coef double, se double, omitted string")


# degrees of freedom

_CUSTOMERS = "(SELECT * FROM orders JOIN customer ON c_custkey = o_custkey QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1)"


def _ordered(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.dayofyear("o_orderdate").cast("double").alias("day")).join(_table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))


@query("SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT c_nationkey) AS nations, 0 AS customers_redundant, count(DISTINCT c_nationkey) AS nations_redundant, count(DISTINCT o_custkey) AS df_a FROM orders JOIN customer ON c_custkey = o_custkey")
def nested_dof(spark, d):
    told = absorbed(_ordered(spark, d), ["o_custkey", "c_nationkey"])
    return _rows(spark, [(*told["levels"], *told["redundant"], told["df_a"])], "customers long, nations long, customers_redundant long, nations_redundant long, df_a long")


@query(
    o.least_squares(f"SELECT c_nationkey, o_totalprice - avg(o_totalprice) OVER p AS y, dayofyear(o_orderdate) - avg(dayofyear(o_orderdate)) OVER p AS x1, avg(dayofyear(o_orderdate)) OVER () AS mx, avg(o_totalprice) OVER () AS my, 1.0 AS w FROM {_CUSTOMERS} WINDOW p AS (PARTITION BY o_custkey)", 1, "2", "cluster", ["c_nationkey"], constant=["mx"])
    + f"SELECT 'day' AS term, {o.sig('b1')} AS coef, {o.sig('sqrt(c1_1)')} AS se, n::BIGINT AS n FROM s UNION ALL SELECT '_cons', {o.sig('(SELECT any_value(my) FROM d) - mean1 * b1')}, {o.sig('sqrt(c2_2)')}, n::BIGINT FROM s"
)
def nested_cluster(spark, d):
    """Effects that the clusters nest take up no degrees of freedom; the recovered constant has a variance."""
    return _terms(fit(_ordered(spark, d), "o_totalprice", ["day"], ["o_custkey"], clusters=["c_nationkey"], se_type="cluster"), ["day", "_cons"])


def _cons_sql(vce: str, by: list[str] = ()) -> str:
    rows = "SELECT l_suppkey, l_extendedprice - avg(l_extendedprice) OVER p AS y, l_quantity - avg(l_quantity) OVER p AS x1, l_discount - avg(l_discount) OVER p AS x2, avg(l_quantity) OVER () AS mx1, avg(l_discount) OVER () AS mx2, avg(l_extendedprice) OVER () AS my, 1.0 AS w FROM (SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_partkey) > 1) WINDOW p AS (PARTITION BY l_partkey)"
    return o.least_squares(rows, 2, "2 + (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_partkey HAVING count(*) > 1))", vce, by, constant=["mx1", "mx2"]) + f"SELECT '{vce}' AS vce, {o.sig('(SELECT any_value(my) FROM d) - mean1 * b1 - mean2 * b2')} AS cons, {o.sig('sqrt(c3_3)')} AS se FROM s"


@query(" UNION ALL ".join(f"SELECT * FROM ({_cons_sql(v, b)})" for v, b in (("unadjusted", []), ("robust", []), ("cluster", ["l_suppkey"]))))
def constant_inference(spark, d):
    out, rows, work = [], _lines(spark, d), {}
    for vce in ("cluster", "unadjusted", "robust"):  # the first keeps the clusters' ids
        r = fit(rows, Y, ["l_quantity", "l_discount"], ["l_partkey"], se_type=vce, clusters=["l_suppkey"] if vce == "cluster" else [], work=work)
        out.append((vce, float(r.coef[-1]), float(r.se[-1])))
    return _rows(spark, out, "vce string, cons double, se double")


def _ssc_sql(name: str, factor: str) -> str:
    rows = "SELECT l_suppkey, l_extendedprice - avg(l_extendedprice) OVER p AS y, l_quantity - avg(l_quantity) OVER p AS x1, 1.0 AS w FROM (SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_partkey) > 1) WINDOW p AS (PARTITION BY l_partkey)"
    return f"SELECT * FROM ({o.least_squares(rows, 1, '(SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_partkey HAVING count(*) > 1))', 'cluster', ['l_suppkey'], factor=factor)} SELECT '{name}' AS options, {o.sig('sqrt(c1_1)')} AS se FROM s)"


_SSC = {"K.adj=0": "gc / (gc - 1)", "K.fixef=none": "gc / (gc - 1) * (n - 1) / (n - 1 - 1)", "K.fixef=full": "gc / (gc - 1) * (n - 1) / (n - 1 - k_used)", "G.adj=0": "(n - 1) / (n - 1 - k_used)", "K.adj=0 G.adj=0": "1.0"}


@query(" UNION ALL ".join(_ssc_sql(k, v) for k, v in _SSC.items()))
def small_sample_options(spark, d):
    out, rows, work = [], _lines(spark, d), {}
    for options in _SSC:
        r = fit(rows, Y, ["l_quantity"], ["l_partkey"], clusters=["l_suppkey"], se_type="cluster", ssc=options, work=work)
        out.append((options, float(r.se[0])))
    return _rows(spark, out, "options string, se double")


@query(
    o.least_squares("SELECT l_extendedprice - sum(l_quantity*l_extendedprice) OVER p / sum(l_quantity) OVER p AS y, l_discount - sum(l_quantity*l_discount) OVER p / sum(l_quantity) OVER p AS x1, l_tax - sum(l_quantity*l_tax) OVER p / sum(l_quantity) OVER p AS x2, l_quantity AS w FROM (SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_partkey) > 1) WINDOW p AS (PARTITION BY l_partkey)", 2, "2 + (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_partkey HAVING count(*) > 1))", "robust")
    + o.terms(["l_discount", "l_tax"])
)
def probability_weights(spark, d):
    return _terms(fit(_lines(spark, d), Y, ["l_discount", "l_tax"], ["l_partkey"], weights="l_quantity", weight_kind="p"))


# two-stage least squares with more instruments than needed

_IV = """WITH s0 AS (SELECT *, l_quantity + 10 * l_tax AS z1, l_quantity * l_quantity AS z2 FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_partkey) > 1),
t AS MATERIALIZED (SELECT l_extendedprice - avg(l_extendedprice) OVER p AS y, l_discount - avg(l_discount) OVER p AS x, l_quantity - avg(l_quantity) OVER p AS q, z1 - avg(z1) OVER p AS z1, z2 - avg(z2) OVER p AS z2 FROM s0 WINDOW p AS (PARTITION BY l_partkey)),
f0 AS MATERIALIZED (SELECT sum(x*x) AS g1_1, sum(x*z1) AS g1_2, sum(x*z2) AS g1_3, sum(z1*z1) AS g2_2, sum(z1*z2) AS g2_3, sum(z2*z2) AS g3_3, sum(x*q) AS h1, sum(z1*q) AS h2, sum(z2*q) AS h3, sum(q*q) AS qq FROM t), """ + o.inverted(3, "f0", "f1") + """,
f AS MATERIALIZED (SELECT v1_1*h1 + v1_2*h2 + v1_3*h3 AS p1, v2_1*h1 + v2_2*h2 + v2_3*h3 AS p2, v3_1*h1 + v3_2*h2 + v3_3*h3 AS p3 FROM f1),
q AS MATERIALIZED (SELECT y, x, q, p1*x + p2*z1 + p3*z2 AS qh FROM t, f),
g AS MATERIALIZED (SELECT sum(x*x) AS a, sum(x*qh) AS b, sum(qh*qh) AS c, sum(x*y) AS h1, sum(qh*y) AS h2, count(*) AS n, (SELECT count(DISTINCT l_partkey) FROM s0) AS k FROM q),
b AS MATERIALIZED (SELECT *, (c*h1 - b*h2) / (a*c - b*b) AS b1, (a*h2 - b*h1) / (a*c - b*b) AS b2 FROM g),
r AS MATERIALIZED (SELECT any_value(n) AS n, any_value(b1) AS b1, any_value(b2) AS b2, any_value(c / (a*c - b*b)) AS i1, any_value(a / (a*c - b*b)) AS i2, sum((y - b1*x - b2*q) * (y - b1*x - b2*q)) / (any_value(n) - 2 - any_value(k)) AS s2 FROM q, b),
pr AS (SELECT 1 - sum((q - qh) * (q - qh)) / (sum(q*q) - sum(x*q) * sum(x*q) / sum(x*x)) AS partial_r2 FROM q)
"""


@query(_IV + f"SELECT 'l_discount' AS term, {o.sig('b1')} AS coef, {o.sig('sqrt(s2 * i1)')} AS se, NULL::DOUBLE AS partial_r2, n::BIGINT AS n FROM r UNION ALL SELECT 'l_quantity', {o.sig('b2')}, {o.sig('sqrt(s2 * i2)')}, {o.sig('partial_r2')}, n::BIGINT FROM r, pr")
def iv_over_identified(spark, d):
    df = _lines(spark, d).withColumn("z1", F.col("l_quantity") + 10 * F.col("l_tax")).withColumn("z2", F.col("l_quantity") ** 2)
    r = feols("l_extendedprice ~ l_discount | l_partkey | l_quantity ~ z1 + z2", df)
    return _rows(spark, [(t["term"], t["coef"], t["se"], r.iv["partial_r2"].get(t["term"]), r.n) for t in r.tidy() if t["term"] != "_cons"], "term string, coef double, se double, partial_r2 double, n long")


# what a fit tells

_TWO = "SELECT l_orderkey, l_linenumber, l_extendedprice AS raw, l_quantity AS r1, l_discount AS r2, l_extendedprice - avg(l_extendedprice) OVER p AS y, l_quantity - avg(l_quantity) OVER p AS x1, l_discount - avg(l_discount) OVER p AS x2, 1.0 AS w FROM (SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_partkey) > 1) WINDOW p AS (PARTITION BY l_partkey)"
_TWO_K = "2 + (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_partkey HAVING count(*) > 1))"


@query(
    o.least_squares(_TWO, 2, _TWO_K, extra=", c AS (SELECT avg(raw) - b1 * avg(r1) - b2 * avg(r2) AS cons, stddev(raw) AS sd FROM d, b GROUP BY b1, b2) ")
    + "SELECT round(sum(xb) / any_value(sd) / count(*), 6) AS xb, round(sum(xb * r1) / any_value(sd) / count(*), 5) AS xb_by_quantity, round(sum(dd * dd) / any_value(sd * sd) / count(*), 6) AS d2, round(sum(u * raw) / any_value(sd * sd) / count(*), 6) AS residual_by_y, round(sum((raw - u) * raw) / any_value(sd * sd) / count(*), 5) AS xbd_by_y, round(sum((raw - xb) * r1) / any_value(sd) / count(*), 5) AS dresiduals_by_quantity FROM (SELECT raw, r1, u, cons + b1 * r1 + b2 * r2 AS xb, raw - u - (cons + b1 * r1 + b2 * r2) AS dd, sd FROM e, b, c)"
)
def predictions(spark, d):
    r = fit(_lines(spark, d), Y, ["l_quantity", "l_discount"], ["l_partkey"])
    base = r.sample.select("__y")
    parts = {k: r.predict(k).select(F.col(k).alias("v"), "__y", "l_quantity") for k in ("xb", "d", "residuals", "xbd", "dresiduals")}
    sd, n = base.agg(F.stddev("__y"), F.count(F.lit(1))).first()
    one = lambda k, x: float(parts[k].agg(F.sum(x)).first()[0])
    row = (round(one("xb", F.col("v")) / sd / n, 6), round(one("xb", F.col("v") * F.col("l_quantity")) / sd / n, 5), round(one("d", F.col("v") ** 2) / sd**2 / n, 6), round(one("residuals", F.col("v") * F.col("__y")) / sd**2 / n, 6), round(one("xbd", F.col("v") * F.col("__y")) / sd**2 / n, 5), round(one("dresiduals", F.col("v") * F.col("l_quantity")) / sd / n, 5))
    return spark.createDataFrame([row], "xb double, xb_by_quantity double, d2 double, residual_by_y double, xbd_by_y double, dresiduals_by_quantity double")


_STATS = {"N": "n", "r2": "1 - rss / tss", "adj_r2": "1 - rss / tss * (n - 1) / (n - k_used)", "adj_r2_within": "1 - rss / tw * (n - k_used + 2) / (n - k_used)", "ll_0": "-0.5 * n * (1 + ln(2 * pi()) + ln(tw / n))", "aic": "2 * k_used + n * (1 + ln(2 * pi()) + ln(rss / n))", "bic": "ln(n) * k_used + n * (1 + ln(2 * pi()) + ln(rss / n))", "df_r": "n - k_used", "df_a": "k_used - 2"}


@query(o.least_squares(_TWO, 2, _TWO_K, extra=", t AS (SELECT s.*, (SELECT var_pop(raw) * count(*) FROM d) AS tss, (SELECT sum(y*y) FROM d) AS tw FROM s) ") + " UNION ALL ".join(f"SELECT '{k}' AS statistic, {o.sig(v)} AS value FROM t" for k, v in _STATS.items()))
def fit_information(spark, d):
    r = fit(_lines(spark, d), Y, ["l_quantity", "l_discount"], ["l_partkey"])
    told = {k: r.stat(k) for k in _STATS if k != "ll_0"} | {"ll_0": r.information()["ll_0"]}
    return _rows(spark, [(k, float(v)) for k, v in told.items()], "statistic string, value double")


@query(" UNION ALL ".join(f"SELECT '{name}' AS variable, {o.sig(f'avg({c})', 5)} AS mean, {o.sig(f'stddev({c})', 5)} AS sd, min({c})::DOUBLE AS least, max({c})::DOUBLE AS greatest FROM (SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_partkey) > 1)" for name, c in (("y", Y), ("l_quantity", "l_quantity"), ("l_discount", "l_discount"))))
def sample_summary(spark, d):
    out = fit(_lines(spark, d), Y, ["l_quantity", "l_discount"], ["l_partkey"]).summarize()
    six = lambda c: F.expr(f"cast(printf('%.4e', {c}) AS double)").alias(c)
    return out.select("variable", six("mean"), six("sd"), "least", "greatest")


# recovered effects

#: Suppliers by turns: seven levels, all rows.
_DEPOTS, _LINES = range(7), "(SELECT *, l_suppkey % 7 AS depot FROM lineitem)"


def _depot_rows(table: str = _LINES, key: str = "l_partkey", weight: str = "1.0") -> str:
    """Rows of y, and dummies of all depots but the last, less their means in each key."""
    mean = lambda c: f"{c} - sum({weight} * {c}) OVER p / sum({weight}) OVER p"
    dummies = ", ".join(f"{mean(f'(CASE WHEN depot = {m} THEN 1.0 ELSE 0.0 END)')} AS x{i}" for i, m in enumerate(_DEPOTS[:-1], 1))
    return f"SELECT l_orderkey, l_linenumber, {key}, depot, l_extendedprice AS raw, {mean('l_extendedprice')} AS y, {dummies}, {weight} AS w FROM {table} WINDOW p AS (PARTITION BY {key})"


_PSI = "(CASE depot " + " ".join(f"WHEN {m} THEN b{i}" for i, m in enumerate(_DEPOTS[:-1], 1)) + " ELSE 0.0 END)"


def _shipped(spark, d):
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 7).alias("depot"), Y, "l_quantity", "l_discount")


@query(o.least_squares(_depot_rows(f"(SELECT * FROM {_LINES} QUALIFY count(*) OVER (PARTITION BY l_partkey) > 1)"), 6, "6") + f"SELECT depot, round((any_value(psi) - any_value(m)) / any_value(sd), 6) AS effect FROM (SELECT depot, {_PSI} AS psi, avg({_PSI}) OVER () AS m, stddev(raw) OVER () AS sd FROM d, b) GROUP BY depot")
def fixef_twoway(spark, d):
    df = _shipped(spark, d)
    r = fit(df, Y, [], list(largest_pair(df, ["depot", "l_partkey"])), retain_fes=True, aliases=["part", "of_depot"])
    sd = r.sample.agg(F.stddev("__y")).first()[0]
    return r.fixef().groupBy("depot").agg(F.round(F.avg("of_depot") / sd, 6).alias("effect"))


@query(o.least_squares(_depot_rows(weight="l_quantity"), 6, "6") + "SELECT l_orderkey, l_linenumber, round(u / (SELECT stddev(raw) FROM d), 6) + 0.0 AS price_tilde FROM e")
def partial_out_weighted(spark, d):
    df = _shipped(spark, d)
    sd = df.agg(F.stddev(Y)).first()[0]
    return partial_out(df, [Y], ["l_partkey", "depot"], weights="l_quantity").select("l_orderkey", "l_linenumber", (F.round(F.col(f"{Y}_tilde") / sd, 6) + 0.0).alias("price_tilde"))


@query(f"SELECT * FROM (SELECT 'l_partkey' AS effect, l_partkey::VARCHAR AS level, 0.0::DOUBLE AS left_over FROM lineitem UNION SELECT 'depot', depot::VARCHAR, 0.0::DOUBLE FROM {_LINES})")
def certificate_levels(spark, d):
    """What a two-way absorption leaves in each level, in standard deviations of the column."""
    df = _shipped(spark, d)
    sd = df.agg(F.stddev(Y)).first()[0]
    out, _ = absorb(df, [Y], ["l_partkey", "depot"])
    some = [out.groupBy(k).agg((F.abs(F.round(F.sum(f"{Y}_tilde") / sd, 6)) + 0.0).alias("left_over")).select(F.lit(k).alias("effect"), F.col(k).cast("string").alias("level"), "left_over") for k in ("l_partkey", "depot")]
    return some[0].unionByName(some[1])


@query("SELECT l_suppkey, round(regr_intercept(l_extendedprice, l_tax) / (SELECT stddev(l_extendedprice) FROM lineitem), 6) AS level, round(regr_slope(l_extendedprice, l_tax) / (SELECT stddev(l_extendedprice) FROM lineitem), 5) AS slope FROM lineitem GROUP BY l_suppkey")
def slope_effects(spark, d):
    r = feols("l_extendedprice ~ l_tax | l_suppkey##c.l_tax", _lines(spark, d), retain_fes=True)  # l_tax is omitted
    sd = r.sample.agg(F.stddev("__y")).first()[0]
    fitted = r.fixef().withColumn("fitted", F.col("fe1") + F.lit(float(r.coef[-1])))
    return fitted.groupBy("l_suppkey").agg(F.round(F.expr("regr_intercept(fitted, l_tax)") / sd, 6).alias("level"), F.round(F.expr("regr_slope(fitted, l_tax)") / sd, 5).alias("slope"))


# graphs that split

def _jobs(spark, d):
    """Customers as spells: the worker is the account balance in steps of five, the firm five customers in a row."""
    return _table(spark, d, "customer").select("c_custkey", F.floor(F.col("c_acctbal") / 5).alias("worker"), F.floor((F.col("c_custkey") - 1) / 5).alias("firm"), F.col("c_acctbal").cast("double").alias("pay"))


_JOBS = "(SELECT c_custkey, floor(c_acctbal / 5)::BIGINT AS worker, floor((c_custkey - 1) / 5)::BIGINT AS firm, c_acctbal::DOUBLE AS pay FROM customer)"
_PARTS = o.components(f"SELECT firm AS a, worker AS b FROM {_JOBS}")


@query(f"WITH RECURSIVE {_PARTS}, z AS (SELECT component, count(*) AS n FROM {_JOBS} JOIN cc ON node = firm GROUP BY component) SELECT (SELECT count(DISTINCT worker) FROM {_JOBS}) AS workers, (SELECT count(DISTINCT firm) FROM {_JOBS}) AS firms, (SELECT count(DISTINCT worker) + count(DISTINCT firm) FROM {_JOBS}) - count(*) AS df_a, count(*) AS components, round(max(n) / sum(n), 6) AS largest_share, CASE WHEN max(n) >= 0.9 * sum(n) THEN 'high' WHEN max(n) >= 0.5 * sum(n) THEN 'moderate' ELSE 'low' END AS class FROM z")
def split_graph_dof(spark, d):
    df = _jobs(spark, d)
    told, profile = absorbed(df, ["worker", "firm"]), mobility_profile(df, "worker", "firm")
    return spark.createDataFrame([(*told["levels"], told["df_a"], profile["components"], round(profile["largest_share"], 6), profile["class"])], "workers long, firms long, df_a long, components long, largest_share double, class string")


def _leave_out_sql(rounds: int = 5) -> str:
    """The leave-out set by brute force: each worker is left out in turn, and those without whom firms part go, again and again."""
    largest = lambda name, e: f"{name} AS MATERIALIZED (SELECT component FROM {e} JOIN {name}c ON node = a GROUP BY component ORDER BY count(DISTINCT a) DESC, sum(t) DESC, component LIMIT 1)"
    part = lambda name, e: f"{name}r(node, seen) AS (SELECT a, a FROM {e} UNION SELECT r.node, y.a FROM {name}r r JOIN {e} x ON x.a = r.seen JOIN {e} y ON y.b = x.b), {name}c AS MATERIALIZED (SELECT node, min(seen) AS component FROM {name}r GROUP BY node)"
    out = [f"e0 AS MATERIALIZED (SELECT firm AS a, worker AS b, count(*) AS t FROM {_JOBS} GROUP BY ALL)", part("p0", "e0"), largest("p0", "e0"), "k0 AS MATERIALIZED (SELECT e0.* FROM e0 JOIN p0c ON node = a JOIN p0 USING (component))"]
    for n in range(rounds):
        k = f"k{n}"
        out += [
            f"m{n} AS MATERIALIZED (SELECT b FROM {k} GROUP BY b HAVING count(*) > 1)",
            f"f{n} AS MATERIALIZED (SELECT min(a) AS a, count(DISTINCT a) AS n FROM {k})",
            # firms reached from the first one without worker w
            f"r{n}(w, a) AS (SELECT m{n}.b, f{n}.a FROM m{n}, f{n} UNION SELECT r.w, y.a FROM r{n} r JOIN {k} x ON x.a = r.a AND x.b <> r.w JOIN {k} y ON y.b = x.b)",
            f"c{n} AS MATERIALIZED (SELECT w FROM r{n} GROUP BY w HAVING count(*) < (SELECT n FROM f{n}))",
            f"e{n + 1} AS MATERIALIZED (SELECT * FROM {k} WHERE b NOT IN (SELECT w FROM c{n}) UNION ALL SELECT a, NULL, 0 FROM (SELECT DISTINCT a FROM {k}) WHERE a NOT IN (SELECT a FROM {k} WHERE b NOT IN (SELECT w FROM c{n})))",
            part(f"p{n + 1}", f"e{n + 1}"), largest(f"p{n + 1}", f"e{n + 1}"),
            f"k{n + 1} AS MATERIALIZED (SELECT e{n + 1}.* FROM e{n + 1} JOIN p{n + 1}c ON node = a JOIN p{n + 1} USING (component) WHERE b IS NOT NULL)",
        ]
    return f"WITH RECURSIVE {', '.join(out)} SELECT c_custkey FROM {_JOBS} j WHERE EXISTS (SELECT 1 FROM k{rounds} WHERE a = j.firm AND b = j.worker) AND worker IN (SELECT b FROM k{rounds} GROUP BY b HAVING sum(t) > 1)"


@query(_leave_out_sql())
def split_leave_out(spark, d):
    return leave_out_set(_jobs(spark, d), "worker", "firm", spread=True).select("c_custkey")


@query(f"SELECT worker AS i, firm AS j, pay AS y, row_number() OVER (PARTITION BY worker ORDER BY c_custkey) - 1 AS t FROM {_JOBS}")
def bipartite_frame(spark, d):
    return bipartite(_jobs(spark, d), "pay", "worker", "firm", ["c_custkey"]).select("i", "j", "y", F.col("t").cast("long"))


# worker and firm effects

_SPELLS = f"(SELECT l_orderkey, depot, l_linenumber, l_extendedprice FROM {_LINES} QUALIFY count(*) OVER (PARTITION BY l_orderkey) > 1)"


def _akm_sql(level: str) -> str:
    """Orders as workers, depots as firms: dummies within orders, leverages as quadratic forms in their inverse."""
    k = 6
    fitted = f"{_PSI}"
    dummy = lambda i: f"(CASE WHEN depot = {_DEPOTS[i - 1]} THEN 1.0 ELSE 0.0 END)"
    qs = ", ".join(f"{dummy(i)} - x{i} AS q{i}" for i in range(1, k + 1))  # the worker's mean of the dummy
    quad = lambda a, b: " + ".join(f"{a}{i}*v{i}_{j}*{b}{j}" for i in range(1, k + 1) for j in range(1, k + 1))
    z = ", ".join("(" + " + ".join(f"v{i}_{j}*x{j}" for j in range(1, k + 1)) + f") AS z{i}" for i in range(1, k + 1))
    sums_z = " + ".join(f"z{i}*df{i}" for i in range(1, k + 1))
    zz = " + ".join(f"z{i}*z{i}*df{i}" for i in range(1, k + 1))
    # z' (diag(df) - S) z with S the inverse's inverse: the within products g
    zsz = " + ".join(f"z{i}*z{j}*g{min(i, j)}_{max(i, j)}" for i in range(1, k + 1) for j in range(1, k + 1))
    qz = " + ".join(f"q{i}*z{i}" for i in range(1, k + 1))
    xz = " + ".join(f"x{i}*z{i}" for i in range(1, k + 1))
    base = o.least_squares(_depot_rows(_SPELLS, "l_orderkey"), k, "6", extra=f""",
r0 AS MATERIALIZED (SELECT d.*, count(*) OVER (PARTITION BY l_orderkey) AS tw, {fitted} AS psi0, {qs} FROM d, b),
tot AS MATERIALIZED (SELECT count(*) AS nn, avg(raw) AS ybar, avg(psi0) AS pbar, {', '.join(f'sum({dummy(i)}) AS df{i}' for i in range(1, k + 1))} FROM r0),
r1 AS MATERIALIZED (SELECT r0.*, {z}, psi0 - pbar AS psi, avg(raw - psi0 + pbar) OVER (PARTITION BY l_orderkey) AS alpha FROM r0, b, tot),
r2 AS MATERIALIZED (SELECT r1.*, 1.0 / tw + {xz} AS p, ({zz}) - ({sums_z})^2 / nn AS bfe, 1.0 / tw - 2 * ({qz}) + ({zz}) - ({zsz}) - (1 - ({sums_z}))^2 / nn AS bpe, ({qz}) - (({zz}) - ({zsz})) - (1 - ({sums_z})) * ({sums_z}) / nn AS bcov, raw - alpha - psi AS eta,
 count(*) OVER m AS t, count(DISTINCT depot) OVER (PARTITION BY l_orderkey) AS firms, avg(raw) OVER m AS my, nn, ybar FROM r1, b, tot WINDOW m AS (PARTITION BY l_orderkey, depot)),
""")
    if level == "obs":
        more = "r3 AS MATERIALIZED (SELECT *, (raw - ybar) * eta / (1 - p) AS sigma FROM r2), c AS MATERIALIZED (SELECT sum(bfe * sigma) AS kfe, sum(bpe * sigma) AS kpe, sum(bcov * sigma) AS kcov FROM r3)"
    else:
        more = """mt AS MATERIALIZED (SELECT l_orderkey, depot, any_value(t) AS t, any_value(tw) AS tw, any_value(p) AS p, any_value(bfe) AS bfe, any_value(bpe) AS bpe, any_value(bcov) AS bcov, any_value(firms) AS firms, any_value(my) AS my, any_value(alpha + psi) AS fitted, sum((raw - ybar) * eta) AS own, any_value(nn) AS nn FROM r2 GROUP BY l_orderkey, depot),
r3 AS MATERIALIZED (SELECT *, t * CASE WHEN firms < 2 THEN own / (1 - 1.0 / tw) / t ELSE (sqrt(t) * my - (SELECT avg(sqrt(t) * my) FROM mt)) * sqrt(t) * (my - fitted) / (1 - t * p) END AS sigma FROM mt), c AS MATERIALIZED (SELECT sum(bfe * sigma) AS kfe, sum(bpe * sigma) AS kpe, sum(bcov * sigma) AS kcov FROM r3)"""
    plain = ", pl AS MATERIALIZED (SELECT sum(psi * psi) / (any_value(nn) - 1) AS vpsi, sum((alpha - am) * (alpha - am)) / (any_value(nn) - 1) AS valpha, sum((alpha - am) * psi) / (any_value(nn) - 1) AS vcov, any_value(nn) AS nn, var_samp(raw) AS vy FROM (SELECT *, avg(alpha) OVER () AS am FROM r2))"
    rows = " UNION ALL ".join(f"SELECT '{n}' AS component, {o.sig(f'{v} / vy', 5)} AS plugin, {o.sig(f'({v} - {c} / (nn - 1)) / vy', 5)} AS kss FROM pl, c" for n, v, c in (("var_psi", "vpsi", "kfe"), ("var_alpha", "valpha", "kpe"), ("cov_alpha_psi", "vcov", "kcov")))
    return base + more + plain + " " + rows


def _akm_rows(spark, d, level, **options):
    r = akm_kss(_shipped(spark, d), Y, "l_orderkey", "depot", level=level, leverages="exact", **options)
    five = lambda x: float(f"{x / r.var_y:.5g}")
    return spark.createDataFrame([(k, five(r.plugin[k]), five(r.kss[k])) for k in r.plugin], "component string, plugin double, kss double")


@query("SELECT l_orderkey AS worker, depot AS firm, count(*) AS t, round(sum(l_extendedprice), 2) AS s FROM " + _LINES + " GROUP BY ALL")
def akm_matches(spark, d):
    return matches(_shipped(spark, d), Y, "l_orderkey", "depot").select("worker", "firm", "t", F.round("s", 2).alias("s"))


@query(_akm_sql("obs"))
def akm_by_observation(spark, d):
    return _akm_rows(spark, d, "obs")


@query(_akm_sql("match"))
def akm_by_match(spark, d):
    return _akm_rows(spark, d, "match", spread=True)


def _projection_sql() -> str:
    """The firm effects on the depot's number: its standard error is that of a sum of y with weights that solve the normal equations."""
    a = lambda i: f"(df{i} * ({_DEPOTS[i - 1]} - zbar) / szz)"
    weight = " + ".join(f"x{i} * (" + " + ".join(f"v{i}_{j}*{a(j)}" for j in range(1, 7)) + ")" for i in range(1, 7))
    base = _akm_sql("match")
    head = base[: base.index(", pl AS MATERIALIZED")]
    return head + f""", zs AS MATERIALIZED (SELECT avg(depot) AS zbar, var_pop(depot) * count(*) AS szz, regr_slope(psi, depot) AS slope FROM r2),
ws AS MATERIALIZED (SELECT l_orderkey, depot, any_value({weight}) AS x FROM d, b, tot, zs GROUP BY l_orderkey, depot)
SELECT 'depot' AS term, {o.sig('any_value(slope)', 5)} AS coef, {o.sig('sqrt(sum(sigma * x * x))', 5)} AS se FROM r3 JOIN ws USING (l_orderkey, depot), zs"""


@query(_projection_sql())
def akm_projection(spark, d):
    df = _shipped(spark, d)
    r = akm_kss(df.withColumn("number", F.col("depot").cast("double")), Y, "l_orderkey", "depot", z=["number"], leverages="exact", spread=True)
    told = r.lincom[0]
    return spark.createDataFrame([("depot", float(f"{told['coef']:.5g}"), float(f"{told['se']:.5g}"))], "term string, coef double, se double")


# groups and their members

_GROUP = "(SELECT l_orderkey, any_value(o_totalprice) AS o_totalprice, any_value(dayofyear(o_orderdate)) AS day, " + ", ".join(f"count(DISTINCT CASE WHEN depot = {m} THEN 1 END) / count(DISTINCT depot) AS s{i}" for i, m in enumerate(_DEPOTS, 1)) + " FROM " + _LINES + " JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey)"


@query(o.least_squares(f"SELECT o_totalprice AS y, day AS x1, {', '.join(f's{i} AS x{i + 1}' for i in range(1, 8))}, 1.0 AS w FROM {_GROUP}", 8, "8") + o.terms(["day"]))
def group_members_reg(spark, d):
    orders = _table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.dayofyear("o_orderdate").cast("double").alias("day"))
    df = _shipped(spark, d).select("l_orderkey", "depot").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return _terms(fit_groups(df, "o_totalprice", ["day"], "l_orderkey", individual="depot", spread=True))


def _shared_sql(rounds: int = 6) -> str:
    out = ["s0 AS MATERIALIZED (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem)"]
    n = 0
    for _ in range(rounds):
        for key in ("l_partkey", "l_suppkey"):
            out.append(f"s{n + 1} AS MATERIALIZED (SELECT * FROM s{n} WHERE l_orderkey NOT IN (SELECT min(l_orderkey) FROM s{n} GROUP BY {key} HAVING count(DISTINCT l_orderkey) < 2))")
            n += 1
    return f"WITH {', '.join(out)} SELECT l_orderkey, count(*) AS n FROM s{n} GROUP BY l_orderkey"


@query(_shared_sql())
def group_singletons(spark, d):
    df = _lines(spark, d).select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    return shared_singletons(df, "l_orderkey", "l_suppkey", ["l_partkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, any_value(c_nationkey) AS c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey")
def collapsed_groups(spark, d):
    return collapse(_ordered(spark, d), "o_custkey", ["c_nationkey"]).select("o_custkey", "c_nationkey")


# coefficient movement with effects

_MOVED = f"""WITH d AS MATERIALIZED (SELECT l_extendedprice AS raw, l_quantity AS q, l_discount AS z, l_extendedprice - avg(l_extendedprice) OVER p AS y, l_quantity - avg(l_quantity) OVER p AS qt, l_discount - avg(l_discount) OVER p AS zt FROM {_LINES} WINDOW p AS (PARTITION BY depot)),
h AS (SELECT sum(qt*qt) AS a, sum(qt*zt) AS b, sum(zt*zt) AS c, sum(qt*y) AS p, sum(zt*y) AS q FROM d),
f AS MATERIALIZED (SELECT (c*p - b*q) / (a*c - b*b) AS bq, (a*q - b*p) / (a*c - b*b) AS bz FROM h),
k AS MATERIALIZED (SELECT d.q, raw, bz * z AS part, raw - y - bq * (d.q - qt) - bz * (z - zt) AS eff FROM d, f) """


@query(_MOVED + " UNION ALL ".join(f"SELECT '{name}' AS part, {o.sig(f'regr_slope({c}, q)')} AS delta, {o.sig('regr_slope(raw, q)')} AS base FROM k" for name, c in (("discount", "part"), ("depot", "eff"))))
def coef_movement_parts(spark, d):
    df = _shipped(spark, d)
    r = decompose(df, Y, ["l_quantity"], {"discount": ["l_discount"]}, fes=["depot"])
    return _rows(spark, [(g, float(r.delta[i, 0]), float(r.base[0])) for i, g in enumerate(r.groups)], "part string, delta double, base double")


def _movement_sql(vce: str, by: str | None) -> str:
    """Each row's influence on a contribution, through the auxiliary regression and through the group's coefficient."""
    rows = "SELECT l_suppkey, l_extendedprice - avg(l_extendedprice) OVER () AS y, l_quantity - avg(l_quantity) OVER () AS x1, l_discount - avg(l_discount) OVER () AS x2, l_tax - avg(l_tax) OVER () AS x3, 1.0 AS w FROM lineitem"
    big, own = ("n / (n - 1)", "n / (n - 4)") if vce == "robust" else ("gc / (gc - 1)", "(n - 1) / (n - 4) * gc / (gc - 1)")
    sql = o.least_squares(rows, 3, "4", extra=f""", i AS MATERIALIZED (SELECT l_suppkey, {', '.join(f'x1 / g1_1 * b{k} * (x{k} - g1_{k} / g1_1 * x1) AS a{k}, g1_{k} / g1_1 * (v{k}_1*x1 + v{k}_2*x2 + v{k}_3*x3) * u AS c{k}' for k in (2, 3))} FROM e, b),
t AS MATERIALIZED (SELECT {', '.join(f'sum(a{k}) AS a{k}, sum(c{k}) AS c{k}' for k in (2, 3))} FROM i GROUP BY {by}),
z AS MATERIALIZED (SELECT count(*) AS gc, {', '.join(f'sum(a{k}*a{k}) AS aa{k}, sum(c{k}*c{k}) AS cc{k}, sum(a{k}*c{k}) AS ac{k}' for k in (2, 3))} FROM {'t' if by else 'i'}) """.replace("GROUP BY None", "GROUP BY l_suppkey"))
    return sql + " UNION ALL ".join(f"SELECT '{vce}' AS vce, '{name}' AS part, {o.sig(f'g1_{k} / g1_1 * b{k}')} AS delta, {o.sig(f'sqrt({big} * aa{k} + {own} * cc{k} + 2 * {big} * ac{k})')} AS se FROM b, z" for k, name in ((2, "discount"), (3, "tax")))


@query(" UNION ALL ".join(f"SELECT * FROM ({_movement_sql(v, c)})" for v, c in (("robust", None), ("cluster", "l_suppkey"))))
def coef_movement_sandwich(spark, d):
    out = []
    for vce in ("robust", "cluster"):
        r = decompose(_lines(spark, d), Y, ["l_quantity"], {"discount": ["l_discount"], "tax": ["l_tax"]}, vce=vce, clusters=["l_suppkey"] if vce == "cluster" else [])
        out += [(vce, t["group"], t["delta"], t["se"]) for t in r.tidy() if t["group"] != "total"]
    return _rows(spark, out, "vce string, part string, delta double, se double")


# distributions

#: Closed forms of tails at x, with n lines of a part.
_TAILS = {"student_1": "1 - 2 * atan(x) / pi()", "student_2": "1 - x / sqrt(2 + x * x)", "student_4": "1 - x / sqrt(4 + x * x) * (1 + 2.0 / (4 + x * x))", "chi2_2": "exp(-x / 2)", "chi2_4": "exp(-x / 2) * (1 + x / 2)", "chi2_6": "exp(-x / 2) * (1 + x / 2 + x * x / 8)", "f_2": "pow(1 + 2 * x / n, -n / 2.0)"}


@query(f"SELECT l_partkey, {', '.join(f'round(({v})::DOUBLE, 6) AS {k}' for k, v in _TAILS.items())}, round((tan(pi() * u / 2))::DOUBLE, 4) AS quantile_1 FROM (SELECT l_partkey, avg(l_quantity)::DOUBLE / 10 AS x, count(*) AS n, avg(l_discount)::DOUBLE * 5 AS u FROM lineitem GROUP BY l_partkey)")
def tails(spark, d):
    """Tails of each part's mean quantity, with its lines as degrees of freedom, and a quantile at its mean discount."""
    parts = _lines(spark, d).groupBy("l_partkey").agg((F.avg("l_quantity") / 10).alias("x"), F.count(F.lit(1)).alias("n"), (F.avg("l_discount") * 5).alias("u"))
    m = distributions
    of = {f"student_{k}": lambda x, n, k=k: m.student_ps(x, k) for k in (1, 2, 4)} | {f"chi2_{k}": lambda x, n, k=k: m.chi2_tails(x, k) for k in (2, 4, 6)} | {"f_2": lambda x, n: m.f_tails(x, 2, n)}

    def run(batches):
        for part in batches:
            x, n, u = (part[c].to_numpy(float) for c in "xnu")
            for name, f in of.items():
                part[name] = [round(v, 6) for v in f(x, n).tolist()]
            part["quantile_1"] = [round(v, 4) for v in m.student_quantiles(0.5 + u / 2, 1.0).tolist()]
            yield part.drop(columns=["x", "n", "u"])

    key = parts.schema["l_partkey"].dataType.simpleString()
    return parts.mapInPandas(run, f"l_partkey {key}, " + ", ".join(f"{k} double" for k in [*of, "quantile_1"]))
