"""Queries of the linear-model operators over the star tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.absorb import within
from .operators.akm import akm_kss, leave_out_set as leave_out
from .operators.decompose import decompose
from .operators.graph import absorbed, mobility_groups
from .operators.groups import fit_groups
from .operators.model import fit
from .operators.resample import bootstrap
from .operators.sample import drop_singletons
from .plans.formula import Effect

Y, X = "l_extendedprice", ["l_quantity", "l_discount"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark, d) -> DataFrame:
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax", Y, *X)


def _rounded(r, digits: int = 6) -> DataFrame:
    rows = [(t["term"], float(f"{t['coef']:.{digits}g}"), float(f"{t['se']:.{digits}g}"), r.n) for t in r.tidy() if t["term"] != "_cons"]
    return r.sample.sparkSession.createDataFrame(rows, "term string, coef double, se double, n long")


def within_oneway(spark, d):
    rows = _lines(spark, d)
    spread = rows.agg(*[F.stddev(c) for c in (Y, "l_quantity")]).first()
    out = within(rows, [Y, "l_quantity"], "l_partkey")
    return out.select("l_orderkey", "l_linenumber", F.round(F.col(f"{Y}_tilde") / spread[0], 8).alias("price_within"), F.round(F.col("l_quantity_tilde") / spread[1], 8).alias("quantity_within"))


def fe_reg_oneway(spark, d):
    return _rounded(fit(_lines(spark, d), Y, X, ["l_partkey"]))


def fe_reg_robust(spark, d):
    return _rounded(fit(_lines(spark, d), Y, X, ["l_partkey"], se_type="robust"))


def fe_reg_cluster(spark, d):
    return _rounded(fit(_lines(spark, d), Y, X, ["l_partkey"], clusters=["l_suppkey"], se_type="cluster"))


def fe_reg_multiway(spark, d):
    return _rounded(fit(_lines(spark, d), Y, X, ["l_partkey"], clusters=["l_suppkey", "l_orderkey"], se_type="cluster"))


def fe_reg_weighted(spark, d):
    return _rounded(fit(_lines(spark, d), Y, ["l_discount", "l_tax"], ["l_partkey"], weights="l_quantity"))


def fe_reg_fweight(spark, d):
    return _rounded(fit(_lines(spark, d), Y, ["l_discount", "l_tax"], ["l_partkey"], weights="l_quantity", fweights=True))


def iv_just_identified(spark, d):
    return _rounded(fit(_lines(spark, d).withColumn("z", F.col("l_quantity") + 10 * F.col("l_tax")), Y, [], ["l_partkey"], endogenous=["l_quantity"], instruments=["z"]))


def twoway_reg(spark, d):
    return _rounded(fit(_lines(spark, d), Y, X, ["l_partkey", "l_suppkey"]))


def singletons(spark, d):
    return drop_singletons(_lines(spark, d), ["l_orderkey", "l_partkey"]).select("l_orderkey", "l_linenumber")


def groupvar(spark, d):
    return mobility_groups(_table(spark, d, "events"), "user_id", "event_type").select("user_id", "group")


def twoway_dof(spark, d):
    told = absorbed(_lines(spark, d), ["l_partkey", "l_suppkey"])
    return spark.createDataFrame([(*told["levels"], told["df_a"])], "parts long, suppliers long, df_a long")


def slope_reg(spark, d):
    return _rounded(fit(_lines(spark, d), Y, X, [Effect(("l_suppkey",), ("l_tax",))]))


def fixef_oneway(spark, d):
    r = fit(_lines(spark, d), Y, X, ["l_partkey"], retain_fes=True)
    spread = r.sample.agg(F.stddev("__y")).first()[0]
    return r.fixef().groupBy("l_partkey").agg(F.round(F.avg("fe1") / spread, 8).alias("effect"))


def model_summary(spark, d):
    r = fit(_lines(spark, d), Y, X, ["l_partkey"])
    told = {"r2": r.r2, "r2_within": r.r2_within, "rmse": r.rmse, "ll": r.ll, "f": r.wald()[0]}
    return spark.createDataFrame([(k, float(f"{v:.6g}")) for k, v in told.items()], "statistic string, value double")


def coef_movement(spark, d):
    r = decompose(_lines(spark, d), Y, ["l_quantity"], {"discount": ["l_discount"], "tax": ["l_tax"]})
    return spark.createDataFrame([(t["group"], float(f"{t['delta']:.6g}"), float(f"{t['se']:.6g}")) for t in r.tidy() if t["group"] != "total"], "part string, delta double, se double")


def coef_movement_effects(spark, d):
    r = decompose(_lines(spark, d), Y, ["l_quantity"], {"discount": ["l_discount"]}, fes=["l_partkey"], vce="cluster", clusters=["l_suppkey"])
    return spark.createDataFrame([(t["group"], *[float(f"{t[c]:.6g}") for c in ("delta", "se", "share")]) for t in r.tidy()], "part string, delta double, se double, share double")


def coef_movement_bootstrap(spark, d):
    got = bootstrap(_lines(spark, d), "l_suppkey", reps=199, seed=7, y=Y, x1=["l_quantity"], groups={"discount": ["l_discount"], "tax": ["l_tax"]}, fes=["l_partkey"])
    return spark.createDataFrame([(r["target"], r["group"], r["delta"], r["se"], r["low"], r["high"], r["valid"]) for r in got], "target string, part string, delta double, se double, low double, high double, valid long")


def leave_out_set(spark, d):
    return leave_out(_lines(spark, d), "l_orderkey", "l_suppkey").select("l_orderkey", "l_linenumber")


def akm_components(spark, d):
    return akm_kss(_table(spark, d, "events"), "value", "user_id", "event_type").frame()


def _orders(spark, d):
    orders = _table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.dayofyear("o_orderdate").alias("day"))
    return _lines(spark, d).select("l_orderkey", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


def group_reg(spark, d):
    return _rounded(fit_groups(_orders(spark, d), "o_totalprice", ["day"], "l_orderkey", ["o_custkey"]))


def group_individual_reg(spark, d):
    return _rounded(fit_groups(_orders(spark, d), "o_totalprice", ["day"], "l_orderkey", individual="l_suppkey"))


QUERIES = {f.__name__: f for f in (within_oneway, fe_reg_oneway, fe_reg_robust, fe_reg_cluster, fe_reg_multiway, fe_reg_weighted, fe_reg_fweight, iv_just_identified, twoway_reg, singletons, groupvar, twoway_dof, slope_reg, fixef_oneway, model_summary, coef_movement, coef_movement_effects, coef_movement_bootstrap, leave_out_set, akm_components, group_reg, group_individual_reg)}


def _sig(x: str, digits: int = 6) -> str:
    return f"printf('%.{digits - 1}e', {x})::DOUBLE"


def _two(x1: str, x2: str, weight: str = "1.0", n: str = "count(*)", scale: str = "1.0") -> str:
    """CTEs of the regression on two columns within parts: d (within), g (moments), b (coefficients), e (residuals)."""
    m = lambda c: f"{c} - sum({weight} * {c}) OVER p / sum({weight}) OVER p"
    return f"""WITH s AS (SELECT * FROM lineitem QUALIFY {'sum(l_quantity)' if scale == 'f' else 'count(*)'} OVER (PARTITION BY l_partkey) > 1),
d AS (SELECT l_suppkey, l_orderkey, {weight} AS w, {m(Y)} AS y, {m(x1)} AS x1, {m(x2)} AS x2 FROM s WINDOW p AS (PARTITION BY l_partkey)),
g AS (SELECT sum(w*x1*x1) AS a, sum(w*x1*x2) AS b, sum(w*x2*x2) AS c, sum(w*x1*y) AS p, sum(w*x2*y) AS q, {n} AS n, count(*) AS rows_, sum(w) AS sw, (SELECT count(DISTINCT l_partkey) FROM s) AS k FROM d),
b AS (SELECT *, a*c - b*b AS det, (c*p - b*q) / (a*c - b*b) AS b1, (a*q - b*p) / (a*c - b*b) AS b2 FROM g),
e AS (SELECT d.*, y - b1*x1 - b2*x2 AS u FROM d, b)"""


def _out(x1: str, x2: str, v1: str, v2: str, extra: str = "") -> str:
    return f"""
SELECT '{x1}' AS term, {_sig('b1')} AS coef, {_sig(f'sqrt({v1})')} AS se, n::BIGINT AS n FROM b{extra}
UNION ALL SELECT '{x2}', {_sig('b2')}, {_sig(f'sqrt({v2})')}, n::BIGINT FROM b{extra}"""


_SAND = "(c*c*m11 - 2*b*c*m12 + b*b*m22) / (det*det) * {f}", "(b*b*m11 - 2*a*b*m12 + a*a*m22) / (det*det) * {f}"


def _cluster_meat(keys: str, name: str) -> str:
    return f"{name} AS (SELECT sum(s1*s1) AS m11, sum(s1*s2) AS m12, sum(s2*s2) AS m22, count(*) AS gc FROM (SELECT sum(w*u*x1) AS s1, sum(w*u*x2) AS s2 FROM e GROUP BY {keys}))"


_CLASSIC = ("c/det * {s}", "a/det * {s}")
_RSS = "(SELECT sum(w*u*u) FROM e)"
ORACLE_SQL = {
    "within_oneway": f"SELECT l_orderkey, l_linenumber, round(({Y} - avg({Y}) OVER p) / (SELECT stddev({Y}) FROM lineitem), 8) AS price_within, round((l_quantity - avg(l_quantity) OVER p) / (SELECT stddev(l_quantity) FROM lineitem), 8) AS quantity_within FROM lineitem WINDOW p AS (PARTITION BY l_partkey)",
    "fe_reg_oneway": _two(*X) + _out(*X, *(x.format(s=f"{_RSS} / (n - 2 - k)") for x in _CLASSIC)),
    "fe_reg_robust": _two(*X) + ", m AS (SELECT sum(u*u*x1*x1) AS m11, sum(u*u*x1*x2) AS m12, sum(u*u*x2*x2) AS m22 FROM e)" + _out(*X, *(x.format(f="n / (n - 2 - k)") for x in _SAND), ", m"),
    "fe_reg_cluster": _two(*X) + ", " + _cluster_meat("l_suppkey", "m") + _out(*X, *(x.format(f="gc / (gc - 1) * (n - 1) / (n - 2 - k)") for x in _SAND), ", m"),
    "fe_reg_multiway": _two(*X) + ", " + ", ".join(_cluster_meat(k, v) for k, v in (("l_suppkey", "ma"), ("l_orderkey", "mb"), ("l_suppkey, l_orderkey", "mc")))
    + ", m AS (SELECT ma.m11 + mb.m11 - mc.m11 AS m11, ma.m12 + mb.m12 - mc.m12 AS m12, ma.m22 + mb.m22 - mc.m22 AS m22, least(ma.gc, mb.gc) AS gc FROM ma, mb, mc)"
    + _out(*X, *(x.format(f="gc / (gc - 1) * (n - 1) / (n - 2 - k)") for x in _SAND), ", m"),
    "fe_reg_weighted": _two("l_discount", "l_tax", "l_quantity") + _out("l_discount", "l_tax", *(x.format(s=f"{_RSS} * n / sw / (n - 2 - k)") for x in _CLASSIC)),
    "fe_reg_fweight": _two("l_discount", "l_tax", "l_quantity", "sum(w)", "f") + _out("l_discount", "l_tax", *(x.format(s=f"{_RSS} / (n - 2 - k)") for x in _CLASSIC)),
    "iv_just_identified": f"""WITH s AS (SELECT *, l_quantity + 10 * l_tax AS z FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_partkey) > 1),
d AS (SELECT {Y} - avg({Y}) OVER p AS y, l_quantity - avg(l_quantity) OVER p AS x, z - avg(z) OVER p AS z FROM s WINDOW p AS (PARTITION BY l_partkey)),
b AS (SELECT sum(z*y) / sum(z*x) AS b, sum(z*z) / (sum(z*x) * sum(z*x)) AS v, count(*) AS n, (SELECT count(DISTINCT l_partkey) FROM s) AS k FROM d)
SELECT 'l_quantity' AS term, {_sig('any_value(b)')} AS coef, {_sig('sqrt(any_value(v) * sum((y - b*x) * (y - b*x)) / (any_value(n) - 1 - any_value(k)))')} AS se, any_value(n) AS n FROM d, b""",
    "singletons": "WITH " + ", ".join(f"s{i} AS MATERIALIZED (SELECT * FROM {'lineitem' if i == 0 else f's{i - 1}'} QUALIFY count(*) OVER (PARTITION BY {'l_orderkey' if i % 2 == 0 else 'l_partkey'}) > 1)" for i in range(10)) + " SELECT l_orderkey, l_linenumber FROM s9",
    "groupvar": """WITH RECURSIVE e AS (SELECT DISTINCT user_id, event_type FROM events),
r(a, b) AS (SELECT user_id, user_id FROM e UNION SELECT r.a, y.user_id FROM r JOIN e x ON x.user_id = r.b JOIN e y ON y.event_type = x.event_type)
SELECT a AS user_id, min(b) AS "group" FROM r GROUP BY a""",
    "twoway_dof": "WITH e AS MATERIALIZED (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), l0 AS MATERIALIZED (SELECT DISTINCT a, a AS l FROM e), "
    + ", ".join(f"l{i + 1} AS MATERIALIZED (SELECT e.a, min(m) AS l FROM e JOIN (SELECT b, min(l) AS m FROM e JOIN l{i} USING (a) GROUP BY b) USING (b) GROUP BY e.a)" for i in range(12))
    + " SELECT count(DISTINCT a) AS parts, count(DISTINCT b) AS suppliers, count(DISTINCT a) + count(DISTINCT b) - (SELECT count(DISTINCT l) FROM l12) AS df_a FROM e",
}


def _sweeps(rounds: int = 20) -> str:
    """Two-way within columns by sweeps in turn over both effects."""
    cs = [Y, *X]
    out = [f"t0 AS MATERIALIZED (SELECT l_partkey, l_suppkey, {', '.join(f'{c} AS v{i}' for i, c in enumerate(cs))} FROM lineitem)"]
    for n in range(2 * rounds):
        key = "l_partkey" if n % 2 == 0 else "l_suppkey"
        out.append(f"t{n + 1} AS MATERIALIZED (SELECT l_partkey, l_suppkey, {', '.join(f'v{i} - avg(v{i}) OVER (PARTITION BY {key}) AS v{i}' for i in range(3))} FROM t{n})")
    return ", ".join(out) + f", d AS (SELECT v0 AS y, v1 AS x1, v2 AS x2, 1.0 AS w FROM t{2 * rounds})"


ORACLE_SQL["twoway_reg"] = (
    f"WITH {_sweeps()}, g AS (SELECT sum(x1*x1) AS a, sum(x1*x2) AS b, sum(x2*x2) AS c, sum(x1*y) AS p, sum(x2*y) AS q, count(*) AS n, (SELECT count(DISTINCT l_partkey) + count(DISTINCT l_suppkey) - 1 FROM lineitem) AS k FROM d), "
    "b AS (SELECT *, a*c - b*b AS det, (c*p - b*q) / (a*c - b*b) AS b1, (a*q - b*p) / (a*c - b*b) AS b2 FROM g), e AS (SELECT d.*, y - b1*x1 - b2*x2 AS u FROM d, b)"
    + _out(*X, *(x.format(s=f"{_RSS} / (n - 2 - k)") for x in _CLASSIC))
)


def _line_fit(c: str) -> str:
    """c less its least-squares line on l_tax, with intercept, in each supplier."""
    return f"{c} - avg({c}) OVER p - (l_tax - avg(l_tax) OVER p) * covar_pop({c}, l_tax) OVER p / var_pop(l_tax) OVER p"


ORACLE_SQL["slope_reg"] = (
    f"WITH d AS (SELECT {_line_fit(Y)} AS y, {_line_fit(X[0])} AS x1, {_line_fit(X[1])} AS x2, 1.0 AS w FROM lineitem WINDOW p AS (PARTITION BY l_suppkey)), "
    "g AS (SELECT sum(x1*x1) AS a, sum(x1*x2) AS b, sum(x2*x2) AS c, sum(x1*y) AS p, sum(x2*y) AS q, count(*) AS n, (SELECT 2 * count(DISTINCT l_suppkey) FROM lineitem) AS k FROM d), "
    "b AS (SELECT *, a*c - b*b AS det, (c*p - b*q) / (a*c - b*b) AS b1, (a*q - b*p) / (a*c - b*b) AS b2 FROM g), e AS (SELECT d.*, y - b1*x1 - b2*x2 AS u FROM d, b)"
    + _out(*X, *(x.format(s=f"{_RSS} / (n - 2 - k)") for x in _CLASSIC))
)
ORACLE_SQL["fixef_oneway"] = _two(*X) + f", f AS (SELECT l_partkey, {Y} AS y, {Y} - b1*l_quantity - b2*l_discount AS v FROM s, b) SELECT l_partkey, round((avg(v) - (SELECT avg(v) FROM f)) / (SELECT stddev(y) FROM f), 8) AS effect FROM f GROUP BY l_partkey"
ORACLE_SQL["model_summary"] = (
    _two(*X)
    + f""", t AS (SELECT {_RSS} AS rss, (SELECT sum(y*y) FROM d) AS tw, (SELECT var_pop({Y}) * count(*) FROM s) AS tss, * FROM b),
m AS (SELECT 1 - rss/tss AS r2, 1 - rss/tw AS r2_within, sqrt(rss / (n - 2 - k)) AS rmse, -0.5 * n * (1 + ln(2 * pi()) + ln(rss / n)) AS ll, (b1*p + b2*q) / 2 / (rss / (n - 2 - k)) AS f FROM t)
"""
    + " UNION ALL ".join(f"SELECT '{k}' AS statistic, {_sig(k)} AS value FROM m" for k in ("r2", "r2_within", "rmse", "ll", "f"))
)
ORACLE_SQL["coef_movement"] = f"""WITH d AS (SELECT {Y} - avg({Y}) OVER () AS y, l_quantity - avg(l_quantity) OVER () AS x, l_discount - avg(l_discount) OVER () AS z1, l_tax - avg(l_tax) OVER () AS z2 FROM lineitem),
g AS (SELECT sum(x*x) AS xx, sum(x*z1) / sum(x*x) AS g1, sum(x*z2) / sum(x*x) AS g2, sum(x*y) / sum(x*x) AS gy, count(*) AS n, avg(x) AS mx FROM d),
r AS (SELECT x, y - gy*x AS y, z1 - g1*x AS z1, z2 - g2*x AS z2 FROM d, g),
h AS (SELECT sum(z1*z1) AS a, sum(z1*z2) AS b, sum(z2*z2) AS c, sum(z1*y) AS p, sum(z2*y) AS q FROM r),
b AS (SELECT *, (c*p - b*q) / (a*c - b*b) AS b1, (a*q - b*p) / (a*c - b*b) AS b2, c / (a*c - b*b) AS i1, a / (a*c - b*b) AS i2 FROM h),
s AS (SELECT sum((y - b1*z1 - b2*z2) * (y - b1*z1 - b2*z2)) / (any_value(n) - 4) AS s2 FROM r, b, g)
SELECT 'discount' AS part, {_sig('g1*b1')} AS delta, {_sig('sqrt(b1*b1*a / (n - 4) / xx + g1*g1*s2*i1)')} AS se FROM g, b, s
UNION ALL SELECT 'tax', {_sig('g2*b2')}, {_sig('sqrt(b2*b2*c / (n - 4) / xx + g2*g2*s2*i2)')} FROM g, b, s"""
#: Influences on the contributions: a1 and a2 through the regressions of the parts on quantity, c through the discount's coefficient.
ORACLE_SQL["coef_movement_effects"] = f"""WITH s AS (SELECT l_suppkey, {Y} AS raw, l_quantity AS x, l_discount AS z, l_partkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_partkey) > 1),
d AS MATERIALIZED (SELECT *, raw - avg(raw) OVER p AS yt, x - avg(x) OVER p AS xt, z - avg(z) OVER p AS zt, x - avg(x) OVER () AS xc FROM s WINDOW p AS (PARTITION BY l_partkey)),
g AS (SELECT sum(xt*xt) AS a, sum(xt*zt) AS b, sum(zt*zt) AS c, sum(xt*yt) AS p, sum(zt*yt) AS q, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM d),
f AS MATERIALIZED (SELECT *, a*c - b*b AS det, (c*p - b*q) / (a*c - b*b) AS bx, (a*q - b*p) / (a*c - b*b) AS bz FROM g),
h AS MATERIALIZED (SELECT l_suppkey, x, xc, z, raw, bz*z AS h1, raw - yt - bx*(x - xt) - bz*(z - zt) AS h2, (a*zt - b*xt) / det * (yt - bx*xt - bz*zt) AS c FROM d, f),
m AS MATERIALIZED (SELECT regr_slope(h1, x) AS d1, regr_slope(h2, x) AS d2, regr_intercept(h1, x) AS i1, regr_intercept(h2, x) AS i2, regr_slope(z, x) AS gamma, regr_slope(raw, x) AS base, sum(xc*xc) AS xx FROM h),
k AS (SELECT sum(xc / xx * (h1 - i1 - d1*x)) AS a1, sum(xc / xx * (h2 - i2 - d2*x)) AS a2, sum(c) AS c FROM h, m GROUP BY l_suppkey),
v AS (SELECT count(*) / (count(*) - 1.0) AS big, sum(a1*a1) AS v11, sum(a1*a2) AS v12, sum(a2*a2) AS v22, sum(a1*c) AS v1c, sum(c*c) AS vcc FROM k),
r AS (SELECT d1, d2, base, big*v11 + gamma*gamma*big*(n - 1) / (n - 2 - parts)*vcc + 2*gamma*big*v1c AS s1, big*v22 AS s2, big*v12 AS s12 FROM v, m, f)
SELECT 'discount' AS part, {_sig('d1')} AS delta, {_sig('sqrt(s1)')} AS se, {_sig('d1 / base')} AS share FROM r
UNION ALL SELECT 'l_partkey', {_sig('d2')}, {_sig('sqrt(s2)')}, {_sig('d2 / base')} FROM r
UNION ALL SELECT 'total', {_sig('d1 + d2')}, {_sig('sqrt(s1 + s2 + 2*s12)')}, {_sig('(d1 + d2) / base')} FROM r"""
#: Orders and suppliers of these tables are one component that no order holds together alone, so only orders of one line go.
ORACLE_SQL["leave_out_set"] = "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey) > 1"
ORACLE_SQL["group_individual_reg"] = f"""WITH RECURSIVE p AS (SELECT DISTINCT l_orderkey AS g, l_suppkey FROM lineitem),
o AS (SELECT o_orderkey AS g, o_totalprice - avg(o_totalprice) OVER () AS y, dayofyear(o_orderdate) - avg(dayofyear(o_orderdate)) OVER () AS x FROM orders WHERE o_orderkey IN (SELECT g FROM p)),
k AS (SELECT count(DISTINCT l_suppkey)::INT AS k FROM p),
e AS MATERIALIZED (SELECT g, dense_rank() OVER (ORDER BY l_suppkey)::INT AS i, 1.0::DOUBLE / count(*) OVER (PARTITION BY g) AS v FROM p UNION ALL SELECT g, k + 1, x FROM o, k UNION ALL SELECT g, k + 2, y FROM o, k),
c AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM e a JOIN e b USING (g) GROUP BY a.i, b.i),
-- the cross products, from which the suppliers are eliminated one after the other
r(n, i, j, v) AS (SELECT 0, x.i::INT, z.j::INT, coalesce(v, 0) FROM (SELECT unnest(range(1, k + 3)) AS i FROM k) x CROSS JOIN (SELECT unnest(range(1, k + 3)) AS j FROM k) z LEFT JOIN c ON c.i = x.i AND c.j = z.j
  UNION ALL SELECT n + 1, i, j, v - CASE WHEN d > 1e-9 THEN a * b / d ELSE 0 END FROM (SELECT *, max(CASE WHEN i = n + 1 AND j = n + 1 THEN v END) OVER () AS d, max(CASE WHEN j = n + 1 THEN v END) OVER (PARTITION BY i) AS a, max(CASE WHEN i = n + 1 THEN v END) OVER (PARTITION BY j) AS b FROM r) WHERE n < (SELECT k FROM k) AND i > n + 1 AND j > n + 1),
f AS (SELECT max(CASE WHEN i = k + 1 AND j = k + 1 THEN v END) AS xx, max(CASE WHEN i = k + 1 AND j = k + 2 THEN v END) AS xy, max(CASE WHEN i = k + 2 AND j = k + 2 THEN v END) AS yy, any_value(k) AS k FROM r, k WHERE n = k),
t AS (SELECT count(*) AS n FROM o)
SELECT 'day' AS term, {_sig('xy / xx')} AS coef, {_sig('sqrt((yy - xy * xy / xx) / (n - 1 - k) / xx)')} AS se, n FROM f, t"""
ORACLE_SQL["group_reg"] = f"""WITH s AS (SELECT o_totalprice, dayofyear(o_orderdate) AS day, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1),
d AS (SELECT o_totalprice - avg(o_totalprice) OVER p AS y, day - avg(day) OVER p AS x FROM s WINDOW p AS (PARTITION BY o_custkey)),
b AS (SELECT sum(x*y) / sum(x*x) AS b, sum(x*x) AS xx, count(*) AS n, (SELECT count(DISTINCT o_custkey) FROM s) AS k FROM d)
SELECT 'day' AS term, {_sig('any_value(b)')} AS coef, {_sig('sqrt(sum((y - b*x) * (y - b*x)) / (any_value(n) - 1 - any_value(k)) / any_value(xx))')} AS se, any_value(n) AS n FROM d, b"""
