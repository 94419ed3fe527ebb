"""SQL of linear models, written out: least squares of any few columns by Gauss-Jordan steps over scalars, for the queries' oracles."""

from __future__ import annotations


def sig(x: str, digits: int = 6) -> str:
    """x to so many significant digits."""
    return f"printf('%.{digits - 1}e', ({x})::DOUBLE)::DOUBLE"


def sums(products: list[tuple[str, str]]) -> str:
    return ", ".join(f"sum({x}) AS {name}" for name, x in products)


def inverted(k: int, source: str, to: str, of: str = "g", prefix: str = "v") -> str:
    """CTEs that add the inverse of the symmetric matrix <of>i_j (i <= j, from 1) of the one row of `source` as <prefix>i_j."""
    cell = lambda i, j: f"{of}{min(i, j)}_{max(i, j)}"
    steps = [f"{to}0 AS MATERIALIZED (SELECT " + ", ".join([f"{cell(i, j)}::DOUBLE AS m{i}_{j}" for i in range(1, k + 1) for j in range(1, k + 1)] + [f"{float(i == j)}::DOUBLE AS m{i}_{k + j}" for i in range(1, k + 1) for j in range(1, k + 1)]) + f" FROM {source})"]
    for p in range(1, k + 1):
        row = [f"m{p}_{j} / m{p}_{p} AS m{p}_{j}" for j in range(1, 2 * k + 1)]
        rest = [f"m{i}_{j} - m{i}_{p} * m{p}_{j} / m{p}_{p} AS m{i}_{j}" for i in range(1, k + 1) if i != p for j in range(1, 2 * k + 1)]
        steps.append(f"{to}{p} AS MATERIALIZED (SELECT {', '.join(row + rest)} FROM {to}{p - 1})")
    steps.append(f"{to} AS MATERIALIZED (SELECT {source}.*, " + ", ".join(f"m{i}_{k + j} AS {prefix}{i}_{j}" for i in range(1, k + 1) for j in range(1, k + 1)) + f" FROM {source}, {to}{k})")
    return ", ".join(steps)


def least_squares(rows: str, k: int, parameters: str, vce: str = "unadjusted", by: list[str] = (), nobs: str = "count(*)", extra: str = "", factor: str | None = None, constant: list[str] | None = None) -> str:
    """CTEs d (the rows: y, x1..xk, w, all less what effects explain), b (coefficients b1.., inverse v1_1.., n, k_used) and s (b with c1_1.., the covariance).

    parameters: SQL of how many parameters are estimated; by: cluster columns of d; factor: SQL that scales the meat, over n,
    k_used and gc (clusters). constant: the means of x1.. (columns of d, the same in each row): then column k + 1 is a recovered constant's.
    """
    xs = [f"x{i}" for i in range(1, k + 1)]
    pairs = [(i, j) for i in range(1, k + 1) for j in range(i, k + 1)]
    moments = [(f"g{i}_{j}", f"w*x{i}*x{j}") for i, j in pairs] + [(f"h{i}", f"w*x{i}*y") for i in range(1, k + 1)] + [("sw", "w")]
    out = [f"d AS MATERIALIZED ({rows})", f"g AS MATERIALIZED (SELECT {sums(moments)}, {nobs} AS n, count(*) AS n_rows, ({parameters}) AS k_used{''.join(f', any_value({m}) AS mean{i}' for i, m in enumerate(constant or [], 1))} FROM d)"]
    out.append(inverted(k, "g", "gi"))
    coef = ", ".join("(" + " + ".join(f"v{i}_{j}*h{j}" for j in range(1, k + 1)) + f") AS b{i}" for i in range(1, k + 1))
    out.append(f"b AS MATERIALIZED (SELECT *, {coef} FROM gi)")
    out.append("e AS MATERIALIZED (SELECT d.*, y - (" + " + ".join(f"b{i}*{x}" for i, x in enumerate(xs, 1)) + ") AS u FROM d, b)")
    size = k + (constant is not None)
    scores = [f"w*u*{x}" for x in xs] + (["w*u"] if constant is not None else [])
    # the inverse over scores: with a constant, its own row is 1 / sw, and rows are then combined by the means
    bread = lambda i, j: f"v{i}_{j}" if i <= k and j <= k else "0.0" if i != j else "(1.0 / sw)"
    if vce == "unadjusted":
        out.append(f"m AS MATERIALIZED (SELECT sum(w*u*u) AS rss, 0 AS gc FROM e)")
        scale = factor or "rss / (n - k_used)"
        cell = lambda i, j: f"({bread(i, j)}) * ({scale})"
    else:
        meat = ", ".join(f"sum(s{i}*s{j}) AS m{i}_{j}" for i in range(1, size + 1) for j in range(i, size + 1))
        own = ", ".join(f"{x} AS s{i}" for i, x in enumerate(scores, 1)) if not by else ", ".join(f"sum({x}) AS s{i}" for i, x in enumerate(scores, 1))
        grouped = f" GROUP BY {', '.join(by)}" if by else ""
        out.append(f"m AS MATERIALIZED (SELECT {meat}, count(*) AS gc, (SELECT sum(w*u*u) FROM e) AS rss FROM (SELECT {own} FROM e{grouped}))")
        scale = factor or ("n / (n - k_used)" if vce == "robust" else "gc / (gc - 1) * (n - 1) / (n - k_used)")
        cell = lambda i, j: "(" + " + ".join(f"({bread(i, a)})*m{min(a, c)}_{max(a, c)}*({bread(c, j)})" for a in range(1, size + 1) for c in range(1, size + 1) if bread(i, a) != "0.0" and bread(c, j) != "0.0") + f") * ({scale})"
    cells = [f"{cell(i, j)} AS c{i}_{j}" for i in range(1, size + 1) for j in range(1, size + 1)]
    out.append(f"s{'0' if constant is not None else ''} AS MATERIALIZED (SELECT b.*, rss, gc, {', '.join(cells)} FROM b, m)")
    if constant is not None:
        kept = [f"c{i}_{j}" for i in range(1, k + 1) for j in range(1, k + 1)]
        mean = lambda i: f"mean{i}"
        whole = f"c{size}_{size}" + "".join(f" - 2*{mean(i)}*c{i}_{size}" for i in range(1, k + 1)) + "".join(f" + {mean(i)}*{mean(j)}*c{i}_{j}" for i in range(1, k + 1) for j in range(1, k + 1))
        out.append(f"s AS MATERIALIZED (SELECT * EXCLUDE (c{size}_{size}), {whole} AS c{size}_{size} FROM s0)")
    return "WITH " + ", ".join(out) + extra


def terms(names: list[str], source: str = "s") -> str:
    """Rows (term, coef, se, n) of s."""
    return " UNION ALL ".join(f"SELECT '{t}' AS term, {sig(f'b{i}')} AS coef, {sig(f'sqrt(c{i}_{i})')} AS se, n::BIGINT AS n FROM {source}" for i, t in enumerate(names, 1))


def student_tail(t: str, df: str, steps: int = 4000) -> str:
    """P(|T| > |t|), by Simpson's rule over the density of the angle atan(t / sqrt(df)), in which it is a power of the cosine."""
    # P(|T| > t) = integral_a^{pi/2} cos^(df - 1) / integral_0^{pi/2} cos^(df - 1), a = atan(t / sqrt(df)); both peak at 0 with width 1 / sqrt(df)
    top = f"least(pi() / 2, 12.0 / sqrt({df}))"
    part = lambda low: f"(SELECT sum((CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(greatest(cos({low} + ({top} - {low}) * i / {steps}), 0), {df} - 1)) * ({top} - {low}) / {steps} / 3 FROM range({steps} + 1) q(i))"
    return f"({part(f'atan(abs({t}) / sqrt({df}))')} / {part('0.0')})"


def student_quantile(df: str) -> str:
    """The 97.5 % quantile of Student's t for many degrees of freedom, by its expansion around the normal one."""
    z = "1.959963984540054"
    return f"({z} + ({z}^3 + {z}) / 4 / {df} + (5*{z}^5 + 16*{z}^3 + 3*{z}) / 96 / {df}^2 + (3*{z}^7 + 19*{z}^5 + 17*{z}^3 - 15*{z}) / 384 / {df}^3)"


def components(edges: str, name: str = "cc") -> str:
    """CTEs <name>_r and <name> (node, component) of `edges` (a, b), a query over two kinds of nodes named apart; for WITH RECURSIVE."""
    return f"{name}_e AS MATERIALIZED (SELECT DISTINCT a, b FROM ({edges})), {name}_r(node, seen) AS (SELECT a, a FROM {name}_e UNION SELECT r.node, y.a FROM {name}_r r JOIN {name}_e x ON x.a = r.seen JOIN {name}_e y ON y.b = x.b), {name} AS MATERIALIZED (SELECT node, min(seen) AS component FROM {name}_r GROUP BY node)"
