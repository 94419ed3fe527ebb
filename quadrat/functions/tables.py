"""Small tables of results as records, Markdown, LaTeX, HTML or CSV text."""

from __future__ import annotations

import html
import math
import re


def number(v, digits: int = 3) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.{digits}f}" if isinstance(v, float) else str(v)


def stars(p: float) -> str:
    return "" if p != p else "***" if p < 0.01 else "**" if p < 0.05 else "*" if p < 0.1 else ""


def model_table(results: dict, digits: int = 3, keep: str | None = None, drop: str | None = None) -> list[dict[str, str]]:
    """A column for each fitted model, a row for each term and its standard error, then fit statistics."""
    terms = [t for t in dict.fromkeys(t for r in results.values() for t in r.terms) if (keep is None or re.search(keep, t)) and not (drop and re.search(drop, t))]
    told = {name: {t["term"]: t for t in r.tidy()} for name, r in results.items()}
    out = []
    for t in terms:
        out.append({"": t} | {m: number(told[m][t]["coef"], digits) + stars(told[m][t]["p"]) if t in told[m] else "" for m in results})
        out.append({"": ""} | {m: f"({number(told[m][t]['se'], digits)})" if t in told[m] else "" for m in results})
    for label, of in (("N", lambda r: r.n), ("R2", lambda r: r.r2), ("R2 within", lambda r: r.r2_within), ("RMSE", lambda r: r.rmse)):
        out.append({"": label} | {m: number(of(r), digits) for m, r in results.items()})
    return out


def parts_table(d, digits: int = 3, keep: str | None = None, drop: str | None = None) -> list[dict[str, str]]:
    """A row for each contribution of a decomposition; groups left out are summed as "Other (filtered)", so rows add up."""
    shown = [g for g in d.groups if (keep is None or re.search(keep, g)) and not (drop and re.search(drop, g))]
    out = [{"": "base"} | {t: number(float(v), digits) for t, v in zip(d.targets, d.base, strict=True)}]
    rows = {(r["target"], r["group"]): r for r in d.tidy()}
    for g in shown:
        out.append({"": g} | {t: f"{number(rows[t, g]['delta'], digits)}{stars(rows[t, g]['p'])} ({number(rows[t, g]['se'], digits)})" for t in d.targets})
    if rest := [g for g in d.groups if g not in shown]:
        sums = {t: d.contrast({(t, g): 1.0 for g in rest}) for t in d.targets}
        out.append({"": "Other (filtered)"} | {t: f"{number(s['value'], digits)} ({number(s['se'], digits)})" for t, s in sums.items()})
    return [*out, {"": "full"} | {t: number(float(v), digits) for t, v in zip(d.targets, d.full, strict=True)}]


def render(rows: list[dict[str, str]], kind: str = "markdown") -> str:
    """Rows of equal keys as markdown, latex, html or csv."""
    head = list(rows[0]) if rows else []
    body = [[r[c] for c in head] for r in rows]
    if kind == "markdown":
        line = lambda c: "| " + " | ".join(x.replace("|", "\\|") for x in c) + " |"
        return "\n".join([line(head), "|" + "---|" * len(head), *map(line, body)])
    if kind == "latex":
        escaped = lambda x: re.sub(r"([&%$#_{}])", r"\\\1", x)
        line = lambda c: " & ".join(map(escaped, c)) + r" \\"
        return "\n".join([rf"\begin{{tabular}}{{l{'c' * (len(head) - 1)}}}", line(head), r"\hline", *map(line, body), r"\end{tabular}"])
    if kind == "html":
        cells = lambda c, tag: "<tr>" + "".join(f"<{tag}>{html.escape(x)}</{tag}>" for x in c) + "</tr>"
        return "\n".join(["<table>", cells(head, "th"), *[cells(r, "td") for r in body], "</table>"])
    if kind == "csv":
        import csv
        import io

        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([head, *body])
        return out.getvalue()
    raise ValueError(f"table as {kind!r}")


def records(result) -> list[dict]:
    """The rows of a model's or a decomposition's tidy() as plain records, with NaN as None, for frames and other table packages."""
    return [{k: None if isinstance(v, float) and math.isnan(v) else v for k, v in r.items()} for r in result.tidy()]


def plot_data(d, target: str, keep: str | None = None, drop: str | None = None, labels: dict[str, str] | None = None, other: bool = True, least: float = 1e-12) -> dict:
    """A waterfall of one target's movement to draw with any plotting package: bars from `bottom` over `height`, and lines between them.

    keep and drop are patterns for groups; what they leave out is one bar of its own, so bars still lead from base to full, unless
    other is False. share: of the movement, None where that is under least. A bar's kind is endpoint, group or other.
    """
    labels, j = labels or {}, d.targets.index(target)
    shown = [g for g in d.groups if (keep is None or re.search(keep, g)) and not (drop and re.search(drop, g))]
    moves = [(g, "group", float(d.delta[d.groups.index(g), j])) for g in shown]
    rest = [float(d.delta[i, j]) for i, g in enumerate(d.groups) if g not in shown]
    if rest and other:
        moves.append(("Other (filtered)", "other", sum(rest)))
    base, full, movement = float(d.base[j]), float(d.full[j]), float(d.total[j])
    bars, at = [{"label": labels.get("base", "base"), "kind": "endpoint", "start": 0.0, "end": base, "share": None}], base
    for name, kind, value in moves:
        bars.append({"label": labels.get(name, name), "kind": kind, "start": at, "end": at - value, "share": value / movement if abs(movement) > least else None})
        at -= value
    bars.append({"label": labels.get("full", "full"), "kind": "endpoint", "start": 0.0, "end": full, "share": None})
    bars = [{"position": i, **b, "bottom": min(b["start"], b["end"]), "height": abs(b["end"] - b["start"])} for i, b in enumerate(bars)]
    # a line leaves where a bar ends, and meets the next where it starts, or where the last one ends
    lines = [{"from": a["position"], "to": b["position"], "left": a["end"], "right": b["end"] if b["kind"] == "endpoint" else b["start"]} for a, b in zip(bars, bars[1:], strict=False)]
    return {"target": target, "bars": bars, "lines": lines}
