"""Formulas: y ~ x1 + a:b + a*b + (a + b)**2 + I(a + b) + C(g) + C(g):x | fe1 + f1^f2 + fe[z] + fe[[z]] | endogenous ~ instruments.

Categories may also be written i.g, and numbers c.x; effects may be written f1#f2, fe##c.z, fe#c.z and fe##c.(z1 z2).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations


@dataclass(frozen=True)
class Effect:
    """A fixed effect: key columns (several make a joint id), slopes on columns, and whether levels have an intercept."""

    keys: tuple[str, ...]
    slopes: tuple[str, ...] = ()
    intercept: bool = True

    @property
    def name(self) -> str:
        base = "^".join(self.keys)
        return base if not self.slopes else f"{base}{'[' if self.intercept else '[['}{','.join(self.slopes)}{']' if self.intercept else ']]'}"


@dataclass(frozen=True)
class Formula:
    y: str
    x: tuple[str, ...]
    effects: tuple[Effect, ...] = ()
    endogenous: tuple[str, ...] = ()
    instruments: tuple[str, ...] = ()
    intercept: bool = True


def split_top(text: str, at: str) -> list[str]:
    """Split at a character outside brackets, quotes and backticks."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == at and not depth:
            out.append(text[start:i])
            start = i + 1
    if depth or quote:
        raise ValueError(f"unbalanced brackets or quotes in {text!r}")
    return [x.strip() for x in [*out, text[start:]]]


def terms(text: str) -> tuple[tuple[str, ...], bool]:
    """Terms of a sum in order, products as a:b, and whether there is an intercept."""
    out: list[str] = []
    intercept = True
    for raw in split_top(text.replace("- 1", "+ 0").replace("-1", "+ 0"), "+"):
        raw = re.sub(r"(?<![\w.`])i\.([A-Za-z_]\w*)", r"C(\1)", re.sub(r"(?<![\w.`])c\.(?=[A-Za-z_])", "", raw))
        if raw in ("0", "1", ""):
            intercept = intercept and raw != "0"
            continue
        if raw == ".":
            raise ValueError("'.' is not supported in a formula")
        if (m := re.fullmatch(r"(.+?)\s*\*\*\s*(\d+)", raw)) and len(split_top(raw, ":")) == 1 and not re.match(r"\w+\(", raw):
            # a power is all products of up to so many of the terms, each once
            inner = terms(m[1][1:-1] if m[1].startswith("(") and m[1].endswith(")") else m[1])[0]
            found = [":".join(some) for k in range(1, int(m[2]) + 1) for some in combinations(inner, k)]
            out += [t for t in found if t not in out]
            continue
        parts = split_top(raw, "*")
        if len(parts) > 1 and not raw.startswith("I("):
            found = [":".join(p for i, p in enumerate(parts) if k >> i & 1) for k in sorted(range(1, 2 ** len(parts)), key=lambda k: (k.bit_count(), k))]
        else:
            found = [":".join(split_top(raw, ":"))]
        out += [t for t in found if t not in out]
    return tuple(out), intercept


def effect(text: str) -> Effect:
    if "#" in text:
        return crossed(text)
    if m := re.fullmatch(r"(.+?)\[\[(.+)\]\]", text):
        return Effect(tuple(split_top(m[1], "^")), tuple(split_top(m[2], ",")), False)
    if m := re.fullmatch(r"(.+?)\[(.+)\]", text):
        return Effect(tuple(split_top(m[1], "^")), tuple(split_top(m[2], ",")), True)
    return Effect(tuple(k.strip("`") for k in split_top(text, "^")))


def crossed(text: str) -> Effect:
    """a#b and a##b are a joint id; a#c.x a slope, a##c.x intercept and slope, and c.(x z) several slopes."""
    parts = [x for x in re.split(r"#+", text) if x]
    slopes = [z for x in parts if x.startswith("c.") for z in x[2:].strip("()").split()]
    keys = tuple(x.removeprefix("i.").strip("`") for x in parts if not x.startswith("c."))
    if not keys:
        raise ValueError(f"no key in {text!r}")
    return Effect(keys, tuple(slopes), not slopes or "##" in text)


@lru_cache(128)
def parse(text: str) -> Formula:
    parts = split_top(text, "|")
    sides = split_top(parts[0], "~")
    if len(sides) != 2 or not sides[0] or len(parts) > 3:
        raise ValueError(f"not a formula: {text!r}")
    iv = parts.pop() if len(parts) > 1 and len(split_top(parts[-1], "~")) == 2 else None
    if len(parts) == 3:
        raise ValueError("the last part must be endogenous ~ instruments")
    x, intercept = terms(sides[1])
    effects = tuple(effect(t) for t in split_top(parts[1], "+") if t not in ("0", "")) if len(parts) > 1 else ()
    endogenous, instruments = (terms(s)[0] for s in split_top(iv, "~")) if iv else ((), ())
    return Formula(sides[0].strip("`"), x, effects, endogenous, instruments, intercept)
