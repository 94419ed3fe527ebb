"""Personal data by weak supervision: labelers vote on candidate spans, a model learns whom to trust, a classifier decides.

Base spans are the matches of four strict patterns that pass their checks; they always stay. Candidates come from wider patterns (tight
numbers next to others, numbers without a country code, spelled-out addresses). Labelers of three sorts vote on each,
for, against or not at all: regular expressions (strict form, clean borders, check digits), gazetteers (endings of host names,
issuer ranges, blocks of addresses, country codes) and context (words before). Expectation-maximisation over the counts of all vote
patterns in the corpus estimates each labeler's reliability in a kind and so the chance of each pattern. With these
chances as targets a logistic span classifier is trained on what the labelers don't see: the span's digits and
separators, the characters at its borders and the word before it. Candidates it finds likely, that pass their check and that overlap no
base span, are added.

What a text holds depends on the text alone, so every text is searched once, what is found in those that hold anything is settled
by a hash of the text, and the model is learnt from that and joined back. All is DataFrame functions; only counts of
vote patterns and of shapes, of which there is a fixed number at most, reach the driver. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_by_text, sealed, settle

#: Texts that hold anything, up to which their spans are broadcast; beyond it rows are joined by the hash of the text.
MOST_HELD = 50_000

#: Kinds in their order, and their patterns. Possessive forms match the same as the greedy ones but
#: take linear time; the look-behind skips starts inside a run, which fail where the run's own start fails.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|(?:[0-9]{4}[\x20-]){3}[0-9]{4})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])",
}
#: Words that speak for a kind, or against any, in the text before a span.
FOR = {
    "email": "mail|contact|write|reach",
    "ip": r"\bip\b|address|host|server|login|from",
    "card": "card|visa|master|amex|credit|pay|account",
    "phone": "phone|tel|call|mobile|cell|fax|whatsapp",
}
AGAINST = r"version|token|\bsha|hash|\bisbn|order|serial|\bid\b|release"
#: Fixed values of the gazetteers. Endings of host names (besides those of two letters, which are countries'):
ENDINGS = "com org net edu gov mil int info biz name pro aero coop museum mobi asia tel jobs cat travel post xyz online site app dev shop store tech cloud blog live email agency digital"
#: Blocks of addresses that aren't public unicast.
RESERVED = r"0|10|127|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])|169\.254|172\.(1[6-9]|2[0-9]|3[01])|192\.168|192\.0\.[02]|192\.88\.99|198\.1[89]|198\.51\.100|203\.0\.113|22[4-9]|2[3-9][0-9]"
#: Issuer ranges of card numbers and their lengths, as digits alone.
ISSUERS = r"4([0-9]{12}|[0-9]{15}|[0-9]{18})|(5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}|3[47][0-9]{13}|(6011|64[4-9][0-9]|65[0-9]{2})[0-9]{12,15}|3(0[0-5]|[68][0-9])[0-9]{11}|35(2[89]|[3-8][0-9])[0-9]{12,15}|62[0-9]{14,17}|(50|5[6-8]|6[0-9])[0-9]{11,17}"
#: Country codes of telephone numbers.
COUNTRIES = "1|7|2[07]|21[1-368]|2[2346][0-9]|25[0-8]|29[017-9]|3[0-469]|3[578][0-9]|4[013-9]|42[013]|5[1-8]|50[0-9]|59[0-9]|6[0-6]|67[02-9]|68[0-35-9]|69[0-2]|8[1246]|80[08]|85[02356]|87[08]|88[0-368]|9[0-58]|96[0-8]|97[0-79]|99[2-689]"
GAZETTEER = {
    "email": rf"(?i)[.\s)\]]({'|'.join(ENDINGS.split())}|[a-z]{{2}})$",
    "ip": rf"^(?!({RESERVED})\.)",
    "card": rf"^({ISSUERS})$",
    "phone": rf"^(\+({COUNTRIES})|\(?[2-9][0-9]{{2}}\)?[\x20.-][2-9])",
}
STRICT = {"email": "at|dot", "ip": r"^[0-9.]+$", "card": r"^([0-9]{16}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4})$", "phone": r"^\+"}
LABELERS = ("form", "border", "check", "gazetteer", "context")
_NONE = "cast(array() AS array<struct<s:int,e:int,m:string,before:string,after:string>>)"
_RUN = 64


def _let(value: str, name: str, body: str) -> str:
    """body with name standing for value, which is made once; a lambda would make it again at each step."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _positions(found: str, gaps: str) -> str:
    """Spans with their offsets, from the matches of a pattern and the text between; sums go by runs, so they are not quadratic."""
    item = "struct(a.pos + x.g AS s, a.pos + x.g + length(x.m) AS e, x.m AS m, x.before AS before, x.after AS after)"
    parts = f"transform(sequence(0, size({found}) - 1), i -> struct(length({gaps}[i]) AS g, {found}[i] AS m, right({gaps}[i], 40) AS before, left({gaps}[i + 1], 1) AS after))"
    runs = f"transform(sequence(0, (size(ps) - 1) div {_RUN}), b -> aggregate(slice(ps, cast(b * {_RUN} + 1 AS int), {_RUN}), struct(0 AS pos, {_NONE} AS out), (a, x) -> struct(a.pos + x.g + length(x.m) AS pos, concat(a.out, array({item})) AS out)))"
    lows = "aggregate(rs, struct(0 AS pos, cast(array() AS array<int>) AS low), (a, x) -> struct(a.pos + x.pos AS pos, concat(a.low, array(a.pos)) AS low)).low"
    moved = "flatten(zip_with(rs, ls, (x, low) -> transform(x.out, o -> struct(o.s + low AS s, o.e + low AS e, o.m AS m, o.before AS before, o.after AS after))))"
    return f"CASE WHEN size({found}) = 0 THEN {_NONE} ELSE {_let(parts, 'ps', _let(runs, 'rs', _let(lows, 'ls', moved)))} END"


def _with_spans(rows: DataFrame, patterns: dict[str, str], prefix: str) -> DataFrame:
    for kind, pattern in patterns.items():
        found, gaps = f"{prefix}_{kind}_found", f"{prefix}_{kind}_gaps"
        rows = rows.withColumn(found, F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)))
        rows = rows.withColumn(gaps, F.when(F.size(found) > 0, F.split("__text", pattern, -1)))
        rows = rows.withColumn(f"{prefix}_{kind}", F.expr(_positions(found, gaps))).drop(found, gaps)
    return rows


_DIGITS = "regexp_replace({m}, '[^0-9]', '')"
_OCTETS = "forall(split({m}, '[.]'), p -> p rlike '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$')"


def _luhn(digits: str) -> str:
    """Whether a string of 13 to 19 digits has a sound check digit."""
    doubled = "2 * cast(substring(d, i, 1) AS int)"
    return f"aggregate(array({digits}), false, (ok, d) -> CASE WHEN length(d) BETWEEN 13 AND 19 THEN aggregate(sequence(1, length(d)), 0, (t, i) -> t + CASE WHEN (length(d) - i) % 2 = 0 THEN cast(substring(d, i, 1) AS int) WHEN {doubled} > 9 THEN {doubled} - 9 ELSE {doubled} END) % 10 = 0 ELSE false END)"


CHECKS = {
    "email": "true",
    "ip": _OCTETS.format(m="x.m"),
    "card": _luhn(_DIGITS.format(m="x.m")),
    "phone": f"length({_DIGITS.format(m='x.m')}) BETWEEN 9 AND 15",
}


def _votes(kind: str) -> str:
    """The labelers' votes on candidate x, as digits: 0 against, 1 none, 2 for."""
    check = CHECKS[kind] if kind != "email" else "length(x.m) < 80"
    named = _DIGITS.format(m="x.m") if kind == "card" else "x.m"
    return f"""concat(
        CASE WHEN x.m rlike '{_sql(STRICT[kind])}' THEN '2' ELSE '1' END,
        CASE WHEN concat(right(x.before, 1), x.after) rlike '[A-Za-z0-9"_/]' THEN '0' ELSE '2' END,
        CASE WHEN {check} THEN '2' ELSE '0' END,
        CASE WHEN {named} rlike '{_sql(GAZETTEER[kind])}' THEN '2' ELSE '0' END,
        CASE WHEN lower(x.before) rlike '{_sql(AGAINST)}' THEN '0' WHEN lower(x.before) rlike '{_sql(FOR[kind])}' THEN '2' ELSE '1' END)"""


#: What the classifier sees of candidate x, a letter each: digits, separators, the characters before and after, the word before.
SHAPE = f"""concat(
    cast(least(length({_DIGITS.format(m="x.m")}) div 2, 9) AS string),
    CASE WHEN x.m rlike '^[0-9A-Za-z+]*$' THEN 'n' WHEN x.m rlike '^[^ .()-]*( [^ .()-]*)+$' THEN 's' WHEN x.m rlike '^[^ .()-]*(-[^ .()-]*)+$' THEN 'd' WHEN x.m rlike '^[^ .()-]*([.][^ .()-]*)+$' THEN 'p' ELSE 'm' END,
    CASE WHEN x.before = '' THEN 'b' WHEN x.before rlike '[:=#]$' THEN 'c' WHEN x.before rlike '[[:space:]]$' THEN 's' WHEN x.before rlike '[("<]$' THEN 'q' ELSE 'o' END,
    CASE WHEN x.after = '' THEN 'b' WHEN x.after rlike '[[:space:]]' THEN 's' WHEN x.after rlike '[.,;:!?)]' THEN 'p' ELSE 'o' END,
    CASE WHEN x.before rlike '[:=#] ?$' THEN 'l' WHEN x.before rlike '[0-9][^A-Za-z0-9]*$' THEN 'd' WHEN x.before rlike '(^|[^A-Za-z])[A-Z][A-Za-z]*[^A-Za-z0-9]*$' THEN 'u' WHEN x.before rlike '[a-z][^A-Za-z0-9]*$' THEN 'w' ELSE 'n' END)""".replace("[[:space:]]", "[\\\\s]")


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _free(kind: str) -> str:
    """Candidates that overlap no base span of any kind."""
    return f"filter(wide_{kind}, x -> NOT exists(base_all, b -> b.s < x.e AND x.s < b.e))"


def _spotted(docs: DataFrame, text_col: str) -> DataFrame:
    """(__h1, __h2, base_<kind>, wide_<kind>) for every row whose text holds anything: valid base spans, and candidates with votes and shape."""
    rows = docs.select(*keyed_by_text(F.col(text_col)), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = _with_spans(rows, BASE, "raw")
    for kind in KINDS:
        rows = rows.withColumn(f"base_{kind}", F.expr(f"transform(filter(raw_{kind}, x -> {CHECKS[kind]}), x -> struct(x.s AS s, x.e AS e))")).drop(f"raw_{kind}")
    rows = rows.withColumn("base_all", F.concat(*[f"base_{k}" for k in KINDS]))
    rows = _with_spans(rows, WIDE, "wide")
    for kind in KINDS:
        rows = rows.withColumn(f"wide_{kind}", F.expr(f"transform({_free(kind)}, x -> struct(x.s AS s, x.e AS e, {_votes(kind)} AS votes, {SHAPE} AS shape))"))
    made = ["__h1", "__h2", *(f"{x}_{k}" for k in KINDS for x in ("base", "wide"))]
    return sealed(rows.select(*made), made).where(" OR ".join(f"size({c}) > 0" for c in made[2:]))


@dataclass
class Model:
    """Reliabilities by kind and labeler (of a vote for, and of one against), and the span classifier's weights by feature."""

    reliability: dict[tuple[str, int], tuple[float, float]]
    weights: dict[str, float]

    def chance(self, kind: str, shape: str) -> float:
        return 1 / (1 + math.exp(-sum(self.weights.get(f, 0.0) for f in features(kind, shape))))

    def score(self, kind: str) -> str:
        """The log odds of candidate x, in SQL."""
        table = ", ".join(f"'{k}', {v!r}D" for k, v in sorted(self.weights.items())) or "'', 0D"
        names = [f"'{kind}'", *(f"concat('{kind}:{i}:', substring(x.shape, {i + 1}, 1))" for i in range(5))]
        return f"({' + '.join(f'coalesce(element_at(map({table}), {n}), 0D)' for n in names)})"


def features(kind: str, shape: str) -> list[str]:
    return [kind, *(f"{kind}:{i}:{v}" for i, v in enumerate(shape))]


def reconcile(counts: dict[tuple[str, str], int], rounds: int = 50) -> tuple[dict[tuple[str, str], float], dict]:
    """Expectation-maximisation over vote patterns: the chance that each is personal data, and the labelers' reliabilities.

    A labeler votes for a true span with one probability and for a false one with another; a prior of a few votes keeps
    both sensible where a kind has few candidates. One that would speak
    against what it votes for says nothing, so what is common isn't taken for what is true.
    """
    n = len(LABELERS)
    chance = {}
    for (kind, votes), _ in counts.items():
        told = [int(v) - 1 for v in votes[:n]]
        chance[kind, votes] = 1 / (1 + math.exp(-1.2 * sum(told)))
    rates: dict = {}
    for _ in range(rounds):
        prior = {}
        for kind in KINDS:
            own = [(v, c) for (k, v), c in counts.items() if k == kind]
            yes = sum(c * chance[kind, v] for v, c in own)
            no = sum(c * (1 - chance[kind, v]) for v, c in own)
            prior[kind] = (yes + 1) / (yes + no + 2)
            for i in range(n):
                pro = [(v, c) for v, c in own if v[i] == "2"]
                con = [(v, c) for v, c in own if v[i] == "0"]
                a, b = (sum(c * chance[kind, v] for v, c in x) for x in (pro, con))
                d, e = (sum(c * (1 - chance[kind, v]) for v, c in x) for x in (pro, con))
                t, f = (a + 8) / (a + b + 10), (d + 2) / (d + e + 10)
                rates[kind, i] = (t, f) if t > f else ((a + d + 5) / (a + b + d + e + 10),) * 2
        for kind, votes in chance:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for i, v in enumerate(votes[:n]):
                t, f = rates[kind, i]
                odds += math.log(t / f) if v == "2" else math.log((1 - t) / (1 - f)) if v == "0" else 0.0
            chance[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return chance, rates


def fit(targets: dict[tuple[str, str], tuple[int, float]], rounds: int = 400, rate: float = 2.0, ridge: float = 0.01) -> dict[str, float]:
    """Logistic weights for shapes by kind; targets: the number of candidates of a shape, and the sum of their chances."""
    weights: dict[str, float] = {}
    rows = [(features(*p), t / n, math.log1p(n)) for p, (n, t) in sorted(targets.items())]
    whole = {k: sum(w for f, _, w in rows if f[0] == k) for k in KINDS}
    for _ in range(rounds):
        step: dict[str, float] = {}
        for names, target, w in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(f, 0.0) for f in names)))))
            for f in names:
                step[f] = step.get(f, 0.0) + w * (target - p) / whole[names[0]]
        for f, g in step.items():
            weights[f] = weights.get(f, 0.0) + rate * (g - ridge * weights.get(f, 0.0))
    return weights


def learn(spotted: DataFrame) -> Model:
    """A model from the candidates of all rows. Without candidates it is blank."""
    every = F.concat(*[F.expr(f"transform(wide_{k}, x -> struct('{k}' AS kind, x.votes AS votes, x.shape AS shape))") for k in KINDS])
    found = spotted.select(F.explode(every).alias("x")).select("x.*")
    counts = {(r["kind"], r["votes"]): r["count"] for r in found.groupBy("kind", "votes").count().collect()}  # 4 kinds by 3**5 votes at most
    chance, rates = reconcile(counts)
    told = spotted.sparkSession.createDataFrame([(*k, p) for k, p in chance.items()], "kind string, votes string, chance double")
    shapes = found.join(F.broadcast(told), ["kind", "votes"]).groupBy("kind", "shape").agg(F.count("*").alias("n"), F.sum("chance").alias("t")).collect()  # 4 kinds by 5000 shapes at most
    return Model(rates, fit({(r["kind"], r["shape"]): (r["n"], r["t"]) for r in shapes}))


def find(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows with base and spans: arrays of (kind, s, e) by kind as listed, then start; spans has the base ones and those added.

    Null and empty texts have none. Columns of docs named base or spans are replaced. Repeated rows count as often.
    """
    spotted = settle(_spotted(docs.select(text_col), text_col))
    model = learn(spotted)
    named = lambda kind, a: f"array_sort(transform({a}, x -> struct('{kind}' AS kind, x.s AS s, x.e AS e)))"
    odds = math.log(least / (1 - least))
    # A failed check (a card's check digit, an octet over 255) rules a span out, whatever the classifier says.
    added = {k: f"transform(filter(wide_{k}, x -> substring(x.votes, {LABELERS.index('check') + 1}, 1) = '2' AND {model.score(k)} >= {odds!r}D), x -> struct(x.s AS s, x.e AS e))" for k in KINDS}
    spans = [f"concat({', '.join(named(k, f'base_{k}') for k in KINDS)}) AS __base", f"concat({', '.join(named(k, f'concat(base_{k}, {added[k]})') for k in KINDS)}) AS __spans"]
    held = settle(spotted.dropDuplicates(["__h1", "__h2"]).selectExpr("__h1 AS __k1", "__h2 AS __k2", *spans))
    if held.count() <= MOST_HELD:
        held = F.broadcast(held)
    keep = [c for c in docs.columns if c.lower() not in ("base", "spans")]
    rows = docs.select(*keyed_by_text(F.col(text_col)), *[F.col(f"`{c}`") for c in keep])
    rows = rows.join(held, (F.col("__h1") == F.col("__k1")) & (F.col("__h2") == F.col("__k2")), "left")
    none = F.expr("cast(array() AS array<struct<kind:string,s:int,e:int>>)")
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("__base", none).alias("base"), F.coalesce("__spans", none).alias("spans"))


def joined(spans: str) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')")


def redact(found: DataFrame, text_col: str = "text", spans: str = "spans") -> DataFrame:
    """The rows with every span in the text replaced by <KIND>; of spans that overlap, the earlier is named and the rest of the later goes."""
    ordered = f"transform(array_sort(transform({spans}, x -> struct(x.s AS s, x.e AS e, x.kind AS kind))), x -> x)"
    t = f"`{text_col}`"
    body = f"""aggregate({ordered}, struct(0 AS at, cast(array() AS array<string>) AS out), (a, x) -> struct(greatest(a.at, x.e) AS at,
        concat(a.out, CASE WHEN x.s >= a.at THEN array(substring({t}, a.at + 1, x.s - a.at), concat('<', upper(x.kind), '>')) ELSE cast(array() AS array<string>) END) AS out),
        a -> concat(array_join(a.out, ''), substring({t}, a.at + 1)))"""
    return found.withColumn(text_col, F.expr(f"CASE WHEN size({spans}) > 0 THEN {body} ELSE {t} END"))
