"""Main text of web pages by equivalence classes of tokens over the pages of a host.

Tokens are elements, told apart by their path of tags (with class, id and role), and whole text blocks at their path. A token's
occurrence vector is how often it occurs in each page of its host. Vectors aren't gathered: a token has the sum over pages of its
count times the page's hash, modulo 2^64, and equal sums are equal vectors but for a chance of 2^-64. Tokens with one vector are a class. A
class of two tokens or more (or of an element that is once in nearly every page it is in) is valid if its tokens come in one
cyclic order in 95 of 100 pages that have them; elements of valid classes, nested by their paths, are the host's template. What
else is in the pages lies in its slots, each under the innermost template element.

A slot's share of text and of link text, over all pages, and the names of its elements tell whether it is main text. Text
blocks of the class of what occurs once in every page belong to the template, and are left out. A page in which its host's
template has no main text is judged by one deduced from itself alone.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter, defaultdict
from decimal import Decimal
from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, pieces, settle

#: HTML's element names by how they behave.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
CLOSES = {k: (frozenset(v.split()), within) for k, (v, within) in CLOSES.items()}
#: Elements, roles and words of class and id names of what is not main text.
OTHER_TAGS = frozenset("nav header footer aside form script style noscript template head title button select textarea svg iframe object canvas dialog menu xmp noembed noframes".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
NOT_THEN = frozenset("has with no without".split())
ARTICLE = frozenset(("article", "main"))
NEVER_OTHER = frozenset(("html", "body", "article", "main"))

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"']+)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|([^\s=/"'<>]+)""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ROOT, MASK = 0, 2**64 - 1
ELEMENT, BLOCK, PAGE = 0, 1, 2


def _named(*what: object) -> int:
    return int.from_bytes(blake2b("\x00".join(map(str, what)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Memory(dict):
    """What make(*key) gave, until there are many."""

    def __init__(self, make, most: int = 50_000):
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = out = self.make(*key)
        return out


def label_of(tag: str, attributes: str) -> tuple[str, bool]:
    """The element's name with its class, id and role, digits left out, and whether these say that it isn't main text."""
    values = {}
    for name, a, b, c, alone in ATTRIBUTE.findall(attributes):
        values.setdefault((name or alone).lower(), a or b or c)
    names = " ".join(values.get(k, "") for k in ("class", "id", "role"))
    words = [w.lower() for w in NAME.findall(names)]
    meant = {w for before, w in zip(["", *words], words, strict=False) if before not in NOT_THEN}
    other = tag in OTHER_TAGS or values.get("role", "").lower() in OTHER_ROLES or bool(meant & OTHER_WORDS)
    hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", values.get("style", ""))
    return f"{tag} {' '.join(words)}".strip(), bool(hidden) or (other and tag not in NEVER_OTHER)


class Tag:
    """What is known of a start tag as it is written."""

    __slots__ = ("closes", "head", "is_block", "is_link", "is_void", "label", "name", "other", "raw")

    def __init__(self, name: str, attributes: str):
        self.name = name = name.lower()
        self.label, self.other = label_of(name, attributes)
        self.head = self.other and (name == "header" or "header" in self.label.split()) and not set(self.label.split()[1:]) & (OTHER_WORDS - {"header"})
        self.is_block, self.is_link = name not in INLINE, name == "a"
        self.is_void = name in VOID or (attributes.endswith("/") and name in ("svg", "path"))
        self.raw = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) if name in RAW else None
        self.closes = CLOSES.get(name)


TAGS, PATHS = Memory(Tag), Memory(lambda parent, label: _named(parent, label))


class Parser:
    """One page. elements: (path, parent's path, label); blocks of text: (path, text, characters of links, elements before); both in page order.

    Elements and texts that by name aren't main text are left out. Closing tags may lack or be too many, as in HTML.
    """

    def __init__(self, page: str):
        self.elements: list[tuple[int, int, str]] = []
        self.blocks: list[tuple[int, str, int, int]] = []
        self.stack: list[tuple[Tag, int, bool]] = []  # an open element, its path, whether it is in what isn't main text
        self.open: dict[str, int] = defaultdict(int)
        self.path, self.other, self.linked = ROOT, False, 0
        self.pieces: list[str] = []
        at, more = 0, True
        while more:
            more = False
            for m in TOKEN.finditer(page, at):
                if m.start() > at and not self.other:
                    self._text(page[at : m.start()])
                at = m.end()
                if m.lastindex is None:
                    continue
                closing, name, attributes = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
                if closing:
                    self._end(name.lower())
                elif (tag := TAGS[name, attributes]).raw:
                    self._start(tag)
                    shut = tag.raw.search(page, at)
                    at, more = (shut.end(), True) if shut else (len(page), False)
                    break
                else:
                    self._start(tag)
        if at < len(page) and not self.other:
            self._text(page[at:])
        self._flush()

    def _text(self, piece: str) -> None:
        if "&" in piece:
            piece = html.unescape(piece)
        self.pieces.append(piece)
        if self.open["a"]:
            self.linked += len(piece.strip())

    def _flush(self) -> None:
        """End a block of text."""
        if self.pieces:
            if whole := " ".join("".join(self.pieces).split()):
                self.blocks.append((self.path, whole, min(self.linked, len(whole)), len(self.elements)))
            self.pieces = []
        self.linked = 0

    def _cut(self, k: int) -> None:
        """Close the open elements from number k on."""
        stack = self.stack
        for tag, _, _ in stack[k:]:
            self.open[tag.name] -= 1
            if tag.is_block:
                self._flush()
        del stack[k:]
        self.path, self.other = stack[-1][1:] if stack else (ROOT, False)

    def _end(self, name: str) -> None:
        if not self.open[name]:
            if name == "p" and not self.other:
                self._flush()
            return
        stack, k, inline = self.stack, len(self.stack) - 1, name in INLINE
        while stack[k][0].name != name:
            if inline and stack[k][0].is_block:
                return
            k -= 1
        self._cut(k)

    def _start(self, tag: Tag) -> None:
        stack = self.stack
        if tag.is_block:
            if self.open["p"] and not tag.raw:
                k = len(stack) - 1
                while stack[k][0].name not in ("p", "table", "td", "th", "button", "caption"):
                    k -= 1
                if stack[k][0].name == "p":
                    self._cut(k)
            if tag.closes:
                ends, within = tag.closes
                k, found = len(stack) - 1, -1
                while k >= 0 and stack[k][0].name not in within:
                    found = k if stack[k][0].name in ends else found
                    k -= 1
                if found >= 0:
                    self._cut(found)
            self._flush()
        elif tag.name == "br":
            self.pieces.append(" ")
        other = tag.other and not (tag.head and (self.open["article"] or self.open["main"]))  # an article has its own head
        own = self.path
        if tag.is_block and not self.other and not other:
            own = PATHS[own, tag.label]
            self.elements.append((own, self.path, tag.label))
        if not tag.is_void and not tag.raw:
            stack.append((tag, own, self.other or other))
            self.open[tag.name] += 1
            self.path, self.other = own, self.other or other


def parsed(page: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, str, int, int]]]:
    p = Parser(page)
    return p.elements, p.blocks


def _signed(x: int) -> int:
    return x - 2**64 if x >> 63 else x


class Counts:
    """What a task has counted of tokens, by host, and the tokens of each page in their order."""

    def __init__(self):
        self.rows: dict[tuple[str, int], list] = {}
        self.pages: Counter = Counter()
        self.orders: list[tuple[str, int, list[int]]] = []

    def add(self, host: str, mark: int, elements, blocks) -> None:
        self.pages[host] += 1
        number, texts, linked, about = Counter([e[0] for e in elements]), Counter(), Counter(), {ROOT: (ROOT, "", ELEMENT)}
        number[ROOT] = 1
        for own, parent, label in elements:
            about[own] = parent, label, ELEMENT
        order, done = [], 0
        for path, text, links, before in blocks:
            texts[path] += len(text)
            linked[path] += links
            name = _named(path, "text", text)
            number[name] += 1
            texts[name] += len(text)
            about[name] = path, "", BLOCK
            order += [e[0] for e in elements[done:before]]
            order.append(name)
            done = before
        self.orders.append((host, mark, order + [e[0] for e in elements[done:]]))
        for name, k in number.items():
            row = self.rows.get((host, name))
            if row is None:
                row = self.rows[host, name] = [*about[name], 0, 0, 0, 0, 0]
            row[3] += 1
            row[4] += k
            row[5] = row[5] + k * mark & MASK
            row[6] += texts[name]
            row[7] += linked[name]

    def out(self):
        """Rows of COUNTED. Text blocks that are neither in each of the host's pages here nor wherever their element is are left out."""
        rest = {key for key, row in self.rows.items() if row[2] != BLOCK or row[3] == row[4] == self.pages[key[0]] or row[5] == self.rows[key[0], row[0]][5]}
        for host, name in rest:
            parent, label, kind, pages, number, mark, chars, linked = self.rows[host, name]
            yield host, _signed(name), _signed(parent), label, kind, pages, number, Decimal(mark), chars, linked, None
        for host, mark, order in self.orders:
            names = [_signed(x) for x in order if (host, x) in rest]
            yield host, _signed(mark), ROOT, "", PAGE, 1, 1, Decimal(0), 0, 0, names


#: One row for a token of a host, or for a page (its token is its hash), with the page's tokens in order.
COUNTED = "host string, token long, parent long, label string, kind int, pages long, number long, mark decimal(20,0), chars long, linked long, order array<bigint>"
#: Tokens that a task holds at a time.
MOST_TOKENS = 100_000


def counted(pages: DataFrame) -> DataFrame:
    """Of pages (host, html, mark), what each task counts of the tokens of each host, and every page's tokens in order."""

    def batches(it):
        import pyarrow as pa

        decimal, long, string = pa.decimal128(20, 0), pa.int64(), pa.string()
        kinds = [string, long, long, string, pa.int32(), long, long, decimal, long, long, pa.list_(long)]
        names = [x.split(" ")[0] for x in COUNTED.split(", ")]

        def told(c):
            return pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*c.out(), strict=True), kinds, strict=True)], names)

        c = Counts()
        for batch in it:
            for part in pieces(batch, column="html"):
                for host, page, mark in zip(*(part.column(k).to_pylist() for k in ("host", "html", "mark")), strict=True):
                    c.add(host, mark & MASK, *parsed(page or ""))
                if len(c.rows) > MOST_TOKENS:
                    yield told(c)
                    c = Counts()
        if c.rows:
            yield told(c)

    return pages.transform(in_arrow, batches, COUNTED)


def candidates(counts: DataFrame, least_pages: int, least_tokens: int) -> DataFrame:
    """One row for each host: its template's tokens as JSON, before classes are checked for their order.

    Elements are given that are in a tenth of the pages at least (so their number is bounded by what pages hold), and marked where their
    class has least_tokens; text blocks that are once in every page, or wherever their element is, if it is in least_pages and the host has so many different ones.
    """
    sums = [F.sum(c).alias(c) for c in ("pages", "number", "mark", "chars", "linked")]
    # The sum of decimals is exact, so that it can be taken modulo 2^64 at the end.
    tokens = counts.where(f"kind <> {PAGE}").groupBy("host", "token", "parent", "label", "kind").agg(*sums).withColumn("mark", F.expr("cast(mark % 18446744073709551616BD AS decimal(20,0))"))
    tokens = settle(tokens)
    every = tokens.where(f"token = {ROOT} AND kind = {ELEMENT}").select("host", F.col("pages").alias("all"), F.col("mark").alias("once"))
    different = counts.where(f"kind = {PAGE}").select("host", "token").distinct().groupBy("host").agg(F.count("*").alias("different"))
    known = tokens.join(every, "host").join(different, "host")
    around = tokens.where(f"kind = {ELEMENT}").select("host", F.col("token").alias("parent"), F.col("mark").alias("around"))
    elements = known.where(f"kind = {ELEMENT} AND pages * 10 >= all")
    texts = known.where(f"kind = {BLOCK} AND pages >= {least_pages} AND different >= {least_pages}").join(around, ["host", "parent"]).where("mark = once AND number = all OR mark = around")
    known = elements.unionByName(texts.drop("around"))
    sizes = known.groupBy("host", "mark").agg((F.count("*") >= least_tokens).alias("large"))
    large = F.expr(f"large OR kind = {ELEMENT} AND 20 * number <= 21 * pages").alias("large")
    rows = known.join(sizes, ["host", "mark"]).select("host", F.struct("token", "parent", "label", "kind", F.col("mark").cast("string").alias("mark"), "chars", "linked", large).alias("row"))
    return rows.groupBy("host").agg(F.to_json(F.collect_list("row")).alias("template"))


def in_order(tokens: list[int]) -> tuple[int, bool]:
    """A name of the order of a class's tokens in a page, and whether they come again and again in that order."""
    k = len(set(tokens))
    cycle = tokens[:k]
    return _named(*cycle), len(set(cycle)) == k and tokens == cycle * (len(tokens) // k)


def disordered(orders: DataFrame) -> DataFrame:
    """(host, mark) of the classes whose tokens don't come in one order in 95 of 100 pages; orders: host, order and template."""

    def batches(it):
        import pyarrow as pa

        seen: Counter = Counter()
        classes: dict[str, dict[int, str]] = {}

        def told():
            rows = [(*key, n) for key, n in seen.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            return pa.record_batch([pa.array(x, k) for x, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], ["host", "mark", "first", "good", "n"])

        for batch in it:
            templates = batch.column("template")
            for i, (host, order) in enumerate(zip(batch.column("host").to_pylist(), batch.column("order").to_pylist(), strict=True)):
                if host not in classes:
                    if len(classes) > MOST_HOSTS:
                        classes.clear()
                    classes[host] = {x["token"]: x["mark"] for x in json.loads(templates[i].as_py() or "[]") if x["large"]}
                own, met = classes[host], defaultdict(list)
                for name in order:
                    if mark := own.get(name):
                        met[mark].append(name)
                for mark, names in met.items():
                    first, good = in_order(names)
                    seen[host, mark, _signed(first), good] += 1
            if len(seen) > MOST_TOKENS:
                yield told()
                seen.clear()
        yield told()

    each = orders.transform(in_arrow, batches, "host string, mark string, first long, good boolean, n long")
    kinds = each.groupBy("host", "mark", "first", "good").agg(F.sum("n").alias("n"))
    return kinds.groupBy("host", "mark").agg(F.sum("n").alias("n"), F.max(F.when(F.col("good"), F.col("n"))).alias("most")).where("most IS NULL OR 100 * most < 95 * n").select("host", "mark")


#: Hosts whose templates a task holds at a time.
MOST_HOSTS = 200


class Template:
    """A host's template: its elements, the slots with main text, and the text blocks that are the template's own."""

    def __init__(self, rows: list[dict], invalid: set[str]):
        elements = {x["token"]: x for x in rows if x["kind"] == ELEMENT}
        self.fixed = {x["token"] for x in rows if x["kind"] == BLOCK and x["large"] and x["mark"] not in invalid}
        self.own = {t for t, x in elements.items() if t != ROOT and x["large"] and x["mark"] not in invalid}
        self.parent = {t: x["parent"] for t, x in elements.items()}
        self.label = {t: x["label"] for t, x in elements.items()}
        chars, linked = Counter(), Counter()
        for t, x in elements.items():
            chars[self.slot(t)] += x["chars"]
            linked[self.slot(t)] += x["linked"]
        # Where a class has no other text, its texts are content that happens to be alike (copies of a page, say).
        of_class, alike = Counter(), Counter()
        for t in self.own:
            of_class[elements[t]["mark"]] += chars[t]
        for x in rows:
            if x["token"] in self.fixed:
                alike[x["mark"]] += x["chars"]
        self.fixed = {x["token"] for x in rows if x["token"] in self.fixed and of_class[x["mark"]] > alike[x["mark"]]}
        self.main = self._main(chars, linked)

    def slot(self, token: int) -> int:
        """The innermost template element around; 0 outside all."""
        while token and token not in self.own:
            token = self.parent.get(token, 0)
        return token

    def _from_top(self) -> list[tuple[int, int]]:
        """Each slot and the one around it, that one before; 0, outside all, is the first."""
        inside = defaultdict(list)
        for t in self.own:
            inside[self.slot(self.parent[t])].append(t)
        out, k = [(0, -1)], 0
        while k < len(out):
            out += [(t, out[k][0]) for t in inside[out[k][0]]]
            k += 1
        return out

    def _main(self, chars: Counter, linked: Counter) -> set[int]:
        tag = lambda t: self.label.get(t, "").split(" ")[0]
        tree = self._from_top()
        below, depth = Counter(), {-1: 0}  # text that isn't a link, in a slot and what it holds
        for s, around in reversed(tree):
            below[s] += chars[s] - linked[s]
            below[around] += below[s]
        for s, around in tree:
            depth[s] = depth[around] + 1
        heads: list[int] = []
        for kind in ("article", "main"):
            if heads := [t for t in self.own if tag(t) == kind and below[t] > 0]:
                most = max(below[t] for t in heads)
                heads = [t for t in heads if 2 * below[t] >= most]
                break
        if not heads:
            enough = [t for t, _ in tree if below[t] > 0 and 5 * below[t] >= 4 * below[0]]
            if not enough:
                return set()
            heads = [max(enough, key=lambda t: (depth[t], below[t], t)), *[t for t in self.own if tag(t) == "h1"]]
        main, menus = set(), set()
        for s, around in tree:
            if around in menus or (2 * linked[s] > chars[s] and tag(s) not in ("p", "blockquote", "pre", "h1", "h2", "h3", "article", "main")):
                menus.add(s)
            elif s in heads or around in main:
                main.add(s)
        return main

    def text(self, elements, blocks) -> str:
        """The blocks in slots with main text, one a line."""
        parents = {own: parent for own, parent, _ in elements}
        main: dict[int, bool] = {ROOT: 0 in self.main}

        def is_main(path: int) -> bool:
            chain = []
            while path not in main:
                if (name := _signed(path)) in self.own:
                    main[path] = name in self.main
                    break
                chain.append(path)
                path = parents[path]
            for p in chain:
                main[p] = main[path]
            return main[path]

        return "\n".join(text for path, text, *_ in blocks if is_main(path) and not (self.fixed and _signed(_named(path, "text", text)) in self.fixed))


def of_page(elements, blocks) -> Template:
    """The template that a page alone has."""
    number, chars, linked, about = Counter([ROOT]), Counter(), Counter(), {ROOT: (ROOT, "")}
    for own, parent, label in elements:
        number[own] += 1
        about[own] = parent, label
    for path, text, links, _ in blocks:
        chars[path] += len(text)
        linked[path] += links
    same = Counter(number.values())
    rows = [{"token": _signed(t), "parent": _signed(about[t][0]), "label": about[t][1], "kind": ELEMENT, "mark": "", "chars": chars[t], "linked": linked[t], "large": number[t] == 1 or same[number[t]] > 1} for t in number]
    return Template(rows, set())


#: Bytes of templates up to which they are broadcast; beyond, pages are joined with them by host, where skewed partitions are split.
MOST_BROADCAST_BYTES = 16 << 20


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_pages: int = 8, least_tokens: int = 2) -> DataFrame:
    """All columns of pages but the HTML, and text: the main text, one line a block, or empty.

    Character references are decoded, comments and markup go, white space in a block is one space. Elements named as menus, headers (but an
    article's own), footers, sidebars, notices, adverts, forms, scripts, styles or comments are left out, whatever the template. Null and empty HTML has an
    empty text. Pages whose URL is null or has no host are one host. Copies of a page count as often as they occur, but least_pages counts different pages:
    with fewer, no text block is taken for the template's own. Ids may be null or repeat. A column named text is replaced.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url_col}`"), "^[^:/?#]*://([^/?#]*)", 1), F.lit("")))
    base = pages.select(host.alias("host"), F.col(f"`{html_col}`").alias("html"), F.xxhash64(html_col).alias("mark"))
    counts = settle(counted(base))
    found = settle(candidates(counts, least_pages, least_tokens))
    small = (found.agg(F.sum(F.length("template"))).first()[0] or 0) <= MOST_BROADCAST_BYTES
    beside = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    wrong = disordered(counts.where(f"kind = {PAGE}").select("host", "order").join(beside(found), "host", "left"))
    wrong = wrong.groupBy("host").agg(F.array_join(F.collect_list("mark"), " ").alias("wrong"))
    templates = settle(found.join(wrong, "host", "left"))
    keep = [c for c in pages.columns if c.lower() != "text" and c != html_col]
    rows = pages.select(host.alias("host"), F.col(f"`{html_col}`").alias("html"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"))

    def batches(it):
        import pyarrow as pa

        known: dict[str, Template] = {}
        for batch in it:
            for part in pieces(batch, column="html"):
                template, bad, texts = part.column("template"), part.column("wrong"), []
                for i, (name, page) in enumerate(zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True)):
                    if name not in known:
                        if len(known) > MOST_HOSTS:
                            known.clear()
                        known[name] = Template(json.loads(template[i].as_py() or "[]"), set((bad[i].as_py() or "").split()))
                    elements, blocks = parsed(page or "")
                    texts.append((known[name].text(elements, blocks) or of_page(elements, blocks).text(elements, blocks)) if blocks else "")
                yield pa.record_batch([part.column("__row"), pa.array(texts, pa.string())], ["__row", "text"])

    out = rows.join(beside(templates), "host", "left").transform(in_arrow, batches, f"__row {rows.schema['__row'].dataType.simpleString()}, text string")
    return out.select(*[F.col("__row")[c].alias(c) for c in keep], "text")
