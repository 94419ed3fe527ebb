"""Importance resampling, periodic runs and main text of pages, against plain Python and on odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.llm import importance, queries
from quadrat.llm.html_templates import Template, candidates, counted, disordered, extract, in_order, of_page, parsed
from quadrat.llm.periodic_runs import Refinement, find_runs, made_periodic, runs_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def test_crc_states():
    r = random.Random(1)
    for _ in range(50):
        a, b = r.randbytes(r.randrange(40)), r.randbytes(r.choice([0, 1, 3, 70, 5000]))
        moved = importance.moved_on(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))
        assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("share", [(5, 100), (60, 100), (1, 1)])
def test_importance_by_force(spark, share):
    r = random.Random(7)
    words = ["the", "The", "of", "straße", "x9", "日本", "é", "long" * 20, *(f"w{i}" for i in range(60))]
    texts = [" ".join(r.choice(words) + r.choice(["", ".", "!?"]) for _ in range(r.randrange(60))) for _ in range(80)]
    rows = [*enumerate(texts), (200, None), (201, ""), (202, " . "), (3, texts[3]), (None, texts[4]), (7, texts[5]), (203, "word " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("score", F.lit("x")).withColumn("n_words", F.lit(1))
    target = spark.createDataFrame([(t,) for t in [*texts[:5], None, ""]], "text string")
    buckets, s, t = 500, [0] * 500, [0] * 500
    for _, x in rows:
        for g in features(x)[1]:
            s[zlib.crc32(g.encode()) % buckets] += 1
    for x in texts[:5]:
        for g in features(x)[1]:
            t[zlib.crc32(g.encode()) % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    want = []
    for i, x in rows:
        n, own = features(x)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in own)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((n, i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    long = sorted((x for x in want if x[0] >= 20), key=lambda x: (-x[4], x[1] is None, x[1] or 0, x[2], x[3]))
    drawn = {k: x for k, x in enumerate(long[: len(long) * share[0] // share[1]], 1)}
    got = importance.resample(docs, target, buckets=buckets, share=share).collect()
    plain = lambda x: (x is None, x)
    assert sorted((tuple(x)[:4] for x in got), key=lambda x: tuple(map(plain, x))) == sorted((x[1:] for x in want), key=lambda x: tuple(map(plain, x)))
    assert {x["rank"]: tuple(x)[:4] for x in got if x["rank"]} == {k: x[1:] for k, x in drawn.items()}
    assert importance.resample(docs.limit(0), target).count() == 0
    assert [x.weight for x in importance.resample(docs.where("doc_id = 0"), target.limit(0)).collect()]


def runs_by_force(words, times=4, least=6):
    ids: dict = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words])
    out = []
    for q in range(1, len(w) // times + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (w[q:] == w[:-q]).astype(int), [0]]))).tolist()
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a + q >= max(least, times * q) and not any(q % p == 0 and s <= a and s + n >= b + q for s, n, p in out):
                out.append((a, b - a + q, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_by_force():
    r = random.Random(2)
    met = 0
    for _ in range(250):
        texts = []
        for _ in range(r.randint(1, 5)):
            k, text = r.choice([1, 2, 2, 3, 5]), []
            for _ in range(r.choice([0, 1, 3, 12])):
                text += [r.randrange(k) for _ in range(r.randint(1, 9))] * r.randint(1, 7)
            texts.append(text)
        times, least = r.choice([2, 3, 4, 4]), r.choice([0, 6])
        word = np.array([x for t in texts for x in t], np.uint64)
        found = runs_of(word, np.array([i for i, t in enumerate(texts) for _ in t], np.int64), len(texts), times, least)
        for i, t in enumerate(texts):
            own = [(int(s), int(n), int(p)) for k, s, p, n in found if k == i]
            assert own == runs_by_force(t, times, least), (t, times, least)
            met += len(own)
    assert met > 1000


def test_smaller_halves():
    """A word repeated n times moves one position a length, and each position of any text a logarithmic number of times."""
    moved = []
    for word in (np.zeros(4000, np.uint64), np.array([int(x) for x in bin(int("110" * 1300, 2) ^ 1)[2:]], np.uint64)):
        r = Refinement(word, np.zeros(len(word), np.int64), 1, 2)
        total, length = 0, 1
        while r.alive and length < len(word) // 2:
            length += 1
            r.refine(length)
            total += len(r.small)
        moved.append(total / len(word))
    assert max(moved) < 12


def test_runs_of_documents(spark):
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(9)}" for _ in range(r.randrange(90))) + "\t x y" * r.choice([0, 5]) for _ in range(60)]
    rows = [*enumerate(texts), (None, "a a a a a a"), (None, None), (3, "b  b\n b b b b c"), (3, ""), (4, " \t"), (5, "é 日 " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("g", F.lit(2)).repartition(3)
    made = {(x.doc_id, x.text) for x in made_periodic(docs).collect()}
    want = set()
    for i, t in rows:
        w, h = re.findall("[^\x20\x09-\x0d]+", t or ""), zlib.crc32(("" if i is None else str(i)).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(n))
        want.add((i, t))
    assert made == want and len({t for _, t in made} - {t for _, t in rows}) > 2
    for x in find_runs(docs).collect():
        w = (x.text or "").split()
        runs = runs_by_force(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert [(y.start, y.length, y.period) for y in x.runs] == runs and x.collapsed == " ".join(y for k, y in enumerate(w) if k not in gone) and x.g == 2
    assert find_runs(docs).count() == len(rows) and find_runs(docs.limit(0)).count() == 0


def test_runs_query_by_force(spark):
    where = "/root/testdata/sf0.001"
    got = {x.doc_id: x for x in queries.QUERIES["op13_periodic_runs"](spark, where).collect()}
    for x in made_periodic(spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text")).collect():
        w = re.findall("[^\x20\x09-\x0d]+", x.text or "")
        runs, best = runs_by_force(w), None
        for run in runs:
            best = run if best is None or run[1] * best[2] > best[1] * run[2] else best
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(y for k, y in enumerate(w) if k not in gone))]
        assert tuple(got[x.doc_id])[1:] == (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digests)


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_pages_alone():
    own = lambda x: of_page(*parsed(x)).text(*parsed(x))
    assert own("plain &lt;text&gt; &amp; more") == "plain <text> & more"
    assert own("<p>a<br>b</p><p>c<p>d<ul><li>e<li>f</ul>") == "a b\nc\nd\ne\nf"
    assert own("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert own("<script>var x='<p>no</p>'") == "" and own("<!-- never closed <p>x") == "" and own("") == ""
    assert own("<div hidden>h</div><p style='display: none'>i</p><p>v&nbsp;&#9;w</p>") == "v w"
    assert own("x" * 200_000 + "<b>y") == "x" * 200_000 + "y"
    assert own("<div>" * 20_000 + "deep") == "deep"
    article = "<header><h1>Title</h1></header><p>Text with a <a href=x>link</a>.</p><div class='share-buttons'><a>Tweet</a></div><footer>by us</footer>"
    rest = "<header class=top><h1>Site</h1></header><nav><a>Home</a></nav><div id=cookieNotice>We use cookies</div><aside>side</aside>"
    assert own(page(f"{rest}<article class='post has-comments'>{article}</article><section class=comments><p>Nice post, much longer than the article itself is.</p></section>")) == "Title\nText with a link."
    assert own(page(f"{rest}<div class=content><h1>Title</h1><div class=text><p>One, long enough.<p>Two, as long as that.</div></div><form><p>Mail</form>")) == "Title\nOne, long enough.\nTwo, as long as that."


def test_pages_of_a_host(spark):
    """Texts that every page of a host has, and unnamed menus, go by the template; a page of another make is judged by itself."""
    r = random.Random(4)
    say = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(90)) for _ in range(n))
    wanted, rows = {}, []
    for i in range(30):
        own = [say(12), *(say(r.randint(5, 30)) for _ in range(r.randint(1, 6)))]
        menu = "".join(f"<li><a href=/{k}>{say(2)}</a>" for k in range(r.randint(2, 6)))
        body = f"<div class=upper><ul>{menu}</ul></div><div class=middle><h2>{own[0]}</h2><div class=fixed>Call us any time of the day</div>" + "".join(f"<p>{t}" for t in own[1:]) + "</div><div class=lower>All rights reserved for ever</div>"
        rows.append((i, f"https://User.Example.org:1/{i}", page(body)))
        wanted[i] = "\n".join(own)
    rows += [(100, "https://user.example.org:1/odd", page("<article><p>Other make</article>")), (101, None, None), (None, "", "<p>no host"), (102, "http://b.org", ""), (102, "http://b.org/x", page("<p>only one")), (5, *rows[5][1:])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit(2)).repartition(4)
    got = extract(df).collect()
    assert len(got) == len(rows) and {x.host for x in got} == {2}
    by = {x.page_id: x.text for x in got if x.page_id != 102}
    assert {k: v for k, v in by.items() if k in wanted} == wanted
    assert (by[100], by[101], by[None]) == ("Other make", "", "no host") and sorted(x.text for x in got if x.page_id == 102) == ["", "only one"]
    assert sum(x.page_id == 5 for x in got) == 2 and extract(df.limit(0)).count() == 0


def test_classes(spark):
    """Tokens of equal vectors are a class; one whose order changes is not valid."""
    assert in_order([1, 2, 1, 2])[1] and not in_order([1, 2, 2, 1])[1] and in_order([3])[1]
    body = ["<div class=a>x</div><div class=b>y</div>", "<div class=b>z</div><div class=a>w</div>"]
    df = spark.createDataFrame([("h", page(body[i % 2] + f"<div class=c>{i}</div>")) for i in range(10)], "host string, html string").withColumn("mark", F.xxhash64("html"))
    counts = counted(df)
    found = candidates(counts, 8, 2).collect()
    assert len(found) == 1
    import json

    rows = json.loads(found[0].template)
    vectors = {x["label"]: x["mark"] for x in rows}
    assert vectors["div a"] == vectors["div b"] == vectors["html"] == vectors["div c"]
    orders = counts.where("kind = 2").select("host", "order").withColumn("template", F.lit(found[0].template))
    assert [x.mark for x in disordered(orders).collect()] == [vectors["html"]]
    assert Template(rows, {vectors["html"]}).own == set() and len(Template(rows, set()).own) == 5
