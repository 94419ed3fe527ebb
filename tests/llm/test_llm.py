"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against plain Python."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quadrat.llm import personal_data
from quadrat.llm.common import components, joined_nodes, keyed, mix64
from quadrat.llm.cover_tree import near_vectors
from quadrat.llm.language_id import identify, train
from quadrat.llm.licenses import scan
from quadrat.llm.near_dups import near_duplicates
from quadrat.llm.sentence_pieces import decode, encode
from quadrat.llm.sentence_spans import remove_repeats
from quadrat.llm.token_counts import Transducer, token_counts
from quadrat.llm.url_filters import judge
from quadrat.llm.winnowing import decontaminate

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "a", "it's 'll <|endoftext|> x", "日本語 é 👩‍👩‍👧", "▁x▁ y", "a" * 3000, "a  b \t\n c ", "x\x00y", "word " * 400]


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghij") + r.choice("aeiou") + r.choice("klmnp") + str(r.randrange(40)) + r.choice(["", "", "", "."]) for _ in range(n))


def test_sentence_pieces(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = docs(spark, ODD).withColumn("Ids", F.lit(1))
    plain = {r.doc_id: r for r in encode(df, MODEL, dropout=0.0).collect()}
    for i, t in enumerate(ODD):
        assert (plain[i].ids is None) == (t is None)
        if t and "▁" not in t:
            assert plain[i].ids == lib.encode(t)
    varied = decode(encode(df, MODEL, dropout=0.3, seed=5), MODEL).collect()
    assert all(r.decoded == r.text for r in varied)
    assert any(r.ids != plain[r.doc_id].ids for r in varied)
    assert encode(df, MODEL, dropout=0.3, seed=5).collect() == encode(df, MODEL, dropout=0.3, seed=5).collect()
    assert encode(df.limit(0), MODEL).count() == 0


def test_sentence_pieces_by_force():
    """With dropout, each occurrence is merged as a plain agenda with the same skips merges it."""
    from quadrat.llm import sentence_pieces as m

    own = m.Encoder(MODEL, 0.3)
    texts = [t or "" for t in ODD] + [prose(3, 400), "été über " * 50, "internationalization " * 40, "ab" * 300]
    names = keyed(9, len(texts))
    for _ in range(2):  # the second time from what is kept
        ids, number = own.encode(texts, names)
    got = np.split(ids, np.cumsum(number)[:-1])
    one = lambda x: np.array([x], np.uint64)
    joins = {}

    def joined(a, b):
        if (a, b) not in joins:
            place, piece = own.best(np.array([a]), np.array([b]), None, np.zeros(1), np.zeros(1))
            joins[a, b] = (int(place[0]), int(piece[0]))
        return joins[a, b]

    def merged(part, name):
        part = part.replace(m.MARK, m.OWN_MARK).replace(" ", m.MARK)
        live = [(i, i + 1, own.letters.get(x, own.unknown)) for i, x in enumerate(part)]
        while True:
            best = None
            for k, (x, y) in enumerate(zip(live, live[1:], strict=False)):
                place, piece = joined(x[2], y[2])
                if place < m.NONE and not own.skipped(one(name), one(x[0] << 32 | y[1]))[0] and (best is None or place < best[0]):
                    best = place, k, piece
            if best is None:
                return [i for a, _, i in live for i in (own.spell_out(part[a]).tolist() if i == own.unknown else [i])]
            _, k, piece = best
            live[k : k + 2] = [(live[k][0], live[k + 1][1], piece)]

    varied = 0
    for t, name, ids in zip(texts, names, got, strict=True):
        parts = m.PARTS.findall(" " + t) if t else []
        if len(parts) > 120 or max(map(len, parts), default=0) > 700:
            parts = parts[:120]  # of long ones the beginning is enough here
        wanted = [i for place, p in enumerate(parts) if len(p) <= 700 for i in merged(p, int(mix64(one(name) ^ one(place + 1) * m.PLACE)[0]))]
        assert ids[: len(wanted)].tolist() == wanted
        varied += len({tuple(merged(" internationalization", int(mix64(one(name) ^ one(k + 1) * m.PLACE)[0]))) for k in range(40)})
    assert varied > 8 * len(texts)  # a word has many segmentations
    assert own.decode(got) == texts


def test_token_counts(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    got = {r.doc_id: r.n_tokens for r in token_counts(docs(spark, ODD), BPE).collect()}
    assert got == {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(ODD)}
    machine = Transducer(BPE)
    texts = [t or "" for t in ODD] + [prose(1, 300), "ab" * 4000, "x" + "a" * 5001, "".join(random.Random(2).choice("abcde") for _ in range(6000)), "日本" * 900, " " * 700 + "z"]
    wanted = [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    for chunk in (3, 5, 64, 1024):
        assert machine.counts(texts, chunk=chunk).tolist() == wanted
    rounds = []
    run = machine.run
    machine.run = lambda *a: (rounds.append(1), run(*a))[1]
    machine.plain_counts(["".join(random.Random(3).choice("abcde") for _ in range(60_000))], 64)
    assert len(rounds) < 12  # not one for each chunk of a long pre-token


@pytest.mark.parametrize(("size", "by"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, by):
    r = random.Random(3)
    base = [prose(s, 120).split() for s in range(4)]
    texts = [None, "", "one", "one", "ONE", "two words"]
    for b in base:
        for _ in range(40):
            w = list(b)
            for _ in range(r.randrange(9)):
                w[r.randrange(len(w))] = f"new{r.randrange(1000)}"
            texts.append(" ".join(w))
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(texts)))
    for _ in range(12):
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= by * len(a | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = {x.doc_id: x for x in near_duplicates(docs(spark, texts), shingle=size, times=100, by=by).collect()}
    assert {i: x.component_id for i, x in got.items()} == dict(enumerate(root))
    assert all(got[i].n_shingles == len(s) and got[i].kept == (root[i] == i) for i, s in enumerate(sets))
    assert near_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_regions_of_long_heads():
    """A region that is longer than what is held at once keeps one name, and no other changes at a cut."""
    import pyarrow as pa

    from quadrat.llm.near_dups import DEPTH, REGION, _neighbours

    g = np.random.default_rng(4)
    keys = np.ones((430_000, DEPTH), ">u2")
    keys[450:, 3] = 2
    keys[450:, 4:] = np.minimum(g.geometric(0.02, (len(keys) - 450, DEPTH - 4)), 60)
    keys[100_000:, 3:] = 3  # of one whole key, and cut within it
    keys[:450, 5:] = g.integers(0, 9, (450, DEPTH - 5))
    keys = keys[np.lexsort(keys.T[::-1])]
    keys = np.concatenate([keys, np.full((2, DEPTH), 9, ">u2")])
    ids = np.arange(len(keys)) * 3
    whole = pa.record_batch([pa.array(np.zeros(len(ids), np.int32)), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(ids)], ["tree", "key", "id"])
    got = pa.Table.from_batches(_neighbours(3)(whole.slice(i, 10_000) for i in range(0, len(ids), 10_000)))
    names = dict(zip(got["id"].to_pylist(), got["region"].to_pylist(), strict=True))
    sizes = [np.unique(keys[:, :d], axis=0, return_inverse=True, return_counts=True) for d in range(3, DEPTH + 1)]
    groups = [(k, n[k]) for _, k, n in sizes]
    depth = np.select([n <= REGION for _, n in groups], range(len(groups)), len(groups) - 1)
    wanted = [(int(depth[i]), int(groups[depth[i]][0][i])) for i in range(len(ids))]
    alone = np.array([groups[depth[i]][1][i] == 1 for i in range(len(ids))])
    assert all((names.get(x) is None) == a for x, a in zip(ids.tolist(), alone, strict=True))
    pairs = {(w, names[x]) for w, x, a in zip(wanted, ids.tolist(), alone, strict=True) if not a}
    assert len(pairs) == len({w for w, _ in pairs}) == len({n for _, n in pairs})  # one name for each region, one region for each name
    others = dict(zip(got["id"].to_pylist(), got["other"].to_pylist(), strict=True))
    assert [others.get(x) for x in ids.tolist()] == [None, *ids[:-3].tolist(), None, ids[-2]]


def test_hot_prefixes(spark):
    """Readings of a hot head are dealt out deeper, to several tasks, and their regions are the same."""
    from quadrat.llm import near_dups as m

    g = np.random.default_rng(8)
    sig = np.tile(g.integers(0, 60_000, m.POOL), (3000, 1))
    swap = g.random(sig.shape) < np.repeat([0.0, 0.02, 0.3], 1000)[:, None]
    sig[swap] = g.integers(0, 60_000, swap.sum())
    rows = [(i, s.astype(np.uint16).tobytes()) for i, s in enumerate(sig)]
    classes = spark.createDataFrame(rows, "id long, sig binary").repartition(4)
    schema = "tree int, id long, other long, region long"

    def regions(df):
        out = {}
        for r in df.mapInArrow(m._neighbours(3), schema).where("region IS NOT NULL").collect():
            out.setdefault((r.tree, r.region), set()).add(r.id)
        return {(t, frozenset(x)) for (t, _), x in out.items()}

    plain = m._readings(classes).repartition(4, "tree").sortWithinPartitions("tree", "key", "id")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    try:
        dealt = m._sorted(classes, 3, share=1, hot=100)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert "low" in dealt.columns and "low" not in m._sorted(classes, 3, share=1, hot=100_000).columns
    assert regions(dealt) == regions(plain) == regions(m._sorted(classes, 3, share=1, hot=100_000))
    whole = m._readings(classes).groupBy("tree", "key").count().orderBy(F.desc("count")).first()
    spread = dealt.withColumn("p", F.spark_partition_id()).where((F.col("tree") == whole["tree"]) & (F.col("key") == F.lit(bytes(whole["key"])))).groupBy("p").count()
    assert spread.count() > 1


def test_components(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)], "u long, v long")
    wanted = {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}
    assert dict(components(df).collect()) == wanted
    assert dict(components(df.repartition(3), most_edges=20).collect()) == wanted
    assert components(df.limit(0)).count() == 0


def test_joined_nodes():
    g = np.random.default_rng(1)
    u, v = g.integers(-500, 500, (2, 700))
    nodes, roots = joined_nodes(u, v)
    root = {x: x for x in nodes.tolist()}
    for _ in range(1000):
        moved = False
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            low = min(root[a], root[b])
            moved |= root[a] != low or root[b] != low
            root[a] = root[b] = low
        if not moved:
            break
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == root
    turned, other = joined_nodes(u, v, lambda x: mix64(x.astype(np.uint64)))
    assert len({(root[x], y) for x, y in zip(turned.tolist(), other.tolist(), strict=True)}) == len(set(root.values()))


def test_personal_data(spark):
    texts = [None, "", "mail a@b.co or 1.2.3.4 and 999.1.1.1", "card 4111111111111111 4111111111111111", "+1 (826) 555-4081 190.137.223.204", "é a@b.c_d@e.f", "4111 1111 1111 1112", "5" * 3000]
    got = {r.doc_id: r for r in personal_data.find(docs(spark, texts).withColumn("spans", F.lit(1))).select("doc_id", personal_data.joined("base").alias("b"), personal_data.joined("spans").alias("s"), "text").collect()}
    assert got[0].b == got[1].b == got[6].b == got[7].b == ""
    assert got[2].b == "email:5:11,ip:15:22"
    assert got[3].b == "" and got[5].b == "email:2:7,email:7:13"
    assert got[4].b == "ip:18:33"
    assert personal_data.redact(personal_data.find(docs(spark, texts))).where("doc_id = 2").first().text == "mail <EMAIL> or <IP> and 999.1.1.1"
    counts = {("card", "222225"): 500, ("card", "200005"): 200}
    chance, _ = personal_data.reconcile(counts)
    assert chance["card", "222225"] > 0.9 > 0.1 > chance["card", "200005"]


def test_personal_data_by_force(spark):
    """Base spans as the contract's patterns give them, in texts of pieces that touch and overlap, and in one with many."""

    def luhn(d):
        return sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    r = random.Random(5)
    some = ["a@b.c", "1.2.3.4", "256.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (826) 555-4081", "+12", ".", "@", " ", "-", "é", "x", "7", "+", "(", "\n", "_", "a.b"]
    texts = ["".join(r.choice(some) for _ in range(r.randrange(1, 30))) for _ in range(400)]
    texts += [" ".join(f"me{i}@host{i}.com 10.0.{i % 300}.1" for i in range(2500)), "1" * 5000, "1." * 3000, "a." * 3000 + "@", "+1" + "-" * 4000]
    got = {x.doc_id: x.b for x in personal_data.find(docs(spark, texts)).select("doc_id", personal_data.joined("base").alias("b")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ",".join(f"{k}:{m.start()}:{m.end()}" for k, (p, good) in rules.items() for m in re.finditer(p, t) if good(m[0]))


def test_personal_data_learns(spark):
    """The classifier tells spans that labelers agree on from those of another shape, and never adds one that fails its check."""
    good = [f"Call me, phone 212-555-{i:04d} today" for i in range(60)]
    bad = [f"version 12 1234 {i:04d} x" for i in range(60)]
    cards = [f"card: 4111 1111 1111 {i:04d}x" for i in range(100, 160)]
    found = personal_data.find(docs(spark, good + bad + cards)).select("doc_id", personal_data.joined("spans").alias("s")).collect()
    got = {x.doc_id: x.s for x in found}
    assert sum(got[i] == "phone:15:27" for i in range(60)) == 60 and not any("phone" in got[i] for i in range(60, 120))
    assert not any(got[i] for i in range(120, 180) if not personal_data_luhn(f"411111111111{i - 20:04d}"))
    assert personal_data.find(docs(spark, ["x"]).limit(0)).count() == 0
    same = personal_data.find(docs(spark, ["a@b.co"] * 3).withColumn("doc_id", F.lit(None).cast("long")).withColumn("Base", F.lit(1)))
    assert [x.base[0].s for x in same.collect()] == [0, 0, 0]


def personal_data_luhn(d):
    return sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0


def test_url_filter(spark):
    rows = [(1, "http://a.example.com/en/5", None), (2, "https://www.b.org/x/", None), (3, "http://b.org/x", '<link rel="canonical" href="http://a.example.com/en/5">'), (4, None, None), (5, "none", ""), (6, "http://example.com/en/77", "<meta http-equiv='refresh' content='0;url=http://c.net/q?x'>"), (7, "https://C.net:443/q?x#u", None), (8, "HTTP://A.EXAMPLE.com/en/5#t", None), (None, "http://c.com/en/", None)]
    rules = [("block", "com", "en/"), ("allow", "example.com", "en/7")]
    got = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert [got[i].verdict for i in range(1, 9)] == ["block", "allow", "block", "allow", "allow", "allow", "allow", "block"]
    assert got[1].rule == "com/en/" and got[6].rule == "example.com/en/7" and got[4].host == "" and got[8].host == "a.example.com"
    assert [got[i].component for i in (1, 3, 6, 7, 8)] == [1, 1, 6, 6, 1] and got[None].verdict == "block"
    assert judge(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0), rules).count() == 0


def test_url_filter_targets(spark):
    link, turn = "<link rel='canonical' href='{}'>", "<meta http-equiv='refresh' content='0;url={}'>"
    rows = [(1, "http://x.com/a/b.html?q", link.format("../c/./d")), (2, "http://x.com/c/d", None), (3, "http://y.org/p", link.format("//bad.net/de/1")), (4, "http://z.org/a", turn.format("/b") + turn.format("http://bad.net/de/2")), (5, "http://z.org/b", None), (6, "http://w.org/a/b", turn.format("c")), (7, "http://w.org/a/c", None), (8, "none", link.format("/c/d"))]
    rows += [(9, "http://q.com/p?id=1", link.format("http://bad.net/de/3")), (10, "http://q.com/p?id=2", None), (11, "http://q.com/p?id=3", '<LINK href=/p?id=2 REL="alternate Canonical">'), (12, "http://q.com/p", link.format("?id=4")), (13, "http://q.com/p?id=4", "<link rel=canonicals href=http://bad.net/de/1>")]
    got = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string"), [("block", "bad.net", "de/")]).collect()}
    assert [got[i].component for i in range(1, 14)] == [1, 1, 3, 4, 4, 6, 6, 8, 9, 10, 10, 12, 12]
    assert [i for i in range(1, 14) if got[i].verdict == "block"] == [3, 4, 5, 9]


def test_url_filter_sql(spark, tmp_path):
    """The registered SQL agrees on pages with links of all kinds but dot segments."""
    import duckdb

    from quadrat.llm.queries import ORACLE_SQL, RULES

    r = random.Random(2)
    hosts = ["a.com", "b.net", "example.com", "x.example.net", "c.org"]
    url = lambda: f"http://{r.choice(hosts)}/{r.choice(['en', 'de', 'es', 'q'])}/{r.randrange(12)}{r.choice(['', '', '?a=1', '#z'])}"
    tags = [lambda: f'<link rel="canonical" href="{url()}">', lambda: f'<link rel="next canonical" href="{url()[5:]}">', lambda: f'<meta http-equiv="refresh" content="0; url=/en/{r.randrange(9)}">', lambda: "<p>x</p>"]
    rows = [(i, url(), "<html>" + "".join(r.choice(tags)() for _ in range(r.randrange(3)))) for i in range(120)] + [(200, None, None), (201, "x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    own = duckdb.connect()
    df.toPandas().to_parquet(tmp_path / "pages.parquet")
    own.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    wanted = sorted(own.sql(ORACLE_SQL["op4_url_filter"]).fetchall())
    got = sorted(tuple(x) for x in judge(df, RULES).collect())
    assert got == wanted and len({x[5] for x in got}) < 100


def test_url_filter_contract(spark, tmp_path):
    """The query's rules are the contract's, in code and SQL."""
    import duckdb

    from quadrat.llm.queries import ORACLE_SQL, QUERIES

    urls = ["http://a.com/en/1", "http://a.example.com/en/7", "http://a.net/de/1", "http://x.example.net/de/8", "http://x.example.net/de/7", "http://a.org/es/", "http://a.org/de/"]
    wanted = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block"), (None, "allow")]
    spark.createDataFrame([(i, u, "<p>x</p>") for i, u in enumerate(urls)], "page_id long, url string, html string").toPandas().to_parquet(tmp_path / "pages.parquet")
    got = QUERIES["op4_url_filter"](spark, str(tmp_path)).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == wanted
    own = duckdb.connect()
    own.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    assert [x[3:5] for x in sorted(own.sql(ORACLE_SQL["op4_url_filter"]).fetchall())] == wanted


def test_language_id(spark):
    r = random.Random(1)
    word = {"xx": lambda: r.choice(["lorem", "ipsum", "dolor"]), "yy": lambda: r.choice(["straße", "über", "ähnlich"])}
    rows = [(i, " ".join(word[k]() for _ in range(20)), k) for i, k in enumerate(["xx", "yy"] * 60)]
    df = spark.createDataFrame(rows + [(900, None, "xx"), (901, "12 34 !", None), (902, "", "yy")], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in identify(df, train(df.where("doc_id < 80"))).collect()}
    assert all(got[i].lang_pred == k and got[i].score > 0.5 for i, _, k in rows)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[901].score == 0
    assert identify(df, train(df.limit(0))).first().lang_pred == "und"


def test_near_vectors(spark):
    g = np.random.default_rng(0)
    x = g.normal(size=(150, 8))
    x = np.concatenate([x, x[:40] + g.normal(size=(40, 8)) * 0.2, x[:5], x[:5] * 3])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, []), (904, [1.0, None])]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = (u @ u.T >= 0.9).sum(1) - 1
    assert [got[i].n_links for i in range(len(x))] == n.tolist() and all(got[i].n_links == 0 and got[i].kept for i in range(900, 905))


def test_winnowing(spark):
    item = prose(9, 20).replace(".", "")
    texts = [None, "", f"before {item} after", prose(10, 300) + " " + item + " " + prose(11, 900), item.rsplit(" ", 8)[0], "short one", "a short one here"]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "Short one"), (3, "Short one")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate(docs(spark, texts).withColumn("N_hit", F.lit(1)), bench).collect()}
    assert [got[i].n_hit for i in range(7)] == [0, 0, 20, 20, 0, 2, 2]
    assert got[2].items == ["1"] and got[6].items == ["3"] and got[2].contaminated and not got[3].contaminated
    other = prose(12, 30).replace(".", "")
    two = decontaminate(docs(spark, [item + " " + other]), spark.createDataFrame([(1, item), (1, other)], "item_id long, text string")).first()
    assert (two.n_hit, two.items) == (50, ["1"])


def test_winnowing_sql(spark, tmp_path):
    """The registered SQL agrees on texts that hold whole, cut, altered and repeated items, and on repeated rows, ids and items."""
    import duckdb

    from quadrat.llm.queries import ORACLE_SQL

    r = random.Random(6)
    words = lambda n: [r.choice("abcdefgh") + str(r.randrange(9)) for _ in range(n)]
    items = [words(r.choice([1, 3, 12, 13, 14, 20, 40])) for _ in range(14)] + [["x"] * 30, []]
    texts = [None, "", "x " * 50]
    for _ in range(60):
        w = words(r.randrange(60))
        for _ in range(r.randrange(3)):
            x = r.choice(items)
            lo = r.randrange(len(x) + 1)
            at = r.randrange(len(w) + 1)
            w[at:at] = r.choice([x, x[lo:], x[:lo], x + x])
        texts.append(r.choice([" ", ", ", "\n"]).join(w).upper())
    df = docs(spark, texts + texts[:9])
    bench = spark.createDataFrame([(i % 12, " ".join(x)) for i, x in enumerate(items)] + [(3, " ".join(items[3])), (None, "x"), (90, None)], "item_id long, text string")
    for name, t in (("documents", df), ("benchmark", bench)):
        t.toPandas().astype({c: "Int64" for c in t.columns if c != "text"}).to_parquet(tmp_path / f"{name}.parquet")
    own = duckdb.connect()
    for name in ("documents", "benchmark"):
        own.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    wanted = sorted(own.sql(ORACLE_SQL["op8_winnowing"].replace("FROM benchmark)", "FROM benchmark WHERE item_id IS NOT NULL)")).fetchall())
    got = decontaminate(df.repartition(3), bench).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated")
    assert sorted(tuple(x) for x in got.collect()) == wanted and sum(x[2] > 0 for x in wanted) > 20
    assert decontaminate(df, bench.limit(0)).where("n_hit > 0").count() == 0 and decontaminate(df.limit(0), bench).count() == 0


def test_licenses(spark):
    mit = """Copyright (c) 2019 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
    gpl = """/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version. */ int main() {}"""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer."""
    texts = [None, "", "x", "text\nReleased under the MIT license\nmore", "Released under the ABC thing", "Licensed under CC BY-NC 4.0.", "Copyright 2024 X. All rights reserved. Released under the MIT License.", mit, "code " * 500 + gpl, bsd, gpl, gpl]
    df = docs(spark, texts).withColumn("Dice", F.lit("x"))
    got = {r.doc_id: r for r in scan(df).collect()}
    assert [got[i].licenses for i in range(12)] == ["", "", "", "MIT", "", "CC-BY-NC-4.0", "MIT", "MIT", "GPL-3.0", "BSD", "GPL-3.0", "GPL-3.0"]
    assert got[5].dice == 100 and got[3].n_templates == 1
    assert scan(df.limit(0)).count() == 0
    own = scan(df, spark.createDataFrame([("own", "code code int main"), ("none", "word")], "name string, text string"))
    assert [r.licenses for r in own.collect() if r.licenses] == []


def test_licenses_sql(spark, tmp_path):
    """The registered SQL agrees on texts that hold altered notices among other words."""
    import duckdb

    from quadrat.llm.licenses import TEMPLATES
    from quadrat.llm.queries import ORACLE_SQL

    r = random.Random(8)
    texts = [None, ""]
    for i in range(60):
        w = TEMPLATES[i % len(TEMPLATES)][1].split()
        for _ in range(r.randrange(1 + len(w) // 6)):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], ["other"], [w[k], "and"], [w[k] + "\n"], [w[k] + "\n\n"]])
        texts.append(r.choice(["", "Some words before. ", "a line\n"]) + " ".join(w) + r.choice(["", " and words after", "\nend"]))
    df = docs(spark, texts)
    df.toPandas().to_parquet(tmp_path / "documents.parquet")
    own = duckdb.connect()
    own.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    wanted = sorted(own.sql(ORACLE_SQL["op9_license_scan"]).fetchall())
    assert sorted(tuple(x) for x in scan(df).select("doc_id", "licenses", "n_templates", "dice").collect()) == wanted
    assert 20 < sum(bool(x[1]) for x in wanted) < 60


def test_sentence_spans(spark):
    passage = prose(20, 60)
    texts = [prose(21, 50) + ".\n" + passage + ".\nend one.", None, "", passage + ".", "unlike. " + prose(22, 80), "start.\n" + passage + "."]
    got = {r.doc_id: r for r in remove_repeats(docs(spark, texts)).collect()}
    assert [got[i].n_removed > 0 for i in range(6)] == [False, False, False, True, False, True]
    assert got[0].text == texts[0] and got[4].text == texts[4] and got[1].text is None and got[5].text.startswith("start.")


def test_sentence_spans_by_force(spark):
    """Against every run of the same sentences in plain Python: what is removed is what lies in a repeated span that isn't the first."""
    from quadrat.llm import sentence_spans as m

    r = random.Random(4)
    common = [[" ".join(prose(100 + k, n).replace(".", "").split()) + "." for n in (9, 7, 12, 5, 15)] for k in range(6)]
    texts = []
    for i in range(40):
        own = [" ".join(prose(500 + i * 10 + k, r.randrange(3, 16)).replace(".", "").split()) + "." for k in range(r.randrange(1, 6))]
        for _ in range(r.randrange(3)):
            c = r.choice(common)
            lo = r.randrange(len(c))
            own[(k := r.randrange(len(own) + 1)) : k] = c[lo : r.randrange(lo + 1, len(c) + 1)]
        texts.append(" ".join(own))
    texts += [texts[5], None, "", "x"]
    split = [re.findall(r"[^.]+\.", t or "") or ([t] if t else []) for t in texts]

    def spans(sentences):
        n = [len(x.split()) for x in sentences]
        starts = [(i, next((j for j in range(i + 2, len(n) + 1) if sum(n[i:j]) >= 25), None)) for i in range(len(n))]
        ends = [(next((i for i in range(j - 2, -1, -1) if sum(n[i:j]) >= 25), None), j) for j in range(1, len(n) + 1)]
        return sorted({(i, j) for i, j in starts + ends if i is not None and j is not None})

    first, number = {}, {}
    for d, sentences in enumerate(split):
        for i, j in spans(sentences):
            key = tuple(" ".join(sentences[i:j]).lower().split())
            first.setdefault(key, (d, i))
            number[key] = number.get(key, 0) + 1
    gone = [{k for i, j in spans(x) if first[key := tuple(" ".join(x[i:j]).lower().split())] != (d, i) for k in range(i, j)} for d, x in enumerate(split)]
    got = {x.doc_id: x for x in remove_repeats(docs(spark, texts).repartition(3)).collect()}
    assert [got[i].n_removed for i in range(len(texts))] == [len(g) for g in gone]
    assert [len(split[i]) for i in range(40)] == [got[i].n_sentences for i in range(40)] and sum(map(len, gone)) > 20
    assert all((got[i].text or "").split() == " ".join(s for k, s in enumerate(split[i]) if k not in gone[i]).split() for i in range(len(texts)))
    same = remove_repeats(docs(spark, texts[:2] * 2).withColumn("doc_id", F.lit(7)).withColumn("N_removed", F.lit("x"))).collect()
    assert len(same) == 4 and remove_repeats(docs(spark, texts).limit(0)).count() == 0


def test_sentence_spans_of_odd_ids(spark):
    """Rows that share an id, or have none, are told apart by their texts: a passage that repeats is cut out of the later rows that hold it alone."""
    p, x, y = prose(31, 60) + ".", "Other. " + prose(32, 60) + ".", prose(33, 40) + ". " + prose(34, 30) + "."
    run = lambda rows: sorted(((i is None, i, t) for i, t in (tuple(r) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "text").collect())), key=str)
    assert [t for *_, t in run([(1, p), (None, p), (None, x), (None, y)])] == [p, *sorted(["", x, y])]
    assert sorted(t for *_, t in run([(1, p), (2, p), (2, x)])) == sorted([p, "", x])
    assert sorted(t for *_, t in run([(2, x), (None, p), (2, p + " " + y), (1, y)])) == sorted([x, "", p + " ", y])


def test_sentence_spans_by_number(spark):
    """With no least number of words, every run of so many sentences is hashed."""
    texts = ["One of them. Two of them. Three of them. Own end.", "Begin. One of them. Two of them. Three of them.", "One of them. Two of them. Else."]
    got = {r.doc_id: r.text for r in remove_repeats(docs(spark, texts), least_words=0, least_sentences=3).collect()}
    assert got == {0: texts[0], 1: "Begin. ", 2: texts[2]}
    got = {r.doc_id: r.text for r in remove_repeats(docs(spark, texts), least_words=0).collect()}
    assert got == {0: texts[0], 1: "Begin. ", 2: "Else."}


@pytest.mark.parametrize("lengths", [[30, 30, 5], [30, 14, 3, 2], [70]])
def test_sentence_spans_cover(lengths):
    """All of a passage that repeats lies in common spans, but for what is near its ends within a long sentence."""
    from quadrat.llm import sentence_spans as m

    for seed in range(20):
        words = prose(seed, sum(lengths)).replace(".", "").split()
        ends = np.cumsum(lengths)
        passage = " ".join(w + "." * (i + 1 in ends) for i, w in enumerate(words))
        inner = len(lengths) == 1  # the passage begins and ends in a sentence
        texts = [passage, ("some words and no stop " if inner else "Some words. ") + passage + (" and on" if inner else " And on.")]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        s = m.Sentences(data, np.cumsum([0, *map(len, texts)]), 16)
        assert (s.stop - s.first).max() <= 16
        try:
            a, b, h1, _ = m.span_hash_pairs(s, 25)
        except TypeError:
            a, b, h1, _ = m.span_hash_pairs(data, s, 25)
        both = np.intersect1d(h1[s.owner[a] == 0], h1[s.owner[a] == 1])
        held = np.zeros(len(words), bool)
        for i, j in zip(a[np.isin(h1, both) & (s.owner[a] == 0)], b[np.isin(h1, both) & (s.owner[a] == 0)], strict=True):
            held[s.first[i] : s.stop[j - 1]] = True
        assert held[31:-31].all() and held.any() if inner else held.all()
    same = np.frombuffer(b"word " * 400, np.uint8)
    s = m.Sentences(same, np.array([0, len(same)]), 16)
    assert (s.stop - s.first).max() <= 16 and len(s.first) <= 26
