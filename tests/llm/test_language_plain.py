"""The query of language identification against a plain Python version of the whole: n-grams, TF-IDF, the regularised leader, temperature."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import regex

from quadrat.llm.language_id import frequencies, identify, train
from quadrat.llm.queries import op5_language_id

SF = "/root/testdata/sf0.001"
BINS = 1 << 14
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ x >> shift) * factor % 2**64
    return x >> 50


def grams(text):
    """Counts of the bins of n-grams with a letter, and of those of letters alone."""
    points = []
    for ch in text.lower():
        if regex.fullmatch(r"\p{L}", ch):
            points.append(ord(ch))
        elif points and points[-1]:
            points.append(0)
    if points and points[-1]:
        points.append(0)
    every, letters = Counter(), Counter(mixed(p) for p in points if p)
    for n in (1, 2, 3):
        for i in range(len(points) - n + 1):
            some = points[i : i + n]
            if any(some):
                key = 0
                for p in some:
                    key = key << 21 | p
                every[mixed((key ^ (n << 61 if n > 1 else 0)) % 2**64)] += 1
    return every, letters


def odds(logits, t=1.0):
    e = [math.exp((x - max(logits)) / t) for x in logits]
    return [x / sum(e) for x in e]


class Plain:
    def __init__(self, rows):
        """rows: (text, language), in the order of their marks."""
        found = [grams(t) for t, _ in rows]
        seen = Counter(b for every, _ in found for b in every)
        self.idf = lambda b: math.log((1 + len(rows)) / (1 + seen[b])) + 1
        self.known = {b for _, letters in found for b in letters}
        self.langs = sorted({lang for _, lang in rows})
        xs = [self.values(every, np.float32) for every, _ in found]
        fit = [i for i in range(len(rows)) if i % 5 != 4]
        self.z, self.n = {}, {}
        lots = np.random.default_rng(7)
        for _ in range(3):
            for k in lots.permutation(len(fit)):
                x, label = xs[fit[k]], self.langs.index(rows[fit[k]][1])
                w = {b: [self.weight(b, j) for j in range(len(self.langs))] for b in x}
                p = odds([sum(v * w[b][j] for b, v in x.items()) for j in range(len(self.langs))])
                for b, v in x.items():
                    for j, pj in enumerate(p):
                        g, n = v * (pj - (j == label)), self.n.get((b, j), 0.0)
                        sigma = (math.sqrt(n + g * g) - math.sqrt(n)) / ALPHA
                        self.z[b, j] = self.z.get((b, j), 0.0) + g - sigma * w[b][j]
                        self.n[b, j] = n + g * g
        held = [(self.logits(xs[i]), self.langs.index(rows[i][1])) for i in range(len(rows)) if i % 5 == 4]
        loss = lambda t: -sum(math.log(odds(x, t)[label] + 1e-12) for x, label in held) / len(held)
        self.temperature = min((0.2 * 100 ** (i / 59) for i in range(60)), key=loss)

    def values(self, every, kind=float):
        total = sum(every.values())
        return {b: float(kind(c / total)) * self.idf(b) * 100 for b, c in every.items()} | {BINS: 1.0}

    def weight(self, b, j):
        z = self.z.get((b, j), 0.0)
        return 0.0 if abs(z) <= L1 else -(z - math.copysign(L1, z)) / ((BETA + math.sqrt(self.n[b, j])) / ALPHA + L2)

    def logits(self, x):
        return [sum(v * self.weight(b, j) for b, v in x.items()) for j in range(len(self.langs))]

    def predict(self, text):
        every, letters = grams(text or "")
        if not letters:
            return "und", 0.0
        p = odds(self.logits(self.values(every)), self.temperature)
        best = max(range(len(p)), key=p.__getitem__)
        return self.langs[best], p[best] * sum(c for b, c in letters.items() if b in self.known) / sum(letters.values())


def marks(spark, rows):
    """(id, text, language) in the order of the hash by which training rows are sorted."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "id string, text string, lang string").where("text IS NOT NULL AND lang IS NOT NULL")
    return [(r.text, r.lang) for r in df.withColumn("mark", F.xxhash64("id", "text")).orderBy("mark", "lang").collect()]


def test_query_is_the_plain_version(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    held = lambda d: zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2
    plain = Plain(marks(spark, [(str(d["doc_id"]), d["text"], d["lang"]) for d in docs if not held(d)]))
    got = {r.doc_id: r for r in op5_language_id(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        lang, score = plain.predict(d["text"])
        r = got[d["doc_id"]]
        assert r.lang_pred == lang and abs(r.score - score) < 1e-6 and r.held_out == held(d)


def test_weights(spark):
    """Weights, constant and temperature themselves, on texts that begin and end with letters, gaps or nothing."""
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["über", "straße", "weg"], "cc": ["два", "три", "пять"]}
    rows = [(str(i), ["", " ", "7 "][i % 3] + " ".join(words[k][(i * j) % 3] for j in range(1, 9)) + ["", "!", " 3"][i % 4 % 3], k) for i, k in enumerate(["aa", "bb", "cc"] * 20)] + [("x", None, "aa"), ("y", "lorem", None), ("z", "", "bb")]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    plain, model = Plain(marks(spark, rows)), train(df)
    assert model.langs == plain.langs and model.temperature == pytest.approx(plain.temperature)
    want = np.array([[plain.weight(b, j) * plain.idf(b) * 100 for j in range(3)] for b in range(BINS)])
    assert np.allclose(model.weights, want, atol=1e-6) and np.allclose(model.bias, [plain.weight(BINS, j) for j in range(3)], atol=1e-6)
    assert set(np.flatnonzero(model.known)) == plain.known


def test_alone_or_among_others(spark):
    """A text's score doesn't depend on which texts are beside it."""
    rows = [(i, t, k) for i, (t, k) in enumerate([("lorem ipsum dolor", "aa"), ("über straße weg", "bb")] * 40)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["7 lorem", "über", " weg 1", "lorem dolor!", "", "x"]
    for some in (texts, texts[::-1], [""], []):
        for found, text in zip(frequencies(some), some, strict=True):
            assert {b: n for b, n in enumerate(found) if n} == grams(text)[0]
    together = model.predict(texts)[1]
    assert np.allclose(together, [model.predict([t])[1][0] for t in texts], rtol=0, atol=1e-12)
    assert np.allclose(together[::-1], model.predict(texts[::-1])[1], rtol=0, atol=1e-12)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert np.allclose([r.score for r in identify(df, model).orderBy("doc_id").collect()], together, rtol=0, atol=1e-12)
