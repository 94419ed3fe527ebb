"""Every operator on one odd table: null ids and texts, empty, repeated and very long rows, one id for two texts, clashing columns, no rows."""

import pytest
from pyspark.sql import functions as F

from quadrat.llm import queries
from quadrat.llm.cover_tree import near_vectors
from quadrat.llm.language_id import identify, train
from quadrat.llm.licenses import scan
from quadrat.llm.near_dups import near_duplicates
from quadrat.llm.personal_data import find
from quadrat.llm.sentence_pieces import decode, encode
from quadrat.llm.sentence_spans import remove_repeats
from quadrat.llm.token_counts import token_counts
from quadrat.llm.url_filters import judge
from quadrat.llm.winnowing import decontaminate

LONG = "A sentence of eight words, then it ends. " * 6000
TEXTS = [(1, "one two three four"), (1, "one two three four"), (1, "another text of that id"), (None, "one two three four"), (None, None), (2, None), (2, ""), (3, LONG), (4, LONG), (5, " \t\n"), (6, "mail a@b.co Released under the MIT License.")]
BPE, PIECES = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")
CLASHING = ["ids", "n_tokens", "n_bytes", "base", "spans", "lang_pred", "score", "n_words", "n_hit", "items", "contaminated", "licenses", "dice", "n_sentences", "n_removed", "kept", "component_id", "h1", "mark", "KEY", "tree"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*x, "xx") for x in TEXTS], "doc_id long, text string, lang string").repartition(3).select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three four"), (1, "one two three four"), (None, "x"), (2, None), (2, "")], "item_id long, text string")


OPERATORS = {
    "encode": lambda d, b: decode(encode(d, PIECES), PIECES),
    "near": lambda d, b: near_duplicates(d, shingle=3, by=85),
    "find": lambda d, b: find(d),
    "identify": lambda d, b: identify(d, train(d)),
    "count": lambda d, b: token_counts(d, BPE),
    "decontaminate": lambda d, b: decontaminate(d, b),
    "scan": lambda d, b: scan(d),
    "spans": lambda d, b: remove_repeats(d),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(docs, benchmark, name):
    out = OPERATORS[name](docs, benchmark)
    rows = out.collect()
    assert len(rows) == len(TEXTS) and len(set(map(str.lower, out.columns))) == len(out.columns)
    by = lambda c: sorted((-1 if r.doc_id is None else r.doc_id, r[c] if r[c] is not None else -1) for r in rows)
    if name not in ("near", "count"):  # those return their own columns alone
        made = {"encode": ["ids", "n_tokens"], "find": ["base", "spans"], "identify": ["lang_pred", "score"], "decontaminate": ["n_words", "n_hit", "items", "contaminated"], "scan": ["licenses", "dice"], "spans": ["n_sentences", "n_removed"]}[name]
        assert all(r[c] == CLASHING.index(c) for r in rows for c in CLASHING if c not in made)
    if name == "encode":
        assert all(r.decoded == r.text for r in rows)
    if name == "near":
        assert by("component_id") == [(-1, -1), (-1, -1), (1, 1), (1, 1), (1, 1), (2, 2), (2, 2), (3, 3), (4, 3), (5, 5), (6, 6)]
        assert sum(r.kept for r in rows) == 10
    if name == "decontaminate":
        assert sum(r.contaminated for r in rows) == 3 and all((r.n_hit == 4) == (r.text == "one two three four") for r in rows)
    if name == "scan":
        assert [r.licenses for r in rows if r.doc_id == 6] == ["MIT"] and sum(bool(r.licenses) for r in rows) == 1
    if name == "spans":
        got = {r.doc_id: r for r in rows}
        assert got[3].n_removed > 5900 and got[4].n_removed == got[4].n_sentences and got[2].n_sentences == 0
        assert [r.text for r in rows if r.doc_id == 1].count("one two three four") == 2
    if name == "identify":
        assert {r.lang_pred for r in rows if not (r.text or "").strip()} == {"und"} and {r.lang_pred for r in rows if (r.text or "").strip()} == {"xx"}
    if name == "count":
        assert by("n_bytes")[:2] == [(-1, 0), (-1, 18)]
    assert OPERATORS[name](docs.limit(0), benchmark).count() == 0


def test_odd_pages(spark):
    rows = [(1, "http://a.com/en/1", "<link rel=canonical href=http://b.com/>"), (1, "http://c.com/x", None), (None, "http://b.com", None), (2, None, "<link rel=canonical href=/x>"), (3, "http://b.com/", "x" * 300_000 + "<link"), (3, "http://b.com/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("component", F.lit(9)).withColumn("verdict", F.lit("x"))
    got = judge(df, [("block", "com", "en/")])
    assert got.count() == 6 and sorted((r.page_id or 0, r.verdict) for r in got.collect()) == [(0, "allow"), (1, "block"), (1, "block"), (2, "allow"), (3, "block"), (3, "block")]
    ties = [("allow", "a.com", "en/"), ("block", "a.com", "en/")]
    assert judge(df, ties).where("page_id = 1 AND host = 'a.com'").first().verdict == judge(df, ties[::-1]).where("page_id = 1 AND host = 'a.com'").first().verdict


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [float("inf"), 0.0]), (5, [1.0, 0.0, 0.0]), (6, [1e-200, 1e-200]), (7, [1e200, 1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("kept", F.lit(1)).withColumn("unit", F.lit(1))
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in near_vectors(df).collect())
    assert got == [(0, 0, 0), (1, 0, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6)]
    assert near_vectors(df.limit(0)).count() == 0
