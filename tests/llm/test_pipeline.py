"""The stages of the corpus pipeline on small tables with nulls, empty and repeated rows and clashing columns, and the whole against plain Python."""

import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quadrat.llm.near_dups import one_of_each

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
STAGE = dict(corpus_pipeline.STAGES)


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "magna"]) + str(r.randrange(30)) for _ in range(n))


def german(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["straße", "über", "ähnlich", "größer"]) + str(r.randrange(30)) for _ in range(n))


def row(i, text, lang="xx"):
    return (i, text, lang, "s", None if text is None else len(text))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, words(900, 40)), (2, "short item here now"), (3, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def made(spark):
    rows = [row(i, words(i, 60)) for i in range(20)] + [row(i, german(i, 60), "yy") for i in range(20, 40)]
    near = words(3, 60).split()
    near[30] = "other"
    long = words(8, 400).split()
    rows += [row(40, " ".join(near)), row(41, words(3, 60)), row(42, words(901, 10) + " " + words(900, 40)), row(43, "mail me@here.org now " + words(44, 30))]
    rows += [row(45, " ".join(long)), row(46, " ".join(long[:398])), row(None, words(5, 60)), row(47, None), row(48, ""), row(49, "12 34 !"), rows[7], row(None, None), row(50, words(950, 9000))]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.mark.parametrize("name", list(STAGE))
def test_stage_edges(spark, folder, name):
    docs = made(spark).withColumn("items", F.lit("mine")).withColumn("Spans", F.lit(2)).withColumn("component", F.lit(1)).withColumn("kept", F.lit(False)).withColumn("id", F.lit("x"))
    out = STAGE[name](spark, docs, folder)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert rows and all(r["items"] == "mine" and r.Spans == 2 and r.id == "x" for r in rows)
    assert STAGE[name](spark, docs.limit(0), folder).count() == 0
    if name in ("decontamination", "personal_data", "sentence_pieces"):
        gone = {42} if name == "decontamination" else set()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id not in gone)
    if name == "personal_data":
        got = {r.doc_id: r for r in rows}
        assert got[43].text.startswith("mail <EMAIL> now") and got[43].n_chars == len(got[43].text) and got[47].text is None
        assert all(got[r.doc_id].text == r.text for r in docs.collect() if r.doc_id not in (43, None))
    if name == "language_id":
        assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in rows} == {47, 48, 49}
    if name == "sentence_pieces":
        got = {r.doc_id: r for r in rows}
        assert got[47].ids is None and got[48].ids == [] and got[50].n_tokens == len(got[50].ids)


def test_language_rejects_what_it_cannot_place(spark, folder):
    docs = made(spark).where("doc_id < 40").unionByName(spark.createDataFrame([row(60, "ωψξ λκιδ ωψξ λκιδ", None)], COLUMNS))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, folder, least_score=0.9).collect()}
    assert kept == set(range(40))


def kept_by_force(rows, size=5, by=80):
    """The rows that near-dedup keeps: of each group the smallest id, null last; rows alike in id and text are one."""
    one = {}
    for r in rows:
        one.setdefault((r.doc_id is None, r.doc_id, r.text), r)
    told = list(one.values())
    sets = []
    for r in told:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").lower())
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    group = list(range(len(told)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= by * len(a | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    best = {}
    for g, r in zip(group, told, strict=True):
        best[g] = min(best.get(g, r), r, key=lambda x: (x.doc_id is None, x.doc_id or 0))
    return sorted((str(r.doc_id), r.text or "") for r in best.values())


def test_near_dedup_by_force(spark):
    docs = made(spark)
    assert sorted((str(r.doc_id), r.text or "") for r in one_of_each(docs).collect()) == kept_by_force(docs.collect())
    same = spark.createDataFrame([row(1, words(1, 30)), row(2, words(1, 30)), row(2, words(9, 30)), row(None, words(9, 30)), row(1, words(1, 30), "zz")], COLUMNS)
    got = one_of_each(same).collect()
    assert sorted((r.doc_id, r.lang) for r in got) == [(1, "xx"), (2, "xx")]


def test_whole_pipeline(spark, folder):
    """What run() keeps: documents with a language, one of each group, without the contaminated, redacted, and their pieces spell the text."""
    from quadrat.llm.sentence_pieces import decode

    docs = made(spark)
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder)
    rows = decode(out, corpus_pipeline.tokenizer("piece_bpe_32k.model")).collect()
    placed = [r for r in docs.collect() if r.text and re.search("[a-z]", r.text)]
    wanted = [(i, t.replace("me@here.org", "<EMAIL>")) for i, t in kept_by_force(placed) if i != "42"]
    assert sorted((str(r.doc_id), r.text) for r in rows) == sorted(wanted)
    assert all(r.decoded == r.text for r in rows)
