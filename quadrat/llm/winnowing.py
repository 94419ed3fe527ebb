"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A benchmark window is WINDOW consecutive words of an item (an item of fewer words is one window). Of every WINDOW words,
the smallest hash among the GRAM-word grams in them is a fingerprint: a shared window has the same smallest hash on
both sides, so every shared window shares a fingerprint. An item of fewer words has one fingerprint, the hash of all its words;
on the documents' side all grams of just those lengths that occur are fingerprints too.

Fingerprints are joined; only texts with a common one are looked at again. There every occurrence of an item's gram lays
the item over the text, and each lay is extended over the item word by word: every window of the item that occurs there marks its words.
A text is looked at once, whatever rows it is in, and lays are rows of their own, so no document gathers items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_by_text, sealed, settle

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 13, 7
#: Fingerprints and keys of texts are broadcast up to this many rows of 16 bytes and shuffled beyond; so are results, of fewer rows.
MOST_BROADCAST = 500_000
MOST_HELD = 50_000


def words(column: str) -> F.Column:
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(column), F.lit("")), UPPER, SMALL), GAPS), "")


def _grams(hashes: str, size: int) -> str:
    return f"CASE WHEN size({hashes}) >= {size} THEN transform(sequence(1, size({hashes}) - {size - 1}), i -> xxhash64(slice({hashes}, i, {size}))) ELSE cast(array() AS array<bigint>) END"


def _over_seven(rows: DataFrame, source: str, to: str, both: str) -> DataFrame:
    """Column `to`: the fold of every seven neighbours in array `source`, by runs of two, four and seven; both: the fold of x and y."""
    for k, (a, b) in enumerate([(source, f"{to}_2"), (f"{to}_2", f"{to}_4"), (f"{to}_4", to)], 1):
        n = f"greatest(size({a}) - {k}, 0)"
        rows = rows.withColumn(b, F.expr(f"CASE WHEN {a} IS NOT NULL THEN zip_with(slice({a}, 1, {n}), slice({a}, {k + 1}, {n}), (x, y) -> {both}) END"))
    return rows.drop(f"{to}_2", f"{to}_4")


def _fingerprints(rows: DataFrame, hashes: str, grams: str, to: str) -> DataFrame:
    """Columns `grams`, a hash of every GRAM words, and `to`, their distinct minima over every WINDOW words."""
    assert GRAM == WINDOW - GRAM + 1 == 7
    rows = _over_seven(rows, hashes, grams, "xxhash64(x, y)")
    return _over_seven(rows, grams, to, "least(x, y)").withColumn(to, F.array_distinct(to))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows with n_words, n_hit, n_items, items (sorted ids, as strings) and contaminated.

    n_hit counts the document's words inside any occurrence of a window, items are those with such windows;
    contaminated: n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have no words and no windows; so have such
    items, and an item without id. Repeated rows are each given what their text holds; repeated items count once; texts that
    share an item's id are windows of that item. Columns that have the new names are replaced.
    """
    new = ("n_words", "n_hit", "n_items", "items", "contaminated")
    keep = [c for c in docs.columns if c.lower() not in new]
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(item_text_col).alias("iw")).where("item IS NOT NULL AND size(iw) > 0").distinct()
    items = items.withColumn("ih", F.expr("transform(iw, x -> xxhash64(x))"))
    # At most WINDOW - 1 numbers.
    short = sorted(r[0] for r in items.where(F.size("iw") < WINDOW).select(F.size("iw")).distinct().collect())
    items = _fingerprints(items, "ih", "ig", "ip")
    marks = items.withColumn("fp", F.expr(f"CASE WHEN size(iw) < {WINDOW} THEN array(xxhash64(ih)) ELSE ip END"))
    # Not explode: Spark would put a filter on the array below all its steps, and compute them twice.
    marks = settle(marks.select(F.xxhash64("item", "iw").alias("mark"), "item", "iw", "ig", F.explode_outer("fp").alias("fp1")))
    few = marks.count() <= MOST_BROADCAST
    held = F.broadcast if few else (lambda df: df)

    texts = docs.select(*keyed_by_text(F.col(text_col)), words(text_col).alias("dw"))
    body = texts.select("__h1", "__h2", F.expr("transform(dw, x -> xxhash64(x))").alias("dh"))
    prints = ["dp", *(_grams("dh", n) for n in short)]
    found = _fingerprints(body, "dh", "dg", "dp").select("__h1", "__h2", F.explode_outer(F.expr(f"array_distinct(concat({', '.join(prints)}))")).alias("fp1"))
    some = settle(found.join(held(marks.select("fp1").distinct()), "fp1", "left_semi").select(F.col("__h1").alias("k1"), F.col("__h2").alias("k2")).distinct())
    some = F.broadcast(some) if some.count() <= MOST_BROADCAST else some
    of_key = (F.col("__h1") == F.col("k1")) & (F.col("__h2") == F.col("k2"))
    seen = settle(texts.join(some, of_key, "left_semi").dropDuplicates(["__h1", "__h2"]))

    # Where items may lie: a document's place before the item's first word.
    rows = _over_seven(seen.select("__h1", "__h2", F.expr("transform(dw, x -> xxhash64(x))").alias("dh")), "dh", "dg", "xxhash64(x, y)")
    places = [f"transform({g}, (x, i) -> struct(x AS fp1, i AS p, {n} AS w))" for n, g in [(WINDOW, "dg"), *((n, _grams("dh", n)) for n in short)]]
    rows = rows.select("__h1", "__h2", F.explode_outer(F.expr(f"concat({', '.join(places)})")).alias("x")).select("__h1", "__h2", "x.*")
    own = f"CASE WHEN size(iw) < {WINDOW} THEN array(0) ELSE transform(filter(sequence(1, size(ig)), i -> ig[i - 1] = fp1), i -> i - 1) END"
    lays = rows.join(held(marks.select("fp1", "mark", F.expr(f"least({WINDOW}, size(iw))").alias("w"), F.explode(F.expr(own)).alias("q"))), ["fp1", "w"])
    lays = lays.select("__h1", "__h2", "mark", (F.col("p") - F.col("q")).alias("lay")).distinct()
    # Of each lay, the item's windows that occur, as the document's places where they start.
    lays = lays.join(held(marks.select("mark", "item", "iw").distinct()), "mark").join(seen.select("__h1", "__h2", "dw"), ["__h1", "__h2"])
    starts = f"""transform(filter(sequence(1, size(iw) - least({WINDOW}, size(iw)) + 1), j -> CASE WHEN lay + j >= 1 AND lay + j + least({WINDOW}, size(iw)) - 1 <= size(dw)
        THEN slice(iw, j, least({WINDOW}, size(iw))) = slice(dw, lay + j, least({WINDOW}, size(iw))) ELSE false END), j -> struct(lay + j AS s, least({WINDOW}, size(iw)) AS w))"""
    met = sealed(lays.select("__h1", "__h2", "item", F.expr(starts).alias("starts")), ["starts"]).where("size(starts) > 0")
    words_hit = met.select("__h1", "__h2", F.explode("starts").alias("x")).select("__h1", "__h2", F.explode(F.sequence("x.s", F.col("x.s") + F.col("x.w") - 1)).alias("word")).distinct().groupBy("__h1", "__h2").agg(F.count("*").alias("__hit"))
    met = met.groupBy("__h1", "__h2").agg(F.array_sort(F.collect_set("item")).alias("__items")).join(words_hit, ["__h1", "__h2"])
    met = settle(met.select(F.col("__h1").alias("k1"), F.col("__h2").alias("k2"), "__hit", "__items"))
    met = F.broadcast(met) if met.count() <= MOST_HELD else met

    out = docs.select(*keyed_by_text(F.col(text_col)), F.size(words(text_col)).cast("long").alias("__words"), *[F.col(f"`{c}`") for c in keep]).join(met, of_key, "left")
    out = out.select(*[F.col(f"`{c}`") for c in keep], F.col("__words").alias("n_words"), F.coalesce("__hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("__items", F.expr("cast(array() AS array<string>)")).alias("items"))
    return out.select(*[f"`{c}`" for c in keep], "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", F.expr("n_hit > 0 AND 20 * n_hit >= n_words").alias("contaminated"))
