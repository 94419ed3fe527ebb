"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features: the n-grams of one to three letters of the lower-cased text (every other character is one gap, and so is a text's end), hashed into
2**BITS bins. TF is a bin's share of the text's n-grams, IDF comes from the document frequencies of all training
documents. A score is linear in the shares, so a text is scored by one sum over its n-grams, of any length.

Weights: follow-the-regularised-leader with L1 and L2 penalties, on about `most_rows` training documents (the sample is the
one bounded part; it is a parameter): each language gives its share, `least_rows` at least, by the hash of id and text, so none is too rare to be learnt. A fifth of them is held back from the
weights and sets a temperature by likelihood, so the scores are calibrated. A score is the language's calibrated probability times the
share of the text's letters that the training documents have, so a text in letters never seen is placed nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, mix64, pieces, text_of
from .token_counts import LETTER, classes

BITS = 14
ORDERS = 3
SCALE = 100.0
UNDETERMINED = "und"


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the text and the bin of every n-gram that has a letter; and at last the number of letters, by text."""
    whole = "".join(t.lower() + "\0" for t in texts)
    sizes = np.array([len(t.lower()) for t in texts], np.int64)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    letter = classes()[points] == LETTER
    # of a run of gaps only the first, and none before a text's first letter, whatever text is before it
    keep = letter | np.concatenate([[False], letter[:-1]]) if len(letter) else letter
    points, owner, letter = np.where(letter, points, 0).astype(np.uint64)[keep], owner[keep], letter[keep]
    key, good = points, letter
    yield owner[good], bins(key[good])
    for n in range(2, ORDERS + 1):
        key = (key[:-1] << np.uint64(21)) | points[n - 1 :]
        good = (owner[: len(key)] == owner[n - 1 :]) & (letter[: len(key)] | letter[n - 1 :] | letter[n // 2 : n // 2 + len(key)])
        yield owner[: len(key)][good], bins(key[good] ^ (np.uint64(n) << np.uint64(61)))
    yield np.bincount(owner[letter], minlength=len(texts)), None


def bins(key: np.ndarray) -> np.ndarray:
    return (mix64(key) >> np.uint64(64 - BITS)).astype(np.int64)


def frequencies(texts: list[str], letters: np.ndarray | None = None) -> np.ndarray:
    """Counts of the bins in each text, dense; for slices of few texts. letters: counts of the bins of letters, to be added to."""
    out = np.zeros(len(texts) << BITS, np.int64)
    for k, (owner, bin_) in enumerate(grams(texts)):
        if bin_ is not None:
            out += np.bincount(owner << BITS | bin_, minlength=len(out))
            if not k and letters is not None:
                letters += np.bincount(bin_, minlength=1 << BITS)
    return out.reshape(len(texts), 1 << BITS)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # bins x langs, IDF and scale included
    bias: np.ndarray
    temperature: float
    known: np.ndarray  # whether training documents have a letter of the bin

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        letters, known = n, n
        for k, (owner, bin_) in enumerate(grams(texts)):
            if bin_ is None:
                letters = owner
                continue
            if not k:
                known = np.bincount(owner, self.known[bin_], len(texts))
            n += np.bincount(owner, minlength=len(texts))
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(owner, self.weights[bin_, k], len(texts))
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        p = softmax((total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature)
        best = p.argmax(1)
        some = letters > 0
        return [self.langs[k] if s else UNDETERMINED for k, s in zip(best, some, strict=True)], np.where(some, p[np.arange(len(p)), best] * known / np.maximum(letters, 1), 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, n_langs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic net; rows are (bins, values), the last bin is the constant's."""
    z, n = np.zeros(((1 << BITS) + 1, n_langs)), np.zeros(((1 << BITS) + 1, n_langs))

    def weights(b) -> np.ndarray:
        return np.where(np.abs(z[b]) > l1, -(z[b] - np.sign(z[b]) * l1) / ((beta + np.sqrt(n[b])) / alpha + l2), 0.0)

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            b, x = rows[i]
            w = weights(b)
            p = softmax((x @ w)[None])[0]
            p[label[i]] -= 1
            g = x[:, None] * p[None]
            sigma = (np.sqrt(n[b] + g * g) - np.sqrt(n[b])) / alpha
            z[b] += g - sigma * w
            n[b] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = 3000, least_rows: int = 50) -> Model:
    """Learn from the text and language of every row that has both. With none, the model predicts only `und`."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def document_counts(it):
        import pyarrow as pa

        total, letters, number = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64), 0
        for batch in it:
            for part in pieces(batch, 1 << 19):
                for i in range(0, part.num_rows, 64):
                    found = frequencies(part.slice(i, 64).column("text").to_pylist(), letters)
                    total += (found > 0).sum(0)
                    number += len(found)
        every = np.concatenate([total, letters, [number]])
        some = np.flatnonzero(every)
        yield pa.record_batch([pa.array(some), pa.array(every[some])], ["bin", "n"])

    seen = rows.select("text").transform(in_arrow, document_counts, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # 2 * 2**BITS + 1 rows at most
    every = np.zeros((2 << BITS) + 1)
    every[[r["bin"] for r in seen]] = [r["n"] for r in seen]
    frequency, known, number = every[: 1 << BITS], every[1 << BITS : -1] > 0, every[-1]
    idf = np.log((1 + number) / (1 + frequency)) + 1

    def shares(it):
        import pyarrow as pa

        for batch in it:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                found = frequencies(part.column("text").to_pylist())
                some = [np.flatnonzero(f) for f in found]
                yield pa.record_batch([part.column("mark"), part.column("lang"), pa.array([x.astype(np.int16) for x in some], pa.list_(pa.int16())), pa.array([(f[x] / f.sum()).astype(np.float32) for f, x in zip(found, some, strict=True)], pa.list_(pa.float32()))], ["mark", "lang", "bins", "shares"])

    # A language's share of the range of hashes gives about its number of rows: nothing is sorted, no text is shuffled.
    mark = F.xxhash64("id", "text")
    sizes = rows.groupBy("lang").count().collect()  # a row for each language
    total = sum(r["count"] for r in sizes)
    wanted = {r["lang"]: max(least_rows, most_rows * r["count"] / total) for r in sizes}
    bars = rows.sparkSession.createDataFrame([(r["lang"], min(2**63 - 1, int(-(2**63) + min(1.0, wanted[r["lang"]] / r["count"]) * 2**64))) for r in sizes], "lang string, bar long")
    picked = rows.withColumn("mark", mark).join(F.broadcast(bars), "lang").where("mark <= bar").select("mark", "lang", "text")
    # Repeated rows have one hash, and count once.
    picked = picked.groupBy("mark", "lang").agg(F.first("text").alias("text"))
    most = int(2 * sum(wanted.values())) + 100  # hashes are even, so about half as many come
    sample = picked.transform(in_arrow, shares, "mark long, lang string, bins array<short>, shares array<float>").limit(most + 1).toArrow()
    if sample.num_rows > most:
        raise RuntimeError(f"more than {most} rows fell to a sample of {most_rows}")
    sample = sample.sort_by([("mark", "ascending"), ("lang", "ascending")])
    import pyarrow as pa
    import pyarrow.compute as pc

    langs = sorted(set(sample.column("lang").to_pylist()))
    label = np.array([langs.index(x) for x in sample.column("lang").to_pylist()], np.int64)
    flat, ends = {}, np.zeros(1, np.int64)
    for name in ("bins", "shares"):  # as flat arrays: lists of numbers would be many times as large
        whole = pa.concat_arrays(sample.column(name).chunks) if sample.num_rows else pa.array([], sample.schema.field(name).type)
        flat[name] = whole.flatten().to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(pc.list_value_length(whole).to_numpy(zero_copy_only=False))).astype(np.int64)
    xs = []
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        b = flat["bins"][lo:hi].astype(np.int64)
        xs.append((np.append(b, 1 << BITS), np.append(flat["shares"][lo:hi] * idf[b] * SCALE, 1.0)))
    if not langs:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0, known)
    held = np.arange(len(xs)) % 5 == 4
    w, bias = follow_the_leader([x for x, h in zip(xs, held, strict=True) if not h], label[~held], len(langs))
    logits = np.array([x[:-1] @ w[b[:-1]] + bias for (b, x), h in zip(xs, held, strict=True) if h]).reshape(-1, len(langs))
    return Model(langs, (w * (idf * SCALE)[:, None]).astype(np.float64), bias, temperature(logits, label[held]), known)


def temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The divisor of the logits that makes the labels most likely, from a grid."""
    if not len(label):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.2), np.log(20), 60))
    return float(min(grid, key=lambda t: -np.log(softmax(logits / t)[np.arange(len(label)), label] + 1e-12).mean()))


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """The rows with the language of each whole text and its score. Repeated rows are judged alike.

    `und` with score 0 where the text is null or has no letter. Columns that have the new names are replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in (lang_col.lower(), score_col.lower())]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"))
    text = text_of(text_col)

    def batches(it):
        import pyarrow as pa

        for batch in it:
            for part in pieces(batch, 1 << 19, text=text):
                langs, scores = model.predict([t or "" for t in text(part).to_pylist()])
                yield pa.record_batch([part.column("__row"), pa.array(langs, pa.string()), pa.array(scores)], ["__row", "__lang", "__score"])

    out = rows.transform(in_arrow, batches, f"__row {rows.schema['__row'].dataType.simpleString()}, __lang string, __score double")
    return out.select(*[F.col("__row")[c].alias(c) for c in keep], F.col("__lang").alias(lang_col), F.col("__score").alias(score_col))
