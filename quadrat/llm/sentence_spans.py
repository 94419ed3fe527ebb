"""Substring dedup by sliding sentence spans.

A sentence ends at a line end, or at . ! ? before white space. One of more than `longest` words is cut into pieces of
`longest` at most, at places chosen by the words around them, so that a passage is cut alike wherever it stands. From
every sentence starts one span and at every sentence ends one: the fewest consecutive sentences, `least_sentences` at least, that hold
`least_words` words (with least_words = 0, every run of least_sentences). Spans are compared by 96 bits of hashes of their lower-cased words.
Of equal spans anywhere, the first in the document of the smallest id stays; the sentences of all others are removed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, _powers, arrow_bytes, in_arrow, mix64, pieces, span_hashes, words_of

_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


def _cuts(word: np.ndarray, new: np.ndarray, longest: int) -> np.ndarray:
    """Where sentences of more than `longest` words are cut.

    Of any `longest` places in a row in a sentence, it is cut at the one with the least hash of the words on both sides;
    of equal ones, the last. A run of one word has no such places, and is cut by count.
    """
    n, none = len(word), np.uint64(2**64 - 1)
    place = np.arange(n)
    begin = np.maximum.accumulate(np.where(new, place, 0))
    out = np.zeros(n, bool)
    if n > longest:
        local = np.append(none, mix64(word[1:] ^ mix64(word[:-1])))
        local[1:][(local[1:] == local[:-1]) & (place[1:] - 1 > begin[1:])] = none
        k = place[: n - longest + 1]
        k = k[(begin[k] == begin[k + longest - 1]) & (k > begin[k])]
        least, at = local[k], k
        for j in range(1, longest):
            better = local[k + j] <= least
            least, at = np.where(better, local[k + j], least), np.where(better, k + j, at)
        out[at[least < none]] = True
    piece = np.maximum.accumulate(np.where(new | out, place, 0))
    return out | ((place - piece) % longest == 0)


class Sentences:
    """The sentences of texts that lie end to end: the words, their hashes, and the text and the words of each sentence."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, longest: int):
        self.starts, self.ends, owner = words_of(data, offsets)
        self.word = span_hashes(LOWER[data], self.starts, self.ends)
        n = len(self.starts)
        new = np.ones(n, bool)
        if n:
            line = np.cumsum(data == 10)
            ended = _ENDS[data[self.ends[:-1] - 1]] | (line[self.starts[1:]] > line[self.ends[:-1] - 1]) | (owner[1:] != owner[:-1])
            new[1:] = ended
            new |= _cuts(self.word, new, longest)
        self.first = np.flatnonzero(new)  # the first word of each sentence
        self.stop = np.append(self.first[1:], n)
        self.owner = owner[self.first]


def span_hash_pairs(s: Sentences, least_words: int, least_sentences: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each span: its first sentence, the sentence after it, and two hashes."""
    word, m = s.word, len(s.first)
    # the sentence after the span: enough words, and enough sentences
    to = np.searchsorted(s.stop, s.first + least_words, "left") + 1
    to = np.maximum(to, np.arange(m) + least_sentences)
    # the spans at whose end none of these ends: the last start from which there are enough
    last = np.setdiff1d(np.arange(1, m + 1), to)
    since = np.searchsorted(to, last, "right") - 1
    a, b = np.concatenate([np.arange(m), since]), np.concatenate([to, last])
    good = (a >= 0) & (b <= m)
    good[good] &= s.owner[b[good] - 1] == s.owner[a[good]]
    a, b = a[good], b[good]
    out = []
    for base in _BASES:
        total = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(word * _powers(base, len(word)), out=total[1:])
        low, high = s.first[a], s.stop[b - 1]
        raw = (total[high] - total[low]) * _powers(pow(base, -1, 2**64), len(word) + 1)[low]
        out.append(mix64(raw ^ (high - low).astype(np.uint64)).view(np.int64))
    return a, b, out[0], (out[1] >> 32).astype(np.int32)


#: Of a span's place: bits for whether its text has it before, and for its number of sentences. The number of its first sentence is above.
AGAIN, SIZE = 1, 24


def named(docs: DataFrame, id_col: str, text_col: str) -> dict:
    """What tells documents apart: their ids where all rows have one of their own, else also a hash of the text."""
    n, different = docs.agg(F.count(F.lit(1)), F.countDistinct(id_col)).first()
    return {"id": F.col(id_col)} | ({} if n == different else {"key": F.xxhash64(text_col)})


def spans(docs: DataFrame, names: dict, text_col: str, least_words: int, longest: int, least_sentences: int) -> DataFrame:
    """(h1, h2, id, perhaps key, place): every span, with its document's names as in named(); place: see AGAIN."""

    def batches(it):
        import pyarrow as pa

        for batch in it:
            for part in pieces(batch):
                data, offsets = arrow_bytes(part.column("text"))
                s = Sentences(data, offsets, longest)
                a, b, h1, h2 = span_hash_pairs(s, least_words, least_sentences)
                at = a - np.searchsorted(s.owner, s.owner[a], "left")
                order = np.lexsort((a, h2, h1, s.owner[a]))
                k = order[1:], order[:-1]
                again = np.zeros(len(a), bool)
                again[k[0]] = (h1[k[0]] == h1[k[1]]) & (h2[k[0]] == h2[k[1]]) & (s.owner[a[k[0]]] == s.owner[a[k[1]]])
                row, place = pa.array(s.owner[a]), (at << SIZE | b - a) << AGAIN | again
                yield pa.record_batch([pa.array(h1), pa.array(h2), *(part.column(c).take(row) for c in names), pa.array(place)], ["h1", "h2", *names, "place"])

    rows = docs.select(*[v.alias(c) for c, v in names.items()], F.col(text_col).alias("text"))
    names = list(names)
    return rows.transform(in_arrow, batches, "h1 long, h2 int, " + "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in names) + "place long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 25, longest: int = 16, least_sentences: int = 2) -> DataFrame:
    """The rows with repeated spans taken out of the text, and n_sentences and n_removed.

    A sentence goes with the white space after it. Null stays null; texts shorter than a span stay as they are. Rows alike in id
    and text are one document, in each of which the first place of a span stays; rows alike in id alone, or without id, are
    documents of their own, the one of the smaller hash of its text first. A null id is larger than others.
    Columns named n_sentences or n_removed are replaced.
    """
    names = named(docs, id_col, text_col)
    every = spans(docs, names, text_col, least_words, longest, least_sentences)
    # One row for each repeated span; occurrences are combined before the shuffle, so a hot passage is one row a task.
    first = F.col("id") if len(names) == 1 else F.struct(F.col("id").isNull().alias("none"), *names)
    repeated = every.groupBy("h1", "h2").agg(F.min(first).alias("first"), F.count("*").alias("n")).where("n > 1")
    # The xor hides how this side is partitioned, so it is dealt out again and a hot span's partition can be split.
    leads = [F.col("first" if len(names) == 1 else f"first.{c}").alias(f"first_{c}") for c in names]
    repeated = repeated.select(F.col("h1").bitwiseXOR(F.lit(0)).alias("h1"), "h2", *leads)
    later = every.join(repeated, ["h1", "h2"]).where("place % 2 = 1 OR NOT (" + " AND ".join(f"{c} <=> first_{c}" for c in names) + ")")
    gone = later.groupBy(*names).agg(F.collect_set("place").alias("gone"))
    keep = [c for c in docs.columns if c.lower() not in ("n_sentences", "n_removed")]
    rows = docs.select(*[v.alias(f"__{c}") for c, v in names.items()], F.col(text_col).alias("__text"), F.struct(*[F.col(f"`{c}`") for c in keep if c != text_col]).alias("__row"))
    same = [F.col("__id").eqNullSafe(F.col("id")), *([F.col("__key") == F.col("key")] if "key" in names else [])]
    both = rows.join(gone, same, "left").select("__text", "__row", "gone")

    def batches(it):
        import pyarrow as pa

        for batch in it:
            for part in pieces(batch, column="__text"):
                data, offsets = arrow_bytes(part.column("__text"))
                s = Sentences(data, offsets, longest)
                low = np.searchsorted(s.owner, np.arange(part.num_rows + 1), "left")
                cut = np.zeros(len(s.first) + 1, np.int64)
                for i, marks in enumerate(part.column("gone").to_pylist()):
                    for m in marks or ():
                        begin, size = low[i] + (m >> SIZE + AGAIN), m >> AGAIN & (1 << SIZE) - 1
                        cut[begin] += 1
                        cut[begin + size] -= 1
                out = np.cumsum(cut)[:-1] > 0
                texts = part.column("__text").to_pylist()
                raw = data.tobytes()
                begin = s.starts[s.first] if len(s.first) else s.first
                for i in np.unique(s.owner[out]):
                    own = np.arange(low[i], low[i + 1])
                    after = np.append(begin[own[1:]], offsets[i + 1])
                    texts[i] = (raw[offsets[i] : begin[own[0]]] + b"".join(raw[begin[k] : e] for k, e in zip(own, after, strict=True) if not out[k])).decode("utf-8")
                number = np.bincount(s.owner[out], minlength=part.num_rows)
                yield pa.record_batch([pa.array(texts, pa.string()), part.column("__row"), pa.array(np.diff(low)), pa.array(number)], ["__text", "__row", "n_sentences", "n_removed"])

    out = both.transform(in_arrow, batches, f"__text string, __row {rows.schema['__row'].dataType.simpleString()}, n_sentences long, n_removed long")
    return out.select(*[F.col("__text").alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in keep], "n_sentences", "n_removed")
