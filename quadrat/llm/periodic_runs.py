"""Runs of periodic words by Crochemore's partition refinement.

Positions of a text are kept in classes: those from which equal factors of some length start. From one length to the next a
class splits by the classes of the positions that follow. Of the parts that a class has just split into, all but a largest one
are small, and only what precedes a small part is moved (the smaller-half strategy), so a position is moved a logarithmic number
of times. Members of a class are linked in order. Neighbours at a distance equal to the length start a
square, since its two halves are the factor; squares that start one after the other are one run. A link is looked at only at
the length that equals its distance.

Here all texts of a slab are refined at once by array operations. A run of at least `times` periods has times - 1 members
or more in each class that its squares start from; smaller classes can be left alone, as can what precedes them, and so can a text beyond a
`times`-th of its length.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bytes, in_arrow, mix64, pieces, span_hashes, words_of


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the ranges [start, start + size), one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


class Refinement:
    """Classes of equal factors of the words of texts; a text has a position for each word and one more, which equals no other."""

    def __init__(self, word: np.ndarray, owner: np.ndarray, texts: int, times: int):
        number = np.bincount(owner, minlength=texts)
        self.limit, self.fewest = number // times, max(2, times - 1)
        self.base = np.cumsum(number + 1) - (number + 1)
        self.number = number
        n = len(word) + texts
        at = np.arange(len(word)) + owner
        self.text = np.repeat(np.arange(texts), number + 1)
        self.next, self.before = np.full(n, -1), np.full(n, -1)
        self.cls = np.full(n, -1)  # -1: left alone
        self.waiting: dict[int, list[np.ndarray]] = defaultdict(list)
        _, first, kind, size = np.unique(mix64(word ^ mix64(owner.astype(np.uint64) + np.uint64(1))), return_index=True, return_inverse=True, return_counts=True)
        by_size = np.lexsort((size, owner[first]))
        largest = by_size[np.append(np.flatnonzero(np.diff(owner[first][by_size])), len(by_size) - 1)] if len(word) else by_size
        small = np.ones(n, bool)
        is_largest = np.zeros(len(size), bool)
        is_largest[largest] = True
        small[at] = ~is_largest[kind]
        self.small = np.flatnonzero(small)
        self.cls[at] = np.where((size[kind] >= self.fewest) & (self.limit[owner] > 0), kind, -1)
        self.alive = int((self.cls >= 0).sum())
        self._settle()
        same = self.cls[self.order[1 : self.used]] == self.cls[self.order[: max(self.used - 1, 0)]]
        self._link(self.order[: max(self.used - 1, 0)][same], self.order[1 : self.used][same], 1)

    def _settle(self) -> None:
        """Number the classes anew and lay their members out, each class in a segment with room for new ones at the end."""
        live = np.flatnonzero(self.cls >= 0)
        _, kind, size = np.unique(self.cls[live], return_inverse=True, return_counts=True)
        self.cls[live] = kind
        room = 2 * len(live) + 1024
        self.order, self.used = np.zeros(room, np.int64), len(live)
        self.order[: len(live)] = live[np.argsort(kind, kind="stable")]
        self.start, self.laid, self.size = (np.zeros(room, np.int64) for _ in range(3))
        self.ids = k = len(size)
        self.size[:k] = self.laid[:k] = size
        self.start[:k] = np.cumsum(size) - size

    def _link(self, a: np.ndarray, b: np.ndarray, length: int) -> None:
        """Make a and b neighbours; a square may start at a when the length has grown to their distance."""
        self.next[a], self.before[b] = b, a
        gap = b - a
        good = (gap >= length) & (gap <= self.limit[self.text[a]])
        a, gap = a[good], gap[good]
        if len(a):
            by = np.argsort(gap, kind="stable")
            a, gap = a[by], gap[by]
            edges = [0, *(np.flatnonzero(np.diff(gap)) + 1).tolist(), len(a)]
            for i, j in zip(edges, edges[1:], strict=False):
                self.waiting[int(gap[i])].append(a[i:j])

    def squares(self, length: int) -> np.ndarray:
        """Where squares with halves of this length start, in order; asked once the classes are of factors of this length."""
        a = self.waiting.pop(length, None)
        if not a:
            return np.zeros(0, np.int64)
        a = np.unique(np.concatenate(a))
        return a[(self.cls[a] >= 0) & (self.next[a] - a == length)]

    def drop(self, texts: np.ndarray) -> None:
        """Leave these texts alone from now on."""
        every = _ranges(self.base[texts], self.number[texts])
        self.alive -= int((self.cls[every] >= 0).sum())
        self.cls[every] = -1

    def refine(self, length: int) -> None:
        """From the classes of factors one shorter to those of `length`."""
        j = self.small - 1
        j = j[j >= 0]
        j = j[self.cls[j] >= 0]
        self.small = j
        if not len(j):
            return
        if self.used + len(j) > len(self.order) or self.ids + len(j) > len(self.order):
            self._settle()
        c, to = self.cls[j], self.cls[j + 1]
        by = np.lexsort((j, to, c))
        j, c, to = j[by], c[by], to[by]
        # Take what moves out of the links of its class.
        out = j[np.lexsort((j, c))]
        chained = self.next[out[:-1]] == out[1:]
        p, q = self.before[out[np.append(True, ~chained)]], self.next[out[np.append(~chained, True)]]
        self.next[p[p >= 0]] = q[p >= 0]
        self.before[q[q >= 0]] = p[q >= 0]
        both = (p >= 0) & (q >= 0)
        rest_links = p[both], q[both]
        # The parts: those that move, and what is left of each class.
        new = np.append(True, (c[1:] != c[:-1]) | (to[1:] != to[:-1]))
        part, first = np.cumsum(new) - 1, np.flatnonzero(new)
        size = np.diff(np.append(first, len(j)))
        known = to[first] >= 0
        dead = ~known | (size < self.fewest)
        begin = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        old = c[begin]
        self.size[old] -= np.diff(np.append(begin, len(j)))
        left, counted = self.size[old], np.where(known, size, 0)
        most = np.maximum.reduceat(counted, part[begin])
        whose = np.cumsum(np.append(True, np.diff(c[first]) != 0)) - 1
        exempt = (counted == most[whose]) & (left < most)[whose]  # the largest of its class ...
        places = np.flatnonzero(exempt)
        exempt[places[1:][np.diff(whose[places]) == 0]] = False  # ... or one of them
        live = np.flatnonzero(~dead)
        name = np.full(len(size), -1)
        name[live] = self.ids + np.arange(len(live))
        self.cls[j] = name[part]
        self.next[j] = self.before[j] = -1
        stays = ~dead[part]
        self.alive -= int((~stays).sum())
        inner = ~new[1:] & stays[1:]
        self._link(*rest_links, length)
        self._link(j[:-1][inner], j[1:][inner], length)
        laid = j[stays]
        self.order[self.used : self.used + len(laid)] = laid
        self.start[name[live]] = self.used + np.cumsum(size[live]) - size[live]
        self.laid[name[live]] = self.size[name[live]] = size[live]
        self.used, self.ids = self.used + len(laid), self.ids + len(live)
        # What is left is small too where a part that moved is larger; it is looked up in the segment, which then holds it alone.
        look = old[(left > 0) & ((left < most) | (left < self.fewest))]
        self.small = j[~exempt[part]]
        if len(look):
            member, of = self.order[_ranges(self.start[look], self.laid[look])], np.repeat(look, self.laid[look])
            member, of = member[self.cls[member] == of], of[self.cls[member] == of]
            self.small = np.concatenate([self.small, member])
            few = self.size[of] < self.fewest
            self.cls[member[few]] = -1
            self.alive -= int(few.sum())
            self.laid[look] = self.size[look]
            self.order[_ranges(self.start[look], self.laid[look])] = member


def runs_of(word: np.ndarray, owner: np.ndarray, texts: int, times: int = 4, least: int = 6) -> np.ndarray:
    """Rows (text, start, period, length) of the runs of at least `times` periods and `least` words, in that order.

    word: a number for each word, equal for equal words; owner: the number of its text, not decreasing.
    """
    r = Refinement(word, owner, texts, times)
    ending = np.argsort(r.limit, kind="stable")
    limits, done = r.limit[ending], 0
    found = []
    for period in range(1, int(r.limit.max(initial=0)) + 1):
        if period > 1:
            r.refine(period)
        a = r.squares(period)
        if len(a):
            first = np.flatnonzero(np.append(True, np.diff(a) != 1))
            length = np.diff(np.append(first, len(a))) - 1 + 2 * period
            good = length >= max(least, times * period)
            start = a[first[good]]
            text = r.text[start]
            found.append(np.stack([text, start - r.base[text], np.full(len(start), period), length[good]], axis=1))
        over = int(np.searchsorted(limits, period, "right"))
        if over > done:
            r.drop(ending[done:over])
            done = over
        if not r.alive:
            break
    out = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    return out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]


def find_runs(docs: DataFrame, text_col: str = "text", times: int = 4, least: int = 6) -> DataFrame:
    """All columns, runs (start, length and period, in words from 0, by start, then period) and collapsed.

    Words are what stands between ASCII white space. A run is a stretch of words with smallest period q, of at least `times` x q and
    `least` words, that no neighbour extends. collapsed: the words, joined by a space, but for those that some run contains after
    its first q words. Null, empty and blank texts have no runs and are collapsed to an empty text. Rows are judged each by itself, so
    ids may be null or repeat. Columns named runs or collapsed are replaced. A text is held whole, with some 100 bytes a word.
    Words are told apart by 64 bits of hashes.
    """
    keep = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    rows = docs.select(F.col(f"`{text_col}`").alias("__text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"))
    run_type = "array<struct<start: bigint, length: bigint, period: bigint>>"

    def batches(it):
        import pyarrow as pa

        for batch in it:
            for part in pieces(batch, 4 << 20, "__text"):
                data, offsets = arrow_bytes(part.column("__text"))
                starts, ends, owner = words_of(data, offsets)
                found = runs_of(span_hashes(data, starts, ends), owner, part.num_rows, times, least)
                texts, edges = [], np.searchsorted(found[:, 0], np.arange(part.num_rows + 1))
                for i in range(part.num_rows):
                    words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                    if edges[i] < edges[i + 1]:
                        depth = np.zeros(len(words) + 1, np.int64)
                        for _, start, period, length in found[edges[i] : edges[i + 1]]:
                            depth[start + period] += 1
                            depth[start + length] -= 1
                        words = compress(words, np.cumsum(depth[:-1]) == 0)
                    texts.append(b" ".join(words))
                own = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 3, 2)], ["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), own)
                yield pa.record_batch([part.column("__row"), runs, pa.array(texts, pa.binary()).cast(pa.string())], ["__row", "runs", "collapsed"])

    out = rows.transform(in_arrow, batches, f"__row {rows.schema['__row'].dataType.simpleString()}, runs {run_type}, collapsed string")
    return out.select(*[F.col("__row")[c].alias(c) for c in keep], "runs", "collapsed")


def made_periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every tenth document, by a hash of its id, with the words after some place replaced by repeats of the first of them.

    With h = crc32 of the id as text (null as an empty one) and g = h // 10, those with h % 10 = 0 and n > 0 words keep the words before a = g % n; word i from
    there on is word a + (i - a) % p, with p = 1 + (n - a) // (3 + g % 8). Other texts and all other columns stay.
    """
    h = "crc32(cast(coalesce(cast(`{}` AS string), '') AS binary))".format(id_col)
    space = "[\\\\x20\\\\x09-\\\\x0D]"
    # Each step of the outer arrays, of one element, names what the next one uses, so that it is made once.
    words = f"array(split(regexp_replace(`{text_col}`, '^{space}+|{space}+$', ''), '{space}+'))"
    begun = f"transform({words}, w -> named_struct('w', w, 'g', {h} div 10, 'a', cast(({h} div 10) % size(w) AS int)))"
    known = f"transform({begun}, x -> named_struct('w', x.w, 'a', x.a, 'p', cast(1 + (size(x.w) - x.a) div (3 + x.g % 8) AS int)))"
    made = f"transform({known}, x -> array_join(transform(sequence(0, size(x.w) - 1), i -> x.w[if(i < x.a, i, x.a + (i - x.a) % x.p)]), ' '))[0]"
    some = F.expr(f"{h} % 10 = 0 AND rlike(`{text_col}`, '[^\\\\x20\\\\x09-\\\\x0D]')")
    return docs.withColumn(text_col, F.when(some, F.expr(made)).otherwise(F.col(f"`{text_col}`")))
