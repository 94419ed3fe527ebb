"""SentencePiece encoding with seeded merge-dropout, and decoding.

Agenda. A text is split where no piece can reach across (before a space that follows something else, and around line
ends), so each part is merged alone. A part starts as its characters; the agenda holds the neighbouring pairs whose
joined string is a piece, and the pair with the best score, then the leftmost, is merged, until none is left.

Dropout. A candidate is named by its document, the part's place in it, and its start and end in the part. A hash of that
name under the seed decides whether the merge is skipped, so every occurrence of a word draws anew, and a skip is the
same in every run and on every machine. A part's own segmentation is kept with the candidates that came up in it: an
occurrence that skips none of them is segmented so, and any other is merged by itself.

Whatever is skipped, the pieces of a part spell the part: decoding returns the text. Characters outside the model, and
the character U+2581 that stands for a space, are written as byte pieces.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, kept, mix64, pieces, text_of

MARK = "▁"
#: Stands in a part for U+2581 of the text itself; a lone surrogate is in no valid text.
OWN_MARK = "\udc81"
PARTS = re.compile(r" *[^ \n]+| +|\n")
#: Characters from which a part is merged with a heap.
LONG = 400
#: The place in the agenda of a pair that joins to nothing.
NONE = 1 << 30
PLACE = np.uint64(0x9E3779B97F4A7C15)


def as_letters(text: str) -> str:
    """A part in the letters of the model: spaces are marks, and marks of the text stand apart."""
    return text.replace(MARK, OWN_MARK).replace(" ", MARK)


class Spelling:
    """The pieces of a model: what they spell, and what they are."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = np.full(256, -1, np.int32)
        self.plain: dict[str, int] = {}
        spelled: list[bytes] = []
        for i in range(self.model.get_piece_size()):
            name = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes[int(name[1:-1], 16)] = i
                spelled.append(bytes([int(name[1:-1], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                spelled.append(b"")
            else:
                self.plain[name] = i
                spelled.append(name.replace(MARK, " ").encode())
        #: The bytes of all pieces, laid end to end.
        self.letters_of = np.frombuffer(b"".join(spelled), np.uint8)
        self.length = np.array([len(x) for x in spelled], np.int64)
        self.begin = np.cumsum(self.length) - self.length

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The texts that lists of ids spell."""
        number = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        sizes = self.length[flat]
        ends = np.cumsum(sizes)
        spelled = self.letters_of[np.repeat(self.begin[flat] - (ends - sizes), sizes) + np.arange(sizes.sum())].tobytes()
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(number)])].tolist()
        # each begins with the space that was put before it
        return [spelled[i + 1 : j].decode("utf-8", "replace") for i, j in zip(at[:-1], at[1:], strict=True)]


class Encoder(Spelling):
    """most_parts bounds memory: beyond it what is kept of parts is dropped and made anew."""

    def __init__(self, path: str, dropout: float, most_parts: int = 80_000):
        super().__init__(path)
        plain, size = self.plain, len(self.length)
        self.letters = {x: i for x, i in plain.items() if len(x) == 1}
        self.letter_ids = np.full(max(map(ord, self.letters)) + 1, size, np.int32)
        self.letter_ids[[ord(x) for x in self.letters]] = list(self.letters.values())
        self.unknown = size  # characters outside the model join with nothing
        joins = {}
        for name, i in plain.items():
            for cut in range(1, len(name)):
                a, b = plain.get(name[:cut]), plain.get(name[cut:])
                if a is not None and b is not None:
                    joins[a * (size + 1) + b] = i
        self.base = size + 1
        # Joins in an open hash table of a power of two; most probes find their pair or an empty slot at once.
        self.mask = (1 << (4 * len(joins)).bit_length()) - 1
        self.pairs = np.full(self.mask + 1, -1, np.int64)
        self.joined = np.zeros(self.mask + 1, np.int32)
        left, slot = np.array(list(joins), np.int64), self.slot(np.array(list(joins), np.int64))
        value = np.array(list(joins.values()), np.int32)
        while len(left):
            _, first = np.unique(slot, return_index=True)
            first = first[self.pairs[slot[first]] < 0]
            self.pairs[slot[first]], self.joined[slot[first]] = left[first], value[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, slot, value = left[rest], slot[rest] + 1 & self.mask, value[rest]
        #: The place of a piece in the order of scores, the best first; ties stay in the order of ids.
        order = sorted(plain.values(), key=lambda i: -self.model.get_score(i))
        self.place = np.zeros(size + 1, np.int32)
        self.place[order] = np.arange(len(order))
        self.bar = np.uint64(min(int(dropout * 2**64), 2**64 - 1))
        self.dropout, self.most_parts = dropout, most_parts
        self.plain = {}  # no longer needed
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.parts: list[str] = []
        # Of each part: where its own segmentation is kept, and the candidates that came up in it.
        self.at, self.size = np.full(1024, -1, np.int64), np.zeros(1024, np.int64)
        self.span_at, self.span_n, self.lens = (np.zeros(1024, np.int64) for _ in range(3))
        self.spans, self.span_fill = np.zeros(1 << 16, np.uint64), 0
        self.flat, self.fill = np.zeros(1 << 16, np.int32), 0

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * PLACE >> np.uint64(24)).astype(np.int64) & self.mask

    def skipped(self, name: np.ndarray, span: np.ndarray) -> np.ndarray:
        """Whether candidates are skipped, by the names of their occurrences and start << 32 | end."""
        return mix64(name ^ span * PLACE) < self.bar

    def best(self, left: np.ndarray, right: np.ndarray, name: np.ndarray | None, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For candidate pairs: the joined piece's place in the agenda (a large number if there is none or it is skipped), and the piece."""
        key = left.astype(np.int64) * self.base + right
        k = self.slot(key)
        there = self.pairs[k]
        odd = np.flatnonzero((there != key) & (there >= 0))
        while len(odd):
            k[odd] = k[odd] + 1 & self.mask
            there[odd] = self.pairs[k[odd]]
            odd = odd[(there[odd] != key[odd]) & (there[odd] >= 0)]
        found = there == key
        piece = self.joined[k]
        if name is not None:
            found &= ~self.skipped(name, (start.astype(np.uint64) << np.uint64(32)) | end.astype(np.uint64))
        return np.where(found, self.place[piece], np.int32(NONE)), piece

    def merge(self, words: list[str], sizes: np.ndarray, names: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the words, all of about one length, laid end to end, and their numbers. names: of the occurrences; None for no skips."""
        name = (lambda r: None) if names is None else names.__getitem__
        seen: list[tuple] = []  # candidates without skips, for learn()
        n, longest = len(words), int(sizes.max())
        text = as_letters("".join(words))
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.where(points < len(self.letter_ids), self.letter_ids[np.minimum(points, len(self.letter_ids) - 1)], self.unknown)
        # A row of `wide` cells for each word; a symbol is the cell it begins in, and cells are numbered throughout.
        wide = longest + 1
        row = np.repeat(np.arange(n), sizes)
        col = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        cell = row * wide + col
        ids = np.full(n * wide, self.unknown, np.int32)
        ids[cell] = letters
        # A linked list in each row: the next live symbol, and the one before it.
        nxt = np.arange(1, n * wide + 1)
        prv = nxt - 2
        begin, stop = np.arange(n) * wide, np.arange(n) * wide + sizes
        live = np.zeros(n * wide, bool)
        live[cell] = True
        rank = np.full(n * wide, NONE, np.int32)
        piece = np.zeros(n * wide, np.int32)

        def offer(r, c, d):
            """Put the pairs of symbols c and d of rows r on the agenda."""
            start, end = c - begin[r], nxt[d] - begin[r]
            rank[c], piece[c] = self.best(ids[c], ids[d], name(r), start, end)
            if names is None:
                seen.append((r, start, end, rank[c]))

        have = col + 1 < sizes[row]
        offer(row[have], cell[have], cell[have] + 1)
        todo = np.arange(n)
        while len(todo):
            at = begin[todo] + rank.reshape(n, wide)[todo].argmin(1)
            good = rank[at] < NONE
            todo, at = todo[good], at[good]
            if not len(todo):
                break
            after = nxt[at]
            then, before = nxt[after], prv[at]
            ids[at], live[after], rank[after], nxt[at] = piece[at], False, NONE, then
            rank[at] = NONE
            inside, led = then < stop[todo], before >= begin[todo]
            prv[then[inside]] = at[inside]
            offer(np.concatenate([todo[inside], todo[led]]), np.concatenate([at[inside], before[led]]), np.concatenate([then[inside], at[led]]))
        kept = live[cell]
        out, owner = ids[cell][kept], row[kept]
        odd = np.flatnonzero(out == self.unknown)
        if len(odd):
            chars = np.array(list(text), object)[kept][odd]
            spelled = [self.spell_out(x) for x in chars]
            times = np.ones(len(out), np.int64)
            times[odd] = [len(x) for x in spelled]
            out, owner = np.repeat(out, times), np.repeat(owner, times)
            out[np.repeat(np.isin(np.arange(len(times)), odd), times)] = np.concatenate(spelled)
        if names is None and self.dropout:
            r, c, d, k = (np.concatenate(x) for x in zip(*seen, strict=True))
            good = k < NONE
            r, spans = r[good], (c[good].astype(np.int64) << 32 | d[good]).astype(np.uint64)
            order = np.argsort(r, kind="stable")
            self.told = spans[order], np.bincount(r, minlength=n)
        return out, np.bincount(owner, minlength=n)

    def spell_out(self, letter: str) -> np.ndarray:
        """The byte pieces of a character that the model has no piece for."""
        return self.bytes[list((MARK if letter == OWN_MARK else letter).encode())]

    def merge_long(self, word: str, name: np.uint64 | None) -> list[int]:
        """merge() for one long word, with the agenda in a heap."""
        word, n = as_letters(word), len(word)
        ids = [self.letters.get(x, self.unknown) for x in word]
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        names = None if name is None else np.full(max(n - 1, 1), name)
        col = np.arange(n - 1)
        flat = np.array(ids)
        rank, piece = self.best(flat[:-1], flat[1:], None if names is None else names[: n - 1], col, col + 2)
        seen = [i << 32 | i + 2 for i in col[rank < NONE].tolist()]
        agenda = [(r, i, i + 2, p) for r, i, p in zip(rank.tolist(), col.tolist(), piece.tolist(), strict=True) if r < NONE]
        heapq.heapify(agenda)
        live = [True] * n

        def offer(i: int, j: int) -> None:
            one = lambda x: np.array([x], np.int64)
            r, p = self.best(one(ids[i]), one(ids[j]), None if names is None else names[:1], one(i), one(end[j]))
            if r[0] < NONE:
                seen.append(i << 32 | end[j])
                heapq.heappush(agenda, (int(r[0]), i, end[j], int(p[0])))

        while agenda:
            _, i, stop, to = heapq.heappop(agenda)
            j = end[i]
            if not live[i] or j >= n or end[j] != stop:
                continue  # one of the two has been merged since
            live[j], ids[i], end[i] = False, to, stop
            if stop < n:
                before[stop] = i
                offer(i, stop)
            if before[i] >= 0:
                offer(before[i], i)
        self.told = np.array(seen, np.uint64), np.array([len(seen)])
        out: list[int] = []
        for i in range(n):
            if live[i]:
                out += self.spell_out(word[i]).tolist() if ids[i] == self.unknown else [ids[i]]
        return out

    def learn(self, part: np.ndarray, names: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Segment parts by number, and say where in `flat` their pieces are and how many there are. Without names, keep their candidates."""
        words = [self.parts[k] for k in part.tolist()]
        sizes = self.lens[part]
        order = np.argsort(sizes, kind="stable")
        where, total = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        i = 0
        while i < len(order):
            longest = sizes[order[i]]
            # parts of like length together, and a bounded matrix
            j = min(int(np.searchsorted(sizes[order], longest + max(2, longest // 4), "right")), i + max(1, (1 << 18) // (int(longest) * 5 // 4 + 4)))
            pick = order[i:j]
            if longest > LONG:
                pick = order[i : i + 1]
                j, out = i + 1, np.array(self.merge_long(words[pick[0]], None if names is None else names[pick[0]]), np.int64)
                number = np.array([len(out)])
            else:
                out, number = self.merge([words[k] for k in pick.tolist()], sizes[pick], None if names is None else names[pick])
            while self.fill + len(out) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.fill : self.fill + len(out)] = out
            if names is None and self.dropout:
                spans, n = self.told
                while self.span_fill + len(spans) > len(self.spans):
                    self.spans = np.concatenate([self.spans, np.zeros_like(self.spans)])
                self.spans[self.span_fill : self.span_fill + len(spans)] = spans
                self.span_at[part[pick]], self.span_n[part[pick]] = self.span_fill + np.cumsum(n) - n, n
                self.span_fill += len(spans)
            where[pick] = self.fill + np.cumsum(number) - number
            total[pick] = number
            self.fill += len(out)
            i = j
        return where, total

    def varied(self, part: np.ndarray, names: np.ndarray) -> np.ndarray:
        """The occurrences of parts that skip a candidate of the part's own segmentation, by number."""
        out = []
        ends = np.cumsum(self.span_n[part])
        lo = 0
        while lo < len(part):  # some candidates at a time
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 100_000, "right")))
            n = self.span_n[part[lo:hi]]
            owner = np.repeat(np.arange(lo, hi), n)
            at = np.arange(len(owner)) + np.repeat(self.span_at[part[lo:hi]] - np.cumsum(n) + n, n)
            hit = owner[self.skipped(names[owner], self.spans[at])]
            out.append(hit[np.concatenate([[True], hit[1:] != hit[:-1]])] if len(hit) else hit)
            lo = hi
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def encode(self, texts: list[str], names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the texts, laid end to end, and their numbers. names: of the documents, as uint64."""
        if len(self.parts) > self.most_parts or self.fill > 40 * self.most_parts:
            self.clear()
        split = [PARTS.findall(" " + t) if t else [] for t in texts]
        flat = [x for s in split for x in s]
        had = len(self.parts)
        for x in set(flat).difference(self.index):
            self.index[x] = len(self.parts)
            self.parts.append(x)
        while len(self.parts) > len(self.at):
            self.at = np.concatenate([self.at, np.full(len(self.at), -1)])
            self.size, self.span_at, self.span_n, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.span_at, self.span_n, self.lens))
        self.lens[had : len(self.parts)] = list(map(len, self.parts[had:]))
        part = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        number = np.array([len(s) for s in split], np.int64)
        new = np.unique(part[self.at[part] < 0])
        if len(new):
            self.at[new], self.size[new] = self.learn(new, None)
        where, sizes, own_fill = self.at[part], self.size[part], self.fill
        if self.dropout:
            place = np.arange(len(flat)) - np.repeat(np.cumsum(number) - number, number)
            own = mix64(np.repeat(names, number) ^ (place.astype(np.uint64) + np.uint64(1)) * PLACE)
            some = self.varied(part, own)
            if len(some):
                where[some], sizes[some] = self.learn(part[some], own[some])
        self.fill = own_fill  # what skips gave isn't kept
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(where - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        total = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(number)])]
        return ids, np.diff(total)


def encoder(path: str, dropout: float) -> Encoder:
    """One for each worker process, kept between tasks."""
    return kept("encoder", (path, dropout), lambda: Encoder(path, dropout))


@lru_cache(1)
def spelling(path: str) -> Spelling:
    return Spelling(path)


def encode(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids", n_col: str = "n_tokens") -> DataFrame:
    """The rows of docs with the piece ids of each whole text and their number.

    A null text has null ids and no tokens; an empty one has no ids. dropout 0 gives the library's own encoding (but
    for U+2581). Rows of one id draw alike, so repeated rows are encoded alike; a null id is an id like others. Columns of docs that have the new columns' names are replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in (ids_col.lower(), n_col.lower())]
    rows = docs.select(F.xxhash64(F.lit(seed), F.col(id_col)).alias("__name"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"))
    text = text_of(text_col)

    def batches(it) -> Iterator:
        import pyarrow as pa

        own = encoder(model, dropout)
        for batch in it:
            for part in pieces(batch, 1 << 19, text=text):
                texts = text(part).to_pylist()
                ids, number = own.encode([t or "" for t in texts], np.asarray(part.column("__name")).view(np.uint64))
                offsets = pa.array(np.concatenate([[0], np.cumsum(number)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()), mask=pa.array([t is None for t in texts]))
                yield pa.record_batch([part.column("__row"), lists, pa.array(number, pa.int64())], ["__row", "__ids", "__n"])

    batches.keeps = "encoder"
    out = rows.transform(in_arrow, batches, f"__row {rows.schema['__row'].dataType.simpleString()}, __ids array<int>, __n long")
    return out.select(*[F.col("__row")[c].alias(c) for c in keep], F.col("__ids").alias(ids_col), F.col("__n").alias(n_col))


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows with the text that their ids spell; null ids give null."""

    @F.pandas_udf("string")
    def spell(ids):
        import pandas as pd

        own = spelling(model)
        out = pd.Series([None] * len(ids), dtype=object)
        some = np.flatnonzero(ids.notna().to_numpy())
        ends = np.cumsum([len(ids.iloc[k]) for k in some])
        lo = 0
        while lo < len(some):  # some ids at a time, whole texts
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 300_000, "right")))
            out.iloc[some[lo:hi]] = own.decode(ids.iloc[some[lo:hi]].tolist())
            lo = hi
        return out

    return encoded.withColumn(text_col, spell(F.col(ids_col)))
