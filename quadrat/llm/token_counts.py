"""Token counts of byte-level BPE, from a transducer compiled out of the merges.

State. After a prefix of a pre-token, the last token of that prefix's own tokenization decides everything that
follows: a token sequence is the BPE result exactly if every neighbouring pair in it is (the pair's bytes, tokenized
alone, give the pair). So a state holds the longest suffix that begins some token (a trie node) and, for each
position in that suffix, the last token of the prefix ending there and its token count relative to the whole prefix.
These states are finite in number; they are determinised lazily and interned. Reading a byte leads to one state and
emits the change of the token count, so the tokens of a text are the sum of what its transitions emit.

Runs. Each text is cut into chunks. A chunk with a pre-token start in it leaves in the same state whatever its entry; only its
head, before that start, depends on the entry. A chunk without one (inside a very long pre-token) is a map from entry states to exit states and
counts. All chunks of a batch run side by side in NumPy. Maps are made for the states that can occur: from guessed
entries, the exits of one chunk are entries of the next until no new one comes up, which is soon, as runs from different
states meet after some bytes (and else cycle through few states). The maps are then composed in a parallel scan: the entries of maps
point at the entries they lead to, and pointers and sums double until they reach the end of their pre-token.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, kept, pieces

LETTER, NUMBER, OTHER, SPACE, BLANK, EDGE = range(6)
#: The code points of Unicode's White_Space besides U+0020.
WHITE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The endings that the pre-tokenizer takes together with an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def classes() -> np.ndarray:
    """The pre-tokenizer's class of every code point."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[[ord(x) for x in m[0]]] = kind
    out[WHITE] = BLANK
    out[0x20] = SPACE
    return out


def pretoken_starts(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which code points begin a pre-token; edges: positions that only separate texts."""
    n = len(points)
    kind = classes()[points]
    kind[edges] = EDGE
    before = np.concatenate([[EDGE], kind[:-1]]).astype(np.uint8)
    after = np.concatenate([kind[1:], [EDGE]]).astype(np.uint8)
    white, white_before, white_after = (x >= SPACE for x in (kind, before, after))
    white, white_before, white_after = white & (kind != EDGE), white_before & (before != EDGE), white_after & (after != EDGE)
    starts = np.where(white, ~white_before | (~white_after & (after != EDGE)), (kind != before) & (before != SPACE))
    for end in ENDINGS:
        k = len(end) + 1
        at = np.flatnonzero((points[: n - len(end)] == 39) & starts[: n - len(end)])
        for i, letter in enumerate(end, 1):
            at = at[points[at + i] == ord(letter)]
        at = at[kind[at] != EDGE]
        starts[at + 1] = False
        at = at[at + k < n]
        starts[at[kind[at + k] == LETTER] + k] = True
    return starts


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the rest from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Counts tokens of byte-level BPE. most_states bounds memory: beyond it the table is emptied and built anew."""

    def __init__(self, path: str, most_states: int = 250_000):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[x] for x in s)
        merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        tokens = dict.fromkeys([bytes([b]) for b in range(256)] + [a + b for a, b in self.ranks])
        self.tokens = [t for t in tokens if self.split(t) == [t]]
        # A byte changes the count by 1 at most upwards, and downwards by less than the bytes of a token.
        self.SHIFT = max(map(len, self.tokens)).bit_length() + 1
        self.BIAS = 1 << self.SHIFT - 1
        #: Added tokens: the library takes their strings out of a text before all else, as one token each.
        self.special = [x["content"] for x in told["added_tokens"]]
        self.most_states = most_states
        self._trie()
        self.fits: dict[int, bool] = {}
        self.clear()

    def split(self, word: bytes) -> list[bytes]:
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(x, 1 << 30), i) for i, x in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _trie(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.depth, token = [0], [-1]
        for t, word in enumerate(self.tokens):
            node = 0
            for b in word:
                if b not in self.next[node]:
                    self.next[node][b] = len(self.next)
                    self.next.append({})
                    self.depth.append(self.depth[node] + 1)
                    token.append(-1)
                node = self.next[node][b]
            token[node] = t
        self.fail = [0] * len(self.next)
        #: Tokens that end here, the longest first, as (token, length).
        self.ends: list[tuple] = [()] * len(self.next)
        queue = [0]
        for node in queue:
            for b, to in self.next[node].items():
                if node:
                    back = self.fail[node]
                    while back and b not in self.next[back]:
                        back = self.fail[back]
                    self.fail[to] = self.next[back].get(b, 0)
                own = ((token[to], self.depth[to]),) if token[to] >= 0 else ()
                self.ends[to] = own + self.ends[self.fail[to]]
                queue.append(to)

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.columns = np.full(256, -1, np.int64)
        self.width = 64
        self.used = 0
        self.table = np.full((1024, self.width), -1, np.int32)
        self.intern((0, ((-1, 0),)))

    def intern(self, state: tuple) -> int:
        k = self.ids.get(state)
        if k is None:
            k = self.ids[state] = len(self.states)
            self.states.append(state)
            if k >= len(self.table):
                self.table = np.concatenate([self.table, np.full((len(self.table) // 2, self.width), -1, np.int32)])
        return k

    def fit(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            x, y = self.tokens[a], self.tokens[b]
            if len(self.fits) > 4_000_000:
                self.fits.clear()
            known = self.fits[key] = self.split(x + y) == [x, y]
        return known

    def step(self, state: tuple, b: int) -> tuple[tuple, int]:
        """The state after byte b, and the change of the token count."""
        node, tail = state
        while node and b not in self.next[node]:
            node = self.fail[node]
        node = self.next[node].get(b, 0)
        for token, size in self.ends[node]:
            last, count = tail[-size]
            if last < 0 or self.fit(last, token):
                break
        else:
            raise ValueError("the merges are not those of a byte-level BPE")
        change = count + 1
        keep = self.depth[node]
        return (node, (*((t, c - change) for t, c in tail[len(tail) - keep :]), (token, 0))), change

    def learn(self, state: int, b: int) -> None:
        if self.columns[b] < 0:
            if self.used == self.width:
                self.table = np.concatenate([self.table, np.full((len(self.table), 32), -1, np.int32)], 1)
                self.width += 32
            self.columns[b] = self.used
            self.used += 1
        to, change = self.step(self.states[state], b)
        k = self.intern(to)
        self.table[state, self.columns[b]] = k << self.SHIFT | change + self.BIAS

    def run(self, data: np.ndarray, reset: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each lane, bytes [start, end) from its entry state, emits in all, and its exit state."""
        order = np.argsort(starts - ends, kind="stable")
        size = (ends - starts)[order]
        at, state, total = starts[order].copy(), entry[order].copy(), np.zeros(len(order), np.int64)
        live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
        for m in live:
            here = at[:m]
            b = data[here]
            s = np.where(reset[here], 0, state[:m])
            col = self.columns[b]
            v = self.table[s, col]
            bad = np.flatnonzero((v < 0) | (col < 0))
            if len(bad):
                for key in np.unique(s[bad] << 8 | b[bad]).tolist():
                    self.learn(key >> 8, key & 255)
                v[bad] = self.table[s[bad], self.columns[b[bad]]]
            state[:m] = v >> self.SHIFT
            total[:m] += (v & (1 << self.SHIFT) - 1) - self.BIAS
            at[:m] += 1
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return total[back], state[back]

    def counts(self, texts: list[str], chunk: int = 1024) -> np.ndarray:
        """The number of tokens of each text; strings of added tokens in it are one each."""
        if not any(x in t for x in self.special for t in texts):
            return self.plain_counts(texts, chunk)
        cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        parts = [cut.split(t) for t in texts]
        sizes = np.array([len(p) for p in parts])
        inner = self.plain_counts([x for p in parts for x in p], chunk)
        return np.bincount(np.repeat(np.arange(len(texts)), sizes), inner, len(texts)).astype(np.int64) + sizes - 1

    def plain_counts(self, texts: list[str], chunk: int) -> np.ndarray:
        if len(self.states) > self.most_states:
            self.clear()
        whole = "\0".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(whole.encode(), np.uint8)
        chars = np.array([len(t) for t in texts], np.int64)
        edges = (np.cumsum(chars + 1) - 1)[:-1]
        if not len(data):
            return np.zeros(len(texts), np.int64)
        starts = pretoken_starts(points, edges)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        byte = np.concatenate([[0], np.cumsum(width)])
        reset = np.zeros(len(data) + 1, bool)
        reset[byte[:-1][starts]] = True
        low = byte[np.concatenate([[0], edges + 1])]
        high = byte[np.concatenate([edges, [len(points)]])]
        n = -(-(high - low) // chunk)
        text = np.repeat(np.arange(len(texts)), n)
        k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        begin = low[text] + k * chunk
        end = np.minimum(begin + chunk, high[text])
        marks = np.flatnonzero(reset)
        first = np.concatenate([marks, [len(data)]])[np.searchsorted(marks, begin)]
        head = np.minimum(first, end)  # where the part that depends on the entry ends
        total, leave = self.run(data, reset, head, end, np.zeros(len(begin), np.int64))
        total += self.heads(data, reset, begin, head, head == end, leave)
        return np.bincount(text, total, len(texts)).astype(np.int64)

    def heads(self, data: np.ndarray, reset: np.ndarray, begin: np.ndarray, head: np.ndarray, passes: np.ndarray, leave: np.ndarray) -> np.ndarray:
        """What the heads of chunks emit, at the chunk where their pre-token enters its first whole chunk.

        passes: chunks that are all head; leave: the exits of the others.
        """
        out = np.zeros(len(begin), np.int64)
        depend = head > begin
        if not depend.any():
            return out
        follows = depend & np.concatenate([[False], passes[:-1] & depend[:-1]])  # its entry is the exit of a map
        guess = np.zeros(len(begin), np.int64)
        whole = np.flatnonzero(passes & depend)
        guess[whole] = self.run(data, reset, begin[whole], head[whole], guess[whole])[1]
        known = np.where(passes, guess, leave)
        chunk = np.flatnonzero(depend)
        # A row is an entry of a chunk's map: chunk << 32 | state, sorted; what it emits, and the key of the entry it leads to.
        new = chunk << 32 | known[chunk - 1]
        starts = new[~follows[chunk]]
        keys, emits, leads = (np.zeros(0, np.int64) for _ in range(3))
        while len(new):
            at = new >> 32
            n, exits = self.run(data, reset, begin[at], head[at], new & 0xFFFFFFFF)
            on = passes[at] & (at + 1 < len(begin))
            on[on] = follows[at[on] + 1]
            to = np.where(on, at + 1 << 32 | exits, -1)
            keys, emits, leads = (np.concatenate(x) for x in ((keys, new), (emits, n), (leads, to)))
            order = np.argsort(keys, kind="stable")
            keys, emits, leads = keys[order], emits[order], leads[order]
            new = np.setdiff1d(to[on], keys)
        # Pointers double; the last row is where all end.
        to = np.where(leads < 0, len(keys), np.searchsorted(keys, leads))
        to, emits = np.append(to, len(keys)), np.append(emits, 0)
        while (to < len(keys)).any():
            emits = emits + emits[to]
            to = to[to]
        out[starts >> 32] = emits[np.searchsorted(keys, starts)]
        return out


def transducer(path: str) -> Transducer:
    """One for each worker process, kept between tasks."""
    return kept("transducer", (path,), lambda: Transducer(path))


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every whole text, for a byte-level BPE .json file at a path that executors have.

    Null and empty texts have no tokens. Repeated rows and ids stay as rows of their own. Other columns are not read.
    """

    def batches(it) -> Iterator:
        import pyarrow as pa

        machine = transducer(tokenizer)
        for batch in it:
            for part in pieces(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(machine.counts(texts))], ["id", "n_bytes", "n_tokens"])

    batches.keeps = "transducer"
    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).transform(in_arrow, batches, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
