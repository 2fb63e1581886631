"""SentencePiece encoding with seeded merge-dropout, and decoding.

A BPE model merges, again and again, the adjacent pair whose union is the best piece; the agenda holds
the candidate pairs. Under dropout a candidate that comes up is skipped with probability `dropout`,
and stays out until a merge next to it makes a new candidate. The draw is a keyed hash of seed, doc_id,
the occurrence's place in the text, the candidate's place in the word and the piece it would make: the
same call gives the same pieces on any machine and after any retry, and every occurrence of a word draws
for itself. With dropout 0 the pieces are the library's own.

No piece of the model reaches over the start of a word (that is checked), so texts are cut into words.
Each batch merges its words many at once in numpy; occurrences of a word share the work as long as their
draws are alike. Words over LONGEST characters take a heap, one by one. Characters without a piece become bytes, and so does a literal U+2581, which is
why decoding gives the text again, whatever it holds.

Defined results: null and empty texts have no pieces and decode to the empty text; repeated rows repeat
results; rows without doc_id count as doc_id 0; texts of any length are encoded whole; an empty table
gives an empty one; an input column that has the output's name is replaced, all others pass.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

SEED, DROPOUT = 20, 0.1
LONGEST, CHARS_AT_ONCE = 48, 500_000
_BITS = 20
SPACE = "▁"
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_BIG = np.iinfo(np.int32).max
_M1, _M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_MASK = (1 << 64) - 1


def _mix(*parts):
    """A 64-bit hash of integers or arrays of them; the same for both."""
    whole = all(isinstance(p, int) for p in parts)
    h = 0x243F6A8885A308D3 if whole else np.uint64(0x243F6A8885A308D3)
    for p in parts:
        if whole:
            h = ((h ^ p) * _M1) & _MASK
            h ^= h >> 32
            h = (h * _M2) & _MASK
            h ^= h >> 29
        else:
            h = (np.atleast_1d(h) ^ (np.uint64(p) if isinstance(p, int) else p.astype(np.uint64))) * np.uint64(_M1)
            h = h ^ (h >> np.uint64(32))
            h = h * np.uint64(_M2)
            h = h ^ (h >> np.uint64(29))
    return h


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and each word's first place."""
    lengths = np.array([len(w) for w in words], np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(lengths) - lengths


class Subwords:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        if any(p and re.search(f"[^{SPACE}]{SPACE}", t) for t, p in zip(self.text, plain)):
            raise ValueError("a piece of this model reaches over the start of a word")
        self.ids = {t: i for i, t in enumerate(self.text) if plain[i]}
        byte = {int(t[3:5], 16): i for i, t in enumerate(self.text) if sp.is_byte(i)}
        self.bytes_of = byte
        self.raw = [bytes([int(t[3:5], 16)]) if sp.is_byte(i) else t.replace(SPACE, " ").encode() if plain[i] else b"" for i, t in enumerate(self.text)]
        self.none = n  # a character without a piece
        best = sorted((i for i in self.ids.values() if len(self.text[i]) > 1), key=lambda i: (-sp.get_score(i), i))
        self.rank = np.full(n + 1, _BIG, np.int32)
        self.rank[best] = np.arange(len(best))
        pairs = {}
        for i in best:
            t = self.text[i]
            for k in range(1, len(t)):
                a, b = self.ids.get(t[:k]), self.ids.get(t[k:])
                if a is not None and b is not None:
                    pairs[a * (n + 1) + b] = i
        self.pairs = pairs
        self.wide = n + 1
        self.best = np.array([*best, self.none], np.int32)  # the piece of each rank
        self._build_table()
        self.char = np.full(0x110000, self.none, np.int32)
        for t, i in self.ids.items():
            if len(t) == 1:
                self.char[ord(t)] = i

    def _build_table(self):
        """Pair -> rank, as an open table of 2^_BITS slots; a pair is at most _far slots from its own."""
        keys = np.array(list(self.pairs), np.int64)
        slots, ranks = np.full((1 << _BITS) + 64, -1, np.int64), np.full((1 << _BITS) + 64, _BIG, np.int32)
        self._far = 0
        for k, at in zip(keys.tolist(), self._slot(keys).tolist()):
            far = 0
            while slots[at + far] >= 0:
                far += 1
            slots[at + far], ranks[at + far] = k, self.rank[self.pairs[k]]
            self._far = max(self._far, far)
        self._slots, self._ranks = slots, ranks

    @staticmethod
    def _slot(key):
        return ((key.astype(np.uint64) * np.uint64(_M1)) >> np.uint64(64 - _BITS)).astype(np.int64)

    def _pair(self, a, b):
        """The rank of what each pair makes; _BIG if nothing. b may be -1: no right part."""
        key = a.astype(np.int64) * self.wide + b
        at = self._slot(key)
        found = self._slots[at]
        out = np.where(found == key, self._ranks[at], _BIG)
        # few pairs lie further on than their own slot, and an empty slot ends the search
        left = np.nonzero((found != key) & (found >= 0) & (b >= 0))[0] if key.ndim == 1 else None
        far = 0
        while left is not None and len(left) and far < self._far:
            far += 1
            k, place = key[left], at[left] + far
            f = self._slots[place]
            hit = f == k
            out[left[hit]] = self._ranks[place[hit]]
            left = left[~hit & (f >= 0)]
        out[b < 0] = _BIG
        return out

    def _bytes(self, char: str) -> list[int]:
        return [self.bytes_of[b] for b in char.encode("utf-8", "surrogatepass")]

    def slow(self, chars: list[str], key: int, limit: int) -> list[int]:
        """One word by a heap; an entry is (rank, place, right, piece), stale if either part has changed since."""
        sym = [self.ids.get(c, self.none) for c in chars]
        n = len(sym)
        right, left, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
        agenda: list[tuple] = []

        def offer(i):
            j = right[i]
            if j < n:
                piece = self.pairs.get(sym[i] * self.wide + sym[j])
                if piece is not None:
                    heapq.heappush(agenda, (int(self.rank[piece]), i, j, piece, size[i], size[j]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, j, piece, a, b = heapq.heappop(agenda)
            if size[i] != a or j >= n or size[j] != b or right[i] != j:
                continue
            if limit and _mix(key, _mix(i, piece)) >> 40 < limit:
                continue
            sym[i], size[i], right[i] = piece, a + b, right[j]
            size[j] = 0
            if right[j] < n:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        out: list[int] = []
        i = 0
        while i < n:
            out += [sym[i]] if sym[i] != self.none else self._bytes(chars[i])
            i = right[i]
        return out

    def fast(self, words: list[str], of: np.ndarray, keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of about one length at once, as linked rows in arrays. `of` is the word of each occurrence, `keys` its hash.

        A row stands for all occurrences of a word whose draws have been alike so far; where they differ,
        those that skip the merge go on in a row of their own. Returns the rows' symbols, -1 where one was
        merged into its left, each row's word, each occurrence's row and the characters by word and column.
        """
        n, width = len(words), max(map(len, words)) + 1
        code, first = _coded(words)
        lengths = np.diff(np.append(first, len(code)))
        sym = np.full((n, width), -1, np.int32)
        row = np.repeat(np.arange(n), lengths)
        column = np.arange(len(code)) - np.repeat(first, lengths)
        sym[row, column] = self.char[code]
        chars = np.zeros((n, width), np.uint32)
        chars[row, column] = code
        # right and left are columns; the last column of a row is always empty, so a right part there ends the word
        right = np.tile(np.minimum(np.arange(1, width + 1), width - 1).astype(np.int8), (n, 1))
        left = np.tile(np.arange(-1, width - 1).astype(np.int8), (n, 1))
        rank = np.full((n, width), _BIG, np.int32)
        rank[:, :-1] = self._pair(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, width - 1)
        rank[sym < 0] = _BIG
        whose, at_row = np.arange(n), of.copy()
        state = [sym, right, left, rank]
        rows, live = np.arange(n), np.arange(len(of)) if limit else np.zeros(0, np.int64)  # rows and occurrences still at work
        while len(rows):
            sym, right, left, rank = state
            p = (rank if len(rows) == len(rank) else rank[rows]).argmin(1)
            r = rank[rows, p]
            going = r < _BIG
            rows, r, p = rows[going], r[going], p[going]
            if not len(rows):
                break
            if limit:
                where = np.full(len(rank), -1, np.int64)
                where[rows] = np.arange(len(rows))
                mine = where[at_row[live]]
                live, mine = live[mine >= 0], mine[mine >= 0]
                skips = (_mix(keys[live], _mix(p, self.best[r])[mine]) >> np.uint64(40)) < np.uint64(limit)
                some, all_ = np.bincount(mine, weights=skips, minlength=len(rows)), np.bincount(mine, minlength=len(rows))
                never, split = some == all_, (some > 0) & (some < all_)
                fresh = np.zeros(0, np.int64)
                if split.any():
                    at = np.nonzero(split)[0]
                    fresh = np.arange(len(rank), len(rank) + len(at))
                    state = [np.concatenate([x, x[rows[at]]]) for x in state]
                    sym, right, left, rank = state
                    whose = np.concatenate([whose, whose[rows[at]]])
                    rank[fresh, p[at]] = _BIG
                    where = np.full(len(rows), -1, np.int64)
                    where[at] = fresh
                    gone = skips & split[mine]
                    at_row[live[gone]] = where[mine[gone]]
                rank[rows[never], p[never]] = _BIG
                still = rows
                at, r, p = rows[~never], r[~never], p[~never]
                rows = np.concatenate([still, fresh])
            else:
                at = rows
            gone = right[at, p].astype(np.int64)
            sym[at, p], sym[at, gone] = self.best[r], -1
            rank[at, gone] = _BIG
            nxt = right[at, gone].astype(np.int64)
            right[at, p] = nxt
            left[at, nxt] = p
            rank[at, p] = self._pair(sym[at, p], sym[at, nxt])
            inner = p > 0
            at, p = at[inner], p[inner]
            before = left[at, p].astype(np.int64)
            rank[at, before] = self._pair(sym[at, before], sym[at, p])
        return state[0], whose, at_row, chars

    def _spelt(self, sym: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all rows in a row, and each row's number of them; characters without a piece become bytes."""
        held = sym >= 0
        flat = sym[held]
        odd = flat == self.none
        if not odd.any():
            return flat, held.sum(1)
        which, of = np.unique(chars[held][odd], return_inverse=True)
        spelt = [self._bytes(chr(c)) for c in which.tolist()]
        size = np.ones(len(flat), np.int64)
        size[odd] = np.array([len(x) for x in spelt])[of]
        first = np.cumsum(size) - size
        out = np.repeat(flat, size)
        for k in range(max(map(len, spelt))):
            some = size[odd] > k
            out[first[odd][some] + k] = np.array([x[k] if len(x) > k else 0 for x in spelt], np.int32)[of[some]]
        row = np.repeat(np.arange(len(sym)), held.sum(1))
        return out, np.bincount(row, weights=size, minlength=len(sym)).astype(np.int64)

    def encode_words(self, words: list[str], token: np.ndarray, keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat pieces of all segmentations that occur, how many each has, and which one each occurrence takes."""
        lengths = np.array([len(w) for w in words])
        which = np.zeros(len(token), np.int64)
        edges = [0, 4, 7, 10, 13, 17, 24, LONGEST]
        flats, counts, total = [], [], 0
        for lo, hi in zip(edges, edges[1:]):
            known = np.nonzero((lengths > lo) & (lengths <= hi))[0]
            if not len(known):
                continue
            number = np.full(len(words), -1, np.int64)
            number[known] = np.arange(len(known))
            here = np.nonzero(number[token] >= 0)[0]
            some = [words[i] for i in known.tolist()]
            sym, whose, row, chars = self.fast(some, number[token[here]], keys[here], limit)
            flat, size = self._spelt(sym, chars[whose])
            flats.append(flat)
            counts.append(size)
            which[here] = total + row
            total += len(sym)
        whole: dict[int, int] = {}  # without dropout all occurrences of a long word are alike
        for i in np.nonzero(lengths[token] > LONGEST)[0].tolist() if len(words) else ():
            t = int(token[i])
            if limit or t not in whole:
                x = np.array(self.slow(list(words[t]), int(keys[i]), limit), np.int32)
                flats.append(x)
                counts.append(np.array([len(x)]))
                whole[t] = total
                total += 1
            which[i] = whole[t]
        return np.concatenate([np.zeros(0, np.int32), *flats]), np.concatenate([np.zeros(0, np.int64), *counts]), which

    def encode(self, texts: list, keys: list[int], seed: int = SEED, dropout: float = DROPOUT) -> list[np.ndarray]:
        ids, starts = self.flat(texts, keys, seed, dropout)
        return [ids[a:b] for a, b in zip(starts, starts[1:])]

    def flat(self, texts: list, keys: list[int], seed: int = SEED, dropout: float = DROPOUT) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all texts in a row, and where each text's begin, with the end of the last."""
        limit = int(dropout * (1 << 24))
        known: dict[str, int] = defaultdict(count().__next__)  # words are numbered as they come
        streams, special = [], {}
        for i, t in enumerate(texts):
            t = t or ""
            if SPACE in t:
                special[i] = self._literal(t, keys[i], seed, limit)
                t = ""
            streams.append(np.fromiter(map(known.__getitem__, _WORD.findall(SPACE + t.replace(" ", SPACE)) if t else ()), np.int64))
        sizes = np.array([len(s) for s in streams])
        words = list(known)
        token = np.concatenate(streams) if streams else np.zeros(0, np.int64)
        place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        drawn = _mix(seed, np.repeat(np.array(keys, np.int64), sizes), place) if limit else np.zeros(len(token), np.uint64)
        flat, counts, which = self.encode_words(words, token, drawn, limit)
        offsets = np.cumsum(counts) - counts
        c = counts[which]
        ends = np.cumsum(c)
        ids = flat[np.repeat(offsets[which] - (ends - c), c) + np.arange(ends[-1] if len(ends) else 0)]
        starts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        if special:
            each = [special.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(starts, starts[1:]))]
            ids, starts = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return ids, starts

    def _literal(self, text: str, key: int, seed: int, limit: int) -> np.ndarray:
        """A text with U+2581 in it: that character stands for itself, as bytes, and starts no word."""
        marked = [SPACE] + [SPACE if c == " " else "" if c == SPACE else c for c in text]
        out: list[int] = []
        word: list[str] = []
        place = 0
        for c in [*marked, None]:
            if c is None or (c == SPACE and word and word[-1] != SPACE):
                out += self._marked(word, _mix(seed, key & _MASK, place), limit)
                word, place = [], place + 1
            word.append(c)
        return np.array(out, np.int32)

    def _marked(self, word: list[str], key: int, limit: int) -> list[int]:
        out, run = [], []
        for c in [*word, ""]:
            if c == "":
                if run:
                    out += self.slow(run, _mix(key, len(out)), limit)
                run = []
                out += self._bytes(SPACE)
            else:
                run.append(c)
        return out[: -len(self._bytes(SPACE))]

    def decode(self, ids) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


_loaded: dict[str, Subwords] = {}


def model_at(path: str) -> Subwords:
    if path not in _loaded:
        _loaded[path] = Subwords(path)
    return _loaded[path]


def _slices(texts: list, most: int = CHARS_AT_ONCE):
    """Ranges of rows with about `most` characters."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _encoded(model: Subwords, texts: pa.Array, keys: pa.Array, seed: int, dropout: float):
    """For some rows at a time: their pieces in a row, and where each row's begin."""
    texts, keys = texts.to_pylist(), keys.fill_null(0).to_pylist()
    for a, b in _slices(texts):
        yield model.flat(texts[a:b], keys[a:b], seed, dropout)


def _lists(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    starts, total = [np.zeros(1, np.int64)], 0
    for ids, at in parts:
        starts.append(total + at[1:])
        total += len(ids)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(starts), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *(x for x, _ in parts)]), pa.int32()))


def _texts(model: Subwords, ids: np.ndarray, starts: np.ndarray) -> list[str]:
    ids, starts = ids.tolist(), starts.tolist()
    return [model.decode(ids[a:b]) for a, b in zip(starts, starts[1:])]


def encoder(path: str, seed: int = SEED, dropout: float = DROPOUT):
    """A column function of (text, id): array<int> of pieces."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array, keys: pa.Array) -> pa.Array:
        return _lists(list(_encoded(model_at(path), texts, keys, seed, dropout)))

    return encode


def decoder(path: str):
    """A column function of array<int>: the text; a null array is the empty text."""

    @F.arrow_udf("string")
    def decode(pieces: pa.Array) -> pa.Array:
        model = model_at(path)
        return pa.array([model.decode(x or ()) for x in pieces.to_pylist()], pa.string())

    return decode


def round_trip(path: str, seed: int = SEED, dropout: float = DROPOUT):
    """A column function of (text, id): the pieces, and the text decoded from them, in one pass of a worker."""

    @F.arrow_udf("pieces array<int>, decoded string")
    def both(texts: pa.Array, keys: pa.Array) -> pa.Array:
        model = model_at(path)
        parts = list(_encoded(model, texts, keys, seed, dropout))
        decoded = pa.array([t for ids, at in parts for t in _texts(model, ids, at)], pa.string())
        return pa.StructArray.from_arrays([_lists(parts), decoded], ["pieces", "decoded"])

    return both


def encode_documents(docs: DataFrame, path: str, seed: int = SEED, dropout: float = DROPOUT, text: str = "text", out: str = "pieces") -> DataFrame:
    """docs with the pieces of each text."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, encoder(path, seed, dropout)(F.col(text), F.col("doc_id").cast("long")))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text encoded and decoded again: counts and digests, and whether nothing was lost."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounded_batches(spark)
    done = docs.select("doc_id", "text", round_trip(path)("text", F.col("doc_id").cast("long")).alias("r")).select("doc_id", "text", "r.*")
    return done.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.size("pieces").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("pieces", ","), 256).alias("pieces_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("lossless"),
    )
