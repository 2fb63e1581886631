"""N-gram Jaccard join: all documents whose shingle sets are alike, as components of the links.

1. A document's set: hashes (64 bits) of its distinct word shingles. Rows with equal sets are one class,
   one node of all that follows, named by a hash of the set.
2. Candidates without a miss. Two sets of sizes a <= b with intersection >= t * union differ in at most
   D = (a + b) * (1 - t) / (1 + t) elements. Sizes fall into bands, a tile holds two neighbouring
   bands. In a tile the universe of shingles is cut by hash into D + 1 + S parts: similar sets agree on
   at least 1 + S whole parts. Each set leaves out the digests of its S most frequent parts. In any one
   order of all digests the first that both sets share has S shared ones behind it, so neither leaves
   it out. The order is by counts of all digests of all documents in SKETCH counters (a fixed size),
   then by digest; collisions there cost time, never a link. Digests go to the machines by tile, and in
   hash ranges of it, so that a node is named in few ranges. With its name go its size and parities: for
   each of some buckets whether it holds an odd number of the set's elements. Where two sets' parities
   differ, at least one element is in one set alone, so they bound what the sets may have in common.
3. A digest that up to NEAR nodes share gives each of their pairs, so at most NEAR - 1 a node. Most are
   strangers with one passage in common, more of them with each document; parities and sizes part nearly all of
   them in the range itself, so that only a pair that may be a link becomes a row, once a range. It goes on only
   if the two bitmap signatures allow a link, too: bits of one side that the other lacks are elements that it
   lacks. A digest that more share keeps them all together, and of what a range keeps together only a spanning
   forest is handed on. A map task thins digests that many of its documents share to NEAR + 1 nodes, so one that
   a third of all documents share costs few rows.
4. Components of these pairs are groups. A group is laid out in tiles by size band, large bands in
   several by hash. Tiles of bands that can hold links meet in pairs, first by size and signature alone: groups
   become what signatures connect, and only the sets of these travel. In a pair of tiles, bitmap
   signatures (hash -> bit) bound the overlap from above: |A & B| <= |A| - bits of A that B lacks. What
   passes is decided by intersecting the sorted arrays. Sets already known to be connected in this pair
   of tiles need no decision: they can't change the components.
5. Components of the links, with equal sets joined in.

No pair of documents is ever a row unless it is a candidate or a link; tiles are bounded by TILE
elements. Defined results: null text, empty text and texts without words have no set, are linked with
nothing and are their own component; texts with fewer words than a shingle are one shingle; rows that
repeat a doc_id are one document with all the links of its rows; a null doc_id has a null component; an
empty table gives an empty one; texts of any length are shingled whole; columns beyond doc_id and text
are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, drop_cut, join_class, table
from .graph import components

#: Parts beyond D + 1: SPARE, and one for each D / SPARE_SHARE.
SPARE, SPARE_SHARE = 2, 1
#: Counters of digests, and how many of them are a row when they are summed up.
SKETCH_BITS, SKETCH_ROW = 22, 4096
#: Elements of sets that one tile holds about; digests in one range of hashes.
TILE, RANGE = 4_000_000, 16_000_000
#: Digests of a range that are looked at together; a range is many of these, as each row of a range names its nodes anew.
SLICE = 1_000_000
#: Nodes of a digest whose pairs are looked at one by one.
NEAR = 8
#: Documents' digests that a map task thins at a time.
THIN = 1_000_000
#: Bits of a signature for each element of the largest set, and at most, in a pair of tiles.
BITS_EACH, BITS_MOST = 2, 1 << 14
#: Bytes of words that are hashed by place; longer ones by a digest of their own.
LONG_WORD = 64
#: Parities of a set for each element in which linked sets may differ, at least.
PARITIES = 4
BROADCAST_ROWS = 500_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M1
    return x ^ (x >> np.uint64(31))


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random 64-bit value for each byte, one for both cases of A-Z, and which bytes part words."""
    value = _stir(np.arange(1, 257, dtype=np.uint64) * _M1)
    value[65:91] = value[97:123]
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    return value, blank


_VALUE, _BLANK = _tables()
#: Bytes that are hashed at a time.
_AT_ONCE = 1_000_000
#: Bytes of shingles that a task hands on at a time; bits that are spread out at a time.
_HANDED, _SPREAD = 8_000_000, 1 << 24


def _chain(x: np.ndarray, n: int, first: int, count: int) -> np.ndarray:
    """Hashes of the n words from each of `count` places on."""
    h = np.full(count, n, np.uint64)
    for k in range(n):
        h = _stir(h * _M1 + x[first + k : first + k + count])
    return h


class Shingler:
    """Texts -> for each a sorted array of 64-bit hashes of its distinct shingles."""

    def __init__(self, words: int):
        self.words = words

    def __call__(self, texts):
        held, size = [], 0
        for t in texts:
            b = (t or "").encode("utf-8", "surrogatepass")
            held.append(b)
            size += len(b) + 1
            if size >= _AT_ONCE:
                yield from self._sets(held)
                held, size = [], 0
        if held:
            yield from self._sets(held)

    def _sets(self, texts: list[bytes]):
        b = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        inside = ~_BLANK[b]
        at = np.nonzero(inside)[0]
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1] + 1
        first = np.nonzero(new)[0]
        x = np.zeros(0, np.uint64)
        if len(first):
            # a word's hash: the sum of its bytes' values times powers by place, which over long words would be weak
            length = np.diff(np.append(first, len(at)))
            place = np.minimum(np.arange(len(at)) - np.repeat(first, length), LONG_WORD)
            power = np.cumprod(np.full(LONG_WORD + 1, _M1))
            x = _stir(np.add.reduceat(_VALUE[b[at]] * power[place], first) + length.astype(np.uint64))
            for k in np.nonzero(length > LONG_WORD)[0].tolist():
                word = b[at[first[k]] : at[first[k]] + length[k]].tobytes().translate(_LOWER)
                x[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        last = np.searchsorted(at[first], ends) if len(first) else np.zeros(len(ends), np.int64)
        n = self.words
        h = _chain(x, n, 0, len(x) - n + 1) if len(x) >= n else x[:0]
        begin = 0
        for end in last.tolist():
            if end - begin >= n:
                s = np.sort(h[begin : end - n + 1])
                keep = np.ones(len(s), bool)
                keep[1:] = s[1:] != s[:-1]
                yield s[keep]
            elif end > begin:
                yield _chain(x, end - begin, begin, 1)
            else:
                yield x[:0]
            begin = end


class Bands:
    """Size bands for a threshold num / den: linked sets are in one band or in neighbours."""

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den, self.low = num, den, [1]
        while self.low[-1] <= largest:
            # the smallest size that no member of the band can be linked to, beyond the next band
            self.low.append(max(self.low[-1] + 1, (self.low[-1] * den) // num + 1))
        self.edges = np.array(self.low, np.int64)

    def of(self, size):
        return np.searchsorted(self.edges, size, side="right") - 1

    def parts(self, tile: int) -> int:
        """Parts in a tile of bands tile and tile + 1."""
        return self.differ(tile) + 1 + self.spare(tile)

    def differ(self, tile: int) -> int:
        top = self.low[min(tile + 2, len(self.low) - 1)] - 1
        return (2 * top * (self.den - self.num)) // (self.den + self.num)

    def spare(self, tile: int) -> int:
        return SPARE + self.differ(tile) // SPARE_SHARE

    def parities(self, tile: int) -> int:
        """Bits of a set's parities in a tile: strangers differ in about half of them, which is to be well beyond what links may differ in."""
        return max(64, 1 << (PARITIES * (self.differ(tile) + 1) - 1).bit_length())


def _tile_digests(x: np.ndarray, bands: Bands):
    """For each of a set's two tiles: the digests of all parts, and how many of them may be left out."""
    band = int(bands.of(len(x)))
    for tile in (band - 1, band):
        if tile < 0:
            continue
        k = bands.parts(tile)
        place = (_stir(x + np.uint64(tile + 1)) % np.uint64(k)).astype(np.int64)
        sums = np.zeros(k, np.uint64)
        np.add.at(sums, place, _stir(x * _M1 + np.uint64(7)))
        yield _stir(sums * _M2 + np.arange(k, dtype=np.uint64) + np.uint64(tile << 32)), bands.spare(tile)


def _counter(digests: np.ndarray) -> np.ndarray:
    return (digests >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def part_digests(x: np.ndarray, bands: Bands, counts: np.ndarray | None = None) -> np.ndarray:
    """Digests of a set's parts in its two tiles, one tile after the other, without each tile's most frequent ones."""
    out = []
    for d, spare in _tile_digests(x, bands):
        order = np.lexsort((d, counts[_counter(d)])) if counts is not None else np.argsort(d)
        out.append(d[order[: len(d) - spare]])
    return np.concatenate(out)


def parities(x: np.ndarray, bits: int) -> bytes:
    """For each of `bits` buckets of hashes whether the set has an odd number of elements there."""
    odd = np.bincount(((x >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def node_of(x: np.ndarray) -> int:
    """A set's name: equal sets have equal ones. Different sets that share one cost time, never a link."""
    return int(_stir(np.bitwise_xor.reduce(_stir(x ^ np.uint64(5)))[None] + np.uint64(len(x))).view(np.int64)[0])


def signature(x: np.ndarray) -> bytes:
    """A bitmap of a set, of BITS_EACH bits an element or more, a power of two; it folds to any smaller one."""
    bits = np.zeros(max(64, 1 << (BITS_EACH * len(x) - 1).bit_length()), np.uint8)
    bits[(x >> np.uint64(20)).astype(np.int64) & (len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _may_link(na: int, nb: int, a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sets of these sizes and signatures (arrays of 64-bit words) can be linked."""
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    both = a & b
    bound = min(na - int(np.bitwise_count(a ^ both).sum()), nb - int(np.bitwise_count(b ^ both).sum()))
    return (num + den) * bound >= num * (na + nb)


def _by_digest(digests: np.ndarray, nodes: np.ndarray):
    """Distinct (digest, node) in order, each one's first place in its digest and the digest's number of nodes."""
    order = np.lexsort((nodes, digests))
    d, n = digests[order], nodes[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (n[1:] != n[:-1])
    d, n = d[new], n[new]
    first = np.ones(len(d), bool)
    first[1:] = d[1:] != d[:-1]
    start = np.nonzero(first)[0]
    size = np.diff(np.append(start, len(d)))
    return d, n, np.repeat(start, size), np.repeat(size, size)


def _distinct(pairs: np.ndarray) -> np.ndarray:
    return np.unique(pairs, axis=0) if len(pairs) else np.zeros((0, 2), np.int64)


def _forest(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of pairs, in order, and the smallest node each is connected to."""
    nodes, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def ranged(digests: np.ndarray, nodes: np.ndarray, ranges: int, begin: int = 0, about: tuple | None = None) -> pd.DataFrame:
    """(digest, node) as a row for each range of digests, numbered from `begin`; of a digest that more than NEAR nodes share the rest becomes pairs that stay together, as a row without digests.

    about: names of the nodes in order, their sizes and their parities, one row a node, which go with a node's name.
    """
    d, n, first, many = _by_digest(digests, nodes)
    nth = np.arange(len(d)) - first
    over = nth > NEAR
    kept = _distinct(np.stack([n[first[over]], n[over]], 1))
    d, n = d[~over], n[~over]
    part = (d >> np.uint64(32)).astype(np.int64) % ranges
    order = np.lexsort((n, part))
    part, n, d = part[order], n[order], d[order].astype(np.uint32)
    cuts = np.searchsorted(part, np.arange(ranges + 1))
    rows = []
    for i in np.nonzero(np.diff(cuts))[0].tolist():
        mine = n[cuts[i] : cuts[i + 1]]
        start = np.nonzero(np.append(True, mine[1:] != mine[:-1]))[0]
        known = [b"", b""]
        if about is not None:
            at = np.searchsorted(about[0], mine[start])
            known = [of[at].tobytes() for of in about[1:]]
        rows.append((begin + i, d[cuts[i] : cuts[i + 1]].tobytes(), mine[start].tobytes(), np.diff(np.append(start, len(mine))).astype(np.uint32).tobytes(), *known))
    if len(kept):
        rows.append((begin + int(kept[0, 0] % ranges), b"", kept.tobytes(), b"", b"", b""))
    return pd.DataFrame(rows, columns=["part", "digests", "nodes", "counts", "sizes", "parities"])


RANGED = "part long, digests binary, nodes binary, counts binary, sizes binary, parities binary"


def _ranges(classes: DataFrame, bands: Bands, least: int) -> dict[int, tuple[int, int]]:
    """For each tile that has sets its first range and the number of its ranges, about `least` ranges or more in all."""
    weight = {}
    for band, rows in classes.groupBy(_band(bands)).agg(F.sum("rows")).collect():
        for tile in range(max(0, band - 1), band + 1):
            # digests of 4 bytes, and what goes with a node's name
            each = bands.parts(tile) - bands.spare(tile) + 5 + bands.parities(tile) / 32
            weight[tile] = weight.get(tile, 0) + rows * each
    one, out, begin = min(RANGE, sum(weight.values()) / least), {}, 0
    for tile in sorted(weight):
        out[tile] = begin, math.ceil(weight[tile] / one)
        begin += out[tile][1]
    return out


def _thinner(words: int, bands: Bands, ranges: dict[int, tuple[int, int]], counts=None):
    """Documents become digests by tile and range, and, as rows without digests, pairs that stay together."""

    def thin(batches):
        shingler = Shingler(words)
        held, names, size = {}, set(), 0

        def flush():
            nonlocal held, names, size
            for tile, rows in held.items():
                rows.sort(key=lambda r: r[0])
                named = np.array([r[0] for r in rows], np.int64)
                about = named, np.array([r[1] for r in rows], np.int64), np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
                yield ranged(np.concatenate([r[3] for r in rows]), np.repeat(named, [len(r[3]) for r in rows]), ranges[tile][1], ranges[tile][0], about)
            held, names, size = {}, set(), 0

        for pdf in batches:
            for x in shingler(pdf["text"].tolist()):
                if not len(x):
                    continue
                node = node_of(x)
                if node in names:
                    continue
                names.add(node)
                d = part_digests(x, bands, counts.value if counts is not None else None)
                band, rest = int(bands.of(len(x))), d
                if band:
                    own = bands.parts(band - 1) - bands.spare(band - 1)
                    held.setdefault(band - 1, []).append((node, len(x), parities(x, bands.parities(band - 1)), d[:own]))
                    rest = d[own:]
                held.setdefault(band, []).append((node, len(x), parities(x, bands.parities(band)), rest))
                size += len(d)
                if size >= THIN:
                    yield from flush()
        yield from flush()

    return thin


def _array(column, i: int, kind) -> np.ndarray:
    """A binary value as numbers, without a copy."""
    found = column[i].as_buffer()
    return np.frombuffer(found, kind) if found is not None and found.size else np.zeros(0, kind)


_KINDS = np.uint32, np.int64, np.uint32, np.int64, np.uint64
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("kept", pa.bool_())])


def _pairs_of(digests: np.ndarray, nodes: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one range: a forest of what stays together, and the pairs of digests that few nodes share."""
    d, n, first, many = _by_digest(digests, nodes)
    large = (many > NEAR) & (first != np.arange(len(d)))
    kept = _distinct(np.concatenate([kept, np.stack([n[first[large]], n[large]], 1)]))
    few = np.nonzero((many > 1) & (many <= NEAR))[0]
    last = first + many
    near = [np.zeros((0, 2), np.int64)]
    for k in range(1, NEAR):
        i = few[few + k < last[few]]
        near.append(np.stack([n[i], n[i + k]], 1))
    near = _distinct(np.concatenate(near))
    if len(kept):
        known, root = _forest(kept)
        kept = np.stack([root, known], 1)[root != known]
        if len(near):
            at = np.minimum(np.searchsorted(known, near), len(known) - 1)
            together = (known[at] == near).all(1) & (root[at[:, 0]] == root[at[:, 1]])
            near = near[~together]
    return kept, near


def _unsaid(pairs: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that are not in told, and told with them; beyond SLICE it begins anew, which costs repeated rows."""
    if not len(pairs):
        return pairs, told
    both, first = np.unique(np.concatenate([told, pairs]), axis=0, return_index=True)
    return both[first >= len(told)], both if len(both) <= SLICE else both[:0]


class Known:
    """Sizes and parities of the nodes of one range, by name."""

    def __init__(self, nodes: np.ndarray, sizes: np.ndarray, maps: np.ndarray):
        self.names, first, at = np.unique(nodes, return_index=True, return_inverse=True)
        self.sizes, self.maps = sizes[first], maps[first]
        # sets that share a name are never parted from others
        self.several = np.zeros(len(first), bool)
        self.several[at[(sizes != self.sizes[at]) | (maps != self.maps[at]).any(1)]] = True

    def may_link(self, pairs: np.ndarray, num: int, den: int) -> np.ndarray:
        """The pairs that sizes and parities don't rule out: two sets differ in the difference of their sizes, and in an element for each parity that differs."""
        out, each = [pairs[:0]], max(1, _SPREAD // (8 * self.maps.shape[1]))
        for i in range(0, len(pairs), each):
            some = pairs[i : i + each]
            a, b = np.searchsorted(self.names, some).T
            differ = np.maximum(np.bitwise_count(self.maps[a] ^ self.maps[b]).sum(1).astype(np.int64), np.abs(self.sizes[a] - self.sizes[b]))
            out.append(some[((num + den) * differ <= (den - num) * (self.sizes[a] + self.sizes[b])) | self.several[a] | self.several[b]])
        return np.concatenate(out)


def _pairer(batches, num: int = 0, den: int = 1):
    """Rows of one range after another become candidate pairs; where parities came with the nodes, those that may be links at num / den."""

    def out(held):
        none = np.zeros(0, np.int64)
        kept = np.concatenate([none, *(h[1] for h in held if not len(h[0]))]).reshape(-1, 2)
        held = [h for h in held if len(h[0])]
        slices = np.uint64(max(1, -(-sum(len(h[0]) for h in held) // SLICE)))
        known = None
        if held and len(held[0][4]):
            known = Known(*(np.concatenate([h[k] for h in held]) for k in (1, 3)), np.concatenate([h[4].reshape(len(h[1]), -1) for h in held]))
        hung, told = none, none.reshape(-1, 2)
        for i in range(int(slices)):
            digests, nodes = [np.zeros(0, np.uint32)], [none]
            for d, n, c, *_ in held:
                mine = (d * slices) >> np.uint64(32) == i
                digests.append(d[mine])
                nodes.append(np.repeat(n, c)[mine])
            kept, near = _pairs_of(np.concatenate(digests), np.concatenate(nodes), kept)
            if known is not None:
                near = known.may_link(near, num, den)
            # what an earlier slice of the range has said is not said again
            new = kept[~np.isin(kept[:, 1], hung)]
            hung = kept[:, 1]
            near, told = _unsaid(near, told)
            both = np.concatenate([new, near])
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.arange(len(both)) < len(new))], schema=_PAIRS)

    key, held = None, []
    for batch in batches:
        for i, part in enumerate(batch.column(0).to_pylist()):
            if part != key and held:
                yield from out(held)
                held = []
            key = part
            held.append(tuple(_array(batch.column(k), i, kind) for k, kind in enumerate(_KINDS, 1)))
    if held:
        yield from out(held)


def _allowed(num: int, den: int):
    """Rows a, b, n, m, x, y (nodes, sizes, signatures) -> a, b where the signatures allow a link."""

    def check(batches):
        for batch in batches:
            a, b, n, m = (batch.column(i).to_pylist() for i in range(4))
            x, y = batch.column(4), batch.column(5)
            may = [_may_link(n[i], m[i], _array(x, i, np.uint64), _array(y, i, np.uint64), num, den) for i in range(len(a))]
            yield pa.RecordBatch.from_pydict({"a": [i for i, k in zip(a, may) if k], "b": [i for i, k in zip(b, may) if k]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return check


class Tile:
    """Sets of one side of a pair of tiles, with bitmaps."""

    def __init__(self, nodes, arrays, width: int):
        order = np.argsort([len(x) for x in arrays], kind="stable")
        self.nodes, self.arrays = [nodes[i] for i in order], [arrays[i] for i in order]
        self.size = np.array([len(x) for x in self.arrays], np.int64)
        self.maps = np.zeros((len(arrays), width // 64), np.uint64)
        self.count = np.zeros(len(arrays), np.int64)
        each = max(1, _SPREAD // width)
        for a in range(0, len(arrays), each):
            some = self.arrays[a : a + each]
            bits = np.zeros((len(some), width), np.uint8)
            for i, x in enumerate(some):
                bits[i, (x >> np.uint64(20)).astype(np.int64) & (width - 1)] = 1
            self.maps[a : a + each] = np.packbits(bits, axis=1).view(np.uint64)
            self.count[a : a + each] = bits.sum(1)


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int((y[at] == x).sum())


def links_of_tiles(one: Tile, two: Tile | None, num: int, den: int):
    """Pairs of nodes: enough links of one x two (or inside one) to connect what those links connect."""
    same = two is None
    two = one if same else two
    index = {}
    for n in [*one.nodes, *two.nodes]:
        index.setdefault(n, len(index))
    parent = np.arange(len(index))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    at = np.array([index[n] for n in two.nodes])
    label = np.arange(len(index))
    found = []
    for i, x in enumerate(one.arrays):
        lo = i + 1 if same else int(np.searchsorted(two.size, -(-one.size[i] * num // den)))
        hi = int(np.searchsorted(two.size, one.size[i] * den // num, side="right"))
        if lo >= hi:
            continue
        mine = index[one.nodes[i]]
        both = np.bitwise_count(one.maps[i] & two.maps[lo:hi]).sum(1).astype(np.int64)
        # bits of one side that the other lacks are elements that it lacks
        bound = np.minimum(one.size[i] - (one.count[i] - both), two.size[lo:hi] - (two.count[lo:hi] - both))
        may = (num + den) * bound >= num * (one.size[i] + two.size[lo:hi])
        may &= label[at[lo:hi]] != label[mine]
        todo = lo + np.nonzero(may)[0]
        todo = todo[np.argsort(-bound[todo - lo], kind="stable")]
        while len(todo):
            j = int(todo[0])
            common = _overlap(x, two.arrays[j])
            if den * common >= num * (len(x) + len(two.arrays[j]) - common):
                a, b = label[mine], label[at[j]]
                found.append((one.nodes[i], two.nodes[j]))
                label[label == b] = a
                todo = todo[1:][label[at[todo[1:]]] != a]
            else:
                todo = todo[1:]
    return found


def _decider(num: int, den: int):
    """Rows sorted by pair of tiles become links."""

    def out(held):
        largest = max(len(x) for _, _, x in held)
        width = min(BITS_MOST, max(64, 1 << (BITS_EACH * largest - 1).bit_length()))
        sides = [Tile([n for n, s, _ in held if s == k], [x for _, s, x in held if s == k], width) if any(s == k for _, s, _ in held) else None for k in (0, 1)]
        if sides[0] is None:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        found = links_of_tiles(sides[0], sides[1], num, den) if sides[1] is not None or held[0][1] == 0 else []
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    def decide(batches):
        key, held = None, []
        for batch in batches:
            blobs = batch.column(4)
            for i, (k, alone, node, side) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                if k != key and held:
                    if held_alone or {s for _, s, _ in held} == {0, 1}:
                        yield pa.RecordBatch.from_pandas(out(held), schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]), preserve_index=False)
                    held = []
                key, held_alone = k, alone
                held.append((node, side, _array(blobs, i, np.uint64)))
        if held and (held_alone or {s for _, s, _ in held} == {0, 1}):
            yield pa.RecordBatch.from_pandas(out(held), schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]), preserve_index=False)

    return decide


class Signs:
    """Sets of one side of a pair of tiles by size and signature alone, in order of size and so of width."""

    def __init__(self, rows):
        rows = sorted(rows, key=lambda r: r[1])
        self.nodes, self.size = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)
        maps = [_folded(r[2], BITS_MOST // 64) for r in rows]
        self.width = np.array([len(m) for m in maps])
        self.maps = {int(w): np.stack([m for m in maps if len(m) == w]) for w in np.unique(self.width)}
        self.first = {w: int(np.searchsorted(self.width, w)) for w in self.maps}
        self.fold = {}

    def at(self, own: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The signatures of width `own`, folded to `width`, and their bits."""
        if (own, width) not in self.fold:
            m = _folded(self.maps[own], width)
            self.fold[own, width] = m, np.bitwise_count(m).sum(1).astype(np.int64)
        return self.fold[own, width]


def _folded(m: np.ndarray, width: int) -> np.ndarray:
    while m.shape[-1] > width:
        half = m.shape[-1] // 2
        m = m[..., :half] | m[..., half:]
    return m


def sifted(one: Signs, two: Signs | None, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of nodes that connect what pairs connect whose sizes and signatures allow a link: a forest."""
    same = two is None
    two = one if same else two
    index = {}
    for n in [*one.nodes, *two.nodes]:
        index.setdefault(n, len(index))
    names, label, found = list(index), np.arange(len(index)), []
    at = np.array([index[n] for n in two.nodes])
    for i, mine in enumerate(one.nodes):
        n, own = int(one.size[i]), int(one.width[i])
        lo = i + 1 if same else int(np.searchsorted(two.size, -(-n * num // den)))
        hi = int(np.searchsorted(two.size, n * den // num, side="right"))
        for width, first in two.first.items():
            a, b = max(lo, first), min(hi, first + len(two.maps[width]))
            if a >= b:
                continue
            x, bits = one.at(own, min(own, width)), two.at(width, min(own, width))
            x, count = x[0][i - one.first[own]], x[1][i - one.first[own]]
            both = np.bitwise_count(x & bits[0][a - first : b - first]).sum(1).astype(np.int64)
            bound = np.minimum(n - (count - both), two.size[a:b] - (bits[1][a - first : b - first] - both))
            may = (num + den) * bound >= num * (n + two.size[a:b])
            for j in np.unique(label[at[a:b][may]]).tolist():
                if j != label[index[mine]]:
                    found.append((mine, names[j]))
                    label[label == j] = label[index[mine]]
    return found


def _sifter(num: int, den: int):
    """Rows k, alone, whole, side, node, n, bits sorted by k (pair of tiles) become pairs; of whole groups (node, root) for all that have a pair."""

    def out(held, alone, whole):
        sides = [[r[1:] for r in held if r[0] == s] for s in (0, 1)]
        if not sides[0] or not (alone or sides[1]):
            return []
        pairs = sifted(Signs(sides[0]), Signs(sides[1]) if sides[1] else None, num, den)
        if not whole or not pairs:
            return pairs
        nodes, roots = _forest(np.array(pairs, np.int64))
        return list(zip(nodes.tolist(), roots.tolist()))

    def batch_of(held, key):
        found = out(held, key[1], key[2])
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64()), pa.array([key[2]] * len(found), pa.bool_())], names=["a", "b", "whole"])

    def sift(batches):
        key, held = None, []
        for batch in batches:
            k, alone, whole, side, node, n = (batch.column(c).to_pylist() for c in range(6))
            for i in range(len(k)):
                if held and k[i] != key[0]:
                    yield batch_of(held, key)
                    held = []
                key = k[i], alone[i], whole[i]
                held.append((side[i], node[i], n[i], _array(batch.column(6), i, np.uint64)))
        if held:
            yield batch_of(held, key)

    return sift


_SIZED = "doc_id long, n long, node long, content binary, bits binary, row int, places binary, counts binary"


def _sizer(words: int, bands: Bands):
    """Size, node, 128-bit digest and signature of each document's set; at the end of a task, rows of its counts of part digests."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in _SIZED.split(", "))])

    def rows_of(**columns):
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_pydict({f.name: columns.get(f.name, [None] * n) for f in schema}, schema=schema)

    def size(batches):
        shingler = Shingler(words)
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            sizes, nodes, contents, bits = [], [], [], []
            for x in shingler(batch.column("text").to_pylist()):
                sizes.append(len(x))
                nodes.append(node_of(x) if len(x) else None)
                contents.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                bits.append(signature(x) if len(x) else None)
                for d, _ in _tile_digests(x, bands) if len(x) else ():
                    np.add.at(counts, _counter(d), np.uint32(1))
            yield rows_of(doc_id=batch.column("doc_id"), n=sizes, node=nodes, content=contents, bits=bits)
        for row, part in enumerate(counts.reshape(-1, SKETCH_ROW)):
            at = np.nonzero(part)[0]
            if len(at):
                yield rows_of(row=[row], places=[at.astype(np.uint16).tobytes()], counts=[part[at].tobytes()])

    return size


def _summer(batches):
    """Rows sorted by `row` become one row of sums each."""
    key, sums = None, np.zeros(SKETCH_ROW, np.int64)
    done = lambda: pd.DataFrame({"row": [key], "sums": [np.minimum(sums, 0xFFFFFFFF).astype(np.uint32).tobytes()]})
    for pdf in batches:
        for row, at, n in zip(pdf["row"].tolist(), pdf["places"].tolist(), pdf["counts"].tolist()):
            if row != key:
                if key is not None:
                    yield done()
                key, sums = row, np.zeros(SKETCH_ROW, np.int64)
            sums[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
    if key is not None:
        yield done()


def _digest_counts(sized: DataFrame) -> np.ndarray:
    """The counters over all documents: 2^SKETCH_BITS numbers, however many documents there are."""
    rows = sized.filter("row IS NOT NULL").select("row", "places", "counts").repartition("row").sortWithinPartitions("row")
    out = np.zeros((1 << SKETCH_BITS) // SKETCH_ROW * SKETCH_ROW, np.uint32).reshape(-1, SKETCH_ROW)
    for r in rows.mapInPandas(_summer, "row int, sums binary").collect():
        out[r["row"]] = np.frombuffer(r["sums"], np.uint32)
    return out.ravel()


def jaccard_components(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text); sets are linked at num / den or more."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wide = Bands(num, den, 1 << 40)
    sized = cut(docs.mapInArrow(_sizer(words, wide), _SIZED))

    def candidates(usable, classes, total):
        counts = spark.sparkContext.broadcast(_digest_counts(sized))
        ranges = _ranges(classes, wide, spark.sparkContext.defaultParallelism)
        return paired(usable.mapInPandas(_thinner(words, wide, ranges, counts), RANGED), sum(n for _, n in ranges.values()), num, den)

    return linked(docs, sized.filter("row IS NULL"), words, num, den, candidates)


def paired(digests: DataFrame, ranges: int, num: int = 0, den: int = 1) -> DataFrame:
    """Rows of ranged() as candidate pairs a, b; `kept` ones are as good as links of their group, the others are looked at one by one."""

    def pair(batches):
        return _pairer(batches, num, den)

    return digests.repartition(ranges, "part").sortWithinPartitions("part").mapInArrow(pair, "a long, b long, kept boolean")


def linked(docs: DataFrame, sized: DataFrame, words: int, num: int, den: int, candidates, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id of docs by exact links among candidate pairs and whatever they connect.

    sized: doc_id, n, node, content, bits of each row's set, and columns `more` that are one for equal sets.
    candidates(usable docs, classes, elements in all) gives pairs of nodes, as paired() does.
    """
    slim = sized.select("doc_id", "n", "content")
    known = sized.filter("doc_id IS NOT NULL AND n > 0")
    total, largest, rows = known.agg(F.sum("n"), F.max("n"), F.count("*")).first()
    if total is None:
        return slim.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    # A class: all rows with one set, by its smallest document.
    classes = cut(known.groupBy("node", "content").agg(F.min("doc_id").alias("head"), *(F.first(c).alias(c) for c in ("n", "bits", *more)), F.count("*").alias("rows")))
    bands = Bands(num, den, largest)
    usable = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    pairs = cut(candidates(usable, classes, total))
    side = lambda node, n, bits: classes.select(F.col("node").alias(node), F.col("n").alias(n), F.col("bits").alias(bits))
    near = pairs.filter("NOT kept").select("a", "b").distinct().join(side("a", "na", "xa"), "a").join(side("b", "nb", "xb"), "b")
    near = near.filter(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).select("a", "b", "na", "nb", "xa", "xb")
    edges = cut(pairs.filter("kept").select("a", "b").unionByName(near.mapInArrow(_allowed(num, den), "a long, b long")))
    drop_cut(pairs)
    groups = components(edges) if not edges.isEmpty() else None
    if groups is not None:
        groups = _narrowed(classes, groups, num, den, bands)
    links = None
    if groups is not None:
        links = cut(_links(usable, classes, groups, words, num, den, bands))
        drop_cut(groups)
    drop_cut(edges)
    heads = classes.select("content", "head", "rows")
    # Rows of one doc_id may have several sets: their classes hang together.
    twice = known.groupBy("doc_id").agg(F.min("content").alias("x"), F.max("content").alias("y")).filter("x <> y").select("doc_id")
    more = known.select("doc_id", "content").join(twice, "doc_id", "left_semi").join(heads, "content").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    roots = components(more if links is None else links.unionByName(more)).withColumnRenamed("node", "head")
    if links is not None:
        drop_cut(links)
    # No document is in two classes unless it hangs them together, so the head's root is each row's.
    heads = heads.join(roots, "head", "left").select("content", F.coalesce("root", "head").alias("root"), "rows")
    out = join_class(slim, heads, "content", "rows", rows)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def _narrowed(classes: DataFrame, groups: DataFrame, num: int, den: int, bands: Bands) -> DataFrame | None:
    """groups (node, root) without what no signature links: sets, which are many times as large, are handed on only for the rest."""
    member = groups.select("node", F.col("root").alias("grp")).join(classes.groupBy("node").agg(F.max("n").alias("n")), "node")
    places = _laid_out(member.select(F.col("node").alias("id"), "grp", "n"), bands)
    rows = places.withColumnRenamed("id", "node").join(classes.select("node", "n", "bits"), "node").select("k", "alone", "whole", "side", "node", "n", "bits")
    found = cut(rows.repartition("k").sortWithinPartitions("k").mapInArrow(_sifter(num, den), "a long, b long, whole boolean"))
    drop_cut(groups)
    drop_cut(places)
    near = found.filter("whole").select(F.col("a").alias("node"), F.col("b").alias("root"))
    parts = found.filter("NOT whole").select("a", "b")
    if not parts.isEmpty():
        near = near.unionByName(components(parts))
    return None if near.isEmpty() else cut(near)


def _band(bands: Bands):
    """The band of size n."""
    return F.expr(f"size(filter(array({', '.join(f'{x}L' for x in bands.low)}), x -> x <= n)) - 1")


def _laid_out(member: DataFrame, bands: Bands) -> DataFrame:
    """member: id, grp, n -> id, k, grp, side, alone, whole: where each meets others, by group or by pair of tiles of a large group."""
    member = cut(member.withColumn("band", _band(bands)))
    shape = member.groupBy("grp", "band").agg(F.sum("n").alias("n"))
    whole = shape.groupBy("grp").agg(F.sum("n").alias("all"))
    shape = cut(shape.join(whole, "grp").withColumn("tiles", F.when(F.col("all") <= TILE, 0).otherwise(F.ceil(F.col("n") / TILE).cast("int"))).select("grp", "band", "tiles"))
    small = member.join(shape.filter("tiles = 0").select("grp").distinct(), "grp", "left_semi")
    small = small.select("id", F.xxhash64("grp").alias("k"), F.col("grp"), F.lit(0).alias("side"), F.lit(True).alias("alone"), F.lit(True).alias("whole"))
    # Large groups: tile (band, salt) meets itself, the others of its band, and those of the next band.
    large = member.join(shape.filter("tiles > 0"), ["grp", "band"]).withColumn("salt", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("tiles")).cast("int"))
    beyond = shape.filter("tiles > 0").select("grp", (F.col("band") - 1).alias("band"), F.col("tiles").alias("next"))
    before = shape.filter("tiles > 0").select("grp", (F.col("band") + 1).alias("band"), F.col("tiles").alias("prev"))
    large = large.join(beyond, ["grp", "band"], "left").join(before, ["grp", "band"], "left")
    meet = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda lo, a, b, side: F.struct(lo.cast("long").alias("lo"), a.cast("int").alias("x"), b.cast("int").alias("y"), F.lit(side).alias("side"))
    own = F.transform(meet(F.col("tiles")), lambda t: F.struct((F.col("band") * 2).cast("long").alias("lo"), F.least("salt", t).alias("x"), F.greatest("salt", t).alias("y"), F.when(F.col("salt") <= t, 0).otherwise(1).alias("side")))
    up = F.transform(meet(F.col("next")), lambda t: pair(F.col("band") * 2 + 1, F.col("salt"), t, 0))
    down = F.transform(meet(F.col("prev")), lambda t: pair(F.col("band") * 2 - 1, t, F.col("salt"), 1))
    large = large.withColumn("p", F.explode(F.concat(own, up, down)))
    alone = (F.col("p.lo") % 2 == 0) & (F.col("p.x") == F.col("p.y"))
    large = large.select("id", F.xxhash64("grp", "p.lo", "p.x", "p.y").alias("k"), "grp", F.col("p.side").alias("side"), alone.alias("alone"), F.lit(False).alias("whole"))
    places = cut(small.unionByName(large))
    drop_cut(member)
    return places


def _links(docs: DataFrame, classes: DataFrame, groups: DataFrame, words: int, num: int, den: int, bands: Bands) -> DataFrame:
    # Of equal sets the smallest document stands for the others.
    member = groups.select("node", F.col("root").alias("grp")).join(classes.select("node", F.col("head").alias("doc_id"), "n"), "node")
    places = _laid_out(member.groupBy(F.col("doc_id").alias("id"), "grp").agg(F.max("n").alias("n")), bands).withColumnRenamed("id", "doc_id")
    # Only documents in groups are read again; their list goes to all machines if it is known to be short.
    few = places.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    ids = F.broadcast(places) if few else places
    held = docs.join(ids, "doc_id")

    def shingled(batches):
        shingler, names = Shingler(words), ["k", "alone", "doc_id", "side"]
        for pdf in batches:
            first, blobs, size = 0, [], 0
            for i, x in enumerate(shingler(pdf["text"].tolist())):
                blobs.append(x.tobytes())
                size += len(blobs[-1])
                if size >= _HANDED or i == len(pdf) - 1:
                    part = pdf[names].iloc[first : i + 1].assign(blob=blobs)
                    yield part[part["blob"].str.len() > 0]
                    first, blobs, size = i + 1, [], 0

    rows = held.mapInPandas(shingled, "k long, alone boolean, doc_id long, side int, blob binary")
    return rows.repartition("k").sortWithinPartitions("k").mapInArrow(_decider(num, den), "a long, b long")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 9, 10)


def one_of_each(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs without those that have a component with a smaller doc_id: one document of each group stays. Rows without doc_id stay."""
    labels = jaccard_components(docs.select("doc_id", "text"), words, num, den)
    gone = labels.filter("component_id < doc_id").select("doc_id").distinct()
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
