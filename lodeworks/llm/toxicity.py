"""Toxicity by a noisy channel: obfuscated words are restored before the text is scored.

Restoring. A word's characters span a lattice: a symbol such as 0, 3, @ or $ may be itself or a letter
it stands for; a letter twice or more in a row may be the run or any fewer; single letters in a row (`i d i o t`,
`i.d.i.o.t`, or with several blanks between) may be one word or several, as a word may end after each. Viterbi finds the path with the highest
probability under a character trigram model times the channel's cost for each substitution; a spaced run is also
cut into the likeliest learned words. Parts without stand-ins and double letters have one path and are left as they
are, and so are words that MIN_CLEAN clean training texts hold; all others are decoded. Training texts are restored
in the same way, by the model of their plain words.

Scoring. Evidence units of the restored words are whole words and their first 4 to 6 letters. From the
labelled training texts each unit gets the log odds of toxic against clean documents, where copies of one toxic text
weigh little more than one; units whose lean chance could explain, given how many units there are, are dropped, and
so are beginnings that most words have in clean texts. A document's evidence is the
sum of its strongest three units' log odds (prefixes of one word count once), and a logistic curve
fitted on the training texts makes it a probability.

Training counts every labelled row outside the held-out fold, as Spark aggregations; only the model goes through
the driver: trigrams, words that a fixed share of all texts hold, units that pass, and evidence by thousandths.
fit() is the same by plain Python, for tests. Defined results: null and empty texts score as a text without evidence; repeated
rows repeat results; without any labelled toxic row every score is 0; of paths of equal probability the
first found counts; words of any length are decoded; a null doc_id isn't held out; an empty table gives an
empty one; columns of docs beyond text and doc_id aren't read by the query, and pass drop_toxic unchanged.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, drop_cut, table
from .graph import components

#: Labels up to which they are sent to every machine; counters that a task holds.
BROADCAST_ROWS, HELD = 1_000_000, 200_000
#: What a symbol may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou",
}
#: Log cost of a substitution, of dropping a repeated letter, of joining spaced letters.
COST_SWAP, COST_REPEAT, COST_JOIN = -0.7, -0.3, -0.5
MIN_TOXIC, MIN_ODDS, CHANCE, STRONGEST = 2, 2.5, 1.0, 3
#: Clean training texts that make a word part of the vocabulary, which is never decoded.
MIN_CLEAN = 3
#: Of more texts, one in so many must hold a word that is learned as clean, and one that runs are cut into.
CLEAN_SHARE, WORD_SHARE = 2_000, 6_000
#: One in so many clean texts is counted before all are.
FIRST = 8
#: Longer parts are decoded like all others, but not kept for the next time.
MEMO = 64
_LETTER = r"[^\W\d_]"
_TOKEN = re.compile(r"\S+")
_WORD = re.compile(rf"{_LETTER}+")
_SIGN = "[" + re.escape("".join(LEET)) + "]"
#: What the lattice decodes: letters and their stand-ins in a row.
_PART = re.compile(rf"(?:{_LETTER}+|{_SIGN}+)+")
#: Without a stand-in or a letter twice in a row a part has one path, itself.
_OPEN = re.compile(rf"{_SIGN}|({_LETTER})\1")
_EDGE = "!(|+*"
#: Letters or their stand-ins one by one, with the same spaces or signs between.
_SPACED = re.compile(rf"(?<![\w@$])(?:{_LETTER}|{_SIGN})(?:([\s.\-_*]+)(?:{_LETTER}|{_SIGN})(?:\1(?:{_LETTER}|{_SIGN}))*)(?![\w@$])")
#: Without this a text has no such row.
_RUN = re.compile(rf"[\s.\-_*](?<=(?:{_LETTER}|{_SIGN}).)(?<![\w@$]..)[\s.\-_*]*(?:{_LETTER}|{_SIGN})(?:[\s.\-_*]|(?![\w@$]))", re.S)
_CHEAP = re.compile(rf"{_SIGN}|({_LETTER})\1|{_RUN.pattern}", re.S)


def trigrams(words) -> Counter:
    found = Counter()
    for w, n in words.items():
        w = f"^^{w}$"
        for i in range(2, len(w)):
            found[w[i - 2 : i + 1]] += n
    return found


class CharModel:
    """Character trigrams with add-k smoothing backed by bigrams; words are bounded by ^ and $."""

    def __init__(self, words: Counter, tri: Counter | None = None, total: int | None = None, least: int = 1):
        """words: how often each is seen; with the trigrams and the total of all words, those beyond `least` are enough."""
        self.tri, self.bi = trigrams(words) if tri is None else tri, Counter()
        for t, n in self.tri.items():
            self.bi[t[:2]] += n
        self.v = len(set().union(*self.tri)) + 1
        # What a spaced run is cut into: words seen once are chance finds for the most part.
        self.words = {w: n for w, n in words.items() if n > least}
        self.total = (sum(words.values()) if total is None else total) + 1
        self.lengths = sorted(set(map(len, self.words)))
        self.common: set[str] = set()
        self.logs: dict[tuple[str, str], float] = {}

    def log(self, before: str, c: str) -> float:
        found = self.logs.get((before, c))
        if found is None:
            if len(self.logs) >= 100_000:
                self.logs.clear()
            found = self.logs[before, c] = math.log((self.tri.get(before + c, 0) + 0.05) / (self.bi.get(before, 0) + 0.05 * self.v))
        return found

    def cut(self, letters: str) -> list[str]:
        """Letters in a row cut into the likeliest learned words; an unknown letter stands alone at a high price."""
        best = [(0.0, 0)]
        for end in range(1, len(letters) + 1):
            found = [(best[end - 1][0] - math.log(self.total) - 8, end - 1)]
            for size in self.lengths:
                start = end - size
                if start < 0:
                    break
                n = self.words.get(letters[start:end])
                if n:
                    found.append((best[start][0] + math.log(n / self.total), start))
            best.append(max(found))
        out, end = [], len(letters)
        while end:
            out.append(letters[best[end][1] : end])
            end = best[end][1]
        return out


def viterbi(token: str, model: CharModel, spaced: bool = False) -> str:
    """The likeliest letters behind a token. States are the last two letters; each position is one run of a character.

    In a spaced run every character is its own position, and a word may end at each: the result has spaces there.
    """
    runs = [(c, 1) for c in token] if spaced else [(c, len(list(g))) for c, g in groupby(token)]
    best = {"^^": (0.0, None)}  # state -> probability, (letters, what went before)
    for c, n in runs:
        choices = []
        letters = [(c, 0.0)] if c.isalpha() else []
        letters += [(x, COST_SWAP) for x in LEET.get(c, "")]
        if not letters:
            letters = [("", COST_JOIN)]
        for x, cost in letters:
            # the second repeat on costs the same each time, so of all lengths 1, 2 and n are enough
            for m in {1, min(n, 2), n}:
                choices.append((x * m, cost * m + COST_REPEAT * (n - m)))
        if not c.isalpha():
            choices.append(("", 4 * COST_SWAP * n))
        new: dict[str, tuple] = {}
        for state, (p, out) in best.items():
            for x, cost in choices:
                s, q = state, p + cost
                for y in x[:2]:
                    q += model.log(s, y)
                    s = s[1] + y
                if len(x) > 2:
                    q += (len(x) - 2) * model.log(s, x[0])
                if s not in new or q > new[s][0]:
                    new[s] = (q, (x, out))
        if spaced:
            ends = [(q + model.log(s, "$"), out) for s, (q, out) in new.items() if s != "^^"]
            if ends:
                q, out = max(ends, key=lambda x: x[0])
                if "^^" not in new or q > new["^^"][0]:
                    new["^^"] = (q, (" ", out))
        best = new
    back = max(((p + (0 if spaced and s == "^^" else model.log(s, "$")), out) for s, (p, out) in best.items()), key=lambda x: x[0], default=(0, None))[1]
    found = []
    while back:
        found.append(back[0])
        back = back[1]
    return "".join(reversed(found))


class Reach:
    """Whether a part's restored words can begin as one of the given units does, by all paths of the lattice at once.

    A path writes at least one letter for each run of a letter and perhaps none for other signs, so the beginnings
    that are open after each character are known without any model; where none is left, nothing has to be decoded.
    """

    def __init__(self, only: set[str]):
        self.heads = heads(only)
        self.open = {h[:n] for h in self.heads for n in range(len(h))}
        # What a text is searched for: parts whose first letters allow it. Beyond Latin, letters may count as signs here.
        signs, second = re.escape("".join(LEET)) + "\x80-\xbfɐ-\U0010ffff", {}
        for h in self.heads:
            second.setdefault(h[0], set()).add(h[1:2])
        ways = [f"(?<=[{signs}])"]
        for c, after in sorted(second.items()):
            c = re.escape(c)
            ways.append(f"(?<={c})" if "" in after else f"(?<={c}){c}*[{signs}{re.escape(''.join(sorted(after)))}]")
        either = f"(?:{_LETTER}|{_SIGN})"
        self.parts = re.compile(f"[{signs}{re.escape(''.join(sorted(second)))}](?<!{either}.)(?<={either})(?:{'|'.join(ways)})(?:{_LETTER}+|{_SIGN}+)*", re.S)


    def __call__(self, token: str, anywhere: bool = False) -> bool:
        """anywhere: a word may begin at each character."""
        at, before = {""}, None
        for c in token:
            letter = c.isalpha()
            new = set() if letter and c != before else set(at)
            for x in (*(c if letter else ""), *LEET.get(c, "")):
                for s in at:
                    s += x
                    if s in self.heads:
                        return True
                    if s in self.open:
                        new.add(s)
            if anywhere:
                new.add("")
            if not new:
                return False
            at, before = new, c
        return False


class Restorer:
    """only: units that are asked for; words without any of them are left out, and what can't become one with them isn't decoded."""

    def __init__(self, model: CharModel, keep: int = 40_000, only: set[str] | None = None):
        self.model, self.keep, self.known = model, keep, {}
        self.only, self.reach = only, None if only is None else Reach(only)

    def _one(self, token: str) -> str:
        if len(token) > MEMO:
            return viterbi(token, self.model)
        if token not in self.known:
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[token] = viterbi(token, self.model)
        return self.known[token]

    def _run(self, token: str) -> set[str]:
        """The words of a spaced run: by the lattice, and by the vocabulary over the letters it gives."""
        words = viterbi(token, self.model, spaced=True).split()
        return {*words, *self.model.cut("".join(words)), self._one(token)}

    def _read(self, parts) -> set[str]:
        """The words of parts. Signs at a part's ends may be letters or not: both readings count."""
        out, plain, reach = set(), [], self.reach
        for t in parts:
            if t in self.model.common or not _OPEN.search(t):
                plain.append(t)
                continue
            if reach is None or reach(t):
                out.add(self._one(t))
            bare = t.strip(_EDGE)
            if bare != t:
                if bare in self.model.common or not _OPEN.search(bare):
                    plain.append(bare)
                elif reach is None or reach(bare):
                    out.add(self._one(bare))
        out.update(plain)  # letters alone
        return out

    def _asked(self, words: set[str]) -> set[str]:
        first, only = self.reach.heads, self.only
        return {w for w in words if w[:4] in first and not only.isdisjoint(units((w,)))}

    def words(self, text: str) -> set[str]:
        """The words of the restored text."""
        out = set()
        for m in _SPACED.finditer(text) if _RUN.search(text) else ():
            token = "".join(m.group(0).split(m.group(1)))
            if self.reach is None:
                out |= self._run(token)
            elif self.reach(token, anywhere=True):
                out |= self._asked(self._run(token))
        if self.reach is None:
            return out | self._read(set(_PART.findall(text)))
        return out | self._asked(self._read(set(self.reach.parts.findall(text))))


def words_of(text: str, restorer: Restorer | None) -> set[str]:
    low = text.lower()
    if restorer is not None and (restorer.only is not None or _CHEAP.search(low)):
        return restorer.words(low)
    return set(_WORD.findall(low))


def units(words) -> set[str]:
    out = set()
    for w in words:
        out.add(w)
        out.update("^" + w[:n] for n in (4, 5, 6) if len(w) > n)
    return out


def heads(found) -> set[str]:
    """The first four letters of units: a word that begins otherwise has none of them."""
    return {u[1:5] if u.startswith("^") else u[:4] for u in found}


def band_keys(words: set[str], bands: int = 8) -> list[str]:
    """MinHash keys of a set that isn't empty, of two minima each."""
    factors = np.random.default_rng(7).integers(0, 2**64, 2 * bands, np.uint64) | np.uint64(1)
    h = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)
    low = np.array([(h * f).min() for f in factors]).reshape(bands, 2)
    return [f"{b} {x} {y}" for b, (x, y) in enumerate(low.tolist())]


def copies(sets: list[set[str]], bands: int = 8, least: float = 0.5) -> list[int]:
    """A group for each set of words: sets that are alike at `least` or more hang together. Candidates by MinHash in bands of two."""
    group, seen = list(range(len(sets))), {}

    def find(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i, words in enumerate(sets):
        if not words:
            continue
        for key in band_keys(words, bands):
            other = seen.setdefault(key, i)
            if find(other) != find(i) and len(words & sets[other]) >= least * len(words | sets[other]):
                group[max(find(i), find(other))] = min(find(i), find(other))
    return [find(i) for i in range(len(sets))]


class ToxicModel:
    def __init__(self, odds: dict[str, float], chars: CharModel, slope: float, offset: float):
        self.odds, self.chars, self.slope, self.offset = odds, chars, slope, offset
        self.restorer, self.heads = None, heads(odds)

    def evidence(self, words) -> float:
        odds, first, each = self.odds, self.heads, []
        for w in words:
            if w[:4] not in first:
                continue
            o = max(odds.get(w, 0.0), odds.get("^" + w[:4], 0.0), odds.get("^" + w[:5], 0.0), odds.get("^" + w[:6], 0.0))
            if o:
                each.append(o)
        return sum(sorted(each)[-STRONGEST:])

    def score(self, text: str | None) -> float:
        if self.restorer is None:
            self.restorer = Restorer(self.chars, only=self.odds.keys())
        x = self.evidence(words_of(text or "", self.restorer))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * x + self.offset))))


def curve(model: ToxicModel, x: np.ndarray, y: np.ndarray, times: np.ndarray) -> None:
    """The logistic curve of labels y over evidence x, each seen so many times, by Newton steps with a small ridge; both classes weigh the same."""
    each = times * np.where(y == 1, max(1, times[y == 0].sum()) / max(1, times[y == 1].sum()), 1.0)
    a, b = 0.5, -2.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(each * (p - y) * x).sum() + 0.1 * a, (each * (p - y)).sum() + 0.1 * b])
        w = each * p * (1 - p) + times * 1e-9
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -1, 1)
    model.slope, model.offset = float(a), float(b)


def fit(texts: list[str], labels: list[int]) -> ToxicModel:
    y = np.array(labels)
    seen, toxic = Counter(), Counter()
    for t, label in zip(texts, labels):
        (toxic if label else seen).update(words_of(t or "", None))
    words = Counter(seen)
    for w, n in toxic.items():
        words[w] += 2 * n  # toxic words are rare; the channel should still find them likely
    chars = CharModel(words)
    chars.common = {w for w, n in seen.items() if n >= MIN_CLEAN}  # few texts: no share
    del words, seen, toxic
    restorer = Restorer(chars)
    same: dict[str, str] = {}  # one object for each word, however many texts hold it
    plain = [tuple(same.setdefault(w, w) for w in words_of(t or "", restorer)) for t in texts]
    del same, restorer
    chars.logs = {}
    # Copies of one toxic text count once, and once more for each fourfold of them: else each chance word of a
    # text with many copies would seem toxic.
    marked = [set(found) for found, label in zip(plain, labels) if label]
    groups = copies(marked)
    weight = {g: 1 + math.log(n, 4) for g, n in Counter(groups).items()}
    findings: dict[int, set[str]] = {g: set() for g in weight}
    for words, g in zip(marked, groups):
        findings[g].update(words)
    toxic, clean, once = Counter(), Counter(), {}  # once: whether a single text and its copies hold a unit
    n1, n0 = max(1, sum(weight.values())), max(1, int((y == 0).sum()))
    for g, words in findings.items():
        for u in units(words):
            toxic[u] += weight[g]
            once[u] = u not in once
    # The evidence that a unit leans to toxic texts (a Poisson log likelihood ratio) must exceed what
    # the best of so many units would reach by chance.
    tried = {u: n for u, n in toxic.items() if n >= MIN_TOXIC}
    bearers: dict[str, list[int]] = {u: [0, 0] for u in tried if u.startswith("^")}  # words that begin so: of toxic texts alone, of clean ones
    innocent = set()
    for found, label in zip(plain, labels):
        if not label:
            clean.update(units(found) & tried.keys())
            innocent.update(found)
    for words, counted in ((set().union(*findings.values()) - innocent, 0), (innocent, 1)):
        for w in words:
            for u in {"^" + w[:n] for n in (4, 5, 6) if len(w) > n} & bearers.keys():
                bearers[u][counted] += 1
    del innocent, marked, findings
    least = math.log(len(tried) + 1) + CHANCE
    odds = {}
    for u, n in tried.items():
        o = math.log((n + 0.1) / (n1 + 0.2)) - math.log((clean.get(u, 0) + 0.1) / (n0 + 0.2))
        expected = (n + clean.get(u, 0)) * n1 / (n0 + n1)
        gain = n * math.log(n / expected) - (n - expected) if n > expected else 0
        # a beginning counts only if most words that have it are toxic ones
        bar = math.log(len(toxic) + 1) + CHANCE if once[u] else least
        if o >= MIN_ODDS and gain >= bar and (u not in bearers or bearers[u][0] > bearers[u][1]):
            odds[u] = min(o, 8.0)
    chars.logs = {}
    model = ToxicModel(odds, chars, 1.0, -4.0)
    if not (y == 1).any():
        model.slope, model.offset = 0.0, -30.0
        return model
    x = np.array([model.evidence(w) for w in plain])
    curve(model, x, y, np.ones(len(y)))
    return model


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _tally(counters: list[Counter], names: list[str]) -> pd.DataFrame:
    keys = list(set().union(*counters))
    return pd.DataFrame({names[0]: pd.Series(keys, dtype=object)} | {name: [c[k] for k in keys] for name, c in zip(names[1:], counters)})


def _seen(batches):
    """Rows text, toxic -> word and how many clean and toxic texts have it, and how many clean ones as a part of letters alone."""
    names = ["word", "clean", "toxic", "plain"]
    clean, toxic, plain = counters = [Counter(), Counter(), Counter()]
    for pdf in batches:
        for text, label in zip(pdf["text"], pdf["toxic"]):
            parts = set(_PART.findall((text or "").lower()))
            words = {p for p in parts if p.isalpha()}
            words.update(_WORD.findall(" ".join(parts - words)))
            (toxic if label else clean).update(words)
            if not label:
                plain.update(parts & words)
            if len(clean) + len(toxic) >= HELD:
                yield _tally(counters, names)
                for c in counters:
                    c.clear()
    yield _tally(counters, names)


def _grams(batches):
    for pdf in batches:
        yield _tally([trigrams(dict(zip(pdf["word"], pdf["n"])))], ["gram", "n"])


def _units(w: Column) -> Column:
    """A word's units, as units() gives them."""
    return F.concat(F.array(w), *(F.when(F.length(w) > n, F.array(F.concat(F.lit("^"), F.substring(w, 1, n)))).otherwise(F.array().cast("array<string>")) for n in (4, 5, 6)))


def _restored(rows: DataFrame, chars: CharModel) -> DataFrame:
    """rows: id, text -> id, words, keys: restored words of each text and their MinHash keys."""
    shared = rows.sparkSession.sparkContext.broadcast(chars)

    def restore(batches):
        restorer = Restorer(shared.value)
        for pdf in batches:
            words = [words_of(t or "", restorer) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "words": [sorted(w) for w in words], "keys": [band_keys(w) if w else [] for w in words]})

    return rows.select("id", "text").mapInPandas(restore, "id long, words array<string>, keys array<string>")


def _bearing(rows: DataFrame, chars: CharModel, only: set[str], counts: bool = False) -> DataFrame:
    """rows: text -> words, unit, word, n. Three kinds of rows: the words of a text that have one of the units `only`, if any;
    a unit and how many texts of a part of the rows have it; a word that a part of the rows has. counts: the second kind alone."""
    shared = rows.sparkSession.sparkContext.broadcast((chars, only))

    def told(held: Counter, seen: set[str]) -> pd.DataFrame:
        u, w = list(held), list(seen)
        n = len(u) + len(w)
        return pd.DataFrame({"words": pd.Series([None] * n, dtype=object), "unit": pd.Series(u + [None] * len(w), dtype=object), "word": pd.Series([None] * len(u) + w, dtype=object), "n": pd.Series([held[x] for x in u] + [0] * len(w), dtype="int64")})

    def bear(batches):
        chars, only = shared.value
        restorer, held, seen = Restorer(chars, only=only), Counter(), set()
        for pdf in batches:
            found = [w for t in pdf["text"] if (w := words_of(t or "", restorer))]
            for words in found:
                held.update(units(words) & only)
                if not counts:
                    seen |= words
            if not counts:
                none = pd.Series([None] * len(found), dtype=object)
                yield pd.DataFrame({"words": pd.Series([sorted(w) for w in found], dtype=object), "unit": none, "word": none, "n": pd.Series([0] * len(found), dtype="int64")})
            if len(held) + len(seen) >= HELD:
                yield told(held, seen)
                held, seen = Counter(), set()
        yield told(held, seen)

    return rows.select("text").mapInPandas(bear, "words array<string>, unit string, word string, n long")


def _groups(texts: DataFrame) -> DataFrame:
    """texts: id, words, keys -> grp, weight, word: copies as in copies(), their weight, their distinct words."""
    own = F.when(F.size("words") == 0, F.col("id").cast("string")).otherwise(F.sha2(F.array_join("words", " "), 256))
    sets = cut(texts.groupBy(own.alias("own")).agg(F.min("id").alias("id"), F.first("words").alias("words"), F.first("keys").alias("keys"), F.count("*").alias("n")))
    keyed = sets.select("id", F.explode("keys").alias("key"))
    pairs = keyed.join(keyed.groupBy("key").agg(F.min("id").alias("head")), "key").filter("id <> head").select("id", "head").distinct()
    pairs = pairs.join(sets.select("id", F.col("words").alias("x")), "id").join(sets.select(F.col("id").alias("head"), F.col("words").alias("y")), "head")
    edges = cut(pairs.filter(F.size(F.array_intersect("x", "y")) >= 0.5 * F.size(F.array_union("x", "y"))).select(F.col("id").alias("a"), F.col("head").alias("b")))
    grouped = sets.withColumn("grp", F.col("id"))
    if not edges.isEmpty():
        grouped = sets.join(components(edges).withColumnRenamed("node", "id"), "id", "left").withColumn("grp", F.coalesce("root", "id"))
    weight = grouped.groupBy("grp").agg((1 + F.log(F.sum("n")) / math.log(4)).alias("weight"))
    return cut(grouped.select("grp", F.explode_outer("words").alias("word")).distinct().join(weight, "grp"))


def _passes(n: Column, clean: Column, once: Column, n1: float, n0: int, bars: tuple[float, float]) -> Column:
    """Whether a unit of so much weight in toxic texts and so many clean ones leans enough to toxic texts, and by more than chance."""
    odds = F.log((n + 0.1) / (n1 + 0.2)) - F.log((clean + 0.1) / (n0 + 0.2))
    expected = (n + clean) * n1 / (n0 + n1)
    gain = F.when(n > expected, n * F.log(n / expected) - (n - expected)).otherwise(0.0)
    return (odds >= MIN_ODDS) & (gain >= F.when(once, bars[1]).otherwise(bars[0]))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> ToxicModel:
    """Fits on all labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    known = known.groupBy("doc_id").agg((F.max("toxic") != 0).alias("toxic"))
    few = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    ids = docs.select("doc_id").join(F.broadcast(known) if few else known, "doc_id")
    n0, found = (ids.agg(F.count_if(~F.col("toxic")), F.count_if("toxic")).first())
    rows = docs.select("doc_id", "text").join(F.broadcast(known) if few else known, "doc_id").select(F.monotonically_increasing_id().alias("id"), "text", "toxic", (F.pmod(F.xxhash64("doc_id"), F.lit(FIRST)) == 0).alias("first"))
    if not found:
        return ToxicModel({}, CharModel(Counter()), 0.0, -30.0)
    # The channel: trigrams of all words; toxic words are rare, it should still find them likely.
    seen = cut(rows.select("text", "toxic").mapInPandas(_seen, "word string, clean long, toxic long, plain long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("clean", "toxic", "plain"))))
    words = seen.select("word", "clean", (F.col("clean") + 2 * F.col("toxic")).alias("n"))
    grams = words.select("word", "n").mapInPandas(_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    least, many = max(MIN_CLEAN, n0 // CLEAN_SHARE), max(1, (n0 + found) // WORD_SHARE)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    chars = CharModel(Counter({r["word"]: r["n"] for r in words.filter(F.col("n") > many).collect()}), Counter({r["gram"]: r["n"] for r in grams.collect()}), total, many)
    double = F.col("word").rlike(r"(.)\1")
    # a word without a letter twice in a row is never decoded, learned or not
    chars.common = {r["word"] for r in words.filter((F.col("clean") >= least) & double).select("word").collect()}
    toxic = cut(_restored(rows.filter("toxic"), chars))
    groups = _groups(toxic)
    n1 = max(1.0, groups.select("grp", "weight").distinct().agg(F.sum("weight")).first()[0])
    n0 = max(1, n0)
    found_units = groups.filter("word IS NOT NULL").select("grp", "weight", F.explode(_units(F.col("word"))).alias("unit")).distinct()
    tally = cut(found_units.groupBy("unit").agg(F.sum("weight").alias("n"), (F.count("*") == 1).alias("once")))
    n_tried, n_units = tally.agg(F.count_if(F.col("n") >= MIN_TOXIC), F.count("*")).first()
    bars = (math.log(n_tried + 1) + CHANCE, math.log(n_units + 1) + CHANCE)
    # Words that stay as they are give each unit a least number of clean texts; what can't pass by that is counted no further.
    sure = seen.filter((F.col("plain") > 0) & (~double | (F.col("clean") >= least)))
    sure = sure.select("plain", F.explode(_units(F.col("word"))).alias("unit")).groupBy("unit").agg(F.max("plain").alias("sure"))
    passes = lambda clean: _passes(F.col("n"), F.coalesce(clean, F.lit(0)), F.col("once"), n1, n0, bars)
    tried = cut(tally.filter(F.col("n") >= MIN_TOXIC).join(sure, "unit", "left").filter(passes(F.col("sure"))).select("unit", "n", "once"))
    # So do the counts of some of the clean texts, restored; all clean texts are then asked for the units that are left.
    some = _bearing(rows.filter("NOT toxic AND first"), chars, {r["unit"] for r in tried.collect()}, counts=True).groupBy("unit").agg(F.sum("n").alias("some"))
    tested, tried = tried, cut(tried.join(some, "unit", "left").filter(passes(F.col("some"))).select("unit", "n", "once"))
    clean = cut(_bearing(rows.filter("NOT toxic"), chars, {r["unit"] for r in tried.collect()}))
    held_units = clean.filter("unit IS NOT NULL").groupBy("unit").agg(F.sum("n").alias("clean"))
    # a beginning counts only if most words that have it are toxic ones
    innocent = cut(clean.filter("word IS NOT NULL").select("word").distinct())
    starts = lambda df: df.select(F.explode(_units(F.col("word"))).alias("unit")).filter(F.col("unit").startswith("^")).groupBy("unit").agg(F.count("*").alias("k"))
    guilty = starts(groups.filter("word IS NOT NULL").select("word").distinct().join(innocent, "word", "left_anti")).withColumnRenamed("k", "guilty")
    left = tried.join(held_units, "unit", "left").join(guilty, "unit", "left").join(starts(innocent).withColumnRenamed("k", "innocent"), "unit", "left")
    left = left.filter(passes(F.col("clean")) & (~F.col("unit").startswith("^") | (F.coalesce("guilty", F.lit(0)) > F.coalesce("innocent", F.lit(0)))))
    odds = {r["unit"]: min(8.0, math.log((r["n"] + 0.1) / (n1 + 0.2)) - math.log(((r["clean"] or 0) + 0.1) / (n0 + 0.2))) for r in left.collect()}
    model = ToxicModel(odds, chars, 1.0, -4.0)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def evidence(words: pd.Series) -> pd.Series:
        return pd.Series([shared.value.evidence(w) for w in words], dtype="float64")

    count = lambda df: {r["x"]: r["count"] for r in df.select(F.round(evidence("words"), 3).alias("x")).groupBy("x").count().collect()}
    marked, other = count(toxic), Counter(count(clean.filter("words IS NOT NULL")))
    other[0.0] += n0 - sum(other.values())
    x, times = np.array([*marked, *other]), np.array([*marked.values(), *other.values()], np.float64)
    curve(model, x, np.repeat([1, 0], [len(marked), len(other)]), times)
    for df in (seen, toxic, groups, tally, tested, tried, clean, innocent):
        drop_cut(df)
    return model


def scorer(model: ToxicModel):
    """A column function: the score of a text."""
    bounded_batches(SparkSession.getActiveSession())
    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t) for t in texts], dtype="float64")

    return score


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    score = scorer(train(docs, labels))
    out = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the model scores at 0.5 or more."""
    return docs.filter(scorer(train(docs, labels))("text") < 0.5)
