"""Traces of scanning in the pages of files, and their repair.

Three learned parts, all fitted here on synthetic damage of all words and compounds of the table that are common enough:

* candidates for misread words come from an inverted join on character q-grams of shape-folded words; gradient-boosted
  trees rank them against the word as it stands;
* a classifier of line pairs decides whether a line's end and the next line (or page) make one word;
* a classifier of line pairs across pages of a source decides what is a running header or a printed page number.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlode.operators.skew import attach_groups
from textlode.session import stage

#: What letters are mistaken for: (printed, read). Fixed values.
LOOK_ALIKES = [
    ("e", "c"), ("t", "f"), ("o", "0"), ("a", "@"), ("n", "ri"), ("l", "1"), ("s", "5"), ("i", "l"), ("c", "("), ("l", "|"), ("d", "cl"),
    ("h", "b"), ("u", "ii"), ("m", "rn"), ("g", "9"), ("b", "6"), ("w", "vv"), ("v", "y"), ("y", "v"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("in", "m"),
    ("i", "1"), ("i", "|"), ("i", "!"), ("s", "$"), ("b", "8"), ("z", "2"), ("c", "e"), ("f", "t"), ("m", "nn"), ("h", "li"), ("ci", "d"), ("rn", "m"),
]
#: Signs that end a cut word.
HYPHENS = "-‐‑¬­"
#: Words whose synthetic damage is made in one group of rows; a longer word list gives more groups.
WORDS = 3000
#: Steps to a unit on which features are counted for the fits.
GRID = 256
SEED = 5
LEAST_COUNT = 5  # occurrences of a word that may be a correction
TOUCHED = 3  # q-grams that one letter is part of

_PAIRS = {(a, b) for a, b in LOOK_ALIKES}
#: Letters by what they are mistaken for, letter by letter: n for rl, m for rrl, u and h for ll.
_PARTS = str.maketrans({
    "e": "c", "(": "c", "f": "t", "0": "o", "@": "a", "i": "l", "1": "l", "|": "l", "!": "l", "5": "s", "$": "s", "9": "g", "2": "z", "y": "v",
    "n": "rl", "m": "rrl", "u": "ll", "h": "ll", "b": "ll", "6": "ll", "8": "ll", "d": "cl", "w": "vv", "ﬁ": "tl", "ﬂ": "tl",
})
_STROKES = re.compile(r"[lr]+rl")
_TOKEN = re.compile(r"[^\s.,;:?“”„‘’\"'\[\]{}<>/\\=–—…*#~^]+")
_CUT = re.compile(rf"[{HYPHENS}](?<=[^\W\d_].)[^\S\n]*\n[^\S\n]*(?=[^\W\d_])")
_ROMAN = re.compile(r"^(?=[ivxlc])(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})$")
_LETTERS = re.compile(r"[^\W\d_]+")
_MARKS = set("01|!5$@(9682")


def core(word: str) -> str:
    """A word's shape under all of ``LOOK_ALIKES``: words that differ by any number of them, wherever they stand, have the same one.

    Every letter is written as its parts; as m is mistaken for each of rn, in and nn, what stands before rl in a run of strokes doesn't count.
    """
    return _STROKES.sub("rrl", word.translate(_PARTS))


class _Words(dict):
    """The words that a raw token counts as, remembered by token."""

    def __missing__(self, raw: str) -> tuple[str, ...]:
        if not _LETTERS.search(raw):
            return ()
        token = raw.lower().rstrip(")!")
        if token[:1] == "(" and not (len(token) > 3 and token[1:].isalpha()):
            token = token[1:]
        parts = re.split(rf"[{HYPHENS}]", token) if any(h in token for h in HYPHENS) else (token,)
        words = [p for p in parts if len(p) > 1 and any(c.isalpha() for c in p)]
        if len(parts) > 1 and all(p.isalpha() for p in parts):
            words.append("-".join(parts))
        if len(self) < 500_000:
            self[raw] = tuple(words)
        return tuple(words)


def words_of(text: str, known: _Words | None = None) -> Counter:
    """Lower-cased words with how often they occur, words cut at line ends joined. Marks that letters are mistaken
    for stay inside a word; hyphenated words count with their parts and as a whole."""
    known, out = _Words() if known is None else known, Counter()
    for raw, n in Counter(_TOKEN.findall(_CUT.sub("", text))).items():
        for word in known[raw]:
            out[word] += n
    return out


def explain(word: str, read: str) -> tuple[int, int]:
    """(look-alikes, other edits) of the cheapest way from ``word`` to ``read``; an other edit costs as much as four look-alikes."""
    a = b = 0  # equal ends cost nothing; a letter of them is kept, as look-alikes may be two letters wide
    most = min(len(word), len(read)) - 1
    while a < most and word[a] == read[a]:
        a += 1
    while b < most - a and word[-1 - b] == read[-1 - b]:
        b += 1
    a, b = max(0, a - 1), max(0, b - 1)
    return _explain(word[a : len(word) - b], read[a : len(read) - b])


@lru_cache(200_000)
def _explain(word: str, read: str) -> tuple[int, int]:
    n, m = len(word), len(read)
    best = [[(10**6, 0, 0)] * (m + 1) for _ in range(n + 1)]
    best[0][0] = (0, 0, 0)
    for i in range(n + 1):
        for j in range(m + 1):
            cost, alike, other = best[i][j]
            if cost >= 10**6:
                continue
            if i < n and j < m and word[i] == read[j]:
                best[i + 1][j + 1] = min(best[i + 1][j + 1], (cost, alike, other))
            for a in (1, 2):
                for b in (1, 2):
                    if i + a <= n and j + b <= m and (word[i : i + a], read[j : j + b]) in _PAIRS:
                        best[i + a][j + b] = min(best[i + a][j + b], (cost + 1, alike + 1, other))
            for a, b in ((1, 0), (0, 1), (1, 1)):
                if i + a <= n and j + b <= m:
                    best[i + a][j + b] = min(best[i + a][j + b], (cost + 4, alike, other + 1))
    return best[n][m][1:]


#: Places, at most, where trees divide a feature.
CUTS = 24


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """For each feature the number of ``cuts`` below it."""
    return np.stack([np.searchsorted(points, x[:, k]) for k, points in enumerate(cuts)], 1).astype("u1")


class Boosted:
    """Gradient-boosted trees of depth three for two classes, small enough to fit and send anywhere."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3) -> None:
        self.trees, self.depth, self.rate, self.fitted = trees, depth, rate, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.05, 0.95, CUTS))) for k in range(x.shape[1])]
        return self.fit_counted(binned(x, cuts), y, np.ones(len(y)), cuts)

    def fit_counted(self, bins: np.ndarray, y: np.ndarray, n: np.ndarray, cuts: list[np.ndarray]) -> Boosted:
        """Fit to rows of which each counts ``n`` times and has, for each feature, the number of ``cuts`` that lie below it."""
        columns = np.ascontiguousarray(bins.T)
        f = np.zeros(len(y))
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = n * (y - p), n * p * (1 - p)

            def grow(at: np.ndarray, depth: int) -> tuple:
                ga, ha = g[at].sum(), h[at].sum()
                gain, pick = 1e-6, None
                for k, points in enumerate(cuts if depth and n[at].sum() >= 10 else ()):
                    b = columns[k][at]
                    gl, hl = (np.bincount(b, v[at], len(points) + 1).cumsum()[:-1] for v in (g, h))
                    gains = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                    # of cuts that divide the rows alike the first, whatever the last digits of their sums are
                    if len(points) and gains.max() > gain * (1 + 1e-9):
                        gain, pick = float(gains.max()), (k, int((gains >= gains.max() * (1 - 1e-9)).argmax()))
                if pick is None:
                    f[at] += self.rate * ga / (ha + 1.0)
                    return (float(ga / (ha + 1.0)),)
                left = columns[pick[0]][at] <= pick[1]
                return (pick[0], float(cuts[pick[0]][pick[1]]), grow(at[left], depth - 1), grow(at[~left], depth - 1))

            self.fitted.append(grow(np.arange(len(y)), self.depth))
        return self

    def _one(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        return np.where(x[:, tree[0]] <= tree[1], self._one(tree[2], x), self._one(tree[3], x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-sum(self.rate * self._one(t, x) for t in self.fitted)))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, n: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last for the constant) by regularised Newton steps; ``n`` tells how often each row counts."""
    x, n = np.c_[x, np.ones(len(x))], np.ones(len(x)) if n is None else n
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w)), x.T @ (n * (y - p)) - 0.01 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _chance(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ w, -30, 30)))


# ---------------------------------------------------------------- misread words


class Ranker:
    """Trees over pairs of a word as it stands and a candidate, and the letter pairs of the words they were fitted on."""

    def __init__(self, words: list[tuple[str, int]], seen: dict[str, float] | None = None) -> None:
        """``seen`` has the letter pairs of words where they are counted already."""
        seen = Counter(seen or {})
        for w, n in words:
            for pair in self._pairs(w):
                seen[pair] += n**0.5
        first: Counter = Counter()
        for pair, n in seen.items():
            first[pair[0]] += n
        self.logs = {pair: float(np.log((n + 0.05) / (first[pair[0]] + 2.0))) for pair, n in seen.items()}
        self.trees = Boosted(trees=60, depth=4)

    @staticmethod
    def _pairs(word: str) -> list[str]:
        word = f"^{word}$"
        return [word[i : i + 2] for i in range(len(word) - 1)]

    def likely(self, word: str) -> float:
        """How usual the word's letter pairs are, in nats."""
        return sum(self.logs.get(pair, -7.0) for pair in self._pairs(word))

    def features(self, read: list[str], word: list[str], n_read: np.ndarray, n_word: np.ndarray) -> np.ndarray:
        known: dict[str, float] = {}
        rows = []
        for r, w in zip(read, word):
            for x in (r, w):
                if x not in known:
                    known[x] = self.likely(x)
            alike, other = explain(w, r)
            marks = sum(c in _MARKS for c in r)
            inside = sum(c in _MARKS for c in r[1:-1])
            rows.append((alike, other, len(w), marks, max(0, other - inside), len(r) - len(w), known[r] - known[w]))
        out = np.array(rows, dtype="f8").reshape(len(rows), 7)
        lr, lw = np.log1p(n_read), np.log1p(n_word)
        return np.c_[out, lr, lw, lw - lr]

    def score(self, read: list[str], word: list[str], n_read: np.ndarray, n_word: np.ndarray) -> np.ndarray:
        return self.trees.score(self.features(read, word, n_read, n_word))


def misread(word: str, rng: random.Random) -> str | None:
    """``word`` with one or two letters replaced by look-alikes, or one inside it by a sign that no list has for it."""
    if rng.random() < 0.08 and len(word) > 4:
        i = rng.randrange(1, len(word) - 1)
        return word[:i] + rng.choice("0123456789|!$@(") + word[i + 1 :]
    for _ in range(1 if rng.random() < 0.8 else 2):
        ways = [(i, a, b) for a, b in LOOK_ALIKES for i in range(len(word)) if word.startswith(a, i)]
        if not ways:
            return None
        i, a, b = rng.choice(ways)
        word = word[:i] + b + word[i + len(a) :]
    return word


def damaged(words: list[tuple[str, int]], letters: list[str], seed: int) -> tuple[list[str], list[str], list[float], list[float], list[int]]:
    """(words as read, candidates, counts of both, labels): pairs from which trees learn to tell a misread word's true candidate from others, and
    misread words from correct ones."""
    rng = random.Random(seed)
    by_gram: dict[str, list[tuple[str, int]]] = {}
    for w, n in words:
        for g in _grams(core(w)):
            by_gram.setdefault(g, []).append((w, n))
    r, c, nr, nc, y = [], [], [], [], []

    def add(a: str, b: str, na: float, nb: float, label: int) -> None:
        r.append(a), c.append(b), nr.append(na), nc.append(nb), y.append(label)  # noqa: PLW0106

    def rare(n: int) -> int:
        return max(1, int(n * 10 ** rng.uniform(-4.5, -0.6)))

    for w, n in words * max(1, WORDS // (2 * max(1, len(words)))):
        bad, worse = misread(w, rng), misread(w, rng)
        seen = rare(n)
        if worse and worse != w:
            add(worse, w, rare(n), n, 1)
        near = [x for x in by_gram[rng.choice(_grams(core(w)))] if x[0] != w and abs(len(x[0]) - len(w)) < 4]
        if bad and bad != w:
            add(bad, w, seen, n, 1)
            for other, m in rng.sample(near, min(2, len(near))):
                add(bad, other, seen, m, 0)
        # a correct word needs no replacement, not even if it is rare: other words, inflected and otherwise changed ones, and those with a number
        for other, m in rng.sample(near, min(2, len(near))):
            add(w, other, n, m, 0)
            add(w, other, rare(m), m, 0)
        i = rng.randrange(len(w))
        for turned in (w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w + rng.choice(letters), w + rng.choice("0123456789!"), w[:i] + rng.choice("01!|") + w[i:]):
            if turned != w and explain(w, turned)[1]:
                add(turned, w, seen, n, 0)
        if rng.random() < 0.5:
            add(w + rng.choice("0123456789!"), w + rng.choice(letters), 1, max(5, seen), 0)
    return r, c, nr, nc, y


def fit_ranker(words: list[tuple[str, int]], seed: int = SEED) -> Ranker:
    """The ranker of a list of words."""
    ranker = Ranker(words)
    r, c, nr, nc, y = damaged(words, sorted({c for w, _ in words for c in w}) or ["a"], seed)
    if len(set(y)) > 1:
        ranker.trees.fit(ranker.features(r, c, np.array(nr, "f8"), np.array(nc, "f8")), np.array(y, "f8"))
    return ranker


def _grams(skeleton: str) -> list[str]:
    padded = f"^{skeleton}$"
    return sorted({padded[i : i + 3] for i in range(len(padded) - 2)})


def _shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        shape = [core(w) for w in batch["w"]]
        yield batch.assign(shape=shape, size=[len(x) for x in shape])


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[["i", "size"]].assign(grams=[[f"^{x}$"[k : k + 3] for k in range(len(x))] for x in batch["shape"]])


def misread_words(counts: DataFrame, ranker: Ranker) -> DataFrame:
    """``(w, correction)`` of the words of ``counts`` (w, n) that are misread ones.

    The index holds all q-grams of the shapes of all words that are common enough to be corrections, by place and by the lengths that are one
    off at most. Look-alikes leave a shape as it is, and one other sign in it touches at most ``TOUCHED`` of its q-grams and moves the others
    by at most one: so of any more than that, the rarest of a word for instance, a correction has at least one. Any number of look-alikes
    and one other change are found; what of it is a misreading, the trees decide.
    """
    spark = counts.sparkSession
    shapes = counts.where(F.length("w") >= 3).mapInPandas(_shapes, "w string, n long, shape string, size int")
    shapes = stage(shapes.withColumn("i", F.monotonically_increasing_id()))
    common = shapes.where(F.col("w").rlike(r"^\p{L}+$") & (F.col("n") >= LEAST_COUNT))
    # words with a common word of about their length; q-grams go by the word's number, as a word may be as long as a text
    near = lambda df: df.withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
    # (broadcast: no more numbers than the longest word has letters)
    some = shapes.join(F.broadcast(near(common.select("size")).distinct()), "size", "left_semi").select("i", "size", "shape")
    placed = stage(some.mapInPandas(_placed, "i long, size int, grams array<string>").select("i", "size", F.posexplode("grams").alias("at", "g")))
    index = near(placed.join(common.select("i", F.col("w").alias("c"), F.col("n").alias("nc"), F.col("shape").alias("cs")), "i")).withColumnRenamed("at", "c_at").drop("i")
    often = index.groupBy("g", "size").agg(F.count(F.lit(1)).alias("df"))
    asked = placed.join(often, ["g", "size"], "left").select("i", "size", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g", "at").alias("r"))
    rare = asked.groupBy("i", "size").agg(F.slice(F.array_sort(F.collect_list("r")), 1, TOUCHED + 1).alias("r"))  # the q-grams of one word
    rare = rare.select("i", "size", F.explode("r").alias("r")).where("r.df > 0").select("i", "size", F.col("r.g").alias("g"), F.col("r.at").alias("at"))
    rare = rare.join(shapes.select("i", "w", "n", "shape"), "i")
    pairs = rare.join(index, ["g", "size"]).where("abs(at - c_at) <= 1 AND nc > n AND w <> c AND levenshtein(shape, cs, 1) >= 0")
    pairs = pairs.select("w", "n", "c", "nc").distinct()
    model = spark.sparkContext.broadcast(ranker)

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranker = model.value
        for batch in batches:
            if len(batch) and ranker.trees.fitted:
                score = ranker.score(list(batch["w"]), list(batch["c"]), batch["n"].to_numpy("f8"), batch["nc"].to_numpy("f8"))
                yield batch[["w", "c", "nc"]].assign(score=score)

    ranked = pairs.mapInPandas(rank, "w string, c string, nc long, score double").where("score >= 0.5")
    # of candidates that score alike the commonest, so that none is a misreading itself
    best = F.max(F.struct(F.round("score", 1).alias("s"), "nc", "c"))
    return ranked.groupBy("w").agg(best.alias("b")).select("w", F.col("b.c").alias("correction"))


# ---------------------------------------------------------------- line pairs


def join_features(sign: list[str], joined: np.ndarray, left: np.ndarray, right: np.ndarray, compound: np.ndarray, lower: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Features of a line's end with a sign and what follows, from the counts of the words they make."""
    soft = np.array([s in "¬­" for s in sign], "f8")
    j, a, b, c = (np.log1p(v.astype("f8")) for v in (joined, left, right, compound))
    return np.c_[soft, j, np.minimum(a, b), c, j > np.minimum(a, b), lower, end, (j > 0) & (j > c)]


def cut_words(words: list[tuple[str, int]], compounds: list[tuple[str, int]], often: int, seed: int) -> list[tuple]:
    """Line ends and what follows, from words cut anywhere, compounds cut at their own hyphen and dashes between words: (sign; the words joined,
    left, right and compound, None for those that aren't there; lower case, end of the page; label, how often it counts). A compound counts ``often`` times."""
    rng, rows = random.Random(seed), []
    for w, _ in words:
        if len(w) < 5:
            continue
        at = rng.randrange(2, len(w) - 1)
        sign, end = rng.choice("-‐‑¬­"), rng.random() < 0.3
        unseen = rng.random() < 0.4  # the rest is on a page that isn't there
        asked = [None, w[:at], None, None] if unseen and end else [w, w[:at], w[at:], f"{w[:at]}-{w[at:]}"]
        rows.append((sign, asked, 0.0 if unseen and end else 1.0, float(end), 1, 1))
    for w, _ in compounds:
        a, _, b = w.partition("-")
        rows.append(("-", [a + b, a, b, w], 1.0, 0.0, 0, often))
    for k in range(len(words) // 2):  # a dash between whole words
        (a, _), (b, _) = rng.choice(words), rng.choice(words)
        rows.append(("-", [a + b, a, b, f"{a}-{b}"], float(k % 2), 0.0, 0, 1))
    return rows


_NO_WORD = re.compile(r"[\W\d_]+")
_NOT_SHAPED = re.compile(r"[^a-z0-9|@($!ß-￿]")
_OF = re.compile(r"\b(\d{1,6})\s*(?:of|/|von|de)\s*\d{1,6}\b")
_SET_OFF = re.compile(r"\S {3,}\S|\bpage\b|\bseite\b", re.I)


@lru_cache(50_000)
def line_shape(line: str) -> str:
    """What stays of a line apart from case, numbers and misreading; roman numbers count as numbers."""
    words = [w for w in line.lower().split() if not _ROMAN.match(w.strip("[](){}-–—.·|"))]
    kept = [w for w in words if not _NO_WORD.fullmatch(w)]
    return core(_NOT_SHAPED.sub("", "".join(kept)))


_NUMBER = re.compile(r"(?<![\w.,])(\d{1,6}|[ivxlc]{1,8})(?![\w,])", re.I)
_ALONE = re.compile(
    r"^\W*(?:(?:page|pg|p|seite|s|página|pagina|pág|page n°|strona|str|стр|страница)\W*)?(\d{1,6}|[ivxlc]{1,8})(?:\s*(?:of|/|von|de|sur|из|z)\s*\d{1,6})?\W*$", re.I
)


def roman(text: str) -> int | None:
    """The value of a roman number up to 399 in lower case, None for other text."""
    if not text or not _ROMAN.match(text):
        return None
    values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in text]
    return sum(-v if v < max(values[k:], default=0) else v for k, v in enumerate(values))


def _value(text: str) -> int | None:
    return int(text) if text.isdigit() else roman(text.lower())


@lru_cache(50_000)
def line_numbers(line: str) -> tuple[list[int], bool, bool]:
    """(numbers that may be the page's, whether the line has nothing else, whether it is set like a page number)."""
    alone = _ALONE.match(line.strip())
    if alone and _value(alone[1]) is not None:
        return [_value(alone[1])], True, not alone[1] == line.strip()
    words = line.split()
    out = []
    for w in (words[:1] + words[-1:]) if len(words) > 1 else []:
        v = _value(w.strip("[](){}-–—.·|"))
        if v is not None and not (w.isalpha() and len(w) < 2):
            out.append(v)
    of = _OF.search(line)
    if of:
        out.append(int(of[1]))
    return out, False, bool(of) or bool(_SET_OFF.search(line))


EDGE = 3  # lines at the top and at the foot that may be furniture


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of every text the words, counted over many texts ("count": text, at); of pages also the lines at the edges, the words cut at line ends,
    the words that the first lines begin with, and the words."""
    columns, known, raw = ["record_id", "source", "page", "what", "at", "text", "shape", "numbers", "alone", "set_off"], _Words(), Counter()

    def counted() -> pd.DataFrame:
        total: Counter = Counter()
        for token, n in raw.items():
            for word in known[token]:
                total[word] += n
        return _frame([(None, None, None, "count", n, word, "", [], False, False) for word, n in total.items()])

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"page": "Int32", "at": "Int32"})

    for batch in batches:
        rows = []
        for key, source, page, text in zip(batch["record_id"], batch["source"], batch["page"], batch["text"]):
            tokens = Counter(_TOKEN.findall(_CUT.sub("", text)))
            raw.update(tokens)
            if page != page or page is None:
                continue
            lines = [x for x in text.split("\n") if x.strip()]
            n = len(lines)
            for k in {*range(min(EDGE, n)), *range(max(0, n - EDGE), n)}:
                numbers, alone, off = line_numbers(lines[k])
                top, foot = k + 1, k - n
                beside = any(line_numbers(lines[j])[1] for j in (k - 1, k + 1) if 0 <= j < n)
                rows.append((key, source, page, "edge", top if top <= -foot else foot, lines[k].strip()[-1:], line_shape(lines[k]), numbers, alone, (off or lines[k][:1].isspace()) and not (alone and beside and not off)))
            for k, line in enumerate(lines):
                end = line.rstrip()
                if len(end) > 1 and end[-1] in HYPHENS and end[-2].isalpha():
                    left = _LETTERS.findall(end)[-1].lower()
                    after = [_LETTERS.match(x.lstrip()) for x in lines[k + 1 : k + 2]]
                    rest = [m.group() for m in after if m]
                    last = n - k <= EDGE
                    rows.append((key, source, page, "cut", 1 if last else 0, f"{end[-1]}{left}", " ".join(rest), [], False, last))
            first = [m.group() for x in lines[: EDGE + 1] if (m := _LETTERS.match(x.lstrip()))]
            rows.append((key, source, page, "first", 0, " ".join(first), "", [], False, False))
            words = dict.fromkeys(word for token in tokens for word in known[token])
            rows.append((key, source, page, "words", 0, "\n".join(words), "", [], False, False))
        yield _frame(rows)
        if len(raw) > 300_000:
            yield counted()
            raw.clear()
    if raw:
        yield counted()


def pages_of(df: DataFrame, row_id: str, text: str, metadata: str) -> DataFrame:
    """``(record_id, source, page, text)`` of the rows with a whole-numbered ``page`` in their metadata."""
    return _texts(df, row_id, text, metadata).where("page IS NOT NULL")


def _texts(df: DataFrame, row_id: str, text: str, metadata: str) -> DataFrame:
    """``(record_id, source, page, text)`` of all rows with a text; ``page`` is null unless it is a whole number."""
    page = F.get_json_object(metadata, "$.page")
    return df.where(F.col(text).isNotNull()).select(
        F.col(row_id).alias("record_id"), F.get_json_object(metadata, "$.source").alias("source"), F.when(page.rlike(r"^\d{1,9}$"), page).cast("int").alias("page"), F.col(text).alias("text")
    )


#: Share of common q-grams from which two lines of a source are a pair to decide about.
ALIKE = 0.6


def header_features(alike, gap, place, step, ends, alone, letters) -> list:
    """Features of a pair of lines on two pages of a source, of columns or arrays: share and number of q-grams in common or not, same place, same distance of
    number and page; then, of the line itself, the end of a sentence, a number alone, and its length."""
    return [alike, gap / (10 + gap), place, step, ends, alone, 3 / (3 + letters)]


def number_features(step, alone, header, off) -> list:
    """Features of a line with a number: a line on another page with the number at the same distance from its page, the number alone, beside a
    header, set off."""
    return [step, alone, header, off, step * alone, step * header, step * off, alone * off]


def _weigh(weights: np.ndarray, features: list) -> Column:
    return sum((F.lit(float(w)) * x for w, x in zip(weights, features)), F.lit(float(weights[-1])))


def line_pairs(words: list[tuple[str, int]], seed: int) -> Counter:
    """Features and label of pairs of lines made of ``words``, with how often they occur; every word begins one at least."""
    rng = random.Random(seed)
    pool = [w for w, _ in words] + ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randrange(4, 11))) for _ in range(max(0, 50 - len(words)))]
    rows: Counter = Counter()

    def add(a: str, b: str, place: float, step: float, ends: float, label: int, alone: float = 0.0) -> None:
        a, b = line_shape(a), line_shape(b)
        if not a or not b:
            return
        x, z = set(_grams(a)), set(_grams(b))
        rows[len(x & z) / len(x | z), float(len(x ^ z)), place, step, ends, alone, float(len(a)), float(label)] += 1

    def flag(p: float) -> float:
        return float(rng.random() < p)

    for k in range(max(WORDS, len(pool))):
        title = [pool[k % len(pool)], *(rng.choice(pool) for _ in range(rng.randrange(6)))]
        line = " ".join(title)
        add(line, line.upper(), flag(0.8), flag(0.4), 0.0, 1)  # the same on another page,
        at = rng.randrange(len(line))
        hurt = line[:at] + rng.choice(["", rng.choice("abcdefgh")]) + line[at + 1 :]  # a letter lost or read as any other,
        add(line, rng.choice([hurt, f"{line} l{rng.randrange(2, 10)}"]), flag(0.8), flag(0.4), 0.0, 1)  # or a number read as letters
        add(line, line, flag(0.3), flag(0.02), 1.0, 0)  # a sentence's end that recurs
        add("page 1", "page 2", flag(0.8), flag(0.5), 0.0, 0, 1.0)
        mark = rng.choice("aegorstz")
        add(mark, mark, flag(0.5), flag(0.02), 0.0, 0)
        share = rng.choice([0.5, 0.8])
        kept = [w if rng.random() < share else rng.choice(pool) for w in title]  # lines with words in common
        if kept != title:
            add(line, " ".join(kept), flag(0.3), flag(0.02), flag(0.2), 0)
        long = [*title, *(rng.choice(pool) for _ in range(4))]  # and stretches of the same text
        add(" ".join(long[:-1]), " ".join(long[rng.randrange(2) :]), flag(0.3), flag(0.02), flag(0.2), 0)
        add(line, " ".join(rng.choice(pool) for _ in title), flag(0.3), flag(0.02), flag(0.2), 0)
    return rows


def fit_headers(pairs: Counter) -> np.ndarray:
    """Weights of the classifier of line pairs for headers."""
    rows = sorted(pairs)
    x = np.array(rows, "f8")
    return logistic(np.stack(header_features(*x[:, :-1].T), 1), x[:, -1], n=np.array([pairs[r] for r in rows], "f8"))


def fit_numbers(seed: int = SEED) -> np.ndarray:
    """Weights of the classifier of line pairs for page numbers, from the ways in which lines with numbers are set."""
    rng, rows, y = random.Random(seed), [], []
    for _ in range(300):
        for alone, beside, off in ((1, 0, 0), (1, 0, 1), (0, 1, 0), (0, 1, 1), (0, 0, 1)):
            rows.append((1, alone, beside, off)), y.append(1)  # printed on two pages  # noqa: PLW0106
            if (alone, off) != (1, 1):  # the same kinds of line, with numbers that don't follow the pages
                rows.append((0, alone, beside, off)), y.append(0)  # noqa: PLW0106
        rows.append((0, 1, 0, 1)), y.append(1)  # one page only, set like a page number  # noqa: PLW0106
        rows += [(int(rng.random() < 0.3), 0, 0, 0), (0, 0, 0, 0)]  # in the text
        y += [0, 0]
    return logistic(np.stack(number_features(*np.array(rows, "f8").T), 1), np.array(y, "f8"))


def _near(shapes: DataFrame, pair: Callable[..., Column], weights: np.ndarray, often: Counter) -> DataFrame:
    """``(key, near)`` of the shapes on one page only: the most that ``pair`` gives for another shape of the source on another page, of those
    that have a share of ``ALIKE`` of their q-grams in common.

    Of its q-grams, ordered by how ``often`` words have them, a shape looks under as many of the first as may be missing in a pair that
    the classifier can take, and one more: two such shapes meet there.
    """
    shapes = stage(shapes.withColumn("i", F.monotonically_increasing_id()))
    rest, gaps = float(np.maximum(weights[2:-1], 0).sum() + weights[-1]), {}

    def missing(size: int) -> int:
        if size not in gaps:
            fits = [0]
            for g in range(1, int(size * (1 - ALIKE) / ALIKE) + 1):
                alike = [max(ALIKE, 1 - g / size), 1 - g / (size + g)]
                if rest + max(weights[0] * x for x in alike) + weights[1] * g / (10 + g) >= 0:
                    fits.append(g)
            gaps[size] = min(max(fits), size - 1)
        return gaps[size]

    class Gram(dict):
        """How often a q-gram is and its bit of a sketch."""

        def __missing__(self, g: str) -> tuple[int, str, int]:
            found = (often.get(g, 0), g, 1 << (crc32(g.encode("utf-8", "replace")) & 255))
            if len(self) < 500_000:
                self[g] = found
            return found

    def rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Gram()
        for batch in batches:
            probed, most, sketches = [], [], []
            for shape in batch["shape"]:
                grams = sorted(map(known.__getitem__, _grams(shape)))
                bits = 0
                for _, _, bit in grams:
                    bits ^= bit
                most.append(missing(len(grams)))
                probed.append([g for _, g, _ in grams[: most[-1] + 1]])
                sketches.append(bits.to_bytes(32, "little"))
            n = np.array(list(map(len, probed)), dtype="i8")
            sketch = np.frombuffer(b"".join(sketches), "<i8").reshape(-1, 4)
            columns = {f"b{k}": np.repeat(sketch[:, k], n) for k in range(4)}
            yield pd.DataFrame({
                "s": np.repeat(batch["source"].to_numpy("i8"), n), "i": np.repeat(batch["i"].to_numpy("i8"), n), "g": [g for gs in probed for g in gs],
                "most": np.repeat(np.array(most, "i4"), n), **columns,
            })

    probes = shapes.select(F.xxhash64("source").alias("source"), "i", "shape").mapInPandas(rare, "s long, i long, g string, most int, b0 long, b1 long, b2 long, b3 long")
    probes = probes.select(F.xxhash64("s", "g").alias("g"), "i", "most", "b0", "b1", "b2", "b3")
    x, y = probes.alias("x"), probes.alias("y")  # of one shuffle
    # a q-gram that one of two shapes lacks turns at most one bit of its sketch
    turned = " + ".join(f"bit_count(x.b{k} ^ y.b{k})" for k in range(4))
    pairs = x.join(y, F.col("x.g") == F.col("y.g")).where(f"x.i <> y.i AND {turned} <= least(x.most, y.most)")
    pairs = pairs.select(F.col("x.i").alias("i"), F.col("y.i").alias("other")).distinct()
    sides = pairs.join(shapes.where("p_min = p_max"), "i")
    sides = sides.join(shapes.drop("key").select(*[F.col(c).alias("other" if c == "i" else f"o_{c}") for c in shapes.columns if c != "key"]), "other")
    sides = sides.where("source = o_source AND (o_p_min <> p_min OR o_p_max <> p_max)")
    grams = "array_distinct(transform(sequence(1, length({0})), i -> substring(concat('^', {0}, '$'), i, 3)))"
    sides = sides.withColumn("a", F.expr(grams.format("shape"))).withColumn("b", F.expr(grams.format("o_shape")))
    sides = sides.withColumn("both", F.size(F.array_intersect("a", "b"))).withColumn("either", F.size("a") + F.size("b") - F.col("both")).where(F.col("both") >= F.col("either") * ALIKE)
    place, step = F.expr("a_min = a_max AND o_a_min = a_min AND o_a_max = a_max"), F.expr("d_min = d_max AND o_d_min = d_min AND o_d_max = d_max")
    near = pair(F.col("both") / F.col("either"), F.col("either") - F.col("both"), place, step)
    return sides.groupBy("key").agg(F.max(near).alias("near"))


def furniture(edges: DataFrame, weights: tuple[np.ndarray, np.ndarray], often: Counter) -> DataFrame:
    """``(record_id, at, header, number)`` of the edge lines that are running headers or hold printed page numbers.

    One classifier decides of pairs of lines on different pages of a source - with the same shape, or with q-grams of it in common -
    whether a line is a header; the other whether a number is the page's, from lines whose numbers are equally far from their pages, and from
    how the line is set.
    """
    for_header, for_number = weights
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")

    def pair(alike: Column, gap: Column, place: Column, step: Column) -> Column:
        return _weigh(np.r_[for_header[:4], 0.0], header_features(alike, gap, flag(place), flag(step), 0, 0, 0)[:4])

    ends, alone = flag(F.col("text").rlike(r"[.,;:!?]$")), flag(F.col("alone"))
    own = _weigh(for_header[4:], header_features(0, 0, 0, 0, ends, alone, F.length("shape"))[4:])
    most = float(np.maximum(for_header[:4], 0).sum())  # what no pair exceeds
    lines = edges.where("source IS NOT NULL AND shape <> ''").withColumn("own", own).where(F.col("own") + most >= 0)
    lines = lines.select("record_id", "source", "page", "at", "shape", "own", (F.expr("get(numbers, 0)") - F.col("page")).alias("d"), F.unhex(F.md5(F.concat_ws("\x01", "source", "shape"))).alias("key"))
    lines = stage(lines)
    pages = {"p_min": F.min("page"), "p_max": F.max("page")}
    spans = pages | {f"{s}_{m}": f(c) for s, c in (("a", "at"), ("d", "d")) for m, f in (("min", F.min), ("max", F.max))}
    same = attach_groups(lines.drop("shape"), "key", "record_id", spans, "p_min < p_max").where(F.col("own") + pair(F.lit(1.0), F.lit(0), F.expr("a_min = a_max"), F.expr("d_min = d_max")) >= 0)
    several = lines.groupBy("source").agg(F.min("page").alias("first"), F.max("page").alias("last")).where("first < last").select("source")
    shapes = lines.groupBy("source", "key", "shape").agg(*[c.alias(n) for n, c in spans.items()]).join(several, "source")
    near = lines.drop("shape").join(_near(shapes, pair, for_header, often), "key").where(F.col("own") + F.col("near") >= 0)
    headers = same.select("record_id", "at").unionByName(near.select("record_id", "at")).distinct().withColumn("header", F.lit(True))
    numbers = edges.select("record_id", "source", "page", "at", "alone", "set_off", F.explode("numbers").alias("number"))
    steps = numbers.withColumn("key", F.when(F.col("source").isNotNull(), F.concat_ws("\x01", "source", F.col("number") - F.col("page"))))
    kept = attach_groups(steps, "key", "record_id", pages, "p_min < p_max").select("record_id", "at").distinct().withColumn("step", F.lit(True))
    both = edges.select("record_id", "at", "alone", "set_off", "numbers").join(headers, ["record_id", "at"], "left").join(kept, ["record_id", "at"], "left")
    header = F.coalesce("header", F.lit(False))
    number = (F.size("numbers") > 0) & (_weigh(for_number, number_features(*[flag(F.col(c)) for c in ("step", "alone", "header", "set_off")])) >= 0)
    return both.select("record_id", "at", header.alias("header"), number.alias("number")).where("header OR number")


def cuts(parsed: DataFrame, counts: DataFrame, weights: np.ndarray) -> DataFrame:
    """``(record_id, text, joined)`` of the words cut at line ends that the classifier of line pairs joins."""
    ends = parsed.where("what = 'cut'").select("record_id", "source", "page", "text", F.col("shape").alias("next"), F.col("set_off").alias("last"))
    ends = ends.distinct()
    firsts = parsed.where("what = 'first' AND source IS NOT NULL").groupBy("source", (F.col("page") - 1).alias("page")).agg(F.max("text").alias("over"))
    ends = ends.join(firsts, ["source", "page"], "left")
    ends = ends.withColumn("rest", F.when(F.col("last"), F.concat_ws(" ", "next", F.coalesce("over", F.lit("")))).otherwise(F.col("next")))
    ends = ends.withColumn("sign", F.substring("text", 1, 1)).withColumn("left", F.expr("substring(text, 2)"))
    tries = ends.select("record_id", "text", "sign", "left", "last", F.explode_outer(F.split(F.trim("rest"), " +")).alias("right"))
    tries = tries.withColumn("right", F.coalesce("right", F.lit(""))).withColumn("low", F.lower("right")).distinct()
    tries = tries.withColumn("joined", F.concat("left", "low"))
    tries = stage(tries.withColumn("t", F.monotonically_increasing_id()))
    # the four words that an end may make, looked up together; where nothing follows there is only the first part
    words = {"n_joined": F.col("joined"), "n_left": F.col("left"), "n_right": F.col("low"), "n_compound": F.concat_ws("-", "left", "low")}
    asked = F.array(*[F.struct(F.lit(name).alias("name"), word.alias("w")) for name, word in words.items()])
    asked = tries.select("t", "low", F.explode(asked).alias("a")).where("low <> '' OR a.name = 'n_left'").select("t", "a.name", "a.w")
    found = asked.join(counts, "w").groupBy("t").agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in words])
    tries = tries.join(found, "t", "left").drop("t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            v = [b[c].fillna(0).to_numpy("f8") for c in ("n_joined", "n_left", "n_right", "n_compound")]
            lower = np.array([r[:1].islower() for r in b["right"]], "f8")
            x = join_features(list(b["sign"]), *v, lower, b["last"].to_numpy("f8"))
            yield b[["record_id", "text", "joined"]].assign(score=_chance(weights, x))

    kind = parsed.schema["record_id"].dataType.simpleString()
    scored = tries.mapInPandas(run, f"record_id {kind}, text string, joined string, score double").where("score >= 0.5")
    return scored.groupBy("record_id", "text").agg(F.max(F.struct("score", "joined")).alias("b")).select("record_id", "text", F.col("b.joined").alias("joined"))


# ---------------------------------------------------------------- fits


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Letter pairs (by the root of the word's count, in whole parts of 2^20, so that no order of adding matters), q-grams of shapes, words and compounds."""
    out: Counter = Counter()
    for batch in batches:
        for w, n in zip(batch["w"], batch["n"]):
            out["compounds" if "-" in w else "words", ""] += 1
            if "-" not in w:
                for pair in Ranker._pairs(w):
                    out["pair", pair] += round(n**0.5 * 2**20)
                for g in _grams(core(w)):
                    out["gram", g] += 1
    yield pd.DataFrame([(*key, v) for key, v in out.items()], columns=["what", "t", "v"])


_MADE = "what string, t long, x array<double>, y double, n long, words array<string>"


def _made(words: list[tuple[str, int]], compounds: list[tuple[str, int]], ranker: Ranker, letters: list[str], often: int, group: int) -> pd.DataFrame:
    """What the classifiers are fitted to, of a group of words: features of damaged words ("misread") and on which steps of ``GRID`` they lie ("value": number of
    the feature, step), pairs of lines ("header"), and cut words, whose counts are yet to be looked up ("cut")."""
    rows: list[tuple] = []
    r, c, nr, nc, y = damaged(words, letters, SEED + group)
    if y:
        x = ranker.features(r, c, np.array(nr, "f8"), np.array(nc, "f8"))
        rows += [("misread", 0, v, float(label), 1, None) for v, label in zip(x, y)]
        for k in range(x.shape[1]):
            rows += [("value", 0, [float(k), v], 0.0, int(n), None) for v, n in zip(*np.unique(np.floor(x[:, k] * GRID), return_counts=True))]
    rows += [("header", 0, key[:-1], key[-1], n, None) for key, n in line_pairs(words, SEED + group).items()]
    for k, (sign, asked, lower, end, label, n) in enumerate(cut_words(words, compounds, often, SEED + group)):
        rows.append(("cut", group << 32 | k, [float(sign in "¬­"), lower, end], float(label), n, asked))
    return pd.DataFrame(rows, columns=["what", "t", "x", "y", "n", "words"])


def _cut_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out: Counter = Counter()
    for b in batches:
        if len(b):
            soft, lower, end = np.stack(b["x"].to_list()).T
            v = [b[c].fillna(0).to_numpy("f8") for c in ("n_joined", "n_left", "n_right", "n_compound")]
            x = np.round(join_features(["¬" if s else "-" for s in soft], *v, lower, end) * GRID) / GRID
            for row, y, n in zip(map(tuple, x.tolist()), b["y"], b["n"]):
                out[row, y] += n
    yield pd.DataFrame([(list(x), y, n) for (x, y), n in out.items()], columns=["x", "y", "n"])


def fit_words(counts: DataFrame) -> tuple[Ranker, np.ndarray, np.ndarray, Counter]:
    """The ranker of misread words, the weights of the classifiers of joins and headers, and how often words have each q-gram.

    All words that occur ``4 * LEAST_COUNT`` times and all compounds that occur ``LEAST_COUNT`` times take part: their letter pairs and q-grams are counted,
    and groups of about ``WORDS`` of them make the rows to fit to, on the executors. Only the rows with how often they occur come to the driver: for
    the trees as the places of the features between the cuts, which is all that trees use of them; for joins on steps of ``GRID``.
    """
    spark = counts.sparkSession
    plain = F.col("w").rlike(r"^\p{L}{3,}$") & (F.col("n") >= 4 * LEAST_COUNT)
    listed = counts.where(plain | (F.col("w").rlike(r"^\p{L}+-\p{L}+$") & (F.col("n") >= LEAST_COUNT)))
    tally: dict[str, dict[str, int]] = {"pair": {}, "gram": {}, "words": {}, "compounds": {}}
    for row in listed.mapInPandas(_tally, "what string, t string, v long").groupBy("what", "t").agg(F.sum("v").alias("v")).collect():
        tally[row["what"]][row["t"]] = row["v"]
    ranker = Ranker([], {pair: v / 2**20 for pair, v in sorted(tally["pair"].items())})
    n_words, n_compounds = tally["words"].get("", 0), tally["compounds"].get("", 0)
    if not n_words + n_compounds:
        return ranker, np.zeros(9), fit_headers(line_pairs([], SEED)), Counter()
    letters = sorted({pair[1] for pair in tally["pair"]} - {"$"}) or ["a"]
    groups, often = max(1, -(-n_words // WORDS)), max(1, n_words // (4 * max(1, n_compounds)))
    model = spark.sparkContext.broadcast((ranker, letters))

    def make(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "w"])
        both = list(zip(part["w"], part["n"].tolist()))
        return _made([x for x in both if "-" not in x[0]], [x for x in both if "-" in x[0]], *model.value, often, int(key[0]))

    named = listed.withColumn("h", F.xxhash64("w")).withColumn("group", F.pmod("h", F.lit(groups)))
    made = stage(named.groupBy("group").applyInPandas(make, _MADE), "what")
    x, y, n = _columns(made.where("what IN ('value', 'header')"))
    headers = Counter({(*a, b): int(c) for a, b, c in zip(x, y, n) if len(a) == 7})
    values = np.array([(*a, c) for a, c in zip(x, n) if len(a) == 2]).reshape(-1, 3)

    words = ["n_joined", "n_left", "n_right", "n_compound"]
    asked = made.where("what = 'cut'").select("t", "x", "y", "n", F.posexplode("words").alias("at", "w")).where("w IS NOT NULL")
    found = asked.join(counts.withColumnRenamed("n", "has"), "w", "left").groupBy("t")
    found = found.agg(*[F.first(c).alias(c) for c in ("x", "y", "n")], *[F.max(F.when(F.col("at") == k, F.col("has"))).alias(c) for k, c in enumerate(words)]).drop("t")
    x, y, n = _columns(found.mapInPandas(_cut_features, "x array<double>, y double, n long"))
    joins = logistic(np.array(x, "f8"), y, n=n) if len(y) else np.zeros(9)

    if len(values):
        steps = [values[values[:, 0] == k, 1:] for k in range(int(values[:, 0].max()) + 1)]
        asked = [_steps_of_quantiles(v) for v in steps]

        def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = np.stack(b["x"].to_list())
                    some = [np.unique(v[np.isin(np.floor(v * GRID), near)], return_counts=True) for v, near in zip(x.T, asked)]
                    yield pd.DataFrame([([float(k), v], 0.0, n) for k, (vs, ns) in enumerate(some) for v, n in zip(vs.tolist(), ns.tolist())], columns=["x", "y", "n"])

        x, _, n = _columns(made.where("what = 'misread'").mapInPandas(fetch, "x array<double>, y double, n long"))
        exact = np.array([(*a, c) for a, c in zip(x, n)])
        cuts = [_quantiles(v, exact[exact[:, 0] == k, 1:]) for k, v in enumerate(steps)]

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"b": [row.tobytes() for row in binned(np.stack(b["x"].to_list()), cuts)], "y": b["y"]})

        placed = made.where("what = 'misread'").mapInPandas(place, "b binary, y double")
        placed = placed.groupBy("b", "y").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("b", "ascending"), ("y", "ascending")])
        bins = np.frombuffer(b"".join(placed["b"].to_pylist()), "u1").reshape(-1, len(cuts))
        y, n = placed["y"].to_numpy(), placed["n"].to_numpy().astype("f8")
        if 0 < y.sum() < len(y):
            ranker.trees.fit_counted(bins, y, n, cuts)
    return ranker, joins, fit_headers(headers if n_words else line_pairs([], SEED)), Counter(tally["gram"])


def _columns(rows: DataFrame) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """(x, y, n) of the different rows in order, with ``n`` summed."""
    found = sorted((tuple(r["x"]), r["y"], r["n"]) for r in rows.groupBy("x", "y").agg(F.sum("n").alias("n")).collect())
    return [x for x, _, _ in found], np.array([y for _, y, _ in found], "f8"), np.array([n for *_, n in found], "f8")


def _ranks(total: float) -> np.ndarray:
    """Places of the quantiles among ``total`` values in order, whole and fractional ones."""
    return np.linspace(0.05, 0.95, CUTS) * (total - 1)


def _steps_of_quantiles(steps: np.ndarray) -> np.ndarray:
    """Of ``steps`` in order (step, how often), those that hold a value on either side of a quantile."""
    below, at = steps[:, 1].cumsum(), np.floor(_ranks(steps[:, 1].sum()))
    return np.unique(steps[np.searchsorted(below, np.r_[at, np.minimum(at + 1, below[-1] - 1)], "right"), 0])


def _quantiles(steps: np.ndarray, exact: np.ndarray) -> np.ndarray:
    """The quantiles of all values, as ``np.quantile`` has them, from ``steps`` and the ``exact`` values (value, how often) of ``_steps_of_quantiles``, both in order."""
    below = dict(zip(steps[:, 0], steps[:, 1].cumsum() - steps[:, 1]))
    of = np.floor(exact[:, 0] * GRID)
    inside = exact[:, 1].cumsum() - exact[:, 1]  # values of exact before this one, then those of its own step alone, and of all steps before
    first = inside[np.searchsorted(of, of)]
    place = np.array([below[v] for v in of]) + inside - first
    at = _ranks(steps[:, 1].sum())
    low = np.floor(at)
    a, b = (exact[np.searchsorted(place, v, "right") - 1, 0] for v in (low, np.minimum(low + 1, steps[:, 1].sum() - 1)))
    t = at - low
    return np.unique(np.where(t < 0.5, a + (b - a) * t, b - (b - a) * (1 - t)))


def analyse(df: DataFrame, row_id: str, text: str, metadata: str) -> dict[str, DataFrame]:
    """The parts from which traces are reported and repaired: ``parsed`` pages, word ``counts`` of all rows, ``misread``
    words with corrections, ``furniture`` lines and ``cuts``."""
    schema = f"record_id {df.schema[row_id].dataType.simpleString()}, source string, page int, what string, at int, text string, shape string, numbers array<int>, alone boolean, set_off boolean"
    parsed = stage(_texts(df, row_id, text, metadata).mapInPandas(_parse, schema), "what")
    counts = stage(parsed.where("what = 'count'").groupBy(F.col("text").alias("w")).agg(F.sum(F.col("at").cast("long")).alias("n")))
    parsed = parsed.where("what <> 'count'")
    ranker, joins, headers, grams = fit_words(counts)
    return {
        "parsed": parsed,
        "counts": counts,
        "misread": stage(misread_words(counts, ranker)),
        "furniture": furniture(parsed.where("what = 'edge'"), (headers, fit_numbers()), grams),
        "cuts": cuts(parsed, counts, joins),
    }


def traces(df: DataFrame, row_id: str, text: str, metadata: str) -> DataFrame:
    """``(record_id, kind)``: pages with words cut at line ends ("hyphen"), misread words ("misread"), running headers ("header") and printed
    page numbers ("page_number").

    Rows without a ``page`` in their metadata, null and blank texts give nothing; without a ``source`` there are no
    headers. Repeated pages each give their traces, but a line must recur on a page of another number to be a header.
    """
    parts = analyse(df, row_id, text, metadata)
    words = parts["parsed"].where("what = 'words'").select("record_id", F.explode(F.split("text", "\n")).alias("w"))
    kinds: list[tuple[str, DataFrame]] = [
        ("hyphen", parts["cuts"]),
        ("misread", words.join(parts["misread"], "w")),
        ("header", parts["furniture"].where("header")),
        ("page_number", parts["furniture"].where("number")),
    ]
    out: DataFrame | None = None
    for kind, rows in kinds:
        rows = rows.select("record_id").distinct().withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumnRenamed("record_id", row_id)



def _repair_page(text: str, drop: set[int], cuts: dict[str, str], words: dict[str, str]) -> list[str]:
    """The paragraphs of a page: furniture dropped, cut words joined, misread words corrected, lines run on."""
    lines = [x for x in text.split("\n")]
    filled = [k for k, x in enumerate(lines) if x.strip()]
    gone = {filled[a - 1] if a > 0 else filled[a] for a in drop if -len(filled) <= a <= len(filled)}
    paragraphs, current = [], ""
    for k, line in enumerate(lines):
        if k in gone:
            continue
        if not line.strip():
            if current and not _open_end(current, cuts):
                paragraphs.append(current)
                current = ""
            continue
        line = line.strip()
        if current:
            current = current[:-1] + line if _open_end(current, cuts) else f"{current} {line}"
        else:
            current = line
    if current:
        paragraphs.append(current)

    def put_right(m: re.Match) -> str:
        token = m.group()
        tail = token[len(token.rstrip(")!")) :]
        good = words.get(token.lower().rstrip(")!"))
        if good is None:
            return token
        core = token[: len(token) - len(tail)]
        upper = sum(c.isupper() for c in core)
        return (good.upper() if upper > 1 and upper >= sum(c.islower() for c in core) else good.capitalize() if upper else good) + tail

    return [_TOKEN.sub(put_right, p) for p in paragraphs] if words else paragraphs


def _open_end(text: str, cuts: dict[str, str]) -> bool:
    """Whether ``text`` ends in a word that was cut there."""
    if len(text) < 2 or text[-1] not in HYPHENS or not text[-2].isalpha():
        return False
    return f"{text[-1]}{_LETTERS.findall(text)[-1].lower()}" in cuts


def repaired(df: DataFrame, row_id: str, text: str, metadata: str) -> DataFrame:
    """``(source, first_page, paragraph_no, last_page, text)``: the text of each paged source as continuous paragraphs.

    A page stored several times counts once (the smallest id). A paragraph runs on to the next page if it ends in a cut word or without the
    end of a sentence and the next page begins in lower case; it is numbered on the page where it begins. Pages without a
    source are left out. Blank pages give no paragraph.
    """
    parts = analyse(df, row_id, text, metadata)
    pages = pages_of(df, row_id, text, metadata).where("source IS NOT NULL")
    one = pages.groupBy("source", "page").agg(F.min("record_id").alias("record_id"))
    pages = pages.join(one.select("record_id"), "record_id", "left_semi")
    drop = parts["furniture"].groupBy("record_id").agg(F.collect_set("at").alias("drop"))
    cut = parts["cuts"].groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("text", "joined"))).alias("cut"))
    words = parts["parsed"].where("what = 'words'").select("record_id", F.explode(F.split("text", "\n")).alias("w")).join(parts["misread"], "w").distinct()
    words = words.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "correction"))).alias("words"))
    pages = pages.join(drop, "record_id", "left").join(cut, "record_id", "left").join(words, "record_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for source, page, body, drop, cut, words in zip(b["source"], b["page"], b["text"], b["drop"], b["cut"], b["words"]):
                cut = dict(cut) if cut is not None else {}
                found = _repair_page(body, set() if drop is None else set(map(int, drop)), cut, dict(words) if words is not None else {})
                for k, p in enumerate(found):
                    last = k == len(found) - 1
                    whole = _open_end(p, cut)
                    runs = last and (whole or not re.search(r"[.!?…:;)\]\"”’»]$", p))
                    rows.append((source, page, k, last, runs, p[:1].islower(), p[:-1] if whole else f"{p} " if last else p))
            yield pd.DataFrame(rows, columns=["source", "page", "k", "last", "runs", "low", "text"])

    done = stage(pages.mapInPandas(run, "source string, page int, k int, last boolean, runs boolean, low boolean, text string"))
    before = done.where("runs").select("source", (F.col("page") + 1).alias("page"), F.lit(True).alias("before"))
    state = done.groupBy("source", "page").agg(F.max(F.when(F.col("k") == 0, F.col("low"))).alias("low"), F.max("k").alias("most"))
    state = state.join(before.distinct(), ["source", "page"], "left").withColumn("goes_on", F.coalesce("before", F.lit(False)) & F.col("low"))
    # where a run of pages that share a paragraph begins: the last page up to this one at which a paragraph begins
    begins = ~F.col("goes_on") | (F.col("most") > 0)
    state = state.select("source", "page", "goes_on", F.when(begins, F.col("page")).alias("start"), F.floor(F.col("page") / 256).alias("block"))
    inside = Window.partitionBy("source", "block").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    state = state.withColumn("prior", F.last("start", ignorenulls=True).over(inside))
    blocks = state.groupBy("source", "block").agg(F.max("start").alias("top"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for 256 pages
    blocks = blocks.withColumn("carry", F.last("top", ignorenulls=True).over(earlier)).drop("top")
    state = state.join(blocks, ["source", "block"]).withColumn("from_page", F.coalesce("prior", "carry", "page"))
    most = done.groupBy("source", F.col("page").alias("from_page")).agg(F.max("k").alias("from_k"))
    rows = done.join(state.select("source", "page", "goes_on", "from_page"), ["source", "page"]).join(most, ["source", "from_page"], "left")
    on = F.col("goes_on") & (F.col("k") == 0)
    rows = rows.select("source", F.when(on, F.col("from_page")).otherwise(F.col("page")).alias("first_page"), F.when(on, F.col("from_k")).otherwise(F.col("k")).alias("paragraph_no"), "page", "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "")
    return rows.groupBy("source", "first_page", "paragraph_no").agg(F.max("page").alias("last_page"), F.rtrim(joined).alias("text"))
