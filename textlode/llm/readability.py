"""Reading level of documents by a latent difficulty model of the Rasch kind.

Every document has a level and every item - a word, or a length class of its sentences - a difficulty. An item occurs in a document of level
``t`` at the rate ``exp(ease + slope * t)``, as in Rasch's model of counts: hard items have a rising, easy ones a falling rate. The likelihood of a
document has the items that occur in it and those that don't: ``slopes * t - log(total rate at t)`` for each occurrence, where the total is over all
items, present or absent. Both sides have their maximum where observed and expected values meet, which makes the alternating steps short:

* a document's level is where the expected slope of an occurrence is the mean slope of its items (``Model.levels``);
* an item's slope is where the expected level of its occurrences is their mean level (``Model.fit``), of which a partition sends two sums an item.

Labelled documents are anchors. Levels are estimated inside each partition, given the broadcast slopes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.session import stage

#: Items are hashed into this many slots, so what is broadcast and collected has a fixed size (a few MB).
SLOTS = 1 << 18
#: Labelled documents that anchor the scale are at most so many (by hash of the id, if there are more).
LABELS = 50_000
ROUNDS, LEVELS = 3, 5
LENGTH_SHARE = 4  # a sentence's length class counts as one of so many of its words
UNLABELLED = 0.02  # what an estimated level counts as a witness, beside a label
PRIOR = 2.0  # occurrences at the mean level that every item is taken to have beside its own
#: Levels at which rates are tabulated, and the bins of levels in which occurrences are counted.
GRID = np.linspace(-1.0, LEVELS + 2.0, 401)
BINS = np.linspace(0.0, LEVELS + 1.0, 61)

_WORD = re.compile(r"[^\W\d_]+")
_BLANK = re.compile(r"\n\s*\n")
_TAG = re.compile(r"</?[a-z][^<>]{0,80}>")
_LEAD = re.compile(r"^\s*(?:[-*•>]+|\d+[.)]|[a-z]:)\s+")
_STOP = re.compile(r"[.!?…;]+(?=\s|$)|[。！？]")
_NOT_PROSE = re.compile(
    r"^\s*(?:\|.*\||[{}\[\]]|\"[^\"]*\"\s*:|#{1,6}\s|```|[-=*_]{3,}\s*$"  # tables, JSON, headings, rules
    r"|\[?\d{4}-\d\d-\d\d[t ]\d|\[?\d\d:\d\d(:\d\d)?|(?=(?:[^,]*,){2})(?!.*,\s)(?!.*[.!?](?:\s|$))"  # logs, comma-separated values
    r"|[\w.\-]+\s*=|at\s+[\w.$]+\(|[$>]\s)"  # settings, traces, commands
)


def prose_sentences(text: str) -> list[list[str]]:
    """The words of each sentence of the running prose: markup, tables, logs, code, headings and lines of under four
    words are left out; lines of a paragraph run on."""
    sentences: list[list[str]] = []
    for paragraph in _BLANK.split(_TAG.sub(" ", text.lower())):
        open_: list[str] = []
        for line in paragraph.split("\n"):
            if not line.strip() or _NOT_PROSE.match(line):
                continue
            lead = _LEAD.match(line)
            if lead and open_:  # a list item begins a new sentence
                sentences.append(open_)
                open_ = []
            parts = _STOP.split(line[lead.end() :] if lead else line)
            for k, part in enumerate(parts):
                open_ += _WORD.findall(part)
                if k < len(parts) - 1 and open_:
                    sentences.append(open_)
                    open_ = []
            if not parts[-1].strip() and len(parts) == 1:
                open_ = []
            if line[-1:].isspace() and open_:  # a line that was ended on purpose
                sentences.append(open_)
                open_ = []
        if open_:
            sentences.append(open_)
    return [s for s in sentences if len(s) >= 4]


class _Slot(dict):
    def __missing__(self, item: str) -> int:
        import xxhash

        slot = xxhash.xxh3_64_intdigest(item) % SLOTS
        if len(self) < 1_000_000:
            self[item] = slot
        return slot


def items_of(text: str, slots: dict) -> tuple[list[int], list[int], int]:
    """Slots and counts of a text's items, and its words of prose."""
    sentences = prose_sentences(text)
    counts: Counter = Counter(chain.from_iterable(sentences))
    total = sum(map(len, sentences))
    for words in sentences:
        counts[f"#{min(int(4 * np.log2(len(words))), 28)}"] += max(1, len(words) // LENGTH_SHARE)
    merged: Counter = Counter()
    for item, n in counts.items():
        merged[slots[item]] += n
    return list(merged), list(merged.values()), total


class Model:
    """Slopes of the items by slot (NaN where unknown), and the expected slope of an occurrence at each level of ``GRID``."""

    def __init__(self, slope: np.ndarray, expected: np.ndarray) -> None:
        self.slope, self.expected = slope, expected

    @classmethod
    def fit(cls, slots: np.ndarray, seen: np.ndarray, levels: np.ndarray, exposure: np.ndarray) -> Model:
        """From the occurrences of each slot, the sum of the levels they were at, and all occurrences by bin of level."""
        mean = float(exposure @ BINS / exposure.sum())
        # the expected level of an occurrence for each slope: it rises with the slope
        slopes = np.linspace(-6.0, 6.0, 1201)
        tilt = np.exp(slopes[:, None] * (BINS - mean)) * exposure
        total = tilt.sum(1)
        slope = np.interp((levels + PRIOR * mean) / (seen + PRIOR), tilt @ BINS / total, slopes)
        ease = np.log(seen) - np.interp(slope, slopes, np.log(total))
        rate, moved = np.zeros(len(GRID)), np.zeros(len(GRID))
        for i in range(0, len(slope), 8192):
            rates = np.exp(ease[i : i + 8192, None] + slope[i : i + 8192, None] * (GRID - mean))
            rate += rates.sum(0)
            moved += slope[i : i + 8192] @ rates
        out = np.full(SLOTS, np.nan)
        out[slots] = slope
        return cls(out, np.maximum.accumulate(moved / rate))

    def levels(self, starts: np.ndarray, slots: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The level of each document (a run of items from ``starts``), NaN where none of its items is known."""
        slope = self.slope[slots]
        known = ~np.isnan(slope)
        rows = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(slots))))[known]
        weight = np.sqrt(n[known])  # an item that recurs in a document is no new witness each time
        total = np.bincount(rows, weight, len(starts))
        mean = np.bincount(rows, weight * slope[known], len(starts)) / np.maximum(total, 1e-12)
        return np.where(total > 0, np.interp(mean, self.expected, GRID), np.nan)


def _flat(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = batch["slots"].map(len).to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype("i8")
    return starts, np.concatenate(batch["slots"].to_numpy()).astype("i8"), np.concatenate(batch["n"].to_numpy()).astype("f8")


def features(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """``(row_id, slots, n, n_words)`` of every row; no items for a text without prose or a null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = _Slot()
        for batch in batches:
            rows = [items_of(t, slots) if t else ([], [], 0) for t in batch["_t"]]
            yield pd.DataFrame({row_id: batch[row_id], "slots": [r[0] for r in rows], "n": [r[1] for r in rows], "n_words": [r[2] for r in rows]})

    kind = df.schema[row_id].dataType.simpleString()
    return df.select(row_id, F.col(text).alias("_t")).mapInPandas(run, f"`{row_id}` {kind}, slots array<int>, n array<int>, n_words int")


def _sums(rows: DataFrame, model: object | None) -> DataFrame:
    """By slot: occurrences and the sum of their levels; under -1 - k all occurrences in bin k of levels. Without a ``model`` of labelled documents
    only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, sums, exposure = np.zeros(SLOTS), np.zeros(SLOTS), np.zeros(len(BINS))
        for batch in batches:
            if not len(batch):
                continue
            starts, slots, n = _flat(batch)
            level = batch["label"].to_numpy("f8")
            witness = np.where(np.isnan(level), UNLABELLED, 1.0)
            if model is not None:
                level = np.where(np.isnan(level), np.clip(model.value.levels(starts, slots, n), 0.5, LEVELS + 0.5), level)
            row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(slots))))
            fine = ~np.isnan(level[row])
            s, v, w = slots[fine], level[row][fine], np.sqrt(n[fine]) * witness[row][fine]
            seen += np.bincount(s, w, SLOTS)
            sums += np.bincount(s, w * v, SLOTS)
            exposure += np.bincount(np.clip(np.rint(v / BINS[1]).astype(int), 0, len(BINS) - 1), w, len(BINS))
        at, bins = np.flatnonzero(seen), np.flatnonzero(exposure)
        yield pd.DataFrame({"slot": np.r_[at, -1 - bins], "w": np.r_[seen[at], exposure[bins]], "wv": np.r_[sums[at], np.zeros(len(bins))]})

    source = rows.where("label IS NOT NULL") if model is None else rows
    parts = source.select("slots", "n", "label").mapInPandas(run, "slot int, w double, wv double")
    return parts.groupBy("slot").agg(F.sum("w").alias("w"), F.sum("wv").alias("wv"))


def fit(rows: DataFrame) -> Model | None:
    """The model of rows of ``features`` with a ``label`` (null: not an anchor); None without any label."""
    context = rows.sparkSession.sparkContext
    model: Model | None = None
    for _ in range(ROUNDS + 1):
        shared = None if model is None else context.broadcast(model)
        sums = _sums(rows, shared).toPandas()  # at most SLOTS rows and one a bin
        if not len(sums):
            return None
        slot, w, wv = (sums[c].to_numpy() for c in ("slot", "w", "wv"))
        exposure = np.zeros(len(BINS))
        exposure[-1 - slot[slot < 0]] = w[slot < 0]
        model = Model.fit(slot[slot >= 0], w[slot >= 0], wv[slot >= 0], exposure)
        if shared is not None:
            shared.unpersist()
    return model


def thresholds(levels: np.ndarray, labels: np.ndarray) -> list[float]:
    """Where the levels pass from a label to the next, in ascending order: of the cuts with about the fewest misplaced labels that in the
    widest gap. Labels between the two - raters who differ - don't count."""
    cuts: list[float] = []
    order = np.argsort(levels)
    for k in range(1, LEVELS):
        clear = np.abs(labels[order] - (k + 0.5)) > 0.3
        x, above = levels[order][clear], labels[order][clear] > k + 0.5
        if not len(x) or above.all() or not above.any():
            cut = k + 0.5 if not len(x) else x[0] - 0.5 if above.all() else x[-1] + 0.5
        else:
            wrong = (~above).sum() + np.concatenate([[0], np.cumsum(np.where(above, 1, -1))])
            edges = np.concatenate([[x[0] - 0.1], (x[1:] + x[:-1]) / 2, [x[-1] + 0.1]])
            gaps = np.concatenate([[0.0], x[1:] - x[:-1], [0.0]])
            near = wrong <= wrong.min() + len(x) // 250
            cut = float(edges[np.where(near, gaps, -1.0).argmax()])
        cuts.append(max(float(cut), cuts[-1] if cuts else -np.inf))
    return cuts


def reading_levels(df: DataFrame, labels: DataFrame, row_id: str, text: str, label: str) -> DataFrame:
    """``(row_id, n_words, difficulty, level)``: ``difficulty`` on the latent scale, ``level`` 1 to 5 on that of the labels.

    ``labels`` has ``row_id`` and ``label`` (nulls are ignored, several raters averaged). Rows without running prose or whose
    items are all unknown have a null difficulty and level. Repeated rows get equal results. Without any label every level is null.
    """
    rows = features(df, row_id, text)
    given = labels.where(F.col(label).isNotNull() & F.col(row_id).isNotNull()).groupBy(row_id).agg(F.avg(label).alias("label"))
    given = stage(given)
    many = given.count()
    if many > LABELS:
        given = given.where(F.pmod(F.xxhash64(row_id), F.lit(1 << 30)) < int((1 << 30) * LABELS / many))
    rows = stage(rows.join(given, row_id, "left"))
    fitted = fit(rows.where(F.size("slots") > 0))
    if fitted is None:
        return rows.select(row_id, "n_words", F.lit(None).cast("double").alias("difficulty"), F.lit(None).cast("int").alias("level"))
    model = df.sparkSession.sparkContext.broadcast(fitted)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            level = np.full(len(batch), np.nan)
            some = np.flatnonzero(batch["slots"].map(len).to_numpy() > 0)
            if len(some):
                level[some] = model.value.levels(*_flat(batch.iloc[some]))
            yield batch[[row_id, "n_words", "label"]].assign(difficulty=level)

    kind = df.schema[row_id].dataType.simpleString()
    scored = rows.mapInPandas(score, f"`{row_id}` {kind}, n_words int, label double, difficulty double")
    scored = stage(scored.withColumn("difficulty", F.nanvl("difficulty", F.lit(None).cast("double"))))
    # a row for each labelled id, so about LABELS at most
    known = scored.where("label IS NOT NULL AND difficulty IS NOT NULL").groupBy(row_id).agg(F.avg("difficulty").alias("difficulty"), F.first("label").alias("label")).toPandas()
    if not len(known):
        return scored.select(row_id, "n_words", "difficulty", F.lit(None).cast("int").alias("level"))
    cuts = thresholds(known["difficulty"].to_numpy(), known["label"].to_numpy())
    level = sum((F.when(F.col("difficulty") > c, 1).otherwise(0) for c in cuts), F.lit(1))
    return scored.select(row_id, "n_words", "difficulty", F.when(F.col("difficulty").isNotNull(), level).cast("int").alias("level"))
