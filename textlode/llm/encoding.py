"""Text decoded with the wrong character encoding: which records, through which chain, and the text before.

A multinomial classifier over hashed byte bigrams tells correct tokens from those garbled by each known chain of encodings, and from those that lost
characters when they were decoded. It is trained on tokens of the table itself, garbled here through every chain they can pass. A token that it gives
to a chain is taken back through it, and counts as garbled only if that decodes strictly and gives likelier text. What the tokens of a text
say of a chain is summed: the text is garbled if that is evidence enough.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.session import ship

#: Tokens that the classifier is fitted on at most: the commonest of all tokens with characters beyond ASCII.
TOKENS = 50_000
BUCKETS = 1 << 15
#: (encoding of the bytes, encoding they were read with), applied from left to right. Fixed values.
CHAINS: list[tuple[tuple[str, str], ...]] = [
    (("utf-8", "cp1252"),),
    (("utf-8", "latin-1"),),
    (("utf-8", "mac_roman"),),
    (("utf-8", "cp437"),),
    (("utf-8", "cp850"),),
    (("utf-8", "cp852"),),
    (("utf-8", "cp866"),),
    (("utf-8", "cp1250"),),
    (("utf-8", "cp1251"),),
    (("utf-8", "cp1253"),),
    (("utf-8", "koi8-r"),),
    (("utf-8", "iso8859-2"),),
    (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    (("utf-8", "cp1251"), ("utf-8", "cp1251")),
    (("cp1252", "latin-1"),),
    (("cp1252", "cp1250"),),
    (("cp1252", "cp1251"),),
    (("cp1252", "cp437"),),
    (("cp1252", "cp850"),),
    (("cp1252", "mac_roman"),),
    (("cp1252", "koi8-r"),),
    (("cp1250", "cp1252"),),
    (("cp1250", "latin-1"),),
    (("cp1250", "cp1251"),),
    (("iso8859-2", "cp1252"),),
    (("iso8859-2", "cp1250"),),
    (("cp1250", "iso8859-2"),),
    (("cp852", "cp1252"),),
    (("cp852", "cp1250"),),
    (("cp1251", "cp1252"),),
    (("cp1251", "cp1250"),),
    (("cp1251", "koi8-r"),),
    (("cp1251", "cp866"),),
    (("cp1251", "mac_roman"),),
    (("koi8-r", "cp1251"),),
    (("koi8-r", "cp1252"),),
    (("cp866", "cp1251"),),
    (("cp866", "cp1252"),),
    (("mac_roman", "cp1252"),),
    (("cp437", "cp1252"),),
    (("cp850", "cp1252"),),
    (("cp1253", "cp1252"),),
    (("gbk", "cp1252"),),
    (("shift_jis", "cp1252"),),
    (("utf-8", "gbk"),),
    (("utf-8", "shift_jis"),),
]
NAMES = [" + ".join(f"{a} read as {b}" for a, b in chain) for chain in CHAINS]
_MULTIBYTE = {"utf-8", "gbk", "shift_jis"}
_TOKEN = re.compile(r"[^ \t\r\n]*[^\x00-\x7f \t\r\n][^ \t\r\n]*")
#: Prior odds against a garbled token, and what taking a token back must gain per byte bigram, in nats.
PRIOR, GAIN, SURE = 4.0, 0.5, 12.0
#: What the different words of a text must say together, in nats, for a chain between one-byte encodings: those only exchange letters for others.
EVIDENCE = 24.0
LOSSY = len(CHAINS) + 1  # the class of tokens that lost characters
_EDGE = re.compile(r"^[\x00-\x2f:-@\[-`{-~‘’“”‚„–—…€«»¿¡]+|[\x00-\x2f:-@\[-`{-~‘’“”‚„–—…€«»¿¡]+$")
_PROVES = [any(step[0] in _MULTIBYTE for step in chain) for chain in CHAINS]


class _Codec:
    """A codec whose undefined bytes stand for the control characters of the same number, as common decoders have it."""

    def __init__(self, name: str) -> None:
        self.name = name
        if name not in _MULTIBYTE:
            self.table = [bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)]
            self.back = {c: b for b, c in reversed(list(enumerate(self.table)))}

    def encode(self, text: str) -> bytes | None:
        if self.name in _MULTIBYTE:
            try:
                return text.encode(self.name)
            except UnicodeEncodeError:
                return None
        try:
            return bytes([self.back[c] for c in text])
        except KeyError:
            return None

    def decode(self, data: bytes) -> str | None:
        if self.name in _MULTIBYTE:
            try:
                return data.decode(self.name)
            except UnicodeDecodeError:
                return None
        return "".join([self.table[b] for b in data])


_codecs: dict[str, _Codec] = {}


def _codec(name: str) -> _Codec:
    if name not in _codecs:
        _codecs[name] = _Codec(name)
    return _codecs[name]


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """``text`` as it looks after the chain; None if it can't pass it or passes unchanged."""
    out: str | None = text
    for right, wrong in chain:
        data = _codec(right).encode(out)
        out = None if data is None else _codec(wrong).decode(data)
        if out is None:
            return None
    return out if out != text else None


def restore(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """``text`` taken back through the chain, None unless every step encodes and decodes strictly, to printable text that
    garbles to ``text`` again."""
    out: str | None = text
    for right, wrong in reversed(chain):
        data = _codec(wrong).encode(out)
        out = None if data is None else _codec(right).decode(data)
        if out is None:
            return None
    if out == text or any("\x7f" <= c <= "\x9f" for c in out) or "�" in out:
        return None
    return out if garble(out, chain) == text else None


def _bigrams(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte bigrams of all tokens, and the token each belongs to."""
    data = [b" " + t.encode("utf-8", "replace") + b" " for t in tokens]
    flat = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(data)), np.array([len(d) for d in data], dtype=int))
    pair = (flat[:-1] << 8) | flat[1:]
    keep = (owner[:-1] == owner[1:]) & ((flat[:-1] >= 128) | (flat[1:] >= 128))  # bigrams of ASCII alone say nothing
    return ((pair * np.uint32(2654435761)) >> np.uint32(17))[keep], owner[:-1][keep]


class Model:
    """Log probabilities of bigram buckets by class; class 0 is correct text, class k the chain ``CHAINS[k - 1]``, the last one text that lost
    characters."""

    def __init__(self, logs: np.ndarray) -> None:
        self.logs = logs

    def scores(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (tokens x classes) and the number of bigrams of each token."""
        bucket, owner = _bigrams(tokens)
        out = np.zeros((len(tokens), self.logs.shape[0]))
        np.add.at(out, owner, self.logs[:, bucket].T)
        out[:, 0] += PRIOR
        return out, np.bincount(owner, minlength=len(tokens))

    def judge(self, token: str) -> tuple[int, str | None, float]:
        """(class, text before, lead over correct text) of a token; class 0 for correct ones, and no text if it can't be had back."""
        scores, n = self.scores([token])
        scores, n = scores[0], max(1, int(n[0]))
        own = (scores[0] - PRIOR) / n
        order = np.argsort(-scores, kind="stable")
        for k in order:
            if k == 0:
                return 0, None, 0.0
            if k == LOSSY:
                if "�" in token:
                    return LOSSY, None, float(scores[k] - scores[0])
                continue
            back = restore(token, CHAINS[k - 1])
            if back is not None and not back.isascii():
                s, m = self.scores([back])
                if (s[0, 0] - PRIOR) / max(1, int(m[0])) > own + GAIN:
                    return int(k), back, float(scores[k] - scores[0])
        best = order[0]
        lead = float(scores[best] - scores[0])
        return (int(best), None, lead) if best and lead > SURE else (0, None, 0.0)

    def read(self, text: str, known: dict) -> dict[str, tuple[int, str | None, float]]:
        """The garbled tokens of a text. A decoding from several bytes a character proves itself in one token; chains
        between one-byte encodings only exchange letters, so the different words of the text must be evidence together."""
        count = Counter(_TOKEN.findall(text))
        found, by_class = {}, {}
        for token in count:
            verdict = known.get(token)
            if verdict is None:
                verdict = self.judge(token)
                if len(known) < 500_000:
                    known[token] = verdict
            if verdict[0]:
                found[token] = verdict
                if verdict[0] != LOSSY and not _PROVES[verdict[0] - 1]:
                    by_class.setdefault(verdict[0], []).append(token)
        if by_class:
            swapped = [t for tokens in by_class.values() for t in tokens]
            # common marks at a word's edge are too easily taken for something else; a word counts once, whatever stands beside it
            telling = [t for t in swapped if not _EDGE.sub("", t).isascii()]
            words: dict[str, float] = {}
            for t in telling:
                word = _EDGE.sub("", t).lower()
                words[word] = max(words.get(word, 0.0), found[t][2])
            if sum(words.values()) < EVIDENCE:
                for t in swapped:
                    del found[t]
            else:  # the text's main chain decides between chains that a single token can't tell apart
                weight: Counter = Counter()
                for t in telling:
                    weight[found[t][0]] += count[t] * found[t][2]
                main = max(weight, key=lambda c: (weight[c], c))
                for t in swapped:
                    back = restore(t, CHAINS[main - 1])
                    if back is not None and not back.isascii():
                        found[t] = (main, back, found[t][2])
                    elif t not in telling:
                        del found[t]
        return found


def _train(clean: list[str], weights: np.ndarray) -> Model:
    counts = np.zeros((len(CHAINS) + 2, BUCKETS))
    bucket, owner = _bigrams(clean)
    counts[0] += np.bincount(bucket, weights[owner], BUCKETS)
    for k, chain in enumerate(CHAINS, 1):
        bad = [(g, w) for t, w in zip(clean, weights) if (g := garble(t, chain)) is not None and restore(g, chain) == t]
        if bad:
            bucket, owner = _bigrams([g for g, _ in bad])
            counts[k] += np.bincount(bucket, np.array([w for _, w in bad])[owner], BUCKETS)
    lost = [(x, w) for t, w in zip(clean, weights) for x in {re.sub(r"[^\x00-\x7f]", "�", t), re.sub(r"[^\x00-\x7f]", "�", t, count=1)}]
    if lost:
        bucket, owner = _bigrams([x for x, _ in lost])
        counts[LOSSY] += np.bincount(bucket, np.array([w for _, w in lost])[owner], BUCKETS)
    smooth = counts + 0.02
    return Model(np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype("f4"))


def fit(count: dict[str, int], rounds: int = 2) -> Model:
    """A model fitted on tokens, with the number of texts that have each, which are mostly correct. Tokens that a chain takes back to a much
    commoner token are not taken for correct ones, nor, in the next round, are those that the model finds garbled."""
    words: Counter = Counter()
    core = re.compile(r"^\W+|\W+$")
    for token, n in count.items():
        words[core.sub("", token)] += n

    def suspicious(token: str) -> bool:
        if "�" in token or any("\x80" <= c <= "\x9f" for c in token):
            return True
        for chain in CHAINS:
            back = restore(token, chain)
            if back is not None and not back.isascii() and words.get(core.sub("", back), 0) > 2 * words[core.sub("", token)]:
                return True
        return False

    clean = [t for t in count if not suspicious(t)]
    for k in range(rounds):
        model = _train(clean, np.array([min(count[t], 200.0) for t in clean]))
        if k < rounds - 1:
            clean = [t for t in clean if model.judge(t)[0] == 0]
    return model


def token_counts(df: DataFrame, text: str) -> DataFrame:
    """``(token, n)``: the texts that have each token with characters beyond ASCII, over all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: Counter = Counter()
        for batch in batches:
            for body in batch["t"]:
                count.update(set(_TOKEN.findall(body)))
            if len(count) > 300_000:
                yield pd.DataFrame({"token": list(count), "n": list(count.values())})
                count = Counter()
        if count:
            yield pd.DataFrame({"token": list(count), "n": list(count.values())})

    rows = df.select(F.col(text).alias("t")).where(F.col("t").rlike(r"[^\x00-\x7f]"))
    return rows.mapInPandas(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def fit_table(df: DataFrame, text: str) -> Model:
    """The model of the ``TOKENS`` commonest tokens of all rows."""
    common = token_counts(df, text).orderBy(F.desc("n"), "token").limit(TOKENS)
    return fit({r["token"]: r["n"] for r in common.collect()})


def garbled(df: DataFrame, row_id: str, text: str, model: Model | None = None) -> DataFrame:
    """``(row_id, chain, n_tokens, n_restored, restored)`` of every row with garbled text.

    ``chain`` is the one most of its garbled tokens went through ("lossy" if they can't be had back); ``restored`` is
    the text with each token put right where that is possible. Null, empty and correct rows don't come out. Repeated rows come out each. A table
    without a garbled row gives none.
    """
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model or fit_table(df, text))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = shared.value, {}
        for batch in batches:
            rows = []
            for key, body in zip(batch["i"], batch["t"]):
                found = model.read(body, known)
                if not found:
                    continue
                votes: Counter = Counter()
                fixed = 0
                for token in _TOKEN.findall(body):
                    if token in found:
                        votes[found[token][0]] += 1
                        fixed += found[token][1] is not None
                after = _TOKEN.sub(lambda m: (found.get(m.group()) or (0, None))[1] or m.group(), body)  # noqa: B023
                best = max(votes, key=lambda c: (votes[c], c))
                rows.append((key, "lossy" if best == LOSSY else NAMES[best - 1], sum(votes.values()), fixed, after))
            yield pd.DataFrame(rows, columns=["i", "chain", "n_tokens", "n_restored", "restored"])

    kind = df.schema[row_id].dataType.simpleString()
    rows = df.select(F.col(row_id).alias("i"), F.col(text).alias("t")).where(F.col("t").rlike(r"[^\x00-\x7f]"))
    out = rows.mapInPandas(run, f"i {kind}, chain string, n_tokens int, n_restored int, restored string")
    return out.withColumnRenamed("i", row_id)
