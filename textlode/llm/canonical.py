"""Records that differ only in formatting: a bottom-up hash of the record's structure.

Leaves are normalised to their letters and digits, case folded. A plain text is one leaf. A record of three or
more ``name: value`` lines, or one JSON object, is an unordered node: its children are (name, value) pairs whose
digests are sorted before the node is hashed. JSON arrays are ordered nodes, nested objects unordered ones.
Records may be nested to any depth and of any length.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlode.llm.components import components
from textlode.operators.skew import attach_group_min, attach_groups, join_to_one
from textlode.session import stage

_OTHER = re.compile(r"[\W_]+")


#: Letters whose upper case is that of other letters. Fixed values.
_SAME_CASE = [("ß", "ss"), ("ς", "σ"), ("ſ", "s"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")]


def letters_digits(c: Column) -> Column:
    """The letters and digits of ``c`` in order, case folded."""
    c = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    for a, b in _SAME_CASE:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _leaf(text: str) -> str:
    text = _OTHER.sub("", text.lower())
    if not text.isascii():
        for a, b in _SAME_CASE:
            text = text.replace(a, b)
    return text


class _Fields:
    """The fields of an object, repeated names included."""

    def __init__(self, pairs: list[tuple[str, object]]) -> None:
        self.pairs = pairs


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).hexdigest()


def _node(kind: str, children: list[tuple[str, str]]) -> tuple[str, str]:
    """(digest, full form) of a node; the children of an ``u``nordered node are sorted by digest."""
    if kind == "u":
        children = sorted(children)
    a, b = "{}" if kind == "u" else "[]"
    return _digest(kind + "".join(d for d, _ in children)), f"{a}{','.join(form for _, form in children)}{b}"


def _hash(value: object) -> tuple[str, str]:
    """(digest, full form) of a record of any depth, from its leaves up; fields without letters and digits don't count."""
    done: list[tuple[str, str]] = []  # hashed nodes that wait for their parent
    todo: list[tuple[str, object]] = [("", value)]
    while todo:
        kind, item = todo.pop()
        if kind:  # all children of a node are done: they are the last ``item``
            children = done[len(done) - item :]
            del done[len(done) - item :]
            if kind == "u":  # pairs of a name and its value
                pairs = [children[k : k + 2] for k in range(0, item, 2)]
                children = [_node("o", pair) for pair in pairs if any(form.strip("{}[],") for _, form in pair)]
            done.append(_node(kind, children))
        elif isinstance(item, _Fields):
            todo.append(("u", 2 * len(item.pairs)))
            for name, inner in reversed(item.pairs):
                todo += [("", inner), ("", name)]
        elif isinstance(item, list):
            todo.append(("o", len(item)))
            todo += [("", inner) for inner in reversed(item)]
        else:
            leaf = _leaf(item if isinstance(item, str) else "" if item is None else str(item))
            done.append((_digest(leaf), leaf))
    return done[0]


_JSON = re.compile(r'[ \t\r\n]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity))', re.S)
_END = re.compile(r"[ \t\r\n]*\Z")
_CONSTANTS = {"true": True, "false": False, "null": None}


def _parse_deep(text: str) -> object:
    """What ``json.loads`` gives, for values nested to any depth; ValueError if ``text`` is no JSON."""
    stack: list[tuple[str, list]] = []
    at, expect, value = 0, "value", None
    while True:
        m = _JSON.match(text, at)
        if m is None:
            raise ValueError("no JSON")
        at, (sign, string, plain) = m.end(), m.groups()
        if expect in ("value", "value or ]") and sign in ("{", "["):
            stack.append((sign, []))
            expect = "name or }" if sign == "{" else "value or ]"
            continue
        if expect in ("name", "name or }") and string:
            stack[-1][1].append(json.loads(string))
            expect = ":"
            continue
        if expect == ":" and sign == ":":
            expect = "value"
            continue
        if expect == "next" and sign == ",":
            expect = "name" if stack[-1][0] == "{" else "value"
            continue
        if expect in ("value", "value or ]") and (string or plain):
            value = json.loads(string) if string else _CONSTANTS.get(plain, plain)
        elif sign in ("}", "]") and stack and expect in ("next", "name or }", "value or ]") and (sign == "}") == (stack[-1][0] == "{"):
            inner = stack.pop()[1]
            value = _Fields(list(zip(inner[::2], inner[1::2]))) if sign == "}" else inner
        else:
            raise ValueError("no JSON")
        if not stack:
            if not _END.match(text, at):
                raise ValueError("more than one value")
            return value
        stack[-1][1].append(value)
        expect = "next"


def _parse(text: str) -> object:
    try:
        return json.loads(text, object_pairs_hook=_Fields, parse_int=str, parse_float=str, parse_constant=str)
    except RecursionError:
        return _parse_deep(text)


def fields_of(text: str) -> _Fields | None:
    """The fields of a record of ``name: value`` lines or of one JSON object; None for any other text.

    A name is what stands before a line's first colon, of any length, and has a letter or digit. Lines without letters and digits
    don't count. Names may recur: each keeps its values.
    """
    body = text.strip()
    if body.startswith("{"):
        try:
            value = _parse(body)
        except ValueError:
            value = None
        if isinstance(value, _Fields):
            return value if value.pairs else None
    pairs: list[tuple[str, object]] = []
    for line in body.splitlines():
        if not _OTHER.sub("", line):
            continue
        name, colon, value = line.partition(":")
        if not colon or not _OTHER.sub("", name):
            return None
        pairs.append((name, value))
    return _Fields(pairs) if len(pairs) >= 3 else None


def structure(text: str) -> tuple[str, str] | None:
    """(root digest, full form) of a record with named fields, None for plain text or a record without content."""
    found = fields_of(text)
    if found is None:
        return None
    digest, form = _hash(found)
    return (digest, form) if form.strip("{}[],") else None


@F.pandas_udf(T.StructType([T.StructField("digest", T.StringType()), T.StructField("form", T.StringType())]))
def _structure(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for series in texts:
        rows = [structure(t) if t is not None else None for t in series]
        yield pd.DataFrame({"digest": [r and r[0] for r in rows], "form": [r and r[1] for r in rows]})


def same_but_for_formatting(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """``(row_id, kept, copies)`` for each row that has equals: ``kept`` is the smallest id of the group.

    Two rows are equal if their letters and digits agree in order, or if both are records with named fields and
    have the same fields in any order; groups are closed under both. Rows whose text is null or has no letter or digit
    belong to no group. Exact copies count, rows with the same id too. Before rows are grouped by a digest, what was hashed is compared in
    full (``_confirmed``).
    """
    # no less than fields_of takes: an object, or lines with colons, of any kind of line ends
    end = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
    line = rf":[^{end}]*+[{end}][^:]*+"
    may_have_fields = F.col("t").rlike(r"^[\s\p{Z}\x1c-\x1f\x85]*\{") | F.col("t").rlike(rf"\A[^:]*+{line}{line}:")
    forms = (
        df.select(F.col(row_id).alias("i"), F.col(text).alias("t"))
        .select("i", letters_digits(F.col("t")).alias("plain"), _structure(F.when(may_have_fields, F.col("t"))).alias("s"))
        .where(F.length("plain") > 0)
        .select("i", "plain", F.col("s.form").alias("form"), F.unhex(F.md5("plain")).alias("p"), F.unhex(F.col("s.digest")).alias("s"))
    )
    forms = stage(forms.withColumn("r", F.monotonically_increasing_id()))
    keys = forms.select("i", "r", "p", "s")
    for digest, whole in (("p", "plain"), ("s", "form")):
        keys = _confirmed(keys, forms, digest, whole)
    keys = stage(keys)
    # a plain text with the letters and digits of a record joins that record's group
    by_plain = stage(keys.where("s IS NOT NULL").groupBy("p").agg(F.min("s").alias("s_min"), F.max("s").alias("s_max")))
    merged = by_plain.where("s_min <> s_max")
    roots = join_to_one(keys, by_plain.select("p", "s_min"), "p", "left").withColumn("root", F.coalesce("s", "s_min", "p"))
    if not merged.isEmpty():  # letters and digits alone tie several structures together
        edges = keys.join(merged.select("p", "s_min"), "p").where("s <> s_min").select(
            F.hex("s").alias("a"), F.hex("s_min").alias("b")
        ).distinct()
        joined = components(edges)
        roots = roots.join(joined.select(F.unhex("node").alias("root"), F.unhex("component").alias("_c")), "root", "left")
        roots = roots.withColumn("root", F.coalesce("_c", "root"))
    return attach_group_min(roots.select("i", "root"), "root", "i").select(F.col("i").alias(row_id), "kept", "copies")


def _confirmed(keys: DataFrame, forms: DataFrame, digest: str, whole: str) -> DataFrame:
    """``keys`` (i, r, p, s), where every row that shares its ``digest`` was compared with the first such row on all of ``whole``.

    So each tie that a group is made of is confirmed, also between rows that only others tie together. A row that differs
    (digests of different texts met) gets the 512-bit digest of its own instead. Only rows that share a digest send their text, once;
    the rows of a large group meet the first one in an inner join, whose partitions Spark splits where they are too large.
    """
    named = attach_groups(keys.select("r", digest), digest, "r", {"a": F.min("r")}, "_n > 1").where("a <> r").select("r", "a")
    # texts are never broadcast: stored small, they may be large
    own = named.join(forms.select("r", F.col(whole).alias("own")).hint("merge"), "r")
    first = forms.select(F.col("r").alias("a"), F.col(whole).alias("first")).hint("merge")
    differs = stage(own.join(first, "a").where("own <> first").select("r", F.unhex(F.sha2("own", 512)).alias("other")))
    if differs.isEmpty():
        return keys
    return keys.join(differs, "r", "left").withColumn(digest, F.coalesce("other", digest)).drop("other")


def same_digest(df: DataFrame, row_id: str, digest: str) -> DataFrame:
    """``(row_id, kept, copies)`` for rows whose ``digest`` agrees in its letters and digits with another row's; rows
    without any belong to no group."""
    rows = df.select(F.col(row_id), F.nullif(letters_digits(F.col(digest)), F.lit("")).alias("_norm"))
    return attach_group_min(rows, "_norm", row_id).select(row_id, "kept", "copies")
