"""Scalar text functions of chunk preparation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's ``str.strip`` removes. Fixed value.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """``c`` without white space of any script at its ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def clean_text(c: Column) -> Column:
    """``c`` without U+0000. (Lone surrogates can't be in a Spark string; loaders drop them.)"""
    return F.replace(c, F.lit("\x00"), F.lit(""))


def digest(c: Column) -> Column:
    """MD5 of the UTF-8 bytes, in hexadecimal; null of null."""
    return F.md5(c)


def store_id(file_id: Column, own_digest: Column, text: Column) -> Column:
    """``{file}_{digest}``, with the digest of the text where none is given; null without a file."""
    return F.concat(file_id, F.lit("_"), F.coalesce(F.nullif(own_digest, F.lit("")), F.md5(text)))


def basename(source: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(source, "/", -1)


def drop_surrogates(text: str) -> str:
    """``text`` without characters that UTF-8 can't encode; for loaders, before text reaches Spark."""
    return text.encode("utf-8", "ignore").decode("utf-8")


def batch_count(total: int, size: int) -> int:
    """Batches needed for ``total`` items: 0 for none, 1 if ``size`` sets no limit."""
    if total <= 0:
        return 0
    return 1 if size <= 0 else math.ceil(total / size)
