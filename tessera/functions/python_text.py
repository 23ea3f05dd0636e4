"""Text functions that the built-in ones cannot express, as Arrow-batched UDFs."""

from __future__ import annotations

import posixpath
import re
import unicodedata
from functools import lru_cache
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal(text: str) -> str:
    """Compatibility form, lower case, only a-z and 0-9."""
    return re.sub(r"[^a-z0-9]", "", unicodedata.normalize("NFKD", text).lower())


def needles(title: str) -> list[str]:
    """What a page that opens a chapter may show: its last part, with and without numbering."""
    last = title.split(">")[-1].strip()
    bare = re.sub(r"^(?:(?:chapter|part|section)\s+)?[\divxlc]+[.:)\-\s]+", "", last, flags=re.I)
    return list(dict.fromkeys(n for n in map(normal, (last, bare)) if len(n) >= 6))


@F.pandas_udf(T.StringType())
def normalize(text: pd.Series) -> pd.Series:
    return text.map(lambda t: normal(t) if t is not None else None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def title_needles(title: pd.Series) -> pd.Series:
    return title.map(lambda t: needles(t) if t is not None else [])


@lru_cache(maxsize=10_000)
def resolve(href: str, folder: str) -> str:
    """A package path: no fragment, percent-decoded where that is valid, normalised."""
    path = href.split("#")[0]
    try:
        decoded = unquote_to_bytes(path).decode()
        path = path if re.search(r"%(?![0-9a-fA-F]{2})", path) else decoded
    except UnicodeDecodeError:
        pass
    return posixpath.normpath(posixpath.join(folder, path)) if path else ""


def signature_pages(text: str, signatures: list[str], least: int = 50) -> list[str]:
    """A text cut where each page's first words occur, at least ``least`` after the page before.

    Pages whose signature is missing share the room up to the next found one evenly.
    """
    n = len(signatures)
    if not n:
        return []
    starts: list[int | None] = [0] * min(n, 1)
    last = 0
    for s in signatures[1:]:
        at = text.find(s, last + least) if s else -1
        starts.append(at if at >= 0 else None)
        last = at if at >= 0 else last
    known = [k for k, v in enumerate(starts) if v is not None]
    for a, b in zip(known, [*known[1:], n], strict=True):
        end = starts[b] if b < n else len(text)
        for k in range(a + 1, b):
            starts[k] = starts[a] + (end - starts[a]) * (k - a) // (b - a)
    return [text[a:b].strip() for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_by_signatures(text: pd.Series, signatures: pd.Series) -> pd.Series:
    """``signature_pages`` by row; null without a text."""
    return pd.Series([None if t is None else signature_pages(t, [x or "" for x in s] if s is not None else []) for t, s in zip(text, signatures, strict=True)])
