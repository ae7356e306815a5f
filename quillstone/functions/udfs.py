"""What Spark has no function for, as Arrow-batched pandas UDFs: Unicode forms, matching-blocks similarity, models.

Models are pluggable: a callable from a list of texts to vectors, scores or texts. What stands in for them offline is
deterministic and needs no files.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _per_value(f: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def normal_form(text: Column, form: str = "NFC", fold: bool = False) -> Column:
    """A Unicode normal form; fold: case folded too."""
    return _per_value(lambda x: unicodedata.normalize(form, x).casefold() if fold else unicodedata.normalize(form, x))(text)


def similarity(a: Column, b: Column) -> Column:
    """2 M / T with M characters in matching blocks of T characters; null where either is."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[np.ndarray]]:
    """Signed counts of words hashed into dim places, of length 1: the stand-in for an embedding model."""

    def embed(texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1 if h >> 63 else -1
            size = float(np.linalg.norm(v))
            out.append(v / size if size else v)
        return out

    return embed


#: Providers by name: each makes a model once for every Python worker.
EMBEDDERS: dict[str, Callable[[], Callable[[list[str]], list[np.ndarray]]]] = {"local": hashing_embedder}


def embed(text: Column, provider: str = "local", batch: int = 64) -> Column:
    """array<float> for each text; null for null and blank texts. A provider that isn't registered is an error."""
    if provider not in EMBEDDERS:
        raise ValueError(f"unknown embedding provider: {provider}")
    make = EMBEDDERS[provider]

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in series:
            usable = [i for i, t in enumerate(s) if isinstance(t, str) and t.strip()]
            out: list = [None] * len(s)
            for at in range(0, len(usable), batch):
                part = usable[at : at + batch]
                for i, v in zip(part, model([s.iloc[j] for j in part]), strict=True):
                    out[i] = np.asarray(v, np.float32)
            yield pd.Series(out)

    return run(text)


def generate(prompt: Column, make: Callable[[], Callable[[list[str]], list[str]]]) -> Column:
    """A language model's replies; null where it fails, so that callers fall back by coalesce."""

    @F.pandas_udf("string")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in series:
            out = []
            for p in s:
                try:
                    out.append(None if p is None else model([p])[0])
                except Exception:  # noqa: BLE001  a model's failure is one row's
                    out.append(None)
            yield pd.Series(out, dtype="object")

    return run(prompt)
