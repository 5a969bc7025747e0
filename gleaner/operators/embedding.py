"""Embedders: a deterministic one that needs no service, and an HTTP client.

An embedder has ``embed_column`` for plans and ``embed`` for a few texts on the
driver; both keep the order and give one vector per text.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from http.client import HTTPConnection, HTTPException, HTTPSConnection, RemoteDisconnected
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.errors import EmbedderError
from gleaner.functions.text import STOP_WORDS

BATCH = 64
MAX_CHARS = 30_000
_TERM = re.compile(r"[^\W_]+")


def batch_numbers(df: DataFrame, order: list[str], size: int = BATCH, group: list[str] | None = None) -> DataFrame:
    """Add ``batch``: rows of a group by ``order`` in runs of ``size``."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    place = F.row_number().over(Window.partitionBy(*(group or [])).orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(place / size))


@dataclass(frozen=True)
class HashingEmbedder:
    """Counts of terms by md5 bucket, scaled to length one. A text without terms is all zeros."""

    dim: int = 64
    name: str = "hashing"

    def vector(self, text: str | None) -> list[float]:
        counts = [0.0] * self.dim
        for term in _TERM.findall((text or "").lower()):
            if term not in STOP_WORDS:
                counts[int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % self.dim] += 1
        size = math.sqrt(sum(c * c for c in counts))
        return [c / size for c in counts] if size else counts

    def embed(self, texts: Iterable[str]) -> list[list[float]]:
        return [self.vector(t) for t in texts]

    def embed_column(self, text: Column) -> Column:
        @F.pandas_udf("array<float>")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([self.vector(t) for t in texts], dtype=object)

        return run(text)

    def health_check(self) -> None:
        return None


@dataclass
class HttpEmbedder:
    """Client of an embedding service with /api/tags and /api/embed.

    One connection serves all calls until ``close``; a task opens its own. A
    connection that the caller hands in is used as it is and never closed here.
    """

    url: str
    model: str
    dim: int
    batch_size: int = BATCH
    timeout: float = 60.0
    connection: HTTPConnection | None = None

    def __post_init__(self) -> None:
        if self.batch_size <= 0:
            raise ValueError("batch_size must be positive")
        self._own: HTTPConnection | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"connection": None, "_own": None}  # a socket stays where it was opened

    def __enter__(self) -> HttpEmbedder:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def close(self) -> None:
        if self._own is not None:
            self._own.close()
            self._own = None

    def _line(self) -> HTTPConnection:
        if self.connection is not None:
            return self.connection
        if self._own is None:
            at = urlsplit(self.url)
            self._own = (HTTPSConnection if at.scheme == "https" else HTTPConnection)(at.netloc, timeout=self.timeout)
        return self._own

    def _call(self, path: str, payload: dict | None = None) -> dict:
        body = None if payload is None else json.dumps(payload)
        for again in (True, False):
            line = self._line()
            kept = line.sock is not None
            try:
                line.request("GET" if body is None else "POST", urlsplit(self.url).path.rstrip("/") + path, body, {"Content-Type": "application/json"})
                answer = line.getresponse()
                content = answer.read()
                if answer.status != 200:
                    raise EmbedderError(f"embedding service at {self.url}: {answer.status} {answer.reason}")
                return json.loads(content)
            except (HTTPException, OSError, ValueError) as e:
                line.close()
                if not (again and kept and isinstance(e, (RemoteDisconnected, ConnectionError))):  # the service may have ended a line that was kept
                    raise EmbedderError(f"embedding service at {self.url}: {e}") from e
        raise AssertionError

    def health_check(self) -> None:
        """Raise unless the service answers and has the model, with or without a tag."""
        names = [m.get("name", "") for m in self._call("/api/tags").get("models", [])]
        if not any(self.model in (n, n.split(":")[0]) for n in names):
            raise EmbedderError(f"model {self.model!r} is not installed; run: ollama pull {self.model}")

    def embed(self, texts: Iterable[str]) -> list[list[float]]:
        texts = list(texts)
        for i, text in enumerate(texts):
            if len(text) > MAX_CHARS:
                raise EmbedderError(f"text {i} has {len(text)} characters, more than {MAX_CHARS}")
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch_size):
            some = texts[at : at + self.batch_size]
            out += self._checked(self._call("/api/embed", {"model": self.model, "input": some}), len(some))
        return out

    def _checked(self, answer: dict, expected: int) -> list[list[float]]:
        vectors = answer.get("embeddings")
        if not isinstance(vectors, list) or len(vectors) != expected:
            raise EmbedderError(f"expected {expected} embeddings")
        for i, v in enumerate(vectors):
            numbers = isinstance(v, list) and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v)
            if not numbers or len(v) != self.dim:
                raise EmbedderError(f"embedding {i} is not a list of {self.dim} numbers")
        return [[float(x) for x in v] for v in vectors]

    def embed_column(self, text: Column) -> Column:
        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            with self as client:
                for texts in batches:
                    yield pd.Series(client.embed(texts), dtype=object)

        return run(text)

    def verify_normalization(self) -> None:
        (v,) = self.embed(["probe"])
        if abs(math.sqrt(sum(x * x for x in v)) - 1) > 1e-3:
            raise EmbedderError("the model's vectors are not of length one")

    def warm_up(self) -> None:
        self.embed(["warm up"])
