"""Vectors for texts: a local hashed embedding, or any callable, in Arrow batches."""

from __future__ import annotations

import math
import re
import time
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")


def hashed_vector(text: str | None, size: int = 64) -> list[float]:
    """Signed counts of hashed words, of length one; zeros without words."""
    out = [0.0] * size
    for word in WORD.findall((text or "").lower()):
        h = zlib.crc32(word.encode())
        out[h % size] += 1.0 if h >> 31 else -1.0
    whole = math.sqrt(sum(x * x for x in out))
    return [x / whole for x in out] if whole else out


def with_retries(call: Callable, tries: int = 3, base: float = 1.0) -> Callable:
    """The callable, asked again with growing pauses."""

    def asked(*args):
        for k in range(tries):
            try:
                return call(*args)
            except Exception:
                if k + 1 == tries:
                    raise
                time.sleep(base * 2**k)

    return asked


def embedded(text: Column, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]] | None = None, size: int = 64) -> Column:
    """A vector column; embed takes a batch of texts."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = with_retries(embed) if embed else lambda texts: [hashed_vector(t, size) for t in texts]
        for batch in batches:
            yield pd.Series([list(map(float, v)) for v in ask(batch.tolist())])

    return run(text)


class QueryCache:
    """The vectors of the last queries, each for a while."""

    def __init__(self, embed: Callable[[str], Sequence[float]], most: int = 1000, seconds: float = 3600):
        self.embed, self.most, self.seconds = embed, most, seconds
        self.kept: OrderedDict[str, tuple[float, Sequence[float]]] = OrderedDict()

    def __call__(self, text: str) -> Sequence[float]:
        now = time.monotonic()
        if text in self.kept and now - self.kept[text][0] < self.seconds:
            self.kept.move_to_end(text)
            return self.kept[text][1]
        self.kept[text] = now, self.embed(text)
        self.kept.move_to_end(text)
        while len(self.kept) > self.most:
            self.kept.popitem(last=False)
        return self.kept[text][1]
