"""Embeddings of labels: cosine similarity and a hashing embedder."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

DIMENSIONS = 384


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty vectors, unequal lengths or a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable, F.coalesce(F.try_divide(dot(a, b), norm), F.lit(0.0))).otherwise(F.lit(0.0))


def hashed_trigrams(text: str | None) -> np.ndarray:
    """Unit vector of character trigrams, each counted at a hash of its bytes."""
    vector = np.zeros(DIMENSIONS)
    padded = f"  {re.sub(r'\\s+', ' ', (text or '').lower().strip())}  "
    for i in range(len(padded) - 2):
        digest = hashlib.blake2b(padded[i : i + 3].encode(), digest_size=4).digest()
        vector[int.from_bytes(digest, "big") % DIMENSIONS] += 1.0
    return vector / (np.sqrt((vector * vector).sum()) or 1.0)


@F.pandas_udf(ArrayType(FloatType()))
def embed(texts: pd.Series) -> pd.Series:
    """The hashing embedder over a column; any other embedder of this shape can take its place."""
    return texts.map(lambda t: hashed_trigrams(t).astype(np.float32))
