"""The stateless operators on streams: nothing here needs a watermark or state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GREEK, SEED, SHARES, Alphabet
from ..functions import text as T


def normalized(stream: DataFrame, text: str = "text", alphabet: Alphabet = GREEK) -> DataFrame:
    """A stream (or table) of texts with ``normal`` and ``letters``."""
    return stream.withColumn("normal", T.normalize(text, alphabet)).withColumn("letters", T.count_letters("normal"))


def split(stream: DataFrame, key: str, shares: dict[str, float] = SHARES, seed: int = SEED) -> DataFrame:
    """A stream with the hashed ``split`` of a group key."""
    return stream.withColumn("split", T.hash_split(F.col(key).cast("string"), shares, seed))
