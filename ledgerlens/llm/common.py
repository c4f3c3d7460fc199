"""Helpers shared by the training-data operators."""

from __future__ import annotations

import codecs
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.shared import discard, materialize

__all__ = ["discard", "materialize"]

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that the operator is about to add; a clash is resolved in favour of the operator."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def id_crc(col: str) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def _letter_classes() -> np.ndarray:
    """Class of every code point: 0 no letter, 1-26 a-z, 27-63 any other letter by lower-case code."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for cp in range(len(table)):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            code = ord(low[0])
            table[cp] = code - 96 if 97 <= code <= 122 else 27 + code % 37
    return table


_CLASSES: np.ndarray | None = None
_CODES: np.ndarray | None = None
N_GRAMS = 1 << 18


def classes(text: str) -> np.ndarray:
    """Letter class of each code point of text."""
    global _CLASSES
    if _CLASSES is None:
        _CLASSES = _letter_classes()
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    return _CLASSES[codes]


def letter_codes(text: str) -> np.ndarray:
    """Lower-case code point of each letter of text; 0 for what is no letter."""
    global _CODES
    if _CODES is None:
        _CODES = np.array([ord(chr(cp).lower()[0]) if chr(cp).isalpha() else 0 for cp in range(sys.maxunicode + 1)], np.uint32)
    return _CODES[np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")]


def trigrams(cls: np.ndarray) -> np.ndarray:
    """18-bit codes of consecutive letter-class triples, as long as cls (padded by non-letters in front)."""
    c = cls.astype(np.int32)
    a = np.concatenate((np.zeros(2, np.int32), c))
    return (a[:-2] << 12) | (a[1:-1] << 6) | c


#: Bytes of text that the operators look at together.
BLOCK = 1 << 20


def text_blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """(start, end) runs of a binary array of at most limit bytes, or of one text."""
    start = size = 0
    for i, n in enumerate(np.diff(_offsets(texts)).tolist()):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)


def text_bytes(texts: pa.Array, i: int) -> memoryview:
    """A text of a binary array without a copy; a null is empty."""
    at, data = _offsets(texts), texts.buffers()[2]
    return memoryview(b"") if data is None or not texts[i].is_valid else memoryview(data)[int(at[i]) : int(at[i + 1])]


def decode_blocks(text: bytes | memoryview, size: int = BLOCK) -> Iterator[str]:
    """A UTF-8 text in pieces of about size bytes; one piece at least."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for at in range(0, max(1, len(text)), size):
        yield decoder.decode(bytes(text[at : at + size]), at + size >= len(text))
