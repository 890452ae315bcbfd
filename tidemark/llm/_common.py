"""What the operators of this subpackage share: written intermediate tables, and vectorised word hashing."""

from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; words are what lies between.
WHITE = rb" \t\n\x0b\x0c\r"
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(b" \t\n\x0b\x0c\r")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, else the context's checkpoint folder, else, in local mode alone, an own one."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return given or _own_dir()


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list:
    """Columns that tell rows apart: the id and a hash of the text. Rows equal in both have equal results."""
    return [F.col(doc_id).alias("rk_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("rk_text")]


def bound(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunks_of(texts: list[bytes], most: int = 1 << 19):
    """(first, last) index ranges of texts of about `most` bytes together; a longer text stands alone."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield first, i
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    t = _tables.get(base)
    if t is None or len(t) < n:
        t = np.full(max(n, 1 << 20), base, _U)
        t[0] = 1
        np.multiply.accumulate(t, out=t)
        if len(t) <= 1 << 22:
            _tables[base] = t
    return t[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def hash_words(texts: list[bytes], lower: bool = False, white: np.ndarray = _IS_WHITE):
    """Words (split at ASCII white space, or at the bytes that `white` marks, a line feed among them) of several texts at once.

    Returns (hashes uint64 of all words in order, words per text, buffer, word starts, word ends)."""
    buf = b"\n" + b"\n".join(texts) + b"\n"
    raw = np.frombuffer(buf, np.uint8)
    apart = white[raw]
    edges = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    first = np.cumsum([1] + [len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, first))
    values = (_LOWER[raw] if lower else raw).astype(_U)
    values += _U(1)
    values *= _powers(_BYTE_BASE, len(values))
    sums = np.cumsum(values)
    h = sums[ends - 1] - sums[starts - 1]
    h *= _powers(_inverse(_BYTE_BASE), len(values))[starts]
    return mix(h), counts, buf, starts, ends


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` consecutive values; entry i starts at value i."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, _U)
    sums = np.zeros(len(words) + 1, _U)
    np.cumsum(words * _powers(_WORD_BASE, len(words)), out=sums[1:])
    h = sums[length:] - sums[:-length]
    h *= _powers(_inverse(_WORD_BASE), len(words))[:n]
    return mix(h)


_CLASS = np.full(256, 2, np.uint8)  # 0 white space, 1 letters and digits, 2 the rest
_CLASS[list(b" \t\n\x0b\x0c\r")] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1


def hash_tokens(texts: list[bytes], prefixes: tuple[int, ...] = ()):
    """Tokens (longest runs of letters and digits, or of other signs) of several texts at once, A-Z lower-cased.

    Returns (hashes, tokens per text, which are words, upper-case letters of each, lengths in bytes, and for each of
    `prefixes` a pair: the longer words, the hashes of their first so many bytes)."""
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    kinds = _CLASS[raw]
    edges = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    if not len(edges):
        return np.zeros(0, _U), np.zeros(len(texts), np.int64), np.zeros(0, bool), np.zeros(0, np.int32), np.zeros(0, np.int64), [(np.zeros(0, np.int64), np.zeros(0, _U)) for _ in prefixes]
    solid = kinds[edges[:-1]] != 0
    starts, ends = edges[:-1][solid], edges[1:][solid]
    counts = np.diff(np.searchsorted(starts, np.cumsum([1] + [len(t) + 1 for t in texts])))
    values = _LOWER[raw].astype(_U)
    values += _U(1)
    values *= _powers(_BYTE_BASE, len(values))
    sums = np.cumsum(values)
    back = _powers(_inverse(_BYTE_BASE), len(raw))
    h = (sums[ends - 1] - sums[starts - 1]) * back[starts]
    upper, word = np.cumsum(_UPPER[raw]), kinds[starts] == 1
    heads = []
    for k in prefixes:
        longer = np.flatnonzero(word & (ends - starts > k))
        at = starts[longer]
        heads.append((longer, mix((sums[at + k - 1] - sums[at - 1]) * back[at] + _U(k))))
    return mix(h), counts, word, upper[ends - 1] - upper[starts - 1], ends - starts, heads
