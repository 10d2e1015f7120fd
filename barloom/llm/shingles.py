"""Word shingles of whole texts as sorted 64-bit hashes, made inside tasks with numpy."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

SIZE = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers; each seed gives another order of them."""
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of texts that are hashed at once, and of a word that is hashed as a polynomial; longer words go by xxh3.
PIECE, LONGEST = 1 << 17, 64
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
#: A random number for each byte, the same for A to Z as for a to z.
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64), seed=11)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = 0x9E6C63D0876A9A47
_INVERSE = pow(_BASE, -1, 2**64)
#: The powers of the base and of its inverse; made where they are used first, so that they need not travel with functions.
_made: dict[int, np.ndarray] = {}


def _powers(base: int) -> np.ndarray:
    """base^0, base^1, ... base^(PIECE-1), modulo 2^64."""
    if base not in _made:
        _made[base] = np.r_[np.ones(1, np.uint64), np.cumprod(np.full(PIECE - 1, base, np.uint64))]
    return _made[base]


def _hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A to Z) words of texts that lie end to end in at most PIECE bytes, and the number of
    words before each of their bounds. A word is the sum of its bytes' numbers times the powers of a base, taken from
    one running sum over all the texts."""
    space = _SPACE[data]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner], last[inner - 1] = ~space[inner], ~space[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE)[: len(data)], out=sums[1:])
    found = mixed((sums[end] - sums[start]) * _powers(_INVERSE)[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONGEST).tolist():
        found[i] = xxh3_64_intdigest(data[start[i] : end[i]].tobytes().lower())
    return found, np.searchsorted(start, bounds)


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the lower-cased (A to Z) words; words part at ASCII white space, as for bytes.split()."""
    if len(text) <= PIECE:
        return _hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    found, at = [], 0
    data = np.frombuffer(text, np.uint8)
    while at < len(data):
        cut = min(at + PIECE, len(data))
        if cut < len(data):  # no word may be cut: a piece ends at white space
            spaces = np.flatnonzero(_SPACE[data[at:cut]])
            if not len(spaces):  # a longer word
                while cut < len(data) and not _SPACE[data[cut]]:
                    more = np.flatnonzero(_SPACE[data[cut : cut + PIECE]])
                    cut = cut + int(more[0]) if len(more) else min(cut + PIECE, len(data))
                found.append(np.array([xxh3_64_intdigest(text[at:cut].lower())], np.uint64))
                at = cut
                continue
            cut = at + int(spaces[-1]) + 1
        found.append(_hashes(data[at:cut], np.array([0, cut - at]))[0])
        at = cut
    return np.concatenate(found)


def _windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words."""
    m = len(h) - size + 1
    acc = h[:m] * _ODD[0]
    for k in range(1, size):
        # each place has its own odd factor; a sixth word on meets a scramble first
        acc = (acc if k % len(_ODD) else mixed(acc)) + h[k : m + k] * _ODD[k % len(_ODD)]
    return mixed(acc)


def _set(h: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The shingles of a text of words ``h`` and ``windows`` (none where the words are too few)."""
    n = len(h)
    if n == 0:
        return h
    if not len(windows):
        return mixed(np.array([xxh3_64_intdigest(h.tobytes())], dtype=np.uint64), seed=n)
    acc = np.sort(windows)
    keep = np.empty(len(acc), bool)
    keep[0] = True
    np.not_equal(acc[1:], acc[:-1], out=keep[1:])
    return acc[keep]


def shingle_set(text: bytes, size: int = SIZE) -> np.ndarray:
    """Distinct shingles of ``size`` words, sorted; fewer words make one shingle; no words make none."""
    h = word_hashes(text)
    return _set(h, _windows(h, size) if len(h) >= size else h[:0])


def shingle_sets(texts: pa.Array, size: int = SIZE) -> Iterator[np.ndarray]:
    """The shingle set of every text (binary, without nulls), hashed several texts at a time."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_binary(texts.type) else np.int32)
    bounds = bounds[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(bounds, bounds[i] + PIECE, "right")) - 1
        if j <= i:
            yield shingle_set(data[bounds[i] : bounds[i + 1]].tobytes(), size)
            i += 1
            continue
        h, word = _hashes(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        windows = _windows(h, size) if len(h) >= size else h[:0]
        for a, b in itertools.pairwise(word.tolist()):
            yield _set(h[a:b], windows[a : max(a, b - size + 1)])
        i = j


def set_id(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a whole set. Among 10^9 different sets the chance of one clash is about 3 %."""
    return xxh3_64_intdigest(tokens.tobytes()) - 2**63


def small_batches(spark: SparkSession) -> None:
    """Whole texts can be long: few rows in an Arrow batch keep a worker's memory bounded."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 200:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")


def utf8(text: Column | str) -> Column:
    """The text's bytes; none for a null text."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit("")).cast("binary")


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The batches' rows, one after the other."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def long_batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=names)


def with_ids(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id (long) and the text's bytes, the only columns that the Python side needs."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), utf8(F.col(f"`{text}`")).alias("t"))
