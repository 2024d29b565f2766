"""Arrow helpers of the text operators: bounded slices, words, hashes.

Every operator that reads texts runs as one ``mapInArrow`` pass. A slice holds at most
``SLICE_BYTES`` of text (or one longer document), so a worker's memory follows the longest
document and not the number of rows that Spark puts into a batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle

SLICE_BYTES = 6 << 20
#: For operators that hold many 64-bit numbers for each word or byte.
SMALL_SLICE = 2 << 20
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def travels(name: str) -> None:
    """Let the functions of a module travel with their tasks; executors need no copy."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


class Words(NamedTuple):
    """Words of a slice: document d has ``ids[starts[d]:starts[d + 1]]``."""

    starts: np.ndarray
    ids: np.ndarray
    vocabulary: list[str]


def text_of(column) -> pa.Array:
    """A text column without nulls (null: empty), with 64-bit offsets and no slice offset."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pa.concat_arrays([column]) if column.offset == 0 else pa.concat_arrays([column, column[:0]])


def bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a text array from ``text_of``."""
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return offsets - first, raw


def text_from(offsets: np.ndarray, raw: np.ndarray) -> pa.Array:
    """Text array over bytes that were changed in place of the old ones."""
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(raw))
    )


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """(rows, text) slices of at most ``most`` bytes of text, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            rows = batch.slice(at, to - at)
            yield rows, text_of(rows.column(column))
            at = to


def split(text: pa.Array) -> Words:
    """Runs of anything but ASCII white space, numbered by their spelling."""
    if not len(text):
        return Words(np.zeros(1, np.int64), np.zeros(0, np.int64), [])
    parts = pc.ascii_split_whitespace(text)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    ids, vocabulary = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    offsets = offsets - offsets[0]
    if "" in vocabulary:  # before leading and after trailing white space
        real = ids != vocabulary.index("")
        offsets, ids = np.concatenate(([0], np.cumsum(real)))[offsets], ids[real]
    return Words(offsets, ids, vocabulary)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: Words, seed: int = 0) -> np.ndarray:
    """64-bit hash of every word of the slice."""
    if not words.vocabulary:
        return np.zeros(0, np.uint64)
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words.vocabulary), np.uint64, len(words.vocabulary))[words.ids]


def windows(hashes: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of every window of ``size`` neighbouring words inside a document."""
    lengths = np.diff(starts)
    counts = np.maximum(lengths - size + 1, 0)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    if not offsets[-1]:
        return offsets, np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - size + 1, np.uint64)
    for i in range(size):
        total = (total ^ hashes[i : len(hashes) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    # a window belongs to the document of its first word if its last word lies there too
    own = np.repeat(starts[:-1] - offsets[:-1], counts) + np.arange(offsets[-1])
    return offsets, mix(total[own])


travels(__name__)
