"""Importance resampling: draw documents that look like a target set, by hashed word n-grams.

Two passes over the texts, both in Arrow slices. In each slice every run of 1 to ``LONGEST`` words
is interned in an open-addressed NumPy table: its key is the xxhash64 of its bytes, and an entry is
taken for equal only after its bytes were compared. A slot keeps the bucket (crc32 modulo
``BUCKETS``) and the count of one distinct n-gram; every occurrence keeps its slot id.

1. ``bucket_counts``: a task adds its slots' counts by bucket and sends at most ``BUCKETS`` rows.
   The sums over all documents and over all target texts give one gain per bucket, a list of
   ``BUCKETS`` numbers, which is all that ever reaches the driver.
2. ``weigh``: slots take the gain of their bucket, occurrences gather it by slot id, a document adds
   its occurrences.

The draw sorts narrow rows (no texts) once over the cluster by score plus Gumbel noise, numbers
them by partition offsets, and the first ones are drawn. No window spans the table.

Defined cases: null, empty and wordless texts have no features, weight 0, and are never drawn; rows
of one doc_id are judged each, ties go to the smaller doc_id, then to the earlier row; a null doc_id
takes its noise from the empty string and loses ties; without target texts or documents the counts
are 0 and the gains follow from that; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.batches import bytes_of, slices, travels
from noticeflow.llm.learning import per_document
from noticeflow.session import discard, materialize

BUCKETS = 10_000
LONGEST = 3
SHARE = (5, 100)
LEAST_WORDS = 20
SEED = 42
SLICE = 2 << 20

# The constants of xxhash64.
_P1, _P2, _P3, _P4, _P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_STRIPES = 32  # from this length on, xxhash64 works on stripes: left to the library

_SPACE = 0x20
_FOLD = np.full(256, _SPACE, np.uint8)
for _code in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _FOLD[_code] = _code
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


class Spelled(NamedTuple):
    """Words of a slice, each followed by one space: document d has words ``of[d]`` to ``of[d + 1]``."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray


def spell(text: pa.Array) -> Spelled:
    """Lower-case words of every text, joined by single spaces."""
    offsets, raw = bytes_of(text)
    sizes = np.diff(offsets)
    padded = np.full(len(raw) + len(text), _SPACE, np.uint8)  # a space behind every text
    padded[np.arange(len(raw)) + np.repeat(np.arange(len(text)), sizes)] = _FOLD[raw]
    inside = padded != _SPACE
    ended = np.zeros(len(padded), bool)
    ended[1:] = inside[:-1] & ~inside[1:]
    of = np.concatenate(([0], np.cumsum(ended)[offsets[1:] + np.arange(len(text))])) if len(text) else np.zeros(1, np.int64)
    joined = padded[inside | ended]
    ends = np.flatnonzero(joined == _SPACE)
    return Spelled(joined, np.concatenate((np.zeros(1, np.int64), ends + 1))[: len(ends)], ends, of)


def runs(words: Spelled, longest: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(offsets by document, first byte, end byte) of all runs of 1, 2, ... words."""
    found = []
    for k in range(1, longest + 1):
        n = np.maximum(np.diff(words.of) - k + 1, 0)
        ends = np.concatenate(([0], np.cumsum(n)))
        first = np.repeat(words.of[:-1] - ends[:-1], n) + np.arange(ends[-1])
        found.append((ends, words.starts[first], words.ends[first + k - 1]))
    return found


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _hash(wide: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """xxhash64 of the ``size`` < 32 bytes from each of ``at``; ``wide[i]`` holds bytes i to i + 7."""
    h = np.full(len(at), _P5 + np.uint64(size), np.uint64)
    for k in range(0, size - 7, 8):
        h = _turn(h ^ _turn(wide[at + k] * _P2, 31) * _P1, 27) * _P1 + _P4
    done = size & ~7
    if size & 4:
        h = _turn(h ^ (wide[at + done] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
        done += 4
    for k in range(done, size):
        h = _turn(h ^ (wide[at + k] & np.uint64(0xFF)) * _P5, 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _same(wide: np.ndarray, data: bytes, a: np.ndarray, b: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Whether the bytes from a and from b are equal, lane by lane; long ones one by one."""
    if isinstance(size, np.ndarray):
        return np.fromiter((data[x : x + n] == data[y : y + n] for x, y, n in zip(a.tolist(), b.tolist(), size.tolist(), strict=True)), bool, len(a))
    equal = np.ones(len(a), bool)
    for k in range(0, size, 8):
        rest = np.uint64(64 - 8 * min(8, size - k))
        equal &= (wide[a + k] ^ wide[b + k]) << rest == 0
    return equal


class Interned(NamedTuple):
    """Slot of every occurrence; first occurrence, first byte, end byte and count of every slot."""

    slots: np.ndarray
    firsts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray


def intern(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Interned:
    """Number the distinct byte strings ``raw[starts:ends]`` by an open-addressed table."""
    n = len(starts)
    sizes = ends - starts
    order = np.argsort(np.minimum(sizes, _STRIPES).astype(np.uint8), kind="stable")
    at, size = starts[order], sizes[order]
    data = raw.tobytes()
    wide = np.ndarray(len(raw), "<u8", data + bytes(8), 0, (1,)).copy()
    bounds = np.searchsorted(np.minimum(size, _STRIPES), np.arange(_STRIPES + 2))
    groups = [(length, slice(a, b)) for length, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a]
    keys = np.empty(n, np.uint64)
    for length, part in groups:
        if length < _STRIPES:
            keys[part] = _hash(wide, at[part], length)
        else:
            keys[part] = np.fromiter((xxhash.xxh64_intdigest(data[a : a + k]) for a, k in zip(at[part].tolist(), size[part].tolist(), strict=True)), np.uint64, part.stop - part.start)
    room = 1 << max(4, (2 * n - 1).bit_length())
    table, mask = np.full(room, -1, np.int32 if n < 1 << 31 else np.int64), np.uint64(room - 1)
    owner = np.empty(n, np.int64)
    for length, part in groups:
        waiting = np.arange(part.start, part.stop)
        place = (keys[part] & mask).astype(np.int64)
        while len(waiting):
            free = table[place] < 0
            table[place[free]] = waiting[free]  # of several claims one stays
            held = table[place].astype(np.int64)
            equal = keys[held] == keys[waiting]
            check = np.flatnonzero(equal & (held != waiting) & (np.minimum(size[held], _STRIPES) == length))
            equal[held != waiting] = False
            if length < _STRIPES:
                real = _same(wide, data, at[held[check]], at[waiting[check]], length)
            else:
                real = (size[held[check]] == size[waiting[check]]) & _same(wide, data, at[held[check]], at[waiting[check]], size[waiting[check]])
            equal[check] = real
            owner[waiting[equal]] = held[equal]
            waiting, place = waiting[~equal], (place[~equal] + 1) & int(mask)
    firsts = np.flatnonzero(owner == np.arange(n))
    number = np.empty(n, np.int64)
    number[firsts] = np.arange(len(firsts))
    slots = np.empty(n, np.int64)
    slots[order] = number[owner]
    return Interned(slots, order[firsts], at[firsts], at[firsts] + size[firsts], np.bincount(slots, minlength=len(firsts)))


def _shifts(most: int) -> np.ndarray:
    """``[n, k, byte]``: what byte k of a crc32 becomes when n more bytes (of value 0) follow."""
    table = np.zeros((most, 4, 256), np.uint32)
    single = np.array([zlib.crc32(bytes((byte,))) ^ zlib.crc32(b"\0") for byte in range(256)], np.uint32)
    for k in range(4):
        table[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, most):
        table[n] = single[table[n - 1] & np.uint32(255)] ^ (table[n - 1] >> np.uint32(8))
    return table


_FOLLOWED = _shifts(64)


def _append(code: np.ndarray, size: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """crc32 of two byte strings put together, from both codes and the length of the second."""
    near = np.minimum(size, len(_FOLLOWED) - 1)
    out = tail.copy()
    for k in range(4):
        out ^= _FOLLOWED[near, k, (code >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def buckets_of(words: Spelled, found: list, table: Interned, buckets: int) -> np.ndarray:
    """Bucket of every slot: crc32 of its bytes, modulo ``buckets``.

    Distinct words are coded byte by byte, longer runs put together from them; a run that ends with
    a word of 63 bytes or more is coded whole.
    """
    data = words.raw.tobytes()
    n = len(words.starts)
    used = np.unique(table.slots[:n])
    spelled = [data[a:b] for a, b in zip(table.starts[used].tolist(), table.ends[used].tolist(), strict=True)]
    code = np.zeros((2, len(table.starts)), np.uint32)
    code[0, used] = np.fromiter(map(zlib.crc32, spelled), np.uint32, len(used))
    code[1, used] = np.fromiter((zlib.crc32(b" " + w) for w in spelled), np.uint32, len(used))
    first, last = code[0][table.slots[:n]], code[1][table.slots[:n]]
    sizes = words.ends - words.starts + 1
    codes, run = [first], first
    for k, (ends, _, _) in enumerate(found[1:], 1):
        run = _append(run[: max(0, n - k)], sizes[k:], last[k:])
        for i in np.flatnonzero(sizes[k:] >= len(_FOLLOWED)).tolist():
            run[i] = zlib.crc32(data[words.starts[i] : words.ends[i + k]])
        at = np.repeat(words.of[:-1] - ends[:-1], np.diff(ends)) + np.arange(ends[-1])
        codes.append(run[at])
    return (np.concatenate(codes)[table.firsts] % np.uint32(buckets)).astype(np.int64)


def _interned(text: pa.Array, longest: int, buckets: int):
    """(offsets of runs by length, interned n-grams, bucket of every slot, words per document) of a slice."""
    words = spell(text)
    found = runs(words, longest)
    table = intern(words.raw, np.concatenate([a for _, a, _ in found]), np.concatenate([b for _, _, b in found]))
    return [ends for ends, _, _ in found], table, buckets_of(words, found, table, buckets), np.diff(words.of)


def _count(longest: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, text in slices(batches, most=SLICE):
            _, table, bucket, _ = _interned(text, longest, buckets)
            np.add.at(total, bucket, table.counts)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return count


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: ``buckets`` numbers."""
    counted = docs.select("text").mapInArrow(_count(longest, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in counted.collect():  # at most ``buckets`` rows
        total[row.bucket] = row.n
    return total


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the log ratio of the smoothed bucket shares, rounded down."""
    n = len(own)
    all_own, all_target = int(own.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_own + n) / ((s + 1) * (all_target + n)))) for s, t in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(gain: np.ndarray, longest: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in slices(batches, most=SLICE):
            by_length, table, bucket, n_words = _interned(text, longest, len(gain))
            each = gain[bucket][table.slots]
            weight, features, at = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64), 0
            for ends in by_length:
                weight += per_document(each[at : at + ends[-1]], ends)
                features += np.diff(ends)
                at += ends[-1]
            yield pa.record_batch(
                [rows.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n_words, features, weight))], ["doc_id", "n_words", "n_features", "weight"]
            )

    return weigh


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""
    return docs.select("doc_id", "text").mapInArrow(_weigh(gain, longest), "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, drawn from the hash of seed and doc_id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    part = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(part))).cast("long")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows with their ``place`` (from 1) in the order, by one distributed sort.

    The sorted rows are written with (partition, position); only the sizes of the partitions are
    gathered, one row per task of the sort.
    """
    table = materialize(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    sizes = table.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    before, offsets = 0, []
    for row in sizes:
        offsets.append((row["_part"], before))
        before += row["n"]
    starts = table.sparkSession.createDataFrame(offsets, "_part long, _before long")
    placed = table.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(starts), "_part")
    return placed.select(*rows.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias("place"))


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS,
    seed: int = SEED, longest: int = LONGEST, buckets: int = BUCKETS,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null if not drawn) of every document.

    Of the documents with ``least_words`` words, ``share`` (numerator, denominator) are drawn.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    scored = materialize(
        weigh(docs, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("_row", F.monotonically_increasing_id()), "scored"
    )
    enough = F.col("n_words") >= least_words
    n_drawn = share[0] * scored.where(enough).count() // share[1]
    placed = numbered(scored, enough.desc(), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row"))
    discard(scored)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(enough & (F.col("place") <= n_drawn), F.col("place")).alias("rank"))


def drawn(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The drawn documents with all their columns, each row of a drawn doc_id."""
    chosen = ranks.where("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(chosen, docs["doc_id"].cast("long") == chosen["__drawn"], "left_semi")


travels(__name__)
travels("noticeflow.llm.learning")
