"""Benchmark decontamination by template windows.

A text becomes a sequence of template tokens: numbers, quantities, units and names (capitalised
words) turn into typed placeholders, other words are lower-cased and lose their ASCII punctuation.
Windows of ``WINDOW`` template tokens with at least ``LITERAL`` words are hashed and joined with
the windows of the benchmark; a re-parameterised question keeps its templates. Letter case decides
what a name is, so each of these windows has a second key of lower-cased words (numbers, quantities
and units typed, no names), which a copy in other case keeps; a position of the item counts once,
whichever key meets it. Then the slots are
checked at each alignment of the two texts: a value of the item that meets two values of the
document, and a value of the document that stands for two of the item, make every window that holds
them inconsistent. A window whose slots all hold the item's own values is a literal copy and always
counts. A document is contaminated by an item if consistent windows cover ``COVERED`` of the item's
windows.

Documents' windows are filtered in the scan by a bitmap of the benchmark's window hashes, a fixed
``2 ** BITS`` bits whatever the benchmark's size, so that only what may match is shuffled.

An item shorter than a window is one window of its own length; documents are cut by every length that
the benchmark holds. An item none of whose windows has ``LITERAL`` words (rich in names and numbers)
is matched by the exact words and values of its windows, in any case.

Defined cases: null or empty text matches nothing, nor does a text shorter than every window of the
benchmark; repeated rows of one item_id count as one item; an empty
documents table gives an empty result, an empty benchmark contaminates nothing; other columns are
kept by ``drop_contaminated`` and ignored otherwise. Rows without doc_id match nothing.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.batches import SMALL_SLICE, mix, slices, split, travels
from noticeflow.session import materialize

WINDOW = 8
LITERAL = 4
COVERED = 0.5
BITS = 22

#: Kinds of keys: template tokens; tokens of the lower-cased words, without names; these words and values.
TEMPLATE, BLIND, EXACT = 0, 1, 2

#: Unit words and number words. Fixed values.
UNITS = frozenset("mm cm m km inch inches foot feet ft yard yards mile miles g kg mg gram grams kilogram kilograms lb lbs pound pounds ounce ounces l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent mph kmh degree degrees".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million dozen".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
_QUANTITY = re.compile(r"[+-]?\d[\d.,]*([a-z]+)")
PUNCTUATION = string.punctuation.replace("$", "").replace("%", "").replace("+", "")


def canonical(word: str) -> tuple[str, str]:
    """(template token, slot value or ""); an empty token is no word."""
    bare = word.strip(string.punctuation)
    if bare.isalpha():
        if bare[0].isupper() and len(bare) > 1 and bare[1:].islower():
            return "<name>", bare.lower()
        low = bare.lower()
        if low in UNITS:
            return "<unit>", low
        return ("<num>", low) if low in NUMBERS else (low, "")
    shown = word.strip(PUNCTUATION)
    if _NUMBER.fullmatch(shown):
        return "<num>", bare
    low = bare.lower()
    if (m := _QUANTITY.fullmatch(low)) and m.group(1) in UNITS:
        return "<qty>", low
    return low, ""


class Templates:
    """Tokens of a slice by kind of key, and the hashes of their windows."""

    def __init__(self, text: pa.Array) -> None:
        words = split(text)
        told = [canonical(w) for w in words.vocabulary]
        blind = [t if (low := w.lower()) == w else canonical(low) for w, t in zip(words.vocabulary, told, strict=True)]
        real = np.fromiter((bool(t) for t, _ in told), bool, len(told))
        keep = real[words.ids] if len(words.ids) else np.zeros(0, bool)
        self.starts = np.concatenate(([0], np.cumsum(keep)))[words.starts]
        self.lengths = np.diff(self.starts)
        self.ids = words.ids[keep]
        self.kinds = {TEMPLATE: told, BLIND: blind, EXACT: [(v or t, "") for t, v in blind]}

    def windows(self, kind: int, sizes: np.ndarray, literal: int) -> Windows:
        """Windows of ``sizes[d]`` tokens of every text d, and whether they hold enough words."""
        told = self.kinds[kind]
        code = np.fromiter((xxhash.xxh3_64_intdigest(t) for t, _ in told), np.uint64, len(told))
        slot = np.fromiter((bool(v) for _, v in told), np.int64, len(told))
        counts = np.maximum(self.lengths - sizes + 1, 0) * (sizes > 0)
        doc = np.repeat(np.arange(len(self.lengths)), counts)
        position = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at, own = position + self.starts[doc], sizes[doc]
        codes, slots = code[self.ids], np.concatenate(([0], np.cumsum(slot[self.ids])))
        total = np.full(len(at), kind, np.uint64)
        for k in range(int(own.max()) if len(own) else 0):
            inside = slice(None) if (own > k).all() else own > k
            step = codes[at[inside] + k]
            total[inside] = mix((total[inside] ^ step) * np.uint64(0x9E3779B97F4A7C15))
        literals = own - (slots[at + own] - slots[at]) if len(at) else np.zeros(0, np.int64)
        # a window of its own length for short items
        return Windows(doc, position, at, own, total, literals >= np.minimum(literal, own))

    def slots(self, kind: int, at: int, own: int) -> str:
        """Values of the placeholders of a window, joined."""
        told = self.kinds[kind]
        return "\x1f".join(v for i in self.ids[at : at + own] if (v := told[i][1]))


class Windows(NamedTuple):
    doc: np.ndarray
    position: np.ndarray
    at: np.ndarray
    own: np.ndarray
    hashes: np.ndarray
    rich: np.ndarray


def _rows(rows: pa.RecordBatch, key: str, found: Templates, kind: int, w: Windows, pick: np.ndarray) -> pa.RecordBatch:
    ids = rows.column(key).cast(pa.int64()).take(pa.array(w.doc[pick]))
    told = [found.slots(kind, a, n) for a, n in zip(w.at[pick].tolist(), w.own[pick].tolist(), strict=True)]
    return pa.record_batch(
        [ids, pa.array(w.position[pick], pa.int64()), pa.array(w.hashes[pick].view(np.int64)), pa.array(told, pa.string()), pa.array(np.full(len(pick), kind), pa.int32()), pa.array(w.own[pick], pa.int32())],
        ["id", "position", "hash", "slots", "kind", "size"],
    )


def _item_windows(size: int, literal: int):
    """Keys of the items: template and case-blind windows at the positions with enough words.

    An item without such a position has exact keys at all positions.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in slices(batches, most=SMALL_SLICE):
            found = Templates(text)
            sizes = np.minimum(found.lengths, size)
            plain = found.windows(TEMPLATE, sizes, literal)
            pick = np.flatnonzero(plain.rich)
            poor = np.flatnonzero(~np.isin(plain.doc, plain.doc[pick]))
            for kind, chosen in ((TEMPLATE, pick), (BLIND, pick), (EXACT, poor)):
                yield _rows(rows, "id", found, kind, found.windows(kind, sizes, literal), chosen)

    return cut


def _document_windows(keys: list[tuple[int, int]], literal: int, bitmap: np.ndarray):
    """Windows of the (kind, size) that the benchmark holds, thinned by its bitmap."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in slices(batches, most=SMALL_SLICE):
            found = Templates(text)
            for kind, size in keys:
                w = found.windows(kind, np.full(len(found.lengths), size), literal)
                low = (w.hashes >> np.uint64(64 - BITS)).astype(np.int64)
                yield _rows(rows, "doc_id", found, kind, w, np.flatnonzero((bitmap[low >> 3] >> (low & 7)) & w.rich))

    return cut


_WINDOW_SCHEMA = "id long, position long, hash long, slots string, kind int, size int"


def _bitmap(windows: DataFrame) -> np.ndarray:
    """Bits of the window hashes: ``2 ** BITS`` bits; only their 32-bit words come to the driver."""
    low = f"shiftrightunsigned(hash, {64 - BITS})"
    words = windows.select(F.expr(f"cast({low} div 32 AS int)").alias("w"), F.expr(f"shiftleft(1, cast({low} % 32 AS int))").alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (BITS - 5), np.uint32)
    bits[rows.column("w").to_numpy()] = rows.column("b").to_numpy().astype(np.int32).view(np.uint32)
    return bits.view(np.uint8)


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, literal: int = LITERAL) -> DataFrame:
    """(doc_id, item_id, share, consistent) of every document and item that share a window.

    ``share``: part of the item's positions that consistent windows cover; ``consistent``: no position
    that met was left out by the slot check.
    """
    items = benchmark.select(F.col("item_id").alias("id"), "text").where("id IS NOT NULL").distinct()
    # written once: four plans read it, and its size is known before documents are scanned
    item_windows = materialize(items.mapInArrow(_item_windows(size, literal), _WINDOW_SCHEMA), "item-windows")
    bits = _bitmap(item_windows)
    keys = sorted((r["kind"], r["size"]) for r in item_windows.select("kind", "size").distinct().collect())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    found = texts.mapInArrow(_document_windows(keys, literal, bits), _WINDOW_SCHEMA)
    sizes = item_windows.groupBy("id").agg(F.countDistinct("position").alias("of"))
    slots = found.alias("d").join(item_windows.alias("b"), "hash").select(
        F.col("d.id").alias("doc_id"), F.col("b.id").alias("item_id"), (F.col("d.position") - F.col("b.position")).alias("shift"),
        F.col("b.position").alias("position"), F.col("b.kind").alias("kind"),
        F.explode(F.arrays_zip(F.split("b.slots", "\x1f").alias("theirs"), F.split("d.slots", "\x1f").alias("ours"))).alias("s"),
    ).select("doc_id", "item_id", "shift", "position", "kind", "s.theirs", "s.ours")
    # an alignment holds no more rows than the item has slots; one exchange serves the windows below
    aligned = ["doc_id", "item_id", "shift"]
    several = lambda value, of: F.min(value).over(Window.partitionBy(*aligned, of)) != F.max(value).over(Window.partitionBy(*aligned, of))
    judged = slots.repartition(*aligned).withColumn("clash", several("ours", "theirs") | several("theirs", "ours"))
    runs = judged.groupBy(*aligned, "position", "kind").agg((F.bool_and(F.col("theirs") == F.col("ours")) | ~F.bool_or("clash")).alias("counts"))
    # an insertion or deletion changes the alignment: a position of the item counts once, whichever alignment and kind cover it
    return (
        runs.groupBy("doc_id", "item_id", "position").agg(F.max("counts").alias("counts"))
        .groupBy("doc_id", "item_id").agg(F.count_if("counts").alias("n"), F.min("counts").alias("consistent"))
        .join(sizes.withColumnRenamed("id", "item_id"), "item_id").select("doc_id", "item_id", (F.col("n") / F.col("of")).alias("share"), "consistent")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """(doc_id, items, share): contaminated documents with the items that they contain."""
    return (
        matches(docs, benchmark).where(F.col("share") >= covered)
        .groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("share").alias("share"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """One row per document: doc_id, contaminated, items, share."""
    found = contaminated(docs, benchmark, covered)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, "doc_id", "left").select(
        "doc_id", F.col("share").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("share", F.lit(0.0)).alias("share")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """Documents without a benchmark item, with all their columns.

    The contaminated ids are written first: where they are few, whole documents are not shuffled to lose them.
    """
    found = materialize(contaminated(docs, benchmark, covered).select(F.col("doc_id").alias("_doc")), "contaminated")
    return docs.join(found, docs.doc_id.cast("long") == found["_doc"], "left_anti")


travels(__name__)
