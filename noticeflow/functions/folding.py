"""Folding by code-point tables over the byte buffers of Arrow batches.

A fold is a rule from one character to none, one or several. Its table covers all planes in pages of
256 code points; a page without changes is shared. A slice of rows is decoded once, mapped by two
lookups per character, its white space is collapsed on the same array, and it is encoded again; no
row is touched alone.

Rows are dispatched by script before they leave the JVM: rows of ASCII letters only (as many bytes
as characters) take native expressions, the others go through the table. Null rows stay null.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

PAGE = 256
SLICE_BYTES = 1 << 19
_LAST = 0x110000
_SPELLED = 1 << 22
_SPACE = 0x20


class Table(NamedTuple):
    """Pages of differences to the code point; a difference from ``_SPELLED`` on numbers a spelling."""

    pages: np.ndarray
    shift: np.ndarray
    starts: np.ndarray
    spelled: np.ndarray
    watched: np.ndarray


def _is_settled(page: str) -> bool:
    """No character of the page has a decomposition, case or mark, or is white space."""
    whole = page == unicodedata.normalize("NFKD", page) == page.lower() == page.casefold()
    return whole and not any(map(unicodedata.combining, page)) and not any(map(str.isspace, page))


def build(rule: Callable[[str], str], watched: str = "", settled: bool = True) -> Table:
    """Table of a rule; rows that hold a ``watched`` character are told apart.

    ``settled``: the rule leaves pages alone that ``_is_settled``.
    """
    shift: dict[bytes, int] = {}
    pages, own, starts, spelled = [], [], [0], []
    numbers: dict[str, int] = {}
    for first in range(0, _LAST, PAGE):
        page = np.zeros(PAGE, np.int32)
        surrogates = 0xD800 <= first <= 0xDFFF
        if not (surrogates or settled and _is_settled("".join(map(chr, range(first, first + PAGE))))):
            for code in range(first, first + PAGE):
                char = chr(code)
                made = rule(char)
                if made == char:
                    continue
                if len(made) == 1:
                    page[code - first] = ord(made) - code
                    continue
                if made not in numbers:
                    numbers[made] = len(numbers)
                    spelled += map(ord, made)
                    starts.append(len(spelled))
                page[code - first] = _SPELLED + numbers[made]
        key = page.tobytes()
        if key not in shift:
            shift[key] = len(own)
            own.append(page)
        pages.append(shift[key])
    return Table(
        np.array(pages, np.int32) * PAGE, np.concatenate(own), np.array(starts, np.int64), np.array(spelled, np.uint32), np.array([ord(c) for c in watched], np.uint32)
    )


def without_marks(char: str) -> str:
    """Compatibility decomposition without combining marks."""
    return char if char < "\x80" else "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))


def _is_space(char: str) -> bool:
    return char.isspace()


def _plain(rule: str, text: str) -> str:
    """The definition of a rule, for rows whose letters depend on their neighbours."""
    bare = "".join(map(without_marks, text))
    return bare if rule == "marks" else bare.lower()


# The small final sigma depends on its neighbours: such rows are folded whole.
_SIGMA = "Σ"


@lru_cache(maxsize=None)
def table(rule: str) -> Table:
    """Rules: ``marks`` drops marks, ``fold`` also lowers, ``case`` folds case, ``token`` keeps letters and digits, ``slug`` those of ASCII between spaces."""
    letters = lambda s: "".join(c for c in s if unicodedata.category(c)[0] in "LN")
    rules = {
        "marks": without_marks,
        "fold": lambda c: "".join(" " if _is_space(b) else b.lower() for b in without_marks(c)),
        "case": str.casefold,
        "squash_case": lambda c: " " if _is_space(c) else c.casefold(),
        "slug": lambda c: "".join(b.lower() if b.isalnum() else " " for b in without_marks(c) if b < "\x80"),
        "token": lambda c: "" if unicodedata.category(c) in ("Cn", "Co") else letters(without_marks(c)).casefold(),
    }
    watched = "".join(c for c in map(chr, range(0x370, 0x1E000)) if _SIGMA in without_marks(c)) if rule == "fold" else ""
    return build(rules[rule], watched, settled=rule not in ("token", "slug"))


def _codes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(character offsets, code points) of a large string array without nulls."""
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    raw = bytes(memoryview(data)[offsets[0] : offsets[-1]]) if data is not None else b""
    codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.concatenate((np.zeros(1, np.int64), np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return heads[offsets - offsets[0]], codes


def _text(offsets: np.ndarray, codes: np.ndarray) -> pa.Array:
    sizes = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))[offsets]
    raw = np.ascontiguousarray(codes, "<u4").tobytes().decode("utf-32-le").encode("utf-8")
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends), pa.py_buffer(raw))


def apply(table: Table, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Map every character; offsets move with spellings of none or several characters."""
    shift = table.shift[table.pages[codes >> np.uint32(8)] + (codes & np.uint32(255)).astype(np.int32)]
    new = codes + shift.view(np.uint32)
    several = np.flatnonzero(shift >= _SPELLED)
    if not len(several):
        return offsets, new
    number = (shift[several] - _SPELLED).astype(np.int64)
    lengths = np.ones(len(new), np.int64)
    lengths[several] = table.starts[number + 1] - table.starts[number]
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
    out = np.repeat(new, lengths)
    inside = np.repeat(ends[several], lengths[several])
    step = np.arange(len(inside)) - np.repeat(np.cumsum(lengths[several]) - lengths[several], lengths[several])
    out[inside + step] = table.spelled[np.repeat(table.starts[number], lengths[several]) + step]
    return ends[offsets], out


def collapse(offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of spaces become one, those at the ends of a row none."""
    blank = codes == _SPACE
    first = np.zeros(len(codes) + 1, bool)
    first[offsets[:-1]] = True
    # a space stays if a character of the same row precedes it directly; the last one of a row goes
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1] & ~first[1:-1]
    kept = np.concatenate((np.zeros(1, np.int64), np.cumsum(keep)))
    ends, out = kept[offsets], codes[keep]
    last = np.flatnonzero(ends[1:] > ends[:-1])
    trailing = ends[1:][last][out[ends[1:][last] - 1] == _SPACE] - 1
    if not len(trailing):
        return ends, out
    stay = np.ones(len(out), bool)
    stay[trailing] = False
    moved = np.concatenate((np.zeros(1, np.int64), np.cumsum(stay)))
    return moved[ends], out[stay]


def folded(text: pa.Array, rule: str, table: Table, squash: bool) -> pa.Array:
    """Folded rows of a string array; nulls stay null."""
    wide = text.cast(pa.large_string())
    valid = wide.drop_null()
    parts, at = [], 0
    sizes = np.cumsum(pa.compute.binary_length(valid).to_numpy(zero_copy_only=False).astype(np.int64)) if len(valid) else np.zeros(0, np.int64)
    while at < len(valid):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        offsets, codes = _codes(valid.slice(at, to - at))
        changed, out = apply(table, offsets, codes)
        part = _text(*(collapse(changed, out) if squash else (changed, out)))
        if len(table.watched) and (odd := np.isin(codes, table.watched)).any():
            rows = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1)
            spelled = part.to_pylist()
            for row in rows.tolist():
                whole = _plain(rule, valid[at + row].as_py())
                spelled[row] = " ".join(whole.split()) if squash else whole
            part = pa.array(spelled, pa.large_string())
        parts.append(part)
        at = to
    done = pa.concat_arrays(parts) if parts else pa.array([], pa.large_string())
    if len(valid) == len(wide):
        return done.cast(pa.string())
    filled = np.cumsum(wide.is_valid().to_numpy(zero_copy_only=False)) - 1
    return done.take(pa.array(filled, mask=wide.is_null().to_numpy(zero_copy_only=False))).cast(pa.string())


@lru_cache(maxsize=None)
def _pass(rule: str, squash: bool):
    own = table(rule)

    @F.arrow_udf("string")
    def fold(text: pa.Array) -> pa.Array:
        return folded(text, rule, own, squash)

    return fold


@lru_cache(maxsize=None)
def _pass_lists(rule: str, squash: bool):
    own = table(rule)

    @F.arrow_udf("array<string>")
    def fold(lists: pa.Array) -> pa.Array:
        values = lists.flatten()
        lengths = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
        return pa.ListArray.from_arrays(ends, folded(values, rule, own, squash), mask=lists.is_null())

    return fold


def by_table(text: Column, rule: str, plain: Column, squash: bool = False) -> Column:
    """``plain`` for rows of ASCII characters, the table pass for the others."""
    wide = F.octet_length(text) > F.length(text)
    return F.when(wide, _pass(rule, squash)(F.when(wide, text))).otherwise(plain)


def lists_by_table(texts: Column, rule: str, squash: bool = False) -> Column:
    """Every element of an array of strings through the table."""
    return _pass_lists(rule, squash)(texts)
