"""Source divergence audit: which sources of a language use other words than the rest.

Every (lang, source) group and every language gives each kept term of the language the smoothed
share ``p = 1 + floor(SCALE * (count + 2) / (N + 2 V))``; two shares are apart by
``f(p, q) = floor((p - q)^2 / (p + q))``. Reported are the sum of f over all kept terms for every two
sources of a language, and the terms that a source overuses most. All numbers are integers.

1. Terms are counted in Arrow slices (a task adds up before it sends), then by (lang, source, term);
   a term is kept if ``LEAST_DOCS`` documents of its language hold it.
2. Most counts are 0, so the sum over all V terms starts from V times the value of two zeros and is
   corrected: once for every (source, share, how often) against every other source at zero, and
   where both have the term, by what both together differ from that.
3. The second kind comes from a frequent-pattern tree. A term row is the path of its (source, share)
   items in the order of sources. Equal rows are one path with a multiplicity; paths are sorted over
   the cluster, so a task meets its part of the tree depth first and keeps one path of it. When a
   node is left, its multiplicity is final and it is set off against each of its ancestors, once for
   all rows that share it. A tree that is cut between two tasks adds up to the same numbers.

A path has at most as many items as its language has sources, and the result has a row for every two
sources of a language: that number is the only one that must fit a task.

Defined cases: null text, lang and source are ''; rows are documents, repeated ones count again;
groups without terms are groups; a language without kept terms has value 0 for its pairs and no
terms; a language with one source has no pairs; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.batches import bytes_of, slices, text_from, text_of, travels
from noticeflow.session import discard, materialize

LEAST_DOCS = 10
SCALE = 1_000_000_000
SMOOTH = 2
TOP_TERMS = 10
SALTS = 32
HELD_TERMS = 200_000
SLICE = 2 << 20
WALKED = 1_000

_GAP = 0x20
_LETTERS = np.full(256, _GAP, np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)

COUNTS = "lang string, source string, term string, n long, docs long"


def _terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(document of every term, its number, vocabulary) of a slice."""
    offsets, raw = bytes_of(text)
    parts = pc.ascii_split_whitespace(text_from(offsets, _LETTERS[raw]))
    ends = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    doc, term = np.repeat(np.arange(len(text)), np.diff(ends)), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    real = term != blank
    return doc[real], term[real], coded.dictionary


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the task by (lang, source, term); a group's row with term null tells that it occurs."""
    held: list[pa.Table] = []
    columns = ["lang", "source", "term", "n", "docs"]

    def together() -> pa.Table:
        added = pa.concat_tables(held).group_by(columns[:3], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return added.rename_columns(columns)

    for rows, text in slices(batches, most=SLICE):
        lang, source = (text_of(rows.column(c)).dictionary_encode() for c in ("lang", "source"))
        pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        kinds, group = np.unique(pair, return_inverse=True)
        doc, term, vocabulary = _terms(text)
        size = max(1, len(vocabulary))
        once, repeats = np.unique(doc * size + term, return_counts=True)
        key, at = np.unique(group[once // size] * size + once % size, return_inverse=True)
        n, docs = np.bincount(at, repeats, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
        of = np.concatenate((key // size, np.arange(len(kinds))))
        terms = pa.concat_arrays([vocabulary.take(pa.array(key % size)), pa.nulls(len(kinds), vocabulary.type)])
        pad = np.zeros(len(kinds), np.int64)
        width = len(source.dictionary)
        held.append(pa.table([
            lang.dictionary.take(pa.array(kinds[of] // width)), source.dictionary.take(pa.array(kinds[of] % width)), terms,
            pa.array(np.concatenate((n, pad))), pa.array(np.concatenate((docs, pad))),
        ], columns))
        if sum(map(len, held)) > HELD_TERMS:
            held = [together()]
            if len(held[0]) > HELD_TERMS // 2:
                yield from held[0].combine_chunks().to_batches()
                held = []
    if held:
        yield from together().combine_chunks().to_batches()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term); term null once per group."""
    counted = docs.select("text", "lang", "source").mapInArrow(_count, COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share_of(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + 2) / (total + 2 terms))``, exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + SMOOTH), wide(total + SMOOTH * terms)) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """lang, term, items (source, n of each source that has it), n (of the language)."""
    return (
        counts.where("term IS NOT NULL").groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("items"))
        .where(F.col("docs") >= least_docs).select("lang", "term", "items", "n")
    )


def groups_of(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total, terms (kept terms of the language), lang_total, zero (share of count 0)."""
    own = kept.select("lang", F.inline("items")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    every = counts.where("term IS NULL").select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    every = every.fillna(0, ["total", "terms", "lang_total"])
    return every.withColumn("zero", F.when(F.col("terms") > 0, share_of(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(F.lit(1).cast("long")))


def _floor(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class _Branch:
    """The path that a task stands on and the sums of its language.

    ``ids``, ``p``, ``zero`` and ``many`` describe the nodes of the path; ``sums[b][a]`` adds up the
    corrections of sources a and b, sources numbered as they are met.
    """

    def __init__(self, lang: str | None) -> None:
        self.lang, self.number, self.sums, self.many, self.depth = lang, {}, [], [], 0
        self.ids, self.p, self.zero = (np.zeros(64, np.int64) for _ in range(3))

    def enter(self, source: str, p: int, zero: int) -> None:
        if self.depth == len(self.ids):
            self.ids, self.p, self.zero = (np.concatenate((x, np.zeros(len(x), np.int64))) for x in (self.ids, self.p, self.zero))
        if source not in self.number:
            self.number[source] = len(self.number)
            self.sums.append(np.zeros(64, np.int64))
        self.ids[self.depth], self.p[self.depth], self.zero[self.depth] = self.number[source], p, zero
        self.many.append(0)
        self.depth += 1

    def leave(self, depth: int) -> None:
        """Go up to ``depth``; a node that is left is set off against all its ancestors at once."""
        while self.depth > depth:
            self.depth -= 1
            times, k = self.many.pop(), self.depth
            if not k:
                continue
            self.many[-1] += times
            before, other, mine, none = self.p[:k], self.zero[:k], self.p[k], self.zero[k]
            more = _floor(before, mine) - _floor(before, none) - _floor(other, mine) + _floor(other, none)
            own = self.ids[k]
            if len(self.sums[own]) < len(self.number):
                self.sums[own] = np.concatenate((self.sums[own], np.zeros(len(self.number), np.int64)))
            self.sums[own][self.ids[:k]] += times * more

    def rows(self) -> pa.RecordBatch:
        self.leave(0)
        names = [*self.number]
        a, b, more = [], [], []
        for own, sums in enumerate(self.sums):
            for other in np.flatnonzero(sums).tolist():
                a.append(names[other])
                b.append(names[own])
                more.append(int(sums[other]))
        return pa.record_batch([pa.array([self.lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(more, pa.int64())], ["lang", "a", "b", "more"])


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk the sorted paths of a task depth first; one row per language and two sources."""
    at = _Branch(None)
    for batch in batches:
        for start in range(0, batch.num_rows, WALKED):
            part = batch.slice(start, WALKED)
            paths = part.column("path")
            ends = paths.offsets.to_numpy() - paths.offsets[0].as_py()
            items = paths.flatten()
            source, p, zero = (items.field(c) for c in ("source", "p", "zero"))
            source, p, zero = source.to_pylist(), p.to_numpy(), zero.to_numpy()
            for row, (lang, times) in enumerate(zip(part.column("lang").to_pylist(), part.column("times").to_pylist(), strict=True)):
                if lang != at.lang:
                    if at.number:
                        yield at.rows()
                    at = _Branch(lang)
                first, last = ends[row], ends[row + 1]
                same, most = 0, min(at.depth, last - first)
                while same < most and at.p[same] == p[first + same] and at.ids[same] == at.number.get(source[first + same]):
                    same += 1
                at.leave(same)
                for i in range(first + same, last):
                    at.enter(source[i], p[i], zero[i])
                at.many[-1] += times
    if at.number:
        yield at.rows()


def branch(lang: Column, path: Column) -> Column:
    """Eight bytes that keep paths with equal beginnings together: a short hash of the first item, of the first two, ...

    The cluster is dealt out by this key alone, so what it samples to find the bounds are numbers, not paths.
    """
    part = lambda k: F.shiftleft(F.xxhash64(lang, F.slice(path, 1, k)).bitwiseAND(0xFFFF if k > 1 else 0x7FFF), 16 * (4 - k))
    return part(1).bitwiseOR(part(2)).bitwiseOR(part(3)).bitwiseOR(part(4))


def _tasks(df: DataFrame) -> int:
    """As many tasks as a shuffle has: the walk is slow for its bytes, so small partitions are not merged."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def joint_corrections(paths: DataFrame) -> DataFrame:
    """lang, a, b, more: corrections of terms that both have; ``paths``: lang, path, times, unique."""
    ordered = paths.repartitionByRange(_tasks(paths), branch(F.col("lang"), F.col("path"))).sortWithinPartitions("lang", "path")
    return ordered.mapInArrow(_tree, "lang string, a string, b string, more long").groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    counts = materialize(term_counts(docs), "counts")
    kept = materialize(kept_terms(counts, least_docs), "kept")
    groups = materialize(groups_of(counts, kept), "groups")
    shares = materialize(
        kept.select("lang", "term", F.col("n").alias("lang_n"), F.inline("items"))
        .join(groups, ["lang", "source"])
        .select("lang", "source", "term", "zero", share_of(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share_of(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")),
        "shares",
    )
    discard(counts, kept)
    paths = materialize(
        shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "zero"))).alias("path"))
        .groupBy("lang", "path").agg(F.count("*").alias("times")),
        "paths",
    )
    both = materialize(joint_corrections(paths), "both")

    # every other source of the language, dealt by salt: no task takes a whole language
    others = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SALTS)).cast("int").alias("salt")
    start = groups.select("lang", "source", "zero", "terms", salt("source")).join(others, ["lang", "salt"]).where("source <> item")
    start = start.select("lang", "source", "item", (F.col("terms") * apart(F.col("zero"), F.col("other"))).alias("value"))
    alone = shares.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("times")).withColumn("salt", salt("source", "p"))
    alone = alone.join(others, ["lang", "salt"]).where("source <> item")
    alone = alone.select("lang", "source", "item", (F.col("times") * (apart(F.col("p"), F.col("other")) - apart(F.col("zero"), F.col("other")))).alias("value"))
    one_way = alone.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    there = one_way.union(both.select("lang", "a", "b", F.col("more")))
    back = there.select("lang", "item", "source", "value")
    pairs = start.union(there).union(back).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
    return ranked(pairs, "pair").union(ranked(terms, "term").where(F.col("rank") <= top))


travels(__name__)
