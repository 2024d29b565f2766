"""N-gram Jaccard join: exact links between documents whose shingle sets have J >= 0.8.

Metric-space join, no minhash and no lost pairs. With ``x ^ y`` for the symmetric difference,
``J(x, y) >= t`` is the same as ``|x ^ y| <= r (|x| + |y|)``, ``r = (1 - t) / (1 + t)``.

1. Equal sets become one class; only its smallest document goes on.
2. First pivots are one-shingle sets. A document lies in the region of a pivot if it holds the
   shingle; it is replicated to its first ones in a common order, a window wider by ``MARGIN n``
   than what a partner may miss (``n - ceil(t n)``). Fewer than ``MARGIN n`` regions that hold
   somebody else: the document has no partner, it is done and never moves again.
3. The rest is ordered by document frequency, rarest first. A document less than ``t`` of whose
   shingles occur elsewhere has no partner. What remains (a tenth of the rows) forms regions.
4. The most central document of a region becomes its pivot p; all others are measured against it.
   Within ``t`` they are inner and linked with p, so pairs of inner documents need no look.
5. ``x -> x ^ p`` keeps symmetric differences, so a region joins recursively as a join of the small
   sets ``x ^ p``. By the triangle inequality an outer x (``|x ^ p| > r (|x| + |p|)``) and any
   partner y share elements of these sets: ``|dx & dy| >= (|dx| + |dy| - r (|x| + |y|)) / 2``.
   Windows from that bound replicate boundary documents to the regions of the next round. A
   region of that kind with at most ``LEAF`` documents is compared directly, a larger one again
   by a pivot. Each round lets leaves be four times as large: documents that no pivot tells
   apart (all of them 0.2 to 0.4 from each other) end after logarithmically many rounds.

The order (central first) is total and a region never holds what precedes its pivot, so rounds
end. Pairs are (document, pivot), or lie in a leaf: linear in a region's size. Hot regions are
split by adaptive skew joins; nothing is gathered per group, on the driver or in a broadcast.

Defined cases: null, empty or blank text has no shingle, ``n_shingles`` 0 and is its own component;
fewer than five words count as one shingle of all of them; repeated rows of one doc_id count once,
and of different texts of one doc_id the one with the least xxhash64 counts, whatever the order of
rows (``one_text``); rows without doc_id are left out;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.batches import SMALL_SLICE, mix, slices, split, travels, windows, word_hashes
from noticeflow.session import discard, materialize

SIZE = 5
THRESHOLD = Fraction(4, 5)
LEAF = 32
MARGIN = Fraction(1, 10)
ONLY_P = np.int64(-1)


def shingle_sets(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the distinct shingles of each text, sorted by hash."""
    words = split(pc.ascii_lower(text))
    hashes = word_hashes(words)
    offsets, found = windows(hashes, words.starts, size)
    sets = []
    for i in range(len(text)):
        own = found[offsets[i] : offsets[i + 1]]
        if not len(own) and words.starts[i + 1] > words.starts[i]:
            whole, n = np.uint64(0), words.starts[i + 1] - words.starts[i]
            for h in hashes[words.starts[i] : words.starts[i + 1]]:
                whole = mix(np.array([whole ^ h], np.uint64))[0]
            own = mix(np.array([whole + np.uint64(n)], np.uint64))
        sets.append(np.unique(own))
    return np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64), np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def window(n: int, t: Fraction) -> int:
    """How many first shingles must hold one of any partner's: n - ceil(t n) + 1."""
    return n + (-n * t.numerator // t.denominator) + 1 if n else 0


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))


def _sketch(size: int, t: Fraction):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in slices(batches, most=SMALL_SLICE):
            offsets, values = shingle_sets(text, size)
            n = np.diff(offsets)
            more = [-(-int(k) * MARGIN.numerator // MARGIN.denominator) for k in n]
            keep = [values[a : min(b, a + window(int(b - a), t) + k)] for a, b, k in zip(offsets, offsets[1:], more, strict=False)]
            need = np.array([len(k) for k in keep], np.int64) - [window(int(k), t) - 1 for k in n]
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keep])))
            once, twice = mix(values), mix(values ^ np.uint64(0x5851F42D4C957F2D))
            total = lambda x: pa.array(_sums(x, offsets).view(np.int64))
            yield pa.record_batch(
                [rows.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), total(once), total(twice), pa.array(need, pa.int64()), _lists(ends, np.concatenate(keep))],
                ["doc_id", "n", "d1", "d2", "need", "first"],
            )

    return sketch


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))[offsets])


def _whole(size: int):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in slices(batches, most=SMALL_SLICE):
            offsets, values = shingle_sets(text, size)
            yield pa.record_batch([rows.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), _lists(offsets, values)], ["doc_id", "n", "sigs"])

    return whole


def _compare(t: Fraction):
    """Measure documents against their pivot and cut the windows of the next round."""
    up, down = t.denominator - t.numerator, t.denominator + t.numerator  # r = up / down

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            xs, ps = batch.column("x_sigs"), batch.column("p_sigs")
            xn, pn, leaf = (batch.column(c).to_pylist() for c in ("x_n", "p_n", "leaf"))
            linked, outer, near, wide = [], [], [], []
            for i in range(batch.num_rows):
                x, p = xs[i].values.to_numpy(), ps[i].values.to_numpy()
                both, in_x, in_p = np.intersect1d(x, p, assume_unique=True, return_indices=True)
                n, m, same = xn[i], pn[i], len(both)
                delta = n + m - 2 * same
                far = down * delta - up * (n + m)  # > 0: outer
                linked.append(far <= 0)
                outer.append(far > 0)
                # the order: what only x holds, added, removed, what only p holds (in every set)
                ordered = np.concatenate((np.delete(x, in_x), np.delete(p, in_p)[::-1]))
                # partner is outer: they share more than half, less the difference in size
                half = _cut(ordered, delta - max(1, (down * delta + up * (m - n)) // (2 * down) + 1) + 1 - (n - len(x)))
                # outer x, inner partner
                rest = _cut(ordered, delta - max(1, _least(far, up, down)) + 1 - (n - len(x))) if far > 0 else half
                near.append(half if far > 0 and not leaf[i] else half[:0])
                wide.append(rest[:0] if leaf[i] else rest)
            arrays = []
            for keep in (near, wide):
                ends = np.concatenate(([0], np.cumsum([len(k) for k in keep])))
                arrays.append(_lists(ends, np.concatenate(keep).astype(np.int64)))
            yield pa.record_batch(
                [batch.column("p"), batch.column("x"), batch.column("cen"), pa.array(linked), pa.array(outer), *arrays],
                ["p", "x", "cen", "linked", "outer", "near", "wide"],
            )

    return compare


def _cut(ordered: np.ndarray, room: int) -> np.ndarray:
    """First ``room`` elements; past the listed ones stands one for all that only p holds."""
    return np.append(ordered, ONLY_P) if room > len(ordered) else ordered[: max(0, room)]


def _least(far: int, up: int, down: int) -> int:
    """Least shared part of an outer document and any partner.

    ``c >= (dx + dy - r (|x| + |y|)) / 2`` with ``|y| <= |p| + dy`` and ``dy >= c`` gives
    ``c (1 + r) >= dx - r (|x| + |p|) = far / down``.
    """
    return -(-far // (down + up))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): smallest node reachable over edges (a, b); nodes of edges only.

    Large-star and small-star steps: every step is two shuffles on a key with partial
    aggregation, the number of steps grows with the logarithm of the longest chain.
    """
    step = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = lambda e: e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
    now = mark(step)
    while now[0]:
        both = step.union(step.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(low, large.a == low.k).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = materialize(small, name)
        discard(step)
        step, before, now = after, now, mark(after)
        if now == before:
            break
    return step.select(F.col("a").alias("node"), F.col("b").alias("component"))


def one_text(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that hold the text of their doc_id, table to discard afterwards).

    The text of a doc_id is the one with the least hash. Texts are not shuffled to find it; only
    doc_ids with different texts are joined back, as a rule none.
    """
    h = F.xxhash64("text")
    several = materialize(
        docs.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(h).alias("least"), F.max(h).alias("most")).where("id IS NOT NULL AND least <> most").select("id", "least"),
        "several",
    )
    return docs.join(several, (docs.doc_id.cast("long") == several.id) & (F.xxhash64(docs.text) != several.least), "left_anti"), several


def near_duplicates(docs: DataFrame, size: int = SIZE, threshold: Fraction = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest document with the same set), component_id."""
    t = threshold
    docs, several = one_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where("doc_id IS NOT NULL"))
    sketches = materialize(
        docs.mapInArrow(_sketch(size, t), "doc_id long, n long, d1 long, d2 long, need long, first array<long>"), "sketches"
    )
    classes = materialize(sketches.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("class_id")), "classes")
    # one class per set; the class of a document without words is the document
    members = materialize(
        sketches.where("n > 0").select("doc_id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"]).select("doc_id", "n", "class_id").distinct()
        .union(sketches.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("class_id")).distinct()),
        "members",
    )
    heads = classes.select(F.col("class_id").alias("doc_id")).distinct().hint("merge")
    first = materialize(sketches.select("doc_id", "need", "first").join(heads, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "first")
    discard(sketches)
    windows_of = first.select("doc_id", "need", F.explode("first").alias("sig"))
    shared = windows_of.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1").select("sig")
    some = materialize(
        windows_of.join(shared.hint("merge"), "sig", "left_semi").groupBy("doc_id").agg(F.count("*").alias("k"), F.max("need").alias("need")).where("k >= need").select("doc_id"),
        "some",
    )
    discard(first)
    sets = materialize(
        docs.join(some.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_whole(size), "doc_id long, n long, sigs array<long>"), "sets"
    )
    rows = sets.select("doc_id", "n", F.explode("sigs").alias("sig"))
    common = rows.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    num, den = t.numerator, t.denominator
    points = materialize(
        rows.join(common.hint("merge"), "sig")
        .groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("s"))
        .where(f"{den} * size(s) >= {num} * n")
        .select("doc_id", "n", F.expr("transform(s, e -> e.sig)").alias("sigs"),
                F.expr("aggregate(s, 0D, (a, e) -> a - ln(e.df)) / n").alias("cen")),
        "points",
    )
    discard(some, sets, several)
    room = F.expr(f"cast(n - ceil(n * {num} / {den}) + 1 - (n - size(sigs)) AS int)")
    regions = points.select(F.lit(0).cast("long").alias("p"), F.lit(0).alias("role"), F.explode(F.slice("sigs", 1, room)).alias("e"), F.col("doc_id").alias("x"), "cen", F.lit(True).alias("outer"))
    links, spent = [], []
    while True:
        leaf = LEAF * 4 ** (len(spent) - 1) if spent else 0
        # role 0: pairs of outer documents; role 1: pairs of an outer and an inner one
        pivots = (
            regions.groupBy("p", "role", "e")
            .agg(F.min(F.struct("cen", "x")).alias("best"), F.count("*").alias("k"), F.max("outer").alias("o"), F.min("outer").alias("all_o"))
            .where("k > 1 AND (role = 0 OR (o AND NOT all_o))")
            .select("p", "role", "e", F.col("best.x").alias("q"), (F.col("k") <= leaf).alias("leaf"))
        )
        held = regions.join(pivots.hint("merge"), ["p", "role", "e"])
        pairs = held.where("NOT leaf AND x <> q").select(F.col("q").alias("p"), "x", "leaf")
        if spent:
            one, two = (held.where("leaf").select("p", "role", "e", F.col("x").alias(i), F.col("outer").alias(f"{i}_outer")) for i in ("i", "j"))
            leaves = one.join(two.hint("merge"), ["p", "role", "e"]).where("i < j AND (role = 0 OR i_outer <> j_outer)")
            pairs = pairs.union(leaves.select(F.col("i").alias("p"), F.col("j").alias("x"), F.lit(True).alias("leaf")))
        pairs = pairs.groupBy("p", "x").agg(F.min("leaf").alias("leaf"))
        x = points.select(F.col("doc_id").alias("x"), F.col("n").alias("x_n"), F.col("sigs").alias("x_sigs"), "cen")
        p = points.select(F.col("doc_id").alias("p"), F.col("n").alias("p_n"), F.col("sigs").alias("p_sigs"))
        measured = materialize(
            pairs.join(x.hint("merge"), "x").join(p.hint("merge"), "p").mapInArrow(_compare(t), "p long, x long, cen double, linked boolean, outer boolean, near array<long>, wide array<long>"), "measured"
        )
        links.append(measured.where("linked").select(F.col("x").alias("a"), F.col("p").alias("b")))
        spent.append(measured)
        if measured.isEmpty():
            break
        keys = F.expr("concat(transform(near, e -> struct(0 AS role, e AS e)), transform(wide, e -> struct(1 AS role, e AS e)))")
        regions = measured.select("p", F.explode(keys).alias("k"), "x", "cen", "outer").select("p", "k.role", "k.e", "x", "cen", "outer")
    edges = links[0]
    for more in links[1:]:
        edges = edges.union(more)
    found = components(edges)
    discard(points, classes, *spent)
    return (
        members.join(found, members.class_id == found.node, "left")
        .select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"))
    )


travels(__name__)
