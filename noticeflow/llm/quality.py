"""Quality rules: counted base rules and a calibrated hashed n-gram logistic regression.

The model pools hashed words and hashed byte 4-grams of a text (mean weight of each kind), is
fitted on a bounded sample of labelled rows (``SAMPLE`` documents, chosen by a hash of doc_id)
and calibrated on a quarter of that sample, chosen by another hash, which the fit does not see. Texts are scored in
Arrow batches in one pass; a document goes if a base rule fails or if P(good) < ``REJECT``.

Defined cases: null, empty or blank text has no words, all counts 0, and fails the base rules;
repeated lines and rows are judged each; without labels of both kinds the model keeps all; an
empty table gives an empty result; other columns are ignored (``extra`` passes chosen ones on).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.batches import SMALL_SLICE, Words, bytes_of, mix, slices, split, travels, windows, word_hashes
from noticeflow.llm.learning import Adam, in_order, labelled_sample, per_document, platt, sigmoid

SAMPLE = 4000
BUCKETS = 1 << 16
REJECT = 0.2
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean"


def grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, buckets) of the byte 4-grams inside each text."""
    offsets, raw = bytes_of(text)
    counts = np.maximum(np.diff(offsets) - 3, 0)
    ends = np.concatenate(([0], np.cumsum(counts)))
    if not ends[-1]:
        return ends, np.zeros(0, np.int64)
    wide = raw.astype(np.uint32)
    code = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    code = (code * np.uint32(2654435761)) >> np.uint32(16)
    own = np.ones(len(code), bool)
    for k in (1, 2, 3):  # grams that run into the next text
        at = offsets[1:-1] - k
        own[at[(at >= 0) & (at < len(code))]] = False
    # a text shorter than four bytes has none
    return ends, code[own].astype(np.int64)


def features(text: pa.Array, words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(offsets, buckets) of both kinds; words take the upper half of the buckets."""
    own = (word_hashes(words) >> np.uint64(48)).astype(np.int64) + BUCKETS
    return [grams(text), (words.starts, own)]


def counts(text: pa.Array, words: Words) -> dict[str, np.ndarray]:
    """Base counts of each text."""
    n = len(text)
    offsets, raw = bytes_of(text)
    is_symbol = np.zeros(256, np.int64)
    is_symbol[list(SYMBOLS)] = 1
    lengths = pc.utf8_length(pa.array(words.vocabulary, pa.large_string())).to_numpy(zero_copy_only=False).astype(np.int64) if words.vocabulary else np.zeros(0, np.int64)
    parts = pc.split_pattern(text, "\n")
    ends = parts.offsets.to_numpy().astype(np.int64)
    lines = parts.values.slice(ends[0], ends[-1] - ends[0])
    owner = np.repeat(np.arange(n), np.diff(ends))
    real = pc.not_equal(pc.ascii_trim_whitespace(lines), "").to_numpy(zero_copy_only=False)
    line = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[real]
    kinds = int(line.max()) + 1 if len(line) else 1
    distinct = np.unique(owner[real] * kinds + line) // kinds
    dup = np.bincount(owner[real], minlength=n) - np.bincount(distinct, minlength=n)
    # a window is repeated if another one of the same text has its hash
    at, hashes = windows(word_hashes(words), words.starts, WINDOW)
    of = np.repeat(np.arange(n), np.diff(at))
    keys = mix(hashes ^ mix(of.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    first = (np.arange(len(keys)) - at[of] + words.starts[of])[again]
    cover = np.zeros(len(words.ids) + WINDOW + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + WINDOW, -1)
    covered = (np.cumsum(cover)[: len(words.ids)] > 0).astype(np.int64)
    return {
        "n_words": np.diff(words.starts),
        "word_chars": per_document(lengths[words.ids], words.starts),
        "n_symbols": per_document(is_symbol[raw], offsets),
        "n_dup_lines": dup,
        "n_repeat_words": per_document(covered, words.starts),
    }


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of a sampled text with their share in the pooled mean."""
    for rows, text in slices(batches, most=SMALL_SLICE):
        kinds = features(text, split(text))
        for i in range(len(text)):
            where, share = [], []
            for starts, buckets in kinds:
                own, n = np.unique(buckets[starts[i] : starts[i + 1]], return_counts=True)
                where.append(own)
                share.append(n / max(1, n.sum()))
            yield pa.record_batch(
                [rows.column("doc_id").slice(i, 1), rows.column("y").slice(i, 1), pa.array([np.concatenate(where)], pa.list_(pa.int32())), pa.array([np.concatenate(share)], pa.list_(pa.float32()))],
                ["doc_id", "y", "where", "share"],
            )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = 200) -> dict | None:
    """Weights and calibration; None without labelled rows of both kinds."""
    rows = labelled_sample(docs, labels, "quality", sample).mapInArrow(_count_features, "doc_id long, y int, where array<int>, share array<float>").toArrow()
    rows, held = in_order(rows)
    y = np.array(rows.column("y").to_pylist(), np.float64)
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        return None
    lists = rows.column("where").combine_chunks()
    where = lists.flatten().to_numpy()
    share = rows.column("share").combine_chunks().flatten().to_numpy().astype(np.float64)
    of = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    weight = np.where(held, 0, np.where(y == 1, 0.5 / y[~held].sum(), 0.5 / (1 - y[~held]).sum()))
    w, steps = np.zeros(2 * BUCKETS), Adam(2 * BUCKETS, 0.5, 1e-3)
    for _ in range(rounds):
        z = np.bincount(of, share * w[where], len(y))
        steps.step(w, np.bincount(where, share * (weight * (sigmoid(z) - y))[of], 2 * BUCKETS))
    z = np.bincount(of, share * w[where], len(y))
    a, b = platt(z[held], y[held])
    return {"w": w.astype(np.float32), "a": a, "b": b}


def _judge(model: dict | None, reject: float):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text in slices(batches, most=SMALL_SLICE):
            words = split(text)
            base = counts(text, words)
            n = base["n_words"]
            failed = (n < 10) | (100 * base["n_repeat_words"] > 20 * n)
            score = np.ones(len(text))
            if model:
                z = sum(per_document(model["w"][b].astype(np.float64), s) / np.maximum(1, np.diff(s)) for s, b in features(text, words))
                score = sigmoid(model["a"] * z + model["b"])
            yield pa.record_batch(
                [rows.column("doc_id").cast(pa.int64()), *(pa.array(base[c], pa.int64()) for c in BASE), pa.array(failed), pa.array(score), pa.array(~failed & (score >= reject))],
                ["doc_id", *BASE, "base_failed", "score", "kept"],
            )

    return judge


def quality_rules(docs: DataFrame, model: dict | None, reject: float = REJECT) -> DataFrame:
    """One row per document: base counts, base_failed, score = P(good), kept."""
    return docs.select("doc_id", "text").mapInArrow(_judge(model, reject), SCHEMA)


def keep_good(docs: DataFrame, model: dict | None, reject: float = REJECT) -> DataFrame:
    """Documents that the rules keep, with all their columns, in one pass."""
    judge = _judge(model, reject)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in slices(batches, most=SMALL_SLICE):
            verdict = pa.concat_arrays([b.column("kept") for b in judge([rows.select(["doc_id", "text"])])])
            yield rows.filter(verdict)

    return docs.mapInArrow(keep, docs.schema)


travels(__name__)
travels("noticeflow.llm.learning")
