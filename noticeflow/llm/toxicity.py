"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or.

Only documents carry labels. A sentence s has the logit z_s = b + sum of the weights of its
words; a document is toxic if any sentence is: P = 1 - (1 - leak) prod(1 - sigmoid(z_s)). The
weights are fitted to the document labels through that formula, on a bounded sample
(``SAMPLE`` documents, chosen by a hash of doc_id). Scoring is one Arrow pass; sentences with
a probability of 0.5 or more are reported as the offending ones.

Words are lower-cased runs without ASCII white space, stripped of ASCII punctuation; a word's
features are itself and its first 4 and 5 letters, as far as they go with a label beyond chance
in the sample (z > ``CHANCE``, five documents or more). A sentence
ends with a word that ends in one of . ! ? or at a line end.

Defined cases: null, empty or blank text has no sentence and the score ``leak``; repeated rows
are scored each; without labels of both kinds every score is ``leak``; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.batches import slices, split, travels
from noticeflow.llm.learning import Adam, in_order, labelled_sample, sigmoid

SAMPLE = 4000
BUCKETS = 1 << 18
LEAK = 1e-3
PREFIXES = (4, 5)
CHANCE = 4.0
REMEMBERED = 500_000
LINE_END = "\x1e"  # a word of its own while sentences are cut

SCHEMA = "doc_id long, score double, n_sentences long, offending array<struct<start: int, stop: int, score: double>>"


def word_features(word: str) -> tuple[int, ...]:
    """Buckets of a word: itself and its beginnings of ``PREFIXES`` letters; none for no word."""
    bare = word.lower().strip(string.punctuation)
    if not bare or word == LINE_END:
        return ()
    marked = [bare, *(f"^{bare[:k]}" for k in PREFIXES if len(bare) >= k)]
    return tuple(xxhash.xxh3_64_intdigest(m) % BUCKETS for m in marked)


class Sentences:
    """Words of a slice with their features and sentences."""

    def __init__(self, text: pa.Array) -> None:
        words = split(pc.replace_substring(text, "\n", f" {LINE_END} "))
        self.starts, self.ids, n = words.starts, words.ids, len(words.ids)
        self.vocabulary = words.vocabulary
        stop = np.fromiter((w.endswith((".", "!", "?")) or w == LINE_END for w in words.vocabulary), np.int64, len(words.vocabulary))
        real = np.fromiter((w != LINE_END for w in words.vocabulary), np.int64, len(words.vocabulary))
        self.sentence = self.before = np.zeros(0, np.int64)
        self.heard = np.zeros(0, bool)
        if n:
            opens = np.zeros(n + 1, np.int64)
            opens[self.starts[:-1]] = 1  # a document's first word begins a sentence
            opens[1:] |= stop[self.ids]
            self.sentence = np.cumsum(opens[:n]) - 1
            self.before = np.concatenate(([0], np.cumsum(real[self.ids])[:-1]))  # words in front, without line ends
            self.heard = np.bincount(self.sentence, real[self.ids]) > 0
        self.owner = np.zeros(len(self.heard), np.int64)
        self.owner[self.sentence] = np.repeat(np.arange(len(text)), np.diff(self.starts))

    def logits(self, model: dict, known: dict[str, float]) -> np.ndarray:
        """``known`` remembers the weights of words that the worker has met."""
        if len(known) > REMEMBERED:
            known.clear()
        weights = model["w"]
        for w in self.vocabulary:
            if w not in known:
                known[w] = float(sum(weights.get(i, 0.0) for i in word_features(w)))
        per_word = np.fromiter((known[w] for w in self.vocabulary), np.float64, len(self.vocabulary))
        return np.bincount(self.sentence, per_word[self.ids], len(self.heard)) + model["b"]


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, text in slices(batches):
        found = Sentences(text)
        features = [word_features(w) for w in found.vocabulary]
        words, sentences = [], []
        for a, b in zip(found.starts, found.starts[1:], strict=False):
            pairs = [(i, s) for w, s in zip(found.ids[a:b].tolist(), found.sentence[a:b].tolist(), strict=True) for i in features[w]]
            words.append([i for i, _ in pairs])
            sentences.append([s for _, s in pairs])
        yield pa.record_batch([rows.column("doc_id"), rows.column("y"), pa.array(words, pa.list_(pa.int32())), pa.array(sentences, pa.list_(pa.int32()))], ["doc_id", "y", "words", "sentences"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, where=None, rounds: int = 400) -> dict | None:
    """Word weights and bias; None without labelled rows of both kinds."""
    rows = labelled_sample(docs, labels, "toxic", sample, where).mapInArrow(_collect, "doc_id long, y int, words array<int>, sentences array<int>").toArrow()
    rows, _ = in_order(rows)
    y = np.array(rows.column("y").to_pylist(), np.float64)
    if len(set(y)) < 2:
        return None
    lists = rows.column("words").combine_chunks()
    word, sentence = lists.flatten().to_numpy(), rows.column("sentences").combine_chunks().flatten().to_numpy()
    doc = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    # only features that go with a label beyond chance: rare ones would be learned by heart
    pair = np.unique(word.astype(np.int64) * len(y) + doc)
    feature, of = pair // len(y), pair % len(y)
    one, zero = (np.bincount(feature[y[of] == k], minlength=BUCKETS) for k in (1, 0))
    n1, n0 = y.sum(), len(y) - y.sum()
    share = (one + zero) / len(y)
    z = np.abs(one / n1 - zero / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    keep = ((z > CHANCE) & (one + zero >= 5))[word]
    _, sentence = np.unique(doc.astype(np.int64) << 32 | sentence.astype(np.int64), return_inverse=True)
    owner = np.zeros(sentence.max(initial=-1) + 1, np.int64)
    owner[sentence] = doc
    word, sentence = word[keep], sentence[keep]
    used, word = np.unique(word, return_inverse=True)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, steps = np.zeros(len(used) + 1), Adam(len(used) + 1, 0.1, 1e-4)
    w[-1] = -5.0
    for _ in range(rounds):
        z = np.bincount(sentence, w[word], len(owner)) + w[-1]
        s = sigmoid(z)
        total = np.bincount(owner, np.logaddexp(0, z), len(y)) + LEAK
        pull = np.where(y == 1, -1 / np.expm1(np.clip(total, 1e-6, 40)), 1.0) * weight
        slope = s * pull[owner]
        steps.step(w, np.append(np.bincount(word, slope[sentence], len(used)), slope.sum()))
    return {"w": dict(zip(used.tolist(), w[:-1].tolist(), strict=True)), "b": float(w[-1])}


def _spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point spans of word ranges."""
    found = [m.span() for m in re.finditer("[^\x20\x09-\x0d]+", text)]
    return [(found[a][0], found[b - 1][1]) for a, b in ranges]


def _score(model: dict | None, at: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for rows, text in slices(batches):
            n = len(text)
            result, count, offending = np.full(n, LEAK), np.zeros(n, np.int64), [[] for _ in range(n)]
            found = Sentences(text)
            heard, owner = found.heard, found.owner
            count = np.bincount(owner[heard], minlength=n)
            if model and len(found.ids):
                z = found.logits(model, known)
                result = 1 - (1 - LEAK) * np.exp(-np.bincount(owner[heard], np.logaddexp(0, z[heard]), n))
                for s in np.flatnonzero(heard & (sigmoid(z) >= at)):
                    a, b = np.searchsorted(found.sentence, [s, s + 1])
                    lead = found.before[found.starts[owner[s]]]
                    last = found.before[b] if b < len(found.before) else found.before[-1] + 1
                    offending[owner[s]].append((found.before[a] - lead, last - lead, float(sigmoid(z[s]))))
                for d in [d for d in range(n) if offending[d]]:
                    spans = _spans(text[d].as_py(), [(a, b) for a, b, _ in offending[d]])
                    offending[d] = [{"start": a, "stop": b, "score": p} for (a, b), (_, _, p) in zip(spans, offending[d], strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
            yield pa.record_batch(
                [rows.column("doc_id").cast(pa.int64()), pa.array(result), pa.array(count, pa.int64()), pa.array(offending, kind)],
                ["doc_id", "score", "n_sentences", "offending"],
            )

    return score


def toxicity(docs: DataFrame, model: dict | None, at: float = 0.5) -> DataFrame:
    """One row per document: score, n_sentences, offending sentences as code point spans."""
    return docs.select("doc_id", "text").mapInArrow(_score(model, at), SCHEMA)


def held_out(doc_id) -> "F.Column":
    """Documents whose labels are never learned."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


travels(__name__)
