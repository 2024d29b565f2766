"""SentencePiece encoding, decoding and token counts by shared-prefix forward passes.

A text becomes marked words: the space mark stands in front, and a cut is made before a mark that
follows something else and around line ends. No piece of the vocabulary covers such a cut (checked
when the file is read), so words are encoded on their own. The distinct words of a slice are sorted
and walked as a trie, depth first: a node is a prefix, and what the forward pass knows of it is kept
on a stack, so that words with a common prefix share its states.

Two forward passes, as the model file asks:

* unigram: best score over the pieces that end at a node (Viterbi);
* BPE: a path may go from piece u to piece t only if the merge order leaves ``u t`` apart; the
  best path is then the only one, and its last piece depends on the prefix alone. It gives the
  pieces of the library, which the sum of the scores of a BPE file does not.

Characters outside the vocabulary become byte pieces. Words that a worker has met are remembered
up to ``REMEMBERED``; nothing is shuffled.

Defined cases: null or empty text has no pieces and decodes to the empty text; the mark itself
(U+2581) counts as a space, as in the library; very long words only make the stack longer;
repeated rows are encoded each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from noticeflow.llm.batches import SMALL_SLICE, bytes_of, slices, text_from, travels

MARK = "▁"
REMEMBERED = 400_000
UNKNOWN_PENALTY = 10.0


class Model(NamedTuple):
    """What the passes need of a model file."""

    pieces: list[str]  # "" where a piece is never text
    scores: list[float]
    byte_ids: list[int]
    unigram: bool


def load(path: str) -> Model:
    """Read a model file (on the driver; the result travels with the tasks)."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only models that keep texts as they are and put a mark in front are supported")
    kinds = proto.ModelProto.SentencePiece
    pieces = [p.piece if p.type == kinds.NORMAL else "" for p in model.pieces]
    for p in pieces:
        if "\n" in p or MARK in p.lstrip(MARK):
            raise ValueError(f"piece {p!r} crosses a cut between words")
    byte_ids = [i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE]
    if len(byte_ids) != 256:
        raise ValueError("only models with byte pieces are supported")
    return Model(pieces, [p.score for p in model.pieces], byte_ids, model.trainer_spec.model_type == proto.TrainerSpec.UNIGRAM)


class Forward:
    """Walks sorted words as a trie."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.id = {p: i for i, p in enumerate(model.pieces) if p}
        self.floor = min((model.scores[i] for i in self.id.values()), default=0.0) - UNKNOWN_PENALTY
        self.root: dict = {}
        self.parts: dict[int, tuple[int, int]] = {}  # last merge of a piece
        self.known: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        # merges in their order; a piece that its own merges do not yield is never used
        order = sorted((i for p, i in self.id.items() if len(p) > 1), key=lambda i: -model.scores[i])
        self.rank = {i: k for k, i in enumerate(order)}
        usable = [i for p, i in self.id.items() if len(p) == 1]
        if model.unigram:
            usable = list(self.id.values())
        else:
            for i in order:
                if (split := self._last_merge(model.pieces[i])) is not None:
                    self.parts[i] = split
                    usable.append(i)
        for i in usable:
            node = self.root
            for c in model.pieces[i]:
                node = node.setdefault(c, {})
            node[""] = i

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        parts = list(piece)
        while len(parts) > 2:
            best = min(((self.rank[i], k) for k in range(len(parts) - 1) if (i := self.id.get(parts[k] + parts[k + 1])) in self.rank), default=None)
            if best is None:
                return None
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        ids = tuple(self.id.get(p, -1) for p in parts)
        return ids if len(ids) == 2 and min(ids) >= 0 else None

    def apart(self, a: int, b: int) -> bool:
        """Do merges leave pieces a and b apart when they stand side by side?"""
        key = a << 32 | b
        if (found := self.known.get(key)) is None:
            if len(self.known) > 3_000_000:
                self.known.clear()
            found = self.known[key] = self._apart(a, b)
        return found

    def _apart(self, a: int, b: int) -> bool:
        limit = len(self.rank) + 1
        text = self.model.pieces
        while True:
            over = self.rank.get(self.id.get(text[a] + text[b], -1))
            if over is not None and over < limit:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra > rb:  # undo the later merge of the two and look again
                limit, a = ra, self.parts[a][1]
            elif rb < 0:
                return True
            else:
                limit, b = rb + 1, self.parts[b][0]

    def encode(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each word; remembers them."""
        new = sorted(w for w in words if w not in self.words)
        if len(self.words) + len(new) > REMEMBERED:
            self.words = {}
            new = sorted(words)
        last, back, score, alive = [-1], [0], [0.0], [[]]
        root, unigram, scores, byte_ids, floor, apart = self.root, self.model.unigram, self.model.scores, self.model.byte_ids, self.floor, self.apart
        before = ""
        for word in new:
            k, most = 0, min(len(word), len(before))
            while k < most and word[k] == before[k]:
                k += 1
            del last[k + 1 :], back[k + 1 :], score[k + 1 :], alive[k + 1 :]
            for i in range(k, len(word)):
                c = word[i]
                going, piece, start, best = [], -1, i, 0.0
                for j, node in [*alive[i], (i, root)]:
                    if (node := node.get(c)) is None:
                        continue
                    going.append((j, node))
                    t = node.get("")
                    if t is None:
                        continue
                    if unigram:
                        s = score[j] + scores[t]
                        if piece < 0 or s > best:
                            piece, start, best = t, j, s
                    elif piece < 0 and (j == 0 or last[j] < 0 or apart(last[j], t)):
                        piece, start = t, j
                if unigram and "" not in root.get(c, ()) and (piece < 0 or score[i] + floor > best):
                    piece, start, best = -1, i, score[i] + floor
                last.append(piece)
                back.append(start)
                score.append(best)
                alive.append(going)
            ids: list[int] = []
            at = len(word)
            while at:
                if last[at] >= 0:
                    ids.append(last[at])
                else:
                    ids.extend(byte_ids[b] for b in reversed(word[back[at] : at].encode()))
                at = back[at]
            self.words[word] = tuple(reversed(ids))
            before = word
        return self.words


def marked_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(starts, numbers, spellings) of the marked words of each text; a space stands for the mark."""
    text = pc.replace_substring(text, MARK, " ")
    text = pc.if_else(pc.equal(text, ""), text, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))
    offsets, raw = bytes_of(text)
    if not len(raw):
        return np.zeros(len(text) + 1, np.int64), np.zeros(0, np.int64), []
    line = raw == 10
    space = raw == 32
    cut = line | space
    cut[1:] &= ~(space[1:] & space[:-1])
    cut[1:] |= line[:-1]
    cut[offsets[:-1][offsets[:-1] < len(raw)]] = True
    at = np.flatnonzero(cut)
    coded = text_from(np.append(at, len(raw)), raw).dictionary_encode()
    starts = np.searchsorted(at, offsets)
    return starts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), [w.replace(" ", MARK) for w in coded.dictionary.to_pylist()]


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def encode_slice(forward: Forward, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of words, starts of ids, ids) of each text."""
    starts, numbers, spellings = marked_words(text)
    known = forward.encode(spellings)
    lists = [known[w] for w in spellings]
    sizes = np.fromiter((len(x) for x in lists), np.int64, len(lists))
    flat = np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    per_word = sizes[numbers]
    ids = flat[_spread(first[numbers], per_word)] if len(numbers) else flat
    return starts, np.concatenate(([0], np.cumsum(per_word)))[starts], ids


class Speller:
    """Turns ids back into text."""

    def __init__(self, model: Model) -> None:
        of_byte = {i: bytes([b]) for b, i in enumerate(model.byte_ids)}
        table = [of_byte.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(model.pieces)]
        self.raw = np.frombuffer(b"".join(table), np.uint8)
        self.size = np.array([len(t) for t in table], np.int64)
        self.first = np.cumsum(self.size) - self.size

    def text(self, starts: np.ndarray, ids: np.ndarray) -> pa.Array:
        sizes = self.size[ids]
        raw = self.raw[_spread(self.first[ids], sizes)] if len(ids) else np.zeros(0, np.uint8)
        offsets = np.concatenate(([0], np.cumsum(sizes)))[starts]
        keep = np.ones(len(raw), bool)
        own = offsets[:-1][np.diff(offsets) > 0]
        keep[own[raw[own] == 32]] = False  # the mark in front
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, text_from(offsets, raw[keep]).buffers())
        try:
            return binary.cast(pa.large_string())
        except pa.ArrowInvalid:  # ids that no text gives
            return pa.array([b.decode("utf-8", "replace") for b in binary.to_pylist()], pa.large_string())


def _encode(model: Model, check: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward, speller = Forward(model), Speller(model)
        for rows, text in slices(batches, most=SMALL_SLICE):
            _, starts, ids = encode_slice(forward, text)
            same = pc.equal(speller.text(starts, ids), pc.replace_substring(text, MARK, " ")) if check else pa.nulls(len(text), pa.bool_())
            yield pa.record_batch(
                [rows.column("doc_id").cast(pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32())), same],
                ["doc_id", "n_tokens", "ids", "round_trip"],
            )

    return encode


def encode(docs: DataFrame, model: Model, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids and whether they decode to the text (null unless ``check``)."""
    return docs.select("doc_id", "text").mapInArrow(_encode(model, check), "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """doc_id and text of rows with ``ids`` (null: empty)."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(model)
        for batch in batches:
            lists = batch.column("ids")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            text = speller.text(np.concatenate(([0], np.cumsum(sizes))), lists.flatten().to_numpy(zero_copy_only=False))
            yield pa.record_batch([batch.column("doc_id"), text.cast(pa.string())], ["doc_id", "text"])

    return encoded.select(encoded.doc_id.cast("long").alias("doc_id"), "ids").mapInArrow(spell, "doc_id long, text string")


def _count(models: list[Model]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = [Forward(m) for m in models]
        for rows, text in slices(batches):
            starts, numbers, spellings = marked_words(text)
            totals = []
            for forward in passes:
                known = forward.encode(spellings)
                sizes = np.fromiter((len(known[w]) for w in spellings), np.int64, len(spellings))
                own = np.concatenate(([0], np.cumsum(sizes[numbers]))) if len(numbers) else np.zeros(1, np.int64)
                totals.append(np.diff(own[starts]))
            yield pa.record_batch(
                [rows.column("doc_id").cast(pa.int64()), pa.array(np.diff(starts), pa.int64()), *(pa.array(t, pa.int64()) for t in totals)],
                ["doc_id", "n_words", "n_tokens", "n_unigram"],
            )

    return count


def token_counts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words (marked words), n_tokens (as the file's own model), n_unigram (by scores)."""
    return docs.select("doc_id", "text").mapInArrow(_count([model, model._replace(unigram=True)]), "doc_id long, n_words long, n_tokens long, n_unigram long")


travels(__name__)
