"""Secret scans over a trigram inverted index.

Every rule is a regular expression. From its parse tree a Boolean query over byte trigrams of the
lower-cased text is derived (the texts that a match must contain); each slice of documents gets an
index with the postings of the trigrams that any query names; postings are joined by AND and OR,
and only the candidates meet the expression. A rule from which no trigram follows scans every
document. The index of a slice lives in the task that reads it, so nothing is shuffled.

A private key runs from its BEGIN line to the END line of the same label, or to the end of the text
if none follows.

Defined cases: null or empty text has no spans; repeated rows are scanned each; an empty table
gives an empty result; other columns are kept by ``redact`` and ignored by ``find_secrets``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import product
from re import _constants as sre  # names of the nodes of a parsed expression
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from noticeflow.llm.batches import bytes_of, slices, travels

#: (kind, expression, group that must be long, its least length, part of the base rules). Fixed values.
RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    ("hex", r"[0-9a-f]{32,}", 0, 32, True),
    ("private_key", r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----[\s\S]*?(?:-----END \1-----|\Z)", 0, 0, False),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, False),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, False),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0, False),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]{20,}", 0, 0, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0, False),
)
BASE_KINDS = tuple(r[0] for r in RULES if r[4])
MOST_STRINGS = 64

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_extra long"


def trigram_query(expression: str) -> list[list[set[str]]]:
    """AND of ORs of trigram sets: each clause lists alternatives, each a set that must all occur.

    Runs of exactly known text are expanded to all their (lower-cased) spellings; a run ends at
    anything else. A run gives a clause if every spelling has a trigram. No clause: scan fully.
    """
    clauses: list[list[set[str]]] = []

    def close(run: set[str]) -> None:
        if run and all(len(s) >= 3 for s in run):
            clauses.append([{s[i : i + 3] for i in range(len(s) - 2)} for s in sorted(run)])

    def spellings(node) -> set[str] | None:
        """All texts of a node if they are few and known."""
        op, arg = node
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            return {chr(a).lower() for _, a in arg}
        if op is sre.SUBPATTERN:
            return sequence(arg[3])
        if op is sre.BRANCH:
            found = [sequence(p) for p in arg[1]]
            return None if None in found else set().union(*found)
        if op is sre.MAX_REPEAT and arg[1] <= 2:
            once = sequence(arg[2])
            return None if once is None else {"".join(p) for k in range(arg[0], arg[1] + 1) for p in product(once, repeat=k)}
        return None

    def sequence(nodes) -> set[str] | None:
        result = {""}
        for node in nodes:
            own = spellings(node)
            if own is None or len(result) * len(own) > MOST_STRINGS:
                return None
            result = {a + b for a in result for b in own}
        return result

    def walk(nodes) -> None:
        run = {""}
        for node in nodes:
            own = spellings(node)
            if own is not None and len(run) * len(own) <= MOST_STRINGS:
                run = {a + b for a in run for b in own}
                continue
            close(run)
            run = {""}
            if own is not None:
                run = own
            elif node[0] is sre.SUBPATTERN:
                walk(node[1][3])
            elif node[0] is sre.MAX_REPEAT and node[1][0] >= 1:
                walk(node[1][2])
        close(run)

    walk(_parser.parse(expression))
    return clauses


class Index:
    """Postings of the named trigrams over one slice of texts."""

    def __init__(self, text: pa.Array, names: list[bytes]) -> None:
        offsets, raw = bytes_of(pc.ascii_lower(text))
        self.size, self.postings = len(text), {}
        code = np.zeros(0, np.uint32)
        if len(raw) >= 3:
            wide = raw.astype(np.uint32)
            code = wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]
        wanted = np.zeros(1 << 24, bool)
        keys = [int.from_bytes(n, "big") for n in names]
        wanted[keys] = True
        at = np.flatnonzero(wanted[code])
        doc = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[doc + 1]
        found = np.unique(code[at[inside]].astype(np.int64) * max(1, self.size) + doc[inside])
        for name, key in zip(names, keys, strict=True):
            low, high = np.searchsorted(found, [key * max(1, self.size), (key + 1) * max(1, self.size)])
            self.postings[name] = found[low:high] - key * max(1, self.size)

    def select(self, clauses: list[list[set[bytes]]]) -> np.ndarray:
        """Documents that satisfy every clause."""
        chosen = None
        for clause in clauses:
            either = np.zeros(self.size, bool)
            for names in clause:
                every = np.ones(self.size, bool)
                for name in names:
                    has = np.zeros(self.size, bool)
                    has[self.postings[name]] = True
                    every &= has
                either |= every
            chosen = either if chosen is None else chosen & either
        return np.arange(self.size) if chosen is None else np.flatnonzero(chosen)


class Scanner:
    """Compiled rules with their trigram queries."""

    def __init__(self, rules=RULES) -> None:
        self.rules = [(kind, re.compile(e), group, least, [[{t.encode() for t in s} for s in c] for c in trigram_query(e)]) for kind, e, group, least, _ in rules]
        self.names = sorted({t for *_, clauses in self.rules for c in clauses for s in c for t in s})
        self.wide = {kind: e for kind, e, *_ in rules}

    def scan(self, text: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Per text the spans (start, end, number of the rule), sorted by start, then rule."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(text))]
        index = Index(text, self.names)
        cached: dict[int, str] = {}
        for number, (kind, expression, group, least, clauses) in enumerate(self.rules):
            candidates = index.select(clauses)
            if not clauses:  # full scan of every document, by the vectorised matcher
                candidates = np.flatnonzero(pc.match_substring_regex(text, self.wide[kind]).to_numpy(zero_copy_only=False))
            for d in candidates.tolist():
                if d not in cached:
                    cached[d] = text[d].as_py()
                found[d].extend((*m.span(), number) for m in expression.finditer(cached[d]) if len(m.group(group)) >= least)
        return [sorted(f, key=lambda s: (s[0], s[2])) for f in found]


def _scan(rules):
    kinds = [r[0] for r in rules]
    base = [r[4] for r in rules]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for rows, text in slices(batches):
            counts = {k: [] for k in ("assign", "access", "hex", "extra")}
            digests, spans = [], []
            for own in scanner.scan(text):
                told = [(f"{kinds[n]}:{a}:{b}", base[n]) for a, b, n in own]
                for k in ("assign", "access", "hex"):
                    counts[k].append(sum(kinds[n] == k for _, _, n in own))
                counts["extra"].append(sum(not b for _, b in told))
                digests.append(hashlib.sha256(",".join(t for t, b in told if b).encode()).hexdigest())
                spans.append(",".join(t for t, _ in told))
            yield pa.record_batch(
                [rows.column("doc_id").cast(pa.int64()), *(pa.array(counts[k], pa.int64()) for k in ("assign", "access", "hex")), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(counts["extra"], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_extra"],
            )

    return scan


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans."""
    return docs.select("doc_id", "text").mapInArrow(_scan(rules), SCHEMA)


def redact(docs: DataFrame, rules=RULES) -> DataFrame:
    """Documents with every secret replaced by ``[kind]``; ``n_chars`` follows the text if present."""

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for rows, text in slices(batches):
            changed = {}
            for d, own in enumerate(scanner.scan(text)):
                if not own:
                    continue
                old, parts, at = text[d].as_py(), [], 0
                for a, b, n in own:
                    if a >= at:
                        parts += [old[at:a], f"[{scanner.rules[n][0]}]"]
                    at = max(at, b)
                changed[d] = "".join([*parts, old[at:]])
            if changed:
                number = rows.schema.get_field_index("text")
                texts = rows.column(number).to_pylist()
                for d, new in changed.items():
                    texts[d] = new
                columns = rows.columns
                columns[number] = pa.array(texts, rows.schema.field(number).type)
                if "n_chars" in rows.schema.names:
                    number = rows.schema.get_field_index("n_chars")
                    sizes = columns[number].to_pylist()
                    for d, new in changed.items():
                        sizes[d] = len(new)
                    columns[number] = pa.array(sizes, rows.schema.field(number).type)
                rows = pa.record_batch(columns, schema=rows.schema)
            yield rows

    return docs.mapInArrow(replace, docs.schema)


travels(__name__)
