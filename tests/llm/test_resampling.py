"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from noticeflow.llm import queries, resampling
from noticeflow.llm.batches import text_of
from tests.llm.test_operators import DOCS, lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def features(text, longest=3):
    own = re.findall(WORD, lower(text))
    return [" ".join(own[i : i + k]) for k in range(1, longest + 1) for i in range(len(own) - k + 1)], len(own)


def plain(docs, target, buckets=10_000, share=5, least=20):
    """{row: (n_features, weight, score, rank)} by the definition."""
    code = lambda f: zlib.crc32(f.encode()) % buckets
    own = [features(t) for _, t in docs]
    s = Counter(code(f) for fs, _ in own for f in fs)
    t = Counter(code(f) for x in target for f in features(x)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for (doc, _), (fs, n) in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(code(f)) for f in fs)
        rows.append([doc, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for rank, r in enumerate(enough[: share * len(enough) // 100], 1):
        r[5] = rank
    return [(r[0], *r[2:]) for r in rows]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(3)
    pool = ["".join(rnd.choice("abcdeÄéß漢") for _ in range(rnd.randint(1, 9))) for _ in range(300)] + ["A", "x" * 80, "y" * 200, "9"]
    text = lambda n: "".join(rnd.choice(pool) + rnd.choice([" ", "\n", "--", "\x00", ". "]) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 60))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, " .,\n"), (303, "word " * 30_000), (304, "z" * 1_000_000 + " end")]
    docs += [(305, docs[7][1]), (7, docs[7][1]), (7, docs[8][1]), (None, docs[9][1])]
    docs += [(9, docs[9][1])] * 150  # one doc_id with a third of the rows
    target = [docs[3][1], text(40), None, ""]
    root = str(tmp_path_factory.mktemp("resampling"))
    rows = [(i, t, "en", "s", 1, 2, 3) for i, t in docs]
    spark.createDataFrame(rows, DOCS + ", rank int, weight long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(list(enumerate(target)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, docs, target


def test_query_equals_plain_version(spark, tables):
    root, docs, target = tables
    got = queries.op11_importance_resampling(spark, root)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert ordered(map(tuple, got.collect())) == ordered(plain(docs, target))


def test_layout_of_the_files_does_not_matter(spark, tables):
    root, _, _ = tables
    docs = spark.read.parquet(f"{root}/documents.parquet").repartition(7, "text")
    got = resampling.resample(docs, spark.read.parquet(f"{root}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")
    assert ordered(map(tuple, got.collect())) == ordered(map(tuple, queries.op11_importance_resampling(spark, root).collect()))


def test_drawn_documents_keep_their_columns(spark, tables):
    root, _, _ = tables
    docs, target = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "benchmark"))
    ranks = resampling.resample(docs, target, share=(1, 4), least_words=1)
    got = resampling.drawn(docs, ranks)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in ranks.where("rank IS NOT NULL AND doc_id IS NOT NULL").collect()}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    target = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(docs, target).collect() == []
    some = spark.createDataFrame([(1, "a b " * 15, "en", "s", 1)], DOCS)
    got = resampling.resample(some, target, share=(1, 1)).collect()
    assert [(r.doc_id, r["rank"], r.n_words) for r in got] == [(1, 1, 30)]


def test_keys_are_xxhash64_of_the_bytes():
    data = bytes(range(256)) * 2
    wide = np.ndarray(len(data), "<u8", data + bytes(8), 0, (1,)).copy()
    at = np.arange(300)
    for size in range(1, 32):
        assert resampling._hash(wide, at, size).tolist() == [xxhash.xxh64_intdigest(data[a : a + size]) for a in at.tolist()]


def test_equal_keys_with_other_bytes_stay_apart(monkeypatch):
    monkeypatch.setattr(resampling, "_hash", lambda wide, at, size: np.full(len(at), 5, np.uint64))
    monkeypatch.setattr(resampling.xxhash, "xxh64_intdigest", lambda data: 5)
    texts = ["a bb a cc bb", "a bb " + "q" * 40 + " " + "r" * 40 + " " + "q" * 40 + " a"]
    words = resampling.spell(text_of(pa.array(texts)))
    found = resampling.runs(words, 3)
    table = resampling.intern(words.raw, np.concatenate([a for _, a, _ in found]), np.concatenate([b for _, _, b in found]))
    data = words.raw.tobytes()
    spelled = [data[a:b] for _, starts, ends in found for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    assert [data[table.starts[s] : table.ends[s]] for s in table.slots.tolist()] == spelled
    assert table.counts.tolist() == [spelled.count(data[a:b]) for a, b in zip(table.starts.tolist(), table.ends.tolist(), strict=True)]
    codes = resampling.buckets_of(words, found, table, 997)
    assert codes.tolist() == [zlib.crc32(data[a:b]) % 997 for a, b in zip(table.starts.tolist(), table.ends.tolist(), strict=True)]
