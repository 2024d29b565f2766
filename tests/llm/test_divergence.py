"""Source divergence against a plain version."""

import random
import re
from collections import Counter, defaultdict

import pytest

from noticeflow.llm import divergence, queries
from tests.llm.test_operators import DOCS, lower

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def plain(docs, least=10, top=10):
    """{(lang, source, part, item): (value, rank)} by the definition."""
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        own = Counter(re.findall(TERM, lower(text)))
        counts[lang or "", source or ""].update(own)
        seen[lang or ""].update(own.keys())
    rows = set()

    def rank(key, part, values, most):
        for k, (item, value) in enumerate(sorted(values, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
            rows.add((*key, part, item, value, k))

    for lang in seen:
        kept = [t for t, n in seen[lang].items() if n >= least]
        groups = {s: c for (own, s), c in counts.items() if own == lang}
        groups[None] = sum(groups.values(), Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            if s is None:
                continue
            rank((lang, s), "pair", [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o not in (s, None)], None)
            rank((lang, s), "term", [(t, f(p[s][t], p[None][t])) for t in kept if groups[s][t] and p[s][t] > p[None][t]], top)
    return rows


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(5)
    pool = ["".join(rnd.choice("abÄé漢ß") for _ in range(rnd.randint(1, 3))) for _ in range(60)]
    rows = []
    for _ in range(400):
        source = rnd.choice(["hot"] * 4 + ["s1", "s2", "s3", None, "", "Ä"])
        lang = rnd.choice(["en", "en", "de", None])
        some = pool[:20] if source == "hot" else pool[10:] if source == "s1" else pool
        rows.append((rnd.choice([" ", "1", "-\n", "\x00"]).join(rnd.choice(some) for _ in range(rnd.randint(0, 30))), lang, source))
    rows += [(None, "fr", "s1"), ("", "fr", "s2"), ("few terms here", "fr", "s9"), ("1 2 3", "xx", "only")]
    rows += [("again AGAIN again", "en", "s3")] * 12 + [("long " * 200_000 + "x" * 500_000, "en", "s2")]
    return rows


def frame(spark, docs, **more):
    rows = [(i, t, lang, s, 0, "a", 1) for i, (t, lang, s) in enumerate(docs)]
    return spark.createDataFrame(rows, DOCS + ", term string, p int")


def test_equals_plain_version(spark, docs):
    got = divergence.divergence(frame(spark, docs))
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain(docs)


def test_flushed_tasks_and_cut_trees_add_up(spark, docs, monkeypatch):
    for name, small in (("HELD_TERMS", 50), ("WALKED", 7), ("SLICE", 500)):
        monkeypatch.setattr(divergence, name, small)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = divergence.divergence(frame(spark, docs).repartition(9), top=3)
        assert {tuple(r) for r in got.collect()} == plain(docs, top=3)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark):
    assert divergence.divergence(frame(spark, []).limit(0)).collect() == []


def test_shares_are_exact_beyond_64_bits(spark):
    count, total, terms = 4_000_000_000_123, 9_000_000_000_777, 123_456_789
    row = spark.range(1).selectExpr(f"{count} AS c", f"{total} AS n", f"{terms} AS v")
    got = row.select(divergence.share_of(row.c, row.n, row.v)).first()[0]
    assert got == 1 + 1_000_000_000 * (count + 2) // (total + 2 * terms)


def test_registered():
    assert "op12_source_divergence" in queries.QUERIES and "op12_source_divergence" in queries.ORACLES
