"""URL rules by Bloom filter cascades: exact membership without a join.

Keys are the texts of rules: host and path prefix. The universe of a cascade are all keys that the
corpus can ask for, every parent domain of every host with at most as many labels as some rule's,
with every prefix of the path that is as long as some rule's. Level 1 is a Bloom filter of the listed keys, level 2 one of the keys of the
universe that pass level 1 without being listed, level 3 one of the listed keys that pass level 2,
and so on until nothing passes wrongly. The first level that rejects a key decides: an odd one says
not listed, an even one listed. Level 1 lets about as many unlisted keys pass as there are listed
ones, so later levels are small; the corpus is read for each level of each list; the filters grow with the list
and the logarithm of the corpus.

One cascade holds the rules that block, one those that allow. Filters are literals of the plan, at
most ``MOST_BITS`` bits in all (checked); a longer list is asked for as several lists.

Defined cases: null url or one without ``://`` has empty host and path, fits no rule and is allowed;
repeated rows are judged each; an empty table gives an empty result, an empty list allows all; a
rule that is listed twice, or to block and to allow, counts once, to block; other columns are kept.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 25

#: (rule, action). Fixed values.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


class Level(NamedTuple):
    salt: int
    bits: int
    hashes: int
    words: list[int]


def with_parts(pages: DataFrame) -> DataFrame:
    """host and path of ``url``; both empty without ``://``."""
    rest = F.regexp_extract(F.col("url"), r"(?s)^.*?://(.*)$", 1)
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return pages.withColumns({"host": host, "path": path})


def keys(lengths: list[int], labels: int) -> Column:
    """All rule texts that would fit, longest first: longer hosts, then longer paths.

    ``lengths`` of path prefixes and the most ``labels`` of a host come from the rules, so a host
    with thousands of labels asks for no more keys than another one.
    """
    if not lengths:
        return F.expr("cast(array() AS array<string>)")
    sizes = ", ".join(str(n) for n in sorted(lengths, reverse=True))
    most = f"least({labels}, length(host) - length(replace(host, '.', '')) + 1)"
    return F.expr(
        f"CASE WHEN host = '' THEN cast(array() AS array<string>) ELSE flatten(transform(sequence({most}, 1, -1), i -> "
        f"transform(filter(array({sizes}), n -> n <= length(path)), n -> "
        f"concat(substring_index(host, '.', -i), substr(path, 1, n))))) END"
    )


def _position(level: Level | tuple, key: str, i: str) -> str:
    salt, bits = level[0], level[1]
    return f"(pmod(xxhash64({key}, {salt}L), {bits}L) + {i} * (pmod(xxhash64({key}, {salt + 1}L), {bits}L) | 1L)) % {bits}L"


def passes(level: Level, key: str) -> str:
    """SQL: does a key pass one filter?"""
    words = "array(" + ", ".join(f"{w}L" if w >= 0 else f"({w + 1}L - 1L)" for w in level.words) + ")"
    at = _position(level, key, "cast(i AS bigint)")
    return f"forall(sequence(0, {level.hashes - 1}), i -> transform(array({at}), p -> getbit({words}[cast(p div 64 AS int)], cast(p % 64 AS int)))[0] = 1)"


def listed(cascade: list[Level], key: str) -> str:
    """SQL: is a key of the universe listed?"""
    answer = "true" if len(cascade) % 2 else "false"
    for number in range(len(cascade), 0, -1):
        answer = f"if({passes(cascade[number - 1], key)}, {answer}, {'false' if number % 2 else 'true'})"
    return answer


def _level(rows: DataFrame, n: int, rate: float, salt: int) -> Level:
    """Bloom filter of the column ``key``; its words come to the driver, bounded by ``MOST_BITS``."""
    hashes = max(1, round(-math.log2(rate)))
    bits = 64 * max(1, math.ceil(n * hashes / math.log(2) / 64))
    if bits > MOST_BITS:
        raise ValueError(f"a filter of {bits} bits is over {MOST_BITS}; split the list")
    at = F.expr(f"explode(transform(sequence(0L, {hashes - 1}L), i -> {_position((salt, bits), 'key', 'i')}))")
    found = rows.select(at.alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 AS int)))").alias("b")).collect()
    words = np.zeros(bits // 64, np.int64)
    for row in found:
        words[row.w] = row.b
    return Level(salt, bits, hashes, words.tolist())


def build(asked: DataFrame, size: int, members: DataFrame, salt: int) -> list[Level]:
    """Cascade of ``members`` (key) over the universe ``asked`` (keys, an array) with about ``size`` keys."""
    n = members.count()
    if not n:
        return []
    cascade = [_level(members, n, min(0.5, n * math.sqrt(0.5) / max(1, size)), salt)]
    wrong = (
        asked.select(F.explode("keys").alias("key")).where(passes(cascade[0], "key")).distinct()
        .join(members, "key", "left_anti")  # only what passes the filter comes here
    )
    inside = members
    while True:
        count = wrong.count()
        if not count:
            return cascade
        cascade.append(_level(wrong, count, 0.5, salt + 2 * len(cascade)))
        # what wrongly passes the new level: keys of the other side
        wrong, inside = inside.where(passes(cascade[-1], "key")), wrong


def url_filter(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """All columns with host, path, rule (null: none fits) and verdict (allow or block)."""
    parts = with_parts(pages)
    rules = rules.where("rule IS NOT NULL AND action IN ('allow', 'block')").groupBy("rule").agg(F.max("action").alias("action"))
    lengths = [r.n for r in rules.select(F.expr("length(rule) - instr(rule, '/') + 1").alias("n")).where("n > 0").distinct().orderBy("n").collect()]
    labels = rules.select(F.max(F.size(F.split(F.substring_index("rule", "/", 1), "[.]")))).first()[0] or 1
    asked = parts.select(keys(lengths, labels).alias("keys"))
    size = asked.agg(F.sum(F.size("keys"))).first()[0] or 0
    cascades = {a: build(asked, size, rules.where(F.col("action") == a).select(F.col("rule").alias("key")), 2 * k * 1000 + 1) for k, a in enumerate(("block", "allow"))}
    kind = f"CASE WHEN {listed(cascades['block'], 'k') if cascades['block'] else 'false'} THEN 'block' WHEN {listed(cascades['allow'], 'k') if cascades['allow'] else 'false'} THEN 'allow' END"
    # longest rule first; the first that is listed decides
    hits = F.expr(f"filter(transform(__keys, k -> named_struct('rule', k, 'action', {kind})), h -> h.action IS NOT NULL)")
    best = parts.withColumn("__keys", keys(lengths, labels)).withColumn("__hits", hits).drop("__keys")
    longest = F.expr("aggregate(__hits, cast(NULL AS struct<rule: string, action: string>), (b, h) -> if(b IS NULL OR length(h.rule) > length(b.rule), h, b))")
    return best.withColumn("__best", longest).withColumns({"rule": F.col("__best.rule"), "verdict": F.coalesce("__best.action", F.lit("allow"))}).drop("__hits", "__best")
