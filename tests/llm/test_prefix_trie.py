"""The prefix trie against a dictionary of prefixes."""

import math
import random
import re
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest

from stridelake.llm import op12_prefix_trie as trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """All nodes of the rebuilt conversations, by dictionaries over whole prefixes."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((-1 if turn is None else turn, role or "", text or ""))
    convs = {c: [t[1:] for t in sorted(v, key=lambda t: t[0])] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = crc32(str(c).encode()) % 4
        built[c] = tuple(convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest()) for p, m in members.items())


def found(df):
    return sorted(tuple(r[c] for c in [*trie.RESULT, "ends_sha256"]) for r in df.collect())


def key(row):
    return (row[0], row[1])


@pytest.mark.parametrize(("block", "fan"), [(trie.BLOCK, trie.FAN), (7, 2), (1, 3)])
def test_against_dictionary(spark, sf, block, fan):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    draw = random.Random(3)
    rows += [(100 + c, t, draw.choice(["user", None]), draw.choice(["a b", "a  c", "", None, "x"])) for c in range(90) for t in range(draw.randint(1, 6))]
    rows += [(200 + c, t, "user", f"same {t}") for c in range(70) for t in range(3)]
    rows += [(301, None, "user", "zero"), (301, 5, "user", "five"), (301, 0, "user", "nought"), (None, 0, "user", "lost"), (323, 0, "user", "w " * 50_000), (340, 0, "user", "é"), (-7, 1, "a", "b")]
    docs = spark.createDataFrame([(*r, "path", 1) for r in rows], "conv_id long, turn int, role string, text string, path string, base int")
    assert found(trie.trie(trie.rebuilt(docs), block, fan)) == plain(rows)


def test_long_conversation(spark):
    rows = [(c, t, "user", f"{t}") for c in (0, 1) for t in range(3000)]
    assert found(trie.trie(trie.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), 500, 2)) == plain(rows)


def test_empty_and_single(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert found(trie.trie(trie.rebuilt(spark.createDataFrame([], schema)))) == []
    assert found(trie.trie(trie.rebuilt(spark.createDataFrame([(4, None, None, None)] * 3, schema)))) == plain([(4, None, None, None)] * 3)


def test_median_insertion_is_balanced():
    tree = trie.Tree()
    for g in trie._medians(1023):
        tree.insert([g], [1], 1, g, g)
    deepest, open_ = 0, [(tree.down[0], 1)]
    while open_:
        at, level = open_.pop()
        if at >= 0:
            deepest = max(deepest, level)
            open_ += [(tree.low[at], level + 1), (tree.high[at], level + 1)]
    assert deepest == 10
