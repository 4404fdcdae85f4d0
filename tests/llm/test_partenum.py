"""The n-gram Jaccard join against all pairs."""

import itertools
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from stridelake.llm import op10_partenum as op


def plain_sets(rows):
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def plain(rows):
    sets, label = plain_sets(rows), list(range(len(rows)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 0.7 * len(a) <= len(b) <= 1.4 * len(a) and 100 * len(a & b) >= 80 * len(a | b):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d if d is not None else -1, len(s), least[find(i)] if d is not None else -1) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def got(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    return sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in op.link(docs).collect())


def made(seed, n, sizes, edits):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=3))
    common, rows = [word() for _ in range(60)], []
    while len(rows) < n:
        base = [word() for _ in range(rng.choice(sizes))]
        if rng.random() < 0.4:
            base += common
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice(edits)):
                if copy:
                    at = rng.randrange(len(copy))
                    copy[at : at + rng.choice([0, 1])] = [word()]
            rows.append((len(rows) * 7 % 9973, " ".join(copy)))
    return rows


def test_small_sets_and_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (None, "a b"), (8, "a b c d e"), (9, "a b c d e"), (9, "a b c d e"), (10, "a b c d e a b c d e"), (11, "a b c d e a b c d e f")]
    assert got(spark, rows) == plain(rows)
    assert got(spark, [(1, "")]) == [(1, 0, 1)]
    assert op.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_against_all_pairs(spark):
    rows = made(1, 100, [6, 9, 14, 30], [0, 1, 2]) + [(20_000 + d, t) for d, t in made(2, 130, [80, 120, 300], [0, 2, 5, 9, 14])]
    assert got(spark, rows) == plain(rows)


def test_chains_of_near_copies(spark):
    rng = random.Random(5)
    text, rows = [str(rng.random()) for _ in range(200)], []
    for k in range(40):
        text = list(text)
        text[(k * 3) % 200] = str(rng.random())
        rows.append((1000 - k, " ".join(text)))
    rng.shuffle(rows)
    assert got(spark, rows) == plain(rows)


def test_test_tables(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    found = got(spark, rows)
    assert found == plain(rows) and len({c for _, _, c in found}) < len(found)


def test_signatures_that_a_link_shares():
    rng = np.random.default_rng(3)
    for n in (4, 5, 9, 40, 333):
        for _ in range(20):
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            gone, new = rng.integers(0, n // 9 + 1), rng.integers(0, n // 9 + 1)
            y = np.concatenate([x[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)])
            both = n - gone
            if 100 * both < 80 * (n + new):
                continue
            a, b = op.signatures(np.sort(x)), op.signatures(np.sort(y))
            assert (gone == new == 0) or any(len(np.intersect1d(s, t)) >= max(k, m) >= 1 for s, k in a for t, m in b)


def test_least_shared_against_all_ways_to_differ():
    for h in range(7):
        ways = itertools.product(range(3), repeat=3)
        shared = min(sum(math.comb(3 - d, 2) if d < 2 else 0 for d in way) for way in ways if sum(way) <= h)
        assert op.least_shared(3, h) == shared


def test_without_stars(spark, monkeypatch):
    """What no star finds, the counts of elements find; rows that a task knows as shared still tell other tasks."""
    monkeypatch.setattr(op, "_starred", lambda opened, arrays: (opened.where("place = 1").selectExpr("node", "node label"), opened.selectExpr("node a", "node b").limit(0)))
    monkeypatch.setattr(op, "HELD", 4000)
    rows = made(7, 90, [40, 80, 120], [0, 2, 4, 7, 9, 11, 14])
    assert got(spark, rows) == plain(rows)
    rng, base, rows = random.Random(9), [f"w{k}" for k in range(150)], []
    for k in range(60):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            copy[rng.randrange(150)] = str(rng.random())
        rows.append((k, " ".join(copy)))
    assert got(spark, rows) == plain(rows)


class Taken:
    """Stands for a DataFrame and gives the function that its tasks run."""

    def mapInArrow(self, rows, _):
        return rows


def test_tasks_hold_and_pass_on_little(monkeypatch):
    """Signatures are held in few bytes; the JVM gets small batches, whatever a task holds or reads."""
    monkeypatch.setattr(op, "HELD", 1 << 18)
    rng = random.Random(4)
    for words, n, copies in ((300, 1500, 1), (300, 50, 30), (12, 12_000, 1)):
        texts = [" ".join(map(str, rng.choices(range(10**6), k=words))) for _ in range(n)] * copies
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
        for made in (op.signed, op.set_arrays):
            tracemalloc.start()
            largest = max(b.nbytes for b in made(Taken(), 0)(iter([batch])))
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert largest <= 1 << 21 and peak <= 10 << 20


def test_words_of_any_length():
    long = "x" * 70_000
    texts = [f"{long} b c d e", "A b\x1cc d  e f", None, "", f"{long} b c d e f", "a b\x1cc d e f", "é " * 3, "é é é", f"{long[1:]} b c d e"]
    sets = [tuple(u) for u in op.batch_shingles(texts)]
    assert [len(u) for u in sets] == [1, 1, 0, 0, 2, 1, 1, 1, 1]
    assert sets[0][0] in sets[4] and sets[1] == sets[5] and sets[6] == sets[7] and sets[0] != sets[8]
    many = [" ".join(map(str, range(k, k + 3000))) for k in range(0, 900_000, 3000)]
    assert [u.tolist() for u in op.batch_shingles(many)] == [op.batch_shingles([t])[0].tolist() for t in many]


def test_words_that_defeat_polynomials(spark):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo a power of two, whatever the base."""
    for n in (1024, 4096):
        bits = [bin(k).count("1") % 2 for k in range(n)]
        one, two = ("".join(pair[b] for b in bits) for pair in ("ab", "ba"))
        for seed in range(3):
            a, b = (op.batch_shingles([t], seed)[0] for t in (one, two))
            assert len(a) == len(b) == 1 and a[0] != b[0]
    assert got(spark, [(1, one), (2, two), (3, one)]) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_word_hashes_tell_lengths_and_places_apart():
    words = [c * n for c in "ab" for n in range(1, 70)] + ["a" * k + "b" + "a" * (20 - k) for k in range(21)]
    texts = words + [f"{w} x" for w in words]
    assert len({tuple(u) for u in op.batch_shingles(texts)}) == len(texts)


def test_keep_one(spark):
    docs = spark.createDataFrame([(3, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "y"), (2, "q", "z"), (None, "q", "z")], "doc_id long, text string, component_id string")
    kept = sorted((r[0] or 0, r[2]) for r in op.keep_one(docs).collect())
    assert kept == [(0, "z"), (1, "y"), (2, "z")]
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n", {"k": "x"}), (1, "a b c d e f g h i j k l m n o", None), (1, "other words that it has under one id", None), (2, " ", None)], "doc_id long, text string, row map<string,string>")
    assert sorted(r[1][:2] for r in op.keep_one(docs).collect()) == [" ", "a ", "ot"]
