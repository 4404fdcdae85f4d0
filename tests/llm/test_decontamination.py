"""Decontamination against windows looked up one by one."""

import random
import re
from hashlib import sha256

import pytest

from stridelake.llm import op13_decontamination as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, bench, window=10):
    windows = {}
    for i, t in bench:
        w = cut(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, items = cut(t), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if found := windows.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    items |= found
        out.append((d, len(w), len(hit), len(items), sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def made(seed, words="a b c d E é 7"):
    draw = random.Random(seed)
    text = lambda n: "".join(draw.choice(words.split()) + draw.choice([" ", " ", ", ", "\n", "-"]) for _ in range(n))
    bench = [(k, text(draw.choice([1, 2, 5, 9, 10, 11, 30]))) for k in range(25)]
    return [(k, text(draw.choice([0, 1, 9, 40, 300]))) for k in range(60)], bench


def found(df):
    rows = df.collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), sha256(",".join(r["items"]).encode()).hexdigest(), r["n_hit"] > 0) for r in rows), key=str)


@pytest.mark.parametrize(("block", "chunk"), [(op.BLOCK, op.CHUNK), (200, 50)])
@pytest.mark.parametrize("kind", ["few words", "no short items", "table"])
def test_against_all_windows(spark, sf, kind, block, chunk):
    if kind == "table":
        docs, bench = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
        block = 3000 if block == 200 else block
        parts = bench[0][1].split()
        docs += [(900, " ".join(["x", *parts[2:14], "y", *parts[2:11]])), (901, "-".join(parts).upper() * 3), (None, " ".join(parts[1:11])), (902, "w " * 400_000 + bench[3][1])]
    else:
        docs, bench = made(4) if kind == "few words" else made(5, " ".join(f"w{k}" for k in range(40)))
        bench = bench if kind == "few words" else [(i, t + " w1 w2 w3 w4 w5 w6 w7 w8 w9 w0") for i, t in bench]
        docs += [(70 + k, (bench[k][1] + " z ") * 2) for k in range(9)] + [docs[3]]
    docs += [(None, None), (1000, ""), (1001, "...")]
    bench += [(None, "null id a b c d e f g h i j"), (5000, None), (5001, "!"), bench[2], (bench[2][0], "the same id again and again and again and again")]
    a = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_hit int, items string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    assert found(op.scan(a, b, block=block, chunk=chunk)) == plain(docs, bench)


def test_empty(spark):
    a, b = spark.createDataFrame([(1, "some text")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert found(op.scan(a, b)) == plain([(1, "some text")], []) and op.scan(a.limit(0), b).count() == 0


def test_automaton_against_substrings():
    draw = random.Random(8)
    items = [(str(k), [draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randint(1, 14))]) for k in range(30)]
    a = op.Automaton(items, 4)
    subs = {tuple(w[i:j]) for _, w in items for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    for _ in range(200):
        words = [draw.choice([b"a", b"b", b"c", b"d"]) for _ in range(20)]
        v = 0
        for w in words:
            v = a.next[v].get(a.vocabulary.get(w, -1), -1)
            if v < 0:
                break
        for k in range(1, 21):
            at = 0
            for w in words[:k]:
                at = a.next[at].get(a.vocabulary.get(w, -1), -1) if at >= 0 else -1
            assert (at >= 0) == (tuple(words[:k]) in subs)


def test_clean(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Before it. {item.title()}! After it " + "and more " * 12, 5), (2, f"mostly {item}", 5), (3, "Nothing  here.", 5), (4, None, 5)]
    got = op.clean(spark.createDataFrame(rows, "doc_id long, text string, spans int"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got.columns == ["doc_id", "text", "spans"]
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "Before it. ! After it " + "and more " * 12, 3: "Nothing  here.", 4: None}
