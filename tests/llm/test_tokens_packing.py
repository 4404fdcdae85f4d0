"""Re-Pair and packing against brute force; quality statistics against a plain loop."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.llm import op3_repair, op4_packing, op8_quality, tokens

ROWS = [(3, "a b a b a b", "x", 7), (1, None, "y", 7), (None, "null id", None, 7), (2, "", "x", 7), (5, "rep " * 4000, "x", 7), (5, "rep " * 4000, "x", 7), (4, "it's <|endoftext|> é\x1c q", "z", 7)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string, start long")


def plain_ids(text, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.public_path(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_matches_library():
    odd = ["a b  c\n\n d", "x\x1cy z", "", "  lead", " é é ́a", "don't <|endoftext|> it's", "tab\t\tx \r\n y", "a b\xa0c", "12 5a\n\n\nb "]
    for name, spaces in ((tokens.BYTE_BPE, True), (tokens.WORD_BPE, False)):
        ids, n = tokens.Encoder(tokens.public_path(name), spaces).encode(odd)
        assert [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == [plain_ids(t, name) for t in odd]


def test_encoder_with_full_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 2)
    e = tokens.Encoder(tokens.public_path(tokens.BYTE_BPE), True)
    for t in ("one two three four", "one five", "six one"):
        assert list(e.encode([t])[0]) == plain_ids(t, tokens.BYTE_BPE)


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.tile([5, 6, 7], 500), rng.integers(0, 40, 3000), np.full(700, 9)]).astype(np.uint32)
    symbols, rules, lens = op3_repair.replace_pairs(ids)
    assert len(symbols) < 3000 + 300 and len(rules) == len(lens)  # all but the random ids shrinks
    assert (op3_repair.expand(symbols, rules) == ids).all()
    for start, n in ((0, 1), (17, 400), (len(ids) - 3, 3), (100, 0)):
        assert (op3_repair.slice_ids(symbols, rules, lens, start, n) == ids[start : start + n]).all()


def test_repair_table(spark, docs, tmp_path):
    op3_repair.write(docs, f"{tmp_path}/t", block_ids=100)
    got = sorted(op3_repair.read(spark, f"{tmp_path}/t").select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    want, at = [], 0
    for d, t, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*plain_ids(t, tokens.BYTE_BPE), 2]
        want.append((at, d, len(ids), crc(ids)))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert op3_repair.read(spark, f"{tmp_path}/t").where("n_tokens < 1").count() == 0


@pytest.mark.parametrize("weights", [None, {"x": 0.5, "y": 0.25, "z": 0.25}])
def test_packing(spark, docs, weights):
    got = op4_packing.pack(docs, weights, size=128).collect()
    ids = {(d, t): [*plain_ids(t, tokens.WORD_BPE), 1] for d, t, *_ in ROWS}
    by_doc = Counter()
    for r in got:
        own = next(v for (d, _), v in ids.items() if d == r["doc_id"])
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == crc(own[r["start"] : r["start"] + r["length"]]) and r["length"] > 0
        by_doc[r["doc_id"]] += r["length"]
    assert by_doc == Counter({1: 1, 2: 1, 3: len(ids[3, "a b a b a b"]), None: len(ids[None, "null id"]), 5: 2 * len(ids[5, "rep " * 4000]), 4: len(next(v for (d, _), v in ids.items() if d == 4))})
    windows = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(windows) == list(range(len(windows)))
    for w, pieces in windows.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 128 or w == len(windows) - 1


def test_schedule_equals_replay():
    totals = [1000, 301, 77, 5]
    for weights in (None, [1, 1, 1, 1], [5, 1, 3, 1]):
        s = op4_packing.Schedule(totals, weights)
        w, credit, left, x = list(weights or totals), [0.0] * 4, list(totals), 0
        x = np.arange(0, sum(totals) + 1)
        got = np.stack([s.taken(x, np.full(len(x), k)) for k in range(4)], 1)
        assert (got.sum(1) == x).all() and (got[-1] == totals).all() and (got <= totals).all()
        if weights is None:  # deficits stay below one id in each queue
            assert (np.abs(got - np.outer(x, np.array(w) / sum(w))) <= 1).all()
        steps = got[64::64] - got[:-64:64][: len(got[64::64])]
        assert (steps[:, :2] >= 0).all()


@pytest.mark.parametrize("weights", [None, {f"s{k}": 1 / 300 for k in range(300)}])
def test_packing_of_many_sources(spark, weights):
    rows = [(k, "word " * (11 + k % 7), None if k // 30 == 7 else f"s{k // 30}") for k in range(9000)]
    got = op4_packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights, size=200).collect()
    windows, source, sizes = {}, {r[0]: r[2] for r in rows}, Counter()
    for r in got:
        windows.setdefault(r["sequence_id"], []).append(r)
        sizes[source[r["doc_id"]]] += r["length"]
    assert len({r["queue"] for r in got}) == len(sizes) == 300 and sum(sizes.values()) == sum({r["doc_id"]: r["doc_tokens"] for r in got}.values())
    taken, whole = Counter(), sum(sizes.values())
    for w in sorted(windows):
        pieces = sorted(windows[w], key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [sum(x["length"] for x in pieces[:k]) for k in range(len(pieces))]
        assert sum(r["length"] for r in pieces) == 200 or w == len(windows) - 1
        for r in pieces:
            taken[source[r["doc_id"]]] += r["length"]
        if weights is None or 200 * (w + 1) < whole / 2:
            assert all(abs(taken[s] - 200 * (w + 1) * (n / whole if weights is None or s is None else 1 / 300)) <= 10 for s, n in sizes.items()) or w == len(windows) - 1


def test_share_of_large_numbers():
    rng = np.random.default_rng(5)
    y, part = rng.integers(0, 2**40, 1000), rng.integers(0, 2**40, 1000)
    whole = part + rng.integers(1, 2**40, 1000)
    assert op4_packing._share(y, part, whole).tolist() == [(a * b + c // 2) // c for a, b, c in zip(y.tolist(), part.tolist(), whole.tolist(), strict=True)]


def test_quality_counts_against_plain_loop():
    texts = ["a b c d e f g h a b c d e f g h i", "x\ny\nx\n \n \nx", "# $ é é %% <|>", "w " * 50, None, "", "\x1c a"]
    counts, features = op8_quality.text_stats(texts)
    for text, got in zip(texts, counts, strict=True):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        many, covered = Counter(wins), set()
        for i, w in enumerate(wins):
            if many[w] > 1:
                covered |= set(range(i, i + 8))
        dups = sum(x in lines[:i] for i, x in enumerate(lines))
        assert tuple(got) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered))
    assert np.isfinite(features).all()


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(4000) < 0.1)).astype(float)
    t = op8_quality.fit(x, y, monotone=[-1, 0, 0], trees=15)
    assert ((t.score(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.95
    grid = np.repeat(rng.random((50, 3)), 40, 0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(t.score(grid).reshape(50, 40), axis=1) <= 1e-12).all()


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    trees = op8_quality.fit_labels(docs, labels.where("doc_id % 2 = 0"))
    got = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", op8_quality.judged(F.col("text"), trees).alias("q")).select("quality", "q.*").collect()
    right = sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in got)
    assert len(got) > 100 and right / len(got) > 0.95


def test_quality_without_labels(spark, docs):
    trees = op8_quality.fit_labels(docs, spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int"))
    assert trees is None
    got = docs.select("doc_id", op8_quality.judged(F.col("text"), trees).alias("q")).select("q.*").collect()
    assert len(got) == len(ROWS) and all(r["kept"] == (not r["base_failed"]) for r in got)
    assert docs.limit(0).select(op8_quality.judged(F.col("text"), None).alias("q")).count() == 0


def test_pieces_of_any_white_space():
    """Texts of single spaces and line ends are cut plainly, others by the pattern; both encode as the whole text does."""
    draw = random.Random(12)
    parts = ["a", "The", "é", "don't", "12", "...", "x" * 30, "\U0001f600"]
    texts = ["".join(draw.choice(parts) + draw.choice(gaps) for _ in range(draw.randint(0, 12))) for gaps in ([" "], [" ", "\n"], [" ", "\n", "", "\n\n", "  ", "\t", " \n", "\n ", "\r\n", "\x0b"]) for _ in range(150)]
    texts += ["", " ", "\n", " a", "\na", "a\n", "a ", "\n\n\n b", "a\x1cb", "\x1d"]
    encoder = tokens.Encoder(tokens.public_path(tokens.BYTE_BPE), True)
    ids, n = encoder.encode(texts)
    parts, at = [], 0
    for size in n.tolist():
        parts.append(ids[at : at + size].tolist())
        at += size
    assert parts == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_repair_until_no_pair_is_left():
    draw = np.random.default_rng(2)
    ids = np.concatenate([np.tile(draw.integers(0, 50, 40), 200), draw.integers(0, 300, 20_000), np.full(5000, 7)]).astype(np.uint32)
    symbols, rules, lens = op3_repair.replace_pairs(ids)
    assert (op3_repair.expand(symbols, rules) == ids).all() and len(symbols) < 0.7 * len(ids)
    keys = (symbols[:-1].astype(np.int64) << 20) | symbols[1:]
    pairs, counts = np.unique(keys[keys >> 20 != keys & ((1 << 20) - 1)], return_counts=True)
    assert counts.max() < 48  # those that are left overlap
    assert [len(op3_repair.expand(np.array([op3_repair.FIRST_RULE + k], np.uint32), rules)) for k in range(len(rules))] == lens.tolist()
    for tiny in ([], [1], [1, 1], [3] * 100):
        s, r, _ = op3_repair.replace_pairs(np.array(tiny, np.uint32))
        assert op3_repair.expand(s, r).tolist() == tiny


def test_words_with_end_marks_share_encodings(monkeypatch):
    """Words that differ in the marks at their end cost one encoding, each distinct piece one look-up, and the ids are those of the whole text."""
    draw = random.Random(4)
    words, marks = ["Ahorn", "été", "x1", "don't", "12", "ß", "²", "ǆ", "ж", "'", "a'", "<|endoftext|>", "x<|endoftext|>", "a.b", "\U0001f600"], ["", ".", ",", "...", "***", "&&&", ".'s", "%%%'", "(", '"', "|>", "’."]
    texts = ["".join(draw.choice(words) + draw.choice(marks) + draw.choice(gaps) for _ in range(40)) for gaps in ([" "], [" ", "\n"], [" ", "", "\n\n", "\t"]) for _ in range(60)]
    for cached in (tokens.CACHED, 30):
        monkeypatch.setattr(tokens, "CACHED", cached)
        encoder = tokens.Encoder(tokens.public_path(tokens.BYTE_BPE), True)
        got = []
        for k in range(0, len(texts), 50):
            ids, n = encoder.encode(texts[k : k + 50])
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.index) <= cached and len(encoder.index) == len(encoder.lengths) == len(encoder.offsets)
    asked, encoder = [], tokens.Encoder(tokens.public_path(tokens.BYTE_BPE), True)
    monkeypatch.setattr(encoder, "_encoded", lambda pieces, own=encoder._encoded: asked.extend(pieces) or own(pieces))
    encoder.encode(["so viel, viel. viel*** viel so."])
    assert sorted(asked) == sorted(["\x1cso", "so", "viel", "\x1c,", "\x1c.", "\x1c***"])


def test_blocks_end_at_their_size(spark, tmp_path):
    """A block holds no more than its size and one document, however many documents are encoded at once."""
    rows = [(k, "one two three " * (k % 5)) for k in range(400)]
    op3_repair.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), f"{tmp_path}/t", block_ids=100)
    table = spark.read.parquet(f"{tmp_path}/t").select("part", "block", "n_ids").collect()
    assert max(r["n_ids"] for r in table) < 100 + 20 and sum(r["n_ids"] < 100 for r in table) <= len({r["part"] for r in table})
    got = op3_repair.read(spark, f"{tmp_path}/t").orderBy("doc_id").collect()
    want = [[*plain_ids(t, tokens.BYTE_BPE), 2] for _, t in rows]
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(k, sum(map(len, want[:k])), len(x), crc(x)) for k, x in enumerate(want)]


def test_slices_of_a_batch(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(op3_repair, "BATCH_DOCS", 3)
    monkeypatch.setattr(op3_repair, "BATCH_BYTES", 10)
    texts = ["x" * 25, "a", None, "b", "c", "dddddddd", "e", "", "x" * 11]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = [x.column(1).to_pylist() for x in op3_repair._slices(batch)]
    assert sum(got, []) == texts and got == [["x" * 25], ["a", None, "b"], ["c", "dddddddd", "e"], [""], ["x" * 11]]


@pytest.mark.parametrize("change", ["prefix", "bytes"])
def test_encoder_of_other_tokenizers(change, tmp_path):
    """A space put before texts: they are encoded whole. A vocabulary that lacks bytes: pieces are encoded alone."""
    import json

    with open(tokens.public_path(tokens.BYTE_BPE)) as f:
        kind = json.load(f)
    if change == "prefix":
        kind["pre_tokenizer"]["add_prefix_space"] = True
    else:
        kind["model"]["merges"] = [x for x in kind["model"]["merges"] if "z" not in "".join(x)]
        kind["model"]["vocab"] = {x: n for x, n in kind["model"]["vocab"].items() if "z" not in x}
    (tmp_path / "t.json").write_text(json.dumps(kind))
    encoder = tokens.Encoder(f"{tmp_path}/t.json", True)
    texts = ["so viel, viel. viel***", "zu\nzu. (zwei) a.", "", "  a\n\nb.", "! a"]
    ids, n = encoder.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
