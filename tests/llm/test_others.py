"""SpotSigs, tool calls, mixing and the pipeline against plain code."""

import json
import random
from collections import Counter
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from stridelake.llm import op1_mixing, op2_tools, op5_secrets, op7_spotsigs


def test_spots_by_hand():
    a, b = op7_spotsigs.spots("The quick fox, the lazy dog"), op7_spotsigs.spots("the QUICK fox xx the lazy dog!")
    assert len(a) == 2 and set(a) <= set(b) and len(op7_spotsigs.spots("no markers here")) == 1 and len(op7_spotsigs.spots(" ")) == 0
    assert op7_spotsigs.likeness(a, b) == len(set(a) & set(b)) / len(set(a) | set(b))


def test_spotsigs_against_loop(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(120).collect()]
    rows += [(5000, None), (5001, ""), (5001, ""), (None, "the null id"), (5002, "\U0001f600" * 9)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int")
    got = sorted(op7_spotsigs.fingerprints(docs).collect(), key=str)
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    want = []
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        s = [set(op7_spotsigs.spots(x).tolist()) for x in (t, edited, after)]
        like = lambda x, y: 1.0 if x == y else len(x & y) / len(x | y)
        want.append((d, len(t), sha256(edited.encode()).hexdigest(), like(s[0], s[1]), like(s[0], s[2])))
    assert sorted([(r[0], r[1], r[2], r[5], r[6]) for r in got], key=str) == sorted(want, key=str)
    assert len({r[3] for r in got}) <= len(rows) and op7_spotsigs.fingerprints(docs.limit(0)).count() == 0
    one = op7_spotsigs.fingerprints(docs.limit(1)).collect()
    assert one[0]["near_next"] == 1.0


def test_spotsigs_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(400).collect()]
    links, members = op7_spotsigs.pairs(spark.createDataFrame(rows, "doc_id long, text string"), 0.6)
    rep = {r[0]: r[1] for r in members.collect()}
    sets = {d: set(op7_spotsigs.spots(t or "").tolist()) for d, t in rows}
    reps = sorted({r for r in rep.values() if sets[r]})
    want = {(a, b) for i, a in enumerate(reps) for b in reps[i + 1 :] if 10 * len(sets[a] & sets[b]) >= 6 * len(sets[a] | sets[b])}
    assert {(r[0], r[1]) for r in links.collect()} == want and want and len(rep) == len(rows)


def test_tool_calls(spark):
    ok = '{"query": "ü\\n", "limit": 3}'
    calls = [("c", "a", None, "lookup", ok), ("c", "b", "a", "lookup", '{"limit": 99, "query": ""}'), ("c", "d", "b", "nope", None), ("c", "e", "f", "translate", "{broken"), ("c", "f", "e", "translate", '{"text":"x","target":"xx"}'), ("c", "g", "f", "summarise", '{"text": "x", "words": NaN}'), ("c", "h", "zz", "summarise", '{"text": "x", "plain": true, "more": 1}'), ("c", "a", None, "lookup", ok), ("c", None, None, "lookup", ok), ("c", "i", "h", "summarise", '{"text": "x"}'), ("c", "i", "h", "summarise", '{"text": "y"}')]
    results = [("c", "a", "yes"), ("c", "a", "yes"), ("c", "q", "orphan"), ("c", "b", "one"), ("c", "b", "two"), ("c", "h", None), ("c", "i", "z")]
    got = {r["call_id"]: r for r in op2_tools.link(spark.createDataFrame(calls, "conv_id string, call_id string, after string, name string, arguments string"), spark.createDataFrame(results, "conv_id string, call_id string, content string")).collect()}
    assert {k: (r["depth"], r["status"]) for k, r in got.items()} == {"a": (0, "linked"), "b": (1, "repeated result"), "d": (2, "unanswered"), "e": (None, "cycle"), "f": (None, "cycle"), "g": (None, "cycle"), "h": (0, "linked"), "i": (1, "repeated call"), "q": (None, "orphan")}
    assert {k: r["errors"] for k, r in got.items()} == {"a": "", "b": "range limit;range query", "d": "unknown tool", "e": "broken json", "f": "enum target", "g": "broken json", "h": "unknown more", "i": "", "q": ""}
    assert got["a"]["json"] == '{"arguments":{"limit":3,"query":"ü\\n"},"id":"a","name":"lookup","result":"yes"}' and got["h"]["dangling"] and not got["b"]["dangling"]


def test_tool_calls_with_ids_of_each_conversation(spark):
    ok = '{"limit":3,"query":"x"}'
    calls = [("p", "1", None, "lookup", ok), ("p", "2", "1", "lookup", ok), ("q", "1", "2", "lookup", ok), ("q", "2", None, "lookup", ok), (None, "1", None, "lookup", ok)]
    results = [("p", "1", "from p"), ("q", "1", "z"), ("q", "1", "a"), ("q", "1", "a"), ("q", "1", None), (None, "1", "from null"), ("r", "1", "lost")]
    rows = op2_tools.link(spark.createDataFrame(calls, "conv_id string, call_id string, after string, name string, arguments string"), spark.createDataFrame(results, "conv_id string, call_id string, content string")).collect()
    got = {(r["conv_id"], r["call_id"]): r for r in rows}
    assert {k: (r["depth"], r["status"], r["dangling"]) for k, r in got.items()} == {("p", "1"): (0, "linked", False), ("p", "2"): (1, "unanswered", False), ("q", "1"): (1, "repeated result", False), ("q", "2"): (0, "unanswered", False), (None, "1"): (0, "linked", False), ("r", "1"): (None, "orphan", False)}
    assert len(rows) == 6 and json.loads(got["q", "1"]["json"])["results"] == [None, "a", "z"]
    assert [json.loads(got[k, "1"]["json"])["result"] for k in ("p", None, "r")] == ["from p", "from null", "lost"]


def test_deep_chain(spark):
    calls = spark.range(700).select(F.col("id").cast("string").alias("call_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("after"))
    assert {r[0]: r[1] for r in op2_tools.depths(calls).collect()} == {str(k): k for k in range(700)}


def test_tool_calls_on_turns(spark, sf):
    got = op2_tools.op2_tool_calls(spark, sf).collect()
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    assert Counter(r["status"] == "orphan" for r in got)[False] == len({(r["conv_id"], r["turn"]) for r in turns if r["role"] == "user"})
    assert any(r["valid"] for r in got) and any(r["errors"] for r in got) and all(json.loads(r["json"]) for r in got)


def test_projected_gradient_reaches_targets(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4, 0.3, 0.3], 300)
    t = rng.integers(1, 500, 300)
    rows = [(int(n), *map(float, q)) for n, q in zip(t, p, strict=True)]
    members = spark.createDataFrame(rows, "tokens long, p0 double, p1 double, p2 double").cache()
    for targets in ({"good": 0.6, "poor": 0.3, "toxic": 0.1}, {"good": 1.0, "poor": 0.0, "toxic": 0.0}):
        past = op1_mixing.fit(members, targets)
        r = np.ones(300)  # the same steps on plain arrays
        for step in past:
            r = np.maximum(0, r - p @ np.array(step))
        got = np.array(sorted(x[0] for x in members.select(op1_mixing.rate(past)).collect()))
        assert np.allclose(np.sort(r), got) and (got >= 0).all()
        share = (r * t) @ p / t.sum()
        best = np.array(list(targets.values()))
        assert np.abs(share - best).max() < 0.08 and np.abs(share - best).sum() < np.abs(t @ p / t.sum() - best).sum()
        if min(best) > 0:
            assert np.abs(share - best).max() < 0.005


def test_mixing_held_out_and_edges(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    model, prior = op1_mixing.weights(docs, labels.where("doc_id % 3 <> 0"))
    scored = op1_mixing.posteriors(docs, model, prior).join(labels.where("doc_id % 3 = 0"), "doc_id").where("toxic = 0").collect()
    right = np.mean([(r["p1"] > r["p0"]) == (r["quality"] == 0) for r in scored])
    assert len(scored) > 80 and right > 0.93
    odd = spark.createDataFrame([(1, None, 5), (None, "x y", 5), (2, "", 5), (2, "", 5)], "doc_id long, text string, tokens int")
    got = op1_mixing.mix(odd, labels.limit(0)).collect()
    assert len(got) == 4 and sorted(r["tokens"] for r in got) == [0, 0, 0, 2] and all(abs(r["p0"] - 1 / 3) < 1e-9 for r in got)
    assert op1_mixing.mixed(odd, labels.limit(0)).columns == odd.columns and op1_mixing.mix(odd.limit(0), labels).count() == 0


def test_mixing_uses_exact_posteriors(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    odd = spark.createDataFrame([(1, None), (2, "x y")], "doc_id long, text string")
    assert all(abs(r[f"p{k}"] - 1 / 3) < 1e-9 for r in op1_mixing.mix(odd, labels.limit(0)).collect() for k in range(3))
    model, prior = op1_mixing.weights(docs, labels)
    words = op1_mixing._words(F.col("text"))
    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(words).alias("word")).select("doc_id", "text_hash", op1_mixing._bucket(F.col("word")).alias("bucket")).collect()
    like, logs = {r["bucket"]: [r[f"l{k}"] for k in range(3)] for r in model.collect()}, {}
    for r in found:
        logs.setdefault((r["doc_id"], r["text_hash"]), []).append(like.get(r["bucket"]))
    got = op1_mixing.mix(docs, labels).collect()
    p = np.array([[r[f"p{k}"] for k in range(3)] for r in got])
    for r, q in zip(got, p, strict=True):
        seen = [x for x in logs.get((r["doc_id"], r["text_hash"]), []) if x]
        if seen and r["tokens"] == len(logs[r["doc_id"], r["text_hash"]]):
            z = np.array(prior) + np.sum(seen, 0) * min(1.0, op1_mixing.EFFECTIVE / len(seen))
            e = np.exp(z - z.max())
            assert np.allclose(q, e / e.sum(), rtol=0, atol=1e-9)
    t, r = np.array([x["tokens"] for x in got]), np.array([x["rate"] for x in got])
    assert np.abs((r * t) @ p / t.sum() - np.array([op1_mixing.TARGETS[d] for d in op1_mixing.DOMAINS])).max() < 1e-3


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, sf)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    unique = corpus_pipeline.near_duplicates(spark, kept, sf)
    assert unique.columns == docs.columns and unique.count() < kept.count()
    clean = corpus_pipeline.secrets(spark, unique, sf)
    assert clean.columns == docs.columns and clean.dtypes == docs.dtypes
    found = op5_secrets.scan(unique).where("size(spans) > 0").count()
    assert clean.where("text like '%[SECRET]%'").count() == found and op5_secrets.scan(clean).where("size(spans) > 0").count() == 0
    mixed = corpus_pipeline.mixing(spark, clean, sf)
    assert mixed.columns == docs.columns and mixed.count() > 0.7 * clean.count()
    pieces = corpus_pipeline.packing(spark, mixed, sf)
    whole = pieces.agg(F.sum("length")).first()[0]
    assert whole == pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n")).first()[0]
    assert pieces.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, sf).count() > 0


def plain_links(calls, results):
    """Calls and results linked by dictionaries: (conv, id) -> depth, status, dangling, valid, errors, json."""
    asked, told = {}, {}
    for conv, i, after, name, arguments in calls:
        if i is not None:
            asked.setdefault((conv, i), set()).add((name, arguments, after))
    for conv, i, content in results:
        if i is not None:
            told.setdefault((conv, i), set()).add(content)
    low = lambda t: tuple((x is not None, x or "") for x in t)
    call = {k: min(v, key=low) for k, v in asked.items()}
    out = {}
    for k in {*asked, *told}:
        contents = sorted(told.get(k, []), key=lambda c: (c is not None, c or ""))
        answer = {"results": contents} if len(contents) > 1 else {"result": contents[0] if contents else None}
        if k not in asked:
            out[k] = (None, "orphan", False, False, "", op2_tools.canonical({"id": k[1]} | answer))
            continue
        name, arguments, after = call[k]
        at, depth, seen = k, 0, set()
        while at is not None and at not in seen:
            seen.add(at)
            before = (at[0], call[at][2])
            at = before if before in call else None
            depth += at is not None
        depth = None if at is not None else depth
        got, wrong = op2_tools.check(name, arguments, op2_tools.TOOLS)
        status = "cycle" if depth is None else "repeated call" if len(asked[k]) > 1 else "repeated result" if len(contents) > 1 else "linked" if contents else "unanswered"
        body = {"id": k[1], "name": name, "arguments": got} | answer | ({"raw": arguments} if got is None else {})
        out[k] = (depth, status, after is not None and (k[0], after) not in call, not wrong, ";".join(wrong), op2_tools.canonical(body))
    return out


def test_tool_calls_against_dictionaries(spark):
    draw = random.Random(11)
    bad = ['{"query": "x", "limit": 1e999}', '{"query": "\\ud800", "limit": 1}', '{"\\udfff": 1}', "[" * 5000, '{"text": "x", "words": -Infinity}', "", None, "[1]", '{"limit":3,"query":"x"}', '{"text":"y","target":"en"}', '{"text": 1e308, "words": 7}', "{" + '"a":{' * 40 + "}" * 41]
    ids = [None, *map(str, range(9))]
    calls = [(draw.choice([None, "p", "q"]), draw.choice(ids), draw.choice(ids), draw.choice([*op2_tools.TOOLS, "nope", None]), draw.choice(bad)) for _ in range(60)]
    results = [(draw.choice([None, "p", "q"]), draw.choice([*ids, "z"]), draw.choice(["one", "two", "é" * 50_000, None])) for _ in range(40)]
    calls += [("deep", str(k), str(k - 1), "lookup", bad[8]) for k in range(70)] + calls[:3]
    a = spark.createDataFrame([(*c, 1, 2) for c in calls], "conv_id string, call_id string, after string, name string, arguments string, depth int, jump int")
    b = spark.createDataFrame([(*r, 1) for r in results], "conv_id string, call_id string, content string, steps int")
    got = {(r["conv_id"], r["call_id"]): tuple(r)[2:] for r in op2_tools.link(a, b).collect()}
    assert got == plain_links(calls, results)
    assert op2_tools.link(a.limit(0), b.limit(0)).count() == 0
