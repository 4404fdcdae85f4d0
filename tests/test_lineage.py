"""Lineages against walks from each clip to its source."""

import random

from stridelake.operators import lineage as op

SCHEMA = "motion_id long, parent_id long, operation string, kind string, seed long, split string"


def walk(rows, start):
    by = {}
    for r in rows:
        if r[0] is not None:
            by.setdefault(r[0], []).append(r)
    least = lambda v: tuple((x is not None, x or (0 if not isinstance(x, str) else "")) for x in v[1:])
    one = {k: min(v, key=least) for k, v in by.items()}
    path, at = [], start
    while at is not None and at in one:
        if at in path:
            return None
        path.append(at)
        at = one[at][1]
    path.reverse()
    faults = []
    for k in reversed(path):
        m, parent, operation, kind, *_ = one[k]
        if len(by[k]) > 1:
            faults.append("repeated id")
        elif kind not in op.KINDS:
            faults.append("unknown kind")
        elif not (operation or "").strip():
            faults.append("no operation")
        elif kind == "source" and parent is not None:
            faults.append("source with a parent")
        elif kind != "source" and parent is None:
            faults.append("no source")
        elif parent is not None and parent not in one:
            faults.append("missing parent")
    source = one[path[0]]
    own, split = one[start][5], source[5]
    status = faults[0] if faults else "other split" if len(path) > 1 and own is not None and split is not None and own != split else "ok"
    return path[0], split, len(path) - 1, tuple(one[k][:5] for k in path), status


def test_against_walks(spark):
    draw = random.Random(4)
    rows = [(k, None, "take", "source", None, draw.choice(["train", "test"])) for k in range(5)]
    for k in range(5, 120):
        rows.append((k, draw.randrange(max(0, k - 9), k), draw.choice(["jitter", "trim"]), draw.choice(["corruption", "repair", "slice"]), draw.randrange(9), None))
    rows += [(200 + k, 199 + k if k else None, "t", "transform" if k else "source", k, "train" if k in (0, 37) else "test" if k == 38 else None) for k in range(70)]
    rows += [(300, 999, "x", "slice", 1, None), (301, 300, "x", "slice", 1, None), (302, None, "x", "slice", 1, None), (303, None, " ", "source", 1, None), (304, 303, "x", "melt", 1, None), (305, 0, "x", "source", 1, None), (306, 307, "x", "slice", 1, None), (307, 306, "x", "slice", 1, None), (308, 307, "x", "slice", 1, None), (309, 309, "x", "slice", 1, None), (310, 0, "a", "slice", 1, None), (310, 0, "b", "slice", 1, None), (None, 0, "x", "slice", 1, None)]
    found = op.lineage(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len({r[0] for r in rows if r[0] is not None})
    for r in found:
        want = walk(rows, r["motion_id"])
        if want is None:
            assert r["status"] == "cycle" and r["source_id"] is None and len(r["steps"]) == 1
        else:
            assert (r["source_id"], r["split"], r["depth"], tuple(map(tuple, r["steps"])), r["status"]) == want, r["motion_id"]
    assert {r["status"] for r in found} >= {"ok", "cycle", "other split", "missing parent", "repeated id", "no source", "unknown kind", "no operation", "source with a parent"}
    assert op.lineage(spark.createDataFrame([], SCHEMA)).count() == 0
