"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings. All in DataFrame functions.

A candidate is a run of 20 or more token characters with a digit and a letter. By its characters it is hex, alnum or
base64, each class with its own least entropy. A window of 20 characters slides over it: one fold keeps the counts of the
window's characters (one place of a string for each ASCII character) and the sum of c * log2(c); each step changes the counts
of the one character that comes in and the one that goes out. A span reaches from the first to the last window of enough
entropy. Candidates that the allow-list knows (UUIDs, words joined by marks, published sample keys) are suppressed; spans of
the fixed patterns stay.

Positions are code points, found by cutting the text at the matches and adding up lengths. All of it is one expression of the
text. What it uses more than once is bound by `_let`, so it is worked out once for a text; sums over an array go by pieces of
PIECE elements; patterns repeat no group that could recurse. So the work grows with the length of a text, and texts of a
million token characters or matches are read whole.

Defined results: a null text is empty and has no spans; overlapping spans of different kinds are all listed; repeated rows
are scanned each; an empty table gives an empty result; other columns are ignored by scan and kept by redact.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 20
#: The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64"]
#: Kind: (what its runs are made of, least bits). Runs in hex count in lower case.
CLASSES = {"entropy_hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0), "entropy_alnum": (r"^[A-Za-z0-9]+$", 3.7), "entropy_base64": (r"", 3.7)}
ALLOWED = [r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$", r"^[A-Za-z]*+(?:[/_=+-](?:[0-9]{1,4}+|[A-Za-z]*+))++$", r"EXAMPLE"]
SPAN = "array<struct<start:int,kind:int,end:int>>"
PIECE = 256
#: c * log2(c) in units of 1 / UNIT, for counts up to WINDOW.
UNIT = 1 << 40
LOGS = [0, *(round(c * log2(c) * UNIT) for c in range(1, WINDOW + 1))]
#: Characters of a piece of text that redact() cuts gaps from.
CUT = 2048


def _none() -> Column:
    return F.array().cast("array<int>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is worked out once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """fold over each prefix of an array of whole numbers of at least 0, from 0 on."""

    def whole(v: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / PIECE).cast("int")), lambda k: F.slice(v, k * PIECE + 1, F.lit(PIECE)))
        return _let(pieces, lambda p: _let(F.transform(p, lambda x: F.aggregate(x, F.lit(0), fold)), lambda t: F.flatten(F.transform(p, lambda x, k: after(x, F.slice(t, F.lit(1), k))))))

    def after(piece: Column, before: Column) -> Column:
        start = F.struct(F.aggregate(before, F.lit(0), fold).alias("at"), _none().alias("out"))

        def step(acc: Column, x: Column) -> Column:
            return F.struct(fold(acc["at"], x).alias("at"), F.array_append(acc["out"], fold(acc["at"], x)).alias("out"))

        return F.aggregate(piece, start, step)["out"]

    return F.when(F.size(values) > 0, _let(values, whole)).otherwise(_none())


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _places(text: Column, pattern: str, found: Column) -> Column:
    """Start of each match: lengths of what is before it, cut and matched."""
    steps = lambda between: F.transform(found, lambda m, k: F.length(F.get(between, k)) + F.coalesce(F.length(F.get(found, k - 1)), F.lit(0)))
    return F.when(F.size(found) > 0, _let(F.split(text, pattern, -1), lambda between: _running(steps(between), lambda a, b: a + b))).otherwise(_none())


def _span(start: Column, kind: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), kind.cast("int").alias("kind"), end.cast("int").alias("end"))


def _fixed(text: Column, pattern: str, kind: int) -> Column:
    """Spans of one fixed pattern; those of ASSIGN need a value of 6 or more characters."""

    def spans(found: Column) -> Column:
        out = _let(_places(text, pattern, found), lambda at: F.transform(found, lambda m, k: _span(F.get(at, k), F.lit(kind), F.get(at, k) + F.length(m))))
        if pattern == ASSIGN:
            values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
            out = _let(out, lambda s: _let(values, lambda v: F.filter(s, lambda x, k: F.length(F.get(v, k)) >= 6)))
        return F.when(F.size(found) > 0, out).otherwise(F.array().cast(SPAN))

    return _let(_matches(text, pattern), spans)


def _entropy(run: Column, least: Column) -> Column:
    """(first start, last end) of the windows of enough entropy in an ASCII run, by one fold over its characters."""
    zero = F.struct(F.lit(0).alias("k"), F.lit("A" * 128).alias("counts"), F.lit(0).cast("long").alias("s"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    # A count is a letter, "A" for none; the place of a character is its code.
    count = lambda counts, place: F.ascii(F.substr(counts, place, F.lit(1))) - 65
    put = lambda counts, place, n: F.overlay(counts, F.char(n + 65), place, F.lit(1))

    def step(acc: Column, ch: Column, logs: Column) -> Column:
        def comes(place: Column) -> Column:
            return _let(count(acc["counts"], place), lambda n: F.struct(put(acc["counts"], place, n + 1).alias("counts"), (acc["s"] + F.get(logs, n + 1) - F.get(logs, n)).alias("s")))

        def goes(state: Column) -> Column:
            place = F.ascii(ch["going"]) + 1
            less = _let(count(state["counts"], place), lambda n: F.struct(put(state["counts"], place, n - 1).alias("counts"), (state["s"] + F.get(logs, n - 1) - F.get(logs, n)).alias("s")))
            return F.when(ch["going"].isNotNull(), less).otherwise(state)

        def judged(state: Column) -> Column:
            enough = (acc["k"] >= WINDOW - 1) & (F.lit(log2(WINDOW)) - state["s"] / F.lit(float(UNIT * WINDOW)) >= least - 1e-9)
            return F.struct(
                (acc["k"] + 1).alias("k"),
                state["counts"].alias("counts"),
                state["s"].alias("s"),
                F.when(enough & (acc["first"] < 0), acc["k"] - (WINDOW - 1)).otherwise(acc["first"]).alias("first"),
                F.when(enough, acc["k"] + 1).otherwise(acc["last"]).alias("last"),
            )

        return _let(_let(F.ascii(ch["coming"]) + 1, comes), lambda after: _let(goes(after), judged))

    def folded(chars: Column) -> Column:
        moves = F.transform(chars, lambda c, k: F.struct(c.alias("coming"), F.get(chars, k - WINDOW).alias("going")))
        return _let(F.array(*map(F.lit, LOGS)).cast("array<long>"), lambda logs: F.aggregate(moves, zero, lambda acc, ch: step(acc, ch, logs)))

    return _let(F.split(run, ""), folded)


def _kind(run: Column) -> Column:
    """Which class a run belongs to, or -1 where it is no candidate."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | run.rlike(pattern)
    kinds = list(CLASSES.items())
    kind = F.lit(KINDS.index(kinds[-1][0]))
    for name, (pattern, _) in reversed(kinds[:-1]):
        kind = F.when(run.rlike(pattern), KINDS.index(name)).otherwise(kind)
    return F.when(run.rlike("[0-9]") & run.rlike("[A-Za-z]") & ~allowed, kind).otherwise(-1)


def _candidates(text: Column) -> Column:
    """Spans of the candidates' windows of enough entropy."""
    hex_kind = KINDS.index("entropy_hex")
    least = lambda kind: F.coalesce(*[F.when(kind == KINDS.index(name), F.lit(bits)) for name, (_, bits) in CLASSES.items()])

    def spans(found: Column) -> Column:
        runs = _let(_places(text, CANDIDATE, found), lambda at: F.transform(found, lambda m, k: F.struct(F.get(at, k).alias("at"), m.alias("run"), _kind(m).alias("kind"))))
        runs = F.filter(runs, lambda r: r["kind"] >= 0)
        windows = F.transform(runs, lambda r: F.struct(r["at"].alias("at"), r["kind"].alias("kind"), _entropy(F.when(r["kind"] == hex_kind, F.lower(r["run"])).otherwise(r["run"]), least(r["kind"])).alias("w")))
        out = F.transform(F.filter(windows, lambda h: h["w"]["first"] >= 0), lambda h: _span(h["at"] + h["w"]["first"], h["kind"], h["at"] + h["w"]["last"]))
        return F.when(F.size(found) > 0, out).otherwise(F.array().cast(SPAN))

    return _let(_matches(text, CANDIDATE), spans)


def spans_of(text: Column) -> Column:
    """All spans (start, kind, end) by start and kind; kind is a place in KINDS."""
    patterns = (ASSIGN, ACCESS, HEX)
    return _let(F.coalesce(text, F.lit("")), lambda t: F.array_sort(F.concat(*[_fixed(t, p, k).cast(SPAN) for k, p in enumerate(patterns)], _candidates(t).cast(SPAN))))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of documents (doc_id, text) as an array of (start, kind, end)."""
    return docs.select("doc_id", spans_of(F.col("text")).alias("spans"))


def redacted(text: Column, by: str = "[SECRET]") -> Column:
    """The text with each span replaced; of spans that overlap, those that start inside one before them go with it."""

    def cut(spans: Column) -> Column:
        ends = _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
        return _let(pieces, lambda p: _let(ends, lambda e: joined(spans, e, p)))

    def between(pieces: Column, a: Column, b: Column) -> Column:
        def part(k: Column) -> Column:
            lo = F.greatest(a - k * CUT, F.lit(0))
            return F.substr(F.get(pieces, k), lo + 1, F.least(b - k * CUT, F.lit(CUT)) - lo)

        return F.when(b > a, F.array_join(F.transform(F.sequence((a / CUT).cast("int"), ((b - 1) / CUT).cast("int")), part), "")).otherwise("")

    def joined(spans: Column, ends: Column, pieces: Column) -> Column:
        before = lambda k: F.coalesce(F.get(ends, k - 1), F.lit(0))
        out = F.transform(spans, lambda s, k: F.when(s["start"] >= before(k), F.concat(between(pieces, before(k), s["start"]), F.lit(by))).otherwise(""))
        return F.concat(F.array_join(out, ""), between(pieces, F.element_at(ends, -1), F.length(text)))

    return _let(spans_of(text), lambda s: F.when(F.size(s) > 0, cut(s)).otherwise(text))


def redact(docs: DataFrame, by: str = "[SECRET]") -> DataFrame:
    """docs whose spans are replaced in the text; where docs has n_chars, it follows where a text changes."""
    new = {"text": F.col("new.text")}
    if "n_chars" in docs.columns:
        size = F.when(F.col("new.text").eqNullSafe(F.col("row.text")), F.col("row.n_chars")).otherwise(F.length("new.text").cast(docs.schema["n_chars"].dataType))
        new["n_chars"] = size
    # Two structs, so that no column of docs can clash with the new ones.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    both = docs.select(row.alias("row"), F.struct(redacted(F.col("text"), by).alias("text")).alias("new"))
    return both.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] <= 2)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
