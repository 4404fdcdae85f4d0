"""Tool-call linking: calls and results joined by identifier, ordered, validated and written as canonical JSON.

Calls and results meet in a hash join on conversation and id, as an id need not be unique beyond its conversation. A call may name the call whose result it uses (`after`); its depth
in that forest is found by pointer doubling, so a chain of n calls takes log2(n) joins, and (depth, call_id) sorts the calls of
a conversation topologically. Arguments are checked against the tool's schema, and call and result become one canonical JSON
object (sorted keys, no spaces, no escapes beyond those that JSON needs).

Defined results: rows repeated whole count once; of different calls with one id in one conversation the least stays, of different
results all do (sorted, as `results` instead of `result`, nulls first), and the status says so; a null conv_id is a conversation; a call without a result is unanswered, a result without a call an orphan; calls on a cycle or behind one have no depth and
status cycle; an `after` that names no call is dangling and starts at depth 0; null ids are left out; null arguments, broken
JSON (half of a surrogate pair and a number beyond a double's range are broken too) and unknown tools are errors of that call; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.llm import common

#: The registered tools.
TOOLS = {
    "lookup": {"properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 10}}, "required": ["query", "limit"]},
    "translate": {"properties": {"text": {"type": "string"}, "target": {"type": "string", "enum": ["de", "en", "es", "fr"]}}, "required": ["text", "target"]},
    "summarise": {"properties": {"text": {"type": "string"}, "words": {"type": "number", "minimum": 5}, "plain": {"type": "boolean"}}, "required": ["text"]},
}
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _no_constant(name: str):
    raise ValueError(name)


def _finite(digits: str) -> float:
    if math.isinf(value := float(digits)):
        raise ValueError(digits)
    return value


def check(name: str | None, arguments: str | None, tools: dict) -> tuple[dict | None, list[str]]:
    """The arguments and what is wrong with them."""
    if name not in tools:
        return None, ["unknown tool"]
    try:
        got = json.loads(arguments or "", parse_constant=_no_constant, parse_float=_finite)
        canonical(got).encode()
    except (ValueError, RecursionError):  # among them half of a surrogate pair and a number beyond the range of a double
        return None, ["broken json"]
    if not isinstance(got, dict):
        return None, ["not an object"]
    known, wrong = tools[name]["properties"], []
    wrong += [f"missing {k}" for k in tools[name].get("required", []) if k not in got]
    for k, v in got.items():
        rule = known.get(k)
        if rule is None:
            wrong.append(f"unknown {k}")
        elif not isinstance(v, TYPES[rule["type"]]) or isinstance(v, bool) != (rule["type"] == "boolean"):
            wrong.append(f"type {k}")
        elif v < rule.get("minimum", v) or v > rule.get("maximum", v) if not isinstance(v, (str, list, dict)) else len(v) < rule.get("minLength", 0):
            wrong.append(f"range {k}")
        elif v not in rule.get("enum", [v]):
            wrong.append(f"enum {k}")
    return got, sorted(wrong)


def depths(calls: DataFrame) -> DataFrame:
    """call_id and depth of calls (call_id, after), unique by call_id; no depth on or behind a cycle.

    Only calls that still have a way to go are joined in a round; those that have reached a first call are set apart.
    """
    known = calls.select(F.col("call_id").alias("after"), F.lit(True).alias("there"))
    first = calls.where("after IS NULL").select("call_id", F.lit(None).cast(calls.schema["call_id"].dataType).alias("jump"))
    later = calls.where("after IS NOT NULL").join(known, "after", "left").select("call_id", F.when(F.col("there"), F.col("after")).alias("jump"))
    state = common.written(first.unionByName(later).withColumn("steps", F.col("jump").isNotNull().cast("long")), "jumps")
    done, open_ = state.where("jump IS NULL"), state.where("jump IS NOT NULL")
    for _ in range(math.ceil(math.log2(max(2, state.count()))) + 1):
        if not open_.limit(1).count():
            break
        target = done.unionByName(open_).select(F.col("call_id").alias("jump"), F.col("jump").alias("further"), F.col("steps").alias("more"))
        state = common.written(open_.join(target, "jump").select("call_id", F.col("further").alias("jump"), (F.col("steps") + F.col("more")).alias("steps")), "jumps")
        done, open_ = done.unionByName(state.where("jump IS NULL")), state.where("jump IS NOT NULL")
    return done.select("call_id", F.col("steps").alias("depth")).unionByName(open_.select("call_id", F.lit(None).cast("long").alias("depth")))


def link(calls: DataFrame, results: DataFrame, tools: dict = TOOLS) -> DataFrame:
    """One row for each conversation and id of calls (conv_id, call_id, after, name, arguments) and results (conv_id, call_id, content)."""
    key = lambda name: F.when(F.col(name).isNotNull(), F.struct("conv_id", F.col(name).alias("call_id")))
    asked = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("name", "arguments", "after")).alias("call"), F.count_distinct(F.struct(F.coalesce("name", F.lit("\0")), F.coalesce("arguments", F.lit("\0")), F.coalesce("after", F.lit("\0")))).alias("n_calls"))
    asked = asked.select("conv_id", "call_id", "call.*", "n_calls")
    asked = common.written(asked.select(key("call_id").alias("call_id"), key("after").alias("after"), "name", "arguments", "n_calls"), "calls")
    told = results.where("call_id is not null").groupBy(F.struct("conv_id", "call_id").alias("call_id")).agg(F.array_sort(F.collect_set(F.struct("content"))).alias("found"))
    told = told.select("call_id", F.col("found.content").alias("contents"), F.size("found").alias("n_results"))
    deep = depths(asked.select("call_id", "after"))
    known = asked.select(F.col("call_id").alias("after"), F.lit(True).alias("parent"))
    joined = asked.where("after IS NULL").withColumn("parent", F.lit(None).cast("boolean")).unionByName(asked.where("after IS NOT NULL").join(known, "after", "left").select(*asked.columns, "parent"))
    joined = joined.join(deep, "call_id").join(told, "call_id", "full_outer")
    orphan = F.col("n_calls").isNull()

    @F.pandas_udf("valid boolean, errors string, json string")
    def validated(ids: pd.Series, names: pd.Series, arguments: pd.Series, contents: pd.Series, orphans: pd.Series) -> pd.DataFrame:
        out = []
        for i, n, a, c, o in zip(ids, names, arguments, contents, orphans, strict=True):
            got, wrong = (None, []) if o else check(n, a, tools)
            raw = {} if got is not None or o else {"raw": a}
            told = {"result": None if c is None else c[0]} if c is None or len(c) < 2 else {"results": list(c)}
            body = {"id": i} | told if o else {"id": i, "name": n, "arguments": got} | told | raw
            out.append((not wrong and not o, ";".join(wrong), canonical(body)))
        return pd.DataFrame(out, columns=["valid", "errors", "json"])

    status = F.when(orphan, "orphan").when(F.col("depth").isNull(), "cycle").when(F.col("n_calls") > 1, "repeated call").when(F.col("n_results") > 1, "repeated result").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    dangling = F.col("after").isNotNull() & F.col("parent").isNull()
    out = joined.select("call_id.*", "depth", status.alias("status"), (dangling & ~orphan).alias("dangling"), validated("call_id.call_id", "name", "arguments", "contents", orphan).alias("v"))
    return out.select("conv_id", "call_id", "depth", "status", "dangling", "v.*")


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in conversations (conv_id, turn, role, text): a user's turn calls a tool, by its length, after the
    user's turn before; the assistant's turn that follows is the result."""
    ident = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    n = F.length(F.coalesce("text", F.lit("")))
    which = F.pmod(n, F.lit(3))
    lookup = F.to_json(F.struct(F.col("text").alias("query"), F.pmod(n, F.lit(13)).alias("limit")))
    translate = F.to_json(F.struct(F.col("text").alias("text"), F.element_at(F.array(*map(F.lit, ["de", "en", "es", "fr", "xx"])), F.pmod(n, F.lit(5)) + 1).alias("target")))
    summarise = F.to_json(F.struct("text", (n / 10).alias("words"), (n > 300).alias("plain")))
    there = turns.where("conv_id is not null and turn is not null")
    calls = there.where("role = 'user'").select("conv_id", ident(0).alias("call_id"), F.when(F.col("turn") >= 2, ident(2)).alias("after"), F.when(which == 0, "lookup").when(which == 1, "translate").otherwise("summarise").alias("name"), F.when(which == 0, lookup).when(which == 1, translate).otherwise(summarise).alias("arguments"))
    return calls, there.where("role = 'assistant'").select("conv_id", ident(1).alias("call_id"), F.col("text").alias("content"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(*from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
