"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join of what it passes.

Each listed URL picks one block of 512 bits by its hash and sets BITS of them; the blocks are or-ed together in a shuffle
and broadcast. The number of blocks follows the number of listed URLs and stops at MAX_BLOCKS (about 32 MB), so the
broadcast has a bound at any size: past it only more URLs pass, and the exact join still removes them.

The list of the registered query is made from the pages themselves: a page whose title has SYMBOLS or more marks is junk,
and its canonical URL is listed, so all spellings of that address are blocked.

Defined results: a null URL or one without :// has an empty host and path, fits no rule and is allowed; an empty host is
never listed; repeated rows are judged each; an empty list blocks nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 6
WORDS = 8
MAX_BLOCKS = 1 << 19
KEYS_PER_BLOCK = 40
SYMBOLS = 3
#: Verdict, host, path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that say where a visitor came from.
TRACKING = r"(^|&)(utm_[a-z]+|ref)=[^&]*"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path without its trailing slashes, and the query without tracking parameters; no scheme, no fragment."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    query = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "^&+", "")
    return F.concat(host(url), F.regexp_replace(path(url), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def rule(hosts: Column, paths: Column) -> Column:
    """The longest rule that fits, as a struct of rule and verdict."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((hosts == h) | hosts.endswith(f".{h}")) & paths.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def bloom(urls: DataFrame) -> tuple[DataFrame, int]:
    """Blocks (block, w0 .. w7) of the distinct column url, and their number."""
    n = urls.count()
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * KEYS_PER_BLOCK < n:
        blocks *= 2
    masks = urls.select(_block(F.col("url"), blocks).alias("block"), *[_mask(F.col("url"), w).alias(f"w{w}") for w in range(WORDS)])
    return masks.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)]), blocks


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column, word: int) -> Column:
    second, out = F.xxhash64(F.lit(1), key), F.lit(0).cast("long")
    for k in range(BITS):
        place = F.shiftrightunsigned(second, 9 * k).bitwiseAND(F.lit(511))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
        out = out.bitwiseOR(F.when(F.shiftright(place, 6) == word, bit).otherwise(F.lit(0).cast("long")))
    return out


def listed(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """pages (page_id, url) with `hit`: its canonical URL is in the column url of urls."""
    urls = urls.select("url").where("url <> ''").distinct()
    blocks, n = bloom(urls)
    keyed = pages.select("page_id", "url", canonical(F.col("url")).alias("key"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    tested = keyed.withColumn("block", _block(F.col("key"), n)).join(F.broadcast(blocks), "block", "left")
    passes = F.lit(True)
    for w in range(WORDS):
        mask = _mask(F.col("key"), w)
        passes = passes & (F.coalesce(F.col(f"w{w}"), F.lit(0)).bitwiseAND(mask) == mask)
    tested = tested.withColumn("maybe", passes & (F.col("host") != "")).select("page_id", "host", "path", "maybe", F.when(F.col("maybe"), F.col("key")).alias("key"))
    clear = tested.where(~F.col("maybe")).select("page_id", "host", "path", F.lit(False).alias("hit"))
    exact = urls.select(F.col("url").alias("key"), F.lit(True).alias("hit"))
    found = tested.where("maybe").join(exact, "key", "left").select("page_id", "host", "path", F.coalesce("hit", F.lit(False)).alias("hit"))
    return clear.union(found)


def judge(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of pages (page_id, url): the rule's, else block if the list has the URL."""
    found = listed(pages, urls).withColumn("fit", rule(F.col("host"), F.col("path")))
    method = F.when(F.col("hit"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), F.col("hit").alias("listed"))


def junk_urls(pages: DataFrame) -> DataFrame:
    """Canonical URLs of pages whose title has SYMBOLS or more marks."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?s)<title>(.*?)</title>", 1)
    marks = F.length(title) - F.length(F.translate(title, "#*$%|<>", ""))
    return pages.where((marks >= SYMBOLS) & (host(F.col("url")) != "")).select(canonical(F.col("url")).alias("url"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, junk_urls(pages))


def _sql() -> str:
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rules = " ".join(f"{f}'{h}{p}'" for f, (_, h, p) in zip(fits, order, strict=True))
    verdicts = " ".join(f"{f}'{v}'" for f, (v, _, _) in zip(fits, order, strict=True))
    return rf"""
WITH parts AS (
  SELECT page_id, html,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    regexp_replace(regexp_replace(coalesce(regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's'), ''), '{TRACKING}', '', 'g'), '^&+', '') AS query
  FROM pages),
keyed AS (
  SELECT *, host || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS key,
    regexp_extract(coalesce(html, ''), '<title>(.*?)</title>', 1, 's') AS title
  FROM parts),
junk AS (SELECT DISTINCT key FROM keyed WHERE host <> '' AND length(title) - length(translate(title, '#*$%|<>', '')) >= {SYMBOLS})
SELECT page_id, host, path, CASE {rules} END AS rule,
  CASE {verdicts} WHEN host <> '' AND key IN (SELECT key FROM junk) THEN 'block' ELSE 'allow' END AS verdict,
  host <> '' AND key IN (SELECT key FROM junk) AS listed
FROM keyed"""


ORACLE = {"op9_url_filter": _sql()}
