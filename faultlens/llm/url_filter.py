"""Allow and block rules on URLs by a sort-merge range join.

A rule (host, path) covers its host, all subdomains, and the paths that start
with its path. With the host reversed label by label, ``www.example.com/en/a``
has the canonical keys ``com SEP /en/a``, ``com.example SEP /en/a`` and
``com.example.www SEP /en/a``; a rule covers exactly the keys that start with
its own key, an interval of the sorted order. Rules and keys are range
partitioned and sorted together, and each partition is swept once with a stack
of the rules whose intervals are still open; intervals are nested or disjoint,
so the top of the stack is the longest rule. Rules that are open where a
partition begins are looked up from that partition's first key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.graph import cut
from faultlens.llm.words import in_batches

SEP = "\x01"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOUND = pa.schema([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


def host_and_path(url):
    """Host and path columns of a url column; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def _reversed_host(host):
    return F.reverse(F.split(host, r"\."))


def _sweep(batches: Iterator[pa.RecordBatch], open_at: dict[int, list]) -> Iterator[pa.RecordBatch]:
    """One sorted partition: rows (part, key, is_url, host, path, rule, verdict)."""

    def rows():
        stack = None
        for batch in batches:
            for part, key, is_url, host, path, rule, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                if stack is None:
                    stack = list(open_at.get(part, ()))
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not is_url:
                    stack.append((key, rule, verdict))
                elif stack:
                    yield host, path, stack[-1][1], stack[-1][2]

    yield from in_batches(rows(), _FOUND)


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per row of ``urls``: the id column, ``host, path, rule, verdict``.

    ``rules`` has ``host, path, verdict``. Of the rules that fit, the longest
    (host and path together, then the longer host) wins; of equal rules with
    both verdicts, ``block`` does. ``rule`` is its host and path, null when none
    fits, and then ``verdict`` is ``default``. Null or malformed urls have an
    empty host and path and no rule; rules with a null or empty host fit
    nothing, a null rule path is empty. Repeated rows are judged each; empty
    tables work on either side. Other columns are not looked at.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    pages = urls.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
                         "verdict").where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = cut(rules.select(
        F.concat(F.array_join(_reversed_host(F.col("host")), "."), F.lit(SEP), "path").alias("key"),
        F.lit(0).alias("is_url"), "host", "path", F.concat("host", "path").alias("rule"), "verdict"))
    depth, longest = rules.agg(F.max(F.size(F.split("host", r"\."))), F.max(F.length("key"))).first()
    targets = pages.where("host <> ''").select("host", "path").distinct()
    labels = _reversed_host(F.col("host"))
    keys = targets.select("host", "path", labels.alias("labels")).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(max(depth or 1, 1)))),
                              lambda j: F.concat(F.array_join(F.slice("labels", 1, j), "."), F.lit(SEP), F.col("path")))).alias("key"),
        F.lit(1).alias("is_url"), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    order = ["key", "is_url"]
    swept = cut(rules.unionByName(keys).repartitionByRange(*order).sortWithinPartitions(*order)
                .select(F.spark_partition_id().alias("part"), "key", "is_url", "host", "path", "rule", "verdict"))
    # Open rules at each partition's start: at most (partitions x nesting depth) rows.
    firsts = swept.groupBy("part").agg(F.min("key").alias("first"))
    prefixes = firsts.select("part", F.explode(F.transform(
        F.sequence(F.lit(1), F.least(F.length("first"), F.lit(longest or 1))), lambda n: F.substring("first", F.lit(1), n))).alias("key"))
    open_at: dict[int, list] = {}
    for r in prefixes.join(rules, "key").select("part", "key", "rule", "verdict").collect():
        open_at.setdefault(r.part, []).append((r.key, r.rule, r.verdict))
    for held in open_at.values():
        held.sort(key=lambda x: len(x[0]))
    found = swept.mapInArrow(lambda it: _sweep(it, open_at), "host string, path string, rule string, verdict string")
    best = found.groupBy("host", "path").agg(F.max(F.struct(
        F.length("rule").alias("n"), F.length(F.regexp_extract("rule", "^[^/]*", 0)).alias("h"), "rule", "verdict")).alias("best"))
    return pages.join(best, ["host", "path"], "left").select(
        pages[id_col], "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
