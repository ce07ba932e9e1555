"""URL allow and block lists as a trie over reversed host labels and path segments.

A url walks host labels from the right; at every host node that holds rules it walks the path's segments.  The longest
rule that fits decides; of equally long ones a block rule before an allow rule, then that of the longer host.

The trie is flat (numbered nodes, edges in a dictionary), so its depth has no limit, and is broadcast while the list has
at most MAX_RULES rules of MAX_CHARS code points in all.  A longer list is not broadcast: each url is joined with the
hosts of rules that are suffixes of its host, then its path prefixes, of the lengths that a host's rules have, are joined
with the rules themselves.  Both ways give equal results.

Defined cases: null urls and urls without ``://`` have an empty host and path, which rules without host may fit; the
verdict without a rule is ``default`` (allow); a host's port or user part belongs to the host as written; repeated rows
are judged alike.  Rules: a null host or path is an empty one, which fits all; those without verdict do not count.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, broadcast_if_small, materialise, table

#: Rules, and code points in their hosts and paths, that are broadcast as a trie.
MAX_RULES, MAX_CHARS = 500_000, 32_000_000
#: (verdict, host, path) of the contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


@dataclass
class Trie:
    """next: node behind a host label or a whole path segment with its slash; paths: root of a host node's path trie;
    ends: the rules that end at a node, by their unfinished last segment, and lengths of these."""

    next: dict[tuple[int, str], int] = field(default_factory=dict)
    paths: dict[int, int] = field(default_factory=dict)
    ends: dict[int, dict[str, tuple]] = field(default_factory=dict)
    sizes: dict[int, list[int]] = field(default_factory=dict)
    nodes: int = 1

    def node(self) -> int:
        self.nodes += 1
        return self.nodes - 1

    def step(self, node: int, name: str) -> int:
        if (node, name) not in self.next:
            self.next[node, name] = self.node()
        return self.next[node, name]


def segments(path: str) -> list[str]:
    """'/en/1' to ['/', 'en/', '1']: every segment keeps its slash, the rest is last."""
    parts = path.split("/")
    return [x + "/" for x in parts[:-1]] + [parts[-1]]


def build(rules) -> Trie:
    trie = Trie()
    for verdict, host, path in rules:
        host, path, node = host or "", path or "", 0
        if verdict is None:
            continue
        for label in reversed(host.split(".")) if host else ():
            node = trie.step(node, label)
        if node not in trie.paths:
            trie.paths[node] = trie.node()
        node = trie.paths[node]
        *whole, rest = segments(path)
        for x in whole:
            node = trie.step(node, x)
        found = (len(host) + len(path), verdict, len(host), host + path)
        ends = trie.ends.setdefault(node, {})
        ends[rest] = max(ends.get(rest, found), found)
    trie.sizes = {node: sorted({len(x) for x in ends}) for node, ends in trie.ends.items()}
    return trie


def find(trie: Trie, host: str, path: str) -> tuple[str | None, str | None]:
    """(rule, verdict) of the longest rule that fits."""
    best = (-1, "", -1, None)
    node, labels, parts = 0, host.split(".") if host else [], segments(path)
    for depth in range(len(labels) + 1):
        at = trie.paths.get(node)
        for part in parts if at is not None else ():
            for size in trie.sizes.get(at, ()):
                if size > len(part):
                    break
                best = max(best, trie.ends[at].get(part[:size], best))
            at = trie.next.get((at, part))
            if at is None:
                break
        if depth == len(labels) or (node := trie.next.get((node, labels[-1 - depth]))) is None:
            break
    return best[3], best[1] or None


def by_trie(parts: DataFrame, rules: list) -> Column:
    """Column of the rule and verdict of host and path.

    The broadcast holds plain values, for executors read it without this package on their path.
    """
    held = parts.sparkSession.sparkContext.broadcast(vars(build(rules)))

    @F.pandas_udf("struct<rule string, verdict string>")
    def longest(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        trie = Trie(**held.value)
        found = [find(trie, h, p) for h, p in zip(hosts, paths)]
        return pd.DataFrame({"rule": [r for r, _ in found], "verdict": [v for _, v in found]}, dtype=object)

    return longest("host", "path")


def by_join(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, found) of each distinct host and path that a rule fits; parts: host, path."""
    size = F.length("rule_host") + F.length("rule_path")
    found = F.struct(size.alias("size"), "verdict", F.length("rule_host").alias("of_host"), F.concat("rule_host", "rule_path").alias("rule"))
    named = rules.where("verdict IS NOT NULL").select("verdict", F.coalesce("host", F.lit("")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"))
    held = materialise(named.groupBy("rule_host", "rule_path").agg(F.max(found).alias("found")), "url-rules")
    hosts = materialise(held.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("sizes")), "url-hosts")
    labels = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.split("host", r"\."))
    deepest = hosts.agg(F.max(F.when(F.col("rule_host") == "", 0).otherwise(F.size(F.split("rule_host", r"\."))))).first()[0] or 0
    count = F.least(F.size("labels"), F.lit(deepest))
    suffixes = F.transform(F.sequence(F.lit(0), count), lambda n: F.array_join(F.slice(F.col("labels"), F.size("labels") - n + 1, n), "."))
    urls = parts.distinct().withColumn("labels", labels)
    met = urls.select("host", "path", F.explode(suffixes).alias("rule_host")).join(broadcast_if_small(hosts), "rule_host")
    fits = F.filter("sizes", lambda n: n <= F.length("path"))
    tried = met.select("host", "path", "rule_host", F.explode(F.transform(fits, lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("rule_path"))
    return tried.join(held, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max("found").alias("found"))


def judge(pages: DataFrame, rules=RULES, default: str = "allow", max_rules: int = MAX_RULES, max_chars: int = MAX_CHARS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row's url; rules: (verdict, host, path), listed or as a table."""
    if isinstance(rules, DataFrame):
        n, chars = rules.agg(F.count("*"), F.coalesce(F.sum(F.coalesce(F.length("host"), F.lit(0)) + F.coalesce(F.length("path"), F.lit(0))), F.lit(0))).first()
    else:
        rules = list(rules)
        n, chars = len(rules), sum(len(h or "") + len(p or "") for _, h, p in rules)
    rest = F.coalesce(F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    split = pages.select("page_id", host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"))
    if n <= max_rules and chars <= max_chars:
        listed = [tuple(r) for r in rules.select("verdict", "host", "path").collect()] if isinstance(rules, DataFrame) else rules
        judged = split.withColumn("found", by_trie(split, listed))
    else:
        long_list = rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
        found = by_join(split.select("host", "path"), long_list).withColumnsRenamed({"host": "h", "path": "p"})
        judged = split.join(found, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    return judged.select("page_id", "host", "path", "found.rule", F.coalesce("found.verdict", F.lit(default)).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))


OP3_SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, host, path, (SELECT max_by([rhost || rpath, verdict], length(rhost || rpath)) FROM r
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS found FROM p)
SELECT page_id, host, path, found[1] AS rule, coalesce(found[2], 'allow') AS verdict FROM m
"""
