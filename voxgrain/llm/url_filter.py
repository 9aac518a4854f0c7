"""Allow and block rules on URLs: a trie over reversed host labels and path segments.

A rule is a host and a path prefix. It fits a URL on that host or any of its subdomains whose path
starts with the rule's path. Of the rules that fit, the one with the most host labels wins, then the
longest path, whatever its verdict; where none fits, the default holds.

Defined results: a null URL, or one without ``://``, has an empty host and path, which no rule fits.
A URL without a path has the empty path, which only a rule with an empty path fits. Repeated rows are
judged alike; an empty table gives an empty result. The same rule given as both allow and block is refused.

The trie is sent to the executors whole only up to ``trie_limit`` rules. A larger list is joined: each
distinct URL is listed under the suffixes of its host and meets the rules by an equi-join on the host.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

ALLOW, BLOCK = "allow", "block"
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_HOST_END, _PATH_END = re.compile(r"[/?#]"), re.compile(r"[?#]")
JUDGED = "host string, path string, rule string, verdict string"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = m.start() if (m := _HOST_END.search(rest)) else len(rest)
    path = rest[end:]
    if m := _PATH_END.search(path):
        path = path[: m.start()]
    return rest[:end].translate(_LOWER), path


class _Node:
    """A host label or a path segment. ``partial`` holds the rules that end inside the next segment."""

    __slots__ = ("down", "paths", "partial")

    def __init__(self):
        self.down: dict[str, _Node] = {}
        self.paths: _Node | None = None
        self.partial: dict[str, tuple[str, str]] = {}


class RuleTrie:
    """Host labels from the right, then path segments from the left; the last segment of a rule may be partial."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root = _Node()
        for verdict, host, path in rules:
            if verdict not in (ALLOW, BLOCK):
                raise ValueError(f"unknown verdict {verdict!r}")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.down.setdefault(label, _Node())
            node.paths = at = node.paths or _Node()
            *whole, last = path.split("/")
            for segment in whole:
                at = at.down.setdefault(segment, _Node())
            if at.partial.setdefault(last, (host + path, verdict))[1] != verdict:
                raise ValueError(f"{host}{path} is both allowed and blocked")

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule that wins and its verdict."""
        node, best, segments = self.root, None, path.split("/")
        for label in reversed(host.split(".")):
            node = node.down.get(label)
            if node is None:
                break
            if node.paths is not None:
                best = self._longest(node.paths, segments) or best
        return best

    @staticmethod
    def _longest(node: _Node, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            if node.partial:
                best = next((node.partial[p] for n in range(len(segment), -1, -1) if (p := segment[:n]) in node.partial), best)
            node = node.down.get(segment)
            if node is None:
                break
        return best


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = ALLOW, trie_limit: int = 500_000) -> DataFrame:
    """``df`` with a struct column ``judged`` (host, path, rule, verdict) for each row's URL, in place of any column of that name."""
    RuleTrie(rules)  # refuses bad rules here rather than on the executors
    if len(rules) > trie_limit:
        return _judge_by_join(df, rules, url, default)
    sent = df.sparkSession.sparkContext.broadcast(rules)

    @F.pandas_udf(JUDGED)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = RuleTrie(sent.value)
        for urls in batches:
            rows = []
            for u in urls:
                host, path = split_url(u)
                rule, verdict = trie.match(host, path) or (None, default)
                rows.append((host, path, rule, verdict))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    return df.withColumn("judged", judge(F.col(f"`{url}`")))


def host_column(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_column(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _judge_by_join(df: DataFrame, rules: list[tuple[str, str, str]], url: str, default: str) -> DataFrame:
    spark = df.sparkSession
    flat = spark.createDataFrame(
        pd.DataFrame([(h.translate(_LOWER), p, h + p, v, h.count(".") + 1) for v, h, p in rules], columns=["suffix", "prefix", "rule", "rule_verdict", "labels"])
    )
    urls = df.select(F.col(f"`{url}`").alias("u")).distinct().withColumn("host", host_column(F.col("u"))).withColumn("path", path_column(F.col("u")))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    won = (
        urls.withColumn("suffix", F.explode(suffixes))
        .join(flat, "suffix")
        .filter(F.col("path").startswith(F.col("prefix")))
        .groupBy(F.col("u").alias("of_url"))
        .agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct("labels", F.length("prefix"))).alias("won"))
    )
    judged = F.struct(
        "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.rule_verdict", F.lit(default)).alias("verdict")
    )
    of = fresh(df, "judged_url")[0]
    found = urls.join(won, F.col("u").eqNullSafe(F.col("of_url")), "left").select(F.col("u").alias(of), judged.alias("judged"))
    return df.drop("judged").join(found, F.col(f"`{url}`").eqNullSafe(F.col(of)), "left").drop(of)


#: The rules that the query is asked to apply.
RULES = [
    (ALLOW, "org", "/"),
    (BLOCK, "example.org", "/es/"),
    (BLOCK, "example.org", "/en/1"),
    (ALLOW, "com", "/fr/"),
    (BLOCK, "com", "/de/"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


OP7_SQL = r"""
with cut as (
  select page_id,
    case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest
  from pages),
parts as (
  select page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from cut),
rules(rhost, rpath, rverdict) as (values
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best as (
  select page_id, host, path,
    (select max_by(struct_pack(rule := rhost || rpath, verdict := rverdict), length(rhost) * 1000 + length(rpath)) from rules
     where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)) as won
  from parts)
select page_id, host, path, won.rule as rule, coalesce(won.verdict, 'allow') as verdict
from best
"""
