"""URL filters: a trie over reversed host labels and path segments, with longest-match precedence.

Defined results: a null url, or one without ``://``, has an empty host and path and gets the default
verdict, as does any url that no rule fits; repeated rows are judged each for itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: Rules of more bytes than this are joined instead of broadcast.
MAX_BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str = "/"


class UrlTrie:
    """Nodes are dicts: host labels from the right, then "/" to the path's part, then whole segments.

    A rule's last, open segment (empty when its path ends in a slash) is kept at its node as a prefix.
    """

    _PATH, _ENDS = object(), object()

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.translate(_FOLD).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(0, {})
            *segments, rest = rule.path.split("/")
            for segment in segments:
                node = node.setdefault(segment, {})
            ends = node.setdefault(1, {})
            # Of two rules for the same urls the block entry stands.
            if ends.get(rest, (ALLOW, ""))[0] == ALLOW:
                ends[rest] = (rule.verdict, rule.host.translate(_FOLD) + rule.path)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits, block before allow among equals."""
        best: tuple[str, str] | None = None
        node: dict | None = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if 0 in node:
                best = self._match_path(node[0], segments, best)
        return best

    @staticmethod
    def _match_path(node: dict | None, segments: list[str], best: tuple[str, str] | None) -> tuple[str, str] | None:
        for k, segment in enumerate(segments):
            for rest, entry in node.get(1, {}).items():
                if (not rest or "/".join(segments[k:]).startswith(rest)) and (best is None or (len(entry[1]), entry[0]) > (len(best[1]), best[0])):
                    best = entry
            node = node.get(segment)
            if node is None:
                break
        return best


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path, both empty for a null url or one without ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return pages.withColumns({"host": F.translate(part(1), UPPER, LOWER), "path": part(2)})


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", key: str = "page_id", default: str = ALLOW) -> DataFrame:
    """key, host, path, rule and verdict of every row. The trie is broadcast when the rules are of a checked size."""
    rules = list(rules)
    parts = with_host_and_path(pages.select(key, url), url).select(key, "host", "path")
    if sum(len(r.host) + len(r.path) + 64 for r in rules) > MAX_BROADCAST_BYTES:
        return _by_join(parts, rules, key, default)
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [trie.value.match(h, p) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f and f[1] for f in found], pa.string()), pa.array([f[0] if f else default for f in found], pa.string())],
                names=[*batch.schema.names, "rule", "verdict"],
            )

    return parts.mapInArrow(judge, f"`{key}` {dict(parts.dtypes)[key]}, host string, path string, rule string, verdict string")


def _by_join(parts: DataFrame, rules: Sequence[Rule], key: str, default: str) -> DataFrame:
    """The same for rule sets too large to broadcast: each url's host suffixes and path folders are looked up."""
    spark = parts.sparkSession
    table = spark.createDataFrame([(r.host.translate(_FOLD), r.path.rpartition("/")[0] + "/" if "/" in r.path else "", r.path, r.verdict) for r in rules], "rule_host string, folder string, rule_path string, rule_verdict string")
    labels = F.split("host", r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    cuts = F.split("path", "/")
    folders = F.array_union(F.array(F.lit("")), F.when(F.size(cuts) > 1, F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda i: F.concat(F.array_join(F.slice(cuts, 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>")))
    parts = parts.withColumn("__row", F.monotonically_increasing_id())
    looked = parts.withColumn("rule_host", F.explode(hosts)).withColumn("folder", F.explode(folders)).join(table, ["rule_host", "folder"]).where(F.expr("startswith(path, rule_path)"))
    best = looked.groupBy("__row").agg(F.max(F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), F.col("rule_verdict"), F.concat("rule_host", "rule_path").alias("rule"))).alias("best"))
    return parts.join(best, "__row", "left").select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
