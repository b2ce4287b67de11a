"""Allow and block rules for URLs, found by longest match in a trie of host labels and path segments.

A rule names a host and a path.  It fits a URL whose host is that host or lies below it, and whose path starts
with the rule's.  The trie goes from the last host label to the first, then along the path's segments; of all rules
that fit, the one with the most host labels wins, then the one with the longest path.

The trie of a block of rules is broadcast.  Blocks are cut by the rules' measured bytes, so that what a worker holds
is bounded; where there are several blocks, the URLs pass them one after the other and keep their deepest match.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspan.llm.common import kept
from fleetspan.shared import accumulated

# Bytes of rules in one trie, each counted with RULE_BYTES on top for its nodes.
TRIE_BYTES = 48 << 20
RULE_BYTES = 400

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = "labels int, chars int, rule string, verdict string"


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or end, in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or end; empty where there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class RuleTrie:
    """Rules ``(host, path, verdict)`` by reversed host labels, then by path segments.

    Nodes are numbers and edges one flat table, so that deep rules don't nest.  The last segment of a rule is a
    prefix of the URL's segment there; all segments before it are whole.
    """

    def __init__(self, rules):
        self.nodes = 1
        self.edges: dict = {}
        self.paths: dict = {}
        self.ends: dict = {}
        self.sizes: dict = {}
        for host, path, verdict in rules:
            node = 0
            for label in reversed(host.split(".")) if host else ():
                node = self._step(node, label)
            if node not in self.paths:
                self.paths[node] = self._new()
            node = self.paths[node]
            *whole, last = path.split("/")
            for segment in whole:
                node = self._step(node, segment)
            self.ends.setdefault(node, {})[last] = (len(path), host + path, verdict)
        for node, ends in self.ends.items():
            self.sizes[node] = sorted({len(last) for last in ends}, reverse=True)

    def _new(self) -> int:
        self.nodes += 1
        return self.nodes - 1

    def _step(self, node: int, name: str) -> int:
        after = self.edges.get((node, name))
        if after is None:
            after = self.edges[node, name] = self._new()
        return after

    def _along(self, node: int, segments: list[str]):
        best = None
        for segment in segments:
            for size in self.sizes.get(node, ()):
                end = self.ends[node].get(segment[:size]) if size <= len(segment) else None
                if end is not None:
                    best = end
                    break
            node = self.edges.get((node, segment))
            if node is None:
                break
        return best

    def find(self, host: str, path: str):
        """``(labels, chars, rule, verdict)`` of the deepest rule that fits, or None."""
        segments = path.split("/")
        roots = [(0, self.paths[0])] if 0 in self.paths else []
        node = 0
        for depth, label in enumerate(reversed(host.split(".")), 1):
            node = self.edges.get((node, label))
            if node is None:
                break
            if node in self.paths:
                roots.append((depth, self.paths[node]))
        for depth, root in reversed(roots):
            end = self._along(root, segments)
            if end is not None:
                return depth, *end
        return None


def _finder(spark, rules: list):
    trie = spark.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known = trie.value
        for hosts, paths in batches:
            found = [known.find(host, path) or (None,) * 4 for host, path in zip(hosts, paths)]
            made = pd.DataFrame(found, columns=["labels", "chars", "rule", "verdict"])
            yield made.astype({"labels": "Int32", "chars": "Int32"})

    return find


def _blocks(rules: DataFrame, trie_bytes: int) -> Iterator[list]:
    """The rules in blocks of about ``trie_bytes``, each small enough for one broadcast."""
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    verdict = F.when(F.col("verdict").isin("allow", "block"), F.col("verdict")).otherwise(
        F.raise_error(F.concat(F.lit("unknown verdict of a rule: "), F.coalesce("verdict", F.lit("null")))))
    plain = rules.select(F.translate(text("host"), UPPER, LOWER).alias("host"), text("path").alias("path"), verdict.alias("verdict"))
    once = plain.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    size = F.octet_length("host") + F.octet_length("path") + F.lit(RULE_BYTES)
    placed = accumulated(once.withColumn("_size", size.cast("long")), [F.reverse("host"), "path"], "_size")
    cut = placed.withColumn("_block", F.floor(F.col("_index") / trie_bytes))
    last = cut.agg(F.max("_block")).first()[0]
    for block in range(0 if last is None else last + 1):
        yield [tuple(row) for row in cut.where(F.col("_block") == block).select("host", "path", "verdict").collect()]


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", keep=("page_id",), default: str = "allow", trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """``keep``, ``host``, ``path``, ``rule`` and ``verdict`` of every row.

    ``rules`` has ``host``, ``path`` and ``verdict`` (``allow`` or ``block``; anything else is an error).  Rule hosts
    are lower-cased; a null or empty host fits every URL, a null path counts as empty, and of equal rules ``block``
    wins.  ``rule`` is the winner's host and path, null where none fits; such rows get ``default``.

    A null URL, or one without ``://``, has an empty host and path.  Nothing is cut off a host: a port or user name
    stays part of its last label.  Rows are judged one by one, so repeated rows, empty tables and very long URLs need
    nothing special.  Columns that are not in ``keep`` are left out; ``keep`` can't name one of the four answers.
    """
    clash = {"host", "path", "rule", "verdict"} & set(keep)
    if clash:
        raise ValueError(f"columns to keep clash with the answers: {sorted(clash)}")
    if default not in ("allow", "block"):
        raise ValueError(f"unknown verdict {default!r}")
    made = pages.select(*keep, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    found = None
    for block, part in enumerate(_blocks(rules, trie_bytes)):
        if block:
            # One trie at a time: what earlier ones found is written down.
            made, found = kept(made.withColumn("_found", found), "url-rules"), F.col("_found")
        match = _finder(pages.sparkSession, part)(F.col("host"), F.col("path"))
        match = F.when(match["rule"].isNotNull(), match)
        found = match if found is None else F.array_max(F.array(found, match))
    if found is None:
        found = F.lit(None).cast(f"struct<{FOUND.replace(' ', ':')}>".replace(",:", ","))
    return made.withColumn("_best", found).select(
        *keep, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
