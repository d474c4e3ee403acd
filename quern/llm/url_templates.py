"""URL verdicts from rules and, where no rule fits, from a tree of path templates for each host.

Pages are first counted by host and shape (the path with its variable parts generalised), so the tree is built from
shapes, not pages. From the root down, a segment that is rare among its siblings becomes a wildcard, and sibling branches
whose subtrees and labels are statistically alike are merged into one, until no path has a segment left; the leaves are
templates. Labels are the rules' own verdicts. A template's share of blocked labels is smoothed by its host's, which is
smoothed by the share of all; a template is rejected if that reaches a limit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.runtime import materialise, ship

#: A literal segment needs so many pages and so large a share of its siblings' pages, so a node has at most 1 / share literal branches.
_LEAST_PAGES, _LEAST_SHARE = 5, 0.005
#: A branch's subtree is the distribution of its pages over so many classes of what follows.
_CLASSES = 256
#: Calls that compare branches, for each shuffle partition.
_CALLS = 4


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first "://" up to /, ?, # or the end, A-Z in lower case) and path (up to ? or # or the end); both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _fitting(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, start = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _shape(path: Column) -> Column:
    """The path with numbers, hexadecimal runs and other runs that hold digits generalised."""
    shaped = F.regexp_replace(path, r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*+[0-9])[0-9A-Fa-f]{8,}+(?![0-9A-Za-z])", "<x>")
    return F.regexp_replace(shaped, "[0-9]+", "<n>")


def _score(part: Column, total: Column, prior: Column, weight: float) -> Column:
    return (part + weight * prior) / (total + weight)


def alike(a: np.ndarray, b: np.ndarray, z: float) -> bool:
    """Whether two branches' counts may come from one distribution: a chi-square test of homogeneity, by the normal
    approximation of its cube root, at the one-sided level of `z`."""
    both = a + b
    used = both > 0
    a, b, both = a[used], b[used], both[used]
    n, m = a.sum(), b.sum()
    if not n or not m or len(both) < 2:
        return True
    expected = both * n / (n + m)
    statistic = ((a - expected) ** 2 * (1 / expected + 1 / (both - expected))).sum()
    free = len(both) - 1
    return ((statistic / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)) <= z


def merge_branches(names: list[str], below: np.ndarray, labels: np.ndarray, z: float) -> list[str]:
    """The name of the branch that each sibling joins: in turn, from the one with most pages, each joins the first branch
    whose pooled subtree and labels are alike, or begins one. Branches with labels and those without are never merged, as
    nothing tells whether they differ.

    below: (siblings, classes) pages; labels: (siblings, 2) labelled pages that are allowed and blocked.
    """
    order = sorted(range(len(names)), key=lambda k: (-below[k].sum(), names[k]))
    found: list[list] = []
    joined = [0] * len(names)
    for k in order:
        for at, (pages, marks, _) in enumerate(found):
            if (marks.sum() > 0) == (labels[k].sum() > 0) and alike(pages, below[k], z) and alike(marks, labels[k], z):
                found[at] = [pages + below[k], marks + labels[k], [*found[at][2], k]]
                break
        else:
            at = len(found)
            found.append([below[k], labels[k], [k]])
        joined[k] = at
    return [names[k] if len(found[at][2]) == 1 else "{" + min(names[i] for i in found[at][2]) + "+}" for k, at in enumerate(joined)]


def _merged(branches: DataFrame, z: float) -> DataFrame:
    """(host, template, segment, branch) of literal branches, from a row for each branch and class of what follows."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("host", "ascending"), ("template", "ascending"), ("segment", "ascending")])
        host, template, segment = (table[c].to_pylist() for c in ("host", "template", "segment"))
        kind, pages, labelled, blocked = (table[c].to_numpy() for c in ("kind", "pages", "labelled", "blocked"))
        out, at = [], 0
        while at < len(host):
            end = at
            while end < len(host) and (host[end], template[end]) == (host[at], template[at]):
                end += 1
            names = sorted(set(segment[at:end]))
            number = {x: k for k, x in enumerate(names)}
            below, labels = np.zeros((len(names), _CLASSES)), np.zeros((len(names), 2))
            for k in range(at, end):
                row = number[segment[k]]
                below[row, kind[k]] += pages[k]
                labels[row] += (labelled[k] - blocked[k], blocked[k])
            out += [(host[at], template[at], x, y) for x, y in zip(names, merge_branches(names, below, labels, z), strict=True)]
            at = end
        return pa.table([pa.array(x, pa.string()) for x in (zip(*out, strict=True) if out else [()] * 4)], names=["host", "template", "segment", "branch"])

    ship(branches.sparkSession)
    tasks = _CALLS * int(branches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = branches.withColumn("task", F.pmod(F.xxhash64("host", "template"), F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(merge, "host string, template string, segment string, branch string")


def _levels(shapes: DataFrame, z: float) -> Iterator[DataFrame]:
    """(host, shape, labelled, blocked, template), those first whose paths end first.

    A node's paths are done where they end, where the node has too few pages for any literal segment, and where the node
    has one shape only; segments that all its paths share are taken at once. So each round is one level of branching.
    """
    node = ["host", "template"]
    rows = shapes.withColumn("segments", F.slice(F.split("shape", "/"), 2, F.length("shape") + 1)).withColumn("template", F.lit("")).withColumn("level", F.lit(0))
    while True:
        left = F.slice("segments", F.col("level") + 1, F.greatest(F.size("segments") - F.col("level"), F.lit(0)))
        nodes = rows.groupBy(*node).agg(F.sum("pages").alias("all_pages"), F.count(F.lit(1)).alias("shapes"), F.min(left).alias("low"), F.max(left).alias("high"))
        parts = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), False).cast("int")  # what least and largest share, all share
        shared = F.when(F.col("all_pages") < _LEAST_PAGES, 0).when(parts > 0, parts - 1).otherwise(F.size("low"))
        rows = rows.join(nodes.select(*node, "all_pages", "shapes", shared.alias("shared")), node)
        common = F.transform(F.slice("segments", F.col("level") + 1, F.col("shared")), lambda s: F.concat(F.lit("/"), s))
        rows = materialise(rows.withColumn("template", F.concat("template", F.array_join(common, ""))).withColumn("level", F.col("level") + F.col("shared")))
        rest = F.when(F.col("all_pages") < _LEAST_PAGES, F.transform(left, lambda _: F.lit("*"))).otherwise(left)
        done = (F.size("segments") <= F.col("level")) | (F.col("all_pages") < _LEAST_PAGES) | (F.col("shapes") == 1)
        yield rows.where(done).select("host", "shape", "labelled", "blocked", F.concat("template", F.array_join(F.transform(rest, lambda s: F.concat(F.lit("/"), s)), "")).alias("template"))
        if rows.where(~done).isEmpty():
            return
        rows = rows.where(~done).withColumn("segment", F.element_at("segments", F.col("level") + 1))
        kind = F.pmod(F.xxhash64(F.slice("segments", F.col("level") + 2, F.size("segments"))), F.lit(_CLASSES)).cast("int")
        sums = [F.sum(c).alias(c) for c in ("pages", "labelled", "blocked")]
        children = materialise(rows.groupBy(*node, "segment", kind.alias("kind")).agg(*sums, F.first("all_pages").alias("all_pages")))
        pages = children.groupBy(*node, "segment").agg(F.sum("pages").alias("n"), F.first("all_pages").alias("all_pages"))
        literal = pages.where((F.col("n") >= _LEAST_PAGES) & (F.col("n") >= _LEAST_SHARE * F.col("all_pages"))).select(*node, "segment")
        branches = materialise(_merged(children.join(literal, [*node, "segment"], "left_semi"), z))
        named = rows.join(branches, [*node, "segment"], "left").withColumn("template", F.concat("template", F.lit("/"), F.coalesce("branch", F.lit("*"))))
        rows = materialise(named.withColumn("level", F.col("level") + 1).select("host", "shape", "pages", "labelled", "blocked", "segments", "template", "level"))


def _templates(shapes: DataFrame, weight: float, z: float) -> DataFrame:
    """(host, shape, template, purity) from (host, shape, pages, labelled, blocked)."""
    rows = None
    for level in _levels(shapes, z):
        rows = level if rows is None else rows.unionAll(level)
    rows = materialise(rows)
    leaves = materialise(rows.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b")))
    hosts = materialise(leaves.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("b").alias("host_b")))
    blocked, labelled = hosts.agg(F.sum("host_b"), F.sum("host_n")).first()
    share = ((blocked or 0) + 0.5 * weight) / ((labelled or 0) + weight)
    prior = _score(F.col("host_b"), F.col("host_n"), F.lit(share), weight)
    scored = leaves.join(hosts, "host").select("host", "template", _score(F.col("b"), F.col("n"), prior, weight).alias("purity"))
    return materialise(rows.join(scored, ["host", "template"]).select("host", "shape", "template", "purity"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], limit: float = 0.8, weight: float = 10.0, z: float = 1.645, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule (the longest one that fits, else null), verdict (the rule's; else block if the template's smoothed blocked purity reaches `limit`), template, purity.

    `rules` are (verdict, host and path start) with the verdicts allow and block. A null url or one without "://" has an
    empty host and path, and is judged by the template of the empty host. Null ids and repeated rows are judged like any
    others. Other columns are not read. An empty table gives an empty result. Paths of any depth are compared whole: one
    round for each level at which some host still branches. `z` is the level of the tests that merge branches.
    """
    host, path = split_url(pages[url_column].cast("string"))
    rows = pages.select(pages[id_column].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", _fitting(F.col("host"), F.col("path"), rules)).withColumn("shape", _shape(F.col("path")))
    labelled, blocked = F.col("fit").isNotNull().cast("long"), (F.col("fit.verdict") == "block").cast("long")
    shapes = materialise(rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"), F.sum(labelled).alias("labelled"), F.sum(F.coalesce(blocked, F.lit(0))).alias("blocked")))
    judged = rows.join(_templates(shapes, weight, z), ["host", "shape"], "left")
    verdict = F.coalesce("fit.verdict", F.when(F.col("purity") >= limit, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
