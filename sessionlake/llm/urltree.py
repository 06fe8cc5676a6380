"""URL filters: rules, then a path-template tree per host.  DataFrame functions only.

A url's host is what follows its first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; its
path goes on up to `?`, `#` or the end.  The longest rule (host, path) that fits decides.

Urls no rule fits are judged by the tree.  Paths are first turned into patterns (digit runs
become {n}, long hexadecimal runs {h}) and counted per host, so only distinct patterns and their
counts of pages, of labelled and of blocked pages are shuffled further; labels are the verdicts
of the rules.  In the tree
- a node with `WIDE` children or more that average under `THIN` pages each is variable: its
  children become one wildcard;
- sibling branches are merged into one if the shape below them is the same and their labelled
  block rate does not differ from that of the siblings together (z below `Z`; unlabelled branches
  never differ);
- a template's purity is its share of blocked labels, smoothed by `WEIGHT` pseudo-labels at the
  host's rate, which is smoothed at the rate of all labels; from `PURE` on it is rejected.

Defined cases: null urls and urls without `://` have empty host and path and, like any host
without labels, take the smoothed rate of all; repeated pages count each; nulls in other columns
do not matter.  Every group is an aggregate with partial sums; windows stand over distinct
patterns of one host and parent only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path); the longest that fits wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
WIDE, THIN, Z, WEIGHT, PURE = 20, 3.0, 1.96, 4.0, 0.6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fitting(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule as host + path, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def pattern(path: Column) -> Column:
    """Segments of a path with variable parts generalised."""
    hexed = F.regexp_replace(path, "(?<![0-9A-Za-z])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}(?![0-9A-Za-z])", "{h}")
    return F.filter(F.split(F.regexp_replace(hexed, "[0-9]+", "{n}"), "/", -1), lambda x: x != "")


def templates(patterns: DataFrame) -> DataFrame:
    """host, segs, n, labelled, blocked per pattern -> the same with `template`, the merged path of each pattern."""
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    nodes = patterns.select("host", "segs", "n", "labelled", "blocked", F.posexplode(F.concat(F.col("segs"), F.array(F.lit("")))).alias("depth", "seg"))
    nodes = nodes.withColumn("parent", F.array_join(F.slice("segs", 1, F.col("depth")), "/")).withColumn("below", F.coalesce(F.get("segs", F.col("depth") + 1), F.lit("")))
    # one row per branch
    branch = nodes.groupBy("host", "parent", "seg").agg(*sums, F.min("below").alias("low"), F.max("below").alias("high"))
    family = branch.groupBy("host", "parent").agg(F.count("*").alias("wide"), F.sum("n").alias("pages"))
    variable = (F.col("wide") >= WIDE) & (F.col("pages") < THIN * F.col("wide"))
    # branches of one shape against their siblings together
    shape = branch.groupBy("host", "parent", "low", "high").agg(F.count("*").alias("like"), F.sum("labelled").alias("sl"), F.sum("blocked").alias("sb"))
    rate = F.col("sb") / F.greatest(F.col("sl"), F.lit(1))
    off = F.abs(F.col("blocked") / F.greatest(F.col("labelled"), F.lit(1)) - rate)
    same = (F.col("labelled") == 0) | (off <= Z * F.sqrt(rate * (1 - rate) / F.greatest(F.col("labelled"), F.lit(1))))
    # an unlabelled branch joins the others of its shape only if these agree among themselves
    told = branch.join(family, ["host", "parent"]).join(shape, ["host", "parent", "low", "high"])
    told = told.withColumn("same", same)
    agree = told.groupBy("host", "parent", "low", "high").agg(F.min(F.col("same").cast("int")).alias("agree"))
    told = told.join(agree, ["host", "parent", "low", "high"])
    group = F.when(F.col("labelled") > 0, F.lit("(like)")).otherwise(F.when(F.col("agree") == 1, F.lit("(like)")).otherwise(F.lit("(new)")))
    name = F.when(variable, F.lit("*")).when((F.col("like") > 1) & F.col("same") & (F.col("seg") != ""), group).otherwise(F.col("seg"))
    named = told.select("host", "parent", "seg", name.alias("name"))
    path = nodes.join(named, ["host", "parent", "seg"]).groupBy("host", "segs").agg(F.array_sort(F.collect_list(F.struct("depth", "name"))).alias("p"))
    path = path.select("host", "segs", F.concat(F.lit("/"), F.array_join(F.col("p.name"), "/")).alias("template"))
    return patterns.join(path, ["host", "segs"])


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "told": verdict, "segs": pattern(F.col("path"))})
    patterns = rows.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("told").alias("labelled"), F.count(F.when(F.col("told") == "block", 1)).alias("blocked"))
    made = templates(patterns)
    label = [F.sum("labelled").alias("l"), F.sum("blocked").alias("b")]
    total = patterns.agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")).first()  # one row of two sums
    everywhere = F.lit(((total.b or 0) + 0.5) / ((total.l or 0) + 1.0))
    smooth = lambda up: (F.col("b") + F.lit(WEIGHT) * up) / (F.col("l") + F.lit(WEIGHT))
    hosts = patterns.groupBy("host").agg(*label).select("host", smooth(everywhere).alias("host_rate"))
    pure = made.groupBy("host", "template").agg(*label).join(hosts, "host").select("host", "template", smooth(F.col("host_rate")).alias("purity"))
    known = made.select("host", "segs", "template").join(pure, ["host", "template"])
    out = rows.join(known, ["host", "segs"], "left")
    own = F.when(F.col("purity") >= PURE, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("told", own).alias("verdict"), "template", "purity")
