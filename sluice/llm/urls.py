"""URL filter: rules on hosts and paths, and a path-template tree for urls that no rule fits.

Urls that a rule decides are the labels. For each host the segments of paths form a tree: segments of digits or long
hexadecimal numbers become classes at once; where a node has many different children they become one wildcard;
siblings that are statistically similar are merged: those whose urls go on alike (shares of the kinds of the next segment) and whose
labelled urls, if there are any, are blocked as often as those of all siblings, by tests of proportions. A branch without labels so
shares the template of the branches that look like it, and what is told of them is told of it.

A template is rejected if its share of blocked urls among labelled ones, smoothed, is high. It is smoothed towards
the share in the rest of its parent, that towards the rest of the grandparent, and so on up to the host and a prior, so that no
label counts twice. Hosts without labels keep the prior and are allowed.

Rows are reduced to distinct paths with counts before any step of the tree, each level is one pre-aggregated shuffle by
node and child, shapes that end or are alone in their node leave the loop, and joins go by `spread_join`, so that a host, node or path with a third of all
rows costs no task more than others. Defined results: a null url, or one without `://`, has empty host and path, fits no
rule and belongs to the template of the empty host. Paths of any depth are read whole. Repeated rows give a row each; empty tables give
empty ones. Only key and url are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm._common import discard, materialise, spread_join


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    block: bool

    @property
    def name(self) -> str:
        return self.host + self.path


#: A node with more children than this, of which a child has fewer than FEW urls on average, has a wildcard for a child.
MOST_CHILDREN, FEW = 20, 5.0
#: Two-sided 1 % of the normal distribution: children that differ from their siblings by more stay apart.
DIFFERENCE = 2.58
#: Urls that what a template is smoothed towards counts for, the prior of a host, and the share from which a template is rejected.
PRIOR_WEIGHT, PRIOR, REJECT_FROM = 4.0, 0.3, 0.7
#: Kinds of the segment that follows: the url ends, a number, a word.
KINDS = ("ends", "number", "word")


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def parsed(pages: DataFrame, key: str, url: str) -> DataFrame:
    """key, host and path of each row."""
    rows = pages.select(F.col(key).alias("_key"), F.coalesce(F.col(url), F.lit("")).alias("_url"))
    return rows.select("_key", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))


def rule_of(rules: list[Rule]) -> Column:
    """Name of the longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        found = F.when(fits, r.name).otherwise(found)
    return found


def segments(path: Column) -> Column:
    """Segments with classes for numbers."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    kind = lambda s: F.regexp_replace(F.regexp_replace(s, "^[0-9]+(?=$|\\.)", "{n}"), "^(?=[0-9a-f]*[0-9])[0-9a-f]{8,}(?=$|\\.)", "{h}")
    return F.transform(parts, kind)


def _branches(shapes: DataFrame) -> DataFrame:
    """Shapes moved down from their node to where its shapes part, as no step before that has a sibling: to the end of a
    shape that is alone."""
    rest = F.slice("segs", F.col("at") + 1, F.size("segs") - F.col("at"))
    nodes = shapes.groupBy("host", "tmpl").agg(F.count("*").alias("rows"), F.min(rest).alias("lo"), F.max(rest).alias("hi"))
    apart = F.array_position(F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y)), False)
    nodes = nodes.select("host", "tmpl", "rows", F.when(apart == 0, F.size("lo")).otherwise(apart - 1).cast("int").alias("on"))
    met = spread_join(shapes, nodes, ["host", "tmpl"], "rows", shapes.count())
    way = F.transform(F.slice("segs", F.col("at") + 1, F.col("on")), lambda s: F.concat(F.lit("/"), s))
    return materialise(met.withColumn("tmpl", F.concat("tmpl", F.array_join(way, ""))).withColumn("at", F.col("at") + F.col("on")).drop("on"), "url-branches")


def _grown(shapes: DataFrame) -> DataFrame:
    """Shapes that go on from their node, moved to its child. A shape has, besides its counts, the node (tmpl), the
    segments passed (at), the node's labelled and blocked urls (all_l, all_b) and the share that the node is smoothed towards (up)."""
    follows = F.when(F.size("segs") == F.col("at") + 1, 0).when(F.get("segs", F.col("at") + 1).startswith("{"), 1).otherwise(2)
    now = shapes.withColumn("seg", F.get("segs", F.col("at"))).withColumn("follows", follows)
    same = ("all_l", "all_b", "up")
    kinds = [F.sum(F.when(F.col("follows") == i, F.col("n")).otherwise(0)).alias(k) for i, k in enumerate(KINDS)]
    counts = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    children = materialise(now.groupBy("host", "tmpl", "seg").agg(*counts, *kinds, *[F.min(c).alias(c) for c in same], F.count("*").alias("shapes")), "url-children")
    totals = [F.sum(c).alias(f"of_{c}") for c in ("n", "labelled", "blocked", *KINDS)]
    nodes = children.groupBy("host", "tmpl").agg(F.count("*").alias("kinds"), *totals)

    def differs(part: Column, of: Column, share: Column) -> Column:
        """Whether a part of a whole is further from a share than chance lets it be; of nothing it isn't."""
        return F.when(of > 0, F.abs(part - share * of) > DIFFERENCE * F.sqrt(share * (1 - share) * of)).otherwise(False)

    shape = F.lit(False)
    for k in KINDS:
        shape = shape | differs(F.col(k), F.col("n"), F.col(f"of_{k}") / F.col("of_n"))
    label = differs(F.col("blocked"), F.col("labelled"), F.col("of_blocked") / F.greatest("of_labelled", F.lit(1)))
    variable = (F.col("kinds") > MOST_CHILDREN) & (F.col("of_n") < FEW * F.col("kinds"))
    merged = F.when(variable | (F.col("kinds") > 1) & ~shape & ~label, F.lit("*")).otherwise(F.col("seg"))
    met = spread_join(children, nodes.withColumn("rows", F.col("kinds")), ["host", "tmpl"], "rows", children.count())
    met = materialise(met.select("host", "tmpl", "seg", "shapes", "labelled", "blocked", *same, merged.alias("step")), "url-steps")
    ways = met.groupBy("host", "tmpl", "step").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), *[F.min(c).alias(c) for c in same], F.count("*").alias("rows"))
    # the rest of the parent, and what the parent itself is smoothed towards
    up = (F.col("all_b") - F.col("b") + PRIOR_WEIGHT * F.col("up")) / (F.col("all_l") - F.col("l") + PRIOR_WEIGHT)
    ways = ways.select("host", "tmpl", "step", "rows", F.col("l").alias("all_l"), F.col("b").alias("all_b"), up.alias("up"))
    moved = spread_join(met.select("host", "tmpl", "seg", "step", "shapes"), ways, ["host", "tmpl", "step"], "rows", children.count())
    kept = now.select("host", "segs", "n", "labelled", "blocked", "tmpl", "seg", (F.col("at") + 1).alias("at"))
    out = spread_join(kept, moved.withColumnRenamed("shapes", "rows"), ["host", "tmpl", "seg"], "rows", shapes.count())
    out = materialise(out.withColumn("tmpl", F.concat("tmpl", F.lit("/"), "step")).drop("seg", "step"), "url-shapes")
    discard(children)
    discard(met)
    return out


def templates(ruled: DataFrame, rules: list[Rule]) -> DataFrame:
    """host, path, template, purity, rejected, and rows (their number) of each distinct path of `ruled` (host, path, rule)."""
    blocking = [r.name for r in rules if r.block]
    blocked = F.coalesce(F.sum(F.col("rule").isin(blocking).cast("long")), F.lit(0))
    paths = ruled.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("rule").alias("labelled"), blocked.alias("blocked"))
    paths = materialise(paths.withColumn("segs", segments(F.col("path"))), "url-paths")
    shapes = paths.groupBy("host", "segs").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")], F.count("*").alias("paths"))
    shapes = materialise(shapes, "url-shapes")
    hosts = shapes.groupBy("host").agg(F.sum("labelled").alias("all_l"), F.sum("blocked").alias("all_b"), F.count("*").alias("rows"))
    hosts = hosts.select("host", "rows", "all_l", "all_b", F.lit(PRIOR).alias("up"), F.lit("").alias("tmpl"))
    placed = spread_join(shapes.drop("paths"), hosts, ["host"], "rows", shapes.count()).withColumn("at", F.lit(0))
    going, ended = materialise(placed, "url-shapes"), []
    while True:
        moved = _branches(going)
        discard(going)
        ended.append(moved.where(F.size("segs") == F.col("at")))
        going = moved.where(F.size("segs") > F.col("at"))
        if going.isEmpty():
            break
        going = _grown(going)
    done = ended[0]
    for more in ended[1:]:
        done = done.unionByName(more)
    purity = (F.col("all_b") + PRIOR_WEIGHT * F.col("up")) / (F.col("all_l") + PRIOR_WEIGHT)
    judged = done.select("host", "segs", F.col("tmpl").alias("template"), purity.alias("purity"))
    judged = judged.join(shapes.select("host", "segs", "paths"), ["host", "segs"])
    known = spread_join(paths.select("host", "path", "segs", F.col("n").alias("rows")), judged, ["host", "segs"], "paths", paths.count())
    return materialise(known.select("host", "path", "template", "purity", (F.col("purity") >= REJECT_FROM).alias("rejected"), "rows"), "url-templates")


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, template and purity of each row."""
    ruled = parsed(pages, key, url).withColumn("rule", rule_of(rules))
    known = templates(ruled, rules)
    found = spread_join(ruled, known, ["host", "path"], "rows", known.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    verdict = F.when(F.col("rule").isin([r.name for r in rules if r.block]) | F.col("rule").isNull() & F.col("rejected"), "block").otherwise("allow")
    return found.select(F.col("_key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


RULES = [Rule("com", "/", False), Rule("example.com", "/en/", True), Rule("www.example.com", "/en/", False), Rule("net", "/es/", True), Rule("net", "/fr/", True)]


def op5_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
