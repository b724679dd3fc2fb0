"""URL filters: host and path rules, and a path-template tree judged by labelled purity.

Rules decide the urls that they fit (the longest one wins); these are also the labelled urls. For
all others the method decides: per host a tree of path segments is grown level by level, until no node
has children left.

- Variable segments: where a node has many different children for its pages, those without a
  share of KEEP_SHARE become the wildcard `*`.
- Similar branches: of the other children, those with evidence (LEAST pages) are compared, largest
  first, with the leaders before them. A child joins the first leader to which a two-proportion
  test finds it equivalent: with confidence, no share differs by MARGIN or more. Shares are those of
  pages with number-like tails, of pages that go on below the child, and of pages that rules block
  and allow. Merged children are one branch, `(a|b)`; without evidence nothing is merged.
- Purity: a template's labelled pages give (blocked + SMOOTH / 2) / (labelled + SMOOTH). A template
  is rejected if that is at least PURITY: some ten labelled pages, nearly all of them blocked.

DataFrame and SQL functions only; no page text is read.

Scale: pages are reduced to counts per (host, node, segment) before each level's shuffle. Nodes with
more than 1/HOT_SHARE of all children meet them by broadcast (there are fewer than HOT_SHARE); a
node's compared children are at most 1 / KEEP_SHARE or VARIETY. The way
back to pages is an equi-join on a written table, which adaptive execution splits where a host or
segment is hot. Levels are not as many as segments: where no evidence can come up below a node, its pages take the
rest of their paths at once (all go on alike, or are parts of one path, or are fewer than
VARIETY: too few for a wildcard, and so for a merge), and pages that go one way until they end or part
take that way at once. So levels end where paths stop branching, and a level only moves the pages that go on.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is
allowed; equal page_ids are judged row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

#: Fixed values: (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
VARIETY = 8
KEEP_SHARE = 0.05
LEAST = 30
MARGIN = 0.2
Z = 1.96
SMOOTH = 5.0
PURITY = 0.8
HOT_SHARE = 1000


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The fitting rule as text and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # the longest is asked first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


#: By child: pages, and those with number-like tails, going on, blocked, allowed.
COUNTS = ("n", "tails", "deeper", "blocked", "allowed")


def _equivalent(x: str, y: str) -> str:
    """SQL: whether all shares of two children differ by less than MARGIN, with confidence."""
    told = []
    for c in COUNTS[1:]:
        p, q = (f"(({v}.{c} + 2D) / ({v}.n + 4D))" for v in (x, y))
        told.append(f"abs({p} - {q}) + {Z}D * sqrt({p} * (1 - {p}) / ({x}.n + 4D) + {q} * (1 - {q}) / ({y}.n + 4D)) < {MARGIN}D")
    return "(" + " AND ".join(told) + ")"


def _branches(kids: DataFrame) -> DataFrame:
    """(host, node, seg, step): children that are merged. kids: a bounded number by node."""
    fields = ", ".join(f"{c}: bigint" for c in COUNTS)
    same = ", ".join(f"l.{c} AS {c}" for c in COUNTS)
    led = kids.groupBy("host", "node").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "seg", *COUNTS))).alias("kids"))
    led = led.withColumn("led", F.expr(f"""aggregate(kids, cast(array() as array<struct<{fields}, segs: array<string>>>),
      (acc, x) -> IF(exists(acc, l -> {_equivalent("l", "x")}),
        transform(acc, (l, i) -> IF(i = array_position(transform(acc, m -> {_equivalent("m", "x")}), true) - 1, struct({same}, array_append(l.segs, x.seg) AS segs), l)),
        array_append(acc, struct({", ".join(f"x.{c} AS {c}" for c in COUNTS)}, array(x.seg) AS segs))))"""))
    groups = led.select("host", "node", F.explode("led.segs").alias("segs")).filter(F.size("segs") > 1)
    return groups.select("host", "node", F.concat(F.lit("("), F.array_join(F.sort_array("segs"), "|"), F.lit(")")).alias("step"), F.explode("segs").alias("seg"))


def _equal(a: Column, b: Column) -> Column:
    """How many leading segments are equal."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("going"))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), start, lambda s, x: F.struct((s["n"] + F.when(s["going"] & x, 1).otherwise(0)).alias("n"), (s["going"] & x).alias("going")), lambda s: s["n"])


def templates(pages: DataFrame) -> DataFrame:
    """pages (host, path, ruled, ...) with their template."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = pages.withColumn("segs", segments)
    # how a path ends: a number, with or without an extension
    rows = rows.withColumn("numeric", F.coalesce(F.element_at(F.when(F.size("segs") > 0, F.col("segs")), -1).rlike(r"^[0-9]+(\.[a-z]+)?$"), F.lit(False)).cast("int"))
    # along: segments below the node that the path shares with one path of the node before, null if it is part of that
    rows = materialise(rows.withColumn("node", F.lit("")).withColumn("along", F.lit(0)), "url-level")
    done = [rows.filter(F.size("segs") == 0)]
    left = rows.filter(F.size("segs") > 0)
    while not left.isEmpty():
        # segs: what of a path is left below its node
        told = left.withColumn("seg", F.get("segs", F.lit(0))).withColumn("rest", F.array_join("segs", "/"))
        shares = [F.count(F.lit(1)).alias("n"), F.sum("numeric").alias("tails"), F.count_if(F.size("segs") > 1).alias("deeper"), F.count_if(F.col("ruled") == "block").alias("blocked"), F.count_if(F.col("ruled") == "allow").alias("allowed")]
        children = materialise(told.groupBy("host", "node", "seg").agg(*shares, F.min("rest").alias("low"), F.max("rest").alias("high"), F.min("along").alias("along")), "url-children")
        nodes = children.groupBy("host", "node").agg(F.count(F.lit(1)).alias("variety"), F.sum("n").alias("all_n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("along").alias("along"))
        alone = (F.col("low") == F.col("high")) | F.col("along").isNull() | (F.col("all_n") < VARIETY)
        nodes = materialise(nodes.select("host", "node", "variety", "all_n", alone.alias("alone"), F.greatest(F.lit(1), "along", F.least(_equal(F.split("low", "/"), F.split("high", "/")), F.size(F.split("low", "/")) - 1, F.size(F.split("high", "/")) - 1)).alias("jump"), F.col("high").alias("trunk")), "url-nodes")
        hot = nodes.filter(F.col("variety") * HOT_SHARE > children.count())  # fewer than HOT_SHARE rows
        children = children.drop("low", "high", "along")
        met = children.join(F.broadcast(hot), ["host", "node"], "left")
        rest = met.filter(F.col("variety").isNull()).select(children.columns).join(nodes, ["host", "node"])
        met = met.filter(F.col("variety").isNotNull()).unionByName(rest)
        wild = (F.col("variety") >= VARIETY) & (F.col("n") < F.col("all_n") * KEEP_SHARE)
        met = materialise(met.select("host", "node", "seg", *COUNTS, "alone", "jump", "trunk", wild.alias("wild")), "url-met")
        merged = _branches(met.filter(~F.col("wild") & (F.col("n") >= LEAST)).select("host", "node", "seg", *COUNTS))
        steps = met.filter("wild").select("host", "node", "seg", "alone", "jump", "trunk", F.lit("*").alias("step")).unionByName(
            met.filter(~F.col("wild")).join(merged, ["host", "node", "seg"], "left").select("host", "node", "seg", "alone", "jump", "trunk", F.coalesce("step", "seg").alias("step")))
        told = told.join(materialise(steps, "url-steps"), ["host", "node", "seg"])
        ahead = F.when(F.col("alone"), F.col("rest")).when(F.col("jump") > 1, F.array_join(F.slice("segs", F.lit(1), F.col("jump")), "/")).otherwise(F.col("step"))
        told = told.withColumn("node", F.concat("node", F.lit("/"), ahead))
        part = F.startswith(F.concat("trunk", F.lit("/")), F.concat("rest", F.lit("/")))
        told = told.withColumn("along", F.when(~part, _equal(F.col("segs"), F.split("trunk", "/")) - F.col("jump")))
        told = told.withColumn("segs", F.when(F.col("alone"), F.slice("segs", 1, 0)).otherwise(F.slice("segs", F.col("jump") + 1, F.size("segs"))))
        rows = materialise(told.select(rows.columns), "url-level")
        done.append(rows.filter(F.size("segs") == 0))
        left = rows.filter(F.size("segs") > 0)
    return reduce(DataFrame.unionByName, done).drop("segs", "numeric", "along").withColumnRenamed("node", "template")


def judged_templates(rows: DataFrame) -> DataFrame:
    """(host, template, pages, labelled, blocked, purity, rejected). rows: host, template, ruled."""
    counts = [F.count(F.lit(1)).alias("pages"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked")]
    purity = (F.col("blocked") + F.lit(SMOOTH / 2)) / (F.col("labelled") + F.lit(SMOOTH))
    return rows.groupBy("host", "template").agg(*counts).withColumn("purity", purity).withColumn("rejected", F.col("purity") >= PURITY)


def url_filter(pages: DataFrame, url: str = "url", key: str = "page_id", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template: one row per page."""
    host, path = host_and_path(url)
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = materialise(templates(rows.select("*", rule.alias("rule"), verdict.alias("ruled"))), "url-pages")
    rejected = materialise(judged_templates(rows).filter("rejected").select("host", "template", F.lit(True).alias("rejected")), "url-rejected")
    out = rows.join(rejected, ["host", "template"], "left")
    method = F.when(F.col("rejected") & (F.col("host") != ""), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
