"""Reports, rollups and small relational operators around ingestion and experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Cells of equal width that a label's values are counted in.
BUCKETS = 4096
#: Values that may meet in one task to be ranked.
MEET = 10_000
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def ingestion_report(chunks: DataFrame) -> DataFrame:
    """One row of counters. chunks: topic_id, state (reused, embedded, cached), stale."""
    state = lambda s: F.count_if(F.col("state") == s)
    return chunks.agg(F.count_distinct("topic_id").alias("topics"), F.count(F.lit(1)).alias("chunks"), state("reused").alias("reused"), state("embedded").alias("embedded"), state("cached").alias("cache_hits"), (state("embedded") + state("cached")).alias("upserted"), F.count_if("stale").alias("stale"))


def batch_report(items: DataFrame, discovered: Column | None = None) -> DataFrame:
    """items: status, topics, chunks. One row: selected, completed, failed and sums of the completed."""
    done = F.col("status") == "completed"
    return items.agg((F.count(F.lit(1)) if discovered is None else F.max(discovered)).alias("discovered"), F.count(F.lit(1)).alias("selected"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum(F.when(done, F.col("topics"))), F.lit(0)).alias("topics"), F.coalesce(F.sum(F.when(done, F.col("chunks"))), F.lit(0)).alias("chunks"))


def manual_status(catalog: DataFrame, progress: DataFrame) -> DataFrame:
    """Every catalog entry with its last progress row's status; `discovered` without one.

    progress: catalog_id, ordinal, status.
    """
    last = progress.groupBy("catalog_id").agg(F.max_by("status", "ordinal").alias("status"))
    return catalog.join(last, "catalog_id", "left").withColumn("status", F.coalesce("status", F.lit("discovered")))


def request_counts(requests: DataFrame, *labels: str) -> DataFrame:
    return requests.groupBy(*labels).agg(F.count(F.lit(1)).alias("count"))


def latency_histogram(requests: DataFrame, value: str, *labels: str, bounds: tuple[float, ...] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative buckets: one row per label set and bound, with count and sum; infinity last."""
    edges = [*bounds, float("inf")]
    counts = requests.groupBy(*labels).agg(F.count(F.lit(1)).alias("count"), F.sum(value).alias("sum"), *(F.count_if(F.col(value) <= F.lit(b)).alias(f"_{i}") for i, b in enumerate(edges)))
    buckets = F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"_{i}").alias("bucket")) for i, b in enumerate(edges)))
    return counts.select(*labels, "count", "sum", F.explode(buckets).alias("b")).select(*labels, "b.le", "b.bucket", "count", "sum")


def latency_percentiles(requests: DataFrame, value: str, *labels: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles (linear between neighbours) by label, as p50, p95, ...; null values don't count.

    A percentile is met by rank. Each round cuts the interval that holds a rank into BUCKETS cells of
    equal width and counts them; the cell of the rank, from its smallest to its largest value, is the next
    interval. That ends when every interval holds at most MEET values, or equal ones: an outlier costs
    a round, as the interval after it ends at the values themselves. No more than MEET values of a label
    ever meet in one task.
    """
    by = [f"_l{i}" for i in range(len(labels) or 1)]
    keys = [F.col(c).alias(n) for n, c in zip(by, labels)] or [F.lit(0).alias(by[0])]
    rows = requests.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("v"))
    span = [F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("here")]
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(q) * (F.col("here") - 1)).alias("at")) for i, q in enumerate(shares))))
    state = rows.groupBy(*by).agg(*span).withColumn("w", wanted).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("w.at"), F.ceil("w.at")))))
    state = written(state.select(*by, "low", "high", "here", "w.i", "w.at", "rank", F.lit(0).cast("long").alias("ahead")), "ranks")
    open_ = (F.col("here") > MEET) & (F.col("low") < F.col("high"))
    while not state.filter(open_).isEmpty():
        cells = _within(rows, state.filter(open_), by).withColumn("cell", _cell()).groupBy(*by, "low", "high", "cell").agg(F.count(F.lit(1)).alias("held"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = Window.partitionBy(*by, "low", "high").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
        met = _joined(state.filter(open_), cells, by).filter((F.col("rank") >= F.col("ahead") + F.col("before")) & (F.col("rank") < F.col("ahead") + F.col("before") + F.col("held")))
        met = met.select(*by, F.col("lo").alias("low"), F.col("hi").alias("high"), F.col("held").alias("here"), "i", "at", "rank", (F.col("ahead") + F.col("before")).alias("ahead"))
        state = written(state.filter(~open_).unionByName(met), "ranks")
    values = _within(rows, state.filter("low < high"), by).groupBy(*by, "low", "high", "v").agg(F.count(F.lit(1)).alias("times"))
    values = values.withColumn("upto", F.sum("times").over(Window.partitionBy(*by, "low", "high").orderBy("v")))
    found = _joined(state.filter("low < high"), values, by).filter((F.col("ahead") + F.col("upto") > F.col("rank")) & (F.col("ahead") + F.col("upto") - F.col("times") <= F.col("rank")))
    told = found.select(*by, "i", "at", "rank", "v").unionByName(state.filter("low = high").select(*by, "i", "at", "rank", F.col("low").alias("v")))
    told = told.groupBy(*by, "i", "at").agg(F.min_by("v", "rank").alias("a"), F.max_by("v", "rank").alias("b"))
    told = told.withColumn("p", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))))
    out = told.groupBy(*by).agg(*(F.max(F.when(F.col("i") == i, F.col("p"))).alias(f"p{round(q * 100)}") for i, q in enumerate(shares)))
    return out.select(*(F.col(n).alias(c) for n, c in zip(by, labels)), *(f"p{round(q * 100)}" for q in shares))


def _cell() -> Column:
    """The cell of v between low and high, which may be infinite."""
    inside = F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BUCKETS)
    last = F.lit(BUCKETS - 1)
    cell = F.when(F.col("v") == F.col("low"), 0).when((F.col("v") == F.col("high")) | (F.col("low") == float("-inf")), last).otherwise(F.least(inside, last))
    return cell.cast("int")


def _within(rows: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """Rows with each interval that holds them."""
    spans = state.select(*(F.col(c).alias(f"s{c}") for c in by), "low", "high").distinct()
    same = [F.col(c).eqNullSafe(F.col(f"s{c}")) for c in by]
    return rows.join(spans, [*same, F.col("v").between(F.col("low"), F.col("high"))]).select(*by, "low", "high", "v")


def _joined(state: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    """Wanted ranks with the parts of their interval."""
    renamed = parts.select(*(F.col(c).alias(f"s{c}") for c in (*by, "low", "high")), *(c for c in parts.columns if c not in (*by, "low", "high")))
    return state.join(renamed, [F.col(c).eqNullSafe(F.col(f"s{c}")) for c in (*by, "low", "high")])


def suite_status(runs: DataFrame, suite: str = "suite_id") -> DataFrame:
    """planned if all are, completed if all are, failed if any is, else incomplete."""
    s = F.col("status")
    status = F.when(F.bool_and(s == "planned"), "planned").when(F.bool_and(s == "completed"), "completed").when(F.bool_or(s == "failed"), "failed").otherwise("incomplete")
    return runs.groupBy(suite).agg(status.alias("status"), F.count(F.lit(1)).alias("runs"))


def merged_timings(parts: dict[str, str], total: str = "total") -> Column:
    """Timing maps (column to prefix) merged under their prefixes; total: the sum of all that are no totals."""
    none = F.expr("cast(map() as map<string,double>)")

    def prefixed(column: str, prefix: str) -> Column:
        return F.transform_keys(F.coalesce(column, none), lambda k, v: F.concat(F.lit(prefix), k))

    maps = [prefixed(c, p) for c, p in parts.items()]
    merged = F.map_concat(*maps)
    plain = F.map_filter(merged, lambda k, v: ~F.endswith(k, F.lit(total)))
    return F.map_concat(plain, F.create_map(F.lit(total), F.aggregate(F.map_values(plain), F.lit(0.0), lambda a, x: a + x)))


def subset(cases: DataFrame, ids: list[str]) -> DataFrame:
    """The cases of an id list in its order; duplicate or missing ids raise."""
    if len(set(ids)) != len(ids):
        raise ValueError("duplicate case ids")
    wanted = cases.sparkSession.createDataFrame([(x, i) for i, x in enumerate(ids)], "case_id string, place int")
    missing = [r["case_id"] for r in wanted.join(cases.select(F.col("case_id").cast("string")), "case_id", "left_anti").limit(5).collect()]
    if missing:
        raise ValueError(f"unknown case ids: {', '.join(missing)}")
    return cases.withColumn("case_id", F.col("case_id").cast("string")).join(wanted, "case_id").orderBy("place")


def latest(rows: DataFrame, key: str, ordinal: str, good: Column) -> DataFrame:
    """The last good row per key (manifest semantics)."""
    held = F.struct(*rows.columns)
    return rows.filter(good & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max_by(held, ordinal).alias("_r")).select("_r.*")


def first_wins(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The first row per key: unlike dropDuplicates, by a defined order."""
    held = F.struct(*rows.columns)
    return rows.groupBy(F.col(key).alias("_k")).agg(F.min_by(held, ordinal).alias("_r")).select("_r.*")
