"""State of publication jobs from their log, and the control tables around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.tables import staged


def current(log: DataFrame, key: str, *order: str) -> DataFrame:
    """State of each job: its last entry in the log (partial aggregation; no sort)."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s"), F.count("*").alias("n_entries")).select(key, "s.*", "n_entries")


def eligible(now: Column) -> Column:
    """Queued, or failed and due again, or running under a lease that has ended (status, retry_at, lease_until)."""
    return (F.col("status") == "queued") | ((F.col("status") == "failed") & (F.col("retry_at") <= now)) | ((F.col("status") == "running") & (F.col("lease_until") < now))


def next_claims(jobs: DataFrame, now: Column, n: int, excluded: list[int] = ()) -> DataFrame:
    """The first n eligible jobs by next attempt, then id, excluded ones left out."""
    rows = jobs.where(eligible(now))
    rows = rows.where(~F.col("job_id").isin(*excluded)) if excluded else rows
    return rows.orderBy(F.col("retry_at").asc_nulls_first(), "job_id").limit(n)


def sequenced(rows: DataFrame, *order: str, buckets: int = 64) -> DataFrame:
    """`sequence`, the row number over the whole table in the given order: the rows of a range of the first column are
    numbered in parallel and shifted by the number of rows before their range."""
    dealt = rows.repartitionByRange(buckets, *order).withColumn("_part", F.spark_partition_id())
    dealt = staged(dealt, "sequenced")
    before = dealt.groupBy("_part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(before.select("_part", "before"), "_part").withColumn("sequence", F.col("_own") + F.col("before")).drop("_own", "_part", "before")


def allocated(current_max: DataFrame, value: str) -> DataFrame:
    """The next number of a series: one more than its largest, or one."""
    return current_max.agg((F.coalesce(F.max(value), F.lit(0)) + 1).alias("next_value"))


def source_state(publications: DataFrame) -> DataFrame:
    """source_id, number of datasets, of active publications, their rows, and the state that follows."""
    active = F.col("status") == "active"
    out = publications.groupBy("source_id").agg(F.count_distinct("dataset_id").alias("n_datasets"), F.count_if(active).alias("n_active"), F.coalesce(F.sum(F.when(active, F.col("row_count"))), F.lit(0)).alias("n_rows"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    state = F.when(F.col("n_active") == F.col("n_datasets"), "published").when(F.col("n_failed") > 0, "failed").when(F.col("n_active") > 0, "importing").otherwise("confirmed")
    return out.withColumn("state", state)


def published_sources(datasets: DataFrame, publications: DataFrame) -> DataFrame:
    """source_id, n_active and n_rows: the active publications (dataset_id, schema_version, status, row_count) of the
    versions of datasets (dataset_id, schema_version, source_id) that there are; sources without any have zeros."""
    active = publications.where("status = 'active'").groupBy("dataset_id", "schema_version").agg(F.count("*").alias("n"), F.sum("row_count").alias("rows"))
    both = datasets.join(active, ["dataset_id", "schema_version"], "left")
    return both.groupBy("source_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_active"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"))


def listed(header: DataFrame, parts: DataFrame, key: str, order: str, name: str = "parts") -> DataFrame:
    """header with an array of the rows of parts that have its key, in order (equal places by the other columns); an
    empty one where there are none. Parts without a header are left out."""
    rest = [order, *[c for c in parts.columns if c not in (key, order)]]
    # partly collected before the shuffle; a list is as long as its key's parts
    lists = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
    out = header.join(lists, key, "left")
    return out.withColumn(name, F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.array().cast(out.schema[name].dataType)))


def catalog(datasets: DataFrame, publications: DataFrame) -> DataFrame:
    """One row for each dataset: the version of its active publication, else the latest confirmed one; a dataset with
    several active publications has none."""
    newest = datasets.groupBy("dataset_id").agg(F.max("version").alias("latest"), F.max_by("source_id", "version").alias("source_id"))
    active = publications.where("status = 'active'").groupBy("dataset_id").agg(F.count("*").alias("n"), F.max("version").alias("version"), F.max("row_count").alias("row_count"))
    one = F.col("n") == 1
    out = newest.join(active, "dataset_id", "left")
    return out.select("dataset_id", "source_id", F.coalesce(F.when(one, F.col("version")), F.col("latest")).alias("version"), F.coalesce(one, F.lit(False)).alias("published"), F.when(one, F.col("row_count")).alias("row_count"))


def upserted(rows: DataFrame, changes: DataFrame, key: str, gone: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """The next snapshot of a control table: changes replace rows of their key or are added; keys in gone are left out.
    Of several changes of a key the last in `order` stays (without it, and among equal places, the largest row)."""
    row = F.struct(*[c for c in rows.columns if c != key])
    changes = changes.groupBy(key).agg(F.max(F.struct(*([F.col(order).alias("_at")] if order else []), row.alias("r"))).alias("m")).select(key, "m.r.*")
    kept = rows.join(changes.select(key), key, "left_anti").select(*rows.columns).unionByName(changes.select(*rows.columns))
    return kept if gone is None else kept.join(gone.select(key), key, "left_anti").select(*rows.columns)


def put_first(rows: DataFrame, new: DataFrame, order: str = "sort_order") -> DataFrame:
    """rows after new ones were put before them, one after the other in the order of `order`: the last one is first, and
    all others move down by as many as there are new ones."""
    n, kind = new.count(), rows.schema[order].dataType
    moved = rows.withColumn(order, (F.col(order) + n).cast(kind))
    numbered = sequenced(new, order).withColumn(order, (F.lit(n) - F.col("sequence")).cast(kind))
    return moved.unionByName(numbered.select(*rows.columns))


def merged_batches(known: DataFrame, incoming: DataFrame, key: str = "batch_id", done: tuple[str, ...] = ("completed", "failed")) -> DataFrame:
    """One row for each batch of either side (key, status, progress): the incoming one, but a known one that has ended,
    or is further, is kept against one that has not ended."""
    both = known.select(F.struct(*known.columns).alias("k"), F.col(key)).join(incoming.select(F.struct(*known.columns).alias("i"), F.col(key)), key, "full")
    ended = lambda x: F.col(f"{x}.status").isin(*done)
    keep = F.col("i").isNull() | (F.col("k").isNotNull() & ~ended("i") & (ended("k") | (F.col("k.progress") > F.col("i.progress"))))
    return both.select(F.when(keep, F.col("k")).otherwise(F.col("i")).alias("b")).select("b.*")


def progress(runs: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Counters of each batch of runs (status, false_positive): completed, passed, failed and false positives."""
    passed = F.col("status") == "passed"
    return runs.groupBy(batch).agg(F.count("*").alias("completed_count"), F.count_if(passed).alias("passed_count"), F.count_if(~passed).alias("failed_count"), F.count_if("false_positive").alias("false_positive_count"))


def indexed(sources: DataFrame, label: str = "indexed") -> DataFrame:
    """The sources that may be searched."""
    return sources.where(F.col("status") == label)


def structured(kind: Column, name: Column, status: Column, labels: tuple[str, ...]) -> Column:
    """Whether a source is a table: by its type, its name's ending or its status."""
    k, n = F.lower(F.trim(kind)), F.lower(F.trim(name))
    return k.isin("xlsx", "csv", "表格") | n.endswith(".xlsx") | n.endswith(".csv") | status.isin(*labels)


def searched(rows: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows whose columns, one after the other, hold the query without regard to case; all where it is blank."""
    asked = query.strip().lower()
    return rows.where(F.lower(F.concat_ws(" ", *columns)).contains(asked)) if asked else rows
