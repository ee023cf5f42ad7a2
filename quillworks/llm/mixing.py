"""Mixing sources to target weights by a time-varying curriculum.

Each source takes a share of all words: its weight's part of the total, at most `most` times its own size, the excess
reshared by weight. A source's schedule over training time t in [0, 1] is w(t) = target * (1 + slope * (2 t - 1));
its integral over [0, 1] is the target. Documents of a source stand in a fixed hash order, lap after lap, up to `most`
laps; the words of the source before a copy's start are its demand D (those of the laps before included), and the
position is the t at which the integral of w reaches D: target * (t + slope * (t^2 - t)) = D. So every copy has its own
position, a lap apart from the others. Sources with high weights come late (slope > 0), those with low ones early.
Copies are range-sorted by position. DataFrame functions only.

Words in front of a document are summed in two steps, so a source with a third of all rows is no single task's work:
within (source, bucket of the hash), and over the buckets.

Defined results: a null text has size 0, takes 0 and has no position; a null source is a source of its own, after all
others; rows that share an id count each for itself (wholly equal rows are interchangeable); rows without an id are
ordered by their text; an empty table gives an empty result; extra columns are ignored by mix_documents and passed on by
mixed_documents; if all sizes are 0 every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillworks.llm import common

#: Weights of the sources in order of their names, repeating, and the slopes of their schedules.
WEIGHTS = (1, 2, 3)
SLOPES = (-0.6, 0.0, 0.6)
MOST = 3
BUCKETS = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: mix_source, source_size, weight_no, target.

    Sources sorted by (most * size / weight) reach their bound in that order, so the share per weight is found from
    running sums: with the first k bounded, (total - their bounds) / (weights of the others). One row per source:
    this is the only window that sees all sources at once.
    """
    rows = sizes.groupBy("mix_source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("mix_source").asc_nulls_last())
    rows = rows.withColumn("weight_no", (F.row_number().over(named) - 1) % len(weights))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("weight_no") + 1))
    rows = rows.withColumn("bound", most * F.col("source_size"))
    order = Window.orderBy(F.col("bound") / F.col("weight"), F.col("mix_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumns({
        "bound_before": F.coalesce(F.sum("bound").over(before), F.lit(0)),
        "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "total": F.sum("source_size").over(everything),
    })
    per_weight = (F.col("total") - F.col("bound_before")) / F.col("weight_left")
    rows = rows.withColumn("level", F.when(per_weight <= F.col("bound") / F.col("weight"), per_weight))
    level = F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("share", level)
    target = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.least(F.col("bound").cast("double"), F.col("share") * F.col("weight")))
    return rows.select("mix_source", "source_size", "weight_no", target.alias("target"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """mix_id, mix_source, size (words), mix_key (hash order of the ids), mix_hash (of the whole row but its maps)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.xxhash64(text).cast("string")).cast("binary"))
    size = F.size(F.array_remove(F.split(text, common.SPACE_CLASS), "")).cast("long")
    names = F.col(id_col).alias("mix_id"), F.col(source_col).alias("mix_source")
    return docs.select(*names, size.alias("size"), key.alias("mix_key"), common.row_hash(docs).alias("mix_hash"))


def position_at(demand: Column, target: Column, slope: Column) -> Column:
    """The time at which a schedule's integral reaches `demand`: the root in [0, 1] of slope t^2 + (1 - slope) t = u."""
    u = demand / target
    b = 1 - slope
    return F.when(slope == 0, u).otherwise((F.sqrt(b * b + 4 * slope * u) - b) / (2 * slope))


def planned(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """Adds to sized() rows: source_size, target, mix_start (words of the source before the row), taken, and mix_laps,
    an array of {lap_taken, position} for each copy."""
    same = lambda a, b: a.eqNullSafe(b)
    rows = rows.withColumn("mix_bucket", (F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int"))
    targets = source_targets(rows, weights, most)
    sums = rows.groupBy("mix_source", "mix_bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
    t = targets.withColumnRenamed("mix_source", "target_source")
    sums = sums.join(t, same(sums.mix_source, t.target_source)).select(F.col("mix_source").alias("s_source"), F.col("mix_bucket").alias("s_bucket"), "bucket_start", "source_size", "weight_no", "target")
    rows = rows.join(sums, same(rows.mix_source, sums.s_source) & (rows.mix_bucket == sums.s_bucket)).drop("s_source", "s_bucket")
    within = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_key", "mix_id", "size", "mix_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("mix_start", F.col("bucket_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    goal = F.floor(F.col("target") + 0.5)
    slope = F.element_at(F.array(*map(F.lit, slopes)), F.col("weight_no") + 1)
    rows = rows.withColumn("slope", slope)
    laps = []
    for lap in range(most):
        demand = F.col("mix_start") + lap * F.col("source_size")
        lap_taken = F.greatest(F.lit(0), F.least(F.col("size"), goal - demand)).cast("long")
        laps.append(F.struct(lap_taken.alias("lap_taken"), position_at(demand, F.col("target"), F.col("slope")).alias("position")))
    rows = rows.withColumn("mix_laps", F.filter(F.array(*laps), lambda x: x["lap_taken"] > 0))
    return rows.withColumn("taken", F.aggregate("mix_laps", F.lit(0).cast("long"), lambda n, x: n + x["lap_taken"]))


def range_sorted(rows: DataFrame) -> DataFrame:
    """Rows in order of position over the partitions; rows without one follow, spread by their hash."""
    last = 1 + F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("double") / (1 << 32)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("mix_order", F.coalesce(F.col("position"), last))
    return rows.repartitionByRange(parts, "mix_order", "mix_key").sortWithinPartitions("mix_order", "mix_key")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, most: int = MOST) -> DataFrame:
    """One row per document, in order of its first copy: id, size, source_size, target, taken, copies, and the positions
    of the first and the last copy.

    `taken` sums to the rounded target in every source; the last copy of a source may be taken in part.
    """
    sizes = common.materialize(sized(docs, id_col, text_col, source_col), "sizes")
    rows = planned(sizes, weights, slopes, most)
    rows = rows.withColumns({"copies": F.size("mix_laps").cast("long"), "position": F.get("mix_laps", 0)["position"]})
    rows = rows.withColumn("last_position", F.get("mix_laps", (F.col("copies") - 1).cast("int"))["position"])
    return range_sorted(rows).select(F.col("mix_id").alias(id_col), "size", "source_size", "target", "taken", "copies", "position", "last_position")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, most: int = MOST) -> DataFrame:
    """The documents, with all their columns, as the mix takes them: left out, once, or repeated, each copy at its position.

    A document is taken whole: a source's last copy counts if half of it or more lies within the target.
    The plan is made from ids and sizes alone and joined to the documents; the texts move for that join and for the sort.
    """
    sizes = common.materialize(sized(docs, id_col, text_col, source_col), "sizes")
    plan = planned(sizes, weights, slopes, most).select("mix_id", "mix_hash", "mix_key", "size", F.explode("mix_laps").alias("lap"))
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    plan = plan.where(2 * F.col("lap.lap_taken") >= F.col("size")).select(name(F.col("mix_id")).alias("mix_name"), "mix_hash", "mix_key", "lap.position")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("mix_row")
    whole = docs.select(row, name(F.col(id_col)).alias("mix_name"), common.row_hash(docs).alias("mix_hash"))
    # of wholly equal rows one stands for all: the plan has a row for each copy of each of them; dealt as the join deals
    turn = F.row_number().over(Window.partitionBy("mix_name", "mix_hash").orderBy("mix_hash"))
    copies = whole.withColumn("mix_turn", turn).where("mix_turn = 1").join(plan, ["mix_name", "mix_hash"])
    return range_sorted(copies.select("mix_row", "position", "mix_key")).select("mix_row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(common.table(spark, sf_dir, "documents"))


def op7_sql() -> str:
    slopes = " ".join(f"WHEN {k} THEN {s}" for k, s in enumerate(SLOPES))
    weights = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(WEIGHTS))
    lap = lambda k: f"greatest(0, least(size, CAST(floor(target + 0.5) AS BIGINT) - {k} * source_size - start))"
    laps = " + ".join(map(lap, range(MOST)))
    copies = " + ".join(f"CAST({lap(k)} > 0 AS INT)" for k in range(MOST))
    at = lambda u: f"CASE WHEN slope = 0 THEN {u} ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * ({u})) - (1 - slope)) / (2 * slope) END"
    return f"""
WITH sized AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS size,
    md5(CAST(doc_id AS VARCHAR)) AS key FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS no FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE no {weights} END AS weight, {MOST} * source_size AS bound FROM sources
), running AS (
  SELECT *, CAST(coalesce(sum(bound) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS before,
    CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS left_w, CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM weighed WINDOW o AS (ORDER BY bound / weight, source NULLS LAST)
), level AS (
  SELECT min_by((total - before) / left_w, bound / weight) AS share FROM running WHERE (total - before) / left_w <= bound / weight
), targets AS (
  SELECT source, source_size, no, CASE WHEN total = 0 THEN 0.0 ELSE least(CAST(bound AS DOUBLE), share * weight) END AS target FROM running, level
), started AS (
  SELECT s.doc_id, s.size, t.source_size, t.no, CAST(t.target AS DOUBLE) AS target,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), took AS (
  SELECT *, CAST({laps} AS BIGINT) AS taken, CAST({copies} AS BIGINT) AS copies, CAST(CASE no {slopes} END AS DOUBLE) AS slope FROM started
)
SELECT doc_id, size, source_size, target, taken, copies, CASE WHEN taken > 0 THEN {at("start / target")} END AS position,
  CASE WHEN taken > 0 THEN {at("(start + (copies - 1) * source_size) / target")} END AS last_position
FROM took
"""
