"""Other inputs and outputs (SRC, SNK): cached JSON answers, logs, rate tables, guarded SQL, renderers, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cached_answers(spark: SparkSession, folder: str, schema: str, today: str, negative_days: int = 30, refresh_older: int | None = None) -> DataFrame:
    """Answers that still hold: ``schema`` has fetched (date string) and found (boolean) beside the payload.

    Files that don't parse are misses, negative answers expire after ``negative_days``; ``refresh_older`` 0 forgets all,
    n those older than n days."""
    rows = spark.read.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).json(folder).cache()
    age = F.datediff(F.lit(today).cast("date"), F.to_date("fetched"))
    holds = F.col("found") | (age <= negative_days)
    fresh = F.lit(True) if refresh_older is None else (F.lit(False) if refresh_older == 0 else age <= refresh_older)
    return rows.where(F.col("_corrupt").isNull() & F.coalesce(holds & fresh, F.lit(False))).drop("_corrupt")


def log_counts(spark: SparkSession, folder: str, patterns: dict[str, str]) -> DataFrame:
    """file and, for each named pattern, how often its lines match and the distinct first groups."""
    lines = spark.read.text(folder).select(F.col("_metadata.file_path").alias("file"), "value")
    columns = []
    for name, pattern in patterns.items():
        hit = F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, 1))
        columns += [F.count(hit).alias(f"{name}_count"), F.array_sort(F.collect_set(hit)).alias(f"{name}_values")]
    return lines.groupBy("file").agg(*columns)


def last_version(collection: Column) -> Column:
    """The last entry of a non-empty collection, "NA" being null."""
    return F.when(F.size(collection) > 0, F.nullif(F.element_at(collection, -1), F.lit("NA")))


def first_present(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def resolve_first(candidates: list[DataFrame], key: str) -> DataFrame:
    """For each key its row in the first source that has one."""
    every = candidates[0].withColumn("_rank", F.lit(0))
    for rank, c in enumerate(candidates[1:], 1):
        every = every.unionByName(c.withColumn("_rank", F.lit(rank)))
    return every.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_rank"))).where("_r = 1").drop("_r", "_rank")


def read_only_sql(spark: SparkSession, statement: str) -> DataFrame:
    """Runs one query; anything that isn't one (commands, writes, several statements) is refused before it runs."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    names = {plan.getClass().getSimpleName()} | {plan.collectLeaves().apply(i).getClass().getSimpleName() for i in range(plan.collectLeaves().size())}
    allowed = ("Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "UnresolvedWith", "WithCTE", "Distinct", "Union", "Except", "Intersect", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "OrderedSubquery", "UnresolvedInlineTable", "UnresolvedRelation", "OneRowRelation", "UnresolvedTableValuedFunction", "SubqueryAlias", "Offset", "Join")
    refused = sorted(n for n in names if n not in allowed)
    if refused:
        raise PermissionError(f"only queries are run here, not {', '.join(refused)}")
    return spark.sql(statement)


def render(rows: DataFrame, as_json: bool = False) -> str:
    """A small result as tab-separated lines with a header, or as one JSON object a line."""
    if as_json:
        return "\n".join(rows.toJSON().collect())
    clean = lambda v: "" if v is None else str(v).replace("\t", " ").replace("\n", " ")
    return "\n".join(["\t".join(rows.columns), *("\t".join(map(clean, r)) for r in rows.collect())])


def audit_snapshot(report: DataFrame, folder: str, date: str) -> str:
    path = f"{folder.rstrip('/')}/audit-{date}"
    report.write.mode("overwrite").json(path)
    return path


def latest_audit(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", True).json(folder).withColumn("_d", F.regexp_extract("_metadata.file_path", r"/audit-([0-9-]+)/", 1))
    return rows.where(F.col("_d") == rows.agg(F.max("_d")).first()[0]).drop("_d")
