"""Reports, manifests and decision entries written by the cluster, one folder a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat_row(df: DataFrame) -> DataFrame:
    """``df`` as rows of a CSV file: arrays joined by ";", nulls empty."""
    arrays = {f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    return df.select(*(F.coalesce(F.array_join(c, ";") if c in arrays else F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns))


def summary(report: DataFrame, decision: str, extension: str, reasons: str, most: int = 30) -> DataFrame:
    """(part, name, decision, n) of a report: files in all, by decision, by extension and decision, and its ``most`` common reasons."""
    sets = report.groupingSets([[], [F.col(decision)], [F.col(extension), F.col(decision)]], F.col(extension), F.col(decision)).agg(
        F.count(F.lit(1)).alias("n"), F.grouping(extension).alias("_e"), F.grouping(decision).alias("_d")
    )
    part = F.when(F.col("_d") == 1, "total").when(F.col("_e") == 1, "decision").otherwise("extension")
    counts = sets.select(part.alias("part"), F.when(F.col("_e") == 0, F.col(extension)).alias("name"), F.col(decision).alias("decision"), "n")
    top = report.select(F.explode(reasons).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "name").limit(most)
    return counts.unionByName(top.select(F.lit("reason").alias("part"), "name", F.lit(None).cast("string").alias("decision"), "n"))


def write_report(report: DataFrame, folder: str, run: str, decision: str, extension: str, reasons: str) -> dict[str, str]:
    """Write a report as JSON lines, as CSV and with its summary; an earlier report of the same run is replaced. Returns the three folders."""
    out = {"jsonl": f"{folder}/filter_report_{run}.jsonl", "csv": f"{folder}/filter_report_{run}.csv", "summary": f"{folder}/filter_summary_{run}.json"}
    write_manifest(report, out["jsonl"])
    flat_row(report).write.mode("overwrite").option("header", True).csv(out["csv"])
    # the counts of a report are a small table whatever its size: extensions, decisions and the top reasons
    summary(report, decision, extension, reasons).coalesce(1).write.mode("overwrite").json(out["summary"])
    return out


def write_manifest(items: DataFrame, path: str) -> None:
    """JSON lines with every field, nulls too."""
    items.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def entry_tags(tags: Column, country: Column, keywords: Column) -> Column:
    """The tags of a decision entry: its own, its country in lower case, its source's keywords; each once, in this order."""
    none = F.array().cast("array<string>")
    where = F.when(F.trim(country) != "", F.trim(country)).otherwise("Unbekannt")
    more = F.transform(F.coalesce(keywords, none), F.lower)
    return F.array_distinct(F.concat(F.coalesce(tags, none), F.array(F.lower(where)), more))


def decision_entries(found: DataFrame, weights: dict[str, int]) -> DataFrame:
    """Rows of the decision store: country or "Unbekannt", tags with country and keywords, outcome or "unknown", weight of the instance (first word in the court's level and name)."""
    court = F.lower(F.concat_ws(" ", "court_level", "court"))
    weight = F.lit(0)
    for word, w in reversed(weights.items()):
        weight = F.when(F.contains(court, F.lit(word)), w).otherwise(weight)
    country = F.when(F.trim("country") != "", F.trim("country")).otherwise("Unbekannt")
    return found.withColumns({
        "tags": entry_tags(F.col("tags"), F.col("country"), F.col("keywords")), "country": country, "outcome": F.coalesce(F.when(F.trim("outcome") != "", F.col("outcome")), F.lit("unknown")),
        "instance_weight": weight, "is_active": F.lit(True),
    })
