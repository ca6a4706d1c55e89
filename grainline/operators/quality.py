"""Quality, leakage and constraint checks (family I). Each returns a table of checks or of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QualityError(ValueError):
    pass


def quality_report(checks: list[tuple[str, DataFrame, Column, str]]) -> DataFrame:
    """name, severity, failure_count, status per check (name, frame, failing condition, severity). Checks of the same frame
    share one aggregate."""
    out = []
    for df in {id(c[1]): c[1] for c in checks}.values():
        own = [c for c in checks if c[1] is df]
        one = df.agg(*(F.count_if(cond).alias(name) for name, _, cond, _ in own))
        rows = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"), F.col(n).alias("failure_count")) for n, _, _, s in own))
        out.append(one.select(F.explode(rows).alias("x")).select("x.*"))
    report = reduce(lambda a, b: a.unionByName(b), out)
    status = F.when(F.col("failure_count") == 0, "pass").when(F.col("severity") == "error", "fail").otherwise("warning")
    return report.withColumn("status", status)


def stop_on_error(report: DataFrame) -> DataFrame:
    """The report, or an error that names the failed checks (a handful of rows)."""
    failed = [r["name"] for r in report.where("status = 'fail'").select("name").limit(100).collect()]
    if failed:
        raise QualityError(f"failed checks: {failed}")
    return report


def rule_violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per row and broken rule: keys, rule. A rule gives the violating condition; NULL is no violation."""
    broken = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(broken).alias("rule"))


def gates(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """gate, failures, passed: one aggregate, then long rows."""
    one = df.agg(*(F.count_if(c).alias(n) for n, c in rules.items()))
    rows = F.array(*(F.struct(F.lit(n).alias("gate"), F.col(n).alias("failures"), (F.col(n) == 0).alias("passed")) for n in rules))
    return one.select(F.explode(rows).alias("x")).select("x.*")


def orphans(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on).distinct(), on, "left_anti")


def lineage_violations(child: DataFrame, parent: DataFrame, on: list[str], rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """Children whose parent is absent or breaks a rule. In rules the parent's columns have the prefix p_."""
    right = parent.select(*on, F.lit(True).alias("_found"), *(F.col(c).alias(f"p_{c}") for c in parent.columns if c not in on))
    joined = child.join(right, on, "left")
    found = F.col("_found").isNotNull()
    return rule_violations(joined, keys, {"no_parent": ~found} | {n: found & c for n, c in rules.items()})


def contract_keys(contracts: dict[str, tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """Per table: missing required columns, rows with a NULL key, keys that repeat."""
    out = []
    for name, (df, required, keys) in contracts.items():
        missing = "|".join(c for c in required if c not in df.columns)
        null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        out.append(groups.agg(F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("null_keys"), F.count_if(~null & (F.col("n") > 1)).alias("repeated_keys")).select(F.lit(name).alias("table_name"), F.lit(missing).alias("missing"), "null_keys", "repeated_keys"))
    return reduce(lambda a, b: a.unionByName(b), out)


def grain_audit(stages: list[tuple[str, DataFrame, DataFrame, list[str]]]) -> DataFrame:
    """Per join stage (name, left, right, keys): input, matched, unmatched rows and rows that the join adds. Right sides are
    reduced to counts of keys first, so nothing is multiplied to be counted."""
    out = []
    for name, left, right, on in stages:
        n = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
        joined = left.select(*on).join(n, on, "left")
        out.append(joined.agg(F.count(F.lit(1)).alias("input_rows"), F.count("_n").alias("matched"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("multiplied")).select(F.lit(name).alias("stage"), "input_rows", "matched", (F.col("input_rows") - F.col("matched")).alias("unmatched"), "multiplied"))
    return reduce(lambda a, b: a.unionByName(b), out)


def leakage_audit(df: DataFrame, target: str, source: str, entity: str) -> DataFrame:
    """Per target season: rows, entities, first and last source, rows whose source is not earlier, passed."""
    out = df.groupBy(target).agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(entity).alias("entities"), F.min(source).alias("first_source"), F.max(source).alias("last_source"), F.count_if(F.col(source) >= F.col(target)).alias("illegal"))
    return out.withColumn("passed", F.col("illegal") == 0)


def temporary_roles(df: DataFrame, group: list[str], season: str, owner: str, start: str, end: str, first: int, last: int) -> DataFrame:
    """df plus temporary: started after the first week with a predecessor, held the end, and another owner opens the group's next
    season."""
    opening = df.where(F.col(start) == first).groupBy(*group, season).agg(F.min(owner).alias("_open"))
    following = opening.select(*group, (F.col(season) - 1).alias(season), F.col("_open").alias("_next"))
    earlier = df.groupBy(*group, season).agg(F.min(start).alias("_first"))
    out = df.join(following, [*group, season], "left").join(earlier, [*group, season], "left")
    flag = (F.col(start) > first) & (F.col("_first") < F.col(start)) & (F.col(end) >= last) & F.col("_next").isNotNull() & (F.col("_next") != F.col(owner))
    return out.withColumn("temporary", F.coalesce(flag, F.lit(False))).drop("_next", "_first")

