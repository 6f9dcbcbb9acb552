"""Tenant scoping, erasure and the audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERASED = "[erased]"
PERSONAL_COLUMNS = ("full_name", "phone", "license_no")


def tenant_view(df: DataFrame, tenant: str | int | None, column: str = "tenant", reporting: bool = False) -> DataFrame:
    """Rows of one tenant; none without a tenant; all only for the reporting role."""
    if reporting:
        return df
    if tenant is None:
        return df.filter(F.lit(False))
    return df.filter(F.col(column) == F.lit(tenant))


def pseudonymise(people: DataFrame, requests: DataFrame, key: str, columns: tuple[str, ...] = PERSONAL_COLUMNS) -> DataFrame:
    """Replaces the personal columns of every requested key."""
    wanted = requests.select(key).distinct().withColumn("_hit", F.lit(True))
    marked = people.join(wanted, key, "left")
    return marked.withColumns({c: F.when(F.col("_hit"), F.lit(ERASED)).otherwise(F.col(c)) for c in columns}).drop("_hit")


def erase_archive(archive: DataFrame, tokens: DataFrame, token: str) -> DataFrame:
    """Archive without the rows of the given tokens (rows without a token stay)."""
    return archive.join(tokens.select(token).distinct(), token, "left_anti")


def erased_counts(archive: DataFrame, tokens: DataFrame, token: str) -> DataFrame:
    """Rows removed per token, 0 included; the archive is counted per token before the join."""
    counts = archive.groupBy(token).agg(F.count(F.lit(1)).alias("_n"))
    return tokens.select(token).distinct().join(counts, token, "left").select(
        token, F.coalesce("_n", F.lit(0).cast("long")).alias("erased")
    )


def audit_rows(df: DataFrame, actor: Column, action: Column, resource: Column, details: list[str], at: Column) -> DataFrame:
    """Audit entries for the rows of an action's result; append them to the audit table."""
    return df.select(
        actor.alias("actor"), action.alias("action"), resource.alias("resource"),
        F.to_json(F.struct(*details)).alias("details"), at.alias("created_at"),
    )
