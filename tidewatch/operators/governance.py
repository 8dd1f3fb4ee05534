"""Retention, masking, erasure and export jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import MICROS
from ..functions.privacy import pseudonym_email, pseudonym_ip, pseudonym_ip_sha
from ..session import side_by_side, small_side

# Column names that hold personal data.
SENSITIVE = ["ip_src", "ip_dst", "src_ip", "dst_ip", "source_ip", "destination_ip", "email", "user_email",
             "customer_email", "credit_card", "card_number", "cc_number", "phone", "phone_number", "mobile", "ssn",
             "social_security"]
MASK = "***MASKED***"

# Identifier types and the columns they select.
IDENTIFIERS = {"ip": ["ip_src", "ip_dst", "src_ip", "dst_ip"], "email": ["email", "user_email", "customer_email"]}
REASON_ERASURE = "GDPR Article 17 (Right to erasure)"
REASON_EXPORT = "GDPR Article 20 (Right to data portability)"


@dataclass(frozen=True)
class RetentionPolicy:
    category: str
    days: int
    archive: bool = False
    archive_path: str | None = None
    delete: bool = True
    roll_up_days: int | None = None


# Retention per category in days (0 keeps for ever).
POLICIES = [
    RetentionPolicy("raw_packets", 1, roll_up_days=1), RetentionPolicy("flows", 30), RetentionPolicy("alerts", 90),
    RetentionPolicy("metrics", 30, roll_up_days=1), RetentionPolicy("audit_logs", 365, archive=True),
    RetentionPolicy("ml_models", 0, delete=False), RetentionPolicy("configuration", 0, delete=False)]


def mask(df: DataFrame, salt: str, columns: list[str] = SENSITIVE, native: bool = False) -> DataFrame:
    """Pseudonyms for address and e-mail columns, a constant for other sensitive ones; empty values stay."""
    ip = pseudonym_ip_sha if native else pseudonym_ip
    out = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        if name not in columns:
            out.append(c)
            continue
        text = c.cast("string")
        masked = ip(text, salt) if "ip" in name else pseudonym_email(text) if "email" in name else F.lit(MASK)
        out.append(F.when(F.coalesce(text, F.lit("")) == "", text).otherwise(masked).alias(name))
    return df.select(*out)


def cutoff(now: Column, days: int) -> Column:
    return now - F.make_dt_interval(days=F.lit(days))


def split_by_age(table: DataFrame, now: Column, days: int, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(kept, expired): rows at the cutoff are kept, rows without a time too."""
    old = F.coalesce(F.col(ts) < cutoff(now, days), F.lit(False))
    return table.filter(~old), table.filter(old)


def count_older(table: DataFrame, now: Column, days: int, ts: str = "ts") -> DataFrame:
    return split_by_age(table, now, days, ts)[1].agg(F.count("*").alias("rows"))


def retention_plan(table: DataFrame, now: Column, category: str, ts: str = "ts", policies: list[RetentionPolicy] = POLICIES) -> DataFrame:
    """Rows with `category` columns: how many each policy would keep, delete and archive; one pass.

    Policies of zero days are skipped.
    """
    rows = []
    for p in policies:
        if p.days:
            old = F.coalesce(F.col(ts) < cutoff(now, p.days), F.lit(False))
            mine = F.col(category) == p.category
            rows.append((p, F.count_if(mine & old), F.count_if(mine & ~old)))
    wide = table.agg(*[c.alias(f"{kind}{i}") for i, (_, o, k) in enumerate(rows) for kind, c in (("o", o), ("k", k))])
    entries = [F.struct(F.lit(p.category).alias("category"), F.lit(p.days).alias("days"), F.col(f"k{i}").alias("kept"),
                        (F.col(f"o{i}") if p.delete else F.lit(0).cast("bigint")).alias("deleted"),
                        (F.col(f"o{i}") if p.archive and p.archive_path else F.lit(0).cast("bigint")).alias("archived"))
               for i, (p, _, _) in enumerate(rows)]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def audit_entry(spark: SparkSession, now: Column, action: str, resource: str, details: dict[str, Column], reason: str) -> DataFrame:
    """One audit row (user `system`)."""
    pairs = [c for k, v in details.items() for c in (F.lit(k), v.cast("string"))]
    return spark.range(1).select(
        F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.lit(action).alias("action"),
        F.lit("system").alias("user"), F.lit(resource).alias("resource"), F.create_map(*pairs).alias("details"),
        F.lit(reason).alias("compliance_reason"))


def apply_retention(spark: SparkSession, source: str, target: str, now: Column, policy: RetentionPolicy,
                    audit_path: str, ts: str = "ts") -> None:
    """Writes the kept rows of a Parquet table to `target`, archives the rest if asked, and audits it."""
    if not policy.days:
        return
    table = spark.read.parquet(source)
    kept, expired = split_by_age(table, now, policy.days, ts)
    if policy.archive and policy.archive_path:
        expired.write.mode("overwrite").json(policy.archive_path)
    if not policy.delete:
        return
    kept.write.mode("overwrite").parquet(target)
    details = {"records_deleted": F.lit(expired.count()), "cutoff_date": cutoff(now, policy.days),
               "retention_days": F.lit(policy.days), "category": F.lit(policy.category),
               "archive_before_delete": F.lit(policy.archive)}
    audit_entry(spark, now, "data_retention_deletion", f"data_store:{policy.category}", details,
                REASON_ERASURE).write.mode("append").json(audit_path)


def roll_up(table: DataFrame, keys: list[str], sums: list[str], days: int = 1, ts: str = "ts") -> DataFrame:
    """Daily (or n-day) totals that outlive the raw rows."""
    width = days * 86400 * MICROS
    start = F.timestamp_micros(F.expr(f"unix_micros({ts}) - pmod(unix_micros({ts}), {width})"))
    return table.groupBy(start.alias("period_start"), *keys).agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in sums])


def _identifier_columns(table: DataFrame, kind: str) -> list[str]:
    names = [c for c in IDENTIFIERS.get(kind, [kind]) if c in table.columns]
    if not names:
        raise ValueError(f"the table has no column for identifier type {kind}")
    return names


def matching_rows(table: DataFrame, requests: DataFrame, kind: str = "ip", erase: bool = False) -> DataFrame:
    """Rows that name a requested identifier (export), or all others (`erase`).

    `requests` has one `identifier` column. Each identifier column is one semi or anti join, so a hot
    address is looked up, not multiplied.
    """
    wanted = small_side(requests.select(F.col("identifier").alias("_id")).distinct())
    names = _identifier_columns(table, kind)
    if erase:
        out = table
        for name in names:
            out = out.join(wanted, F.col(name) == F.col("_id"), "left_anti")
        return out
    flagged = table
    seen = []
    for i, name in enumerate(names):
        hit = wanted.select(F.col("_id").alias(f"_id{i}"))
        flagged = flagged.join(hit, F.col(name) == F.col(f"_id{i}"), "left")
        seen.append(F.col(f"_id{i}").isNotNull())
    keep = seen[0]
    for s in seen[1:]:
        keep = keep | s
    return flagged.filter(keep).select(table.columns)


def compliance_report(policies: DataFrame, audit: DataFrame) -> DataFrame:
    """Policies and the number of audit entries in one row."""
    p = policies.agg(F.count("*").alias("policies"), F.array_sort(F.collect_list(F.struct("category", "days"))).alias("retention"))
    return side_by_side(p, audit.agg(F.count("*").alias("audit_entries")))  # a policy table has a few rows
