"""Pseudonyms for addresses and e-mails."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def pseudonym_ip(ip: Column, salt: str) -> Column:
    """`pseudonym:` and a salted 128-bit BLAKE2b digest; empty or missing input gives ''."""

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        distinct = {v: "pseudonym:" + hashlib.blake2b((v + salt).encode(), digest_size=16).hexdigest() if v else ""
                    for v in values.unique()}
        return values.map(distinct)

    return digest(F.coalesce(ip, F.lit("")))


def pseudonym_ip_sha(ip: Column, salt: str) -> Column:
    """The same shape with SHA-256 cut to 128 bits: stays inside the JVM."""
    digest = F.substring(F.sha2(F.concat(ip, F.lit(salt)), 256), 1, 32)
    return F.when(F.coalesce(ip, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("pseudonym:"), digest))


def pseudonym_email(email: Column) -> Column:
    """`user_` and eight hex digits for the local part; the domain is kept."""
    at = F.instr(email, "@")
    local = F.when(at > 0, F.substring_index(email, "@", 1)).otherwise(email)
    domain = F.when(at > 0, email.substr(at + F.lit(1), F.length(email))).otherwise(F.lit("unknown"))
    masked = F.concat(F.lit("user_"), F.substring(F.sha2(local, 256), 1, 8), F.lit("@"), domain)
    return F.when(F.coalesce(email, F.lit("")) == "", email).otherwise(masked)
