"""Host and site names, and numbers written as text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def dns_name(name: Column) -> Column:
    """Lower case without the root's dot."""
    return F.lower(F.regexp_replace(F.trim(name), r"\.+$", ""))


def host_label(name: Column) -> Column:
    return F.nullif(F.substring_index(dns_name(name), ".", 1), F.lit(""))


@F.pandas_udf(StringType())
def ascii_labels(name: pd.Series) -> pd.Series:
    """Internationalised labels in the form that zones store."""

    def encode(label):
        try:
            return label.encode("idna").decode() if not label.isascii() else label
        except UnicodeError:
            return label

    return name.map(lambda text: ".".join(map(encode, text.split("."))), na_action="ignore")


def in_zone_form(df: DataFrame, name: str) -> DataFrame:
    """df with names in the form that zones store; rows whose names are in it already don't pass through Python."""
    plain = F.coalesce(F.col(name).rlike(r"^[\x00-\x7F]*$"), F.lit(True))
    return df.filter(plain).unionByName(df.filter(~plain).withColumn(name, ascii_labels(F.col(name))))


def registrable_domain(df: DataFrame, name: str, rules: DataFrame) -> DataFrame:
    """df with ``registrable``: the label before the longest suffix rule and that suffix; null if the name is a suffix.

    rules has rule and kind (exact, wildcard, exception; a wildcard's rule is what follows the star, an exception's what
    follows its mark). Suffixes of each distinct name are matched by an equi-join; an exception beats any rule, and a
    name that no rule matches takes its last label as suffix. Names and rules may be written in their own script or in
    the form that zones store: both are compared in the latter, and the answer keeps the name's way of writing. Only
    distinct names and rules that need it are encoded.
    """
    names = df.select(F.col(name).alias("_n")).filter("_n is not null").distinct().withColumn("_labels", F.split(dns_name(F.col("_n")), r"\."))
    size = F.size("_labels")
    rules = in_zone_form(rules, "rule")
    zone = in_zone_form(names.select("_n", "_labels", F.array_join("_labels", ".").alias("_z")), "_z").withColumn("_z", F.split("_z", r"\."))
    suffixes = zone.select("_n", "_labels", "_z", F.explode(F.sequence(F.lit(1), size)).alias("_k")).withColumn("rule", F.array_join(F.slice("_z", size - F.col("_k") + 1, F.col("_k")), "."))
    length = F.when(F.col("kind") == "wildcard", F.col("_k") + 1).when(F.col("kind") == "exception", F.col("_k") - 1).otherwise(F.col("_k"))
    matched = suffixes.join(rules, "rule").withColumn("_s", length).filter(F.col("_s") <= size)
    best = matched.groupBy("_n").agg(F.max(F.struct((F.col("kind") == "exception").alias("e"), F.col("_s"))).alias("_best"))
    found = names.join(best, "_n", "left").withColumn("_s", F.coalesce("_best._s", F.lit(1)))
    domain = F.when(size > F.col("_s"), F.array_join(F.slice("_labels", size - F.col("_s"), F.col("_s") + 1), "."))
    return df.join(found.select(F.col("_n").alias(name), domain.alias("registrable")), name, "left")


def uptime_seconds(text: Column) -> Column:
    """ "12 days, 03:04:05" or "03:04:05" as seconds."""
    days = F.coalesce(F.regexp_extract(text, r"(\d+)\s+day", 1).try_cast("bigint"), F.lit(0))
    clock = [F.regexp_extract(text, r"(\d+):(\d+)(?::(\d+))?", i).try_cast("bigint") for i in (1, 2, 3)]
    return days * 86400 + clock[0] * 3600 + clock[1] * 60 + F.coalesce(clock[2], F.lit(0))


def first_load_average(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def leading_number(text: Column) -> Column:
    """The number before a unit, like "12.3 ms" or "0.5 %"; "~" has none."""
    return F.regexp_extract(text, r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
