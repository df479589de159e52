"""Deduplication and merging of document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import day_gap


def keep_first(rows: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order (ascending, nulls first): an aggregate, so copies go before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    first = F.min_by(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order))))
    return rows.groupBy(*keys).agg(first.alias("_first")).select(*(F.col(f"_first.`{c}`").alias(c) for c in rows.columns))


def merge_new(existing: DataFrame, incoming: DataFrame, key: str, *order: Column) -> DataFrame:
    """existing and the incoming rows of keys that it lacks, one for each key."""
    return existing.unionByName(keep_first(incoming.join(existing, key, "left_anti"), key, *order))


def fuzzy_new(incoming: DataFrame, existing: DataFrame, who: str, day: str, title: str, days: int = 21, prefix: int = 20) -> DataFrame:
    """Incoming rows without a counterpart of the same `who`: on the same day, or within `days` with either title key's prefix in the other."""
    a, b = incoming.alias("a"), existing.select(F.col(who), F.col(day), F.col(title)).alias("b")
    gap = day_gap(F.col(f"a.{day}"), F.col(f"b.{day}"))
    x, y = F.col(f"a.{title}"), F.col(f"b.{title}")
    alike = F.contains(x, F.substring(y, 1, prefix)) | F.contains(y, F.substring(x, 1, prefix))
    return a.join(b, (F.col(f"a.{who}") == F.col(f"b.{who}")) & ((gap == 0) | ((gap <= days) & alike)), "left_anti")


def restore(rows: DataFrame, snapshot: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the columns of a snapshot where the first of them is null."""
    old = snapshot.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    unset = F.col(columns[0]).isNull()
    return rows.join(old, key, "left").select(*(F.when(unset, F.coalesce(F.col(f"_{c}"), F.col(c))).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def flips(before: DataFrame, after: DataFrame, key: str, verdict: str) -> DataFrame:
    """Keys whose verdict changed; rows without a verdict before are no change."""
    b = before.where(F.col(verdict).isNotNull()).select(key, F.col(verdict).alias("before"))
    return b.join(after.select(key, F.col(verdict).alias("after")), key).where("before <> after")


def unique_surnames(names: DataFrame, name: str) -> DataFrame:
    """surname, full_name of the surnames that one person has."""
    last = F.element_at(F.split(F.translate(F.col(name), "-", " "), r"\s+"), -1)
    return names.select(last.alias("surname"), F.col(name).alias("full_name")).groupBy("surname").agg(F.min("full_name").alias("full_name"), F.count_distinct("full_name").alias("n")).where("n = 1").drop("n")


def title_speaker(rows: DataFrame, names: DataFrame, title: str, author: str) -> DataFrame:
    """rows with the author replaced by the person whose surname, which nobody on names(name) shares, the title has as a word.

    Where a title names several, the one that stands first counts; titles without any keep their author.
    """
    known = unique_surnames(names, "name")
    words = rows.withColumn("_row", F.monotonically_increasing_id())
    said = words.select("_row", F.posexplode(F.split(F.col(title), r"[^\p{L}'’]+")).alias("_at", "surname")).join(F.broadcast(known), "surname")  # a roster of names
    first = said.groupBy("_row").agg(F.min_by("full_name", "_at").alias("_named"))
    return words.join(first, "_row", "left").withColumn(author, F.coalesce("_named", author)).select(*rows.columns)
