"""Manifest work: groups, pairing, incremental builds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.functions.strings import file_name, stem
from cellgrove.operators.ranking import global_row_number


def assign_groups(manifest: DataFrame, gmap: DataFrame, key: str, order: list[str], mapped: str = "group_map") -> DataFrame:
    """Group id from the map, else a singleton id above every mapped one.

    The singleton id is ``max(group) + 1 + row index`` in the manifest's order.
    """
    groups = gmap.groupBy(key).agg(F.max("group").alias("_mapped"))
    base = gmap.agg(F.coalesce(F.max("group") + 1, F.lit(0)).alias("base")).scalar()
    numbered = global_row_number(manifest, order, "_index")
    joined = numbered.join(groups, key, "left")
    return joined.select(
        *manifest.columns,
        F.coalesce(F.col("_mapped"), base + F.col("_index")).cast("long").alias("group"),
        F.when(F.col("_mapped").isNotNull(), mapped).otherwise("singleton").alias("group_source"),
    )


def pair_files(images: DataFrame, masks: DataFrame, on: str = "stem") -> DataFrame:
    """Inner join of two listings by file stem or full name.

    Both listings have ``source`` and ``path``; ``stem_number`` is the stem as a
    number where it is one, for natural ordering.
    """
    pick = {"stem": stem, "name": file_name}[on]
    left = images.select("source", pick(F.col("path")).alias("name"), F.col("path").alias("image_path"))
    right = masks.select("source", pick(F.col("path")).alias("name"), F.col("path").alias("mask_path"))
    number = F.expr("try_cast(name as bigint)")
    return left.join(right, ["source", "name"]).withColumn("stem_number", number)


def prefer_first(listings: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of candidate listings; the earliest one that has a key provides its row."""
    tagged = [d.withColumn("_rank", F.lit(i)) for i, d in enumerate(listings)]
    everything = tagged[0]
    for d in tagged[1:]:
        everything = everything.unionByName(d)
    cols = [c for c in listings[0].columns if c not in key]
    return everything.groupBy(*key).agg(F.min_by(F.struct(*cols), "_rank").alias("_v")).select(*key, "_v.*")


def incremental_build(
    manifest: DataFrame, existing: DataFrame, key: str, build: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """Build only keys without an output; returns new outputs and status counts."""
    missing = manifest.join(existing.select(key), key, "left_anti")
    have = existing.select(key).distinct().withColumn("_cached", F.lit(True))
    status = manifest.join(have, key, "left").groupBy(
        F.when(F.col("_cached"), "cached").otherwise("built").alias("status")
    ).agg(F.count("*").alias("n"))
    return build(missing), status
