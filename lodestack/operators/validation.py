"""Audit of a resource manifest that has been read into tables.

Every rule is a DataFrame operation over groups, subgroups and resources of many
files at once; the result is one row for each issue: file, code, severity,
place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import keyed


def _issue(df: DataFrame, code: Column | str, place: Column, severity: Column | str = "error") -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("file", lit(code).alias("code"), lit(severity).alias("severity"), place.alias("place"))


def _group_place(part: str = "") -> Column:
    return F.format_string(f"groups[%d]{part}", "group_index")


def _resource_place(part: str = "") -> Column:
    return F.format_string(f"groups[%d].resources[%d]{part}", "group_index", "resource_index")


def _duplicates(placed: DataFrame, key: str, code: str) -> DataFrame:
    """Resources whose key an earlier one has, unless the two are never loaded together: groups of one parent and different resolutions."""
    apart = (F.col("group_index") != F.col("earlier_group_index")) & (F.col("group_parent") == F.col("earlier_group_parent")) & (F.col("resolution") != F.col("earlier_resolution"))
    found = keyed.first_conflict(placed, ["file", key], "at", apart, ["group_index", "group_parent", "resolution"])
    rows = placed.join(found.select("file", "at"), ["file", "at"])
    return _issue(rows, code, _resource_place("." + key))


def _rule_rows(resources: DataFrame, canonical: bool) -> DataFrame:
    none = lambda c: F.col(c).isNull()
    missing_or_zero = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    image, atlas, child = F.col("type") == "Image", F.coalesce(F.col("atlas"), F.lit(False)), F.col("parent").isNotNull()
    sprite = image & ~atlas & child
    any_image_field = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in ("width", "height", "x", "y", "ax", "ay", "aw", "ah", "cols", "rows")), atlas | child)
    rules: list[tuple[Column, str, str, str]] = []
    for c in ("ax", "ay", "aw", "ah"):
        rules.append((F.col(c) > 65535, "GeometryOutOfRange", "." + c, "error"))
    for c in ("cols", "rows"):
        rules.append((F.col(c) == 0, "InvalidGridSize", "." + c, "error"))
    rules.append((image & atlas & (child | missing_or_zero("width") | missing_or_zero("height")), "InvalidAtlasImage", "", "error"))
    rules.append((sprite & (none("x") | none("y") | missing_or_zero("aw") | missing_or_zero("ah")), "InvalidSprite", "", "error"))
    if canonical:
        rules.append((sprite & (~none("width") | ~none("height")), "UnexpectedResourceMetadata", "", "error"))
    rules.append((~image & any_image_field, "UnexpectedResourceMetadata", "", "error" if canonical else "warning"))
    broken = F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(part).alias("part"), F.lit(severity).alias("severity"))) for bad, code, part, severity in rules))
    rows = resources.withColumn("_b", F.explode(F.filter(broken, lambda x: x.isNotNull())))
    return _issue(rows, F.col("_b.code"), F.concat(_resource_place(), F.col("_b.part")), F.col("_b.severity"))


def validate_manifests(groups: DataFrame, subgroups: DataFrame, resources: DataFrame, canonical: bool = False) -> DataFrame:
    """Issues of the tables of manifests (as ``sources.tables`` reads them, each with the column file)."""
    # of groups with one id the last counts for references; every later one is an issue
    dimension = groups.select("file", "id", "group_index", "kind", F.struct("file", "id").alias("key"))
    later = groups.join(groups.groupBy("file", "id").agg(F.min("group_index").alias("_first")), ["file", "id"]).where("group_index > _first")
    issues = [_issue(later, "DuplicateGroupId", _group_place(".id"))]

    placed = resources.join(groups.select("file", "group_index", F.col("parent").alias("group_parent"), "resolution", "slot_count"), ["file", "group_index"])
    placed = placed.withColumn("at", F.struct("group_index", "resource_index"))
    issues += [_duplicates(placed, "id", "DuplicateResourceId"), _duplicates(placed, "slot", "DuplicateSlot")]
    issues.append(_issue(placed.where("slot >= slot_count"), "SlotOutOfRange", _resource_place(".slot")))
    issues.append(_rule_rows(resources, canonical))

    def referring(df: DataFrame, wanted: str, place: Column) -> DataFrame:
        audited = keyed.referential_audit(df, "_ref", dimension, "key", "group_index", "kind", F.lit(wanted), "_status")
        code = F.when(F.col("_status") == "missing", "MissingGroupReference").otherwise("WrongGroupReferenceKind")
        return _issue(audited.where("_status <> 'ok'"), code, place)

    parents = groups.where("parent is not null").withColumn("_ref", F.struct("file", F.col("parent").alias("id")))
    issues.append(referring(parents, "composite", _group_place(".parent")))
    members = subgroups.withColumn("_ref", F.struct("file", "id"))
    issues.append(referring(members, "simple", F.format_string("groups[%d].subgroups[%d].id", "group_index", "ordinal")))

    local = resources.select("file", F.struct("file", "group_index", "id").alias("key"), "resource_index", F.when((F.col("type") == "Image") & F.col("atlas"), "atlas").otherwise("other").alias("kind"))
    children = resources.where("parent is not null").withColumn("_ref", F.struct("file", "group_index", F.col("parent").alias("id")))
    audited = keyed.referential_audit(children, "_ref", local, "key", "resource_index", "kind", F.lit("atlas"), "_status").where("_status <> 'ok'")
    issues.append(_issue(audited, F.when(F.col("_status") == "missing", "MissingAtlasReference").otherwise("InvalidAtlasReference"), _resource_place(".parent")))

    if canonical:
        slots = resources.groupBy("file").agg(F.countDistinct("slot").alias("n"))
        told = groups.groupBy("file").agg(F.first("slot_count").alias("slot_count")).join(slots, "file", "left")
        issues.append(_issue(told.where("coalesce(n, 0) <> slot_count"), "IncompleteSlotTable", F.lit("slot_count")))
    return reduce(DataFrame.unionByName, issues)
