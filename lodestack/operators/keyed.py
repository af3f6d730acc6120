"""Operators over keys: dictionaries, replacement, remapping, overlays, audits, look-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered

Cols = Sequence[str]


def first_seen_dictionary(df: DataFrame, key: Column, ordinal: str, name: str = "key", code: str = "code", root: str | None = None) -> DataFrame:
    """Codes for the distinct keys in order of first appearance; a ``root`` has code 0 whether it appears or not. The keys are aggregated first, then numbered in range partitions, however many there are."""
    seen = df.select(key.alias(name), F.col(ordinal).alias("_at")).groupBy(name).agg(F.min("_at").alias("_at"))
    shift = 0
    if root is not None:
        seen, shift = seen.where(F.col(name) != root), 1
    coded = ordered.dense_index(seen, ["_at", name], code).select(name, (F.col(code) + shift).alias(code))
    if root is not None:
        coded = coded.unionByName(df.sparkSession.range(1).select(F.lit(root).alias(name), F.lit(0).cast("long").alias(code)))
    return coded


def group_segments(df: DataFrame, key: Column, ordinal: str, fields: Cols, out: str = "segments", name: str = "key") -> DataFrame:
    """The rows of one normalised key as one row, its segments in input order."""
    return df.groupBy(key.alias(name)).agg(F.array_sort(F.collect_list(F.struct(ordinal, *fields))).alias(out))


def replace_by_key(original: DataFrame, edited_keys: DataFrame, replacement: DataFrame, key: str) -> DataFrame:
    """Rows of edited keys go, the replacement's rows come. Keys compare exactly."""
    return original.join(edited_keys.select(key).distinct(), key, "left_anti").unionByName(replacement)


def duplicates(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Keys that more than one row has, with how many."""
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, key: Column, what: str = "key") -> DataFrame:
    """``df`` unchanged; running it fails if two rows have one key."""
    w = Window.partitionBy(key)
    return df.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.expr(f"if(_n > 1, raise_error('duplicate {what}'), true)")).drop("_n")


def mandatory_remap(df: DataFrame, key: str, codes: DataFrame, code_key: str, code: str, out: str, strict: bool = True) -> DataFrame:
    """The new code of each key. A key without one fails the job, or, if not strict, has null."""
    found = df.join(codes.select(F.col(code_key).alias("_k"), F.col(code).alias("_c")), F.col(key) == F.col("_k"), "left")
    value = F.when(F.col("_c").isNull(), F.raise_error(F.concat(F.lit("no code for "), F.col(key).cast("string")))).otherwise(F.col("_c")) if strict else F.col("_c")
    return found.withColumn(out, value).drop("_k", "_c")


def filter_nested(df: DataFrame, array: str, child: str, survivors: DataFrame, old: str, new: str) -> DataFrame:
    """Groups with the children that survive, under their new numbers and in their old order; groups without any go. Adds n_children."""
    others = [c for c in df.columns if c != array]
    opened = df.select(*others, F.posexplode(array).alias("_pos", "_child"))
    kept = opened.join(survivors.select(F.col(old).alias("_old"), F.col(new).alias("_new")), F.col(f"_child.{child}") == F.col("_old"))
    rows = kept.withColumn("_child", F.col("_child").withField(child, F.col("_new")))
    packed = rows.groupBy(*others).agg(F.array_sort(F.collect_list(F.struct("_pos", "_child"))).alias("_a"))
    return packed.withColumn(array, F.expr("transform(_a, x -> x._child)")).withColumn("n_children", F.size(array)).drop("_a")


def overlay(original: DataFrame, edits: DataFrame, removed: DataFrame, added: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) after edits override, removed keys go and added rows come."""
    edited = original.select(key, value).join(edits.select(key, F.col(value).alias("_v")), key, "left").select(key, F.coalesce("_v", value).alias(value))
    return edited.join(removed.select(key).distinct(), key, "left_anti").unionByName(added.select(key, value))


def first_conflict(df: DataFrame, keys: Cols, ordinal: str, allowed: Column, fields: Cols) -> DataFrame:
    """For each row the first earlier row of its key that it conflicts with.

    ``allowed`` tells, with the earlier row's fields prefixed ``earlier_``, whether
    two rows may share a key. Of rows with the same fields the first stands for
    all, so a row meets each different combination of its key once: an
    equi-join on the keys with the rest as its condition. Rows without a
    conflict are not returned.
    """
    later = df.select(*keys, ordinal, *fields)
    firsts = df.groupBy(*keys, *fields).agg(F.min(ordinal).alias("_first"))
    earlier = firsts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_first").alias(f"earlier_{ordinal}"), *(F.col(f).alias(f"earlier_{f}") for f in fields))
    same = F.expr(" and ".join(f"`{k}` = _k{i}" for i, k in enumerate(keys)))
    met = later.join(earlier, same & (F.col(f"earlier_{ordinal}") < F.col(ordinal)) & ~F.coalesce(allowed, F.lit(False)))
    return met.groupBy(*keys, ordinal).agg(F.min(f"earlier_{ordinal}").alias(f"earlier_{ordinal}"))


def referential_audit(df: DataFrame, key: str, dimension: DataFrame, dim_key: str, dim_ordinal: str, kind: str, wanted: Column, out: str) -> DataFrame:
    """missing, wrong kind or ok for each reference. Of dimension rows with one key the last counts; a null reference is ok."""
    last = dimension.groupBy(F.col(dim_key).alias("_k")).agg(F.max_by(kind, dim_ordinal).alias("_kind"))
    found = df.join(last, F.col(key) == F.col("_k"), "left")
    status = F.when(F.col(key).isNull(), "ok").when(F.col("_k").isNull(), "missing").when(F.coalesce(F.col("_kind") == wanted, F.lit(False)), "ok").otherwise("wrong kind")
    return found.withColumn(out, status).drop("_k", "_kind")


def rule_violations(df: DataFrame, id_cols: Cols, rules: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """A row for each rule that a row breaks: ids, rule, severity. Rules are (severity, condition that must hold); null holds."""
    broken = [F.when(~F.coalesce(ok, F.lit(True)), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, (severity, ok) in rules.items()]
    return df.select(*id_cols, F.explode(F.filter(F.array(*broken), lambda x: x.isNotNull())).alias("_b")).select(*id_cols, "_b.rule", "_b.severity")


def errors(issues: DataFrame) -> DataFrame:
    return issues.where("severity = 'error'")


def is_valid(issues: DataFrame) -> DataFrame:
    """One row: no issue is an error."""
    return issues.agg((~F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False))).alias("is_valid"))


def completeness(df: DataFrame, value: str, expected: Column | int, keys: Cols = ()) -> DataFrame:
    """Whether there are exactly as many distinct values as expected."""
    expected = F.lit(expected) if isinstance(expected, int) else expected
    return df.groupBy(*keys).agg(F.countDistinct(value).alias("n_distinct"), F.first(expected).alias("expected")).withColumn("complete", F.col("n_distinct") == F.col("expected"))


def lookup_first(queries: DataFrame, query_key: str, table: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The first row, by ordinal, with the key of each query; null where there is none. Spark hashes keys and compares them again."""
    first = table.groupBy(F.col(key).alias("_k")).agg(F.min(ordinal).alias("first_match"))
    return queries.join(first, F.col(query_key) == F.col("_k"), "left").drop("_k")


def rank_sort(df: DataFrame, value: str, ranks: Mapping[str, int], ordinal: str, otherwise: int, out: str = "rank") -> DataFrame:
    """By the value's rank, then input order. Range partitions sort in parallel."""
    rank = F.lit(otherwise)
    for v, r in ranks.items():
        rank = F.when(F.col(value) == v, r).otherwise(rank)
    return df.withColumn(out, rank).orderBy(out, ordinal)


def equal_as_null(a: Column, b: Column) -> Column:
    """b where it differs from a, null where both are equal."""
    return F.when(~a.eqNullSafe(b), b)


def delta(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """What takes ``before`` to ``after``: for each key of ``after`` the md5 of the old value (of nothing if new), and the new value where it differs."""
    old = before.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    rows = after.join(old, F.col(key) == F.col("_k"), "left").withColumn("_v", F.coalesce("_v", F.lit("").cast(before.schema[value].dataType)))
    return rows.select(key, F.md5(F.col("_v").cast("binary")).alias("before_md5"), equal_as_null(F.col("_v"), F.col(value)).alias("patch"))


def apply_delta(before: DataFrame, patch: DataFrame, key: str, value: str) -> DataFrame:
    """``after`` again; fails where the old value is not the one that the delta was made from."""
    old = before.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    rows = patch.join(old, F.col(key) == F.col("_k"), "left").withColumn("_v", F.coalesce("_v", F.lit("").cast(before.schema[value].dataType)))
    checked = rows.where(F.expr("if(md5(cast(_v as binary)) <> before_md5, raise_error('the source differs from what the delta was made from'), true)"))
    return checked.select(key, F.coalesce("patch", "_v").alias(value))


def first_success(*alternatives: Column) -> Column:
    return F.coalesce(*alternatives)
