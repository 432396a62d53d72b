"""Snapshots of a repository: what changed between two, what an index must drop and read, and which plan that makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_indexable


def snapshot_diff(base: DataFrame, target: DataFrame, keep_same: bool = False) -> DataFrame:
    """(path, status, base_oid, target_oid) of two (path, oid) snapshots: added, deleted, modified, and same if asked for."""
    both = base.select("path", F.col("oid").alias("base_oid")).join(target.select("path", F.col("oid").alias("target_oid")), "path", "full_outer")
    status = F.when(F.col("base_oid").isNull(), "added").when(F.col("target_oid").isNull(), "deleted").when(F.col("base_oid") != F.col("target_oid"), "modified").otherwise("same")
    out = both.withColumn("status", status).select("path", "status", "base_oid", "target_oid")
    return out if keep_same else out.filter("status <> 'same'")


def indexable(snapshot: DataFrame) -> DataFrame:
    """A snapshot without paths that are never indexed; every listing goes through it."""
    return snapshot.filter(is_indexable("path"))


def paths_to_delete(diff: DataFrame) -> DataFrame:
    """Paths whose stored chunks are stale: changed or deleted."""
    return diff.filter("status IN ('modified', 'deleted')").select("path").distinct()


def paths_to_read(diff: DataFrame) -> DataFrame:
    return diff.filter("status IN ('added', 'modified')").select("path").distinct()


def plan_kind(diff: DataFrame, keys: list[str]) -> DataFrame:
    """The execution plan of each repository's diff: noop, delete-only or incremental, with its counts."""
    changed, deleted = F.count_if(F.col("status").isin("added", "modified")), F.count_if(F.col("status") == "deleted")
    per = diff.groupBy(*keys).agg(changed.alias("n_changed"), deleted.alias("n_deleted"))
    return per.withColumn("plan", F.when(F.col("n_changed") > 0, "incremental").when(F.col("n_deleted") > 0, "delete-only").otherwise("noop"))


def overlapping(declarations: DataFrame, hunks: DataFrame) -> DataFrame:
    """Declarations that a hunk of the same path touches; intervals are closed."""
    h = hunks.select(F.col("path").alias("h_path"), F.col("start_line").alias("h_start"), F.col("end_line").alias("h_end"))
    touch = (F.col("path") == F.col("h_path")) & (F.col("h_start") <= F.col("end_line")) & (F.col("start_line") <= F.col("h_end"))
    return declarations.join(h, touch, "left_semi")


def signature_diff(candidates: DataFrame, head: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that exist on both sides with different signatures; what was added or removed does not trigger."""
    side = lambda d, s: d.select(*keys, F.col("signature").alias(f"{s}_signature"))
    return candidates.join(side(head, "head"), keys).join(side(base, "base"), keys).filter("head_signature <> base_signature")


def heritage_breaks(head: DataFrame, base: DataFrame, implementers: DataFrame) -> DataFrame:
    """(owner, implementer, member, kind): members of an owner that changed and that an implementer lacks (missing) or has in another shape (drift).

    head, base: (owner, member, marker); implementers: (owner, implementer, member, marker).
    """
    changed = head.withColumnRenamed("marker", "now").join(base.withColumnRenamed("marker", "was"), ["owner", "member"], "left").filter("was IS NULL OR was <> now")
    pairs = changed.join(implementers.select("owner", "implementer").distinct(), "owner")
    own = implementers.withColumnRenamed("marker", "has")
    return pairs.join(own, ["owner", "implementer", "member"], "left").filter("has IS NULL OR has <> now").select("owner", "implementer", "member", F.when(F.col("has").isNull(), "missing").otherwise("drift").alias("kind"))


def break_stats(breaks: DataFrame, keys: list[str]) -> DataFrame:
    return breaks.groupBy(*keys).agg(F.countDistinct("implementer").alias("implementers"), F.count_if(F.col("kind") == "drift").alias("drift"), F.count_if(F.col("kind") == "missing").alias("missing"))


def reference_tier(path: Column, changed: Column, declaration_path: Column) -> Column:
    """0 for a file of the same change, 1 for the declaring package, else 2."""
    from ..functions.paths import package_of

    return F.when(changed, 0).when(package_of(path) == package_of(declaration_path), 1).otherwise(2)
