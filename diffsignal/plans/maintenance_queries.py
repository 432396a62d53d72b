"""Queries over snapshots and stored tables: what changed, what goes, what stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshots
from ..scratch import new_folder, written
from ..store.chunks import ChunkStore, kept_after_delete, upsert
from .registry import Registry, table

query = Registry()

# Orders as two snapshots of one tree: every seventh path is new, every eleventh is gone, every fifth has changed.
_BASE = "SELECT o_custkey, concat('p/', o_orderkey) AS path, sha1(concat(o_orderkey, o_orderstatus)) AS oid FROM orders WHERE o_orderkey % 7 <> 0"
_TARGET = "SELECT o_custkey, concat('p/', o_orderkey) AS path, sha1(concat(o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE '' END)) AS oid FROM orders WHERE o_orderkey % 11 <> 0"
_DIFF = f"SELECT coalesce(b.path, t.path) AS path, CASE WHEN b.oid IS NULL THEN 'added' WHEN t.oid IS NULL THEN 'deleted' WHEN b.oid <> t.oid THEN 'modified' ELSE 'same' END AS status, b.oid AS base_oid, t.oid AS target_oid FROM ({_BASE}) b FULL JOIN ({_TARGET}) t ON b.path = t.path"


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    table(spark, sf_dir, "orders").createOrReplaceTempView("__orders")
    return spark.sql(_BASE.replace("FROM orders", "FROM __orders")), spark.sql(_TARGET.replace("FROM orders", "FROM __orders"))


@query(f"SELECT * FROM ({_DIFF}) WHERE status <> 'same'")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_diff(*_two(spark, sf_dir))


@query(f"SELECT status, count(*) AS n FROM ({_DIFF}) GROUP BY status")
def snapshot_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_diff(*_two(spark, sf_dir), keep_same=True).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT path FROM ({_DIFF}) WHERE status IN ('modified', 'deleted')")
def paths_to_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.paths_to_delete(snapshots.snapshot_diff(*_two(spark, sf_dir)))


@query(f"SELECT path FROM ({_DIFF}) WHERE status IN ('modified', 'added')")
def paths_to_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.paths_to_read(snapshots.snapshot_diff(*_two(spark, sf_dir)))


@query(f"""
WITH d AS (SELECT d.*, o.o_custkey AS repo FROM ({_DIFF}) d JOIN orders o ON d.path = concat('p/', o.o_orderkey)), n AS (SELECT repo, count(*) FILTER (status IN ('added', 'modified')) AS n_changed, count(*) FILTER (status = 'deleted') AS n_deleted FROM d GROUP BY repo)
SELECT *, CASE WHEN n_changed > 0 THEN 'incremental' WHEN n_deleted > 0 THEN 'delete-only' ELSE 'noop' END AS plan FROM n
""")
def index_plan_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer is a repository with its own plan."""
    diff = snapshots.snapshot_diff(*_two(spark, sf_dir), keep_same=True)
    repo = table(spark, sf_dir, "orders").select(F.concat(F.lit("p/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_custkey").alias("repo"))
    return snapshots.plan_kind(diff.join(repo, "path"), ["repo"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_by_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return kept_after_delete(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), gone, ["l_orderkey"])


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def delete_by_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return kept_after_delete(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), gone, ["c_nationkey"])


@query("SELECT count(*) AS n_vectors FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def deleted_vector_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey").join(gone, "l_orderkey", "left_semi").agg(F.count("*").alias("n_vectors"))


@query("""
WITH new AS (SELECT o_custkey AS id, max(sha1(concat(o_custkey, ':new'))) AS sha, 2 AS version FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey)
SELECT c_custkey AS id, coalesce(new.sha, sha1(CAST(c_custkey AS VARCHAR))) AS sha, coalesce(new.version, 1) AS version FROM customer LEFT JOIN new ON new.id = c_custkey UNION ALL SELECT id, sha, version FROM new WHERE id NOT IN (SELECT c_custkey FROM customer)
""")
def upsert_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.sha1(F.col("c_custkey").cast("string")).alias("sha"), F.lit(1).alias("version"))
    new = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")).distinct().select("id", F.sha1(F.concat(F.col("id").cast("string"), F.lit(":new"))).alias("sha"), F.lit(2).alias("version"))
    return upsert(old, new, ["id"])


@query("SELECT n_name AS repository, r_name AS provider, n_nationkey AS version FROM nation JOIN region ON r_regionkey = n_regionkey")
def list_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("provider"))
    return table(spark, sf_dir, "nation").join(regions, "n_regionkey").select(F.col("n_name").alias("repository"), "provider", F.col("n_nationkey").alias("version"))


# Each nation is a repository whose files are the orders of its customers.
_OF = "SELECT c_custkey AS o_custkey, n_name AS repo FROM customer JOIN nation ON n_nationkey = c_nationkey"


def _index(spark: SparkSession, sf_dir: str) -> ChunkStore:
    """An index of all repositories at once, brought from one snapshot to the other by four commits.

    1: everything of the base; 2: what changed or went is dropped and what is
    new is added; 3: one repository is dropped; 4: another is rebuilt from a
    third of its files.
    """
    base, target = _two(spark, sf_dir)
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("repo"))
    of = table(spark, sf_dir, "customer").join(names, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "repo")
    store = ChunkStore(spark, new_folder(spark, "index"))
    null = lambda kind: F.lit(None).cast(kind)

    def chunks(files: DataFrame) -> DataFrame:
        return files.join(of, "o_custkey").select(
            F.sha1("path").alias("id"), F.lit("local").alias("repo_provider"), null("string").alias("repo_owner"), F.col("repo").alias("repo_name"), F.lit("c").alias("repo_ref"), "path", F.lit("code").alias("kind"), null("string").alias("language"), F.col("oid").alias("content"),
            F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit(0).cast("long").alias("indexed_at"), null("array<string>").alias("symbols"), null("string").alias("symbol_kind"), null("boolean").alias("exported"), F.array(F.length("oid").cast("float")).alias("embedding"), F.lit(1).alias("dim"),
        )

    diff = written(snapshots.snapshot_diff(base, target))  # read for what goes and for what comes
    # what goes was in the base
    gone = base.join(snapshots.paths_to_delete(diff), "path", "left_semi").join(of, "o_custkey").select("path", F.lit("local").alias("repo_provider"), F.col("repo").alias("repo_name"))
    store.insert(chunks(base))
    store.transact(lambda _: {"gone": gone, "added": chunks(target.join(snapshots.paths_to_read(diff), "path", "left_semi"))})
    store.delete_repository("local", "KENYA")
    store.rebuild("local", "PERU", chunks(target.filter("o_custkey % 3 = 0")).filter("repo_name = 'PERU'"))
    return store


@query(f"SELECT repo AS repo_name, path, oid AS content FROM ({_TARGET}) t JOIN ({_OF}) o ON t.o_custkey = o.o_custkey WHERE repo <> 'KENYA' AND (repo <> 'PERU' OR t.o_custkey % 3 = 0)")
def index_after_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index holds after refreshing all repositories, dropping one and rebuilding one."""
    return _index(spark, sf_dir).read().select("repo_name", "path", "content")


@query(f"""
WITH b AS (SELECT repo, path, t.o_custkey FROM ({_BASE}) t JOIN ({_OF}) o ON t.o_custkey = o.o_custkey), t AS (SELECT repo, path, t.o_custkey FROM ({_TARGET}) t JOIN ({_OF}) o ON t.o_custkey = o.o_custkey)
SELECT 1 AS version, repo AS repo_name, count(*) AS n FROM b GROUP BY repo UNION ALL SELECT 2, repo, count(*) FROM t GROUP BY repo UNION ALL SELECT 3, repo, count(*) FROM t WHERE repo <> 'KENYA' GROUP BY repo
UNION ALL SELECT 4, repo, count(*) FROM t WHERE repo <> 'KENYA' AND (repo <> 'PERU' OR o_custkey % 3 = 0) GROUP BY repo
""")
def index_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks each repository had in every version of the index."""
    store = _index(spark, sf_dir)
    counts = [store.read(v).groupBy("repo_name").agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), "repo_name", "n") for v in range(1, store.version() + 1)]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out
