"""Tables written between jobs, and joins that broadcast only what was counted."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: What may be broadcast, in bytes of its rows; beyond it a shuffle takes over.
BROADCAST_BYTES = 48 << 20
#: A key with more rows than this, and more than one in SHARES of all, is dealt over several tasks.
HOT_ROWS, SHARES = 2_000, 10_000
_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one in local tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_roots:
            _local_roots[app] = "file://" + tempfile.mkdtemp(prefix="diffsignal-")
        root = _local_roots[app]
    return root.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    It cuts the lineage: a lost executor costs no recomputation of what is
    above, and later jobs do not run it again.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/diffsignal/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, dict]:
    """``materialise``, and aggregates (aliased) of the rows that are taken while they are written: no job, and on the driver no plan, shuffle and threads, for these."""
    seen = Observation()
    out = materialise(df.observe(seen, *measures), name)
    return out, seen.get or out.agg(*measures).first().asDict()


def _few(rows: int, columns: int, held: int) -> bool:
    return rows * 8 * (columns + 1) + held <= BROADCAST_BYTES


def kept(df: DataFrame, name: str, size: Column | None = None) -> tuple[DataFrame, bool]:
    """``df`` materialised, and whether it may be broadcast (see ``small``), which is counted while it is written."""
    held = F.lit(0) if size is None else size.cast("long")
    out, seen = measured(df, name, F.count(F.lit(1)).alias("rows"), F.sum(held).alias("held"))
    return out, _few(seen["rows"], len(df.columns), seen["held"] or 0)


def marked(df: DataFrame, name: str, size: Column | None = None) -> DataFrame:
    """``df`` materialised and marked for broadcast if it is small."""
    out, few = kept(df, name, size)
    return F.broadcast(out) if few else out


def small(df: DataFrame, size: Column | None = None) -> bool:
    """Whether a materialised table may be broadcast; ``size``: bytes of a row's strings and arrays, where it has any."""
    n = df.count()  # from the files' footers
    if size is None or not _few(n, len(df.columns), 0):
        return _few(n, len(df.columns), 0)
    return _few(n, len(df.columns), df.agg(F.sum(size.cast("long"))).first()[0] or 0)


def counted(df: DataFrame, size: Column | None = None) -> DataFrame:
    """A materialised ``df`` marked for broadcast if it is ``small``, else as it is."""
    return F.broadcast(df) if small(df, size) else df


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], by: list[str], how: str = "inner", size: Column | None = None, few: bool | None = None) -> DataFrame:
    """``many.join(one, keys)`` for materialised tables, where a few keys may hold most rows of ``many``.

    A small ``one`` is broadcast (``size``: see ``small``; ``few``: what ``kept`` told of it).  Else a key with more than HOT_ROWS rows and one in SHARES of all is dealt over
    blocks by a hash of ``by``, and the rows of ``one`` with that key, which
    are few, are copied to each block.  There are at most SHARES such keys.
    """
    if small(one, size) if few is None else few:
        return many.join(F.broadcast(one), keys, how)
    limit = max(HOT_ROWS, many.count() // SHARES)
    hot = many.groupBy(*keys).count().filter(F.col("count") > limit)
    hot = materialise(hot.select(*keys, F.ceil(F.col("count") / limit).cast("int").alias("__blocks")), "hot_keys")
    if hot.isEmpty():
        return many.join(one, keys, how)
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("__block", F.coalesce(F.pmod(F.xxhash64(*by), F.col("__blocks")), F.lit(0)).cast("int")).drop("__blocks")
    copied = one.join(F.broadcast(hot), keys, "left").withColumn("__block", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__blocks"), F.lit(1)) - 1))).drop("__blocks")
    return dealt.join(copied, [*keys, "__block"], how).drop("__block")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``ids`` (one column doc_id); a null id is in no list."""
    gone = counted(materialise(ids.select(F.col("doc_id").alias("gone_id")).distinct(), "dropped"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
