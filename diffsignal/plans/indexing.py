"""Building and refreshing a chunk index: fingerprint, plan, and one new version of the store."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..models import Embedder, embed
from ..operators.chunking import build_chunks
from ..operators.snapshots import indexable, paths_to_delete, paths_to_read, snapshot_diff
from ..store.chunks import ATTEMPTS, ChunkStore, MetadataStore
from ..store.events import EventLog
from ..store.log import Conflict


@dataclass(frozen=True)
class Fingerprint:
    """What makes two indexes comparable."""

    embedding_provider: str
    embedding_model: str
    embedding_dimension: int
    chunk_strategy: str = "composite"
    chunk_version: int = 1


@dataclass(frozen=True)
class Plan:
    kind: str
    reason: str = ""
    changed: DataFrame | None = field(default=None, compare=False)
    stale: DataFrame | None = field(default=None, compare=False)


def differences(stored: dict | None, now: Fingerprint) -> list[str]:
    """The parts of the fingerprint in which a stored index differs."""
    return [k for k, v in vars(now).items() if stored is not None and stored.get(k) != v]


def plan_index(stored: dict | None, now: Fingerprint, commit: str, force: bool = False) -> Plan:
    """full without an index, when forced, or (forced only) when incompatible; noop at the same commit; else incremental."""
    if stored is None:
        return Plan("full", "no index")
    if force:
        return Plan("full", "forced")
    if changed := differences(stored, now):
        return Plan("incompatible", f"index differs in {', '.join(changed)}; force a rebuild")
    return Plan("noop", "same commit") if stored.get("commit_sha") == commit else Plan("incremental")


def execution_plan(plan: Plan, base: DataFrame, target: DataFrame) -> Plan:
    """An incremental plan with its paths: noop if no content changed, delete-only if none is to be read."""
    if plan.kind != "incremental":
        return plan
    diff = snapshot_diff(indexable(base), indexable(target))
    changed, stale = paths_to_read(diff), paths_to_delete(diff)
    counts = diff.agg(F.count_if(F.col("status") != "deleted").alias("read"), F.count("*").alias("all")).first()
    kind = "noop" if not counts["all"] else "delete-only" if not counts["read"] else "incremental"
    return replace(plan, kind=kind, changed=changed, stale=stale)


def rows_for(files: DataFrame, provider: str, name: str, ref: str, embedder: Embedder, size: int = 1000, overlap: int = 200, owner: str | None = None) -> DataFrame:
    """Stored rows of (path, content) files: chunked, embedded and stamped; one lazy plan, nothing collected."""
    chunks = build_chunks(files, size, overlap)
    text = lambda v: F.lit(v).cast("string")
    stamped = chunks.withColumns({"repo_provider": text(provider), "repo_owner": text(owner), "repo_name": text(name), "repo_ref": text(ref), "indexed_at": F.unix_timestamp()})
    return embed(stamped.drop("ord"), embedder)


def refresh(
    spark: SparkSession, store: ChunkStore, metadata: MetadataStore, provider: str, name: str, commit: str, files: DataFrame, base: DataFrame | Callable[[str], DataFrame] | None, target: DataFrame,
    embedder: Embedder, fingerprint: Fingerprint, force: bool = False, dry_run: bool = False, size: int = 1000, overlap: int = 200, branch: str | None = None, events: EventLog | None = None,
) -> Plan:
    """Bring one repository's index to ``commit``; a dry run plans and writes nothing.

    files: (path, content) at the commit; base, target: snapshots (path, oid);
    ``base`` may be a function of the commit that the index stands at.  Deletes,
    new chunks and the fingerprint are one commit of the store: they become
    visible together, or, if the job stops anywhere, not at all.  Where another
    writer brought this repository on meanwhile, the plan is made again from
    what is there now; with a fixed ``base``, which then is no longer the base
    of anything, Conflict is raised.  ``events`` gets the steps with their counts.
    """
    log = events or _Silent()
    with log.task("workflow.index", repository=f"{provider}/{name}", commit=commit):
        return _refresh(spark, store, metadata, provider, name, commit, files, base, target, embedder, fingerprint, force, dry_run, size, overlap, branch, log)


class _Silent:
    """A log that keeps nothing."""

    def emit(self, event: str, **fields: object) -> None:
        pass

    @contextmanager
    def task(self, name: str, **fields: object):
        yield self


def _refresh(
    spark: SparkSession, store: ChunkStore, metadata: MetadataStore, provider: str, name: str, commit: str, files: DataFrame, base: DataFrame | Callable[[str], DataFrame] | None, target: DataFrame,
    embedder: Embedder, fingerprint: Fingerprint, force: bool, dry_run: bool, size: int, overlap: int, branch: str | None, log: EventLog | _Silent,
) -> Plan:
    if store.log.root != metadata.log.root:
        raise ValueError("chunks and metadata of one index share a root, so that one commit holds both")
    kept = indexable(files.select("path", "content"))
    make = lambda f: rows_for(f, provider, name, commit, embedder, size, overlap)
    for attempt in range(ATTEMPTS):
        version = store.version()
        held = metadata.load(provider, name, version)
        plan = plan_index(held.asDict() if held else None, fingerprint, commit, force)
        if plan.kind == "incompatible":
            log.emit("workflow.index.rebuild.required", reason=plan.reason)
            return plan
        if plan.kind == "incremental":
            before = base(held["commit_sha"]) if callable(base) else base
            plan = execution_plan(plan, before if before is not None else spark.createDataFrame([], "path string, oid string"), target)
        log.emit("workflow.index.plan.computed", plan=plan.kind, attempt=attempt)
        if plan.kind in ("incremental", "delete-only"):
            log.emit("workflow.index.files.changed", n=plan.changed.count())
            log.emit("workflow.index.files.deleted", n=plan.stale.join(plan.changed, "path", "left_anti").count())
        if dry_run:
            log.emit("workflow.index.dry_run")
            return plan
        row = [(provider, name, commit, fingerprint.embedding_provider, fingerprint.embedding_model, fingerprint.embedding_dimension, fingerprint.chunk_strategy, fingerprint.chunk_version, "1", branch)]
        saved = spark.createDataFrame(row, "repository_provider string, repository_id string, commit_sha string, embedding_provider string, embedding_model string, embedding_dimension int, chunk_strategy string, chunk_version int, engine_version string, default_branch string")
        does: dict = {"metadata": saved.withColumns({"created_at": F.unix_timestamp(), "gone": F.lit(False)})}
        own = spark.createDataFrame([(provider, name)], "repo_provider string, repo_name string")
        if plan.kind == "full":
            does |= {"dropped": own, "added": make(kept)}
        elif plan.kind in ("incremental", "delete-only"):
            does["gone"] = plan.stale.withColumns({"repo_provider": F.lit(provider), "repo_name": F.lit(name)})
            if plan.kind == "incremental":
                does["added"] = make(kept.join(plan.changed, "path", "left_semi"))
        seen = Observation()
        try:
            change = store.change(version, **does, observed=seen)
            if "added" in does:
                log.emit("context.chunks.built", count=seen.get["chunks"])
            log.emit("workflow.index.published", version=store.log.publish(change))
            return plan
        except Conflict:
            if attempt + 1 == ATTEMPTS or not (callable(base) or base is None):
                raise
    return plan
