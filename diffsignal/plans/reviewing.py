"""A review of one change: context from the index and the symbol graph, prompts, answers, ranked signals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.text import break_notes, chunk_id, embedding_query, review_prompt, type_note
from ..models import Embedder, Model, answer, embed
from ..operators import typescript
from ..operators.modules import SOURCE
from ..operators.context import in_provider_order, joined_context, sections
from ..operators.ordered import first_of, rank_and_cap
from ..operators.retrieval import nearest
from ..operators.signals import explode_raw, finalise, normalise, parse_output
from ..operators.snapshots import heritage_breaks, overlapping, reference_tier, signature_diff
from ..operators.types import Types
from ..scratch import written
from ..store.events import EventLog

VALUE_CAP, TYPE_CAP = 5, 3
CHUNK = ["file", "pos", "source_kind", "path", "symbols", "line_start", "line_end", "kind", "content", "truncated"]
_MARKER = "struct<shown:int,total:int>"

@dataclass(frozen=True)
class Review:
    signals: DataFrame
    results: DataFrame
    prompts: DataFrame


def rag_context(files: DataFrame, chunks: DataFrame, embedder: Embedder, provider: str, name: str, k: int = 8, title: str | None = None, ref: str | None = None) -> DataFrame:
    """Chunks of the same repository, and of one ``ref`` if it is given, nearest to each changed file, none of a path under review.

    files: (path, patch, hunks); chunks: the store's rows.
    """
    text = embedding_query(F.col("path"), F.col("patch"), F.col("hunks"), F.lit(title).cast("string"))
    queries = embed(files.select(F.col("path").alias("q_id"), text.alias("content")), embedder).select("q_id", F.col("embedding").alias("q_embedding"))
    own = chunks.filter((F.col("repo_provider") == provider) & (F.col("repo_name") == name) & (F.col("dim") == embedder.dimension))
    own = own.filter(F.col("repo_ref") == ref) if ref is not None else own
    own = own.join(files.select("path").distinct(), "path", "left_anti").select("id", "path", "kind", "content", "line_start", "line_end", "symbols", "embedding")
    hits = nearest(own, queries, k)
    return hits.select(F.col("q_id").alias("file"), F.col("rank").alias("pos"), F.lit("file").alias("source_kind"), "path", "symbols", "line_start", "line_end", "kind", "content", F.lit(None).cast(_MARKER).alias("truncated"))


def index_available(stored: Row | None, provider: str, model: str, revision: str, events: EventLog | None = None) -> bool:
    """Whether a repository's index (its metadata row) can be searched with these embeddings; one of another commit still can, and is told of."""
    if stored is None:
        if events:
            events.emit("workflow.review.context_unavailable")
        return False
    fits = (stored["embedding_provider"], stored["embedding_model"]) == (provider, model)
    if events and (not fits or stored["commit_sha"] != revision):
        events.emit("workflow.review.index_outdated", indexed=stored["commit_sha"], current=revision)
    return fits


def symbols_available(files: DataFrame, head: DataFrame, base_sha: str | None) -> bool:
    """Whether a change may alter exported symbols: its base is known, the root has a ``tsconfig.json``, and a hunk meets an exported declaration of a TypeScript source."""
    if not base_sha or base_sha == "unknown" or head.filter("path = 'tsconfig.json'").isEmpty():
        return False
    hunks = files.select("path", F.explode("hunks").alias("h")).select("path", "h.start_line", "h.end_line").filter(F.col("path").rlike(SOURCE))
    touched = head.join(hunks.select("path").distinct(), "path", "left_semi").withColumn("side", F.lit("head"))
    return not overlapping(typescript.declarations(touched), hunks).isEmpty()


def symbol_context(files: DataFrame, head: DataFrame, base: DataFrame) -> dict[str, DataFrame]:
    """Direct users and type dependents of the exported symbols whose shape a change alters.

    files: (path, patch, hunks) of the change; head, base: (path, content) of
    the TypeScript sources on both sides, with the configurations of modules.  Gates come first: only declarations
    that a hunk touches and whose signature differs reach the reference scan.
    """
    hunks = files.select("path", F.explode("hunks").alias("h")).select("path", "h.start_line", "h.end_line")
    now, was = Types(head), Types(base)
    source = F.col("path").rlike(SOURCE)
    declared = lambda side, files_, types: types.declarations(typescript.declarations(files_.filter(source).join(files.select("path").distinct(), "path", "left_semi").withColumn("side", F.lit(side))))
    keys = ["path", "name", "kind"]
    ours = written(declared("head", head, now), "declared")
    touched = overlapping(ours, hunks).select(*keys, "start_line", "end_line").distinct()
    triggered = written(signature_diff(touched, ours, declared("base", base, was), keys).select(*keys), "triggered")

    found = typescript.references(head, triggered)
    # members that a type gained or changed, against those that its heirs have, their own and inherited ones
    key = lambda path, name: F.concat(path, F.lit("#"), name)
    of = lambda types, roots: types.members(roots).select(key(F.col("path"), F.col("name")).alias("owner"), "member", "marker")
    heirs = written(now.heirs(triggered), "heirs")
    shapes = of(now, heirs.select(F.col("heir_path").alias("path"), F.col("heir").alias("name"))).withColumnRenamed("owner", "implementer")
    # an heir without any member still lacks those of its base
    pairs = heirs.select(key(F.col("path"), F.col("name")).alias("owner"), key(F.col("heir_path"), F.col("heir")).alias("implementer")).join(shapes, "implementer", "left").select("owner", "implementer", "member", "marker")
    breaks = heritage_breaks(of(now, triggered), of(was, triggered), pairs)
    breaks = breaks.select(F.substring_index("owner", "#", 1).alias("symbol_path"), F.substring_index("owner", "#", -1).alias("symbol"), F.substring_index("implementer", "#", 1).alias("path"), "kind", "member")
    breaks = breaks.groupBy("symbol_path", "symbol", "path").agg(F.array_sort(F.collect_set(F.struct("kind", "member"))).alias("breaks"))
    found = found.join(breaks, ["symbol_path", "symbol", "path"], "left").withColumnRenamed("kind", "use").filter("use <> 'heritage' OR size(breaks) > 0")

    paths = files.select("path").distinct().withColumn("in_change", F.lit(True))
    found = found.join(paths, "path", "left").withColumn("tier", reference_tier(F.col("path"), F.coalesce("in_change", F.lit(False)), F.col("symbol_path")))
    by, order = ["symbol_path", "symbol"], [F.col("tier"), F.col("path"), F.col("line_start"), F.col("use")]

    def rendered(rows: DataFrame, cap: int, prefix: str, note, ids: list[str]) -> DataFrame:
        shown = rank_and_cap(rows, by, order, cap)
        return shown.select(
            F.col("symbol_path").alias("file"), F.dense_rank().over(Window.partitionBy("symbol_path").orderBy("symbol", "rank")).cast("int").alias("pos"), F.lit("file").alias("source_kind"), "path", F.array("symbol").alias("symbols"), "line_start", "line_end",
            F.when(F.col("is_test"), "test").otherwise("code").alias("kind"), F.concat(note, "content").alias("content"), F.col("truncated").cast(_MARKER).alias("truncated"), chunk_id(prefix, *map(F.col, ids)).alias("id"),
        )

    value = F.col("use").isin("call", "heritage")
    calls = first_of(found.filter(value), [*by, "path", "line_start"], [F.col("use").desc()])
    return {
        "references": rendered(calls, VALUE_CAP, "sg", break_notes(F.col("symbol"), F.when(F.col("use") == "heritage", F.col("breaks"))), ["symbol", "path", "line_start"]),
        "type-references": rendered(found.filter(~value), TYPE_CAP, "sgt", type_note(F.col("use"), F.col("symbol")), ["symbol", "path", "line_start", "use"]),
    }


def review(files: DataFrame, contexts: dict[str, DataFrame], model: Model, threshold: float = 0.8, top: int = 10, title: str | None = None, description: str | None = None, branch: str | None = None) -> Review:
    """Prompts for all changed files at once, the model's answers, and the final signals.

    files: (path, pos, patch); contexts: chunk tables by provider.  An empty
    change gives empty tables and asks nothing.
    """
    parts = {k: v.select(*CHUNK) for k, v in contexts.items()}
    named = files.withColumnRenamed("path", "file")
    chunks = sections(in_provider_order(parts)) if parts else named.select("file").limit(0).withColumn("context", F.lit(""))
    text = lambda v: F.lit(v).cast("string")
    prompts = joined_context(named, chunks).withColumn("prompt", review_prompt(F.col("patch"), F.col("context"), text(title), text(description), text(branch)))
    answered = answer(prompts.select("file", "pos", "prompt"), model)
    parsed = parse_output(answered.withColumnsRenamed({"outcome": "asked", "error": "failed"}))
    won = F.col("asked") == "success"
    results = parsed.withColumns({"outcome": F.when(won, F.col("outcome")).otherwise("failure"), "error": F.coalesce("failed", "error")}).drop("asked", "failed")
    signals = finalise(normalise(explode_raw(results.withColumn("file_pos", F.col("pos")))), threshold, top)
    return Review(signals, results, prompts)
