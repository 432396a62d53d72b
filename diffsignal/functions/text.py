"""Text functions: queries for embedding, prompts, context blocks, JSON in model output, comment bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..models import LIMIT_TOLD, WAIT_TOLD

TRUNCATED = "\n// [truncated]"
# Titles of the context sections, in their order.
SECTIONS = {"references": "### Direct callers of changed symbols", "type-references": "### Type-shape dependents of changed symbols", "rag": "### Similar code"}
#: First line of every comment that the engine writes, by which it finds its own.
MARKER = "<!-- diffsignal:review -->"
SYSTEM_PROMPT = (
    "You review a change. Report only defects that a shown line exhibits, each with its file and lines. "
    'Answer with JSON alone: {"signals": [{"type": "bug|risk|test", "severity": "low|medium|high", "confidence": number, "file": string, '
    '"lineStart": number|null, "lineEnd": number|null, "message": string, "rationale": string|null, "suggestedFix": string|null}]}. '
    'A clean change gets {"signals": []}.'
)


def truncate_with_marker(content: Column, limit: int) -> Column:
    """Content of at most ``limit`` characters; what was cut ends in a marker line."""
    return F.when(F.length(content) <= limit, content).otherwise(F.concat(F.substring(content, 1, limit - len(TRUNCATED)), F.lit(TRUNCATED)))


def line_count(content: Column) -> Column:
    return F.size(F.split(content, "\n", -1))


def embedding_query(path: Column, patch: Column, hunks: Column | None = None, title: Column | None = None, limit: int = 4000) -> Column:
    """Header and change of one file, ``limit`` characters at most; the header is never cut."""
    header = F.concat_ws("\n", F.concat(F.lit("PR title: "), F.nullif(title, F.lit(""))) if title is not None else F.lit(None).cast("string"), F.concat(F.lit("File: "), path), F.lit("Changes:"))
    body = patch if hunks is None else F.when(F.size(F.coalesce(hunks, F.array())) > 0, F.array_join(F.transform(hunks, lambda h: h["content"]), "\n")).otherwise(patch)
    room = F.greatest(F.lit(limit) - F.length(header) - 1, F.lit(0))
    return F.concat(header, F.lit("\n"), F.substring(F.coalesce(body, F.lit("")), F.lit(1), room))


def review_prompt(diff: Column, context: Column, title: Column | None = None, description: Column | None = None, branch: Column | None = None) -> Column:
    """The user prompt; empty or missing title, description and branch leave no section."""
    part = lambda name, c: F.concat(F.lit(f"## {name}\n"), F.nullif(c, F.lit(""))) if c is not None else F.lit(None).cast("string")
    must = lambda name, c: F.concat(F.lit(f"## {name}\n"), F.coalesce(c, F.lit("")))
    return F.concat_ws("\n\n", part("PR Title", title), part("PR Description", description), part("Branch Name", branch), must("Pull Request Diff", diff), must("Retrieved Repository Context", context))


def line_suffix(start: Column, end: Column) -> Column:
    """Nothing, ``:s`` or ``:s-e``."""
    return F.when(start.isNull(), "").when(end.isNull() | (start == end), F.concat(F.lit(":"), start.cast("string"))).otherwise(F.concat(F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))


def context_block(path: Column, content: Column, start: Column, end: Column, kind: Column) -> Column:
    """One chunk in a prompt: its place, a test tag, its content and a blank line."""
    return F.concat(F.lit("// "), path, line_suffix(start, end), F.when(kind == "test", " (test)").otherwise(""), F.lit("\n"), content, F.lit("\n\n"))


def reference_header(symbol: Column, shown: Column, total: Column) -> Column:
    """How many references a symbol has, where not all are shown; else nothing."""
    return F.when(shown.isNotNull() & total.isNotNull(), F.concat(F.lit("// "), total.cast("string"), F.lit(" references to "), symbol, F.lit("; "), shown.cast("string"), F.lit(" shown\n"))).otherwise("")


def extract_json(text: Column) -> Column:
    """JSON in model output: the first fenced block, else from the first brace to the last, else the text."""
    fenced = F.trim(F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1), F.lit(" \t\n\r"))
    first, last = F.instr(text, "{"), F.length(text) - F.locate("}", F.reverse(text)) + 1
    braced = (first > 0) & (F.instr(text, "}") > 0)
    return F.when(fenced != "", fenced).when(braced, F.substring(text, first, F.greatest(last - first + 1, F.lit(0)))).otherwise(text)


def strip_fence(text: Column) -> Column:
    """The inside of a fenced block, else the trimmed text."""
    inner = F.regexp_extract(text, r"(?is)```(?:\w+)?\s*(.*?)```", 1)
    return F.trim(F.when(inner != "", inner).otherwise(text), F.lit(" \t\n\r"))


def chunk_id(prefix: str, *parts: Column) -> Column:
    """A reproducible id: prefix and 16 hex digits of SHA-1 over the NUL-joined parts."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(F.concat_ws("\0", *[p.cast("string") for p in parts])), 1, 16))


def break_notes(symbol: Column, breaks: Column) -> Column:
    """One line for each broken member (struct of kind and member), each with its line end; none without breaks."""
    note = lambda b: F.when(b["kind"] == "missing", F.concat(F.lit("// missing member: "), b["member"], F.lit(" (added to "), symbol, F.lit(")\n"))).otherwise(
        F.concat(F.lit("// stale member: "), b["member"], F.lit(" (shape changed on "), symbol, F.lit(")\n"))
    )
    return F.array_join(F.transform(F.coalesce(breaks, F.array().cast("array<struct<kind:string,member:string>>")), note), "")


def type_note(kind: Column, symbol: Column) -> Column:
    label = F.when(kind == "param", "parameter type").when(kind == "return", "return type").when(kind == "field", "field type")
    return F.concat(F.lit("// "), label, F.lit(" depends on "), symbol, F.lit("\n"))


def canonical_signature(calls: Column, constructs: Column, props: Column, text: Column) -> Column:
    """Call and construct signatures and sorted properties joined by bars; else ``type:`` with the text, else ``missing:``."""
    named = F.transform(F.map_entries(props), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    shown = F.when(F.size(props) > 0, F.concat(F.lit("props{"), F.array_join(F.array_sort(named), ";"), F.lit("}")))
    prefixed = lambda word, c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda s: F.concat(F.lit(word), s)), "|"))
    joined = F.concat_ws("|", prefixed("call", calls), prefixed("new", constructs), shown)
    return F.when(joined != "", joined).when(text.isNotNull(), F.concat(F.lit("type:"), text)).otherwise("missing:")


def comment_section(severity: Column, file: Column, message: Column, rationale: Column, fix: Column) -> Column:
    """One signal of a comment."""
    hint = F.when(F.coalesce(fix, F.lit("")) != "", F.concat(F.lit("\nSuggested fix: "), fix)).otherwise("")
    return F.concat(F.lit("### "), F.upper(severity), F.lit(" — "), file, F.lit("\n\n"), message, F.lit("\n\n"), F.coalesce(rationale, F.lit("")), F.lit("\n"), hint, F.lit("\n"))


def comment_body(sections: Column) -> Column:
    """A whole comment of ordered sections, marker first; without any it says so."""
    body = F.when(F.size(sections) > 0, F.array_join(sections, "\n---\n")).otherwise("No significant issues detected.")
    return F.concat(F.lit(f"{MARKER}\n\n## Review\n\n"), body, F.lit("\n"))


def inline_code(text: Column) -> Column:
    """Backtick spans and what lies between them, in order."""
    return F.filter(F.regexp_extract_all(text, F.lit("(`[^`]+`|[^`]+|`)"), F.lit(1)), lambda s: s != "")


def rate_limit_hint(message: Column) -> Column:
    """struct(limit, retry_seconds) told by a provider's rate-limit message; what is not told is null."""
    number = lambda p: F.nullif(F.regexp_extract(message, p, 1), F.lit("")).try_cast("double")
    return F.struct(number(LIMIT_TOLD).cast("long").alias("limit"), number(WAIT_TOLD).alias("retry_seconds"))


def file_stamp(iso: Column) -> Column:
    """A time stamp that may stand in a file name."""
    return F.replace(iso, F.lit(":"), F.lit("-"))


def clamp_input(text: Column, limit: int = 3000) -> Column:
    return F.substring(text, 1, limit)
