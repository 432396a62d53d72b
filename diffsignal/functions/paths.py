"""Predicates and classifications of repository paths, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path segments that are never indexed.
DENY_SEGMENTS = ["node_modules", "dist", "build", "out", "coverage", "target", "vendor", ".git", ".github", ".gitlab", ".husky", ".vscode", ".idea", ".next", ".turbo", ".cache"]
# Stems of meta documents, denied with the extensions below.
DENY_STEMS = [
    "license", "licence", "copying", "copyright", "notice", "authors", "contributors", "maintainers", "contributing",
    "code-of-conduct", "security", "governance", "funding", "support", "changelog", "history", "news",
]
DOC_EXTENSIONS = ["", "md", "rst", "txt", "adoc"]
# Languages by extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "swift": "swift", "php": "php", "rb": "ruby",
    "cs": "csharp", "cpp": "cpp", "cc": "cpp", "c": "c", "h": "c", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "md": "markdown", "sh": "shell", "bash": "shell", "zsh": "shell", "sql": "sql", "html": "html", "css": "css", "scss": "scss",
}


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def segments(path: Column | str) -> Column:
    """The non-empty parts of a path; both slashes separate."""
    return F.filter(F.split(_column(path), r"[\\/]", -1), lambda s: s != "")


def basename(path: Column | str) -> Column:
    return F.try_element_at(segments(path), F.lit(-1))


def is_indexable(path: Column | str) -> Column:
    """False for empty paths, noise folders, dotfiles and meta documents; a null path is null."""
    parts, base = segments(path), basename(path)
    dotted = F.instr(base, ".") > 0
    ext = F.when(dotted, F.lower(F.substring_index(base, ".", -1))).otherwise("")
    stem = F.when(dotted, F.expr("null").cast("string")).otherwise(base)
    stem = F.coalesce(stem, F.substring(base, F.lit(1), F.length(base) - F.length(F.substring_index(base, ".", -1)) - 1))
    stem = F.replace(F.lower(stem), F.lit("_"), F.lit("-"))
    meta = F.exists(F.array(*map(F.lit, DENY_STEMS)), lambda s: (stem == s) | stem.startswith(F.concat(s, F.lit("-"))))
    denied = F.arrays_overlap(parts, F.array(*map(F.lit, DENY_SEGMENTS))) | base.startswith(".") | (ext.isin(DOC_EXTENSIONS) & meta)
    return F.when(_column(path).isNull(), None).otherwise((F.size(parts) > 0) & ~F.coalesce(denied, F.lit(False)))


def detect_kind(path: Column | str) -> Column:
    """doc, test, config or code, tried in this order on the lower-cased path."""
    low = F.lower(_column(path))
    any_of = lambda test, words: F.exists(F.array(*map(F.lit, words)), lambda w: test(low, w))
    ends, holds = (lambda a, b: F.endswith(a, b)), (lambda a, b: F.contains(a, b))
    doc = any_of(ends, [".md", ".rst"]) | any_of(holds, ["readme", "changelog", "contributing"])
    test = any_of(holds, ["/test", "__tests__"]) | any_of(ends, [".spec.ts", ".spec.js", ".test.ts", ".test.js"])
    config = any_of(ends, [".json", ".yml", ".yaml", ".toml", ".ini", ".env"])
    return F.when(doc, "doc").when(test, "test").when(config, "config").otherwise("code")


def detect_language(path: Column | str) -> Column:
    """The language of a path's extension, else null; a leading dot makes no extension."""
    ext = F.regexp_extract(F.coalesce(F.substring_index(_column(path), "/", -1), F.lit("")), r"[^.].*\.([^.]+)$", 1)
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.lower(ext))


def is_ts_file(path: Column | str) -> Column:
    return _column(path).rlike(r"\.(ts|tsx|mts|cts)$")


def is_ts_source(path: Column | str) -> Column:
    return is_ts_file(path) & ~_column(path).rlike(r"\.d\.(ts|mts|cts)$")


def is_project_file(path: Column | str) -> Column:
    """Files that a symbol graph needs: sources, tsconfig*.json, package.json."""
    return is_ts_file(path) | basename(path).rlike(r"^(tsconfig.*\.json|package\.json)$")


def chunker_of(path: Column | str) -> Column:
    """Which chunker reads a path: ``ts`` for .ts and .tsx in any case, else ``char``."""
    return F.when(F.lower(_column(path)).rlike(r"\.tsx?$"), "ts").otherwise("char")


def is_test_file(path: Column | str) -> Column:
    """The value-reference pass's rule for tests."""
    return _column(path).rlike(r"(^|/)(__tests__|tests?)/|\.(test|spec)\.[^/]+$")


def is_generated(path: Column | str) -> Column:
    """The value-reference pass's rule: coverage counts, declaration files do not."""
    return F.arrays_overlap(segments(path), F.array(*map(F.lit, ["dist", "build", "out", "coverage", "node_modules"])))


def is_generated_type(path: Column | str) -> Column:
    """The type-reference pass's rule: declaration files count, coverage does not."""
    return F.arrays_overlap(segments(path), F.array(*map(F.lit, ["dist", "build", "out", "node_modules"]))) | _column(path).rlike(r"\.d\.ts$")


def package_of(path: Column | str) -> Column:
    """``packages/<next>`` where the path has it, else its first segment."""
    parts = F.split(_column(path), "/", -1)
    at = F.array_position(parts, "packages").cast("int")
    return F.when((at > 0) & (at < F.size(parts)), F.concat(F.lit("packages/"), F.try_element_at(parts, at + 1))).otherwise(F.get(parts, F.lit(0)))


def relative_to(path: Column | str, root: str, absolute: bool = False) -> Column:
    """The path below ``root``; elsewhere null, or with ``absolute`` the path itself."""
    p, prefix = _column(path), root.rstrip("/") + "/"
    return F.when(p.startswith(prefix), F.substring(p, F.lit(len(prefix) + 1), F.length(p))).otherwise(p if absolute else F.lit(None))
