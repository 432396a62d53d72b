"""A commit's tree, or the index, as a partitioned source: the driver names subtrees, tasks list and read them.

``spark.read.format("git_tree")`` with the options ``path`` (a repository that
driver and executors can reach), ``ref`` (HEAD), ``prefix`` (a folder),
``content`` (true: with each blob's bytes) and ``index`` (true: what is staged,
in place of a commit).  Rows are (ref, path, mode, oid[, bytes]) of blobs.
Filters on the path prune subtrees before anything of them is listed.
"""

from __future__ import annotations

import subprocess
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

#: Subtrees that the driver names at most, about; bytes of one folder's tree object that a task lists.
PARTITIONS, FOLDER_BYTES = 256, 1 << 20
#: Rows of a batch; objects asked for before their answers are read, so few that neither pipe can fill up.
ROWS, ASKED = 4_096, 512
BYTES = 16 << 20


def git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, "-c", "core.quotepath=false", *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")


@dataclass
class Folder:
    """Part ``part`` of ``parts`` of the blobs in a tree, or, if ``deep``, of those in all trees below it."""

    tree: str
    prefix: str
    deep: bool
    part: int = 0
    parts: int = 1


@dataclass
class Subtrees(InputPartition):
    """What one task lists; without folders all of the index."""

    folders: list[Folder] | None


def records(command: list[str]) -> Iterator[str]:
    """The NUL-ended records that a command writes, as they come."""
    with subprocess.Popen(command, stdout=subprocess.PIPE) as run:
        rest = b""
        while piece := run.stdout.read(1 << 16):
            *whole, rest = (rest + piece).split(b"\0")
            yield from (r.decode("utf-8", "replace") for r in whole)
    if run.returncode:
        raise RuntimeError(f"{' '.join(command)} ended with {run.returncode}")


class Objects:
    """One ``git cat-file --batch`` that answers in order, many requests at a time."""

    def __init__(self, repo: str):
        self.run = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def read(self, names: list[str]) -> Iterator[bytes | None]:
        """The bytes of each object; None where it is not there."""
        for a in range(0, len(names), ASKED):
            part = names[a : a + ASKED]
            self.run.stdin.write("".join(f"{n}\n" for n in part).encode())
            self.run.stdin.flush()
            for _ in part:
                head = self.run.stdout.readline().split()
                if not head:
                    raise RuntimeError("git cat-file ended")
                if head[-1] in (b"missing", b"ambiguous"):
                    yield None
                    continue
                yield self.run.stdout.read(int(head[2]))
                self.run.stdout.read(1)

    def close(self) -> None:
        self.run.stdin.close()
        self.run.stdout.close()
        self.run.wait()


class GitTree(DataSource):
    """Registered as ``git_tree``."""

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "ref string, path string, mode string, oid string" + (", bytes binary" if self._is("content") else "")

    def _is(self, option: str) -> bool:
        return self.options.get(option, "false").lower() == "true"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"], self.options.get("ref", "HEAD"), self.options.get("prefix", ""), self._is("content"), self._is("index"))


class Reader(DataSourceReader):
    def __init__(self, repo: str, ref: str, prefix: str, content: bool, index: bool):
        self.repo, self.ref, self.content, self.index = repo, ref, content, index
        self.prefix = prefix.strip("/") + "/" if prefix.strip("/") else ""
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take what filters on the path say about folders; Spark still applies each of them."""
        for f in filters:
            match f:
                case StringStartsWith(("path",), value) if value.startswith(self.prefix):
                    self.prefix = value[: value.rfind("/") + 1]
                case EqualTo(("path",), value):
                    self._one_of({value})
                case In(("path",), values):
                    self._one_of(set(values))
            yield f

    def _one_of(self, paths: set) -> None:
        paths = {p for p in paths if isinstance(p, str)}
        self.only = paths if self.only is None else self.only & paths

    def partitions(self) -> list[Subtrees]:
        """Folders, opened one by one from the root down; the driver sees names of folders, never of files."""
        if self.index:
            return [Subtrees(None)]
        commit = git(self.repo, "rev-parse", f"{self.ref}^{{commit}}").strip()
        wanted = [self.prefix] if self.only is None else sorted({p[: p.rfind("/") + 1] for p in self.only if p.startswith(self.prefix)})
        front = deque((tree, f) for f in wanted if (tree := self._tree(commit, f)))
        flat = []
        while front and (self.only is not None or len(flat) + len(front) < PARTITIONS):
            tree, prefix = front.popleft()
            flat.append((tree, prefix))
            if self.only is None:  # else each path lies in its own folder
                below = [x.split("\t", 1) for x in git(self.repo, "ls-tree", "-d", "-z", tree).split("\0") if x]
                # a submodule is listed as a folder, but is a commit
                front += [(meta.split()[2], f"{prefix}{name}/") for meta, name in below if meta.split()[1] == "tree"]
        folders = self._split(flat) + [Folder(tree, prefix, True) for tree, prefix in front]
        n = min(PARTITIONS, len(folders)) or 1
        return [Subtrees(folders[i::n]) for i in range(n)]

    def _tree(self, commit: str, folder: str) -> str:
        """The tree of a folder, or nothing where there is none."""
        if not folder:
            return git(self.repo, "rev-parse", f"{commit}^{{tree}}").strip()
        found = [x.split("\t", 1) for x in git(self.repo, "ls-tree", "-d", "-z", commit, "--", folder.rstrip("/")).split("\0") if x]
        return next((meta.split()[2] for meta, name in found if name == folder.rstrip("/") and meta.split()[1] == "tree"), "")

    def _split(self, flat: list[tuple[str, str]]) -> list[Folder]:
        """The files that lie in folders themselves, a folder in parts where they are many; sizes come from one process."""
        asked = "".join(f"{tree}\n" for tree, _ in flat)
        sizes = subprocess.run(["git", "-C", self.repo, "cat-file", "--batch-check=%(objectsize)"], input=asked.encode(), capture_output=True, check=True).stdout.split()
        out = []
        for (tree, prefix), size in zip(flat, sizes, strict=True):
            parts = max(1, -(-int(size) // FOLDER_BYTES))
            out += [Folder(tree, prefix, False, i, parts) for i in range(parts)]
        return out

    def _listed(self, partition: Subtrees) -> Iterator[tuple[str, str, str]]:
        """(path, mode, oid) of the blobs of a partition."""
        base = ["git", "-C", self.repo, "-c", "core.quotepath=false"]
        if partition.folders is None:
            for record in records([*base, "ls-files", "-s", "-z", *(["--", self.prefix] if self.prefix else [])]):
                meta, path = record.split("\t", 1)
                mode, oid, stage = meta.split()
                if stage == "0" and mode != "160000":
                    yield path, mode, oid
            return
        for f in partition.folders:
            for i, record in enumerate(records([*base, "ls-tree", *(["-r"] if f.deep else []), "-z", f.tree])):
                meta, path = record.split("\t", 1)
                mode, kind, oid = meta.split()
                if kind == "blob" and i % f.parts == f.part:
                    yield f.prefix + path, mode, oid

    def read(self, partition: Subtrees) -> Iterator[pa.RecordBatch]:
        names = ["ref", "path", "mode", "oid"] + ["bytes"] * self.content
        objects = Objects(self.repo) if self.content else None

        def batch(rows: list[tuple], contents: list) -> pa.RecordBatch:
            columns = [pa.array([self.ref] * len(rows), pa.string()), *(pa.array(list(c), pa.string()) for c in zip(*rows))]
            return pa.RecordBatch.from_arrays([*columns, *([pa.array(contents, pa.binary())] if objects else [])], names=names)

        try:
            held: list[tuple] = []
            for row in self._listed(partition):
                if self.only is not None and row[0] not in self.only:
                    continue
                held.append(row)
                if len(held) == ROWS:
                    yield from self._filled(held, objects, batch)
                    held = []
            if held:
                yield from self._filled(held, objects, batch)
        finally:
            if objects:
                objects.close()

    def _filled(self, rows: list[tuple], objects: Objects | None, batch) -> Iterator[pa.RecordBatch]:
        """The rows as one batch, or with their contents as many as keep a batch's bytes few."""
        if objects is None:
            yield batch(rows, [])
            return
        done, contents, size = 0, [], 0
        for value in objects.read([oid for _, _, oid in rows]):
            contents.append(value)
            size += len(value or b"")
            if size > BYTES:
                yield batch(rows[done : done + len(contents)], contents)
                done, contents, size = done + len(contents), [], 0
        if contents:
            yield batch(rows[done:], contents)
