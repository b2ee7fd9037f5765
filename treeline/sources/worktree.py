"""Discovery of a Git worktree's Rust files as a DataFrame, with skips and a snapshot identity.

The driver lists names only; executors read the bytes. On a cluster the worktree
must lie on storage that all executors see.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators.ordering import running_sum
from treeline.operators.scratch import settled


class ScopeError(ValueError):
    def __init__(self, code: str, what: str = ""):
        super().__init__(f"{code}: {what}")
        self.code = code


# Default limits, their ranges, and the reasons for which a file is skipped.
DEFAULTS = {"max_file_bytes": 2 << 20, "max_files": 20_000, "max_source_bytes": 256 << 20, "text_bytes": 8192, "page_size": 100, "context_before": 2, "context_after": 2}
RANGES = {"max_file_bytes": (1, 16 << 20), "max_files": (1, 100_000), "max_source_bytes": (1, 512 << 20), "text_bytes": (0, 64 << 10), "page_size": (1, 1000), "context_before": (0, 20), "context_after": (0, 20)}
REASONS = ("oversized", "binary", "non_utf8", "unreadable", "symlink", "nested_repository", "non_utf8_path", "traversal_error")
PRUNED = frozenset((".git", "target"))
SNIFFED = 8192
FILES = "path string, source binary, mode int, length long, reason string, detail_code string, path_bytes_hex string"
#: Bytes of a path that is not UTF-8 which are shown in hex.
SHOWN_PATH = 128


def limits(**given: int) -> dict[str, int]:
    """Limits with defaults; unknown names and values out of range are refused."""
    for name, value in given.items():
        if name not in RANGES or not RANGES[name][0] <= value <= RANGES[name][1]:
            raise ScopeError("INVALID_PARAMS", name)
    return DEFAULTS | given


def resolve_root(path: str) -> str:
    """The canonical path of a worktree's root."""
    if not os.path.exists(path):
        raise ScopeError("PATH_NOT_FOUND", path)
    root = os.path.realpath(path)
    if not os.path.isdir(root) or not os.path.exists(os.path.join(root, ".git")):
        raise ScopeError("NOT_GIT_WORKTREE", root)
    return root


def glob_regex(pattern: str) -> str:
    """An anchored expression for a root-anchored positive glob: ``*`` and ``?`` stay inside a component, ``**`` crosses them."""
    if not pattern or pattern[0] in "!/" or pattern.endswith("/") or "{" in pattern:
        raise ScopeError("INVALID_GLOB", pattern)
    return f"^{_translated(pattern)}$"


def _translated(pattern: str) -> str:
    """A glob as an expression; braces hold alternatives, which may be nested."""
    out, k, open_braces = "", 0, 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k) and (k == 0 or pattern[k - 1] == "/"):
            out, k = out + "(?:[^/]+/)*", k + 3
        elif pattern.startswith("**", k):
            out, k = out + ".*", k + 2
        elif c == "*":
            out, k = out + "[^/]*", k + 1
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[":
            end = pattern.find("]", k + 2)
            if end < 0:
                raise ScopeError("INVALID_GLOB", pattern)
            inner = pattern[k + 1 : end].replace("\\", "\\\\")
            out, k = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif c == "\\" and k + 1 < len(pattern):
            out, k = out + re.escape(pattern[k + 1]), k + 2
        elif c == "{" or (open_braces and c in ",}"):
            open_braces += {"{": 1, ",": 0, "}": -1}[c]
            out, k = out + {"{": "(?:", ",": "|", "}": ")"}[c], k + 1
        else:
            out, k = out + re.escape(c), k + 1
    if open_braces:
        raise ScopeError("INVALID_GLOB", pattern)
    try:
        re.compile(out)
    except re.error:
        raise ScopeError("INVALID_GLOB", pattern) from None
    return out


@dataclass
class Scope:
    """Paths are components-wise prefixes, globs anchored patterns; both must admit a file."""

    paths: tuple[str, ...] | None = None
    globs: tuple[str, ...] | None = None

    @staticmethod
    def of(root: str, paths: list[str] | None = None, globs: list[str] | None = None) -> Scope:
        for p in paths or ():
            parts = p.split("/")
            if os.path.isabs(p) or ".." in parts or PRUNED & set(parts):
                raise ScopeError("OUTSIDE_ROOT", p)
            full = os.path.join(root, p)
            if not os.path.exists(full):
                raise ScopeError("PATH_NOT_FOUND", p)
            if os.path.realpath(full) != os.path.normpath(full):
                raise ScopeError("OUTSIDE_ROOT", p)
        for g in globs or ():
            re.compile(glob_regex(g))
        tidy = lambda xs: tuple(sorted(set(os.path.normpath(x) for x in xs))) if xs is not None else None
        return Scope(tidy(paths), tuple(sorted(set(globs))) if globs is not None else None)

    def admits(self, path: str) -> bool:
        a = self.paths is None or any(p == "." or path == p or path.startswith(p + "/") for p in self.paths)
        return a and (self.globs is None or any(re.match(glob_regex(g), path) for g in self.globs))

    def condition(self, column: str = "path"):
        """The same as a Catalyst predicate."""
        c, out = F.col(column), F.lit(True)
        if self.paths is not None:
            one = F.lit(False)
            for p in self.paths:
                one = one | (F.lit(True) if p == "." else (c == p) | c.startswith(p + "/"))
            out = out & one
        if self.globs is not None:
            one = F.lit(False)
            for g in self.globs:
                one = one | c.rlike(glob_regex(g))
            out = out & one
        return out


def _ignore_rules(folder: str, at: str) -> tuple[list[tuple[str, bool, bool]], bool]:
    """(expression over root-relative paths, only folders, negated) of one folder's .gitignore, and whether all of it was understood.

    A line that is no glob is left out; no line stops a walk.
    """
    try:
        with open(os.path.join(folder, ".gitignore"), "rb") as f:
            lines = f.read().decode("utf-8", "surrogateescape").split("\n")
    except FileNotFoundError:
        return [], True
    except OSError:
        return [], False
    out, good = [], True
    for line in lines:
        line = line.removesuffix("\r")
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        folders = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        try:
            body = _translated(line.lstrip("/"))
        except ScopeError:
            good = False
            continue
        if body:
            prefix = re.escape(at + "/") if at else ""
            out.append((f"^{prefix}{'' if anchored else '(?:.*/)?'}{body}$", folders, negated))
    return out, good


@dataclass
class Entry:
    """A name in the worktree: a file, or something the walk stops at (reason and detail)."""

    path: str
    status: os.stat_result | None
    reason: str | None = None
    detail: str | None = None


def walk(root: str) -> Iterator[Entry]:
    """Names of files in byte order, hidden ones included, and what the walk stops at.

    Symbolic links and nested repositories are policy boundaries wherever they are
    not ignored; folders and ignore files that can't be read are traversal errors.
    """

    def inside(folder: str, at: str, rules: list):
        own, understood = _ignore_rules(folder, at)
        rules = rules + own
        if not understood:
            yield Entry(at or ".", None, "traversal_error", "IGNORE_READ_FAILED")
        try:
            entries = sorted(os.scandir(folder), key=lambda e: os.fsencode(e.name))
        except OSError:
            yield Entry(".", None, "traversal_error", "WALK_FAILED")
            return
        for entry in entries:
            path = f"{at}/{entry.name}" if at else entry.name
            try:
                is_dir, status = entry.is_dir(follow_symlinks=False), entry.stat(follow_symlinks=False)
            except OSError:
                yield Entry(".", None, "traversal_error", "WALK_FAILED")
                continue
            ignored = False
            for rule, folders, negated in rules:
                if (is_dir or not folders) and re.match(rule, path):
                    ignored = not negated
            if ignored or entry.name in PRUNED:
                continue
            if entry.is_symlink():
                yield Entry(path, status, "symlink", "POLICY_BOUNDARY")
            elif is_dir and os.path.lexists(os.path.join(entry.path, ".git")):
                yield Entry(path, status, "nested_repository", "POLICY_BOUNDARY")
            elif is_dir:
                yield from inside(entry.path, path, rules)
            else:
                yield Entry(path, status)

    yield from sorted(inside(root, "", []), key=lambda e: os.fsencode(e.path))


def _is_text(path: str) -> bool:
    try:
        path.encode()
    except UnicodeEncodeError:
        return False
    return True


@dataclass
class Discovery:
    """Files within the limits (reason null: eligible), why the walk ended early, and what of the scope was covered."""

    files: DataFrame
    truncation: list[str]
    discovered: int
    scan_exhausted: bool

    def coverage(self) -> dict[str, bool]:
        """What a search over these files may claim."""
        found = {r["reason"] for r in self.files.where("reason is not null").select("reason").distinct().collect()}  # eight reasons
        complete = self.scan_exhausted and not found & {"traversal_error", "unreadable"}
        return {"scan_exhausted": self.scan_exhausted, "eligible_scan_complete": complete, "scope_exhaustive": self.scan_exhausted and not found - {"symlink", "nested_repository"}}


def _stable_read(root: str, path: str, most: int) -> tuple[bytes | None, int, int, str | None]:
    """(bytes, mode, length, reason): what a file holds, if it stays the same regular file while it is read."""
    full = os.path.join(root, path)
    same = lambda a, b: (a.st_dev, a.st_ino, a.st_mode, a.st_size, a.st_mtime_ns, a.st_ctime_ns) == (b.st_dev, b.st_ino, b.st_mode, b.st_size, b.st_mtime_ns, b.st_ctime_ns)
    mode, length = 0o644, 0
    try:
        before = os.lstat(full)
        mode, length = 0o755 if before.st_mode & 0o111 else 0o644, before.st_size
        if stat.S_ISLNK(before.st_mode):
            return None, mode, length, "symlink"
        if not stat.S_ISREG(before.st_mode) or os.path.commonpath([os.path.realpath(full), root]) != root:
            return None, mode, length, "unreadable"
        if before.st_size > most:
            return None, mode, length, "oversized"
        with open(full, "rb") as f:
            opened = os.fstat(f.fileno())
            raw = f.read(most + 1)
        if len(raw) > most:
            return None, mode, length, "oversized"
        if not same(before, opened) or not same(opened, os.lstat(full)) or len(raw) != opened.st_size:
            return None, mode, length, "unreadable"
    except OSError:
        return None, mode, length, "unreadable"
    return raw, mode, length, eligibility(raw, most)


def survey(spark: SparkSession, root: str, scope: Scope | None = None, **given: int) -> Discovery:
    """Discover a worktree: the driver lists names, executors read the bytes, once.

    The files are one snapshot: their table is written to the shared folder as they are
    read, so later actions see the same bytes whatever happens on the disk.
    Files beyond ``max_files`` in path order, and eligible ones from where their
    bytes exceed ``max_source_bytes``, are not in the result; both end the scan early
    and are named in ``truncation``.
    """
    bound, scope, root = limits(**given), scope or Scope(), os.path.realpath(root)
    rows, files, cut_short = [], 0, []
    for e in walk(root):
        if e.reason is None and not e.path.endswith(".rs"):
            continue
        if e.reason is None and not _is_text(e.path):
            e.reason, e.detail = "non_utf8_path", "PATH_ENCODING"
        if e.reason is None:
            if not scope.admits(e.path):
                continue
            if files == bound["max_files"]:
                cut_short.append("max_files: narrow paths/globs")
                break
            files += 1
        text = _is_text(e.path)
        rows.append((e.path if text else None, None if text else os.fsencode(e.path)[:SHOWN_PATH].hex(), e.status.st_size if e.status else None, e.reason, e.detail))
    listed = spark.createDataFrame(rows, "path string, hex string, length long, reason string, detail string")
    most = bound["max_file_bytes"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, shown, length, reason, detail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, mode = None, None
                if reason is None:
                    raw, mode, length, reason = _stable_read(root, path, most)
                    detail = reason and "FILE_INELIGIBLE"
                out.append((path, raw if reason is None else None, mode, length, reason, detail, shown))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in FILES.split(", ")])

    parts = max(1, min(len(rows) // 64 + 1, 4 * spark.sparkContext.defaultParallelism))
    found = settled(listed.repartition(parts).mapInArrow(read, FILES))  # one reading of the disk for all that follows
    eligible = found.where("reason is null")
    if (eligible.agg(F.sum("length")).first()[0] or 0) > bound["max_source_bytes"]:
        beyond = running_sum(eligible.select("path", "length"), ["path"], F.col("length"), "running").where(F.col("running") > bound["max_source_bytes"]).agg(F.min("path").alias("path")).first()["path"]
        if beyond is not None:
            cut_short.append("max_source_bytes: narrow paths/globs")
            found = found.where(F.col("path").isNull() | (F.col("path") < beyond) | (F.col("detail_code") == "POLICY_BOUNDARY"))
    return Discovery(found, cut_short, files, not cut_short)


def discover(spark: SparkSession, root: str, scope: Scope | None = None, **given: int) -> DataFrame:
    """One row per file within the limits and per boundary: path, source, mode, length, reason (null when it is eligible), detail_code, path_bytes_hex.

    Reasons follow their precedence: unreadable or symlink, oversized, then a NUL in
    the first 8,192 bytes (binary), then invalid UTF-8.
    """
    return survey(spark, root, scope, **given).files


def eligibility(raw: bytes, most: int) -> str | None:
    if len(raw) > most:
        return "oversized"
    if b"\0" in raw[:SNIFFED]:
        return "binary"
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return "non_utf8"
    return None


def skip_counts(files: DataFrame) -> DataFrame:
    """(reason, skipped, examples, examples_omitted) over the fixed domain, zeros included, three first paths each.

    Examples are kept three at a time in every task, so no reason's paths are gathered.
    """
    shown = F.coalesce("path", "path_bytes_hex")
    skipped = files.where(F.col("reason").isNotNull()).select("reason", shown.alias("path"))
    counted = skipped.groupBy("reason").agg(F.count("*").alias("skipped"))
    firsts, least = None, skipped
    for _ in range(3):  # the least path of each reason, then the least of the rest
        one = least.groupBy("reason").agg(F.min("path").alias("first"))
        firsts = one if firsts is None else firsts.unionByName(one)
        least = least.join(F.broadcast(one), "reason").where(F.col("path") > F.col("first")).drop("first")  # one row for each reason
    examples = firsts.groupBy("reason").agg(F.array_sort(F.collect_list("first")).alias("examples"))  # three for each reason
    domain = files.sparkSession.createDataFrame([(r,) for r in REASONS], "reason string")
    rows = domain.join(counted, "reason", "left").join(examples, "reason", "left")
    skipped, examples = F.coalesce("skipped", F.lit(0)), F.coalesce("examples", F.array())
    return rows.select("reason", skipped.alias("skipped"), examples.alias("examples"), (skipped - F.size(examples)).alias("examples_omitted"))


def admit_new_path(root: str, path: str, scope: Scope | None = None) -> str | None:
    """Why a file that doesn't exist yet could not be discovered at ``path``, by the walk's own policy; null if it could."""
    parts = path.split("/")
    if os.path.isabs(path) or {"", ".", ".."} & set(parts) or PRUNED & set(parts) or not _is_text(path):
        return "OUTSIDE_ROOT"
    if not path.endswith(".rs") or not (scope or Scope()).admits(path):
        return "OUTSIDE_SCOPE"
    if os.path.lexists(os.path.join(root, path)):
        return "DESTINATION_ALREADY_EXISTS"
    rules: list = []
    for k in range(len(parts)):
        at = "/".join(parts[:k])
        folder = os.path.join(root, at)
        if os.path.islink(folder) and k:
            return "OUTSIDE_ROOT"
        if k and os.path.lexists(os.path.join(folder, ".git")):
            return "NESTED_REPOSITORY"
        if os.path.lexists(folder) and not os.path.isdir(folder):
            return "OUTSIDE_ROOT"
        rules = rules + _ignore_rules(folder, at)[0]
        here, is_dir, ignored = "/".join(parts[: k + 1]), k + 1 < len(parts), False
        for rule, folders, negated in rules:
            if (is_dir or not folders) and re.match(rule, here):
                ignored = not negated
        if ignored:
            return "IGNORED_PATH"
    return None


def scope_manifest(root: str) -> tuple[list[tuple[str, str | None, int, int]], str]:
    """(folder, SHA-256 of its ignore file or null, device, inode) of every folder that the walk enters, and a digest of them all."""
    folders = {""}
    for e in walk(root):
        if e.reason is None:
            parts = e.path.split("/")[:-1]
            folders |= {"/".join(parts[: k + 1]) for k in range(len(parts))}
    rows = []
    for at in sorted(folders, key=os.fsencode):
        folder = os.path.join(root, at)
        try:
            with open(os.path.join(folder, ".gitignore"), "rb") as f:
                held = hashlib.sha256(f.read()).hexdigest()
        except OSError:
            held = None
        status = os.stat(folder)
        rows.append((at, held, status.st_dev, status.st_ino))
    return rows, hashlib.sha256("\n".join(repr((os.fsencode(a), *r)) for a, *r in rows).encode()).hexdigest()


def snapshot_id(files: DataFrame, root: str = "", scope: Scope | None = None) -> str:
    """A digest over length-prefixed fields in path order: skipped files first, then eligible ones; streamed, never gathered."""
    digest = hashlib.sha1()

    def put(raw: bytes) -> None:
        digest.update(len(raw).to_bytes(8, "big") + raw)

    put(root.encode())
    put(json.dumps([scope.paths if scope else None, scope.globs if scope else None]).encode())
    for row in files.where("reason is not null").orderBy("path", "path_bytes_hex", "reason").select("path", "path_bytes_hex", "mode", "reason").toLocalIterator():
        for part in (b"skipped", (row["path"] or row["path_bytes_hex"]).encode(), (row["mode"] or 0).to_bytes(4, "big"), row["reason"].encode()):
            put(part)
    for row in files.where("reason is null").orderBy("path").select("path", "mode", "source").toLocalIterator():
        for part in (b"eligible", row["path"].encode(), row["mode"].to_bytes(4, "big"), bytes(row["source"])):
            put(part)
    return "sha1:" + digest.hexdigest()
