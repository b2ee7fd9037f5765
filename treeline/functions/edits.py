"""Splices in original byte coordinates, and unified diffs of their outcome."""

from __future__ import annotations

import difflib
from dataclasses import dataclass


class EditError(ValueError):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass(order=True, frozen=True)
class Edit:
    start: int
    end: int
    original: bytes
    replacement: bytes


def conflicts(edits: list[Edit]) -> bool:
    """Sorted neighbours may touch; an insertion conflicts with any other edit that starts at its byte."""
    ordered = sorted(edits)
    return any(a.end > b.start or (a.start == b.start and a.start == a.end) for a, b in zip(ordered, ordered[1:], strict=False))


def reconstruct(source: bytes, edits: list[Edit]) -> bytes:
    """Apply edits after checking their original bytes."""
    if conflicts(edits):
        raise EditError("OVERLAPPING_EDITS")
    out, at = [], 0
    for e in sorted(edits):
        if source[e.start : e.end] != e.original:
            raise EditError("SOURCE_CHANGED")
        out += [source[at : e.start], e.replacement]
        at = e.end
    return b"".join([*out, source[at:]])


#: Bytes of a path that have a short escape; other unusual ones are written in octal.
ESCAPES = {9: "\\t", 10: "\\n", 13: "\\r", 34: '\\"', 92: "\\\\"}


def quoted(path: str) -> str:
    """A path in quotes with C escapes, as patch headers carry it."""
    return '"' + "".join(ESCAPES.get(b, chr(b) if 32 <= b < 127 else f"\\{b:03o}") for b in path.encode()) + '"'


def diff_section(path: str, old: bytes | None, new: bytes, mode: int = 0o644) -> str:
    """One file's section of a Git patch with three lines of context; ``old`` None creates the file."""
    if not path or "\0" in path or any(part in ("", ".", "..") for part in path.split("/")):
        raise EditError("PATCH_ENCODING_FAILED")  # only normal paths below the root
    if old == new:
        return ""
    a, b = quoted(f"a/{path}"), quoted(f"b/{path}")
    head = [f"diff --git {a} {b}\n"]
    if old is None:
        head.append(f"new file mode 100{mode:o}\n")
    head += [f"--- {a if old is not None else '/dev/null'}\n", f"+++ {b}\n"]
    lines = lambda raw: (raw or b"").decode("utf-8").split("\n")
    keep = lambda parts: [x + "\n" for x in parts[:-1]] + ([parts[-1]] if parts[-1] else [])
    body = list(difflib.unified_diff(keep(lines(old)), keep(lines(new)), n=3))[2:]
    return "".join(head) + "".join(line if line.endswith("\n") else line + "\n\\ No newline at end of file\n" for line in body)


#: White space that a gap may lose.
_BLANK = b" \t\r\n\x0c"


def removal_gaps(source: bytes, removals: list[tuple[int, int]], kept: list[tuple[int, int]] = (), insertions: list[int] = ()) -> list[tuple[int, int, bytes]]:
    """(start, end, white space that stays) of every hole that removals would leave with too many empty lines.

    Removals with only white space between them make one hole, which takes in the
    white space around it but nothing of ``kept`` comments and attributes. One line
    break stays at the start of a file, two elsewhere, and the last line's indent.
    A hole with an insertion in it is left alone.
    """
    groups: list[list[tuple[int, int]]] = []
    for a, b in sorted(removals):
        if groups and groups[-1][-1][1] <= a and not source[groups[-1][-1][1] : a].strip(_BLANK):
            groups[-1].append((a, b))
        else:
            groups.append([(a, b)])
    out = []
    for group in groups:
        first, last = group[0][0], group[-1][1]
        start = len(source[:first].rstrip(_BLANK))
        end = len(source) - len(source[last:].lstrip(_BLANK))
        start = max([start, *(b for _, b in kept if b <= first)])
        end = min([end, *(a for a, _ in kept if a >= last)])
        if any(start <= at <= end for at in insertions):
            continue
        edges = [start, *(x for span in group for x in span), end]
        left = b"".join(source[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        most = 1 if start == 0 else 2
        lines = left.split(b"\n")
        if len(lines) - 1 > most:
            out.append((start, end, b"\n".join([*lines[:most], lines[-1]])))
    return out
