"""Signed page cursors that are bound to one normalised request and one snapshot."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import time
from dataclasses import dataclass, field


class CursorError(ValueError):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


# How long a series lives, and how many may be open.
LIFETIME, SERIES = 900, 32


def request_key(request: dict) -> str:
    """One digest for all spellings of a request: sorted keys, sorted scope, no cursor."""
    plain = {k: sorted(set(v)) if k in ("paths", "globs") and v is not None else v for k, v in request.items() if k != "cursor"}
    return hashlib.sha256(json.dumps(plain, sort_keys=True).encode()).hexdigest()


@dataclass
class Cursors:
    """Open series; tokens of other processes or changed requests are refused."""

    secret: bytes = field(default_factory=lambda: os.urandom(32))
    clock: object = time.monotonic
    open: dict[str, tuple[float, str, str]] = field(default_factory=dict)

    def _sign(self, body: bytes) -> str:
        return base64.urlsafe_b64encode(hmac.new(self.secret, body, hashlib.sha256).digest() + body).decode()

    def issue(self, request: dict, snapshot: str, after: list) -> str:
        now = self.clock()
        self.open = {k: v for k, v in self.open.items() if v[0] > now}
        if len(self.open) >= SERIES:
            raise CursorError("CURSOR_CAPACITY")
        name = os.urandom(12).hex()
        self.open[name] = (now + LIFETIME, request_key(request), snapshot)
        return self._sign(json.dumps([name, after]).encode())

    def resume(self, token: str, request: dict, snapshot: str) -> list:
        """The position to go on from, if signature, age, request and snapshot all agree."""
        try:
            raw = base64.urlsafe_b64decode(token.encode())
            mark, body = raw[:32], raw[32:]
            name, after = json.loads(body)
        except (ValueError, TypeError):
            raise CursorError("INVALID_CURSOR") from None
        if not hmac.compare_digest(mark, hmac.new(self.secret, body, hashlib.sha256).digest()):
            raise CursorError("INVALID_CURSOR")
        if name not in self.open or self.open[name][0] <= self.clock():
            raise CursorError("CURSOR_EXPIRED")
        _, key, seen = self.open[name]
        if key != request_key(request):
            raise CursorError("CURSOR_SCOPE_MISMATCH")
        if seen != snapshot:
            raise CursorError("STALE_CURSOR")
        return after


def search_status(stopped: str | None, eligible_complete: bool, exhausted: bool, omitted_diagnostics: int) -> dict:
    """has_more, scope_exhaustive and status of one page; ``stopped`` is None, ``page`` or ``work``."""
    more = True if stopped == "page" else None if stopped == "work" or not eligible_complete else False
    exhaustive = exhausted and stopped is None and eligible_complete
    return {"has_more": more, "scope_exhaustive": exhaustive, "status": "complete" if exhaustive and not omitted_diagnostics else "partial"}
