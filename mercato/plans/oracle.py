"""All oracle SQL strings, each prefixed with the canonical view prelude."""

from __future__ import annotations

from mercato.plans import oracle_ext, oracle_search, oracle_social, oracle_store
from mercato.plans.oracle_views import PRELUDE

_MODULES = [oracle_store, oracle_search, oracle_social, oracle_ext]


def _full(body: str, recursive: bool) -> str:
    pre = PRELUDE.replace("WITH\n", "WITH RECURSIVE\n", 1) if recursive else PRELUDE
    return pre + body


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for mod in _MODULES:
        rec = getattr(mod, "RECURSIVE", set())
        for key, body in mod.SQL.items():
            out[key] = _full(body, key in rec)
    return out
