"""Options of an indexing run: defaults, and overrides where they are set."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    model: str = "gpt-4o-2024-11-20"
    toc_check_pages: int = 20
    max_pages_per_node: int = 10
    max_tokens_per_node: int = 20_000
    add_node_id: bool = True
    add_node_summary: bool = True
    add_doc_description: bool = False
    add_node_text: bool = False
    base_url: str | None = None
    num_ctx: int = 8192
    summary_token_threshold: int = 200


def _flag(value) -> bool:
    return value if isinstance(value, bool) else str(value).strip().lower() in ("yes", "true", "1")


def load(overrides: Mapping[str, object] | None = None, base: Config | None = None) -> Config:
    """base with the overrides that are set: null, unknown names, and numbers that aren't above 0 change nothing."""
    base = base or Config()
    kinds = {f.name: type(getattr(Config(), f.name)) for f in fields(Config)}
    found: dict[str, object] = {}
    for name, value in (overrides or {}).items():
        if value is None or name not in kinds:
            continue
        if kinds[name] is bool:
            found[name] = _flag(value)
        elif kinds[name] is int:
            try:
                number = int(str(value).strip())
            except ValueError:
                continue
            if number > 0:
                found[name] = number
        elif str(value).strip():
            found[name] = str(value)
    return replace(base, **found)
