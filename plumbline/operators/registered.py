"""What checks there are: names of cell and record checks, and packs held against them."""

from __future__ import annotations

from ..plans.rules import Rule, load_pack
from .checks import CELL_CHECKS
from .records import RECORD_CHECKS


def kind_of(name: str) -> str | None:
    """``cell``, ``record``, or None for a name that no check has."""
    return "cell" if name in CELL_CHECKS else "record" if name in RECORD_CHECKS else None


def is_registered(name: str) -> bool:
    return kind_of(name) is not None


def checked_pack(path: str | None = None) -> list[Rule]:
    """A rule pack all of whose checks exist; ValueError otherwise."""
    rules = load_pack(path, {*CELL_CHECKS, *RECORD_CHECKS})
    if unknown := sorted({r.check for r in rules if not is_registered(r.check)}):
        raise ValueError(f"no such checks: {', '.join(unknown)}")
    return rules
