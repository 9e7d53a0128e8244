"""User-declared recognizers: a named pattern of an entity type, strictly checked before any plan is built."""

from __future__ import annotations

import re
from dataclasses import dataclass

from spanloom.schemas import ENTITY_TYPES

FIELDS = frozenset({"name", "pattern", "entity_type", "confidence", "group", "ignore_case"})
NAME = re.compile(r"[A-Za-z][A-Za-z0-9_\-]{0,63}")


@dataclass(frozen=True)
class Recognizer:
    """Matches of `pattern` or of its `group` are spans of `entity_type`; a group that is absent or empty gives none."""

    name: str
    pattern: str
    entity_type: str
    confidence: float = 0.9
    group: str | int | None = None
    ignore_case: bool = False

    def __post_init__(self) -> None:
        if not isinstance(self.name, str) or not NAME.fullmatch(self.name):
            raise ValueError(f"recognizer name {self.name!r} must be 1 to 64 letters, digits, _ or -, a letter first")
        if self.entity_type not in ENTITY_TYPES:
            raise ValueError(f"{self.name}: unknown entity type {self.entity_type!r}")
        if isinstance(self.confidence, bool) or not isinstance(self.confidence, int | float) or not 0 <= self.confidence <= 1:
            raise ValueError(f"{self.name}: confidence must be a number from 0 to 1")
        if not isinstance(self.pattern, str) or not self.pattern:
            raise ValueError(f"{self.name}: pattern must be a string")
        try:
            compiled = self.compiled()
        except re.error as wrong:
            raise ValueError(f"{self.name}: bad pattern: {wrong}") from wrong
        if compiled.match(""):
            raise ValueError(f"{self.name}: the pattern matches the empty string")
        if self.group is not None:
            known = not isinstance(self.group, bool) and (self.group in compiled.groupindex or (isinstance(self.group, int) and 0 <= self.group <= compiled.groups))
            if not known:
                raise ValueError(f"{self.name}: the pattern has no group {self.group!r}")

    @classmethod
    def from_dict(cls, data: dict) -> Recognizer:
        if not isinstance(data, dict):
            raise ValueError("a recognizer must be an object")
        if unknown := set(data) - FIELDS:
            raise ValueError(f"unknown recognizer fields: {sorted(unknown)}")
        if missing := {"name", "pattern", "entity_type"} - set(data):
            raise ValueError(f"missing recognizer fields: {sorted(missing)}")
        return cls(**{**data, "entity_type": str(data["entity_type"]).upper()})

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.IGNORECASE if self.ignore_case else 0)
