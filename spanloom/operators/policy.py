"""Policies: what happens to each entity type."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.operators.recognizers import Recognizer
from spanloom.schemas import ENTITY_TYPES

# Actions, and which types the built-in policies tokenise.
TOKENIZE, REDACT, KEEP = "tokenize", "redact", "keep"
CONTACT = "PERSON EMAIL PHONE ADDRESS".split()
IDENTIFIERS = "IBAN CREDIT_CARD GOV_ID PATIENT_ID CASE_ID ACCOUNT_ID MAC COORDINATES CRYPTO".split()
TOKENIZED = {
    "maximum": ENTITY_TYPES,
    "personal": [*CONTACT, *IDENTIFIERS, "DOB", "IP", "URL"],
    "medical": [*CONTACT, *IDENTIFIERS, "DOB", "DATE", "ORGANIZATION", "IP", "URL", "AGE", "TIME"],
    "legal": [*CONTACT, *IDENTIFIERS, "ORGANIZATION", "LOCATION", "DATE", "IP", "URL"],
}


@dataclass(frozen=True)
class Policy:
    name: str
    actions: dict[str, str] = field(default_factory=dict)
    default: str = KEEP
    recognizers: tuple[Recognizer, ...] = ()

    def __post_init__(self) -> None:
        names = [r.name for r in self.recognizers]
        if twice := {n for n in names if names.count(n) > 1}:
            raise ValueError(f"recognizers declared twice: {sorted(twice)}")
        for r in self.recognizers:
            if self.action_for(r.entity_type) == KEEP:
                raise ValueError(f"recognizer {r.name} finds {r.entity_type}, which policy {self.name} keeps")

    def action_for(self, entity_type: str) -> str:
        return self.actions.get(entity_type, self.default)

    def with_recognizers(self, recognizers) -> Policy:
        return replace(self, recognizers=(*self.recognizers, *recognizers))

    def action(self, entity_type: Column) -> Column:
        """The action as an expression over all types: the policy is at most 21 constants."""
        known = F.create_map(*[F.lit(x) for t in ENTITY_TYPES for x in (t, self.action_for(t))])
        return F.coalesce(F.try_element_at(known, entity_type), F.lit(self.default))


BUILTIN = {name: Policy(name, {t: TOKENIZE for t in types}, TOKENIZE if name == "maximum" else KEEP) for name, types in TOKENIZED.items()}


def get_policy(name: str) -> Policy:
    if name not in BUILTIN:
        raise ValueError(f"unknown policy {name!r}; choose one of {', '.join(sorted(BUILTIN))}")
    return BUILTIN[name]


def policy_from_dict(data: dict) -> Policy:
    """Strict: unknown types, actions, fields or shapes raise ValueError."""
    if not isinstance(data, dict) or set(data) - {"name", "default", "actions", "recognizers"}:
        raise ValueError("a policy is an object of name, default, actions and recognizers")
    allowed = (TOKENIZE, REDACT, KEEP)
    actions = data.get("actions", {})
    if not isinstance(actions, dict):
        raise ValueError("actions must be an object")
    made = {}
    for kind, action in actions.items():
        if str(kind).upper() not in ENTITY_TYPES:
            raise ValueError(f"unknown entity type {kind!r}")
        if action not in allowed:
            raise ValueError(f"unknown action {action!r}")
        made[str(kind).upper()] = action
    if data.get("default", KEEP) not in allowed:
        raise ValueError(f"unknown action {data['default']!r}")
    recognizers = data.get("recognizers", [])
    if not isinstance(recognizers, list):
        raise ValueError("recognizers must be a list")
    return Policy(str(data.get("name", "custom")), made, data.get("default", KEEP), tuple(Recognizer.from_dict(r) for r in recognizers))


def load_policy(path: str) -> Policy:
    with open(path, encoding="utf-8") as file:
        return policy_from_dict(json.load(file))


class Registry:
    """Named policies; a custom one may not take a built-in's name or one that is taken."""

    def __init__(self) -> None:
        self.policies = dict(BUILTIN)

    def register(self, policy: Policy) -> None:
        if policy.name in self.policies:
            raise ValueError(f"a policy named {policy.name!r} exists")
        self.policies[policy.name] = policy

    def get(self, name: str) -> Policy:
        if name not in self.policies:
            raise ValueError(f"unknown policy {name!r}")
        return self.policies[name]
