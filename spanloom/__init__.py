"""Spark-native detection and reversible pseudonymisation of sensitive text.

    made = sanitize(docs, get_policy("personal"))   # docs: doc_id, text
    back = restore(replies, vault_of(made))         # replies: doc_id, response
"""

from __future__ import annotations

from spanloom.functions.lexicon import Lexicon
from spanloom.operators.detect import detect
from spanloom.operators.gateway import LeakBlocked, echo
from spanloom.operators.gateway import run as gateway
from spanloom.operators.kernel import resolved
from spanloom.operators.leakscan import scan, verify
from spanloom.operators.policy import Policy, get_policy, load_policy, policy_from_dict
from spanloom.operators.recognizers import Recognizer
from spanloom.operators.restore import restore, validate_response
from spanloom.operators.risk import assess as assess_reid_risk
from spanloom.operators.sanitize import entity_report, preview, sanitize, vault_of
from spanloom.schemas import ENTITY_TYPES

__version__ = "0.2.0"

__all__ = [
    "ENTITY_TYPES",
    "LeakBlocked",
    "Lexicon",
    "Policy",
    "Recognizer",
    "__version__",
    "assess_reid_risk",
    "detect",
    "echo",
    "entity_report",
    "gateway",
    "get_policy",
    "load_policy",
    "policy_from_dict",
    "preview",
    "resolved",
    "restore",
    "sanitize",
    "scan",
    "validate_response",
    "vault_of",
    "verify",
]
