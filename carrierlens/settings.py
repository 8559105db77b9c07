"""What the caller chooses: a policy and limits. Both are literals of the plan, never data."""

from __future__ import annotations

from dataclasses import dataclass, fields
from enum import Enum


class Policy(Enum):
    BALANCED = "balanced-v1"
    LEGACY_VERDICT = "legacy-verdict-v1"
    CONTEXTUAL = "contextual-v1"

    @property
    def schema_version(self) -> int:
        return 4 if self is Policy.CONTEXTUAL else 3


_LEAST = {"max_chars": 0, "max_input_bytes": 1, "max_findings": 6, "max_output_bytes": 512}


@dataclass(frozen=True)
class Limits:
    max_chars: int = 1_048_576
    max_input_bytes: int = 4_194_304
    max_findings: int = 256
    max_output_bytes: int = 16_777_216

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if type(value) is not int:
                raise TypeError(f"{f.name} must be an int")
            if value < _LEAST[f.name]:
                raise ValueError(f"{f.name} must be at least {_LEAST[f.name]}")


def checked(policy: Policy, limits: Limits) -> None:
    if not isinstance(policy, Policy):
        raise TypeError("policy must be a Policy")
    if not isinstance(limits, Limits):
        raise TypeError("limits must be Limits")
