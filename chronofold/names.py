"""Fixed vocabulary of the journal and the naming rules of projected spans."""

from __future__ import annotations

from dataclasses import dataclass

# Event types a journal may hold today.
RUN_STARTED = "run_started"
ATTEMPT_STARTED = "attempt_started"
ATTEMPT_ABANDONED = "attempt_abandoned"
ATTEMPT_FAILED = "attempt_failed"
EFFECT_INTENT = "effect_intent"
EFFECT_COMPLETED = "effect_completed"
EFFECT_RESOLVED = "effect_resolved"
ACTIVATION_FINISHED = "activation_finished"
AWAITING_APPROVAL = "awaiting_approval"
APPROVAL_GRANTED = "approval_granted"
APPROVAL_DENIED = "approval_denied"
RUN_FINISHED = "run_finished"
RUN_FAILED = "run_failed"

LIVE_TYPES = (
    RUN_STARTED,
    ATTEMPT_STARTED,
    ATTEMPT_ABANDONED,
    ATTEMPT_FAILED,
    EFFECT_INTENT,
    EFFECT_COMPLETED,
    EFFECT_RESOLVED,
    ACTIVATION_FINISHED,
    AWAITING_APPROVAL,
    APPROVAL_GRANTED,
    APPROVAL_DENIED,
    RUN_FINISHED,
    RUN_FAILED,
)
# Readable in old journals, never valid in a version 2 run.
LEGACY_TYPES = (
    "step_started",
    "step_finished",
    "step_failed",
    "effect",
    "effect_replayed",
)

EFFECT_TYPES = (EFFECT_INTENT, EFFECT_COMPLETED, EFFECT_RESOLVED)
ATTEMPT_END_TYPES = (ATTEMPT_ABANDONED, ATTEMPT_FAILED, ACTIVATION_FINISHED)

JOURNAL_VERSION = 2
END_NODE = "__end__"
MODES = ("aware", "control")

# The fields that identify one effect across its facts.
IDENTITY_FIELDS = (
    "effect_id",
    "index",
    "label",
    "request_fingerprint",
    "adapter_version",
    "idempotency_key_fingerprint",
    "retry_safe",
)


@dataclass(frozen=True)
class SpanNaming:
    """Prefixes that enter span names, attributes, ids and service names."""

    attribute: str = "flow"
    salt: str = "chronofold"
    service: str = "chronofold"
    service_version: str = "1"

    def key(self, suffix: str) -> str:
        return f"{self.attribute}.{suffix}"

    def service_name(self, mode: str) -> str:
        return f"{self.service}-{mode}"


DEFAULT_NAMING = SpanNaming()
