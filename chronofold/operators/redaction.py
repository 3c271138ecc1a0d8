"""The public form of an event payload: allowed fields, masked fields, nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold import names as N

_IDENTITY = N.IDENTITY_FIELDS
# Payload fields that may leave the journal, per event type.
PUBLIC_FIELDS = {
    N.RUN_STARTED: ("journal_schema_version", "workflow_version", "start_node", "activation_id"),
    N.ATTEMPT_STARTED: ("recovery",),
    N.EFFECT_INTENT: (*_IDENTITY, "started_at_ns", "retry_of_intent_seq"),
    N.EFFECT_COMPLETED: (*_IDENTITY, "source_intent_seq", "started_at_ns", "ended_at_ns"),
    N.EFFECT_RESOLVED: (
        *_IDENTITY,
        "source_effect_seq",
        "source_intent_seq",
        "started_at_ns",
        "ended_at_ns",
    ),
    N.ACTIVATION_FINISHED: ("next_node", "next_activation_id"),
    N.APPROVAL_GRANTED: ("at_ns",),
    N.APPROVAL_DENIED: ("at_ns",),
}
# Payload fields that leave it only as a mask, per event type.
MASKED_FIELDS = {
    N.RUN_STARTED: ("input",),
    N.ATTEMPT_ABANDONED: ("reason",),
    N.ATTEMPT_FAILED: ("error",),
    N.EFFECT_COMPLETED: ("result",),
    N.ACTIVATION_FINISHED: ("patch",),
    N.AWAITING_APPROVAL: ("state",),
    N.APPROVAL_GRANTED: ("by",),
    N.APPROVAL_DENIED: ("by",),
    N.RUN_FINISHED: ("state",),
    N.RUN_FAILED: ("reason",),
}
MASK = '{"redacted":true}'
SENSITIVE_FIELDS = ("by", "error", "input", "patch", "reason", "result", "state")


def public_payload(payload: str = "payload") -> Column:
    """JSON text of the public payload. A field present as null stays, an absent one does not.

    A payload that is no JSON has no public form: null.
    """
    mask = F.parse_json(F.lit(MASK))

    def form(whole: Column) -> Column:
        value = lambda f: F.variant_get(whole, f"$.{f}", "variant")
        shown = F.when(F.lit(False), F.lit(""))
        for kind in sorted({*PUBLIC_FIELDS, *MASKED_FIELDS}):
            public, masked = PUBLIC_FIELDS.get(kind, ()), MASKED_FIELDS.get(kind, ())
            parts = [
                (value(f) if f in public else F.when(value(f).isNotNull(), mask)).alias(f)
                for f in sorted({*public, *masked})
            ]
            shown = shown.when(F.col("type") == kind, F.to_json(F.struct(*parts)))
        return F.when(F.col(payload).isNull() | whole.isNotNull(), shown.otherwise("{}"))

    # A lambda's variable is parsed once; a column would be parsed again for every field.
    return F.get(F.transform(F.array(F.try_parse_json(payload)), form), F.lit(0))


UNREADABLE = "(unreadable)"


def unmasked_fields(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Sensitive fields that are present and not exactly the mask, one row each.

    A payload that is no JSON may hold anything: one row with UNREADABLE.
    """
    def fields(v: Column) -> Column:
        return F.array(
            *[
                F.when(F.to_json(F.variant_get(v, f"$.{f}", "variant")) != MASK, F.lit(f))
                for f in SENSITIVE_FIELDS
            ],
            F.when(F.col(payload).isNotNull() & v.isNull(), F.lit(UNREADABLE)),
        )

    found = F.get(F.transform(F.array(F.try_parse_json(payload)), fields), F.lit(0))
    return events.withColumn("field", F.explode(F.array_compact(found)))
