"""Column functions: identifiers, canonical text, labels, predicates."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chronofold.names import DEFAULT_NAMING, SpanNaming


def strict_json(text: Column) -> Column:
    """The value when the text is exactly one JSON value, else null.

    The parser stops after the first value and ignores what follows. Inside brackets and
    inside braces, left-over text is an error in at least one of the two.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    single = listed.isNotNull() & F.variant_get(listed, "$[1]", "variant").isNull()
    return F.when(single, F.variant_get(named, "$.v", "variant"))


# A number with a fraction, an exponent or more digits than a long, an escape, or a constant.
UNUSUAL_JSON = r"[0-9][.eE][0-9+-]|[0-9]{18}|\\|NaN|Infinity"


@F.pandas_udf(StringType())
def _canonical_text(texts: pd.Series, fields: pd.Series) -> pd.Series:
    def one(text: str | None, field: str) -> str | None:
        try:
            value = json.loads(text)
            if field:
                value = value[field]
            return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        except (TypeError, ValueError, KeyError, RecursionError):
            return None

    return pd.Series([one(t, f) for t, f in zip(texts, fields, strict=True)], dtype=object)


def canonical_json(text: Column, field: str = "") -> Column:
    """Compact JSON with sorted keys, of the value or of one field of it; else null.

    Numbers keep their kind: ``1.0`` stays, long integers stay whole, exponents are
    written in one way. Texts that hold such a number, an escape or something the parser
    of variants does not take go through a small helper; all others stay in built-ins.
    """
    value = strict_json(text)
    if field:
        value = F.variant_get(value, f"$.{field}", "variant")
    usual = F.when(~text.rlike(UNUSUAL_JSON), F.to_json(value))
    return F.coalesce(usual, _canonical_text(F.when(usual.isNull(), text), F.lit(field)))


def fingerprint(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)


def key_fingerprint(key: Column) -> Column:
    """SHA-256 of an idempotency key; null when there is no key."""
    return F.when(key.isNotNull() & (key != ""), F.sha2(key, 256))


def nonzero_digest(text: Column, size: int) -> Column:
    """First ``size`` bytes of the SHA-256 in hex; the all-zero value becomes one."""
    head = F.substring(F.sha2(text, 256), 1, 2 * size)
    zero = "0" * (2 * size)
    return F.replace(head, F.lit(zero), F.lit(zero[:-1] + "1"))  # a condition would hash twice


def packed_hex(text: Column) -> Column:
    """A text as bytes; one of lower-case hex digits, as ids and hashes are, takes half its length.

    The first byte tells which; ``unpacked_hex`` gives back the same text. Equal texts have
    equal bytes, but the order of bytes is that of texts only among hex digits.
    """
    packed = F.concat(F.lit(b"\x01"), F.unhex(text))
    return F.when(F.lower(F.hex(F.unhex(text))) == text, packed).otherwise(F.concat(F.lit(b"\x00"), text.cast("binary")))


def unpacked_hex(packed: Column) -> Column:
    rest = F.substring(packed, 2, 2**31 - 1)
    return F.when(F.substring(packed, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def trace_id(run_id: Column, mode: Column, naming: SpanNaming = DEFAULT_NAMING) -> Column:
    return nonzero_digest(F.concat(F.lit(f"{naming.salt}:trace:"), mode, F.lit(":"), run_id), 16)


def span_id(
    run_id: Column, mode: Column, identity: Column, naming: SpanNaming = DEFAULT_NAMING
) -> Column:
    text = F.concat(F.lit(f"{naming.salt}:span:"), mode, F.lit(":"), run_id, F.lit(":"), identity)
    return nonzero_digest(text, 8)


def trace_hex(value: Column) -> Column:
    """A numeric trace id of up to 128 bits, given as decimal text, in 32 hex digits.

    No integer type holds 128 bits. The digits come in groups of eight; each step
    multiplies four limbs of 32 bits by 10**8, adds a group and carries. Text that is no
    number below 2**128 gives null.
    """
    text = value.cast("string")
    digits = F.lpad(F.regexp_replace(text, "^0+(?=[0-9])", ""), 40, "0")
    groups = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.substr(digits, i * 8 + 1, F.lit(8)).cast("bigint"))
    step, limb, zero = F.lit(100_000_000).cast("bigint"), F.lit(1 << 32), F.lit(0).cast("bigint")

    def add(limbs: Column, group: Column) -> Column:
        out, carry = [], group
        for i in range(5):
            now = limbs[f"l{i}"] * step + carry
            out.append(F.pmod(now, limb).alias(f"l{i}"))
            carry = quotient(now, 1 << 32)
        return F.struct(*out)

    start = F.struct(*[zero.alias(f"l{i}") for i in range(5)])
    parts = lambda s: [F.lower(F.lpad(F.hex(s[f"l{i}"]), 8, "0")) for i in (3, 2, 1, 0)]
    shown = F.aggregate(groups, start, add, lambda s: F.when(s["l4"] == 0, F.concat(*parts(s))))
    return F.when(text.rlike("^0*[0-9]{1,39}$"), shown)


def span_hex(value: Column) -> Column:
    """A 64-bit id held as a signed integer, in 16 hex digits; null stays null."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def effect_key(run_id: Column, activation_id: Column, effect: str) -> Column:
    return F.concat_ws(":", run_id, activation_id, F.lit(effect))


def receipt_token(key: Column, prefix: str = "rf_") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, 10))


def stable_id(prefix: str, *parts: Column) -> Column:
    """An id that a repeated task computes again, unlike a random one."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32))


def _fixed(ns: Column, unit: int, digits: int) -> Column:
    """``ns / unit`` as a double, rounded to ``digits`` places by its binary value.

    Half-way cases in decimal are decided by the double itself: below the half goes down,
    the half and above goes up. The product of double and unit is split in two exact parts
    to see on which side it lies.
    """
    step = unit // 10**digits
    low = ns - F.pmod(ns, F.lit(step))
    value = ns.cast("double") / F.lit(float(unit))
    scaled = value * F.lit(134217729.0)  # 2**27 + 1
    high = scaled - (scaled - value)
    rest = ns.cast("double") - high * F.lit(float(unit)) - (value - high) * F.lit(float(unit))
    twice = (ns - low) * 2
    up = (twice > step) | ((twice == step) & (rest <= 0))
    tenths = quotient(low, step) + F.when(up, 1).otherwise(0)
    scale = 10**digits
    return F.concat(
        quotient(tenths, scale).cast("string"),
        F.lit("."),
        F.lpad(F.pmod(tenths, F.lit(scale)).cast("string"), digits, "0"),
    )


def quotient(value: Column, by: int) -> Column:
    """Integer division; ``/`` would go through a double and lose low digits."""
    return F.call_function("div", value, F.lit(by))


def duration_label(ns: Column) -> Column:
    return (
        F.when(ns < 1_000, F.concat(ns.cast("string"), F.lit(" ns")))
        .when(ns < 1_000_000, F.concat(_fixed(ns, 1_000, 1), F.lit(" µs")))
        .when(ns < 1_000_000_000, F.concat(_fixed(ns, 1_000_000, 1), F.lit(" ms")))
        .otherwise(F.concat(_fixed(ns, 1_000_000_000, 2), F.lit(" s")))
    )


def ns_text(ns: Column) -> Column:
    return ns.cast("string")


def legacy_ns_text(number: Column) -> Column:
    """Nanoseconds that an old document stored as a JSON number."""
    return number.cast("decimal(20,0)").cast("string")


WINDOW_PAD_MS = 300_000


def window_start_ms(min_ns: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), quotient(min_ns, 1_000_000) - WINDOW_PAD_MS)


def window_end_ms(max_ns: Column) -> Column:
    return quotient(max_ns, 1_000_000) + WINDOW_PAD_MS


def window_limit(n: Column) -> Column:
    return F.greatest(F.lit(100).cast("bigint"), n * 4)


def is_hex(text: Column, digits: int) -> Column:
    return text.rlike(f"^[0-9a-f]{{{digits}}}$")


# Accepted forms of run and lineage ids.
RUN_ID_PATTERN = "^[a-zA-Z0-9][a-zA-Z0-9._-]{0,127}$"
LINEAGE_ID_PATTERN = "^[a-z0-9](?:[a-z0-9._-]{0,62}[a-z0-9])?$"
# Hosts that count as this machine.
LOOPBACK_HOSTS = ("127.0.0.1", "localhost", "[::1]")


def is_run_id(text: Column) -> Column:
    return text.rlike(RUN_ID_PATTERN)


def is_lineage_id(text: Column) -> Column:
    return text.rlike(LINEAGE_ID_PATTERN)


def url_part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def is_loopback_origin(url: Column) -> Column:
    """http, a loopback host, an explicit port, and nothing else."""
    path = F.coalesce(url_part(url, "PATH"), F.lit(""))
    return F.coalesce(
        (url_part(url, "PROTOCOL") == "http")
        & F.lower(url_part(url, "HOST")).isin(*LOOPBACK_HOSTS)
        & url.rlike("^[^/]*//(\\[[^\\]]*\\]|[^:/?#]*):[0-9]+/?$")
        & path.isin("", "/")
        & url_part(url, "USERINFO").isNull()
        & url_part(url, "QUERY").isNull()
        & url_part(url, "REF").isNull(),
        F.lit(False),
    )


def is_loopback_endpoint(url: Column) -> Column:
    """http or https to a loopback address, without credentials, query or fragment."""
    host = F.lower(url_part(url, "HOST"))
    return F.coalesce(
        url_part(url, "PROTOCOL").isin("http", "https")
        & ((host == "localhost") | host.rlike("^127\\.[0-9]+\\.[0-9]+\\.[0-9]+$") | (host == "[::1]"))
        & url_part(url, "USERINFO").isNull()
        & url_part(url, "QUERY").isNull()
        & url_part(url, "REF").isNull(),
        F.lit(False),
    )


def safe_endpoint(url: Column) -> Column:
    """The URL without credentials, query and fragment; a marker when it is no URL."""
    host = url_part(url, "HOST")
    port = F.nullif(F.regexp_extract(url, "^[^/]*//(?:[^@/]*@)?(?:\\[[^\\]]*\\]|[^:/?#]*):([0-9]+)", 1), F.lit(""))
    cleaned = F.concat(
        url_part(url, "PROTOCOL"),
        F.lit("://"),
        F.lower(host),
        F.coalesce(F.concat(F.lit(":"), port), F.lit("")),
        F.coalesce(url_part(url, "PATH"), F.lit("")),
    )
    return F.when(url.isNotNull(), F.coalesce(cleaned, F.lit("<invalid-endpoint>")))


def is_trace_url(url: Column, trace: Column) -> Column:
    return F.coalesce(
        (url_part(url, "PROTOCOL") == "http")
        & F.lower(url_part(url, "HOST")).isin(*LOOPBACK_HOSTS)
        & url_part(url, "USERINFO").isNull()
        & (url_part(url, "PATH") == F.concat(F.lit("/trace/"), trace))
        & url_part(url, "QUERY").isNull()
        & url_part(url, "REF").isNull(),
        F.lit(False),
    )


def trace_url(base: Column, trace: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/trace/"), trace)


def is_confined_path(path: Column) -> Column:
    """Relative POSIX path of 1 to 512 characters that never climbs out."""
    return F.coalesce(
        F.length(path).between(1, 512)
        & ~path.startswith("/")
        & ~path.rlike("^[a-zA-Z]:")
        & ~F.array_contains(F.split(path, "/"), "..")
        & ~path.contains("\\"),
        F.lit(False),
    )


def is_canonical_path(path: Column) -> Column:
    """Relative path spelled the one way a file listing would spell it."""
    parts = F.split(path, "/")
    return (
        ~path.startswith("/")
        & (path != "")
        & ~F.exists(parts, lambda p: p.isin("", ".", ".."))
    )


def event_detail(payload_json: Column) -> Column:
    return F.substring(payload_json, 1, 90)


# Prefix of attributes a document must not carry.
FORBIDDEN_PREFIX = "gen_ai."


def has_forbidden_attribute(text: Column) -> Column:
    return text.contains(FORBIDDEN_PREFIX)
