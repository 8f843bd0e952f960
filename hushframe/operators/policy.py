"""Risk tiers, decisions and settings.

Settings are a value that is passed along, never global.  They hold entity types
and decisions only, no text.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Entity catalogue, tiers, decisions and the decision matrix.
# ---------------------------------------------------------------------------
CATALOGUE = (
    # entity type, label, tier, description
    ("EMAIL_ADDRESS", "Email address", "high", "e.g. alice@example.com"),
    ("PHONE_NUMBER", "Phone number", "high", "e.g. +1 555 867 5309"),
    ("CREDIT_CARD", "Credit card", "high", "Validated with Luhn check"),
    ("IBAN_CODE", "IBAN", "high", "International bank account number"),
    ("SSN", "Social security number", "high", "US SSN format"),
    ("IP_ADDRESS", "IP address", "high", "IPv4 and IPv6"),
    ("CRYPTO", "Crypto address", "high", "Bitcoin, Ethereum addresses"),
    ("SECRET_KEY", "Secret key / token", "high", "Bearer, sk-, ghp_, passwords"),
    ("PERSON", "Person name", "medium", "Detected by NLP (English)"),
    ("LOCATION", "Location", "medium", "City, country, address (English)"),
    ("ORG", "Organisation", "medium", "Company, institution (English)"),
    ("DATE_OF_BIRTH", "Date of birth", "low", "Only when preceded by DOB label"),
)
TIERS = ("high", "medium", "low")
UNKNOWN_TIER = "medium"
DECISIONS = ("block", "auto_scrub", "warn", "notify", "allow")
DECISION_LABELS = {
    "allow": "Allow (skip)",
    "notify": "Notify (passive pill)",
    "warn": "Warn (banner, can override)",
    "auto_scrub": "Auto-scrub",
    "block": "Block (must act)",
}
MATRIX = {
    ("high", "strict"): "block",
    ("high", "permissive"): "auto_scrub",
    ("medium", "strict"): "auto_scrub",
    ("medium", "permissive"): "warn",
    ("low", "strict"): "warn",
    ("low", "permissive"): "notify",
}
# End of fixed values.

MODES = ("strict", "permissive")
_TIER_OF = {entity: tier for entity, _, tier, _ in CATALOGUE}


@dataclass(frozen=True)
class Settings:
    """Mode and per-entity overrides (entity type to decision)."""

    mode: str = "strict"
    overrides: dict[str, str] = field(default_factory=dict)


DEFAULT_SETTINGS = Settings()


def load_settings(stored: dict | None) -> Settings:
    """Settings from stored values, defaults where a value is missing."""
    return apply_settings(DEFAULT_SETTINGS, **(stored or {}))


def apply_settings(current: Settings, **update) -> Settings:
    """Take over the given settings; ``overrides`` is replaced as a whole."""
    known = {k: v for k, v in update.items() if k in ("mode", "overrides")}
    if "overrides" in known:
        known["overrides"] = dict(known["overrides"] or {})
    return replace(current, **known)


def set_override(current: Settings, entity_type: str, decision: str | None) -> Settings:
    """Set one override, or delete it with None or an empty decision."""
    overrides = {k: v for k, v in current.overrides.items() if k != entity_type}
    if decision:
        overrides[entity_type] = decision
    return replace(current, overrides=overrides)


def tier_of(entity_type: str) -> str:
    return _TIER_OF.get(entity_type, UNKNOWN_TIER)


def decision_of(entity_type: str, settings: Settings = DEFAULT_SETTINGS) -> str:
    """The decision for one entity type; an unknown decision counts as block."""
    override = settings.overrides.get(entity_type)
    if override is None:
        return MATRIX[tier_of(entity_type), settings.mode]
    return override if override in DECISIONS else "block"


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def _first_met(
    entity_types: Column, ordered: tuple[str, ...], of: dict[str, str], unknown: str
) -> Column:
    """The first of ``ordered`` that some entity type of the array belongs to."""
    result = F.lit(None).cast("string")
    for name in reversed(ordered):
        members = sorted(e for e, value in of.items() if value == name)
        met = F.arrays_overlap(entity_types, _strings(members)) if members else F.lit(False)
        if name == unknown:
            met = met | (F.size(F.array_except(entity_types, _strings(sorted(of)))) > 0)
        result = F.when(met, F.lit(name)).otherwise(result)
    return result


def _decisions(settings: Settings) -> dict[str, str]:
    return {e: decision_of(e, settings) for e in {*_TIER_OF, *settings.overrides}}


def entity_tier(entity_type: Column) -> Column:
    """``high``, ``medium`` or ``low``; unknown entity types are medium."""
    return _first_met(F.array(entity_type), TIERS, _TIER_OF, UNKNOWN_TIER)


def entity_decision(entity_type: Column, settings: Settings) -> Column:
    """The decision for one entity type."""
    unknown = MATRIX[UNKNOWN_TIER, settings.mode]
    return _first_met(F.array(entity_type), DECISIONS, _decisions(settings), unknown)


def top_tier(detections: Column) -> Column:
    """The highest tier among the detections, NULL without any."""
    return _first_met(detections["entity_type"], TIERS, _TIER_OF, UNKNOWN_TIER)


def message_decision(detections: Column, settings: Settings = DEFAULT_SETTINGS) -> Column:
    """The most restrictive decision over the detections, ``allow`` without any."""
    unknown = MATRIX[UNKNOWN_TIER, settings.mode]
    decision = _first_met(
        detections["entity_type"], DECISIONS, _decisions(settings), unknown
    )
    return F.coalesce(decision, F.lit("allow"))


def policy_table(spark: SparkSession, settings: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """The effective policy, one row per entity type of the catalogue."""
    rows = [
        (
            entity, label, tier, TIERS.index(tier), description,
            MATRIX[tier, settings.mode],
            settings.overrides.get(entity),
            decision_of(entity, settings),
            DECISIONS.index(decision_of(entity, settings)),
            DECISION_LABELS[decision_of(entity, settings)],
        )
        for entity, label, tier, description in CATALOGUE
    ]
    return spark.createDataFrame(
        rows,
        "entity_type string, label string, tier string, tier_rank int, "
        "description string, default_action string, override_action string, "
        "effective_action string, decision_rank int, action_label string",
    )
