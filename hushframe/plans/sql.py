"""The scalar functions for use from SQL, as temporary SQL functions without Python.

Their bodies are made from the same fixed values as the column functions, and Spark
inlines them, so filters and pruning work through them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from hushframe.operators import policy, routing
from hushframe.operators.policy import DEFAULT_SETTINGS, Settings


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _case(branches: Iterable[tuple[str, str]], otherwise: str) -> str:
    cases = " ".join(f"WHEN {when} THEN {_text(then)}" for when, then in branches)
    return f"CASE {cases} ELSE {otherwise} END"


def functions(settings: Settings = DEFAULT_SETTINGS) -> dict[str, str]:
    """Signature and body of every function.

    ``tier_of`` and ``decision_of`` take an entity type (unknown and NULL ones are medium
    risk), ``host_of`` a URL, ``site_of`` a host, ``luhn_valid`` any text with digits and
    ``token_of`` an entity type and a number.
    """
    entities = [entity for entity, *_ in policy.CATALOGUE]
    known = sorted({*entities, *settings.overrides})
    tiers = {entity: tier for entity, _, tier, _ in policy.CATALOGUE}
    unknown = policy.MATRIX[policy.UNKNOWN_TIER, settings.mode]
    digits = "regexp_replace(number, '[^0-9]', '')"
    weight = (
        "(c, i) -> CASE WHEN i % 2 = 0 THEN ascii(c) - 48"
        " WHEN ascii(c) > 52 THEN 2 * (ascii(c) - 48) - 9 ELSE 2 * (ascii(c) - 48) END"
    )
    total = f"aggregate(transform(split(reverse({digits}), ''), {weight}), 0, (a, w) -> a + w)"
    hosts = [(f"host = {_text(h)} OR endswith(host, {_text('.' + h)})", s) for h, s in routing.SITES]
    return {
        "tier_of(entity STRING) RETURNS STRING": _case(
            ((f"entity = {_text(e)}", tiers[e]) for e in entities), _text(policy.UNKNOWN_TIER)
        ),
        "decision_of(entity STRING) RETURNS STRING": _case(
            ((f"entity = {_text(e)}", policy.decision_of(e, settings)) for e in known), _text(unknown)
        ),
        "host_of(url STRING) RETURNS STRING": "lower(try_parse_url(url, 'HOST'))",
        "site_of(host STRING) RETURNS STRING": _case(hosts, _text(routing.GENERIC)),
        "luhn_valid(number STRING) RETURNS BOOLEAN": f"CASE WHEN {digits} = '' THEN true ELSE {total} % 10 = 0 END",
        "token_of(entity STRING, idx BIGINT) RETURNS STRING": "concat('<', entity, '_', idx, '>')",
    }


def register(spark: SparkSession, settings: Settings = DEFAULT_SETTINGS) -> None:
    """Make the functions known to this session, under ``settings``; again to change them."""
    for signature, body in functions(settings).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
