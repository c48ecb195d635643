"""JSON documents in one canonical form: merged, without secrets, keys in order, compact, and their fingerprint."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A key with one of these in it is a secret.
SECRET_PARTS = ("api_key", "authorization", "cookie", "credential", "password", "private_key", "secret", "token")


def _secret(key: str) -> bool:
    plain = key.casefold().replace("-", "_")
    return any(part in plain for part in SECRET_PARTS)


def _over(base, change):
    """`change` laid over `base`; objects are merged key by key."""
    if not (isinstance(base, dict) and isinstance(change, dict)):
        return change
    return base | {k: _over(base.get(k), v) for k, v in change.items() if not _secret(k)}


def _clean(value):
    if isinstance(value, dict):
        return {k: _clean(v) for k, v in value.items() if not _secret(k)}
    return [_clean(v) for v in value] if isinstance(value, list) else value


def _canonical(base: str | None, change: str | None) -> str | None:
    held = [json.loads(t) if t else {} for t in (base, change)]
    if not all(isinstance(h, dict) for h in held):
        return None
    try:
        return json.dumps(_clean(_over(*held)), sort_keys=True, separators=(",", ":"), allow_nan=False)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def canonical(base: pd.Series, change: pd.Series) -> pd.Series:
    """Two JSON objects of any depth as one text: the second laid over the first, secrets dropped, keys sorted, ASCII, no blanks. Null or empty text is an empty
    object; null for what is no object, or holds NaN or an infinity. Text that is no JSON is an error."""
    return pd.Series([_canonical(b, c) for b, c in zip(base, change)], dtype=object)


def fingerprint(text: Column) -> Column:
    """The sha256 of a canonical text."""
    return F.sha2(text, 256)


def unknown_keys(change: Column, scalars: list[str], sections: dict[str, list[str]]) -> Column:
    """The keys of a JSON object that are neither in `scalars` nor a section, and `section.key` for keys that a section does not have; a section that is no object
    stands alone. Null text has none."""
    top = F.array_except(F.json_object_keys(change), F.array(*map(F.lit, [*scalars, *sections])))
    out = [F.coalesce(top, F.array().cast("array<string>"))]
    for name, keys in sections.items():
        part = F.get_json_object(change, f"$.{name}")
        own = F.array_except(F.json_object_keys(part), F.array(*map(F.lit, keys)))
        wrong = F.when(part.isNull(), F.array().cast("array<string>")).when(~part.startswith("{"), F.array(F.lit(name))).otherwise(F.transform(own, lambda k: F.concat(F.lit(f"{name}."), k)))
        out.append(wrong)
    return F.sort_array(F.concat(*out))
