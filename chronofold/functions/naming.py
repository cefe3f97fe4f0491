"""Names of features: ``kind__calculator__key_value__...``, written and read back."""

from __future__ import annotations

import ast
from collections.abc import Mapping


def parameter_text(params: Mapping[str, object] | None) -> str:
    """``key_value`` parts sorted by key, joined by two underscores; strings in double quotes, the rest as Python writes it."""
    parts = []
    for key in sorted(params or {}):
        value = params[key]
        parts.append(f'{key}_"{value}"' if isinstance(value, str) else f"{key}_{value}")
    return "__".join(parts)


def feature_name(calculator: str, params: Mapping[str, object] | None) -> str:
    text = parameter_text(params)
    return f"{calculator}__{text}" if text else calculator


def parse_value(text: str) -> object:
    if text in ("nan", "inf", "-inf"):
        return float(text)
    return ast.literal_eval(text)


def parse_feature(name: str) -> tuple[str, str, dict[str, object] | None]:
    """(kind, calculator, parameters) of a feature's name; a name without two underscores is an error."""
    if not isinstance(name, str):
        raise TypeError(f"a column name must be a string: {name!r}")
    parts = name.split("__")
    if len(parts) < 2:
        raise ValueError(f"not the name of a feature: {name!r}")
    params = {}
    for part in parts[2:]:
        key, _, value = part.rpartition("_")
        params[key] = parse_value(value)
    return parts[0], parts[1], params or None
