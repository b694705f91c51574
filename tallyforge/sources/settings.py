"""Job settings: typed, validated, merged from file and command line."""

from __future__ import annotations

import re
from typing import Any

TRUE, FALSE = {"yes", "true", "t", "y", "1"}, {"no", "false", "f", "n", "0", ""}


def typed(value: str | None, kind: str) -> Any:
    """str, list (comma separated), int (other characters dropped; blank is
    0) or bool (blank is False; other words are an error)."""
    text = (value or "").strip()
    if kind == "int":
        return int(re.sub(r"[^\d+-]", "", text) or 0)
    if kind == "bool":
        if text.lower() in TRUE:
            return True
        if text.lower() in FALSE:
            return False
        raise ValueError(f"not yes or no: {value!r}")
    if kind == "list":
        return [x.strip() for x in text.split(",") if x.strip()]
    return text


def merged(spec: list[dict], file_rows: list[tuple[str, str]], overrides: dict[str, str] | None = None) -> tuple[dict, list[str]]:
    """(settings, violations). Repeated names of `multi` settings gather in a
    list; overrides win; required and choices are checked."""
    given: dict[str, list[str]] = {}
    for name, value in file_rows:
        given.setdefault(name, []).append(value)
    given |= {k: [v] for k, v in (overrides or {}).items()}
    out, wrong = {}, [f"unknown setting {n}" for n in given if n not in {s["name"] for s in spec}]
    for s in spec:
        values = given.get(s["name"], [s["default"]] if s.get("default") not in (None, "") else [])
        if not values and s.get("required"):
            wrong.append(f"missing {s['name']}")
        try:
            got = [typed(v, s.get("type", "str")) for v in values]
        except ValueError as e:
            wrong.append(f"{s['name']}: {e}")
            continue
        if s.get("choices") and any(v not in s["choices"] for v in got):
            wrong.append(f"{s['name']}: not among the choices")
        out[s["name"]] = got if s.get("multi") else got[-1] if got else typed(None, s.get("type", "str"))
    return out, wrong
