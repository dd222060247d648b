"""What language models reply: the first JSON object in a text, and the lenses in it."""

from __future__ import annotations

import json

#: The lenses of a summary, and those of claim lists.
LENSES = ("task_summary", "patterns", "decisions_values")
CLAIM_LENSES = ("tasks", "patterns", "decisions_values", "learnings")


def first_object(text: str) -> dict:
    """The first balanced ``{…}`` of a text that can be read as JSON; ValueError without one."""
    decoder, at = json.JSONDecoder(), text.find("{")
    failed = None
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
            return found
        except json.JSONDecodeError as error:
            failed = failed or error
            at = text.find("{", at + 1)
    if failed and text.count("}") and text.rfind("}") > text.find("{"):
        raise ValueError(str(failed))
    raise ValueError("no balanced JSON object found in model output")


def _required(text: str, keys: tuple[str, ...]) -> dict:
    found = first_object(text)
    missing = [k for k in keys if k not in found]
    if missing:
        raise KeyError(f"missing lens keys {missing}")
    return found


def lenses(text: str) -> dict[str, str]:
    found = _required(text, LENSES)
    return {k: str(found[k]) for k in LENSES}


def claim_lists(text: str) -> dict[str, list[str]]:
    found = _required(text, CLAIM_LENSES)
    for k in CLAIM_LENSES:
        if not isinstance(found[k], list):
            raise ValueError(f"lens {k!r} must be a JSON array, not {type(found[k]).__name__}")
    return {k: [str(c) for c in found[k]] for k in CLAIM_LENSES}


def cluster_name(text: str) -> str:
    name = str(first_object(text).get("name", "")).strip()
    if not name:
        raise ValueError("no cluster name in model output")
    return name
