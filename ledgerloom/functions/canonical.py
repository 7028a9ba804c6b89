"""Canonical JSON: NFC strings and keys, keys in code-point order, no white space, UTF-8, no floats."""

from __future__ import annotations

import json
import unicodedata


class CanonicalError(ValueError):
    """A value that has no canonical form."""


def _nfc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def _clean(value: object, whole_floats: bool) -> object:
    if isinstance(value, str):
        return _nfc(value)
    if isinstance(value, dict):
        return {_nfc(k): _clean(v, whole_floats) for k, v in value.items()}
    if isinstance(value, list):
        return [_clean(v, whole_floats) for v in value]
    if isinstance(value, float):
        if whole_floats and value == value and abs(value) < 1e21 and value.is_integer():
            return int(value)
        raise CanonicalError(f"float {value}")
    return value


def canonical_json(value: object, profile: str = "sdk") -> bytes:
    """Canonical bytes of a JSON value. Profile node takes whole floats as integers and sorts keys by UTF-16 unit."""
    node = profile == "node"
    clean = _clean(value, node)
    try:
        if node:
            return _node_text(clean).encode("utf-8", "surrogatepass")
        return json.dumps(clean, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()
    except (TypeError, UnicodeEncodeError) as e:
        raise CanonicalError(str(e)) from e


def _node_text(value: object) -> str:
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_node_text(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_node_text, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def has_colliding_keys(value: object) -> bool:
    """Whether two keys of one object are equal after NFC."""
    if isinstance(value, dict):
        return len({_nfc(k) for k in value}) < len(value) or any(map(has_colliding_keys, value.values()))
    return isinstance(value, list) and any(map(has_colliding_keys, value))
