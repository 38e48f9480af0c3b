"""JSON documents of any depth: one spelling whatever the order of keys, digests of it, and keys taken out at every level."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that may stay although they look like internal ids.
PUBLIC_KEYS = ("public_id", "source_fighter_id")


def internal(key: str) -> bool:
    return key not in PUBLIC_KEYS and (key == "id" or key.endswith("_id"))


def _mapped(document: Column, change: Callable[[object], object]) -> Column:
    """A document walked by `change` and spelled with sorted keys and no blanks; null where it is null or no JSON, or holds a number that JSON has not."""

    def spell(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else json.dumps(change(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
            except (ValueError, RecursionError):
                return None

        for part in parts:
            yield part.map(one)

    return F.pandas_udf(spell, "string")(document)


def canonical(document: Column) -> Column:
    """The document in its one spelling: keys sorted at every level, no blanks. Equal contents, equal text."""
    return _mapped(document, lambda v: v)


def without_keys(document: Column, gone: Callable[[str], bool] = internal) -> Column:
    """The canonical document without the keys that `gone` names, at every level and within arrays."""

    def walk(v: object) -> object:
        if isinstance(v, dict):
            return {k: walk(x) for k, x in v.items() if not gone(k)}
        return [walk(x) for x in v] if isinstance(v, list) else v

    return _mapped(document, walk)


def without_nul(document: Column) -> Column:
    """The canonical document without NUL characters in keys and texts, which some stores refuse."""

    def walk(v: object) -> object:
        if isinstance(v, dict):
            return {k.replace("\x00", ""): walk(x) for k, x in v.items()}
        if isinstance(v, str):
            return v.replace("\x00", "")
        return [walk(x) for x in v] if isinstance(v, list) else v

    return _mapped(document, walk)


def digest(document: Column) -> Column:
    """SHA-256 of the canonical document, lower-case hex."""
    return F.sha2(canonical(document), 256)


def dedupe_key(kind: str, *parts: Column) -> Column:
    """kind and 40 digits of the digest of the parts in their order, each a JSON document, whatever the order of keys within; null if a part is."""
    listed = F.concat(F.lit("["), *[x for i, p in enumerate(parts) for x in ([F.lit(",")] if i else []) + [canonical(p)]], F.lit("]"))
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(listed, 256), 1, 40))
