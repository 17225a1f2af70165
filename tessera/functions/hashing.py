"""Content hashes: identifiers of paragraphs, ordered id lists and canonical JSON."""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def paragraph_id(title: Column, text: Column) -> Column:
    """Identifier made of the title and the text only."""
    return F.concat(F.lit("paragraph-"), F.sha2(F.to_json(F.array(title, text)), 256))


def object_id(prefix: str, *parts: Column) -> Column:
    """Prefix and 24 hexadecimal digits of the hash of the parts."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.to_json(F.array(*parts)), 256), 1, 24))


def canonical_json(value: Any) -> str:
    """JSON with sorted keys and no spaces; NaN and infinite numbers are refused."""

    def checked(v: Any) -> Any:
        if isinstance(v, float) and not math.isfinite(v):
            raise ValueError("canonical JSON holds finite numbers only")
        if isinstance(v, dict):
            return {str(k): checked(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [checked(x) for x in v]
        return v

    return json.dumps(checked(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_sha256(value: Any) -> str:
    """Hash of the canonical JSON."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()
