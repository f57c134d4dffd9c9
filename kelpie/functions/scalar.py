"""Strings, identifiers, colours and crops."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised_path(path: Column) -> Column:
    """Forward slashes, no leading ./ or doubled slashes; null for a path that leaves its root."""
    from ..operators.integrity import unsafe_path

    p = F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/{2,}", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"/(\./)+", "/"), r"^(\./)+", "")
    return F.when(~unsafe_path(p), p)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and 24 hex digits of the SHA-256 of the parts, NUL between them."""
    joined = parts[0].cast("string")
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("\0"), p.cast("string"))
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 24))


def camera_name(name: Column) -> Column:
    return F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), "^camera/", "")


def rgb_to_bytes(value: Column, eight_bit: bool) -> Column:
    """0 to 255 from 8-bit values in 16-bit fields, or from full 16-bit ones; 180 for missing."""
    scaled = value if eight_bit else F.rint(value / 257.0)
    return F.when(value.isNull(), 180).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), scaled)).cast("int"))


def size_text(n: Column) -> Column:
    """One decimal (halves to even) and the unit, B to TB, without a blank."""
    k, out = 1024.0, F.format_string("%.1fTB", F.bround(n / 1024.0**4, 1))
    for i, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(n < k ** (i + 1), F.format_string(f"%.1f{unit}", F.bround(n / k**i, 1))).otherwise(out)
    return out


def crop_valid(left: Column, top: Column, width: Column, height: Column, image_width: Column, image_height: Column, factor: int) -> Column:
    inside = (left >= 0) & (top >= 0) & (width > 0) & (height > 0) & (left + width <= image_width) & (top + height <= image_height)
    return inside & (width % factor == 0) & (height % factor == 0) & F.lit(factor in (1, 2, 4))


def canonical_json(value) -> bytes:
    """Sorted keys, no blanks, UTF-8: of metadata on the driver."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def signature(manifest: dict, field: str = "signature") -> str:
    """SHA-256 of a manifest without its own signature field."""
    return hashlib.sha256(canonical_json({k: v for k, v in manifest.items() if k != field})).hexdigest()


def signed(manifest: dict, field: str = "signature") -> dict:
    return manifest | {field: signature(manifest, field)}


def verify(manifest: dict, field: str = "signature") -> None:
    if manifest.get(field) != signature(manifest, field):
        raise ValueError("the manifest's signature doesn't match")
