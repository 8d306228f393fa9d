"""Cache keys: by position, by service, and by content."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cache_key_position(file: Column, idx: Column) -> Column:
    return F.concat_ws("_", file, idx.cast("string"))


def cache_key_service(service: Column, key: Column) -> Column:
    return F.concat_ws("_", service, key)


def sorted_json(**fields: Column) -> Column:
    """Compact JSON of the fields, keys in sorted order at every level and nulls kept.

    The fields of a VARIANT object are ordered by name, whatever order they came in.
    """
    return F.to_json(F.to_variant_object(F.struct(*[fields[name].alias(name) for name in sorted(fields)])))


def cache_key_sha256(canonical: Column) -> Column:
    """Hash of request text that already has its keys sorted."""
    return F.sha2(canonical, 256)


def cache_key_md5(scalar: Column, canonical: Column) -> Column:
    """A scalar key is its own text; anything else is hashed from its sorted JSON."""
    return F.coalesce(scalar.cast("string"), F.md5(canonical))
