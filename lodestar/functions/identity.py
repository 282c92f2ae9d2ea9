"""Identities: URNs of kind:value segments, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(value: Column) -> Column:
    """Only the percent sign and the slash are escaped, in this order."""
    return F.replace(F.replace(value, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))


def decode(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("%2F"), F.lit("/")), F.lit("%25"), F.lit("%"))


def mint(*segments: tuple[str, Column], scheme: str = "node") -> Column:
    """scheme://kind:value/kind:value from (kind, value column) pairs; null if a value is null."""
    parts: list[Column] = [F.lit(f"{scheme}://")]
    for i, (kind, value) in enumerate(segments):
        if not kind.strip() or ":" in kind or "/" in kind:
            raise ValueError(f"bad segment kind {kind!r}")
        parts += [F.lit(("/" if i else "") + kind + ":"), encode(value.cast("string"))]
    return F.concat(*parts)


def body(identity: Column) -> Column:
    return F.element_at(F.split(identity, "://", 2), -1)


def segments(identity: Column) -> Column:
    """array<struct<kind, value>> of the well-formed segments, values decoded."""
    parts = F.filter(F.split(body(identity), "/"), lambda p: p.rlike("^[^:]+:.+$"))
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, ":", 1).alias("kind"), decode(F.regexp_replace(p, "^[^:]+:", "")).alias("value")))


def segment(identity: Column, kind: str) -> Column:
    """The value of the first segment of ``kind``; null without one."""
    return F.get(F.filter(segments(identity), lambda s: s["kind"] == kind), F.lit(0))["value"]


def short_name(identity: Column) -> Column:
    return decode(F.regexp_replace(F.element_at(F.split(identity, "/"), -1), "^[^:]+:", ""))


def owning_app(identity: Column) -> Column:
    """The value of the first segment if its kind is app."""
    first = F.get(segments(identity), F.lit(0))
    return F.when(first["kind"] == "app", first["value"])


def node_label(identity: Column, kind: Column, name: Column) -> Column:
    return F.concat(F.coalesce(name, short_name(identity)), F.lit(" ("), kind, F.lit(")"))


def edge_label(kind: Column, source: Column, target: Column) -> Column:
    return F.concat(kind, F.lit(" "), short_name(source), F.lit(" → "), short_name(target))
