"""Scalar text rules of the engine, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_route(route: Column) -> Column:
    """Lower case, no query, placeholders of any style as {}, one leading and no trailing slash."""
    path = F.substring_index(F.lower(F.trim(route)), "?", 1)
    for pattern in (r"\$\{[^}]*\}", r"\{[^}]*\}", r":[A-Za-z_][A-Za-z0-9_]*"):
        path = F.regexp_replace(path, pattern, "{}")
    return F.concat(F.lit("/"), F.regexp_replace(path, "^/+|/+$", ""))


def strip_constraints(route: Column) -> Column:
    return F.regexp_replace(route, r"\{([A-Za-z0-9_]+)[^{}]*\}", r"{$1}")


def combine_routes(prefix: Column, path: Column) -> Column:
    """prefix/path with single slashes and no slash at either end."""
    both = F.concat_ws("/", F.coalesce(prefix, F.lit("")), F.coalesce(path, F.lit("")))
    return F.regexp_replace(F.regexp_replace(both, "/{2,}", "/"), "^/|/$", "")


def resolve_route(controller: Column, class_template: Column, method_template: Column, action: Column) -> Column:
    """Token substitution; an absolute method template overrides the class's; nothing given falls back to controller/action."""
    name = F.regexp_replace(controller, "Controller$", "")
    fill = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?i)\[controller\]", name), r"(?i)\[action\]", action)
    given = F.when(method_template.rlike("^~?/"), F.regexp_replace(fill(method_template), "^~?/", "")).otherwise(combine_routes(fill(class_template), fill(method_template)))
    return F.concat(F.lit("/"), F.when(class_template.isNull() & method_template.isNull(), F.concat_ws("/", name, action)).otherwise(given))


def next_route(path: Column) -> Column:
    """A page file's path below app/ as a route: groups dropped, [id] as {id}, [...rest] as {rest}."""
    inside = F.regexp_replace(F.regexp_replace(path, r"^(?:.*/)?app/", ""), r"/?[^/]*$", "")
    parts = F.filter(F.split(inside, "/"), lambda p: (p != "") & ~p.rlike(r"^\(.*\)$"))
    named = F.transform(parts, lambda p: F.regexp_replace(p, r"^\[+(?:\.\.\.)?([^\]]*)\]+$", r"{$1}"))
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def humanize(name: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[-_. ]+", " "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 20))


def title_words(name: Column) -> Column:
    parts = F.filter(F.split(name, "[-_]"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), " ")


def singular(word: Column) -> Column:
    return F.when(word.rlike("ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("s$"), F.regexp_replace(word, "s$", "")).otherwise(word)


def short_type(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def slug(path: Column) -> Column:
    """Lower case with everything but letters and digits as a hyphen."""
    return F.regexp_replace(F.lower(path), r"[^\p{L}\p{Nd}]", "-")


def classify_shape(setter: Column) -> Column:
    """The kind of filter a state's name suggests; null for what only opens and closes."""
    return (
        F.when(setter.rlike("Open$"), F.lit(None).cast("string"))
        .when(setter.rlike("^[sS]elected|Filters$"), F.lit("multi-select"))
        .when(setter.rlike("Tab$"), F.lit("tab"))
        .otherwise(F.lit("single-value")))


def use_case_phrase(verb: Column, subject: Column, by_id: Column) -> Column:
    thing = singular(subject)
    return (
        F.when((verb == "GET") & by_id, F.concat(F.lit("View a "), thing))
        .when(verb == "GET", F.concat(F.lit("List "), subject))
        .when(verb == "POST", F.concat(F.lit("Create a "), thing))
        .when(verb.isin("PUT", "PATCH"), F.concat(F.lit("Update a "), thing))
        .when(verb == "DELETE", F.concat(F.lit("Delete a "), thing))
        .otherwise(F.concat(verb, F.lit(" "), subject)))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def truncated(text: Column, most: int, marker: str = "…") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(marker))).otherwise(text)


def capped_list(items: Column, most: int) -> Column:
    """The first ``most`` items joined, and how many more there are."""
    shown = F.array_join(F.slice(items, 1, most), ", ")
    return F.when(F.size(items) > most, F.concat(shown, F.lit(", …and "), (F.size(items) - most).cast("string"), F.lit(" more"))).otherwise(shown)


def failure_reason(status: Column, detail: Column) -> Column:
    d = F.lower(F.coalesce(detail, F.lit("")))
    return (
        F.when(status.isin(401, 403), F.lit("Unauthorized")).when(status == 429, F.lit("RateLimited"))
        .when(status.isin(500, 502, 503, 504), F.lit("ServerError")).when(d.contains("timeout"), F.lit("Timeout"))
        .when(d.contains("empty"), F.lit("EmptyResponse")).when(status == 404, F.lit("NotFound")).otherwise(F.lit("Unknown")))


def backoff_ms(attempt: Column, base_ms: int = 500, cap_ms: int = 3000) -> Column:
    return F.least(F.lit(cap_ms).cast("double"), F.lit(base_ms) * F.pow(F.lit(2.0), attempt)).cast("long")


def render_template(template: Column, values: Column) -> Column:
    """{{key}} replaced from a map one after another; unknown keys stay."""
    return F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]))


def split_list(text: Column, separator: str = "[;,]") -> Column:
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")


def line_at(text: Column, offset: Column) -> Column:
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def summed(values: Column) -> Column:
    """The sums of a short array's numbers up to each of them."""
    empty = F.array().cast("array<int>")
    return F.aggregate(values, empty, lambda sums, x: F.array_append(sums, F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0)) + x))


def running_sum(rows: DataFrame, column: str, name: str, block: int = 256) -> DataFrame:
    """``rows`` with ``name``: the sums of an array column's numbers up to each of them.

    The array is summed up in blocks, the blocks' ends in turn, so its length counts once. Blocks are
    a column of their own, as an expression within a lambda is worked out again for every element.
    """
    of = F.col(column)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(of) - 1) / block).cast("int")), lambda b: summed(F.slice(of, b * block + 1, F.lit(block))))
    ends = summed(F.transform("blocks_", lambda b: F.coalesce(F.get(b, F.size(b) - 1), F.lit(0))))
    starts = F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size("blocks_"))
    placed = F.flatten(F.zip_with("blocks_", starts, lambda b, s: F.transform(b, lambda x: x + s)))
    rows = rows.withColumn("blocks_", F.when(F.size(of) > 0, blocks).otherwise(F.array().cast("array<array<int>>")))
    return rows.withColumn(name, placed).drop("blocks_")


def short_sha(commit: Column) -> Column:
    return F.substring(commit, 1, 7)


def operation_label(operation: Column, entity: Column, method: Column) -> Column:
    """What a database operation is shown as: the operation on its entity, else the method, else the operation."""
    return F.when(F.coalesce(entity, F.lit("")) != "", F.concat_ws(" ", F.upper(F.coalesce(operation, F.lit(""))), entity)).otherwise(F.coalesce(method, operation, F.lit("")))


def log_level(severity: Column) -> Column:
    return F.when(severity.isin("Error", "Warning", "Debug"), severity).otherwise("Information")


def order_number(value: Column, fallback: int = (1 << 31) - 1) -> Column:
    """A whole number to order by; what is none comes last, or first with a fallback of 0."""
    return F.coalesce(value.try_cast("int"), F.lit(fallback))


def relation_name(name: Column) -> Column:
    """A name that diagrams take: letters, digits and underscores."""
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")
