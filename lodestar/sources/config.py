"""The declared estate: applications, their repositories and children."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession


def _scalar(text: str):
    text = re.sub(r"\s+#.*$", "", text).strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text.startswith("["):
        return [_scalar(x) for x in text.strip("[]").split(",") if x.strip()]
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(text.lower(), text)


def read_yaml(text: str):
    """The mappings, lists and plain values of block YAML: what an estate file is written in."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#") and x.strip() != "---"]

    def block(at: int, indent: int):
        out = [] if lines[at][1].startswith("- ") or lines[at][1] == "-" else {}
        while at < len(lines) and lines[at][0] == indent:
            said = lines[at][1]
            if isinstance(out, list):
                if not said.startswith("-"):
                    break
                rest = said[1:].strip()
                if re.match(r"[\w-]+:(\s|$)", rest):  # a mapping that begins on the item's line
                    inner = indent + said.index(rest)
                    lines[at] = (inner, rest)
                    value, at = block(at, inner)
                elif rest:
                    value, at = _scalar(rest), at + 1
                else:
                    value, at = block(at + 1, lines[at + 1][0])
                out.append(value)
                continue
            key, _, rest = said.partition(":")
            at += 1
            if re.sub(r"\s*#.*$", "", rest).strip():
                out[key.strip()] = _scalar(rest)
            elif at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("-")):
                out[key.strip()], at = block(at, lines[at][0])
            else:
                out[key.strip()] = None
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def load_applications(spark: SparkSession, text: str) -> DataFrame:
    """applications(name, repos, children, skip_if_unchanged, force) from block YAML, or JSON with comments and trailing commas; unknown keys and unnamed applications are dropped."""
    if text.lstrip().startswith(("{", "/")):
        bare = re.sub(r",(\s*[}\]])", r"\1", re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S))
        said = json.loads(bare)
    else:
        said = read_yaml(text)
    apps = [a for a in said.get("applications") or [] if str(a.get("name") or "").strip()]
    rows = [(a["name"], a.get("repos") or [], a.get("children") or [], bool(a.get("skipIfUnchanged")), bool(a.get("forceReanalysis"))) for a in apps]
    check(rows)
    return spark.createDataFrame(rows, "name string, repos array<string>, children array<string>, skip_if_unchanged boolean, force boolean")


def check(rows: list[tuple]) -> list[str]:
    """The names with children before parents; undeclared children and cycles are errors that name them."""
    children = {r[0]: r[2] for r in rows}
    order: list[str] = []
    state: dict[str, int] = {}

    def visit(name: str, path: list[str]) -> None:
        if state.get(name) == 2:
            return
        if state.get(name) == 1:
            raise ValueError("cycle: " + " -> ".join(path[path.index(name):] + [name]))
        state[name] = 1
        for child in children[name]:
            if child not in children:
                raise ValueError(f"{name} declares the unknown child {child}")
            visit(child, path + [name])
        state[name] = 2
        order.append(name)

    for name in children:
        visit(name, [])
    return order
