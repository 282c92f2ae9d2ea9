"""Extractors for scripts, and what all extractors share: table functions from sources to facts.

Lines count from 1. Rules about structure are joins and windows over the tokens of the scan
(``lexing``); rules about the form of one declaration are patterns over its code, which run in the JVM.
Neither sees comments, or what strings contain as code.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import lexing
from lodestar.operators.facts import SCHEMA, Properties as properties, Sources, extractor, facts, union
from lodestar.operators.merge import first_by
from lodestar.plans.lineage import few, stored

SCRIPT, JSX = lexing.SCRIPT, r"\.[tj]sx$"
#: Script files of which facts are told: declarations, tests and configuration are none.
TS = r"^(?!.*(?:\.d\.ts|\.(?:spec|test)\.[jt]sx?)$).*\.[jt]sx?$"


def occurrences(files: DataFrame, pattern: str, *groups: int, keep: tuple[str, ...] = (), rest: bool = False) -> DataFrame:
    """(path, line, g1, g2, …, kept columns) for every match of ``pattern`` in ``text``.

    Strings in groups are shown as they were. The text is marked at the matches by one pass of the pattern
    and cut at the marks; the pieces' line breaks, summed up along the array, give all
    lines, and the text itself does not go with the matches. A column ``from_line`` of ``files`` is the
    line that the text begins on. With ``rest`` each match has the piece up to the next one as ``text``
    and the line it begins on as ``from_line``.
    """
    first = F.col("from_line") if "from_line" in files.columns else F.lit(1)
    names, last = [f"g{i + 1}" for i in range(len(groups))], len(groups) + 1
    said = "".join(f"${g}{lexing.CUT}" for g in (0, *groups))
    pieces = F.split(F.regexp_replace(lexing.unmarked(F.col("text")), F.lit(pattern), F.lit(lexing.MATCH + said)), lexing.MATCH, -1)
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    cut = F.transform(F.slice("pieces_", F.lit(2), F.size("pieces_") - 1), lambda p: F.split(p, lexing.CUT, -1))
    rows = files.select("path", *keep, first.alias("first_"), pieces.alias("pieces_")).where(F.size("pieces_") > 1)
    rows = rows.select("path", *keep, "first_", breaks(F.get("pieces_", F.lit(0))).alias("head_"), cut.alias("cut_"))
    before = lambda i, part: breaks(F.get(F.get("cut_", i - 1), F.lit(part)))
    gaps = F.transform("cut_", lambda _, i: F.when(i == 0, F.col("head_")).otherwise(before(i, 0) + before(i, last)))
    rows = T.running_sum(rows.withColumn("gaps_", gaps), "gaps_", "lines_")
    each = rows.select("path", *keep, "first_", F.explode(F.arrays_zip("lines_", "cut_")).alias("m_"))
    part = lambda k: F.get("m_.cut_", F.lit(k))
    line = (F.col("first_") + F.col("m_.lines_")).cast("int")
    extra = [part(last).alias("text"), (line + breaks(part(0))).alias("from_line")] if rest else []
    return each.select("path", line.alias("line"), *[lexing.shown(part(i + 1)).alias(n) for i, n in enumerate(names)], *keep, *extra)


def stem(path: Column) -> Column:
    """The file's name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def whole_files(files: DataFrame, *keep: Column) -> DataFrame:
    return files.select("path", F.lit(1).alias("line"), *keep)


# ---- scripts by their tokens -----------------------------------------------------------------


def _back(k: int) -> Column:
    return F.get("back", F.lit(k))


def _ahead(k: int) -> Column:
    return F.get("ahead", F.lit(k))


def _unquoted(said: Column) -> Column:
    """A neighbour's text, of a string its content."""
    return F.regexp_replace(said, '^"', "")


def strings(t: DataFrame) -> DataFrame:
    return t.where("kind in ('s', 't')")


def calls(t: DataFrame) -> DataFrame:
    """The opening marks of calls: ``name`` as it is written, ``method`` its last part and ``on`` what it is called on."""
    called = t.where("text = '(' and kind = 'p' and name is not null and coalesce(lead, '') <> 'function'")
    return called.withColumn("method", F.substring_index("name", ".", -1)).withColumn("on", F.regexp_replace("name", r"\.?[^.]*$", ""))


def first_arguments(t: DataFrame) -> DataFrame:
    """(path, at, value): the first argument of each call that begins with a string."""
    return strings(t).where((_back(0) == "(") & (F.col("open") == F.col("i") - 1)).select("path", F.col("open").alias("at"), F.col("text").alias("value"))


def elements(t: DataFrame) -> DataFrame:
    """(path, i, line, element, open): the opening tags of components; type arguments stand right behind a name and are none."""
    return t.where((F.col("text") == "<") & (F.col("kind") == "p") & ~(F.col("glued") & _back(0).rlike(r"^\w"))).where(_ahead(0).rlike("^[A-Z]")).withColumn("element", _ahead(0))


def exported(t: DataFrame) -> DataFrame:
    """(path, i, line, name, form, default): what a file exports by name; the form is function, class, const, let or value."""
    place = F.array_position("back", "export").cast("int")
    words = ("function", "class", "const", "let", "async", "abstract", "default")
    named = t.where((F.col("kind") == "w") & (place > 0) & ~F.col("text").isin(*words)).where(F.forall(F.slice("back", F.lit(1), place - 1), lambda w: w.isin(*words)))
    form = F.when(_back(0).isin("function", "class", "const", "let"), _back(0)).otherwise("value")
    return named.select("path", "i", "line", F.col("text").alias("name"), form.alias("form"), (F.array_position("back", "default") > 0).alias("default"))


def owners(t: DataFrame) -> DataFrame:
    """(path, owner): the component that a file is about: its default export, or else the first it exports by name."""
    capital = exported(t).where(F.col("name").rlike("^[A-Z]"))
    return capital.groupBy("path").agg(F.min(F.struct(~F.col("default"), "i", "name"))["name"].alias("owner"))


def listed(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the different values of a group, as they come first."""
    first = rows.groupBy(*keys, F.col(value).alias("v_")).agg(F.min("i").alias("i_"))
    return first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i_", "v_"))), lambda x: x["v_"]), ", ").alias(name))


def constants(t: DataFrame) -> DataFrame:
    """(path, known): a file's names for literal strings, the last of each, as a map."""
    last = strings(t).where("into is not null").groupBy("path", F.col("into").alias("key")).agg(F.max_by("text", "i").alias("value"))
    return last.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("known"))


def filled(template: Column, known: Column) -> Column:
    """A template whose holes that only name a constant have its value; others stay."""
    pieces = F.split(template, r"\$\{")

    def closed(piece: Column) -> Column:
        name = F.regexp_replace(F.trim(F.substring_index(piece, "}", 1)), "^this\\.", "")
        rest = F.substr(piece, F.instr(piece, "}") + 1)
        return F.concat(F.coalesce(F.try_element_at(known, name), F.concat(F.lit("${"), F.substring_index(piece, "}", 1), F.lit("}"))), rest)

    return F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), closed), ""))


#: The endings of files that are no endpoints.
ASSETS = r"(?i)\.(css|scss|png|jpe?g|gif|svg|ico|woff2?|ttf|eot|json|txt|map|mjs|js)$"


def address(target: Column) -> Column:
    """The path on its server of what a call goes to, null for assets and where no step is literal; a base that is not known is not part of it."""
    local = F.regexp_replace(target, r"^(?:[A-Za-z][\w+.-]*:)?//[^/?]*", "")
    steps = F.filter(F.split(F.regexp_replace(local, r"^\$\{[^}]*\}", ""), "/"), lambda s: s != "")
    path = F.concat(F.lit("/"), F.array_join(steps, "/"))
    return F.when((F.size(F.filter(steps, lambda s: s.rlike(r"^\p{L}"))) > 0) & ~path.rlike(ASSETS), path)


def api_calls(t: DataFrame, chosen: DataFrame, confidence: float, owner: DataFrame) -> DataFrame:
    """ApiCall nodes, and CALLS from the files' owners, of the calls ``chosen(path, i, line, verb)``, by their first argument."""
    known = constants(t)
    named = t.where((F.col("kind") == "w") & (_back(0) == "(") & _ahead(0).isin(")", ",")).select("path", F.col("open").alias("at"), F.concat(F.lit("${"), "text", F.lit("}")).alias("value"))
    member = t.where((F.col("kind") == "w") & (_back(0) == ".") & (_back(1) == "this") & (_back(2) == "(") & _ahead(0).isin(")", ",")).select("path", F.col("open").alias("at"), F.concat(F.lit("${"), "text", F.lit("}")).alias("value"))
    given = union(first_arguments(t), named, member)
    met = chosen.join(given, [chosen["path"] == given["path"], chosen["i"] == given["at"]]).select(chosen["path"], "line", "verb", "value").join(known, "path", "left")
    url = met.withColumn("route", address(filled(F.col("value"), F.col("known")))).where("route is not null").withColumn("call", F.concat("verb", F.lit(" "), "route")).join(owner, "path", "left")
    return union(facts(url, "ApiCall", F.col("call"), properties(verb=F.col("verb"), route=F.col("route")), confidence), facts(url.where("owner is not null"), "CALLS", F.col("call"), F.col("owner"), 0.7))


def uses(t: DataFrame, states: DataFrame) -> DataFrame:
    """(path, state, field): the field that each of ``states(path, state)`` narrows, found where it is used.

    It is a field that a filter's predicate compares with it, or else what it is sent as: a query's
    parameter, a key that is appended or set, a key of an object. Of several the first in the file.
    """
    seen = t.where("kind = 'w'").join(states.select("path", F.col("state").alias("text")).distinct(), ["path", "text"])
    skip = F.when((_back(0) == ".") & (_back(1) == "this"), 2).otherwise(0)  # this.state
    left = lambda k: F.get("back", skip + k)
    compares = ("===", "!==", "==", "!=")
    field = F.when(left(0).isin(*compares) & (F.get("back", skip + 2) == "."), left(1)).when(_ahead(0).isin(*compares) & (_ahead(2) == "."), _ahead(3))
    key = F.when((F.size(F.filter("ahead", lambda a: a.isNotNull())) > 0) & _ahead(0).isin(",", "}") & (left(0) == ":"), left(1))
    filters = calls(t).where("method = 'filter'").select("path", F.col("i").alias("from_"), F.col("close").alias("to_"))
    compared = seen.withColumn("field", field).where("field is not null").join(filters, "path").where("i between from_ and to_").select("path", F.col("text").alias("state"), "i", "field", F.lit(0).alias("rank"))
    builders = calls(t).where("method in ('append', 'set')").select("path", F.col("i").alias("open"))
    appended = seen.where((left(0) == ",") & left(1).startswith('"')).withColumn("field", _unquoted(left(1))).join(builders, ["path", "open"]).select("path", F.col("text").alias("state"), "i", "field", F.lit(1).alias("rank"))
    keyed = seen.withColumn("field", _unquoted(key)).where("field is not null").select("path", F.col("text").alias("state"), "i", "field", F.lit(1).alias("rank"))
    parameter = r"[?&]([\w-]+)=\$\{\s*(?:this\.)?(\w+)\s*\}"
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(parameter), 1).alias("field"), F.regexp_extract_all("text", F.lit(parameter), 2).alias("state"))
    queried = t.where("kind = 't'").select("path", "i", F.explode(pairs).alias("p")).select("path", "p.state", "i", "p.field", F.lit(1).alias("rank")).join(states.select("path", "state").distinct(), ["path", "state"], "left_semi").select("path", "state", "i", "field", "rank")
    return first_by(union(compared, appended, keyed, queried), ["path", "state"], ["rank", "i", "field"]).select("path", "state", "field")


# ---- React ---------------------------------------------------------------------------------

#: React's own hooks, from its documentation.
BUILTIN_HOOKS = (
    "useActionState", "useCallback", "useContext", "useDebugValue", "useDeferredValue", "useEffect", "useFormStatus", "useId", "useImperativeHandle",
    "useInsertionEffect", "useLayoutEffect", "useMemo", "useOptimistic", "useReducer", "useRef", "useState", "useSyncExternalStore", "useTransition")
_HOOK = "^use[A-Z]"


def component_functions(t: DataFrame) -> DataFrame:
    """(path, i, line, name, default, at): exported functions and the place of their parameters, also within memo and forwardRef."""
    out = exported(t)
    marks = t.where("text = '(' and kind = 'p'")
    declared = marks.where("lead = 'function'").select("path", "name", F.col("i").alias("at"), F.col("then").alias("follows"))
    functions = out.where("form = 'function'").join(declared, ["path", "name"])
    given = first_by(marks.where("into is not null").select("path", F.col("into").alias("name"), "i", F.col("name").alias("by"), "then"), ["path", "name"], ["i"])
    plain = given.where("by is null or by = 'async'").select("path", "name", F.col("i").alias("at"), F.col("then").alias("follows"))
    wrapped = given.where(F.col("by").rlike(r"^(?:React\.)?(?:memo|forwardRef)$")).select("path", "name", F.col("i").alias("outside"))
    inner = first_by(marks.select("path", F.col("open").alias("outside"), F.col("i").alias("at"), F.col("then").alias("follows")), ["path", "outside"], ["at"])
    wrapped = wrapped.join(inner, ["path", "outside"]).select("path", "name", "at", "follows")
    values = out.where("form in ('const', 'let')").join(union(plain, wrapped), ["path", "name"])
    return union(functions, values.select(functions.columns)).where("follows in ('{', '=>', ':')").drop("follows")


@extractor(JSX)
def react_components(src: Sources) -> DataFrame:
    """Exported components: the kind that the file's name gives the default one, how it is rendered, what it is given, the
    hooks of the file, and of the default one the only heading and what is shown when its only list is empty."""
    t = src.script(JSX)
    made = component_functions(t).where((F.col("default") & ~F.col("name").rlike("^use")) | F.col("name").rlike("^[A-Z]"))
    hooks = listed(calls(t).where(F.col("method").rlike(_HOOK)), ["path"], "method", "hooks")
    client = t.where("kind = 's' and text = 'use client'").select("path", F.lit("client").alias("rendering")).distinct()
    words = t.where("kind = 'w'").where(_back(0).isin("(", "{", ","))
    given = union(words.select("path", F.col("open").alias("at"), "i", "text"), words.select("path", F.col("outer").alias("at"), "i", "text")).join(made.select("path", "at"), ["path", "at"], "left_semi")
    props = listed(given, ["path", "at"], "text", "props")
    behind = lambda rows, pattern: rows.join(src.like(JSX).withColumnRenamed("text", "code"), "path").select("path", lexing.shown(F.trim(F.regexp_extract(F.substr("code", F.col("stop") + 1), pattern, 1))).alias("said"))
    only = lambda rows, name: rows.groupBy("path").agg(F.count("*").alias("n"), F.max("said").alias(name)).where(F.col("n") == 1).drop("n")
    heads = behind(t.where((F.col("text") == "<") & _ahead(0).isin("h1", "h2")), r"^\s*h[12]\b[^>]*>\s*([^<{}]+?)\s*</")
    empties = behind(t.where((F.col("text") == "length") & (_back(0) == ".") & (F.slice("ahead", 1, 3) == F.array(F.lit("==="), F.lit("0"), F.lit("?")))), r"^[^?]*\?[^:]*?>\s*(\p{L}[^<>{}:]*?)\s*<")
    kind = F.when(F.lower(stem(F.col("path"))).isin("page", "layout", "loading", "error"), F.lower(stem(F.col("path")))).otherwise("component")
    rows = made
    for more, keys in ((hooks, ["path"]), (client, ["path"]), (props, ["path", "at"]), (only(heads.where("said <> ''"), "heading"), ["path"]), (only(empties, "empty"), ["path"])):
        rows = rows.join(more, keys, "left")
    about = dict(rendering=F.coalesce("rendering", F.lit("server")), props=F.col("props"), hooks=F.col("hooks"))
    return union(
        facts(rows.where("default"), "UIComponent", F.col("name"), properties(kind=kind, **about, displayName=F.col("heading"), emptyStateLabel=F.col("empty")), 0.85),
        facts(rows.where("not default"), "UIComponent", F.col("name"), properties(kind=F.lit("component"), **about), 0.85))


@extractor(TS)
def react_hooks(src: Sources) -> DataFrame:
    rows = exported(src.script(TS)).where(F.col("name").rlike(_HOOK) & F.col("form").isin("function", "const", "let"))
    return facts(rows, "Hook", F.col("name"), None, 0.85)


@extractor(JSX)
def react_hook_uses(src: Sources) -> DataFrame:
    """USES: a component and the hooks that its file calls, React's own ones left out."""
    t = src.script(JSX)
    rows = calls(t).where(F.col("method").rlike(_HOOK) & ~F.col("method").isin(*BUILTIN_HOOKS)).join(owners(t), "path")
    return facts(first_by(rows, ["path", "owner", "method"], ["i"]), "USES", F.col("method"), F.col("owner"), 0.7)


#: What objects that send requests are called, and their methods.
CLIENTS, VERBS = r"(?i)(?:axios|api|client|http)", ("get", "post", "put", "patch", "delete", "postFormData")


@extractor(TS)
def react_api_calls(src: Sources) -> DataFrame:
    """fetch with its method, axios and wrapped clients; CALLS from the component that the file is about."""
    t = src.script(TS)
    methods = strings(t).where((_back(0) == ":") & (_back(1) == "method")).select("path", F.col("outer").alias("i"), F.upper("text").alias("said"))
    fetched = calls(t).where("name = 'fetch'").select("path", "i", "line").join(first_by(methods, ["path", "i"], ["said"]), ["path", "i"], "left").select("path", "i", "line", F.coalesce("said", F.lit("GET")).alias("verb"))
    sent = calls(t).where(F.col("method").isin(*VERBS) & F.substring_index("on", ".", -1).rlike(CLIENTS) & ~F.col("on").startswith("this."))
    return api_calls(t, union(fetched, sent.select("path", "i", "line", F.upper(F.regexp_replace("method", "FormData$", "")).alias("verb"))), 0.75, owners(t))


@extractor(TS)
def react_contexts(src: Sources) -> DataFrame:
    rows = calls(src.script(TS)).where(F.col("method").isin("createContext", "createStore", "configureStore", "create") & F.col("into").isNotNull())
    return facts(rows, "Context", F.col("into"), properties(kind=F.when(F.col("method") == "createContext", "context").otherwise("store")), 0.8)


#: The components that guard what they enclose.
GUARDS = ("ProtectedRoute", "PrivateRoute")


def _routes(t: DataFrame, begins: Column, ends: Column, named: Column, confidence: float) -> DataFrame:
    """(path, line, route, weight, part, i): tokens dealt to the route that begins last before them; ``named`` is where its path is told."""
    order = Window.partitionBy("path").orderBy("i")
    parted = t.withColumn("part", lexing.latest(F.when(begins, F.col("i")).when(ends, F.lit(-1)), order)).where("part >= 0")
    said = F.when(named, F.struct("i", F.col("text").alias("route")))
    head = parted.groupBy("path", "part").agg(F.min(said)["route"].alias("route"), F.min("line").alias("at")).where("route is not null")
    route = F.when(F.col("route") == "", "(index)").otherwise(F.col("route"))
    return parted.join(head.withColumn("route", route), ["path", "part"]).withColumn("weight", F.lit(confidence))


@extractor(TS)
def react_routes(src: Sources) -> DataFrame:
    """Routes of route elements and of router tables: whether and for whom each is guarded, and RENDERS to the components in it."""
    t = src.script(TS)
    library = strings(t).where("text = 'react-router-dom'").select("path").distinct()  # sent to all, if few: only the tokens of such files are shuffled
    tag = (F.col("text") == "<") & (F.col("kind") == "p")
    in_jsx = _routes(t.join(few(library), "path", "left_semi"), tag & (_ahead(0) == "Route"), tag & (_ahead(0) == "/") & (_ahead(1) == "Routes"), F.col("kind").isin("s", "t") & (_back(0) == "=") & (_back(1) == "path"), 0.85)
    routers = calls(t).where("method in ('createBrowserRouter', 'createHashRouter')").select("path", F.col("i").alias("from_"), F.col("close").alias("to_"))
    inside = t.join(few(routers), "path").where("i between from_ and to_")
    table = _routes(inside.drop("from_", "to_"), (F.col("text") == "path") & (_ahead(0) == ":") & _ahead(1).startswith('"'), F.lit(False), F.col("kind").isin("s", "t") & (_back(0) == ":") & (_back(1) == "path"), 0.75)
    rows = stored(union(in_jsx, table))  # its windows pass over all tokens of the scripts: written once, not worked out at each of the looks below
    named = elements(rows).where("element <> 'Route'")
    braces = rows.where((F.col("text") == "{") & (_back(0) == "=") & (_back(1) == "allowedRoles")).select("path", "part", F.col("i").alias("outer"))
    inner = rows.where((F.col("kind").isin("w", "s")) & ~F.coalesce(_ahead(0), F.lit("")).isin(".", "?.")).join(braces, ["path", "part", "outer"])
    key = ["path", "part"]
    guarded = named.where(F.col("element").isin(*GUARDS)).select(*key, F.lit("yes").alias("guarded")).distinct()
    found = rows.select(*key, "route", F.col("at").alias("line"), "weight").distinct().join(guarded, key, "left").join(listed(inner, key, "text", "roles"), key, "left")
    shown = first_by(named.select(*key, F.col("at").alias("line"), "route", "element", "i"), [*key, "element"], ["i"])
    return union(
        facts(found, "Route", F.col("route"), properties(path=F.col("route"), protected=F.coalesce("guarded", F.lit("no")), roles=F.col("roles")), F.col("weight")), facts(shown, "RENDERS", F.col("element"), F.col("route"), 0.6))


@extractor(JSX)
def react_renders(src: Sources) -> DataFrame:
    """RENDERS: the component that a file is about and the components that its markup names."""
    t = src.script(JSX)
    each = elements(t).join(owners(t), "path").where("element <> owner").select("path", "owner", "element", F.lit(1).alias("line")).distinct()
    return facts(each, "RENDERS", F.col("element"), F.col("owner"), 0.6)


@extractor(TS)
def react_roles(src: Sources) -> DataFrame:
    """The roles of a ROLES constant or a role enumeration, by name with their value."""
    t = src.script(TS)
    tables = t.where("text = '{' and kind = 'p'").where((F.col("into") == "ROLES") | ((F.col("lead") == "enum") & F.col("name").rlike("Roles?$"))).select("path", F.col("i").alias("open"), F.col("line").alias("at"))
    each = strings(t).where(_back(0).isin(":", "=") & _back(1).isNotNull()).join(tables, ["path", "open"])
    return facts(each.drop("line").withColumnRenamed("at", "line"), "Role", _unquoted(_back(1)), properties(value=F.col("text")), 0.9)


#: What checks of roles are called, and how a permission is written.
ROLE_CHECKS, PERMISSION = r"^(?:use\w*(?:Role|Permission)\w*|hasAnyRole|hasRole|hasPermission)$", r"^[A-Z][A-Z_]*\.[A-Z][A-Z_]*$"


@extractor(TS)
def react_role_gates(src: Sources) -> DataFrame:
    """GATES: a file that checks roles and those it names; a file that itself defines a check is left out."""
    t = src.script(TS)
    declared = t.where((F.col("kind") == "w") & _back(0).isin("function", "const", "let")).select("path", F.col("text").alias("method"))
    checks = calls(t).where(F.col("method").rlike(ROLE_CHECKS)).select("path", "method").distinct()
    defining = declared.where(F.col("method").rlike(ROLE_CHECKS)).select("path").distinct()
    gated = checks.select("path").distinct().join(defining, "path", "left_anti")
    roles = t.where((F.col("kind") == "w") & (_back(0) == ".") & (_back(1) == "ROLES")).select("path", F.col("text").alias("role"))
    permissions = strings(t).where(F.col("text").rlike(PERMISSION)).select("path", F.col("text").alias("role"))
    each = union(roles, permissions).distinct().join(gated, "path", "left_semi").withColumn("line", F.lit(1))
    return facts(each, "GATES", stem(F.col("path")), F.col("role"), 0.6)


@extractor(TS)
def react_grids(src: Sources) -> DataFrame:
    """Grids and what they show: the column keys of a table library, or else the headings of each table."""
    t, code = src.script(TS, few=True), src.like(TS)
    library = calls(t).where("method = 'useReactTable'").select("path").distinct()
    keys = listed(strings(t).where((_back(0) == ":") & (_back(1) == "accessorKey")).join(library, "path", "left_semi"), ["path"], "text", "columns")
    grids = keys.withColumn("line", F.lit(1)).withColumn("owner", stem(F.col("path")))
    tables = occurrences(code.join(library, "path", "left_anti").withColumn("owner", stem(F.col("path"))), r"(?i)(<table\b[\s\S]*?</table\s*>)", 1, keep=("owner",))
    heads = F.transform(F.regexp_extract_all("g1", F.lit(r"(?i)<th\b[^>]*>([\s\S]*?)</th\s*>"), 1), lambda h: F.trim(F.regexp_replace(F.regexp_replace(h, "<[^>]+>", ""), r"\s+", " ")))
    shown = tables.withColumn("columns", F.array_join(F.array_distinct(F.filter(heads, lambda h: (h != "") & ~h.startswith("{"))), ", ")).where("columns <> ''")
    nth = F.row_number().over(Window.partitionBy("path").orderBy("line", "columns"))
    named = shown.withColumn("n", nth).withColumn("name", F.when(F.col("n") == 1, F.col("owner")).otherwise(F.concat("owner", F.lit(" (table "), "n", F.lit(")"))))
    return union(facts(grids, "DataGrid", F.col("owner"), properties(columns=F.col("columns")), 0.85), facts(named, "DataGrid", F.col("name"), properties(columns=F.col("columns")), 0.8))


#: The chart libraries by what is imported.
CHARTS = (("recharts", "recharts"), ("react-chartjs-2", "Chart.js"), ("chart.js", "Chart.js"))


@extractor(TS)
def react_charts(src: Sources) -> DataFrame:
    """Files that import a charting library, by the first that they name."""
    table = {name: (i, library) for i, (name, library) in enumerate(CHARTS)}
    rank = F.coalesce(*[F.when(F.col("text") == n, F.struct(F.lit(i).alias("r"), F.lit(lib).alias("library"))) for n, (i, lib) in table.items()])
    rows = strings(src.script(TS)).where(_back(0).isin("from", "import", "(") & F.col("text").isin(*table)).groupBy("path").agg(F.min(rank)["library"].alias("library")).withColumn("line", F.lit(1))
    return facts(rows, "AnalyticsChart", stem(F.col("path")), properties(library=F.col("library")), 0.8)


@extractor(TS)
def react_filters(src: Sources) -> DataFrame:
    """Filter states with their shape and the field they narrow; tab and view states only where the file fetches."""
    t = src.script(TS)
    pair = (F.col("kind") == "w") & (_back(0) == "[") & _back(1).isin("const", "let") & (_ahead(0) == ",") & (_ahead(2) == "]") & (_ahead(3) == "=") & ((_ahead(4) == "useState") | (_ahead(4) == "React"))
    states = first_by(t.where(pair).select("path", "line", "i", F.col("text").alias("state")), ["path", "state"], ["i"])
    filters = states.where(F.lower("state").contains("filter")).withColumn("shape", T.classify_shape(F.col("state"))).where("shape is not null").join(uses(t, states), ["path", "state"], "left")
    fetches = calls(t).where((F.col("method") == "fetch") | (F.lower("on").rlike("^axios") | (F.lower("name") == "axios")) | (F.col("method").isin("get", "post") & F.lower("on").rlike(r"api\w*$"))).select("path").distinct()
    tabs = states.where(F.lower("state").rlike("tab|view") & ~F.lower("state").contains("filter")).join(fetches, "path", "left_semi")
    return union(
        facts(filters, "Filter", F.col("state"), properties(component=stem(F.col("path")), shape=F.col("shape"), targetField=F.col("field")), 0.75),
        facts(tabs, "Filter", F.col("state"), properties(component=stem(F.col("path")), shape=F.lit("view-tab")), 0.6))


@extractor(TS)
def react_imports_exports(src: Sources) -> DataFrame:
    """Handlers that import, export, download or upload, whether the file polls a job, and file inputs without a handler."""
    t = src.script(TS, few=True)
    verb = F.regexp_extract("text", "^handle(Import|Export|Download|Upload)", 1)
    handlers = t.where((F.col("kind") == "w") & _back(0).isin("const", "let", "function")).withColumn("verb", verb).where("verb <> ''")
    waits = union(calls(t).where(F.lower("method").rlike("^(?:setinterval$|poll)")).select("path"), strings(t).where("text in ('Pending', 'Processing')").select("path")).distinct().withColumn("polls", F.lit("polls job status"))
    inputs = strings(t).where((F.col("text") == "file") & (_back(0) == "=") & (_back(1) == "type")).select("path", F.lit(1).alias("line")).distinct().join(handlers.select("path"), "path", "left_anti")
    return union(
        facts(handlers.join(waits, "path", "left"), "ImportExport", F.col("text"), properties(kind=F.col("verb"), **{"async": F.col("polls")}), 0.8),
        facts(inputs, "ImportExport", F.concat(stem(F.col("path")), F.lit(" file upload")), properties(kind=F.lit("Upload")), 0.6))


#: The beginnings of names of functions that check what is sent.
CHECKING = "(?i)^(?:validate|handlesubmit|checkform|onsubmit)"


@extractor(TS)
def react_form_fields(src: Sources) -> DataFrame:
    """Registered fields, messages that are assigned to a field's error, and, within functions that validate or submit, to any object's field."""
    t = src.script(TS)
    registers = calls(t).where("method = 'register'").select("path", "line", F.col("i").alias("at"))
    named = first_by(registers.join(first_arguments(t), ["path", "at"]), ["path", "value"], ["at"])
    assigned = strings(t).where((_back(0) == "=") & (_back(2) == ".")).select("path", "line", "i", _back(1).alias("field"), _back(3).alias("object"), F.col("text").alias("message"), "inside")
    known = F.col("object").isin("errors", "newErrors")
    errors = first_by(assigned.where(known), ["path", "field"], ["i"])
    inside = first_by(assigned.where(~known & F.col("inside").rlike(CHECKING)), ["path", "inside", "field"], ["i"])
    form = stem(F.col("path"))
    return union(
        facts(named, "FormField", F.col("value"), properties(form=form), 0.8), facts(errors, "FormField", F.col("field"), properties(form=form, validation=F.col("message")), 0.8),
        facts(inside, "FormField", F.col("field"), properties(form=form, validation=F.col("message")), 0.65))


@extractor(TS)
def react_default_routes(src: Sources) -> DataFrame:
    """ROUTES_TO: where a function of default routes sends each role."""
    t = src.script(TS).where(F.lower("inside").rlike(r"default\w*route"))
    label = F.when((F.col("text") == "case") & (F.col("kind") == "w"), F.when(_ahead(1) == ".", _ahead(2)).otherwise(_unquoted(_ahead(0))))
    order = Window.partitionBy("path", "inside").orderBy("i")
    told = t.withColumn("role", lexing.latest(label, order)).withColumn("case", F.sum(F.when(label.isNotNull(), 1)).over(order))
    sent = told.where((F.col("text") == "return") & (F.col("kind") == "w") & _ahead(0).startswith('"') & F.col("role").isNotNull())
    cases = told.where(label.isNotNull()).select("path", "inside", "case", F.col("line").alias("at"))
    first = first_by(sent.select("path", "inside", "case", "i", "role", _unquoted(_ahead(0)).alias("route")), ["path", "inside", "role"], ["i"]).join(cases, ["path", "inside", "case"]).withColumnRenamed("at", "line")
    return facts(first, "ROUTES_TO", F.col("route"), F.col("role"), 0.65)


# ---- Angular -------------------------------------------------------------------------------


def classes(t: DataFrame) -> DataFrame:
    """(path, owner): the first class that a file exports."""
    return first_by(exported(t).where("form = 'class'").select("path", "i", F.col("name").alias("owner")), ["path"], ["i"]).select("path", "owner")


@extractor(TS)
def angular_components(src: Sources) -> DataFrame:
    rows = occurrences(src.like(TS), r"""@Component\(\{[^}]*?selector:\s*["'`]([^"'`]+)["'`][\s\S]*?export\s+class\s+([A-Za-z0-9]+)""", 1, 2)
    return facts(rows, "UIComponent", F.col("g2"), properties(selector=F.col("g1")), 0.9)


@extractor(TS)
def angular_services(src: Sources) -> DataFrame:
    rows = occurrences(src.like(TS), r"@Injectable\([^)]*\)\s*export\s+class\s+([A-Za-z0-9]+)", 1)
    return facts(rows, "UIService", F.col("g1"), None, 0.9)


@extractor(TS)
def angular_guards(src: Sources) -> DataFrame:
    rows = occurrences(src.like(TS), r"export\s+(?:class|const)\s+([A-Za-z0-9]+)[^\n{]*?\b(CanActivate|CanActivateFn|CanMatchFn|Resolve|ResolveFn|HttpInterceptor|HttpInterceptorFn)\b", 1, 2)
    kind = F.when(F.col("g2").startswith("Can"), "Guard").when(F.col("g2").startswith("Resolve"), "Resolver").otherwise("Interceptor")
    return facts(rows, kind, F.col("g1"), properties(contract=F.col("g2")), 0.85, ("Guard", "Resolver", "Interceptor"))


_PRIMITIVES = ("string", "number", "boolean", "any", "unknown", "void", "object", "Date", "never", "symbol")


@extractor(TS)
def angular_dependencies(src: Sources) -> DataFrame:
    """DEPENDS_ON: a class and the types that its constructor is given, primitive ones left out."""
    t = src.script(TS)
    built = calls(t).where("name = 'constructor'").select("path", F.col("i").alias("open"), "line")
    typed = t.where((F.col("kind") == "w") & (_back(0) == ":")).select("path", "open", F.col("text").alias("type"))
    each = typed.join(built, ["path", "open"]).where(~F.col("type").isin(*_PRIMITIVES)).join(classes(t), "path").distinct()
    return facts(each, "DEPENDS_ON", F.col("type"), F.col("owner"), 0.8)


@extractor(TS)
def angular_form_fields(src: Sources) -> DataFrame:
    """Form controls with the validators of their own declaration, up to the next control."""
    rows = occurrences(src.like(TS), r"\b([a-z][A-Za-z0-9]*):\s*((?:new\s+FormControl\(|\[\s*(?=[^\]]*Validators)|this\.fb\.control\()(?:(?!\b[a-z][A-Za-z0-9]*:\s*(?:new\s+FormControl|\[|this\.fb))[^;}])*)", 1, 2)
    checks = F.array_join(F.array_distinct(F.regexp_extract_all("g2", F.lit(r"Validators\.(\w+)"), 1)), ", ")
    return facts(rows, "FormField", F.col("g1"), properties(form=stem(F.col("path")), validation=checks), 0.8)


@extractor(TS)
def angular_filters(src: Sources) -> DataFrame:
    """Filter fields of components, with their shape and the field they narrow; what only opens and closes is none."""
    t = src.script(TS)
    components = t.where((F.col("text") == "@Component") | ((F.col("text") == "Component") & (_back(0) == "@"))).select("path").distinct()
    named = t.where((F.col("kind") == "w") & F.col("text").rlike(r"^(?:[a-z]\w*(?:Filters?|Tab)|selected[A-Z]\w*)$") & ((_ahead(0) == "=") | (_ahead(0) == ":")) & _back(0).isin(";", "{", "}", "public", "private", "protected") & F.col("inside").isNull())
    states = first_by(named.select("path", "line", "i", F.col("text").alias("state")), ["path", "state"], ["i"]).join(components, "path", "left_semi")
    shaped = states.withColumn("shape", T.classify_shape(F.col("state"))).where("shape is not null").join(uses(t, states), ["path", "state"], "left").join(classes(t), "path")
    return facts(shaped, "Filter", F.col("state"), properties(component=F.col("owner"), shape=F.col("shape"), targetField=F.col("field")), 0.75)


@extractor(TS)
def angular_http(src: Sources) -> DataFrame:
    """Calls of the HTTP client below /api, with the class's fields put in; CALLS from the class."""
    t = src.script(TS)
    sent = calls(t).where(F.col("method").isin(*VERBS[:5]) & (F.substring_index("on", ".", -1) == "http")).select("path", "i", "line", F.upper("method").alias("verb"))
    return api_calls(t, sent, 0.8, classes(t)).where(F.col("name").contains(" /api"))


@extractor(r"\.(?:ts|html)$", tree=True)
def angular_template_tags(src: Sources) -> DataFrame:
    """RENDERS: a component's template file names other components' selectors; paths meet whatever their case."""
    c = angular_components(src).select(F.col("path").alias("owner_path"), F.col("name").alias("owner"), F.col("properties")["selector"].alias("selector"))
    urls = strings(src.script(r"\.ts$")).where((_back(0) == ":") & (_back(1) == "templateUrl")).select(F.col("path").alias("owner_path"), F.lower(F.concat(F.regexp_replace("path", "[^/]*$", ""), F.regexp_replace("text", r"^\./", ""))).alias("template"))
    tags = occurrences(src.like(r"\.html$"), r"<([a-z][a-z0-9]*-[a-z0-9-]+)", 1).select(F.lower("path").alias("template"), "line", F.col("g1").alias("selector"))
    met = c.select("owner_path", "owner").join(urls, "owner_path").join(tags, "template").join(c.select("selector", F.col("owner").alias("child")), "selector").where("child <> owner")
    return facts(met.withColumnRenamed("owner_path", "path"), "RENDERS", F.col("child"), F.col("owner"), 0.85)


@extractor(TS)
def angular_routes(src: Sources) -> DataFrame:
    """Routes with their children's paths joined; a wrapper without component of its own only groups.

    A route is an object of a route table or of another route's children; what names it stands in the object itself.
    """
    t = src.script(TS)
    tables = t.where((F.col("text") == "[") & (F.col("into").isNotNull() | ((_back(0) == ":") & (_back(1) == "children"))))
    roots = t.where((F.col("text") == "Routes") & (_back(0) == ":") & (_ahead(0) == "=") & (_ahead(1) == "[")).select("path", (F.col("i") + 2).alias("table"))
    objects = t.where("text = '{' and kind = 'p'").join(tables.select("path", F.col("i").alias("open"), F.col("open").alias("above")), ["path", "open"]).select("path", F.col("i").alias("object"), "line", F.col("open").alias("table"), "above")
    own = strings(t).where((_back(0) == ":") & _back(1).isin("path", "redirectTo")).groupBy("path", F.col("open").alias("object")).agg(F.max(F.when(_back(1) == "path", F.col("text"))).alias("step"), F.max(F.when(_back(1) == "redirectTo", F.col("text"))).alias("redirect"))
    shown = t.where((F.col("kind") == "w") & (_back(0) == ":") & (_back(1) == "component")).groupBy("path", F.col("open").alias("object")).agg(F.max("text").alias("component"))
    lazy = t.where((F.col("kind") == "w") & F.col("text").isin("loadComponent", "loadChildren") & (_ahead(0) == ":")).select("path", F.col("open").alias("object"), F.col("i").alias("from_"))
    then = calls(t).where("method = 'then'").select("path", F.col("i").alias("at"), F.col("open").alias("object"), F.col("close").alias("to_"))
    member = t.where((F.col("kind") == "w") & (_back(0) == ".") & (_back(2) == "=>")).select("path", F.col("open").alias("at"), F.col("text").alias("loads"))
    loaded = lazy.select("path", "object").distinct().join(then.join(member, ["path", "at"]).groupBy("path", "object").agg(F.min("loads").alias("loads")), ["path", "object"], "left").withColumn("lazy", F.lit(True))
    rows = objects
    for more in (own, shown, loaded):
        rows = rows.join(more, ["path", "object"], "left")
    level = rows.join(roots, ["path", "table"], "left_semi").withColumn("route", F.coalesce("step", F.lit("")))
    found, depth = level, 0
    while depth < ROUTE_DEPTH:  # a level of children at a time
        parents = level.select("path", F.col("object").alias("above"), F.col("route").alias("before"))
        level = rows.join(parents, ["path", "above"]).withColumn("route", F.concat_ws("/", F.nullif("before", F.lit("")), F.nullif("step", F.lit("")))).select(found.columns)
        found, depth = found.unionByName(level), depth + 1
    told = found.where("component is not null or lazy or redirect is not null")
    return facts(told, "Route", F.concat(F.lit("/"), "route"), properties(path=F.concat(F.lit("/"), "route"), component=F.col("component"), loads=F.col("loads"), redirectTo=F.col("redirect")), 0.85)


#: Routes are nested so deep at most in one file.
ROUTE_DEPTH = 6

# ---- Next, shared front end, packages, security ----------------------------------------------


@extractor(r"(?:^|/)app/(?:.*/)?(?:page|layout|loading|error)\.[tj]sx?$")
def next_routes(src: Sources) -> DataFrame:
    kinds = src.files.withColumn("kind_", F.regexp_extract("path", r"(?:^|/)app/(?:.*/)?(page|layout|loading|error)\.[tj]sx?$", 1)).where("kind_ <> ''")
    return facts(kinds.withColumn("line", F.lit(1)), "Route", T.next_route(F.col("path")), properties(path=T.next_route(F.col("path")), kind=F.col("kind_")), 0.9)


#: Identity providers by what is imported.
_PROVIDERS = (("msal", r"@azure/msal"), ("auth0", r"@auth0/|auth0-"), ("firebase", r"firebase/auth"), ("okta", r"@okta/"), ("keycloak", r"keycloak-js"), ("next-auth", r"next-auth"), ("cognito", r"amazon-cognito|aws-amplify"))


@extractor(TS, tree=True)
def frontend_auth(src: Sources) -> DataFrame:
    """Identity providers (first file of each), token storage by key with what is done to it, and token headers."""
    t = src.script(TS, few=True)
    imports = strings(t).where(_back(0) == "from").groupBy(F.col("text").alias("module")).agg(F.min(F.struct("path", "line")).alias("at")).select("at.*", "module")
    rules = src.files.sparkSession.createDataFrame(_PROVIDERS, "provider string, pattern string")
    hits = imports.join(F.broadcast(rules), F.rlike(F.col("module"), F.col("pattern"))).groupBy("provider").agg(F.min(F.struct("path", "line", "module")).alias("f")).select("provider", "f.*")
    stored = calls(t).where(F.col("on").isin("localStorage", "sessionStorage") & F.col("method").isin("setItem", "getItem", "removeItem")).select("path", "line", "method", F.col("i").alias("at")).join(first_arguments(t), ["path", "at"]).where(F.lower("value").contains("token"))
    ops = stored.groupBy("value").agg(F.min(F.struct("path", "line")).alias("f"), F.bool_or(F.col("method") == "setItem").alias("s"), F.bool_or(F.col("method") == "getItem").alias("g")).select("value", "f.*", "s", "g")
    how = F.when(F.col("s") & F.col("g"), "get+set").when(F.col("s"), "set").when(F.col("g"), "get").otherwise("remove")
    bearer = union(t.where((F.col("kind") == "t") & F.col("text").contains("Bearer ${")).select("path", "line"), t.where((F.col("text") == "Authorization") & (_back(0) == "{") & (_back(1) == ":") & (_back(2) == "setHeaders")).select("path", "line"))
    variable = t.where((F.col("kind") == "w") & (_back(0) == ".") & (_back(1) == "env") & (_back(2) == ".") & _back(3).isin("process", "meta") & F.col("text").rlike("CLIENT_ID|TENANT|AUTHORITY|AUDIENCE|ISSUER|DOMAIN"))
    settings = first_by(variable.select("path", "line", "text"), ["text"], ["path", "line"])
    return union(
        facts(hits, "AuthProvider", F.col("provider"), properties(**{"import": F.col("module")}), 0.85), facts(ops, "TokenStorage", F.col("value"), properties(operation=how), 0.75),
        facts(bearer, "TokenAttachment", F.lit("Authorization"), None, 0.75), facts(settings, "Configuration", F.col("text"), properties(source=F.lit("environment")), 0.85))


@extractor(r"appsettings[^/]*\.json$")
def configuration(src: Sources) -> DataFrame:
    """Connection strings' names in settings files with comments; unreadable files give nothing."""
    parsed = src.like(r"appsettings[^/]*\.json$").select("path", F.from_json(F.regexp_replace("text", r",(\s*[}\]])", "$1"), "ConnectionStrings map<string,string>", {"allowComments": "true"}).alias("j"))
    names = parsed.select("path", F.explode(F.map_keys("j.ConnectionStrings")).alias("key")).withColumn("line", F.lit(1))
    return facts(names, "DataStore", F.col("key"), properties(kind=F.lit("connection string")), 1.0)


def vulnerable_packages(reports: DataFrame) -> DataFrame:
    """(path, name, severity) from package-list reports: top-level packages, transitive ones only where there are none; the first severity of each."""
    package = "array<struct<id:string,resolvedVersion:string,vulnerabilities:array<struct<severity:string>>>>"
    j = reports.select("path", F.from_json("text", f"projects array<struct<frameworks:array<struct<topLevelPackages:{package},transitivePackages:{package}>>>>").alias("j"))
    frames = j.select("path", F.explode("j.projects").alias("p")).select("path", F.explode("p.frameworks").alias("f"))
    each = frames.select("path", F.explode(F.coalesce("f.topLevelPackages", "f.transitivePackages")).alias("k")).where(F.size("k.vulnerabilities") > 0)
    return each.select("path", F.concat_ws(" ", "k.id", "k.resolvedVersion").alias("name"), F.get("k.vulnerabilities", F.lit(0))["severity"].alias("severity"))


def audit_findings(reports: DataFrame) -> DataFrame:
    j = reports.select("path", F.from_json("text", "vulnerabilities map<string,struct<severity:string>>").alias("j"))
    return j.select("path", F.explode("j.vulnerabilities").alias("name", "v")).select("path", "name", F.col("v.severity").alias("severity"))


SECRETS = (
    ("api-key-assignment", r"""(?i)\b(?:api[_-]?key|token|secret|password)\s*[=:]\s*["']([A-Za-z0-9+/=_-]{16,})["']"""),
    ("private-key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)"),
    ("cloud-access-key", r"\b(AKIA[0-9A-Z]{16})\b"))


def secrets(rows: DataFrame, key: str) -> DataFrame:
    """(key, type, hits): how many secrets of each type; never their values."""
    out = None
    for kind, pattern in SECRETS:
        one = rows.select(key, F.lit(kind).alias("type"), F.regexp_count("text", F.lit(pattern)).cast("long").alias("hits")).where("hits > 0")
        out = one if out is None else out.unionByName(one)
    return out


@extractor(r"\.json$")
def vulnerabilities(src: Sources) -> DataFrame:
    """Vulnerable packages of scanners' reports, with their severity."""
    rows = union(vulnerable_packages(src.files), audit_findings(src.files)).withColumn("line", F.lit(1)).withColumnRenamed("name", "package")
    return facts(rows, "Vulnerability", F.col("package"), properties(severity=F.col("severity"), type=F.lit("package")), 0.9)


#: Settings, pipelines and sources, in which credentials are looked for.
SCANNED = r"(?i)\.(?:json|ya?ml|config|env|xml|cs|[jt]sx?|properties|ini|tfvars)$|(?:^|/)\.env[^/]*$"


@extractor(SCANNED)
def secret_findings(src: Sources) -> DataFrame:
    """A finding for each type of secret in a file, with how many there are; never their values. Comments count too little to be code, but strings do."""
    found = secrets(src.like(SCANNED).withColumn("text", lexing.shown(F.col("text"))), "path").withColumnRenamed("type", "found")
    return facts(found.withColumn("line", F.lit(1)), "Vulnerability", F.concat("found", F.lit(" in "), "path"), properties(severity=F.lit("High"), type=F.col("found"), hits=F.col("hits")), 0.7)


EXTRACTORS = {x.name: x for x in (
    react_components, react_hooks, react_hook_uses, react_api_calls, react_contexts, react_routes, react_renders, react_roles, react_role_gates, react_grids, react_charts, react_filters,
    react_imports_exports, react_form_fields, react_default_routes, angular_components, angular_services, angular_guards, angular_dependencies, angular_form_fields, angular_filters, angular_http,
    angular_template_tags, angular_routes, next_routes, frontend_auth, configuration, vulnerabilities, secret_findings)}
