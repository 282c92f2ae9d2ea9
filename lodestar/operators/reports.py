"""Report sections over a snapshot: each a DataFrame with a stable schema, and a thin text renderer.

``nodes`` has (identity, kind, properties, confidence), ``edges`` (type, from_id, to_id, seq). All
lookups join on full identities; short names are only shown. Properties are named through
``facts.prop``, which knows what extractors write for each kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions.identity import node_label, short_name
from lodestar.operators.facts import prop
from lodestar.operators.graph import reach
from lodestar.operators.merge import first_by
from lodestar.operators.resolve import top_per_group
from lodestar.plans.lineage import stored

GENERAL = "General"


def _named(identity: Column, properties: Column) -> Column:
    return F.coalesce(properties["name"], short_name(identity))


def of_kind(nodes: DataFrame, *kinds: str) -> DataFrame:
    return nodes.where(F.col("kind").isin(*kinds)).withColumn("name", _named(F.col("identity"), F.col("properties")))


def overview(nodes: DataFrame) -> DataFrame:
    """(kind, n), the most frequent first."""
    return nodes.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def counts(nodes: DataFrame, *kinds: str) -> DataFrame:
    """One row with the number of nodes of each kind, in one pass."""
    return nodes.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


#: What a node of each kind is for, as pages say it.
ROLES = {
    "Controller": "Receives HTTP requests and coordinates responses.", "Endpoint": "A single HTTP operation the application exposes.", "Service": "Encapsulates business logic and orchestrates operations.",
    "Repository": "Provides data access for a domain type.", "Interface": "A contract implemented elsewhere in the application.", "DataStore": "Persists and retrieves application data.",
    "Entity": "A domain data type the application manages.", "UIComponent": "A building block of the user interface.", "UIService": "A frontend service (data access, state, or shared logic).",
    "Hook": "A reusable piece of React state/behavior (custom hook).", "Context": "Shared React state exposed to the component tree.", "Guard": "Controls route access on the frontend.",
    "Interceptor": "Intercepts outgoing HTTP requests on the frontend.", "Component": "A structural building block of the application.", "Route": "A navigable path in the frontend.",
    "ApiCall": "A call the frontend makes to a backend endpoint.", "Configuration": "An application configuration value.", "Project": "A build unit (project) within the application.",
    "Technology": "A framework or library the application depends on.", "Cache": "A caching mechanism (in-memory or distributed).", "AuthScheme": "A configured authentication scheme.",
    "Cors": "Cross-origin resource sharing configuration.", "HealthCheck": "A health-check probe or endpoint.", "Logging": "A logging / audit mechanism.", "Messaging": "A messaging or event-bus integration.",
    "BackgroundJob": "A background-job or scheduling mechanism.", "Middleware": "A stage in the HTTP request pipeline.", "Authorization": "Authorization policy configuration.",
    "Command": "A CQRS command (a state-changing request).", "Query": "A CQRS query (a read request).", "Event": "A domain event / notification.", "Handler": "Handles a CQRS request or event.",
    "Validator": "Validates a request/model (FluentValidation).", "MessageBroker": "A message broker / transport (RabbitMQ, Service Bus, SQS, Kafka, …).", "Consumer": "Consumes messages from the broker.",
    "Message": "A message/event sent over the broker.", "DataAccess": "A data-access approach (EF Core, Dapper, ADO.NET, MongoDB, …).", "Filter": "An MVC filter (authorization / action / exception / result).",
    "Resilience": "A resilience policy (retry, circuit-breaker).", "Vulnerability": "A security finding — e.g. a hardcoded credential detected in a config or pipeline file."}
ANY_ROLE = "A tracked element of the application."


def roles(nodes: DataFrame) -> DataFrame:
    """Nodes with ``role``: what their kind is for, or a general word for other kinds."""
    table = nodes.sparkSession.createDataFrame(list(ROLES.items()), "kind string, role string")
    return nodes.join(F.broadcast(table), "kind", "left").withColumn("role", F.coalesce("role", F.lit(ANY_ROLE)))


def endpoints_by_owner(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(owner, endpoint, verb, route, place): each endpoint under the first node that exposes it, else General."""
    ends = of_kind(nodes, "Endpoint")
    exposed = first_by(edges.where("type = 'EXPOSES'").select(F.col("to_id").alias("identity"), "seq", "from_id"), ["identity"], ["seq"])
    owners = nodes.select(F.col("identity").alias("from_id"), F.coalesce(F.col("properties")["name"], node_label(F.col("identity"), F.col("kind"), F.lit(None).cast("string"))).alias("owner_name"))
    met = ends.join(exposed.select("identity", "from_id"), "identity", "left").join(owners, "from_id", "left")
    rows = met.select(F.coalesce("owner_name", F.lit(GENERAL)).alias("owner"), F.col("name").alias("endpoint"), prop("Endpoint", "verb").alias("verb"), prop("Endpoint", "route").alias("route"), prop("Endpoint", "parameters").alias("parameters"), "identity")
    w = Window.partitionBy("owner").orderBy(F.col("route").asc_nulls_first(), F.col("verb").asc_nulls_first(), "identity")
    return rows.withColumn("place", F.row_number().over(w)).drop("identity")


def features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(owner, phrase): what each group of endpoints lets one do."""
    e = endpoints_by_owner(nodes, edges)
    subject = T.humanize(F.coalesce(F.element_at(F.filter(F.split("route", "/"), lambda p: (p != "") & ~p.rlike(r"^\{|^api$|^v\d+$")), -1), F.col("owner")))
    return e.where("route is not null").select("owner", T.use_case_phrase(F.upper("verb"), subject, F.col("route").rlike(r"\{[^}]*\}$")).alias("phrase")).distinct()


PATTERNS: tuple[tuple[str, Callable[[], Column]], ...] = (
    ("CQRS", lambda: F.bool_or(F.col("kind").isin("Command", "Query")) & F.bool_or(F.col("kind") == "Handler")),
    ("Event-driven", lambda: F.bool_or(F.col("kind").isin("Event", "Message", "Consumer", "MessageBroker"))),
    ("Repository", lambda: F.bool_or(F.col("kind") == "Repository")),
    ("Validation pipeline", lambda: F.bool_or(F.col("kind") == "Validator")),
    ("Layered projects", lambda: F.count_if((F.col("kind") == "Project") & F.lower("identity").rlike("domain|application|infrastructure|core")) >= 2),
    ("Background processing", lambda: F.bool_or(F.col("kind") == "BackgroundJob")),
    ("Single-page front end", lambda: F.bool_or(F.col("kind") == "UIComponent")),
)


def patterns(nodes: DataFrame) -> DataFrame:
    """(pattern, present) in one pass."""
    flags = nodes.agg(*[F.coalesce(rule(), F.lit(False)).alias(name) for name, rule in PATTERNS])
    return flags.select(F.explode(F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(f"`{n}`").alias("present")) for n, _ in PATTERNS])).alias("p")).select("p.*")


def architecture_edges(nodes: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """The first edges between named nodes as labelled lines."""
    n = nodes.select("identity", _named(F.col("identity"), F.col("properties")).alias("name"))
    rows = edges.join(n.select(F.col("identity").alias("from_id"), F.col("name").alias("source")), "from_id").join(n.select(F.col("identity").alias("to_id"), F.col("name").alias("target")), "to_id")
    return rows.orderBy("seq", "type", "from_id", "to_id").limit(most).select("source", "type", "target")


def request_flows(nodes: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """(component, call, endpoint, message, handler, dependencies) chains; empty unless there are two.

    A component's first call is chosen before it is known whether it maps to an endpoint; the steps
    after the endpoint may be missing; a handler shows the three dependencies with most operations.
    """
    def first(type_: str, source: str, target: str, back: bool = False) -> DataFrame:
        a, b = ("to_id", "from_id") if back else ("from_id", "to_id")
        return first_by(edges.where(F.col("type") == type_).select(F.col(a).alias(source), "seq", F.col(b).alias(target)), [source], ["seq"]).drop("seq")

    components = of_kind(nodes, "UIComponent").select(F.col("identity").alias("component"))
    chain = components.join(first("CALLS", "component", "call"), "component").join(first("MAPS_TO", "call", "endpoint"), "call")
    chain = chain.join(first("DISPATCHES", "endpoint", "message"), "endpoint", "left").join(first("HANDLES", "message", "handler", back=True), "message", "left")
    operations = of_kind(nodes, "DatabaseOperation").groupBy(prop("DatabaseOperation", "owner").alias("short")).agg(F.count("*").alias("n"))
    depends = edges.where("type = 'DEPENDS_ON'").select(F.col("from_id").alias("handler"), "seq", F.col("to_id").alias("on"), T.short_type(short_name(F.col("to_id"))).alias("short")).join(operations, "short", "left")
    ranked = top_per_group(depends, ["handler"], [F.coalesce("n", F.lit(0)).desc(), "seq", "on"], 3).groupBy("handler").agg(F.array_sort(F.collect_list(F.struct("rank", "short"))).alias("d"))
    found = chain.join(ranked, "handler", "left").select(
        *[short_name(F.col(c)).alias(c) for c in ("component", "call", "endpoint", "message", "handler")], F.array_join(F.transform("d", lambda x: x["short"]), ", ").alias("dependencies"), F.col("component").alias("id"))
    top = found.orderBy("component", "id").limit(most).drop("id")
    enough = found.limit(2).agg(F.count("*").alias("n")).where("n >= 2")
    return top.join(enough.select(F.lit(1).alias("one")), F.lit(1) == F.col("one"), "left_semi")


def technologies(nodes: DataFrame) -> DataFrame:
    """(category, name): each name once, under the category it was first given."""
    t = of_kind(nodes, "Technology").select(prop("Technology", "category").alias("category"), "name", "identity")
    return first_by(t, ["name"], ["identity"]).select(F.coalesce("category", F.lit("Other")).alias("category"), "name").orderBy("category", "name")


_ER = {"HAS_MANY": "||--o{", "HAS_ONE": "||--||", "MANY_TO_MANY": "}o--o{", "REFERENCES": "}o--||"}


def entity_relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): entity relationship lines, each once."""
    known = nodes.where("kind = 'Entity'").select("identity")
    edges = edges.join(known.withColumnRenamed("identity", "from_id"), "from_id", "left_semi").join(known.withColumnRenamed("identity", "to_id"), "to_id", "left_semi")
    mark = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in _ER.items()])
    safe = lambda c: F.regexp_replace(short_name(F.col(c)), "[^A-Za-z0-9_]", "_")
    return edges.where(F.col("type").isin(*_ER)).select(F.concat(safe("from_id"), F.lit(" "), mark, F.lit(" "), safe("to_id")).alias("line")).distinct()


def role_access(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(role, endpoints): what each role's screens reach in the back end; roles that reach nothing are left out."""
    starts = edges.where(F.col("type").isin("ROUTES_TO", "GATES")).select(F.col("from_id").alias("source"), F.col("to_id").alias("node"))
    seen = reach(edges, starts, ["RENDERS", "CALLS"])
    hits = seen.join(edges.where("type = 'MAPS_TO'").select(F.col("from_id").alias("node"), F.col("to_id").alias("endpoint")), "node")
    return hits.groupBy("source").agg(F.array_sort(F.collect_set(short_name(F.col("endpoint")))).alias("endpoints")).select(short_name(F.col("source")).alias("role"), "endpoints")


def role_routes(nodes: DataFrame) -> DataFrame:
    """(role, path): routes that list the role, and protected routes that list none for every role."""
    roles = of_kind(nodes, "Role").select(F.col("name").alias("role")).distinct()
    routes = of_kind(nodes, "Route").select(prop("Route", "path").alias("path"), T.split_list(F.coalesce(prop("Route", "roles"), F.lit(""))).alias("roles"), F.coalesce(prop("Route", "protected") == "yes", F.lit(False)).alias("protected"))
    listed = routes.select("path", F.explode("roles").alias("role")).join(roles, "role", "left_semi").select("role", "path")
    anyone = routes.where(F.col("protected") & (F.size("roles") == 0)).select("path")
    return listed.unionByName(roles.join(anyone, F.lit(True)).select("role", "path")).distinct()


def orphan_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    shown = edges.where("type = 'RENDERS'").select(F.col("to_id").alias("identity"))
    kinds = of_kind(nodes, "UIComponent")
    renders = edges.where("type = 'RENDERS'").select(F.col("from_id").alias("identity"))
    return kinds.join(shown, "identity", "left_anti").join(renders, "identity", "left_anti").select("identity", "name")


def filters_by_component(nodes: DataFrame) -> DataFrame:
    """(component, single, multi, tabs): filter names by shape, sorted."""
    f = of_kind(nodes, "Filter").select(F.coalesce(prop("Filter", "component"), F.lit(GENERAL)).alias("component"), prop("Filter", "shape").alias("shape"), "name")
    one = lambda *s: F.array_join(F.array_sort(F.collect_list(F.when(F.col("shape").isin(*s), F.col("name")))), ", ")
    return f.where("shape is not null").groupBy("component").agg(one("single-value").alias("single"), one("multi-select").alias("multi"), one("tab", "view-tab").alias("tabs"))


def grouped_lists(nodes: DataFrame, kind: str, owner: str, most: int | None = None) -> DataFrame:
    """(owner, names): the names of a kind by one of its properties, different and sorted, the first ``most``."""
    g = of_kind(nodes, kind).groupBy(F.coalesce(prop(kind, owner), F.lit(GENERAL)).alias("owner")).agg(F.array_sort(F.collect_set("name")).alias("names"))
    return g if most is None else g.withColumn("names", F.slice("names", 1, most))


def public_endpoints(nodes: DataFrame) -> DataFrame:
    """(public, total): endpoints that say so or ask for nothing are public."""
    return of_kind(nodes, "Endpoint").agg(F.count_if(F.coalesce(prop("Endpoint", "authorization"), F.lit("anonymous")) == "anonymous").alias("public"), F.count("*").alias("total"))


def read_only_tokens(nodes: DataFrame) -> DataFrame:
    return of_kind(nodes, "TokenStorage").where(prop("TokenStorage", "operation") == "get").select("name").distinct()


def used_by(nodes: DataFrame) -> DataFrame:
    """(entity, classes): the classes that work on an entity, as database operations and the technologies' usage texts tell; entities without any are left out."""
    said = of_kind(nodes, "Technology").select(F.explode(T.split_list(prop("Technology", "usage"), ";")).alias("use"))
    each = said.select(F.trim(F.regexp_extract("use", r"^(\w+)\s*\(", 1)).alias("class"), F.explode(F.regexp_extract_all("use", F.lit(r"\w+\((\w+)\)"), 1)).alias("entity"))
    operations = of_kind(nodes, "DatabaseOperation").select(prop("DatabaseOperation", "owner").alias("class"), prop("DatabaseOperation", "entity").alias("entity"))
    known = of_kind(nodes, "Entity").select(F.col("name").alias("entity")).distinct()
    return each.unionByName(operations.where("entity is not null and class is not null")).join(known, "entity").groupBy("entity").agg(F.array_sort(F.collect_set("class")).alias("classes"))


def entity_fields(nodes: DataFrame, most: int = 60) -> DataFrame:
    """(entity, key, fields): every entity with its first fields and how many more there are."""
    e = of_kind(nodes, "Entity")
    fields = T.split_list(F.coalesce(prop("Entity", "fields"), F.lit("")), ";")
    return e.select(F.col("name").alias("entity"), F.coalesce(prop("Entity", "primaryKey"), prop("Entity", "key")).alias("key"), T.capped_list(fields, most).alias("fields"))


def workflows(nodes: DataFrame, most: int = 10) -> DataFrame:
    """(workflow, values): members with states, the first of these and how many more there are."""
    return of_kind(nodes, "StatusWorkflow").select(F.col("name").alias("workflow"), T.capped_list(T.split_list(prop("StatusWorkflow", "values")), most).alias("values"))


def stores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(store, entities): every data store with the entities it owns, none if it owns none."""
    owned = edges.where("type = 'OWNS'").select(F.col("from_id").alias("identity"), short_name(F.col("to_id")).alias("entity"))
    s = of_kind(nodes, "DataStore").select("identity", F.col("name").alias("store"))
    return s.join(owned, "identity", "left").groupBy("identity", "store").agg(F.array_sort(F.collect_set("entity")).alias("entities")).select("store", "entities")


def sequences(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, lines): each request flow as the lines of a sequence diagram."""
    f = request_flows(nodes, edges)
    step = lambda a, b, how: F.when(F.col(b).isNotNull() & (F.col(b) != ""), F.concat(F.col(a), F.lit("->>"), F.col(b), F.lit(f": {how}")))
    first = F.concat("component", F.lit("->>"), "endpoint", F.lit(": calls"))
    return f.select("component", F.concat_ws("\n", first, step("endpoint", "message", "dispatches"), step("message", "handler", "handled by"), step("handler", "dependencies", "uses")).alias("lines"))


def journeys(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(role, steps): what each role reaches, where that are two steps or more."""
    return role_access(nodes, edges).where(F.size("endpoints") >= 2).select("role", F.col("endpoints").alias("steps"))


def component_diagram(edges: DataFrame) -> DataFrame:
    """(line): who renders and calls whom, each once."""
    rows = edges.where(F.col("type").isin("RENDERS", "CALLS"))
    return rows.select(F.concat(short_name(F.col("from_id")), F.lit(" -->|"), F.lower("type"), F.lit("| "), short_name(F.col("to_id"))).alias("line")).distinct()


#: The pages and the kinds of which one must be there for a page to be shown; none: always.
PAGES: dict[str, tuple[str, ...]] = {
    "Overview": (), "Features": (), "Use cases": (), "Architecture": (), "API reference": (), "Technology stack": (), "Data and storage": ("DataStore", "Entity"),
    "Security": ("AuthScheme", "Authorization", "AuthorizationPolicy", "Vulnerability", "AuthProvider", "TokenStorage", "Guard", "Endpoint"), "Frontend": ("UIComponent", "Route", "UIService"),
    "Messaging": ("Message", "MessageBroker", "Consumer"), "Workflows": ("StatusWorkflow", "BusinessRule")}


def page_set(nodes: DataFrame) -> DataFrame:
    """(page, shown) in one pass over the nodes."""
    flags = nodes.agg(*[(F.lit(True) if not kinds else F.coalesce(F.bool_or(F.col("kind").isin(*kinds)), F.lit(False))).alias(page) for page, kinds in PAGES.items()])
    return flags.select(F.explode(F.array(*[F.struct(F.lit(p).alias("page"), F.col(f"`{p}`").alias("shown")) for p in PAGES])).alias("p")).select("p.*")


def changelog(diff_nodes: DataFrame, most: int = 15) -> DataFrame:
    """(change, listed): labels of added and removed nodes, capped with how many more there are."""
    g = diff_nodes.groupBy("change").agg(F.array_sort(F.collect_list(short_name(F.col("identity")))).alias("labels"))
    return g.select("change", T.capped_list(F.col("labels"), most).alias("listed"))


#: Lines of a page's part.
LINES = 400
#: The page that each section is on, the rows of which it consists and their order. Every page of PAGES has a section.
SECTIONS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "Overview": lambda n, e: overview(n), "Features": features, "Architecture": architecture_edges, "Patterns": lambda n, e: patterns(n), "Request flows": request_flows, "API reference": endpoints_by_owner,
    "Technology": lambda n, e: technologies(n), "Data": entity_relations, "Entities": lambda n, e: entity_fields(n), "Access": role_access, "Navigation": lambda n, e: role_routes(n), "Unused components": orphan_components,
    "Filters": lambda n, e: filters_by_component(n), "Forms": lambda n, e: grouped_lists(n, "FormField", "form"), "Business rules": lambda n, e: grouped_lists(n, "BusinessRule", "owner"), "Workflows": lambda n, e: workflows(n),
    "Audit": lambda n, e: grouped_lists(n, "AuditLog", "entity"), "Vulnerabilities": lambda n, e: grouped_lists(n, "Vulnerability", "severity"), "Public endpoints": lambda n, e: public_endpoints(n), "Tokens": lambda n, e: read_only_tokens(n),
    "Used by": lambda n, e: used_by(n), "Stores": stores, "Sequences": sequences, "Journeys": journeys, "Component diagram": lambda n, e: component_diagram(e), "Messages": lambda n, e: of_kind(n, "Message", "Consumer", "MessageBroker").select("kind", "name")}
#: What the rows of a section are ordered by, where that is not their text.
ORDERS: dict[str, tuple[str, ...]] = {"Overview": ("-n", "kind"), "API reference": ("owner", "place")}
#: The page of each section, in order.
PAGE_OF: dict[str, str] = {
    "Overview": "Overview", "Features": "Features", "Journeys": "Use cases", "Sequences": "Use cases", "Architecture": "Architecture", "Patterns": "Architecture", "Request flows": "Architecture", "API reference": "API reference", "Technology": "Technology stack",
    "Data": "Data and storage", "Entities": "Data and storage", "Stores": "Data and storage", "Used by": "Data and storage", "Audit": "Data and storage", "Public endpoints": "Security", "Vulnerabilities": "Security", "Tokens": "Security",
    "Access": "Frontend", "Navigation": "Frontend", "Component diagram": "Frontend", "Unused components": "Frontend", "Filters": "Frontend", "Forms": "Frontend", "Messages": "Messaging", "Workflows": "Workflows", "Business rules": "Workflows"}


def lines(section: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(line, o1, o2): a section's rows as lines, with up to two values to order them by."""
    text = F.concat(F.lit("- "), F.concat_ws(" · ", *[F.coalesce(F.col(f"`{c}`").cast("string") if not t.startswith("array") else F.array_join(c, ", "), F.lit("")) for c, t in section.dtypes if c != "place"]))
    def value(name: str):
        bare = name.removeprefix("-")
        of = F.col(f"`{bare}`")
        number = dict(section.dtypes)[bare] not in ("string",)
        return F.lpad((F.lit(10**15) - of if name.startswith("-") else of).cast("string"), 16, "0") if number else of
    keys = [F.coalesce(value(n), F.lit("")) for n in order]
    one, two = (keys + [F.lit("")] * 2)[:2]
    return section.select(text.alias("line"), one.alias("o1"), two.alias("o2"))


def project(nodes: DataFrame, edges: DataFrame, titles: tuple[str, ...] | None = None) -> DataFrame:
    """(path, part, content, page_order) of every page that ``page_set`` shows, or of those with the sections named.

    A page is its title and its sections, each a heading and a line for each row. The lines of all
    pages are ordered together by range, and ranges of LINES of them are the parts: no task and no
    row holds a page. Parts of a page are to be read in order.
    """
    shown = {r["page"] for r in page_set(nodes).where("shown").collect()}  # a row for each page
    out, heads, names = None, [], list(PAGES)
    for place, (title, page) in enumerate(PAGE_OF.items()):
        if page not in shown or (titles is not None and title not in titles):
            continue
        rows = lines(SECTIONS[title](nodes, edges), ORDERS.get(title, ()))
        heads += [(f"# {page}", "", "", names.index(page), -1, 0), ("", "", "", names.index(page), -1, 1), (f"## {title}", "", "", names.index(page), place, -2), ("", "", "", names.index(page), place, -1)]
        body = rows.withColumn("page", F.lit(names.index(page))).withColumn("place", F.lit(place)).withColumn("level", F.lit(0))
        out = body if out is None else out.unionByName(body)
    if out is None:
        return nodes.sparkSession.createDataFrame([], "path string, part int, content string, page_order int")
    body = stored(out)  # each section is made once: ordering by range reads its rows twice, and so do the headings
    out = body.unionByName(nodes.sparkSession.createDataFrame(heads, "line string, o1 string, o2 string, page int, place int, level int").coalesce(1))
    full = body.select("place").distinct().unionByName(nodes.sparkSession.range(1).select(F.lit(-1).alias("place")))
    out = out.join(F.broadcast(full), "place", "left_semi").dropDuplicates(["page", "place", "level", "o1", "o2", "line"])  # no heading without rows
    ordered = stored(out.orderBy("page", "place", "level", "o1", "o2", "line").withColumn("spot", F.monotonically_increasing_id()))
    first = ordered.groupBy("page", (F.shiftright("spot", 33)).alias("task")).agg(F.min("spot").alias("begins"))
    cut = ordered.withColumn("task", F.shiftright("spot", 33)).join(F.broadcast(first), ["page", "task"]).withColumn("range", F.floor((F.col("spot") - F.col("begins")) / LINES))
    parts = cut.groupBy("page", "task", "range").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("spot", "line"))), lambda x: x["line"]), "\n").alias("content"))
    parts = stored(parts)
    number = parts.select("page", "task", "range").withColumn("part", F.row_number().over(Window.partitionBy("page").orderBy("task", "range")) - 1)
    path = F.element_at(F.array(*[F.lit(n.lower().replace(" ", "-") + ".md") for n in names]), F.col("page") + 1)
    return parts.join(number, ["page", "task", "range"]).select(path.alias("path"), "part", "content", F.col("page").alias("page_order"))


def notes_page(found: DataFrame) -> DataFrame:
    """The project's own notes as a page, if there are any."""
    return found.select(F.lit("notes.md").alias("path"), F.lit(0).alias("part"), F.concat(F.lit("# Notes\n\n"), "text").alias("content"), F.lit(len(PAGES)).alias("page_order"))


#: Characters of a page's facts that a text model is given.
GROUNDING = 6000


def grounded(facts: DataFrame, order: list, most: int = GROUNDING) -> DataFrame:
    """(page, text, facts): the first lines of each page of ``facts(page, line, ...)`` in the given order that fit into ``most`` characters together.

    No more lines than characters can fit, so each page is cut to that many before its lengths are
    summed up; a line that does not fit ends the text.
    """
    by = Window.partitionBy("page").orderBy(*order, "line")
    some = facts.where("line is not null").withColumn("n", F.row_number().over(by)).where(F.col("n") <= most)
    total = F.sum(F.length("line") + 1).over(Window.partitionBy("page").orderBy("n"))
    fit = some.withColumn("total", total - 1).where(F.col("total") <= most)
    return fit.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"), F.count("*").alias("facts"))
