"""Extractors over pages, documents and a generated source tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import dotnet as D
from lodestar.operators import extract as X
from lodestar.operators.facts import rendered
from lodestar.plans import sources
from lodestar.plans.starmap import Star
from lodestar.queries.registry import query


def _pages(spark, sf_dir):
    return Star(spark, sf_dir).table("pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"))


@query("""select page_id, href, count(*) as n from (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages) group by page_id, href""")
def extract_hrefs(spark, sf_dir):
    p = Star(spark, sf_dir).table("pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages")
def extract_titles(spark, sf_dir):
    return Star(spark, sf_dir).table("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("""with m as (select doc_id, string_split_regex(text, '\\bthe\\b') as parts from documents)
select doc_id, sum(line)::bigint as lines from (select doc_id, unnest(list_transform(range(1, len(parts)), lambda k: len(string_split(array_to_string(parts[1:k], ''), chr(10))))) as line from m) group by doc_id""".replace("\\\\b", "\\b"))
def extract_line_numbers(spark, sf_dir):
    d = Star(spark, sf_dir).table("documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    rows = X.occurrences(d, r"\bthe\b", 0)
    return rows.groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.sum("line").alias("lines"))


@query(" union all ".join(f"select doc_id, '{k}' as type, len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}'))::bigint as hits from documents where regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')" for k, p in X.SECRETS))
def secret_scan(spark, sf_dir):
    return X.secrets(Star(spark, sf_dir).table("documents").select("doc_id", "text"), "doc_id")


_APP, _USERS, _AUTH, _ROUTES, _ROUTER, _GRID, _PAGE = (p for p, _ in sources.REACT)
_LIST, _ROW, _HTML, _SERVICE, _NG = (p for p, _ in sources.ANGULAR)
_PROJ, _SETTINGS, _PROG, _CTL, _DATA, _MSG = (p for p, _ in sources.DOTNET)
_EF = "approach=EF Core"
#: What each extractor finds in a product, read off its sources by hand: (path, line, kind, name, detail, confidence).
EXPECTED: dict[str, list[tuple]] = {
    "react_components": [
        (_APP, 6, "UIComponent", "App__K__", "kind=component; rendering=client; props=title, items; hooks=useState, useAuth__K__; displayName=All items; emptyStateLabel=No items yet", 0.85),
        (_USERS, 2, "UIComponent", "Users__K__", "kind=component; rendering=server; props=id", 0.85), (_PAGE, 1, "UIComponent", "Page__K__", "kind=page; rendering=server", 0.85)],
    "react_hooks": [(_AUTH, 2, "Hook", "useAuth__K__", None, 0.85)],
    "react_hook_uses": [(_APP, 11, "USES", "useAuth__K__", "App__K__", 0.7)],
    "react_api_calls": [x for n, c in ((13, "GET /api/v__K__/items"), (14, "POST /api/orders"), (15, "PUT /api/items/7")) for x in ((_APP, n, "ApiCall", c, "verb=" + c.replace(" ", "; route="), 0.75), (_APP, n, "CALLS", c, "App__K__", 0.7))],
    "react_contexts": [(_APP, 5, "Context", "User__K__Context", "kind=context", 0.8)],
    "react_routes": [
        (_ROUTES, 2, "Route", "/users/__K__", "path=/users/__K__; protected=yes; roles=ADMIN, OWNER", 0.85), (_ROUTES, 3, "Route", "(index)", "path=(index); protected=no", 0.85), (_ROUTER, 2, "Route", "/a__K__", "path=/a__K__; protected=yes", 0.75), (_ROUTER, 3, "Route", "/b", "path=/b; protected=no", 0.75),
        (_ROUTES, 2, "RENDERS", "ProtectedRoute", "/users/__K__", 0.6), (_ROUTES, 2, "RENDERS", "Users__K__", "/users/__K__", 0.6), (_ROUTES, 3, "RENDERS", "Home", "(index)", 0.6),
        (_ROUTER, 2, "RENDERS", "PrivateRoute", "/a__K__", 0.6), (_ROUTER, 2, "RENDERS", "Page__K__", "/a__K__", 0.6), (_ROUTER, 3, "RENDERS", "B", "/b", 0.6)],
    "react_renders": [(_APP, 0, "RENDERS", x, "App__K__", 0.6) for x in ("Empty__K__", "LineChart", "Users__K__")] + [(_PAGE, 0, "RENDERS", "Users__K__", "Page__K__", 0.6)],
    "react_roles": [(_AUTH, 3, "Role", "ADMIN", "value=admin__K__", 0.9), (_AUTH, 3, "Role", "VIEWER", "value=viewer", 0.9)],
    "react_role_gates": [(_USERS, 0, "GATES", "Users__K__", "ADMIN", 0.6), (_USERS, 0, "GATES", "Users__K__", "SHOP.EDIT", 0.6)],
    "react_grids": [(_GRID, 0, "DataGrid", "Grid__K__", "columns=id, name", 0.85), (_USERS, 5, "DataGrid", "Users__K__", "columns=Name, Due date", 0.8)],
    "react_charts": [(_APP, 0, "AnalyticsChart", "App__K__", "library=recharts", 0.8)],
    "react_filters": [
        (_APP, 7, "Filter", "statusFilter", "component=App__K__; shape=single-value; targetField=state", 0.75), (_APP, 8, "Filter", "selectedFilters", "component=App__K__; shape=multi-select", 0.75),
        (_APP, 10, "Filter", "activeTab", "component=App__K__; shape=view-tab", 0.6)],
    "react_imports_exports": [(_USERS, 4, "ImportExport", "handleExportCsv", "kind=Export; async=polls job status", 0.8), (_GRID, 0, "ImportExport", "Grid__K__ file upload", "kind=Upload", 0.6)],
    "react_form_fields": [(_USERS, 5, "FormField", "email", "form=Users__K__", 0.8), (_USERS, 3, "FormField", "name", "form=Users__K__; validation=Name is required", 0.8), (_USERS, 8, "FormField", "city", "form=Users__K__; validation=City is required", 0.65)],
    "react_default_routes": [(_AUTH, 6, "ROUTES_TO", "/users/__K__", "ADMIN", 0.65), (_AUTH, 7, "ROUTES_TO", "/home", "VIEWER", 0.65)],
    "angular_components": [(_LIST, 1, "UIComponent", "List__K__Component", "selector=app-list", 0.9), (_ROW, 1, "UIComponent", "Row__K__Component", "selector=app-row__K__", 0.9)],
    "angular_services": [(_SERVICE, 1, "UIService", "List__K__Service", None, 0.9)],
    "angular_guards": [(_SERVICE, 3, "Guard", "Auth__K__Guard", "contract=CanActivate", 0.85), (_SERVICE, 4, "Resolver", "load", "contract=ResolveFn", 0.85)],
    "angular_dependencies": [(_LIST, 7, "DEPENDS_ON", "HttpClient", "List__K__Component", 0.8), (_LIST, 7, "DEPENDS_ON", "List__K__Service", "List__K__Component", 0.8)],
    "angular_form_fields": [(_LIST, 6, "FormField", "name", "form=list__K__.component; validation=required, email", 0.8), (_LIST, 6, "FormField", "note", "form=list__K__.component", 0.8)],
    "angular_filters": [(_LIST, 4, "Filter", "statusFilter", "component=List__K__Component; shape=single-value; targetField=status", 0.75)],
    "angular_http": [x for c in ("GET /api/list", "POST /api/v__K__/items", "GET /api/v__K__") for x in ((_LIST, 7, "ApiCall", c, "verb=" + c.replace(" ", "; route="), 0.8), (_LIST, 7, "CALLS", c, "List__K__Component", 0.7))],
    "angular_template_tags": [(_LIST, 2, "RENDERS", "Row__K__Component", "List__K__Component", 0.85)],
    "angular_routes": [(_NG, 1, "Route", "/a__K__", "path=/a__K__; component=AComponent", 0.85), (_NG, 1, "Route", "/a__K__/b", "path=/a__K__/b; component=BComponent", 0.85), (_NG, 1, "Route", "/g/c", "path=/g/c; component=CComponent", 0.85), (_NG, 2, "Route", "/l", "path=/l; loads=LazyModule", 0.85), (_NG, 2, "Route", "/old", "path=/old; redirectTo=a__K__", 0.85)],
    "next_routes": [(_PAGE, 0, "Route", "/items/{id}", "path=/items/{id}; kind=page", 0.9)],
    "configuration": [(_SETTINGS, 0, "DataStore", "Main__K__", "kind=connection string", 1.0)],
    "csharp_types": [
        (_CTL, 3, "Controller", "Orders__K__Controller", "bases=ControllerBase", 0.7), (_DATA, 27, "Repository", "Order__K__Repository", "bases=IOrder__K__Store", 0.6), (_MSG, 4, "Service", "Order__K__Service", None, 0.6),
        (_MSG, 22, "BackgroundJob", "Tick__K__", "bases=BackgroundService", 0.7)],
    "csharp_contracts": [(_DATA, 34, "Interface", "IOrder__K__Store", None, 0.8), (_DATA, 27, "IMPLEMENTS", "IOrder__K__Store", "Order__K__Repository", 0.7)],
    "csharp_entities": [
        (_DATA, 14, "Entity", "Order__K__", "fields=Code: string; Name: string; validated=Name; key=Code", 0.7), (_DATA, 22, "Entity", "Line__K__", "fields=Id: int; key=Id", 0.7),
        (_DATA, 14, "HAS_MANY", "Line__K__", "Order__K__", 0.65), (_DATA, 22, "REFERENCES", "Order__K__", "Line__K__", 0.65)],
    "csharp_data_contexts": [
        (_DATA, 3, "DataStore", "Shop__K__DbContext", "kind=ef-dbcontext", 0.8), (_DATA, 5, "Entity", "Order__K__", None, 0.8), (_DATA, 6, "Entity", "Line__K__", None, 0.8), (_DATA, 5, "OWNS", "Order__K__", "Shop__K__DbContext", 0.8),
        (_DATA, 6, "OWNS", "Line__K__", "Shop__K__DbContext", 0.8), (_DATA, 10, "HAS_MANY", "Line__K__", "Order__K__", 0.7), (_DATA, 11, "HAS_ONE", "Order__K__", "Line__K__", 0.7),
        (_DATA, 9, "Entity", "Order__K__", "tableName=orders__K__", 0.8), (_DATA, 9, "Entity", "Order__K__", "primaryKey=Code", 0.8)],
    "csharp_migrations": [(_DATA, 35, "Migration", "Init__K__", "operations=CreateTable(orders__K__); AddColumn(note)", 0.8)],
    "csharp_database_operations": [
        (_CTL, 26, "DatabaseOperation", "MakeOrder__K__Handler.Handle:Add", f"owner=MakeOrder__K__Handler; method=Handle; operation=Insert; entity=Order__K__; {_EF}", 0.6), (_CTL, 27, "DatabaseOperation", "MakeOrder__K__Handler.Handle:SaveChangesAsync", f"owner=MakeOrder__K__Handler; method=Handle; operation=Persist; {_EF}; async=true", 0.6),
        (_DATA, 30, "DatabaseOperation", "Order__K__Repository.Open:ToListAsync", f"owner=Order__K__Repository; method=Open; operation=Read; entity=Order__K__; {_EF}; operators=AsNoTracking, Where, OrderBy; tracking=no-tracking; async=true", 0.6),
        (_DATA, 31, "DatabaseOperation", "Order__K__Repository.Raw:FromSqlRaw", f'owner=Order__K__Repository; method=Raw; operation=StoredProcedure; entity=Order__K__; {_EF}; sql="EXEC find__K__"', 0.6),
        (_DATA, 31, "DatabaseOperation", "Order__K__Repository.Raw:Query", 'owner=Order__K__Repository; method=Raw; operation=Read; entity=Order__K__; approach=Dapper; sql="select 1"', 0.6)],
    "csharp_dependencies": [(_CTL, 7, "DEPENDS_ON", "Order__K__Service", "Orders__K__Controller", 0.7), (_CTL, 23, "DEPENDS_ON", "Shop__K__DbContext", "MakeOrder__K__Handler", 0.7)],
    "csharp_registrations": [x for n, made, contract, life, kind in ((3, "Order__K__Repository", "IOrder__K__Store", "Scoped", "Repository"), (4, "Clock__K__", "IClock", "Singleton", "Service"), (5, "Listed__K__", "IList", "Transient", "Service"))
                             for x in ((_PROG, n, kind, made, f"lifetime={life}", 0.8), (_PROG, n, "IMPLEMENTS", contract, made, 0.8))],
    "csharp_program": [(_PROG, 0, "Component", "Program", "role=host", 1.0)],
    "csharp_policies": [(_PROG, 7, "AuthorizationPolicy", "Admins__K__", "requirements=RequireRole(admin); RequireClaim(org)", 0.6)],
    "csharp_configuration_usage": [(_PROG, 15, "Configuration", "Jwt:Key__K__", "source=IConfiguration", 0.6), (_PROG, 16, "Configuration", "HOME__K__", "source=EnvironmentVariable", 0.6)],
    "csharp_filters": [(_MSG, 23, "Filter", "Trace__K__Filter", "kind=action", 0.8)],
    "csharp_cqrs": [
        (_CTL, 18, "Query", "GetOrder__K__Query", "returns=Order__K__", 0.7), (_CTL, 19, "Command", "MakeOrder__K__Command", None, 0.7), (_CTL, 20, "Event", "Order__K__Made", None, 0.7),
        (_CTL, 21, "Handler", "MakeOrder__K__Handler", None, 0.7), (_CTL, 21, "HANDLES", "MakeOrder__K__Command", "MakeOrder__K__Handler", 0.75)],
    "csharp_dispatches": [
        (_CTL, 9, "DISPATCHES", "GetOrder__K__Query", "Orders__K__Controller", 0.6), (_CTL, 15, "DISPATCHES", "MakeOrder__K__Command", "Orders__K__Controller", 0.6), (_CTL, 28, "DISPATCHES", "Order__K__Made", "MakeOrder__K__Handler", 0.6)],
    "csharp_outbound": [(_MSG, 12, "OutboundCall", "GET https://other/api/__K__", "owner=Order__K__Service; verb=GET; route=https://other/api/__K__", 0.6)],
    "csharp_business_rules": [(_MSG, 8, "BusinessRule", "must be open __K__", "owner=Order__K__Service; method=ValidateOrder", 0.5)],
    "csharp_audits": [(_MSG, 9, "AuditLog", "Order__K__Service:order changed", "entity=order changed; source=Order__K__Service", 0.6)],
    "csharp_functions": [(_MSG, 26, "AzureFunction", "Hook__K__", "trigger=Queue", 0.8)],
    "csharp_validators": [(_MSG, 18, "Validator", "Order__K__Validator", "rules=Name: NotEmpty, MaximumLength(50); Age: GreaterThan(0)", 0.8), (_MSG, 18, "VALIDATES", "Order__K__Sent", "Order__K__Validator", 0.8)],
    "csharp_endpoints": [
        (_CTL, 8, "Endpoint", "GET /api/Orders__K__/{id}", 'verb=GET; route=/api/Orders__K__/{id}; authorization=Authorize(Roles = "admin"); action=Get; parameters=int id', 0.7), (_CTL, 10, "Endpoint", "POST /api/Orders__K__", "verb=POST; route=/api/Orders__K__; authorization=anonymous; action=Create; parameters=Order__K__Dto dto", 0.7),
        (_CTL, 9, "DISPATCHES", "GetOrder__K__Query", "GET /api/Orders__K__/{id}", 0.6), (_CTL, 15, "DISPATCHES", "MakeOrder__K__Command", "POST /api/Orders__K__", 0.6),
        (_CTL, 8, "EXPOSES", "GET /api/Orders__K__/{id}", "Orders__K__Controller", 0.7), (_CTL, 10, "EXPOSES", "POST /api/Orders__K__", "Orders__K__Controller", 0.7),
        (_PROG, 12, "Endpoint", "GET /shop__K__/items/{id}", "verb=GET; route=/shop__K__/items/{id}; authorization=Authorize", 0.6), (_PROG, 13, "Endpoint", "POST /shop__K__/in/items", "verb=POST; route=/shop__K__/in/items", 0.6), (_PROG, 14, "Endpoint", "DELETE /all", "verb=DELETE; route=/all", 0.6)],
    "packages": [
        (_PROJ, 0, "Project", "Api__K__", "kind=web; framework=net8.0", 1.0), (_PROJ, 1, "Technology", "MediatR (CQRS/mediator)", "category=Application; package=MediatR; version=12.__K__", 1.0),
        (_PROJ, 1, "Technology", "Dapper", "category=Data Access; package=Dapper; version=2.1", 1.0), (_PROJ, 1, "REFERENCES", "Core__K__", "Api__K__", 1.0)],
}
#: Facts that are told once for all products, or list what several have.
OF_ALL: dict[str, str] = {
    "frontend_auth": f"""select min(replace('{_AUTH}', '__K__', s_suppkey::varchar)) as path, kind, name, detail, confidence from supplier cross join
(values ('AuthProvider', 'msal', 'import=@azure/msal-browser', 0.85::double), ('TokenStorage', 'access_token', 'operation=get+set', 0.75), ('Configuration', 'AUTH_CLIENT_ID', 'source=environment', 0.85)) t(kind, name, detail, confidence) group by all""",
    "csharp_data_access": f"""select min(replace('{_DATA}', '__K__', s_suppkey::varchar)) as path, kind, name, detail, confidence from supplier cross join
(values ('DataAccess', 'ADO.NET (SQL Server)', 'approach=ADO.NET; db=SQL Server', 0.7::double), ('DataAccess', 'Dapper (micro-ORM)', 'approach=Dapper (micro-ORM)', 0.7)) t(kind, name, detail, confidence) group by all""",
}
_SETUP = [(_PROG, 6, "Cors", "CORS configured", "detail=policy; origins=https://a, https://b", 0.8), (_PROG, 7, "Authorization", "Authorization policies", None, 0.8), (_PROG, 8, "Cache", "In-memory cache", "detail=IMemoryCache", 0.8),
          (_MSG, 22, "BackgroundJob", "Tick__K__ (Timer)", "detail=timer", 0.6), (_MSG, 22, "BackgroundJob", "Tick__K__", "detail=hosted service", 0.8)]
_MESSAGES = [
    (_MSG, 17, "Consumer", "Sent__K__Consumer", None, 0.7), (_MSG, 17, "Message", "Order__K__Sent", None, 0.65), (_MSG, 17, "CONSUMES", "Order__K__Sent", "Sent__K__Consumer", 0.7), (_MSG, 11, "Message", "Order__K__Sent", None, 0.6),
    (_MSG, 11, "PUBLISHES", "Order__K__Sent", "Order__K__Service", 0.65), (_MSG, 10, "Message", "SendReceipt", "kind=notification", 0.55), (_MSG, 10, "PUBLISHES", "SendReceipt", "Order__K__Service", 0.55)]


def _register(name: str, run, sql: str) -> None:
    run.__name__ = name
    query(sql)(run)


def _templates(name: str) -> list:
    return sources.ANGULAR if name.startswith("angular") else sources.DOTNET if name in D.EXTRACTORS or name == "configuration" else sources.REACT


EXPECTED["status_workflows"] = [(_MSG, 8, "StatusWorkflow", "Order__K__Service.Status", "values=Closed, Open", 0.7)]
EXTRACTORS = X.EXTRACTORS | D.EXTRACTORS
_MIDDLEWARE = f" union all select replace('{_PROG}', '__K__', k), 11 + gap, 'Middleware', 'Authentication', 'order=' || (11 + gap), 0.8::double from keys"
_BROKERS = f""" union all select min(replace(p, '__K__', k)), 1, 'MessageBroker', b, null, 0.8::double from keys cross join (values ('{_PROG}', 'MassTransit'), ('{_MSG}', 'RabbitMQ')) b(p, b) group by b
union all select min(replace('{_MSG}', '__K__', k)), 1, 'Messaging', 'Dead-letter queue (DLQ)', null, 0.7::double from keys"""
EXPECTED |= {"csharp_infrastructure": _SETUP, "csharp_messaging": _MESSAGES}
_MORE = {"csharp_infrastructure": _MIDDLEWARE, "csharp_messaging": _BROKERS}

for _name, _extract in EXTRACTORS.items():
    if _name in EXPECTED:
        _register(f"extract_{_name}", lambda spark, sf_dir, n=_name, x=_extract: rendered(x(sources.files(Star(spark, sf_dir), _templates(n)))), sources.facts_sql(EXPECTED[_name]) + _MORE.get(_name, ""))
    elif _name in OF_ALL:
        _register(f"extract_{_name}", lambda spark, sf_dir, n=_name, x=_extract: rendered(x(sources.files(Star(spark, sf_dir), _templates(n)))).drop("line"), OF_ALL[_name])


@query(f"""with keys as (select s_suppkey::varchar as k from supplier),
owners as (select replace(o, '__K__', k) as owner, ms from keys cross join (values ('Orders__K__Controller', ['Send']), ('MakeOrder__K__Handler', ['Add', 'Publish', 'SaveChangesAsync'])) t(o, ms))
select (select min(replace('{_CTL}', '__K__', k)) from keys) as path, 'Technology' as kind, 'MediatR (CQRS/mediator)' as name, 'category=Application; usage=' || string_agg(owner || ' (' || array_to_string(ms, ', ') || ')', '; ' order by owner) as detail, 0.5::double as confidence from owners""")
def extract_technology_usage(spark, sf_dir):
    found = rendered(D.technology_usage(sources.files(Star(spark, sf_dir), sources.DOTNET)))
    return found.where("name = 'MediatR (CQRS/mediator)'").drop("line")


_REPORT = '{"projects":[{"frameworks":[{"topLevelPackages":[{"id":"Newtonsoft.Json","resolvedVersion":"12.0.__K__","vulnerabilities":[{"severity":"High"},{"severity":"Low"}]},{"id":"Ok","resolvedVersion":"1.0"}]}]}]}'
_NESTED = '{"projects":[{"frameworks":[{"transitivePackages":[{"id":"Deep__K__","resolvedVersion":"2.0","vulnerabilities":[{"severity":"Low"}]}]}]}]}'


@query("""select 'r' || s_suppkey || '.json' as path, 'Newtonsoft.Json 12.0.' || s_suppkey as name, 'High' as severity from supplier union all select 'n' || s_suppkey || '.json', 'Deep' || s_suppkey || ' 2.0', 'Low' from supplier""")
def extract_vuln_json(spark, sf_dir):
    return X.vulnerable_packages(sources.files(Star(spark, sf_dir), [("r__K__.json", _REPORT), ("n__K__.json", _NESTED), ("bad__K__.json", "not json")]))


@query("select 'a' || s_suppkey || '.json' as path, 'lodash' || s_suppkey as name, 'high' as severity from supplier")
def extract_audit_json(spark, sf_dir):
    return X.audit_findings(sources.files(Star(spark, sf_dir), [("a__K__.json", '{"vulnerabilities":{"lodash__K__":{"severity":"high"}}}'), ("bad__K__.json", "{")]))


_TREE = [("a__K__/App.slnx", '<Solution><Project Path="Api/Api__K__.csproj" /></Solution>'), ("a__K__/Api/Api__K__.csproj", ""), ("a__K__/Old/Old.csproj", ""), ("a__K__/web/package.json", '{"dependencies":{"react":"1"}}'),
         ("a__K__/site/package.json", '{"dependencies":{"react":"1"}}'), ("a__K__/site/next.config.js", ""), ("a__K__/ng/angular.json", "{}")]


@query("""select replace(p, '__K__', s_suppkey::varchar) as path, t as technology, replace(n, '__K__', s_suppkey::varchar) as name from supplier cross join (values
('a__K__/Api/Api__K__.csproj', 'dotnet', 'Api__K__'), ('a__K__/ng/angular.json', 'angular', 'a__K__/ng'), ('a__K__/site/next.config.js', 'nextjs', 'a__K__/site'), ('a__K__/web/package.json', 'react', 'a__K__/web'),
('a__K__/Api/Api__K__.csproj', 'security', 'a__K__/Api'), ('a__K__/Old/Old.csproj', 'security', 'a__K__/Old'), ('a__K__/web/package.json', 'security', 'a__K__/web'), ('a__K__/site/package.json', 'security', 'a__K__/site')) v(p, t, n)""")
def scan_artifacts(spark, sf_dir):
    from lodestar.sources.repositories import artifacts
    return artifacts(sources.files(Star(spark, sf_dir), _TREE))
