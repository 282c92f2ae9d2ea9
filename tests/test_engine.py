"""Merging, validation, resolving, snapshots and traversal on small rows, as the engine's rules state them."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import identity as I
from lodestar.functions import text as T
from lodestar.operators import extract, graph, merge, resolve, runs, snapshots, validate
from lodestar.sources import config, repositories

DISC = "seq long, identity string, kind string, properties map<string,string>, evidence array<struct<file:string>>, confidence double"


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_merge_rules(spark):
    d = spark.createDataFrame([
        (0, "a", "Entity", {"x": "1", "y": "1"}, [("f0",)], 0.5), (1, "a", "Event", {"x": "2"}, [("f1",)], 0.5), (2, "b", "Service", {}, [("g",), ("g",)], 1.0), (3, "b", "Service", {}, [], 0.5)], DISC)
    rows = {r["identity"]: r for r in merge.canonical_nodes(d).collect()}
    assert rows["a"]["confidence"] == pytest.approx(0.75) and rows["a"]["kind"] == "Entity"
    assert rows["a"]["properties"] == {"x": "2", "y": "1", "AlternateKinds": "Event"}
    assert [e["file"] for e in rows["a"]["evidence"]] == ["f0", "f1"]
    assert rows["b"]["confidence"] == 1.0 and len(rows["b"]["evidence"]) == 2


def test_merge_does_not_depend_on_partitions(spark):
    rng = random.Random(5)
    rows = [(i, f"n{rng.randrange(20)}", rng.choice("KLM"), {"p": str(rng.randrange(3))}, [(f"f{i}",)], rng.random()) for i in range(200)]
    one = merge.canonical_nodes(spark.createDataFrame(rows, DISC).coalesce(1))
    many = merge.canonical_nodes(spark.createDataFrame(rng.sample(rows, len(rows)), DISC).repartition(7))
    shape = lambda df: values(df.select("identity", "kind", F.to_json("properties"), F.to_json("evidence"), F.round("confidence", 9)))
    assert shape(one) == shape(many)


def simulate(edges, known):
    known, out = set(known), set()
    for seq, a, b in sorted(edges):
        if a != b and (a in known or b in known):
            known |= {a, b}
            out.add(seq)
    return out


def test_external_closure_follows_emission_order(spark):
    rng = random.Random(3)
    for _ in range(3):
        edges = [(i, rng.choice("abcdefghij"), rng.choice("abcdefghij")) for i in range(12)]
        df = spark.createDataFrame([(s, "T", a, b, 0.5) for s, a, b in edges], "seq long, type string, from_id string, to_id string, confidence double")
        known = spark.createDataFrame([("a",)], "identity string")
        got = {r["seq"] for r in validate.accepted(df, known).where("accepted").collect()}
        assert got == simulate(edges, {"a"})


def test_endpoint_classes_and_invariants(spark):
    e = spark.createDataFrame([("T", "x", "y"), ("T", "x", "m"), ("T", "m", "n")], "type string, from_id string, to_id string")
    known = spark.createDataFrame([("x",), ("y",)], "identity string")
    assert {r["class"] for r in validate.endpoint_classes(e, known).collect()} == {"both", "one", "neither"}
    nodes = spark.createDataFrame([("x", "K", 1.5), ("x", "K/", 0.5)], "identity string, kind string, confidence double")
    broken = {r["rule"]: r["violations"] for r in validate.invariants(nodes, e).collect()}
    assert broken == {"duplicate_identity": 1, "dangling_from": 1, "dangling_to": 3, "self_edge": 0, "bad_confidence": 1, "bad_kind": 1, "bad_type": 0, "no_evidence": 0}


def test_routes(spark):
    calls = spark.createDataFrame([(1, "GET", "/api/customer"), (2, "GET", "/clients"), (3, "GET", "/dup")], "call_id long, verb string, url string")
    ends = spark.createDataFrame([(10, "get", "/api/Customer", 1), (11, "GET", "/api/v1/clients", 2), (12, "GET", "/v1/dup", 3), (13, "GET", "/v2/dup", 4)], "endpoint_id long, verb string, route string, seq long")
    assert values(resolve.route_matches(calls, ends)) == [(1, 10, 0.9), (2, 11, 0.75)]


def test_traverse_impact_and_cycles(spark):
    edges = spark.createDataFrame([(1, "T", "a", "b"), (2, "U", "a", "c"), (3, "T", "b", "d"), (4, "T", "c", "d"), (5, "T", "d", "a")], "seq long, type string, from_id string, to_id string")
    nodes = spark.createDataFrame([("a", "K"), ("b", "K"), ("c", "L")], "identity string, kind string")
    assert values(graph.traverse(nodes, edges, "a", 2)) == [("b", "T", 1, "K"), ("c", "U", 1, "L"), ("d", "T", 2, "?")]
    assert graph.traverse(nodes, edges, "a", 0).count() == 0
    assert {r["node"] for r in graph.impact(edges, "a").collect()} == {"a", "b", "c", "d"}
    assert graph.impact(edges, "nowhere").count() == 0


def test_identity_round_trip(spark):
    row = spark.createDataFrame([("Shop/App", "GET /api/{id} 100%25")], "a string, v string").select(I.mint(("app", F.col("a")), ("endpoint", F.col("v"))).alias("i"))
    got = row.select("i", I.short_name(F.col("i")), I.owning_app(F.col("i"))).first()
    assert got[0] == "node://app:Shop%2FApp/endpoint:GET %2Fapi%2F{id} 100%2525"
    assert got[1] == "GET /api/{id} 100%25" and got[2] == "Shop/App"


def test_diff_apply_and_carry(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "identity string"), spark.createDataFrame([("y",), ("z",)], "identity string")
    assert snapshots.diff(a, a, ["identity"]).count() == 0
    assert values(snapshots.diff(a, b, ["identity"])) == [("x", "removed"), ("z", "added")]
    carried = snapshots.carry_nodes(a, a.where("identity = 'x'"), b.where("identity = 'z'"))
    assert values(carried) == [("y", "carried"), ("z", "fresh")]


def test_configuration():
    rows = [("P", [], ["B", "F"], False, False), ("B", [], [], False, False), ("F", [], [], False, False)]
    assert config.check(rows) == ["B", "F", "P"]
    with pytest.raises(ValueError, match="A -> B -> A"):
        config.check([("A", [], ["B"], False, False), ("B", [], ["A"], False, False)])
    with pytest.raises(ValueError, match="unknown child"):
        config.check([("A", [], ["B"], False, False)])


def test_repository_rules(spark):
    files = spark.createDataFrame([("App.sln", 'Project("x") = "A", "A\\A.csproj"'), ("A/A.csproj", ""), ("B/B.csproj", ""), ("web/package.json", '{"dependencies":{"react":"1"}}'), ("site/package.json", '{"react":1, "react-dom": "react", "x":"react"}'), ("site/next.config.js", "")], "path string, text string")
    found = {(r["path"], r["technology"]) for r in repositories.artifacts(files).collect()}
    assert ("A/A.csproj", "dotnet") in found and ("B/B.csproj", "dotnet") not in found
    assert ("web/package.json", "react") in found and ("site/package.json", "react") not in found and ("site/next.config.js", "nextjs") in found


def test_extractors_find_lines_and_skip_lookalikes(spark):
    files = spark.createDataFrame([("a.tsx", "\nexport function Card() {}\n\nexport const useThing = 1;\nconst lower = () => 1;"), ("b.css", "export function Nope() {}")], "path string, text string")
    assert values(extract.react_components(files).select("path", "line", "name")) == [("a.tsx", 2, "Card")]
    assert values(extract.react_hooks(files).select("line", "name")) == [(4, "useThing")]
    assert extract.react_charts(files).count() == 0


def test_text_rules(spark):
    row = spark.range(1).select(T.normalize_route(F.lit(" API/${x}/:id/{k:int}/?q=1")), T.next_route(F.lit("app/(g)/a/[...s]/page.tsx")), T.capped_list(F.array(*map(F.lit, "abc")), 2)).first()
    assert tuple(row) == ("/api/{}/{}/{}", "/a/{s}", "a, b, …and 1 more")


def test_lines_of_many_matches(spark):
    rng = random.Random(6)
    text = "".join(rng.choice(["x", "\n", "hit", "h\nit", " "]) for _ in range(5000))
    files = spark.createDataFrame([("a", text), ("b", "no"), ("c", None), ("d", "hit")], "path string, text string")
    got = sorted((r.path, r.line, r.g1) for r in extract.occurrences(files, r"h\n?it", 0).collect())
    import re
    expected = [("a", text.count("\n", 0, m.start()) + 1, m[0]) for m in re.finditer(r"h\n?it", text)] + [("d", 1, "hit")]
    assert got == sorted(expected) and len(got) > 1500


def test_capabilities_against_all_pairs(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abAB.") for _ in range(n))
    names, rules = [word(rng.randint(1, 9)) for _ in range(200)], [(i, word(rng.randint(0 if i > 28 else 1, 4)), f"c{i}") for i in range(30)]
    got = {r.name: r.category for r in resolve.capability(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(rules, "rule int, fragment string, category string")).collect()}
    expected = {n: next((c for _, f, c in rules if f.upper() in n.upper()), None) for n in names}
    assert got == {n: c for n, c in expected.items() if c}


def test_strong_components_against_closure(spark):
    rng = random.Random(12)
    for size in (8, 14):
        pairs = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(size)}
        nodes = {x for p in pairs for x in p}
        reach = {(a, b) for a, b in pairs}
        while True:
            more = reach | {(a, d) for a, b in reach for c, d in pairs if b == c}
            if more == reach:
                break
            reach = more
        expected = {n: min(m for m in nodes if m == n or ((n, m) in reach and (m, n) in reach)) for n in nodes if (n, n) in reach}
        got = {r.node: r.root for r in graph.strong_components(spark.createDataFrame(sorted(pairs), "child string, parent string")).collect()}
        assert got == expected
    assert graph.strong_components(spark.createDataFrame([], "child string, parent string")).count() == 0


def test_ancestors_end_on_circles(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "node string, parent string")
    children = spark.createDataFrame([("a",), ("c",)], "node string")
    assert values(graph.nearest_ancestor(children, parents, spark.createDataFrame([("d", "v")], "node string, value string"))) == [("c", "v")]
    assert graph.nearest_ancestor(children.where("false"), parents, spark.createDataFrame([("d", "v")], "node string, value string")).count() == 0


def test_refused_calls_take_no_room(spark):
    uses = spark.createDataFrame([("t", i, "2024-01-01 00:00:%02d" % i, n) for i, n in enumerate((50, 60, 40, 10, 5))], "tier string, id int, at string, n long").selectExpr("tier", "id", "cast(at as timestamp_ntz) as at", "n")
    assert [r.admitted for r in runs.admitted(uses, 100, "tier", "at", "n").orderBy("id").collect()] == [True, False, True, True, False]
    assert all(r.admitted for r in runs.admitted(uses, 0, "tier", "at", "n").collect())


def test_edges_keep_their_evidence(spark):
    found = spark.createDataFrame([(2, "T", "a", "b", [("f2",)], 0.5), (1, "T", "a", "b", [("f1",)], 0.5), (3, "T", "a", "a", [], 1.0)], "seq long, type string, from_id string, to_id string, evidence array<struct<file:string>>, confidence double")
    rows = merge.merged_edges(found).collect()
    assert len(rows) == 1 and [e.file for e in rows[0].evidence] == ["f1", "f2"] and rows[0].confidence == pytest.approx(0.75)


def test_estate_files(spark):
    said = """# the estate
applications:
  - name: Shop   # with a comment
    repos: [https://host/a.git#dev, /local/b]
    children:
      - Api
    skipIfUnchanged: true
    unknown: 1
  - name: "Api"
    repos:
    - https://host/c.git
  - repos: [x]
"""
    rows = {r["name"]: r for r in config.load_applications(spark, said).collect()}
    assert rows["Shop"].repos == ["https://host/a.git#dev", "/local/b"] and rows["Shop"].children == ["Api"] and rows["Shop"].skip_if_unchanged
    assert rows["Api"].repos == ["https://host/c.git"] and not rows["Api"].force and set(rows) == {"Shop", "Api"}
    assert config.load_applications(spark, '{ // json\n "applications": [{"name": "J", "repos": [], }] }').count() == 1
    assert config.read_yaml("") == {}


def test_providers():
    from lodestar.plans import providers

    waited, tries = [], []

    def busy(prompt):
        tries.append(prompt)
        raise providers.Refused(429, 9000 if len(tries) == 1 else None)

    def never(prompt):
        raise providers.Refused(401)

    got = providers.rewrite("plain", "p", "b", {"a": lambda p: "said " + p, "b": busy}, waited.append)
    assert got.text == "said p" and got.provider == "a" and waited == [3000, 1000, 2000] and len(tries) == 4
    assert providers.rewrite("plain", "p", "Auto", {"x": never, "y": lambda p: " "}) == providers.Rewritten("plain", None, (("x", "status 401"), ("y", "empty answer")))
    assert providers.rewrite("plain", "p", "Auto", {}).text == "plain"


def test_sources_and_files(spark, tmp_path):
    (tmp_path / "tree/src").mkdir(parents=True)
    (tmp_path / "tree/node_modules").mkdir()
    for name, text in (("src/a.ts", "x"), ("src/a.spec.ts", "x"), ("node_modules/b.ts", "x"), ("README.md", "r" * 30), ("CLAUDE.md", "c")):
        (tmp_path / "tree" / name).write_text(text)
    files = repositories.read_files(spark, str(tmp_path / "tree"))
    assert {r.path for r in files.collect()} == {"src/a.ts", "src/a.spec.ts", "README.md", "CLAUDE.md"}
    assert [r.path for r in repositories.sources(files).collect()] == ["src/a.ts"]
    assert tuple(repositories.notes(files, 10).first()) == ("README.md", "r" * 10 + "\n…")
    assert repositories.notes(files.where("false")).count() == 0


def test_lexing_keeps_places_and_hides_comments_and_strings():
    from lodestar.operators import lexing

    text = """const a = "x // {"; // y "z"
/* class Q {} */ const t = `b ${"}"} c`; const r = /["'`]/g; it's
call(a, { method: 'POST' });
"""
    code, tokens = lexing.read(text, "script")
    assert len(code) == len(text) and code.count("\n") == text.count("\n") and "class" not in code and "z" not in code
    assert lexing.read(code, "script")[0] == code  # nothing left to hide
    by = {(t[0], t[1]): t for t in tokens}
    assert by["s", "x // {"][11] == "a" and by["t", 'b ${"}"} c'][11] == "t" and ("r", "[\"'`]") in by
    post = by["s", "POST"]
    assert tokens[post[6]][1] == "{" and tokens[post[7]][9] == "call" and tokens[post[7]][13] == len(tokens) - 2 and post[2] == 3
    sharp = 'var s = @"a ""b"" { // no"; var c = \'"\'; #region X\n#region class Y\n$"""q "class Z" """;'
    code, tokens = lexing.read(sharp, "sharp")
    assert len(code) == len(sharp) and "class" not in code and [t[1] for t in tokens if t[0] == "s"] == ['a ""b"" { // no', '"', 'q "class Z" ']
    assert lexing.read("", "sharp") == ("", []) and lexing.read('"open\n{', "script")[0] == '"open\n{'


@pytest.mark.parametrize("wrap", ["comment", "string"])
def test_nothing_is_found_in_comments_and_strings(spark, wrap):
    from lodestar.operators import dotnet
    from lodestar.operators.facts import Sources
    from lodestar.plans import sources

    rows = []
    for path, text in sources.REACT + sources.ANGULAR + sources.DOTNET:
        text = text.replace("__K__", "1").replace("*/", "").replace("/*", "")
        if path.endswith((".ts", ".tsx")):
            text = f"/* {text} */" if wrap == "comment" else "const x = '" + text.replace("\\", "").replace("'", "").replace("\n", "\\n") + "';"
        elif path.endswith(".cs"):
            text = f"/* {text} */" if wrap == "comment" else 'var x = @"' + text.replace('"', '""') + '";'
        else:
            continue
        rows.append((path.replace("__K__", "1"), text))
    src = Sources.of(spark.createDataFrame(rows, "path string, text string"))
    for name, x in (extract.EXTRACTORS | dotnet.EXTRACTORS).items():
        if name in ("next_routes", "csharp_program", "packages", "configuration", "vulnerabilities", "secret_findings", "angular_template_tags"):
            continue  # by path, not by code, or about strings
        assert x(src).count() == 0, name


def test_properties_are_declared_once_for_both_sides(spark):
    from lodestar.operators import dotnet, facts
    from lodestar.plans import sources

    with pytest.raises(ValueError, match="Endpoint has no property speed"):
        facts.prop("Endpoint", "speed")
    with pytest.raises(ValueError, match="Hook has no property kind"):
        facts.facts(spark.range(1), "Hook", F.lit("x"), facts.Properties(kind=F.lit("y")), 1.0)
    src = facts.Sources.of(spark.createDataFrame([(p, t) for p, t in sources.REACT + sources.ANGULAR + sources.DOTNET], "path string, text string"))
    read = {"Endpoint": {"verb", "route", "authorization", "parameters"}, "Filter": {"component", "shape"}, "Route": {"path", "protected", "roles"}, "DatabaseOperation": {"owner", "entity"}, "AuditLog": {"entity"}, "BusinessRule": {"owner"}, "FormField": {"form"}, "TokenStorage": {"operation"}, "Entity": {"fields"}, "StatusWorkflow": {"values"}}
    some = (extract.react_routes, extract.react_filters, extract.react_form_fields, extract.frontend_auth, dotnet.csharp_endpoints, dotnet.csharp_database_operations, dotnet.csharp_audits, dotnet.csharp_business_rules, dotnet.csharp_entities, dotnet.status_workflows)
    wrote = {}
    for x in some:
        for r in x(src).where("source is null").select("kind", F.explode(F.map_keys("properties")).alias("p")).distinct().collect():
            wrote.setdefault(r.kind, set()).add(r.p)
    assert all(names <= wrote[kind] for kind, names in read.items())
    assert all(p in facts.PROPERTIES[k] for k, ps in wrote.items() for p in ps)


def test_projects_are_read_as_xml(spark):
    from lodestar.operators import dotnet

    text = """<Project Sdk='Microsoft.NET.Sdk'>
  <!-- <PackageReference Include="Serilog" Version="1" /> -->
  <PropertyGroup Condition="'a' == 'b'"><OutputType>Exe</OutputType></PropertyGroup>
  <ItemGroup>
    <PackageReference Version='2.1' Include='Dapper' PrivateAssets="all"/>
    <PackageReference Include="MediatR" Condition="false" Version="9" />
    <PackageReference Include="Polly" Condition="'$(X)' == 'y'"><Version> 8 </Version></PackageReference>
  </ItemGroup>
  <ItemGroup Condition="'1' == '2'"><PackageReference Include="NLog" Version="5" /></ItemGroup>
</Project>"""
    rows = {(r.kind, r.name): r for r in dotnet.packages(spark.createDataFrame([("a/B.csproj", text), ("c/Bad.csproj", "<Project"), ("d/Empty.csproj", None)], "path string, text string")).collect()}
    assert set(rows) == {("Project", "B"), ("Project", "Bad"), ("Project", "Empty"), ("Technology", "Dapper"), ("Technology", "Polly")}
    assert rows["Technology", "Dapper"].properties["version"] == "2.1" and rows["Technology", "Dapper"].line == 5 and rows["Technology", "Polly"].properties["version"] == "8"
    assert rows["Project", "B"].properties["kind"] == "library"


def test_resolvers_use_each_others_edges_in_any_order(spark):
    from lodestar.operators import resolvers

    evidence = lambda repo: [(repo, "c", "e", "m", 1.0, "f", 1, "s")]
    nodes = spark.createDataFrame([
        (1, "call", "ApiCall", {"name": "GET /a", "verb": "GET", "route": "/a"}, evidence("web"), 1.0), (2, "end", "Endpoint", {"name": "GET /a", "verb": "GET", "route": "/a"}, evidence("api"), 1.0),
        (3, "rw", "SourceRepository", {"name": "web"}, evidence("web"), 1.0), (4, "ra", "SourceRepository", {"name": "api"}, evidence("api"), 1.0)], f"seq long, identity string, kind string, properties map<string,string>, evidence {resolvers_evidence()}, confidence double")
    edges = spark.createDataFrame([("PUBLISHES", "p", "m", 0.5), ("CONSUMES", "c", "m", 0.5)], "type string, from_id string, to_id string, confidence double")
    expected = {("MAPS_TO", "call", "end"), ("DEPENDS_ON", "rw", "ra"), ("PUBLISHES", "p", "c")}
    for registry in (resolvers.REGISTRY, resolvers.REGISTRY[::-1]):
        assert {tuple(r)[:3] for r in resolvers.resolved(nodes, edges, registry).collect()} == expected
    grows = resolvers.Resolver("grows", lambda n, e, new: new.select(F.concat("to_id", F.lit("x")).alias("from_id"), F.concat("to_id", F.lit("xx")).alias("to_id"), F.lit(1.0).alias("confidence")), "PUBLISHES", ("PUBLISHES",))
    old, resolvers.ROUNDS = resolvers.ROUNDS, 3
    try:
        with pytest.raises(RuntimeError, match="still add"):
            resolvers.resolved(nodes, edges, (grows,))
    finally:
        resolvers.ROUNDS = old


def resolvers_evidence():
    from lodestar.sources.stores import EVIDENCE
    return EVIDENCE


def test_changed_files_and_folders(spark):
    from lodestar.operators import trees

    files = lambda **f: spark.createDataFrame([(k.replace("_", "/"), v) for k, v in f.items()] or [], "path string, digest string")
    one, two = files(a="1", d_b="2", d_e_c="3", x_y="4"), files(a="1", d_b="9", d_e_c="3", d_n="5", x_y=None)
    assert trees.changed_files(None, one) is None and trees.changed_files(one, one).count() == 0 and trees.changed_files(files(), files()).count() == 0
    assert values(trees.changed_files(one, two)) == [("d/b", "changed"), ("d/n", "added"), ("x/y", "changed")]
    assert values(trees.changed_files(one, files())) == [(p, "deleted") for p in ("a", "d/b", "d/e/c", "x/y")]
    same = {r.folder: r for r in trees.folder_digests(one).collect()}
    assert set(same) == {"", "d", "d/e", "x"} and same["d/e"].parent == "d" and same[""].parent is None and same["x"].own == same["x"].whole


def test_inherited_values_take_few_rounds(spark, monkeypatch):
    chain = [(f"n{i}", f"n{i + 1}" if i < 40 else None, "top" if i == 40 else None) for i in range(41)] + [("a", "b", None), ("b", "a", None), ("lone", "gone", None), ("own", "n3", "mine")]
    rounds = []
    kept = graph.durable
    monkeypatch.setattr(graph, "durable", lambda df: rounds.append(1) or kept(df))
    got = dict(values(graph.inherited(spark.createDataFrame(chain, "node string, parent string, value string"), 8)))
    assert got == {f"n{i}": "top" for i in range(41)} | {"own": "mine"} and len(rounds) <= 9
    methods = spark.createDataFrame([("m1", "C", "[Authorize]"), ("m2", "C", None), ("m3", "D", "[AllowAnonymous, Authorize]"), ("m4", "E", None), ("m5", None, None)], "method string, node string, attributes string")
    types = spark.createDataFrame([("C", "B", None), ("B", None, "[Authorize(Policy = 1)]"), ("D", "B", None), ("E", "B", "[AllowAnonymous]")], "node string, parent string, attributes string")
    assert dict(values(graph.authorization(methods, types))) == {"m1": "Authorize", "m2": "Authorize(Policy = 1)", "m3": "anonymous", "m4": "anonymous", "m5": None}


def test_grounding_stays_within_its_budget(spark):
    from lodestar.operators import reports

    rows = spark.createDataFrame([("p", i, "x" * n) for i, n in enumerate((3, 4, 50, 1))] + [("q", 0, "y" * 99), ("q", 1, None)], "page string, at int, line string")
    got = {r.page: (r.text, r.facts) for r in reports.grounded(rows, [F.col("at").asc()], 10).collect()}
    assert got == {"p": ("xxx\nxxxx", 2)} and reports.grounded(rows.limit(0), [F.col("at").asc()]).count() == 0


def test_trailing_sums_at_the_window_edges(spark):
    from datetime import datetime, timedelta

    from lodestar.operators import runs
    start, rng = datetime(2024, 3, 1), random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), start + timedelta(seconds=rng.choice([0, 1, 59, 60, 61, 119, 120, 121, 300]), microseconds=rng.choice([0, 0, 1, 999_999])), rng.choice([0, 1, 5, 70, None, -2])) for i in range(200)]
    rows += [(1000 + i, "a", datetime(1969, 12, 31, 23, 59, 30 + i), 1) for i in range(30)] + [(2000, "n", start, None), (2001, "t", None, 4), (2002, "t", None, 5)]
    uses = spark.createDataFrame(rows, "id long, tier string, ts timestamp_ntz, tokens long")

    def used(t, at):
        some = [n for _, u, x, n in rows if u == t and n is not None and (x is None if at is None else x is not None and at - timedelta(seconds=60) <= x <= at)]
        return sum(some) if some else None

    summed = runs.trailing_sum(uses, "tier", "ts", "tokens", 60)
    assert summed.columns == ["id", "tier", "ts", "tokens", "used"]
    assert sorted((r.id, r.used) for r in summed.collect()) == sorted((i, used(t, at)) for i, t, at, _ in rows)
    assert all("tier" in line and "span" in line for line in summed._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.strip(" +-:").startswith("Window"))  # no window over a whole tier


def test_pairs_of_a_common_value_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(resolve, "SIDE", 7)
    left = [(i, "hot" if i < 30 else None if i < 33 else f"k{i}") for i in range(40)]
    right = [(100 + i, "hot" if i < 50 else None if i < 52 else f"k{i - 20}") for i in range(60)] + [(7, "hot"), (7, "hot")]
    make = lambda rows: spark.createDataFrame(rows, "id long, p string")
    found = resolve.equal_property(make(left), make(right), "p")
    assert values(found) == sorted(((a, b, p) for a, p in left for b, q in right if p is not None and p == q), key=repr)
    assert max(found.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 30 * 52  # the common value's pairs are in several tasks


def test_generated_sources_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    from lodestar.plans import sources
    from lodestar.plans.starmap import Star
    spark.range(40).selectExpr("id as s_suppkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    star, templates = Star(spark, str(tmp_path)), [("a__K__.ts", "x__K__"), ("b__K__.cs", "y")]
    whole = values(sources.files(star, templates))
    monkeypatch.setattr(sources, "FILES", 8)
    dealt = sources.files(star, templates)
    assert dealt.rdd.getNumPartitions() == 10 and values(dealt) == whole and len(whole) == 80


@pytest.mark.parametrize("tokens", [1, 7, 10**6])
def test_scan_hands_on_files_together(monkeypatch, tokens):
    import pyarrow as pa

    from lodestar.operators import lexing
    monkeypatch.setattr(lexing, "TOKENS", tokens)
    files = [("a.ts", "const a = f('x'); // no", "r1"), ("b.html", "<p><!-- no -->x</p>", "r2"), ("c.cs", "class C : B { }", "r3"), ("d.cs", None, "r4"), (None, "x", "r5"), ("e.tsx", "g(`t`)", None)]
    batch = pa.RecordBatch.from_arrays([pa.array([f[k] for f in files], pa.string()) for k in range(3)], names=["path", "text", "repository"])
    out = list(lexing._run([batch]))
    assert len(out) == {1: 3, 7: 2, 10**6: 1}[tokens]
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["path"], r["repository"]) for r in rows] == [(f[0], f[2]) for f in files]
    for r, (path, text, _) in zip(rows, files):
        language = {"ts": "script", "tsx": "script", "cs": "sharp"}.get((path or "").rsplit(".", 1)[-1])
        if language:
            code, told = lexing.read(text or "", language)
            assert r["text"] == code and [tuple(t.values()) for t in r["tokens"]] == told
        else:
            assert r["tokens"] == []


def test_neighbours_of_tokens(spark):
    from lodestar.operators import lexing
    scanned = lexing.scan(spark.createDataFrame([("a.ts", "a b c d 'e' f g h"), ("b.ts", "")], "path string, text string"))
    said = ["a", "b", "c", "d", '"e', "f", "g", "h"]
    rows = {r["i"]: r for r in lexing.explode(scanned).collect()}
    assert sorted(rows) == list(range(8))
    for i, r in rows.items():
        assert r["back"] == said[max(0, i - 6) : i][::-1] and r["ahead"] == said[i + 1 : i + 7] and r["path"] == "a.ts"


def test_brief_scan_gives_code_and_words(spark):
    from lodestar.operators import lexing
    from lodestar.plans import sources
    rng = random.Random(7)
    bits = ["class A", " /* x \n y */", "// no\n", '@"a ""b"" {"', '$"q {x}"', '"""raw "q" """', "'c'", "\n  #region z\n", "#if x\n", "@word", "a.b?.c", '"open\n', "'", "é9_", "1.5f", "{}", "\\", "x=>y;"]
    texts = [t for _, t in sources.DOTNET] + ["", *("".join(rng.choices(bits, k=12)) for _ in range(300))]
    for text in texts:
        code, tokens = lexing.read(text, "sharp")
        assert lexing.brief(text) == (code, list(dict.fromkeys(t[1] for t in tokens if t[0] == "w")))
    files = spark.createDataFrame([("a.cs", "class A { A b; }", "k1"), ("b.ts", "let x = 'y'", "k2"), ("c.cs", None, "k3"), ("d.md", "class", "k4")], "path string, text string, key string").coalesce(1)
    whole, short = ({r["path"]: r for r in lexing.scan(files, b).collect()} for b in (False, True))
    assert {p: (r["text"], r["key"]) for p, r in whole.items()} == {p: (r["text"], r["key"]) for p, r in short.items()}
    assert {p: r["words"] for p, r in short.items()} == {"a.cs": ["class", "A", "b"], "b.ts": [], "c.cs": [], "d.md": []}
    assert whole["a.cs"]["tokens"] and not short["a.cs"]["tokens"] and short["b.ts"]["tokens"] == whole["b.ts"]["tokens"]


def test_report_pages_tells_every_page():
    import duckdb

    from lodestar.operators import reports
    from lodestar.queries import registry
    con = duckdb.connect()
    con.execute("create table supplier as select range as s_suppkey from range(3)")
    told = {r[0] for r in con.execute(registry.oracle_sql()["report_pages"]).fetchall()}  # the twin compares the rows
    assert told == {p.lower().replace(" ", "-") + ".md" for p in reports.PAGES} - {"messaging.md", "workflows.md"}


def test_brief_scan_is_the_whole_scan_for_any_order_of_marks():
    from lodestar.operators import lexing
    rng = random.Random(1)
    parts = ["a", "$", "@", '"', '""', '"""', "\\", "\n", "\n#if ", "#", "  #region it's", "'", "'x'", "//", "/*", "*/", "9", "1.5f", "é", "_x", " ", "{", '$@"c:\\"', 'x$"b{c}"', '$$"""q"""', "."]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        code, tokens = lexing.read(text, "sharp")
        assert lexing.brief(text) == (code, list(dict.fromkeys(t[1] for t in tokens if t[0] == "w"))), text


def test_matches_are_found_by_one_pass_of_a_pattern(spark):
    from lodestar.operators.extract import occurrences
    text = "x\n\ufdd0a1;\n\na2\ufdd1\n;b\na3;"
    rows = occurrences(spark.createDataFrame([("p", text), ("q", "none"), ("r", "")], "path string, text string"), r"a(\d)([^;]*);(z)?", 1, 2, 3, rest=True)
    assert [tuple(r) for r in rows.select("path", "line", "g1", "g2", "g3", "from_line").orderBy("line").collect()] == [("p", 2, "1", "", "", 2), ("p", 4, "2", "\ufdd1\n", "", 5), ("p", 6, "3", "", "", 6)]
    assert [r["text"] for r in rows.orderBy("line").collect()] == ["\n\n", "b\n", ""]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("regexp_replace(") <= 2  # at most once more, to leave files without matches out


def test_rules_work_out_the_neighbours_they_ask_for(spark):
    from lodestar.operators import extract as X
    from lodestar.operators.facts import Sources
    files = spark.createDataFrame([("a.ts", "f('x', y); z"), ("a.d.ts", "f('x')"), ("b.tsx", "g(`t`)"), ("c.js", "h('q')"), ("d.ts", "")], "path string, text string")
    src = Sources.of(files)
    found = X.first_arguments(src.script(X.TS, few=True))
    assert sorted(tuple(r) for r in found.collect()) == [("a.ts", 1, "x"), ("b.tsx", 1, "t"), ("c.js", 1, "q")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array(" not in plan  # of the twelve neighbours only one
    assert plan.index("Generate") < plan.index("RLIKE")  # a file's path is looked at once, before its tokens are told apart
    rows, whole = ({(r["path"], r["i"]): r.asDict() for r in t.collect()} for t in (src.script(few=True), src.script()))
    for r in rows.values():
        assert len(r["back"]) == len(r["ahead"]) == 6
        r["back"], r["ahead"] = ([x for x in r[side] if x is not None] for side in ("back", "ahead"))
    assert rows == whole and len(rows) == 8 + 3 * 4


def test_providers_are_looked_for_in_different_modules(spark):
    from lodestar.operators import extract as X
    files = [(f"p{k}.ts", '\n' * (k % 3) + 'import { A } from "@auth0/a";\nimport b from "./b";\nimport { P } from "@azure/msal-react";') for k in range(9, 0, -1)] + [("q.ts", 'import { Q } from "auth0-js";')]
    found = X.frontend_auth(spark.createDataFrame(files, "path string, text string"))
    assert sorted((r["path"], r["line"], r["name"], r["properties"]["import"]) for r in found.collect()) == [("p1.ts", 2, "auth0", "@auth0/a"), ("p1.ts", 4, "msal", "@azure/msal-react")]
    met = found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner, RLIKE(")
    assert len(met) == 2 and "Aggregate [text" in met[1].split("Join")[0]  # each module meets the rules once


@pytest.mark.parametrize("name", ["frontend_auth", "react_imports_exports", "react_grids"])
def test_few_looks_write_the_scan_alone(spark, monkeypatch, name):
    from lodestar.operators import extract as X
    from lodestar.operators import facts
    from lodestar.plans import sources
    written = []
    monkeypatch.setattr(facts, "stored", lambda df: written.append(df.columns) or df)
    found = X.EXTRACTORS[name](spark.createDataFrame(sources.REACT, "path string, text string"))
    assert found.count() and written == [["path", "text", "tokens", "words"]]


def _changed(spark):
    n = spark.createDataFrame([(f"node://app:{a}/x:{i}", "added") for a in "AB" for i in range(7)] + [("node://repo:1/x:0", "added")], "identity string, change string")
    e = spark.createDataFrame([("T", "node://app:A/x:1", "node://app:B/x:2", "removed"), ("T", "node://app:A/x:1", "node://app:A/x:2", "removed"), ("T", "node://repo:1/x:0", "node://app:B/x:2", "added")], "type string, from_id string, to_id string, change string")
    return n, e


def test_a_version_counts_what_its_labels_tell(spark):
    n, e = _changed(spark)
    record = snapshots.version_change("A", 2, n, e)
    assert values(record) == [("A", 2, 14, 0, 0, 2, ["A", "B"], 1, 1)]  # an edge without an owner crosses, but is in no list
    assert "collect_list" not in record._jdf.queryExecution().toString()  # no row holds a list
    assert snapshots.change_labels(n, e).groupBy("list").count().where("list = 'removed_edges'").first()["count"] == 2
    none = snapshots.version_change("A", 2, n.limit(0), e.limit(0))
    assert values(none) == [("A", 2, 0, 0, 0, 0, [], 0, 0)]


def test_digests_of_lists_go_through_batches(spark):
    import hashlib

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # a list goes on in the next batch
    try:
        got = snapshots.list_digests(snapshots.change_labels(*_changed(spark)))
        rows = {r["app"]: tuple(r)[1:] for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    md5 = lambda *labels: hashlib.md5(",".join(sorted(labels)).encode()).hexdigest()
    nodes = {a: md5(*[f"node://app:{a}/x:{i}" for i in range(7)]) for a in "AB"}
    assert rows == {"A": (nodes["A"], "", "", md5("T node://app:A/x:1 -> node://app:B/x:2", "T node://app:A/x:1 -> node://app:A/x:2")), "B": (nodes["B"], "", "", "")}
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_routes_work_out_their_windows_once(spark):
    """The tokens dealt to routes are written once: no window stands in the plan of the rules that look at them."""
    text = 'import { Route } from "react-router-dom";\nconst a = <Routes><Route path="/u" element={<PrivateRoute><Users /></PrivateRoute>} /></Routes>;\n'
    found = extract.react_routes(spark.createDataFrame([("r/src/a.tsx", text), ("r/src/b.ts", 'const r = createBrowserRouter([{ path: "/b", element: <B /> }]);\n')], "path string, text string"))
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.kind, r.name) for r in found.collect()} == {("Route", "/u"), ("Route", "/b"), ("RENDERS", "PrivateRoute"), ("RENDERS", "Users"), ("RENDERS", "B")}
