"""Scalar text rules over table columns and rows for each supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.plans import sources
from lodestar.plans.starmap import Star
from lodestar.queries.merging import _NORM
from lodestar.queries.registry import query


@query(f"select page_id, {_NORM.format('url')} as route from pages")
def route_normalize(spark, sf_dir):
    return Star(spark, sf_dir).table("pages").select("page_id", T.normalize_route(F.col("url")).alias("route"))


@query(r"select s_suppkey, regexp_replace('api/{id' || s_suppkey || ':int}/x', '\{([A-Za-z0-9_]+)[^{}]*\}', '{\1}', 'g') as route from supplier")
def route_constraint_strip(spark, sf_dir):
    s = Star(spark, sf_dir).table("supplier")
    return s.select("s_suppkey", T.strip_constraints(F.concat(F.lit("api/{id"), "s_suppkey", F.lit(":int}/x"))).alias("route"))


_FILES = [("p__K__/app/page.tsx", "/"), ("p__K__/src/app/(shop)/items__K__/[id]/page.tsx", "/items__K__/{id}"), ("p__K__/app/docs/[...slug__K__]/page.tsx", "/docs/{slug__K__}"), ("p__K__/app/a__K__/layout.tsx", "/a__K__")]


@query(f"select * from {sources.products_sql(_FILES, 'path, route')}")
def next_route(spark, sf_dir):
    return sources.products(Star(spark, sf_dir), [(p,) for p, _ in _FILES], "path string").select("path", T.next_route(F.col("path")).alias("route"))


_TEMPLATES = [
    ("Customer__K__Controller", "api/[controller]", "{id}", "Get", "/api/Customer__K__/{id}"), ("Home__K__Controller", None, None, "Index", "/Home__K__/Index"), ("A__K__Controller", "api/a", "/health__K__", "Ping", "/health__K__"),
    ("B__K__Controller", "[controller]/[action]", None, "List", "/B__K__/List")]


@query(f"select * from {sources.products_sql([(c, r) for c, *_, r in _TEMPLATES], 'controller, route')}")
def resolve_route(spark, sf_dir):
    t = sources.products(Star(spark, sf_dir), [x[:4] for x in _TEMPLATES], "controller string, class_template string, method_template string, action string")
    return t.select("controller", T.resolve_route(F.col("controller"), F.col("class_template"), F.col("method_template"), F.col("action")).alias("route"))


@query("select c_custkey, upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) || ' ' || (c_custkey % 7) as label from customer")
def humanize(spark, sf_dir):
    c = Star(spark, sf_dir).table("customer")
    return c.select("c_custkey", T.humanize(F.concat(F.lower("c_mktsegment"), F.lit("-_."), F.col("c_custkey") % 7)).alias("label"))


@query("select p_partkey, case when ends_with(w, 'ies') then w[1:-4] || 'y' when ends_with(w, 's') then w[1:-2] else w end as one from (select p_partkey, split_part(p_name, ' ', 1) || case when p_partkey % 3 = 0 then 's' when p_partkey % 3 = 1 then 'ies' else '' end as w from part)")
def singular(spark, sf_dir):
    p = Star(spark, sf_dir).table("part")
    word = F.concat(F.substring_index("p_name", " ", 1), F.when(F.col("p_partkey") % 3 == 0, "s").when(F.col("p_partkey") % 3 == 1, "ies").otherwise(""))
    return p.select("p_partkey", T.singular(word).alias("one"))


@query("""select p_partkey, case verb when 'GET' then case when by_id then 'View a Part' else 'List Parts' end when 'POST' then 'Create a Part' when 'PUT' then 'Update a Part' when 'DELETE' then 'Delete a Part' else verb || ' Parts' end as phrase
from (select p_partkey, ['GET', 'POST', 'PUT', 'DELETE', 'HEAD'][p_partkey % 5 + 1] as verb, p_size > 25 as by_id from part)""")
def use_case_phrase(spark, sf_dir):
    p = Star(spark, sf_dir).table("part")
    verb = F.element_at(F.array(*map(F.lit, ("GET", "POST", "PUT", "DELETE", "HEAD"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", T.use_case_phrase(verb, F.lit("Parts"), F.col("p_size") > 25).alias("phrase"))


_SETTERS = [("menu__K__Open", None), ("selected__K__Ids", "multi-select"), ("Selected__K__Tags", "multi-select"), ("active__K__Filters", "multi-select"), ("active__K__Tab", "tab"), ("status__K__", "single-value")]


@query(f"select * from {sources.products_sql(_SETTERS, 'name, shape')}")
def classify_shape(spark, sf_dir):
    return sources.products(Star(spark, sf_dir), [(n,) for n, _ in _SETTERS], "name string").select("name", T.classify_shape(F.col("name")).alias("shape"))


@query("select doc_id, greatest(1, length(text) // 4)::bigint as tokens from documents")
def token_estimate(spark, sf_dir):
    return Star(spark, sf_dir).table("documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("select page_id, regexp_replace(lower(split_part(url, '#', 1)), '[^a-z0-9]', '-', 'g') as slug from pages")
def slug(spark, sf_dir):
    return Star(spark, sf_dir).table("pages").select("page_id", T.slug(F.substring_index("url", "#", 1)).alias("slug"))


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def json_props(spark, sf_dir):
    e = Star(spark, sf_dir).table("events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("select doc_id, case when length(text) > 80 then text[1:80] || '…' else text end as head from documents")
def truncate_marker(spark, sf_dir):
    return Star(spark, sf_dir).table("documents").select("doc_id", T.truncated(F.col("text"), 80).alias("head"))


@query("select n_name, 'Nation ' || n_name || ' of {{planet}} no ' || n_nationkey as page from nation")
def template_render(spark, sf_dir):
    n = Star(spark, sf_dir).table("nation")
    return n.select("n_name", T.render_template(F.lit("Nation {{name}} of {{planet}} no {{key}}"), F.create_map(F.lit("name"), F.col("n_name"), F.lit("key"), F.col("n_nationkey").cast("string"))).alias("page"))


_USAGE = "Order__K__Service: Query, Save; Cart__K__Service: Query , ; Empty:"


@query(f"""with u as (select replace('{_USAGE}', '__K__', s_suppkey::varchar) as u from supplier), s as (select trim(x) as part from (select unnest(string_split(u, ';')) as x from u)),
k as (select split_part(part, ':', 1) as class, unnest(string_split(split_part(part, ':', 2), ',')) as op from s) select class, trim(op) as op from k where trim(op) <> ''""")
def usage_parse(spark, sf_dir):
    s = sources.products(Star(spark, sf_dir), [(_USAGE,)], "u string").select(F.explode(T.split_list(F.col("u"), ";")).alias("p"))
    return s.select(F.substring_index("p", ":", 1).alias("class"), F.explode(T.split_list(F.substring_index("p", ":", -1), ",")).alias("op"))


_URLS = [("https://host.example/x/repo__K__.git#dev", "repo__K__", "dev"), ("https://host.example/x/app__K__/", "app__K__", None), ("/local/dir/tool__K__", "tool__K__", None), ("https://host.example/y/z__K__.git", "z__K__", None)]


@query(f"select * from {sources.products_sql(_URLS, 'url, name, branch')}")
def repository_names(spark, sf_dir):
    from lodestar.sources.repositories import branch_of, repository_name
    return sources.products(Star(spark, sf_dir), [(u,) for u, *_ in _URLS], "url string").select("url", repository_name(F.col("url")).alias("name"), branch_of(F.col("url")).alias("branch"))
