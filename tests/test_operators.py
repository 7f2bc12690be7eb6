"""Cases that the tables can't supply, and differential tests against plain Python written from the semantics."""

from __future__ import annotations

import http.server
import json
import random
import threading
import time
from types import SimpleNamespace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factgrid.functions import text
from factgrid.operators import audit, cache, export, extract, gapfill, merge, pages, route, search
from factgrid.operators.retry import call_with_retries
from factgrid.plans.materialize import cut, shared_dir
from factgrid.plans.run import run_topics
from factgrid.plans.table import final_tables
from factgrid.sources import services
from factgrid.sources.html import jsonld_records, parse_sections, with_sections
from factgrid.sources.options import Options
from factgrid.sources.providers import HashEmbed, RuleExtract, RuleFill, TableFetch, TablePlan, TableSearch
from factgrid.streaming import events

CELL = "run_id string, ent_ord long, name string, field string, value string, source_url string, snippet string"
PLAN = "run_id string, ord int, field string"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize(
    ("url", "blocked", "binary", "trusted", "domain"),
    [
        ("https://www.linkedin.com/in/a", True, False, False, "linkedin.com"),
        ("https://netflix.com/a", True, False, False, "netflix.com"),
        ("http://m.facebook.com:80/a", False, False, False, "m.facebook.com:80"),
        ("http://u:p@Www.Example.org/x", False, False, False, "u:p@Www.Example.org"),
        ("https://a.gov.uk/f.PDF", False, True, True, "a.gov.uk"),
        ("https://a.org/f.pdf?x=1", False, False, False, "a.org"),
        ("not an address", False, False, False, ""),
        (None, False, None, False, ""),
    ],
)
def test_addresses(spark, url, blocked, binary, trusted, domain):
    row = spark.createDataFrame([(url,)], "u string").select(text.is_blocked(F.col("u")), text.is_binary(F.col("u")), text.is_trusted(F.col("u")), text.domain(F.col("u"))).first()
    assert tuple(row) == (blocked, binary, trusted, domain)


def test_scalars(spark):
    assert one(spark, text.round_exact(F.col("x")), x=2.675) == 2.67 and one(spark, text.round_exact(F.col("x")), x=12345.005) == round(12345.005, 2)
    assert one(spark, text.value_norm(F.col("x")), x=" $1,200 \x1f") == "1200" and one(spark, text.value_norm(F.col("x")), x="$$") == ""
    assert not any(one(spark, text.has_value(F.col("x")), x=v) for v in ("", " N/A\t", "Unknown", "-", "　null"))
    assert one(spark, text.has_value(F.col("x")), x="not stated") and one(spark, text.strip_fences(F.col("x")), x="```json\n[1]\n```") == "[1]"
    assert one(spark, text.redirect_target(F.col("x")), x="//d/l/?uddg=https%3A%2F%2Fa.b%2Fc+d&rut=1") == "https://a.b/c+d"
    assert one(spark, text.cosine(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(2.0), F.lit(2.0)))) == pytest.approx(1.0)


def same(a, b):
    short, long = sorted((a, b), key=len)
    return bool(short) and short in long and len(short) / len(long) >= 0.7


def test_greedy_groups_are_those_of_the_sequential_scan(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for run in range(25):
        names = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) + rng.choice(["", "!", " C"]) for _ in range(12)]
        rows += [(f"r{run}", i, n, "f", "v", "u", "") for i, n in enumerate(names)]
        norms = ["".join(c for c in n.lower() if c.isascii() and c.isalnum()) for n in names]
        taken: dict[int, int] = {}
        for i, a in enumerate(norms):
            if i not in taken:
                taken |= {j: i for j in range(i, len(norms)) if j not in taken and (j == i or same(a, norms[j]))}
        want |= {(f"r{run}", i): p for i, p in taken.items()}
    got = merge.greedy_groups(merge.names(spark.createDataFrame(rows, CELL))).collect()
    assert {(r.run_id, r.ent_ord): r.pivot for r in got} == want


def test_long_names_and_chains_of_names(spark):
    long = "".join(random.Random(3).choices("abcdefgh", k=10_000))
    names = [long, long[1000:9000], long[:6999], long[2000:9500], "x" + long[5:9000]]
    chain = ["k" * 1400] + ["k" * n for n in range(700, 1000, 3)]
    rows = [("long", i, n, "f", "v", "u", "") for i, n in enumerate(names)] + [("chain", i, n, "f", "v", "u", "") for i, n in enumerate(chain)]
    want = {}
    for run, listed in (("long", names), ("chain", chain)):
        taken: dict[int, int] = {}
        for i, a in enumerate(listed):
            if i not in taken:
                taken |= {j: i for j in range(i, len(listed)) if j not in taken and (j == i or same(a, listed[j]))}
        want |= {(run, i): p for i, p in taken.items()}
    got = merge.greedy_groups(merge.names(spark.createDataFrame(rows, CELL))).collect()
    assert {(r.run_id, r.ent_ord): r.pivot for r in got} == want


def test_a_path_of_matches_takes_few_rounds(spark, monkeypatch):
    edges = spark.createDataFrame([("r", f"n{i + 1}", i + 1, f"n{i}", i) for i in range(999)], "run_id string, norm_a string, ord_a long, norm_b string, ord_b long")
    monkeypatch.setattr(merge, "match_edges", lambda classes: edges)
    entities = spark.createDataFrame([("r", i, f"n{i}", f"n{i}") for i in range(1000)], "run_id string, ent_ord long, name string, norm string")
    assert {r.ent_ord: r.pivot for r in merge.greedy_groups(entities).collect()} == {i: i - i % 2 for i in range(1000)}


def test_names_that_merge_and_names_that_do_not(spark):
    names = ["Ora", "Corallo", "Redis", "Redis Enterprise", "北京", "北京", "Joe's Pizza", "joes pizza!", "Joe's Pizzas"]
    got = merge.greedy_groups(merge.names(spark.createDataFrame([("r", i, n, "f", "v", "u", "") for i, n in enumerate(names)], CELL))).collect()
    assert {r.ent_ord: r.pivot for r in got} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 6}


def test_best_values(spark):
    rows = [("r", 0, "a", "price", "prices vary depending on the season", "u", "prices vary"), ("r", 1, "a", "price", "$$", "u", "a $$ place"), ("r", 2, "a", "price", "$", "u", "")]
    assert merge.best_values(spark.createDataFrame(rows, CELL), ["run_id", "field"]).first().value == "$$"
    assert merge.best_values(spark.createDataFrame(rows[2:] + rows[:1], CELL), ["run_id", "field"]).first().value.startswith("prices")


def test_columns_of_sparse_tables(spark):
    plan = spark.createDataFrame([("r", i, f) for i, f in enumerate("abcd")], PLAN)
    rows = [("r", 0, "x", "a", "1", "u", ""), ("r", 0, "x", "b", "1", "u", ""), ("r", 1, "y", "a", "N/A", "u", ""), ("r", 2, "z", "d", None, "u", "")]
    cells = spark.createDataFrame(rows, CELL)
    entities = cells.select("run_id", "ent_ord", "name").distinct()
    got = {r.field: (r.fill, r.kept) for r in audit.audit_columns(entities, cells, plan).collect()}
    assert got == {"a": (1.0, True), "b": (1.0, True), "c": (0.0, True), "d": (0.0, False)}
    none = audit.audit_columns(entities.limit(0), cells.limit(0), plan).collect()
    assert len(none) == 4 and all(r.kept for r in none)


def naive_finalize(table, fields):
    """table: entity -> (fields with a value, confidence)."""
    rungs, working = [list(fields)], list(fields)
    fill = {f: sum(f in have for have, _ in table.values()) / len(table) for f in fields}
    while len(working) > 1:
        least = min(working, key=lambda f: fill[f])
        working = [f for f in working if f != least]
        rungs.append(working)
    rows_of = lambda cols: [e for e in table if all(f in table[e][0] for f in cols)]
    score = lambda cols: (len(rows_of(cols)) * len(cols), len(cols)) if len(rows_of(cols)) >= 3 else (0, 0)
    best = max(rungs, key=score)
    if score(best) == (0, 0):
        best = max(rungs, key=lambda cols: (len(rows_of(cols)), len(cols)))
    rows = rows_of(best) or sorted((e for e in table if set(best) & table[e][0]), key=lambda e: -sum(f in table[e][0] for f in best))[:3]
    return best, sorted(rows, key=lambda e: -table[e][1])


def test_final_rows_and_columns_are_those_of_the_ladder(spark):
    rng = random.Random(5)
    cells, entities, plans, want = [], [], [], {}
    for run in range(60):
        fields, density = "abcde"[: rng.randint(1, 5)], rng.choice([0.2, 0.5, 0.8])
        table = {e: ({f for f in fields if rng.random() < density}, rng.choice([0.1, 0.5, 0.9])) for e in range(rng.randint(1, 9))}
        plans += [(f"r{run}", i, f) for i, f in enumerate(fields)]
        entities += [(f"r{run}", e, f"n{e}", c) for e, (_, c) in table.items()]
        cells += [(f"r{run}", e, f"n{e}", f, "v", "u", "") for e, (have, _) in table.items() for f in have]
        want[f"r{run}"] = naive_finalize(table, fields)
    rows, fields = audit.finalize(spark.createDataFrame(entities, "run_id string, ent_ord long, name string, confidence double"), spark.createDataFrame(cells, CELL), spark.createDataFrame(plans, PLAN))
    got_rows, got_fields = {}, {}
    for r in rows.orderBy("run_id", "position").collect():
        got_rows.setdefault(r.run_id, []).append(r.ent_ord)
    for r in fields.orderBy("ord").collect():
        got_fields.setdefault(r.run_id, []).extend([r.field] * r.kept)
    for run, (best, order) in want.items():
        assert got_fields[run] == best and got_rows.get(run, []) == order, run


def test_whole_core_fills_what_it_shows(spark):
    plan = spark.createDataFrame([("r", 0, "Name"), ("r", 1, "type"), ("r", 2, "price")], PLAN)
    rows = [("r", i, f"Place {chr(65 + i) * 6}", f, v, f"https://s{i}.org/", f"it is {v}") for i in range(4) for f, v in (("type", "cafe"), ("price", "$$" if i else None), ("Name", "x"))]
    filled = spark.createDataFrame([("r", "Place AAAAAA", "price", "$", "https://gap.gov/", "costs $")], "run_id string, name string, field string, value string, source_url string, snippet string")
    shown = final_tables(spark.createDataFrame(rows, CELL), plan, filled).long().collect()
    assert len(shown) == 8 and all(r.value and 0 <= r.cell_confidence <= 1 for r in shown)
    assert {r.agreement_count for r in shown if r.field == "type"} == {4} and {r.cell_confidence for r in shown if r.field == "type"} == {0.9}


BODIES = [
    ('```json\n[{"name": "a"}]\n```', 1), ('{"results": [{"name": "a"}, 7]}', 2), ('{"items": []}', 0), ('{"entities": [{"name": "a"}, {"name": "b", "attr', 1),
    ('{"entities": [{"name": "a", "attributes": {"x": {"value": 1}', None), ("nothing", None), ("", None), (None, None), ('{"other": []}', None), ('[{"name": NaN}]', 1), ('[{"name": "a", "name": "b"}] tail', 1),
]


@pytest.mark.parametrize(("body", "n"), BODIES)
def test_replies(body, n):
    found = extract.parse_entities(body)
    assert (None if found is None else len(found)) == n


def test_records_of_replies(spark):
    body = json.dumps({"entities": [{"name": {"value": " A "}, "attributes": {"x": 11.0, "y": True, "z": {"value": "Not Stated"}, "q": {"value": "v", "source_snippet": "s" * 300}}}, "junk", {"name": ""}, {"name": "B", "source_url": "https://b/", "attributes": None}]})
    parsed = extract.parse_responses(spark.createDataFrame([("r", 0, body, False), ("r", 1, body, True)], "run_id string, batch long, body string, failed boolean"))
    assert [(r.batch, r.failed, r.n_entities) for r in parsed.orderBy("batch").collect()] == [(0, False, 2), (1, True, 0)]
    plan = spark.createDataFrame([("r", i, f) for i, f in enumerate(["name", "x", "y", "z", "q"])], PLAN)
    cells = extract.build_cells(parsed, plan, spark.createDataFrame([("r", 0, "https://first/")], "run_id string, batch long, url string")).collect()
    assert sorted((r.name, r.field or "", r.value or "", r.source_url, len(r.snippet or "")) for r in cells) == [("A", "q", "v", "https://first/", 200), ("A", "x", "11.0", "https://first/", 0), ("A", "y", "True", "https://first/", 0), ("B", "", "", "https://b/", 0)]


HTML = """<html><head><script type="application/ld+json">{"@graph": [{"name": "Inner", "brand": {"name": "B"}}], "name": "Outer", "url": "u", "address": {"streetAddress": "1 Way", "addressLocality": "X"}, "aggregateRating": {"ratingValue": 4.5}}</script>
<script type="application/ld+json">{broken</script><title>t</title></head><body><nav><p>menu that is skipped</p></nav><main>
<p>An opening paragraph.</p><h2>Fine Heading</h2><ul><li>first <b>item</b> here<ul><li>nested one</li></ul></li><li><h2>Not a section</h2> inside</li></ul>
<h3>ab</h3><p>Still   the same section.</p><table><tr><td>cell a</td><th>cell b</th></tr></table><div>bare text is lost</div><h3>Last One</h3><p>tiny text of it</p></main></body></html>"""


def test_sections_of_a_page():
    got = parse_sections(HTML)
    assert [(i, h) for i, h, _ in got] == [("sec_0", "General Introduction"), ("sec_jsonld", "STRUCTURED DATA (schema.org)"), ("sec_1", "H2: Fine Heading"), ("sec_2", "H3: Last One")]
    assert got[1][2].split("\n") == ["name: Inner | brand: B", "name: Outer | url: u | address: 1 Way X | rating: 4.5"]
    assert got[2][2] == "first item here nested one\nNot a section inside\nStill the same section.\ncell a | cell b"
    assert parse_sections("<p>one of two <p>that nest in here")[0][2] == "one of two that nest in here" and parse_sections("") == []


def test_records_without_more_than_a_name():
    assert list(jsonld_records({"name": "a"})) == [] and list(jsonld_records([{"itemListElement": [{"item": {"name": "a", "license": ["x", {"name": "y"}]}}]}])) == ["name: a | license: x, y"]


def test_thin_pages_lose_headings_but_keep_sections(spark):
    df = spark.createDataFrame([(1, HTML * 2, "snip"), (2, "<h2>Title</h2><p>short but kept</p>", "snip"), (3, None, "snip"), (4, "<p>x</p>", None)], "id int, html string, snippet string")
    got = {r.id: r for r in with_sections(df).collect()}
    assert got[1].content != "snip" and got[1].sections[0].heading
    assert got[2].content == "snip" and [(s.heading, s.text) for s in got[2].sections] == [("", "short but kept")]
    assert got[3].sections == [] and got[4].content == ""


def test_routing(spark):
    s = spark.createDataFrame([("r", 1, "u", i, f"sec_{i}", "H", t) for i, t in enumerate(["nothing", "price and type", "PRICE", "type price cost", "no"])] + [("r", 1, "u", 9, "sec_jsonld", "S", "x"), ("r", 2, "w", 0, "a", "", "zip"), ("r", 2, "w", 1, "b", "", "zap"), ("r", 2, "w", 2, "c", "", "zop")], "run_id string, page_ord long, url string, sec_ord long, sec_id string, heading string, text string")
    plan = spark.createDataFrame([("r", 0, "Price_type", ["cost of"]), ("r", 1, "NAME", ["zip"])], "run_id string, ord int, field string, synonyms array<string>")
    words = route.keywords(plan)
    assert {r.keyword for r in words.collect()} == {"price", "type", "cost", "of"}
    got = sorted((r.page_ord, r.slot, r.sec_ord) for r in route.route_sections(s, words).collect())
    assert got == [(1, 0, 9), (1, 1, 3), (1, 2, 1), (1, 3, 2), (2, 1, 0), (2, 2, 1)]
    assert route.page_prompts(route.route_sections(s, words)).filter("page_ord = 2").first().prompt == "\n--- PAGE: w ---\nzip\nzap\n"
    assert [r.sec_ord for r in route.gap_route(s, spark.createDataFrame([("r", "Price"), ("r", "cost"), ("r", None)], "run_id string, name string")).orderBy("slot").collect()] == [3, 1, 2]


def test_filling_never_overwrites(spark):
    cells = spark.createDataFrame([("r", 0, "a", "x", "old", "u", ""), ("r", 1, "a", "x", "n/a", "u", ""), ("r", 2, "b", "x", None, "u", "")], CELL)
    entities = cells.select("run_id", "ent_ord", "name").distinct()
    offers = [("r", "a", "x", "new", "v", None), ("r", "b", "x", " - ", "v", ""), ("r", "b", "zz", "new", "v", ""), ("r", "c", "x", "new", "v", "")]
    got = gapfill.apply_filled(entities, cells, spark.createDataFrame([("r", 0, "x")], PLAN), spark.createDataFrame(offers, "run_id string, name string, field string, value string, source_url string, snippet string")).collect()
    assert sorted((r.ent_ord, r.value, r.was_filled) for r in got) == [(0, "old", False), (1, "new", True)]


def test_deadlines_and_top_up(spark):
    shards = spark.createDataFrame([("a", 100), ("a", 2100), ("a", 2101), ("b", 9000), ("b", 8500)], "run_id string, elapsed_ms long")
    assert {(r.run_id, r.elapsed_ms): (r.cutoff_ms, r.accepted) for r in extract.before_cutoff(shards).collect()} == {("a", 100): (2100, True), ("a", 2100): (2100, True), ("a", 2101): (2100, False), ("b", 9000): (8500, False), ("b", 8500): (8500, True)}
    e = spark.createDataFrame([("a", "X")], "run_id string, name string")
    assert sorted(r.name for r in extract.top_up(e, spark.createDataFrame([("a", "x"), ("a", "Y"), ("a", "Y")], e.schema)).collect()) == ["X", "Y", "Y"]


def test_cache_of_results(spark, tmp_path):
    schema = "id long, query_text string, embedding array<float>, table_data string"
    rows = spark.createDataFrame([(2, "q", [1.0, 0.0], '{"entities": [{}, {}]}'), (1, "q", [2.0, 0.0], "{}"), (3, "z", [0.0, 0.0], "{}")], schema)
    path = str(tmp_path / "cache")
    cache.append(path, rows)
    cache.append(path, rows.filter("id = 1"))
    stored = spark.read.schema(schema).parquet(path)
    assert stored.count() == 4 and {r.id: r.n_entities for r in cache.cache_list(stored).collect()} == {2: 2, 1: 0, 3: 0}
    probes = spark.createDataFrame([(7, [3.0, 0.0]), (8, [0.0, 5.0])], "probe_id long, embedding array<float>")
    assert {r.probe_id: (r.best_id, r.similarity, r.hit) for r in cache.cache_hits(probes, stored).collect()} == {7: (1, 1.0, True), 8: (1, 0.0, False)}
    cache.clear(path, rows)
    assert spark.read.schema(schema).parquet(path).count() == 0
    assert cache.nearest(probes, rows.limit(0)).count() == 0


def test_search_rules(spark):
    assert one(spark, F.array_join(search.extra_queries(F.lit("Best Cafes"), F.array(*map(F.lit, (" best cafes ", "a", "b", "c", "d")))), "|")) == "a|b|c"
    assert [one(spark, search.is_query(F.lit(q))) for q in ("  ab ", "abc", "x" * 501)] == [False, True, False]
    outcomes = pages.fetch_outcome(spark.createDataFrame([("https://x.com/a.pdf", 404, None, "e"), ("https://a.b/a.pdf", 404, None, "e"), ("https://a.b/", None, None, "timeout"), ("https://a.b/", 500, "text/html", None), ("https://a.b/", 200, None, None), ("https://a.b/", 200, "text/html", None)], "url string, status int, content_type string, fetch_error string"))
    assert [r.error for r in outcomes.collect()] == ["blocked domain", "binary file", "timeout", "HTTP 500", "not HTML", None]


def test_csv_and_bands(spark):
    assert one(spark, export.quoted(F.lit('say "hi"'))) == '"say ""hi"""' and one(spark, export.quoted(F.lit(None))) == '""'
    assert [one(spark, export.confidence_band(F.lit(c))) for c in (0.75, 0.74, 0.55, 0.54)] == ["hi", "mid", "mid", "lo"]


def test_providers_without_a_network(spark):
    corpus = spark.createDataFrame([("u1", "t", "red apples and pears"), ("u2", "t", "green apples"), ("u3", "t", "stones")], "url string, title string, text string")
    hits = TableSearch(corpus).search(spark.createDataFrame([("r", 0, "Red apples")], "run_id string, query_ord int, query string")).orderBy("rank").collect()
    assert [r.url for r in hits] == ["u1", "u2"]
    plan = spark.createDataFrame([("r", 0, "brand")], PLAN)
    replies = RuleExtract(plan).extract(spark.createDataFrame([("r", 0, "\n--- PAGE: https://p/ ---\nname: Inner | brand: B | x: y\nplain")], "run_id string, batch long, prompt string"))
    cells = extract.build_cells(extract.parse_responses(replies), plan, spark.createDataFrame([], "run_id string, batch long, url string")).collect()
    assert [(r.name, r.field, r.value, r.source_url) for r in cells] == [("Inner", "brand", "B", "https://p/")]
    vectors = HashEmbed(16).embed(spark.createDataFrame([(1, "a b"), (2, "b a"), (3, None)], "id long, text string")).collect()
    assert vectors[0].embedding == vectors[1].embedding and len(vectors[2].embedding) == 16


def test_streams_give_the_rows_of_tables(spark, tmp_path):
    ts = "timestamp_seconds(1000 + {0})"
    started = spark.range(6).selectExpr("id % 2 AS run_id", "concat('u', id) AS url", ts.format("id") + " AS fetch_ts")
    ended = spark.range(4).selectExpr("id % 2 AS run_id", "concat('u', id) AS url", ts.format("id + 2 + 4 * (id % 2)") + " AS end_ts", "if(id = 2, 'error', 'ok') AS settle_status")
    late = spark.createDataFrame([(9, "late", 100_000)], "run_id long, url string, t long")
    started.unionByName(late.selectExpr("run_id", "url", ts.format("t") + " AS fetch_ts")).coalesce(1).write.parquet(str(tmp_path / "s"))
    ended.unionByName(late.selectExpr("run_id", "url", ts.format("t") + " AS end_ts", "'ok' AS settle_status")).coalesce(1).write.parquet(str(tmp_path / "e"))
    want = {(r.url, r.status) for r in events.settle_stream(started, ended).collect()}
    assert want == {("u0", "ok"), ("u1", "timeout"), ("u2", "error"), ("u3", "timeout"), ("u4", "timeout"), ("u5", "timeout")}
    read = lambda name, like: spark.readStream.schema(like.schema).parquet(str(tmp_path / name))
    q = events.settle_stream(read("s", started), read("e", ended)).writeStream.format("memory").queryName("settled").outputMode("append").start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    assert {(r.url, r.status) for r in spark.table("settled").collect()} == want | {("late", "ok")}


def test_event_frames(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "status", '{"a":1}'), (1, 1, "error", "{}"), (1, 2, "done", "{}"), (2, 0, "done", "{}")], "run_id long, seq long, event string, data string")
    assert sorted((r.run_id, r.seq) for r in events.until_error(rows).collect()) == [(1, 0), (1, 1), (2, 0)]
    buffer = "event: a\ndata: {\"x\": 1}\n\nevent: b\ndata: {oops\n\nevent: c\ndata: {}\n\nevent: d\nda"
    assert [x.event for x in one(spark, events.parse_frames(F.lit(buffer)))] == ["a", "c"] and one(spark, events.parse_frames(F.lit("event: a"))) == []
    rows.write.parquet(str(tmp_path / "in"))
    q = events.write_frames(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).filter("value = 'event: done\\ndata: {}\\n\\n'").count() == 2


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=30))
def test_tokenised_text_of_any_markup_is_parsed(markup):
    parse_sections(f"<div>{markup}</div><p>{markup}</p>")


def test_topics_to_tables_with_stand_ins(spark):
    things = [("Alpha Cafe", "thai"), ("Beta Diner", "greek"), ("Gamma Grill", "thai")]
    record = lambda n, c: json.dumps({"name": n, "servesCuisine": c, "telephone": "1"})
    html = [(f"https://s{k}.org/{i}", f'<html><head><script type="application/ld+json">{record(n, c)}</script></head><body><p>{n} is a restaurant with {c} food, {'and its page says more than enough about it, ' * 5}no doubt.</p></body></html>') for k in range(2) for i, (n, c) in enumerate(things)]
    corpus = spark.createDataFrame([(u, "t", "restaurants in town", h) for u, h in html] + [("https://gone.org/", "t", "restaurants of old", None)], "url string, title string, text string, html string")
    plan = spark.createDataFrame([("r", 0, "name", []), ("r", 1, "cuisine", ["food"]), ("r", 2, "phone", []), ("r", 3, "website", [])], "run_id string, ord int, field string, synonyms array<string>")
    requests = spark.createDataFrame([("r", "restaurants", ["restaurants old", "x"]), ("short", "ab", [])], "run_id string, query string, planned array<string>")
    done = run_topics(requests, plan, TableSearch(corpus, 10), TableFetch(corpus.filter("html IS NOT NULL").select("url", "html")), RuleExtract(plan))
    assert done.hits.count() == 7 and done.pages.filter("error = 'timeout'").count() == 0
    shown = {(r.name, r.field): (r.value, r.agreement_count, r.cell_confidence) for r in done.tables.long().collect()}
    assert shown == {(n, f): (v, 1, 0.7) for n, c in things for f, v in (("cuisine", c), ("phone", "1"))}
    assert done.unavailable().count() == 0


class Silent:
    """Refuses every extraction, or takes too long for it."""

    def __init__(self, failed, elapsed):
        self.failed, self.elapsed, self.asked = failed, elapsed, 0

    def extract(self, prompts):
        self.asked += prompts.count()
        return prompts.select("run_id", "batch", F.lit('{"entities": []}').alias("body"), F.lit(self.failed).alias("failed"), F.lit(self.elapsed).alias("elapsed_ms"))


def test_a_whole_run_plans_fills_caches_and_tells(spark, tmp_path):
    things = [("Alpha Cafe", "thai"), ("Beta Diner", "greek"), ("Gamma Grill", "thai"), ("Delta Bar", "thai"), ("Eta Inn", "greek")]
    page = lambda lines: "<html><body><h1>Places of the town</h1>" + "".join(f"<p>{x}</p>" for x in lines) + f"<p>{'and there is more to be said about them, ' * 6}</p></body></html>"
    phone = [f"name: {n} | phone: {i}" for i, (n, _) in enumerate(things)]
    html = [("https://a.org/1", page([f"name: {n} | cuisine: {c}" for n, c in things])), ("https://b.org/2", page(["cuisine, phone: what guides say", "cuisine", "<h2>Cuisine here</h2>"]) + page(phone))]
    corpus = spark.createDataFrame([(u, "t", "restaurants in town", h) for u, h in html], "url string, title string, text string, html string")
    fields = [(r, i, f, []) for r in ("r", "bad") for i, f in enumerate(["name", "cuisine", "phone"])]
    plan = spark.createDataFrame(fields, "run_id string, ord int, field string, synonyms array<string>")
    body = json.dumps({"entity_type": "restaurant", "schema_fields": ["name", "cuisine", "phone"], "search_queries": ["restaurants town"], "field_synonyms": {}})
    plans = TablePlan(spark.createDataFrame([("restaurants", body), ("broken", "no plan")], "query string, body string"))
    requests = spark.createDataFrame([("r", "restaurants", []), ("bad", "broken", []), ("short", "ab", [])], "run_id string, query string, planned array<string>")
    path = str(tmp_path / "cache")
    cache.clear(path, spark.createDataFrame([], "id long, query_text string, embedding array<float>, table_data string"))

    def run(asked, extractor, **more):
        return run_topics(asked, plans, TableSearch(corpus, 10), TableFetch(corpus), extractor, filler=RuleFill(), embedder=HashEmbed(64), cache_path=path, **more)

    done = run(requests, RuleExtract(plan))
    shown = {(r.name, r.field): r.value for r in done.tables.long().filter("run_id = 'r'").collect()}
    assert shown == {(n, "cuisine"): c for n, c in things} | {(n, "phone"): str(i) for i, (n, _) in enumerate(things)}
    told = [(r.event, json.loads(r.data)) for r in done.events.filter("run_id = 'r'").orderBy("seq").collect()]
    assert [e for e, _ in told] == ["status", "status", "plan", "status", "status", "status", "source", "source", "status", "status", "status", "status", "results", "done"]
    assert [d["stage"] for e, d in told if e == "status"] == [0, 1, 2, 2, 3, 3, 4, 4, 5] and told[4][1]["message"] == "Found 2 addresses"
    assert [r.event for r in done.events.filter("run_id = 'bad'").orderBy("seq").collect()] == ["status", "status", "error"]
    assert done.events.filter("run_id = 'short'").count() == 0 and done.unavailable().count() == 0
    assert {r.query_text for r in spark.read.parquet(path).collect()} == {"restaurants"}

    again = run(requests.filter("run_id = 'r'"), Silent(True, 1))
    assert [(r.event, json.loads(r.data).get("entity_count")) for r in again.events.orderBy("seq").collect()] == [("status", None), ("status", None), ("results", 5), ("done", None)]
    assert again.pages.count() == 0

    cache.clear(path, spark.read.parquet(path))
    other = Silent(True, 1)
    lost = run(requests.filter("run_id = 'r'"), Silent(True, 1), fallback=other)
    assert other.asked and [r.run_id for r in lost.unavailable().collect()] == ["r"] and lost.events.orderBy(F.desc("seq")).first().event == "error"
    rescued = run(requests.filter("run_id = 'r'"), Silent(False, 9000), fallback=RuleExtract(plan))  # too late counts as failed
    assert rescued.tables.rows.count() == 5 and rescued.unavailable().count() == 0


def test_retries():
    calls = []

    def failing(errors):
        def call(json_mode):
            calls.append(json_mode)
            if len(calls) <= len(errors):
                raise RuntimeError(errors[len(calls) - 1])
            return "body"

        return call

    for errors, want, waits, modes in (
        ([], ("body", False), [], [True]), (["HTTP 429: slow down"], ("body", False), [2], [True, True]), (["could not validate JSON"], ("body", False), [1], [True, False]),
        (["x", "HTTP 429"], (None, True), [1], [True, True]),
    ):
        calls.clear()
        waited = []
        assert call_with_retries(failing(errors), sleep=waited.append) == want and waited == waits and calls == modes


@pytest.fixture
def service():
    """A server on this machine that answers searches, pages and chats; it refuses a chat's first call."""
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self, body):
            seen.append((self.path, body, self.headers.get("X-API-KEY"), time.monotonic()))
            if self.path == "/chat" and sum(p == "/chat" for p, *_ in seen) == 1:
                return self.send_error(429)
            if self.path == "/slow":
                time.sleep(1.5)
            content = {"/search": '{"organic": [{"link": "https://a.org/", "title": "T"}]}', "/chat": json.dumps({"choices": [{"message": {"content": '{"entities": []}'}}]})}.get(self.path)
            content = content or '<div class="result"><h2 class="result__title"><a href="https://b.org/">B</a></h2></div>'
            self.send_response(404 if self.path == "/none" else 200)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write(content.encode())

        def do_GET(self):
            self.answer("")

        def do_POST(self):
            self.answer(self.rfile.read(int(self.headers["Content-Length"])).decode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_services_over_http(spark, service):
    url, seen = service
    queries = spark.createDataFrame([("r", 1, "b c"), ("r", 0, "a")], "run_id string, query_ord int, query string")
    keyed = services.choose_search(Options(search_key="k"), lambda key: services.KeyedSearch(f"{url}/search", key), None)
    assert [(r.query_ord, r.url, r.title, r.snippet) for r in cut(keyed.search(queries)).orderBy("query_ord").collect()] == [(0, "https://a.org/", "T", ""), (1, "https://a.org/", "T", "")]
    assert {k for p, _, k, _ in seen if p == "/search"} == {"k"} and sorted(json.loads(b)["q"] for p, b, *_ in seen if p == "/search") == ["a", "b c"]
    paced = services.choose_search(Options(), None, services.PacedSearch(f"{url}/html?q="))
    assert [(r.query_ord, r.url) for r in cut(paced.search(queries)).orderBy("query_ord").collect()] == [(0, "https://b.org/"), (1, "https://b.org/")]
    asked = [(p, t) for p, _, _, t in seen if p.startswith("/html")]
    assert [p for p, _ in asked][:2] == ["/html?q=a", "/html?q=b+c"] and asked[1][1] - asked[0][1] >= 0.4
    assert services.KeyedSearch("http://127.0.0.1:9/none", "k").search(queries).count() == 0
    hits = spark.createDataFrame([("r", i, u, "t", "s") for i, u in enumerate([f"{url}/page", f"{url}/none", f"{url}/slow", f"{url}/a.pdf", "https://facebook.com/x", "http://127.0.0.1:9/"])], "run_id string, page_ord long, url string, title string, snippet string")
    got = {r.page_ord: r for r in pages.fetch_outcome(services.HttpFetch(1.0).fetch(hits)).collect()}
    assert [got[i].error for i in range(5)] == [None, "HTTP 404", "timeout", "binary file", "blocked domain"] and got[5].fetch_error and "result" in got[0].html
    chat = services.Chat(f"{url}/chat", "key", "model")
    reply = services.ChatExtract(chat, "Read: {pages}").extract(spark.createDataFrame([("r", 0, "p")], "run_id string, batch long, prompt string")).first()
    assert (reply.body, reply.failed) == ('{"entities": []}', False) and reply.elapsed_ms >= 2000
    made = services.ModelEmbed("lengths", lambda: lambda texts: [[float(len(t))] for t in texts]).embed(spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string"))
    assert {r.id: r.embedding for r in made.collect()} == {1: [2.0], 2: [0.0]}


def test_options(spark, monkeypatch):
    monkeypatch.setenv("FACTGRID_SEARCH_KEY", "from environment")
    assert Options.of(spark) == Options(None, "from environment", None)
    spark.conf.set("spark.factgrid.search.key", "from session")
    spark.conf.set("spark.factgrid.model.key", "m")
    assert Options.of(spark) == Options("m", "from session", None) and Options.of(spark).needed_model_key() == "m"
    spark.conf.unset("spark.factgrid.search.key")
    spark.conf.unset("spark.factgrid.model.key")
    with pytest.raises(ValueError, match="spark.factgrid.model.key"):
        Options.of(spark).needed_model_key()


def test_a_shared_folder_is_needed_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            sc = staticmethod(lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True)))

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=Context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)


def test_headers_keep_their_own_white_space():
    (_, heading, _), = parse_sections("<h1>Big  news\n today</h1><p>A paragraph of some length  here.</p>")
    assert heading == "H1: Big  news\n today"


def test_copies_among_probes_are_found(spark, tmp_path):
    from factgrid.queries import QUERIES

    rows = [(50, [1.0, 0.0]), (100, [0.0, 1.0]), (150, [0.0, 1.0]), (7, [1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.probe_id: r.best_id for r in QUERIES["knn_top1"](spark, str(tmp_path)).collect()}
    assert got == {50: 7, 100: 150, 150: 100}
    assert QUERIES["cache_misses"](spark, str(tmp_path)).filter("hit").first().n == 2


def test_second_round_takes_hits_as_they_come(spark, tmp_path):
    import duckdb

    from factgrid.oracles import ORACLE_SQL
    from factgrid.queries import QUERIES

    urls = {3: "a", 63: "a", 23: "b", 43: "b", 83: "a", 60: "c", 120: "c", 180: "d", 240: "e", 300: "f", 20: "g", 0: "h"}
    spark.createDataFrame(list(urls.items()), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in QUERIES["second_round_gate"](spark, str(tmp_path)).select("run_id", "query_ord", "rank", "url", "title", "snippet").collect())
    assert [r[:4] for r in got] == [("src0", 1, k, urls[k]) for k in (60, 120, 180, 240, 300)] + [("src3", 0, 23, "b"), ("src3", 0, 43, "b"), ("src3", 1, 3, "a"), ("src3", 1, 63, "a")]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(duck.execute(ORACLE_SQL["second_round_gate"]).fetchall())


def test_hits_of_a_topic_have_each_address_once(spark):
    from factgrid.plans.run import _first_hits

    class Repeats:
        def search(self, queries):
            return queries.select("run_id", "query_ord", F.posexplode(F.split(F.when(F.col("query_ord") == 0, "a,a,,b").otherwise("b,c,c,"), ",")).alias("rank", "url"), F.lit("t").alias("title"), F.lit("s").alias("snippet"))

    asked = spark.createDataFrame([("r", "q", ["x", "y"])], "run_id string, query string, planned array<string>")
    assert sorted((r.query_ord, r["rank"], r.url) for r in _first_hits(asked, Repeats()).collect()) == [(0, 0, "a"), (0, 3, "b"), (1, 1, "c")]
