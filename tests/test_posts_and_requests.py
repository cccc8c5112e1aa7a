"""Posts by their headings, and requests by their arguments."""

import pytest
from folioscope.operators import hierarchy, posts
from folioscope.plans import requests
from pyspark.sql import functions as F


def parsed(spark, *rows):
    return posts.parse_posts(spark.createDataFrame(list(rows), "post_id int, title string, body string"))


def test_modes_of_posts(spark):
    summary = "intro\r\n## SUMMARY\r\nIt *does* **this** [there](u) .\n### inside\n> and that\n## Rest\nno"
    topics = "- **One** — said\n* **Two** - only listed\n- **No dash** here\n### One\ntext\n\n###  **Three**\n- a\n- b\n## Chapter\n### Four\n \n### `Five`\nlast A.1.2"
    rows = [(1, "P", summary), (2, "P", topics), (3, "", summary), (4, "P", "### One\nonly"), (5, "P", None), (6, None, "## Summary\nx\n## B"), (7, "P", "## Summary\n\n## B\nx"), (8, "P", "#### deep\n##nothing\n###nothing\n## Summary\nalone")]
    got = {r.post_id: r for r in parsed(spark, *rows).collect()}
    assert {k: r["mode"] for k, r in got.items()} == {1: "summary", 2: "topics", 3: "none", 4: "none", 5: "none", 6: "none", 7: "none", 8: "none"}
    assert [(b.title, b.description) for b in got[1].bullets] == [("P", "It *does* this there . inside and that")]
    assert [(b.title, b.description, b.origin) for b in got[2].bullets] == [("One", "text", "topic"), ("Three", "a b", "topic"), ("Five", "last A.1.2", "topic"), ("Two", "only listed", "item")]
    assert posts.post_bullets(parsed(spark, *rows)).where("bullet IS NULL").count() == 6
    assert parsed(spark, *rows).limit(0).count() == 0


@pytest.mark.parametrize(("text", "want"), [("a" * 600, "a" * 600), ("a" * 601, "a" * 600 + "…"), ("a" * 400 + " " + "b" * 300, "a" * 400 + "…"), ("a" * 300 + " " + "b" * 400, "a" * 300 + " " + "b" * 299 + "…"), ("", "")])
def test_shortened(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(posts.shortened(F.col("t"))).first()[0] == want


def test_references_belong_to_their_topics(spark):
    uid = "0a1b2c3d-0000-1111-2222-333344445555"
    body = f"see A.9\n### One\n{'w ' * 400} A.1.2 and {uid.upper()}\n### Two\nA.1.2 B.3\n## After\nNR-1 C.4"
    rows = [(1, "P", body), (2, "A.5 title", "no topics, A.6")]
    df = spark.createDataFrame(rows, "post_id int, title string, body string")
    got = {(r.post_id, r.ref): r.bullet for r in posts.harvested(df, posts.parse_posts(df)).collect()}
    assert got == {(1, "A.9"): 0, (1, "A.1.2"): 0, (1, uid): 0, (1, "B.3"): 1, (1, "C.4"): 0, (2, "A.5"): None, (2, "A.6"): None}


@pytest.fixture(scope="module")
def world(spark):
    docs = spark.createDataFrame([("d1", "A.1", "Root", "Core", None, "root text", 1), ("d2", "A.1.1", "Alpha", "Core", "d1", "alpha is Active now", 2), ("d3", "A.1.2", "Beta", "Data", "d1", "beta is Inactive", 3), ("d4", "A.1.2.1", "Gamma", "Data", "d3", "gamma says alpha beta", 4), ("d5", "A.2", "Other", "Data", None, None, 5)],
                                 "id string, doc_no string, title string, type string, parent_id string, content string, ord long")
    entities = spark.createDataFrame([("d2", "acme", "agent"), ("e2", "bob", "delegate"), ("e3", "eve", "delegate")], "id string, slug string, entity_type string")
    edges = spark.createDataFrame([("d2", "entity", "d3", "doc", "owns"), ("d4", "doc", "d2", "entity", "data_for"), ("d2", "doc", "d5", "doc", "cites"), ("d2", "entity", "e2", "entity", "knows"), ("e3", "entity", "d2", "entity", "knows"), ("e2", "entity", "d5", "doc", "owns"), ("d1", "doc", "e3", "entity", "data_for")],
                                  "from_id string, from_type string, to_id string, to_type string, edge_type string")
    history = spark.createDataFrame([("d3", "2024-06-20", 9, "modified"), ("d4", "2024-01-01", 5, "added"), ("d5", "2024-06-29", 10, "removed")], "doc_id string, date string, commit_seq int, change_type string").withColumn("date", F.to_date("date"))
    return docs, entities, edges, history


def test_requests_in_all_modes(spark, world):
    asked = [
        ("broad", None, "acme", None, None, None, None, None, None, None), ("narrow", None, "acme", ["owns"], None, None, None, None, None, None), ("chain", None, "acme", None, None, "delegate", None, None, None, None),
        ("list", None, None, None, "Data", None, None, None, None, None), ("words", "alpha", None, None, None, None, None, None, None, None), ("both", "beta", "acme", None, None, None, None, None, None, None),
        ("phrase", '"alpha beta"', None, None, None, None, None, None, None, None), ("case", "alpha GaMma", None, None, None, None, None, None, None, None), ("nobody", None, "nobody", None, None, None, None, None, None, None), ("nothing", "", "", None, "", None, None, None, None, None),
        ("since", None, None, None, "Data", None, "30d", None, None, None), ("status", None, None, None, None, None, None, "Active", None, "Core"), ("place", None, None, None, "Data", None, None, None, "A.1.2", None), ("miss", None, None, None, "Data", None, None, None, "A.77", None), ("cut", None, None, None, "Data", None, None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, 1 if r[0] == "cut" else None) for r in asked], "request_id string, q string, entity string, edge_types array<string>, target_type string, via_entity_type string, since string, status string, ancestor string, kind string, k int")
    df = df.withColumn("target_type", F.coalesce("target_type", "kind")).drop("kind").withColumn("include_params", F.lit(True))
    docs, entities, edges, history = world
    answers = requests.answer(df, docs, entities, edges, history)
    got = {}
    for r in answers.orderBy("request_id", "relation", "rank").collect():
        got.setdefault((r.request_id, r["mode"]), []).append((r.relation, r.id) if r.relation else r.id)
    assert got[("broad", "entity_broad")] == [("data_for", "d4"), ("owns", "d3")] and got[("narrow", "entity_narrow")] == ["d3"]
    assert sorted(got[("chain", "entity_chain")]) == ["d1", "d5"] and got[("list", "type_list")] == ["d3", "d4", "d5"] and got[("cut", "type_list")] == ["d3"]
    assert got[("words", "search")] == ["d2", "d4"] and sorted(got[("both", "hybrid_graph")]) == ["d3", "d4"] and got[("phrase", "search")] == ["d4"]
    assert got[("case", "search")] == [None] and got[("nobody", "error")] == [None] and got[("nothing", "error")] == [None]
    assert got[("since", "type_list")] == ["d3", "d5"] and got[("status", "type_list")] == ["d2"] and got[("place", "type_list")] == ["d3", "d4"] and got[("miss", "type_list")] == ["d3", "d4", "d5"]
    full = {(r.request_id, r.id): r for r in requests.enriched(answers, df, docs).collect()}
    assert [a.id for a in full["list", "d4"].ancestors] == ["d1", "d3"] and full["list", "d4"].content == "gamma says alpha beta" and full["list", "d4"].snippet is None
    assert [(p.id, p.name, p.value) for p in full["list", "d3"].params] == [("d4", "Gamma", "gamma says alpha beta")] and full["list", "d5"].params == [] and full["list", "d5"].ancestors == []
    assert full["phrase", "d4"].snippet == "gamma says alpha beta" and full["nobody", None].content is None
    assert requests.answer(df.limit(0), docs, entities, edges, history).count() == 0


def test_walks_of_a_tree(spark):
    rows = [("r", None)] + [(f"n{k}", f"n{k - 1}" if k else "r") for k in range(40)] + [("x", "n5"), ("lost", "gone")]
    docs = spark.createDataFrame(rows, "id string, parent_id string")
    assert {r.id for r in hierarchy.subtree(docs, "n37").collect()} == {"n37", "n38", "n39"} and {r.id for r in hierarchy.subtree(docs, "n5").collect()} == {"x", *(f"n{k}" for k in range(5, 40))}
    up = {(r.id, r.hop): r.ancestor_id for r in hierarchy.climb(docs, docs.where("id IN ('x', 'r')")).collect()}
    assert up == {("r", 0): "r", ("x", 0): "x", **{("x", k + 1): f"n{5 - k}" for k in range(6)}, ("x", 7): "r"}
    near = {r.id: (r.hop, r.ancestor_id) for r in hierarchy.closest_flagged(docs, spark.createDataFrame([("n3",), ("n20",), ("r",)], "id string")).collect()}
    assert near["n39"] == (19, "n20") and near["n20"] == (17, "n3") and near["x"] == (3, "n3") and near["n3"] == (4, "r") and near["n0"] == (1, "r") and "r" not in near and "lost" not in near


def test_a_post_is_parsed_once_for_all_its_references(spark):
    df = spark.createDataFrame([(1, "t", "### A\nx\n### B\ny A.2")], "post_id int, title string, body string")
    found = posts.harvested(df, posts.parse_posts(df))
    assert [tuple(r) for r in found.collect()] == [(1, "A.2", 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # titles and descriptions of list items, and texts of topics and of a summary
    assert plan.count("[—–-]") == 2 and plan.count(r"\*\*([^*]+)\*\*") == 2


def test_equal_requests_are_answered_once(spark, world, monkeypatch):
    rows = [(n, None, "Data", None, 1 + n % 3) for n in range(40)] + [(n, None, "Data", "beta", None) for n in range(40, 60)] + [(n, "acme", None, None, None) for n in range(60, 70)]
    df = spark.createDataFrame(rows, "request_id int, entity string, target_type string, status string, k int")
    written = {}
    kept = requests.stored

    def counted(table, name):
        out = kept(table, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(requests, "stored", counted)
    got = {}
    for r in requests.answer(df, *world).orderBy("request_id", "relation", "rank").collect():
        got.setdefault(r.request_id, []).append(r.id)
    assert all(got[n] == ["d3", "d4", "d5"][: 1 + n % 3] for n in range(40)) and all(got[n] == ["d3", "d4"] for n in range(40, 60)) and all(got[n] == ["d4", "d3"] for n in range(60, 70))
    # three sections of a type for each of two requests, two of an entity for one
    assert written["found"] == 8 and written["marked"] == 7
