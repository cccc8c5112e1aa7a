"""Tables in texts, links of participants and statistics on hand-made rows, empty tables included."""

from folioscope.operators import graph, rosters
from folioscope.plans import reports

ADDRESS = "0x" + "Ab" * 20


def test_rosters(spark):
    delegates = f"| Delegate Name | EA Address | Delegation Contract | Forum Post |\n|---|---|---|---|\n| Old Hand | {ADDRESS} | | [x](https://f.example/1) |\n| New One | 0x{'1' * 40} | 0x{'2' * 40} | |\n| No Address | - | | |\n| | {ADDRESS} | | |"
    gone = "| Identity | Date | Reasoning Post |\n|-|-|-|\n| - | 2020 | |\n| New One | 2021 | |\n| Lost | 2022 | https://f.example/2 |"
    members = f"| Name or Alias | Standing | Verified Governance Address |\n|-|-|-|\n| Mem | good | {ADDRESS}, 0x{'3' * 40} |\n| Lost | bad | N/A |"
    docs = spark.createDataFrame([("d1", 1, delegates), ("d2", 2, gone), ("d3", 3, members), ("d4", 4, "no table"), ("d5", 5, None), ("d6", 6, "| a | b |\n|-|-|\n| 1 | 2 |")], "id string, ord long, content string")
    entities = spark.createDataFrame([("e1", "other", "Other", "ecosystem_actor", True, None, {"k": "v"}), ("e2", "new-one", "Earlier", "agent", True, None, None)], "id string, slug string, name string, entity_type string, is_active boolean, defining_doc_id string, meta map<string,string>")
    owned = spark.createDataFrame([("e1", ADDRESS.lower(), None), ("ghost", "0x" + "1" * 40, None)], "entity_id string, address string, role string")
    after, addresses, listings = rosters.with_rosters(rosters.roster_rows(docs), entities, owned)
    got = {r.slug: r for r in after.collect()}
    assert set(got) == {"other", "new-one", "lost", "mem"} and got["other"].entity_type == "delegate_org" and got["other"].meta == {"k": "v", "forum_url": "https://f.example/1"}
    assert got["new-one"].name == "New One" and got["new-one"].entity_type == "delegate_org" and got["new-one"].defining_doc_id == "d1" and got["new-one"].meta == {"source": "active_data_table"}
    assert not got["lost"].is_active and got["lost"].meta["derecognition_date"] == "2022" and got["mem"].entity_type == "src_member" and got["mem"].meta["standing"] == "good"
    roles = {(r.entity_id, r.address[:6]): r.role for r in addresses.collect()}
    assert roles == {("e1", "0xabab"): "ea_address", ("ghost", "0x1111"): None, (got["new-one"].id, "0x1111"): "ea_address", (got["new-one"].id, "0x2222"): "delegation_contract", (got["mem"].id, "0xabab"): "governance", (got["mem"].id, "0x3333"): "governance"}
    assert {tuple(r) for r in listings.collect()} == {("e1", "d1"), (got["new-one"].id, "d1"), (got["lost"].id, "d2"), (got["mem"].id, "d3")}
    same, _, none = rosters.with_rosters(rosters.roster_rows(docs.limit(0)), entities, owned)
    assert same.count() == 2 and none.count() == 0


def test_participant_links(spark):
    entities = spark.createDataFrame([("a", "agent-a", "agent", "d"), ("p", "party", "composite_party", "d2"), ("q", "alone", "composite_party", "d3"), ("f", "fund", "foundation", "d4"), ("g", "far", "foundation", None), ("o", "other", "delegate_org", None)], "id string, slug string, entity_type string, defining_doc_id string")
    edges = spark.createDataFrame([(x, y, "entity", "entity", t) for x, y, t in [("p", "a", "comprises"), ("p", "f", "comprises"), ("p", "f", "comprises"), ("q", "g", "comprises"), ("p", "o", "comprises"), ("p", "none", "comprises"), ("q", "f", "cites")]], "from_id string, to_id string, from_type string, to_type string, edge_type string")
    got = {r.id: (r.kind, r.target, r.resolved_by) for r in graph.participant_links(entities, edges).collect()}
    assert got == {"a": ("actor", "agent-a", "own"), "p": ("actor", "agent-a", "agent"), "q": ("doc", "d3", "document"), "f": ("actor", "agent-a", "party")}
    assert graph.participant_links(entities.limit(0), edges).count() == 0


def test_statistics_have_zeros_at_all_levels(spark):
    agents = spark.createDataFrame([("x",), ("y",)], "agent_id string")
    seeds = spark.createDataFrame([("x", "C1", "p"), ("z", "C1", "p")], "agent_id string, category string, primitive string")
    facts = spark.createDataFrame([("x", "C1", "p", "Active", "n2"), ("x", "C1", "p", "Active", "n1"), ("x", "C1", "p", "Active", "n1"), ("x", None, "q", "invocation", "i"), ("y", "C1", "p", "Strange", "s"), ("z", "C1", "p", "Active", "out"), ("y", "C1", None, "Active", "nothing")],
                                  "agent_id string, category string, primitive string, status string, name string")
    rows = reports.status_statistics(agents, seeds, facts, ["C1", "C2"], most_names=2).collect()
    at = {(r.level, r.agent_id, r.category, r.primitive, r.status): (r.n, r.names) for r in rows}
    assert len(at) == len(rows) and at["primitive", "x", "C1", "p", "Active"] == (3, ["n1", "n1"]) and at["primitive", "x", "C1", "p", "Suspended"] == (0, [])
    assert at["category", "y", "C2", None, "Completed"] == (0, []) and at["category", "x", "Unknown", None, "invocation"] == (1, []) and at["agent", "y", None, None, "Active"] == (0, [])
    assert at["all", None, None, None, "Active"] == (3, []) and at["all categories", None, "C1", None, "Active"] == (3, []) and ("primitive", "y", "C1", "p", "Active") not in at
    assert reports.status_statistics(agents.limit(0), seeds, facts, ["C1"]).count() == 0
