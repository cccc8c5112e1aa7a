"""Bullets of change sets matched to changed sections."""

from folioscope.operators import attribution

U = "00000000-0000-0000-0000-00000000000a"


def test_passes_in_their_order(spark):
    docs = spark.createDataFrame([("A.1", "Root"), ("A.1.2", "Risk Capital Rules"), ("A.1.2.3", "Payment Cadence"), ("A.6.1.1.1", "Star"), ("A.6.1.1.2", "Moon"), ("A.6.1.1.2.1", "Payment Cadence")], "doc_no string, title string")
    nodes = spark.createDataFrame([
        (1, "n1", "A.1.2", "Risk Capital Rules"), (1, U, "A.1.9", "Whatever"), (1, "n3", "A.1.2.3", "Payment Cadence"), (1, "n4", "A.6.1.1.2.1", "Payment Cadence"), (1, "n5", "A.3", "Nothing Alike"), (1, "n6", "A.4", "Gone"), (2, "m1", "A.9", "Anything"),
    ], "set_id int, id string, doc_no string, title string")
    bullets = spark.createDataFrame([
        (1, 0, "Star payment cadence", "for Star only"), (1, 1, "Changes", f"see A.1.2 and {U}."), (1, 2, "Cadence of payment", "x"), (1, 3, "Other", "alike in one word"), (2, 0, "The only one", None),
    ], "set_id int, bullet int, title string, description string")
    agents = spark.createDataFrame([("Star", "A.6.1.1.1"), ("Moon", "A.6.1.1.2")], "name string, doc_no string")
    harvested = spark.createDataFrame([(1, "A.4", 3)], "set_id int, ref string, bullet int")
    got = {(r.set_id, r.id): (r.bullet, r.score, r.via) for r in attribution.attributed(bullets, nodes, docs, agents, harvested).collect()}
    # the bullet of one agent leaves the other agent's sections alone, and one word in a description is not enough
    assert got == {(1, "n1"): (1, 100, "ref"), (1, U): (1, 100, "ref"), (1, "n3"): (2, 100, "fuzzy"), (1, "n4"): (2, 100, "fuzzy"), (1, "n6"): (3, 100, "ref"), (2, "m1"): (0, 0, "sole-bullet")}
    matches = attribution.attributed(bullets, nodes, docs, agents, harvested)
    assert {r.set_id: (r.changed, r.matched) for r in attribution.match_rates(nodes, matches).collect()} == {1: (6, 5), 2: (1, 1)}
    sets = spark.createDataFrame([(2, "T", "b"), (3, "Fix of one thing", "A short body of it")], "set_id int, title string, body string")
    more = nodes.unionByName(spark.createDataFrame([(3, "k1", "A.7", "x")], nodes.schema))
    told = {r.id: (r.summary, r.description) for r in attribution.summaries(more, matches, bullets, sets).collect()}
    assert told["m1"] == ("The only one", None) and told["k1"] == ("Fix of one thing", "A short body of it") and told["n5"] == (None, None)


def test_moves_of_a_migration(spark):
    events = spark.createDataFrame([("a", "added"), ("a", "removed"), ("b", "added")], "commit_hash string, change_type string")
    commits = spark.createDataFrame([("a", "Migrate all to Markdown File"), ("b", "Other")], "commit_hash string, message string")
    assert sorted(tuple(r) for r in attribution.relabelled(events, commits).collect()) == [("a", "moved"), ("a", "removed"), ("b", "added")]
