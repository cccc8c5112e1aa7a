"""Reports and address context on hand-made rows."""

from pyspark.sql import functions as F

from folioscope.operators import extraction, hierarchy
from folioscope.plans import reports


def test_table_context(spark):
    a = "0x" + "aB" * 20
    body = f"text\n| Name | Address |\n|---|---|\n| Vault | {a} |\n| plain {a}\n"
    rows = extraction.table_cells(spark.createDataFrame([("d", body)], "id string, content string")).collect()
    assert [tuple(r) for r in rows] == [("d", a.lower(), ["Vault", a], ["Name", "Address"], 1)]


def test_labels(spark):
    rows = spark.createDataFrame([("0x1", None, "base", ["d"]), ("0x2", "kept", "base", ["d"]), ("0x3", None, "base", ["d", "e"])], "address string, label string, chain string, docs array<string>")
    one, two = (spark.createDataFrame(x, "address string, name string") for x in ([("0x1", "b"), ("0x1", "a"), ("0x2", "x")], [("0x1", "late"), ("0x9", "y")]))
    got = extraction.filled_labels(rows, one, two)
    assert {r.address: r.label for r in got.collect()} == {"0x1": "a", "0x2": "kept", "0x3": None}
    assert [tuple(r)[:3] for r in extraction.unlabelled(got).collect()] == [("0x3", "base", 2)]


def test_names_before_addresses(spark):
    said = ["The address of the Moon Treasury is ", "the Star Vault's address on ", "The reward address for the Big Lab is ", "see Acme Pool at address ", "Recipient: Good Corp", "**Bold Name**: ", "the address of it is ", "nothing"]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(said)], "k int, t string").select("k", extraction.label_of(F.col("t")).alias("l")).collect()
    assert {r.k: r.l for r in got} == {0: "Moon Treasury", 1: "Star Vault", 2: "Big Lab", 3: "Acme Pool", 4: "Good Corp", 5: "Bold Name", 6: None, 7: None}
    rows = spark.createDataFrame([("0x1", "base", ["Long Name", "N"]), ("0x1", "ethereum", ["N"])], "address string, chain string, labels array<string>")
    registry, contracts = spark.createDataFrame([("0x9", "r")], "address string, name string"), spark.createDataFrame([("0x1", "base", "C"), ("0x1", "base", "B")], "address string, chain string, name string")
    best = {(r.chain): (r.label, r.aliases) for r in extraction.best_labels(rows, registry, contracts).collect()}
    assert best == {"base": ("Long Name", ["B", "N"]), "ethereum": ("N", [])}


def test_duties(spark):
    text = "Intro. See [Acme](x). **Acme** must report. Others will rest."
    snippet = spark.createDataFrame([(text,), ("No subject here.",), ("",)], "c string").select(reports.duty_snippet(F.col("c"), "Acme")).collect()
    assert [r[0] for r in snippet] == ["Acme must report.", "No subject here.", ""]


def test_rewards_and_decisions(spark):
    instances = spark.createDataFrame([("i", "star", "boost", "Active"), ("j", "moon", "boost", "Active")], "id string, agent string, kind string, status string")
    params = spark.createDataFrame([("i", "Rate", "2"), ("i", "Other", "x")], "id string, key string, value string")
    assert {r.id: r.rate for r in reports.rewards(instances, params, {"rate": "Rate"}).collect()} == {"i": "2", "j": None}
    decisions = spark.createDataFrame([("a", "add", "c", None), ("b", "add", None, None), ("c", "ignore", None, "r"), ("z", "add", "c", None), ("d", "add", "c", None), ("d", "add", "c", None), ("e", "add", "c", None)], "id string, action string, category string, reason string")
    docs, curated = spark.createDataFrame([(x,) for x in "abcde"], "id string"), spark.createDataFrame([("e",)], "id string")
    good, bad = reports.decided(decisions, docs, curated)
    assert {r.id for r in good.collect()} == {"a", "c"} and {r.id: r.fault for r in bad.collect()} == {"b": "no category", "z": "unknown id", "d": "given twice", "e": "already there"}


def test_unresolved(spark):
    u = "00000000-0000-4000-8000-00000000000"
    docs = spark.createDataFrame([(f"{u}1", "A.1", f"[x]({u}2) [y]({u}9) [z]({u}9)"), (f"{u}2", "A.1", f"[y]({u}9)"), (f"{u}3", None, None), (f"{u}4", None, "")], "id string, doc_no string, content string")
    edges = spark.createDataFrame([("a", "A.1"), ("b", "A.7"), ("c", "A.7"), ("d", None)], "from_id string, source string")
    assert {r.problem: r.n for r in hierarchy.unresolved(docs, edges).collect()} == {"link to nothing": 2, "evidence of nothing": 2, "number given twice": 1}
    assert {r.n for r in hierarchy.unresolved(docs.limit(0), edges.limit(0)).collect()} == {0}
