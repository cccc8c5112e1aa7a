"""Entity rules and instance parameters on a small corpus."""

from folioscope.operators import entities


def corpus(spark):
    rows = [
        ("p1", "A.6.1.1.1", "Star", "", 1), ("x1", "A.6.1.2.1", "Operational Executor Agent Moon", "", 2), ("x2", "A.6.1.2.2", "Core Council Executor Agent 1", "", 3),
        ("f1", "A.6.1.2.1.1", "Facilitator", "The Operational Facilitator for Moon is the Acme Group.", 4), ("g1", "A.6.1.2.1.2", "GovOps", "Operational GovOps for Moon is Soter.", 5),
        ("e1", "A.1.8.1.2.2.0.6.1", "Members", "- Ann\n- Star\n- Good Foundation", 6), ("r1", "A.2.13.1.1.1", "Grant", "* Recipient: Big Lab\nmore", 7),
        ("i1", "A.9", "Config", "", 8), ("i2", "A.9.1", "Parameters", "", 9), ("i3", "A.9.1.1", "Rates", "", 10), ("i4", "A.9.1.1.1", "Fee", "2 %", 11), ("i5", "A.9.1.2", "Limits", "", 12),
        ("i6", "A.9.1.2.1", "Fee", "3 %", 13), ("i7", "A.9.1.2.2", "Caps", "- `low`: 1\n- `high`: 2", 14), ("i8", "A.9.1.3", "Custom Instance Parameters", "", 15), ("i9", "A.9.1.3.1", "Own", "x", 16),
        ("s1", "A.9.1.1.1.1.1", "Status", "It is `active`.", 17),
    ]
    return spark.createDataFrame(rows, "id string, doc_no string, title string, content string, ord int")


def test_rules(spark):
    got = {r.slug: r for r in entities.entities_of(corpus(spark)).collect()}
    assert {s: (r.entity_type, r.subtype) for s, r in got.items()} == {
        "star": ("agent", "prime"), "moon": ("agent", "operational_executor"), "core-council-executor-agent-1": ("agent", "core_executor"), "acme-group": ("facilitator_org", None),
        "soter": ("govops_org", None), "ann": ("ecosystem_actor", None), "good-foundation": ("foundation", None), "big-lab": ("ecosystem_actor", None),
    }
    assert got["star"].id == "p1" and got["ann"].id is None and got["big-lab"].defining_doc_id == "r1"


def test_params(spark):
    docs = corpus(spark).where("id <> 's1'")
    got = {(r.key, r.value, r.src_id) for r in entities.instance_params(docs, docs.where("id = 'i1'").select("id", "doc_no")).collect()}
    assert got == {("Fee", "2 %", "i4"), ("Limits / Fee", "3 %", "i6"), ("Caps / low", "1", "i7"), ("Caps / high", "2", "i7")}


def test_status(spark):
    docs = corpus(spark)
    got = {r.id: r.status for r in entities.primitive_status(docs, docs.where("id IN ('i4', 'i6')").select("id", "doc_no")).collect()}
    assert got == {"i4": "Active", "i6": None}


def test_values_by_title(spark):
    from pyspark.sql import functions as F

    from folioscope.operators import parameters

    a = "0x" + "ab" * 20
    rows = [
        ("Name", "The name of the token is Moon Coin.", [("Name", "Moon Coin")]), ("Agent Type", "Moon is a Prime Agent.", [("Agent Type", "Prime Agent")]), ("Reward Code", "`1234`.", [("Reward Code", "1234")]),
        ("Integration Partner Chain", "The partner is on the Base blockchain.", [("Integration Partner Chain", "Base")]), ("Pool Address", f"It is `{a}` here.", [("Pool Address", a)]), ("Network", "Base.", [("Network", "Base")]),
        ("Token Address", f"The address of T on the Base blockchain is `{a}`. The address of T on Ethereum is `x`.", [("Token Address (Base)", a), ("Token Address (Ethereum)", "x")]),
        ("Genesis Account", "It will be specified later.", [("Genesis Account", "TBD")]), ("SubProxy Account", f"The address of the account on Ethereum is `{a}`.", [("SubProxy Account / Ethereum", a)]),
        ("Inflow Rate Limit ID", f"It is `0x{'1' * 64}`.", [("Inflow Rate Limit ID", "0x" + "1" * 64)]), ("Swap RateLimitID", "The id: N/A for now.", [("Swap RateLimitID", "N/A for now")]), ("Caps", "Are:\n- `low`: 1\n* `high`: 2", [("Caps / low", "1"), ("Caps / high", "2")]),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "title string, content string")
    got = {r.title: [tuple(p) for p in r.p] for r in df.select("title", parameters.expanded(F.col("title"), F.trim("content")).alias("p")).collect()}
    assert got == {t: p for t, _, p in rows}
    one = spark.createDataFrame([("The documents herein define it.", "- Cat\n  - One Primitive\n    - Two Primitive", "on Avalanche C-Chain")], "a string, b string, c string")
    row = one.select(parameters.directory(F.col("a")).alias("a"), parameters.listed_members(F.col("b")).alias("b"), parameters.chain_name(F.col("c")).alias("c"), parameters.explorer_url(F.lit("x"), F.lit("odd")).alias("d")).first()
    assert tuple(row) == (True, ["One Primitive", "Two Primitive"], "avalanche", "https://etherscan.io/address/x")


def test_steps_by_their_source(spark):
    from folioscope.plans import chains

    texts = {"a": "", "b": "# Step 1\n## stage 2\n# Step 1", "c": "1. x\n2. y\n3. z", "d": "(1) and (2), (3) but (5)", "e": "- a\n* b\n- c", "f": "- a\n- b", "g": "(2) (1)"}
    processes = spark.createDataFrame([(k, k.upper(), t, 9 if k == "f" else None) for k, t in texts.items()], "id string, doc_no string, content string, override int")
    docs = spark.createDataFrame([("A.1",), ("A.2",), ("A.0.6.1",), ("B.1.1",)], "doc_no string")
    got = {r.id: (r.steps, r.source) for r in chains.step_audit(processes, docs).collect()}
    assert got == {"a": (2, "children"), "b": (2, "step-headings"), "c": (3, "numbered-list"), "d": (3, "parenthesized"), "e": (3, "bullets"), "f": (9, "override"), "g": (None, "none")}


def test_chains_deeper_than_any_bound(spark):
    from folioscope.operators import hierarchy

    docs = spark.createDataFrame([(f"n{k}", f"n{k - 1}" if k else None) for k in range(13)], "id string, parent_id string")
    got = {(r.id, r.hop, r.ancestor_id) for r in hierarchy.parent_chain(docs).collect()}
    assert got == {(f"n{k}", k - j, f"n{j}") for k in range(13) for j in range(k)}
    assert {r.id for r in hierarchy.subtree(docs, "n0").collect()} == {f"n{k}" for k in range(13)}
    assert {r.id: r.hop for r in hierarchy.closest_flagged(docs, spark.createDataFrame([("n1",), ("n7",)], "id string")).collect()} == {f"n{k}": k - (7 if k > 7 else 1) for k in range(2, 13)}


def test_long_numbers_compare_as_numbers(spark):
    from pyspark.sql import functions as F

    from folioscope.functions import text

    numbers = ["A.2", "A.010", "A.99", "A.9999999999", "A.12345678901", "A.12345678902", "A.100000000000", "A.var2"]
    df = spark.createDataFrame([(n,) for n in reversed(numbers)], "n string").orderBy(text.natural_key(F.col("n")))
    assert [r.n for r in df.collect()] == numbers


def test_glossary_terms_are_looked_for_without_runs_of_words(spark):
    from folioscope.operators import tables

    texts = spark.createDataFrame([(1, "The  APACHE-license, the"), (2, "then apachelicense"), (3, None), (4, ""), (5, "x the"), (6, "apache\nLicense")], "id int, content string")
    terms = spark.createDataFrame([("the",), ("apache license",), ("the",)], "term string")
    found = tables.glossary_hits(texts, terms)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "apache license"), (1, "the"), (5, "the"), (6, "apache license")]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
