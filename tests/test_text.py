"""Column functions, readers, extraction and streams on hand-made fixtures."""

from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import extraction, hierarchy, history, search
from folioscope.sources import readers
from folioscope.streaming import changes

U = "00000000-0000-0000-0000-00000000000"


def value(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells)).select(column).first()[0]


def test_true_depth(spark):
    rows = [("A.1", 1), ("A.1.2.3", 3), ("A.1.2.0.6.4", 3), ("A.1.2.0.4.1.1.5", 4), ("A.1.2.0.4.1.1.5.2", 5), ("A.1.6.var1", 3), ("NR-4", 1), ("A", 0)]
    df = spark.createDataFrame([r[0:1] for r in rows], "doc_no string").select("doc_no", text.true_depth(F.col("doc_no")).alias("d"))
    assert {r.doc_no: r.d for r in df.collect()} == dict(rows)
    assert value(spark, text.true_depth(F.col("a"), F.col("b")), a="NR-1", b="A.1.2") == 3


def test_prose(spark):
    assert value(spark, text.name_list(F.col("a")), a="Ann, the Bob and Carl") == ["Ann", "Bob", "Carl"]
    assert value(spark, text.bullet_items(F.col("a")), a="x\n- Recipient: Ann\n * Bob\n-\n") == ["Ann", "Bob"]
    assert value(spark, text.assignment(F.col("a"), "The lead"), a="The lead is the Acme Group. More.") == "Acme Group"
    assert value(spark, text.declared_party(F.col("a")), a="x\nResponsible Party: Core GovOps Acme.\nmore") == "Core GovOps Acme"
    assert tuple(value(spark, text.party_role(F.col("a")), a="Core GovOps Acme")) == ("core_govops", "Acme")
    assert value(spark, text.alias_keys(F.col("a")), a="Big Name (BN)") == ["big name (bn)", "big name", "bn"]
    assert value(spark, text.message_number(F.col("a")), a="Fix (#3) again (#12)") == 12
    assert value(spark, text.links(F.col("a")), a=f"[x]({U}1) [y]({U}2) [z]({U}1)") == [f"{U}1", f"{U}2"]
    assert value(spark, text.scrub(F.col("a")), a="**Do not merge yet**\nA real description here") == "A real description here"
    assert value(spark, text.scrub(F.col("a")), a="https://example.org/x") is None
    assert value(spark, text.scrub(F.col("a")), a="Adds the vault. This may only be merged once the poll passes!\nOriginating forum post: <https://x.org/1>") == "Adds the vault."
    assert value(spark, text.declared_party(F.col("a")), a="The Responsible Party is the Acme Lab. It acts.") == "Acme Lab"
    assert value(spark, text.declared_party(F.col("a")), a="The Responsible Party is [Acme](x).") is None
    assert value(spark, text.natural_key(F.col("a")), a="A.2") < value(spark, text.natural_key(F.col("a")), a="A.10")


def test_highlight_tiers(spark):
    cases = [
        ("The GOVERNANCE of <un>governed", (["govern"],), "The <mark>GOVERN</mark>ANCE of &lt;un&gt;<mark>govern</mark>ed"),
        ("Big cats, big cat & bigger", (["big"], ["big cat"]), "<mark>Big</mark> cats, <mark>big cat</mark> &amp; <mark>big</mark>ger"),
        ("Sky, sky and skyline", (["sky"], [], ["Sky"]), "<mark>Sky</mark>, sky and <mark>sky</mark>line"),
        ("One Two one two", ([], ["one two"], ["One Two", "ab"]), "<mark>One Two</mark> one two"),
        ("a.b axb", (["a.b", "x"],), "<mark>a.b</mark> axb"),
        ("", (["ab"], ["cd"]), ""), ("x < y", ([],), "x &lt; y"),
    ]
    for body, given, want in cases:
        assert value(spark, text.highlight(F.col("a"), *given), a=body) == want
    assert value(spark, text.highlight(F.lit(None).cast("string"), "ab"), a="") is None


CORPUS = f"""before
# A.1 - Root [Scope]  <!-- UUID: {U}1 -->
body
line two
## A.1.1 - Child [Core]  <!-- UUID: {U}2 -->
#### A.1.1.1.1 - Far [Core]  <!-- UUID: {U}3 -->
## A.1.2 - Second [Core]  <!-- UUID: {U}4 -->
### A.1.2.1 - Leaf [Core]  <!-- UUID: {U}5 -->
"""


def test_sections(spark):
    rows = readers.sections(spark.createDataFrame([("f", CORPUS), ("g", "no heading")], "path string, text string")).orderBy("ord").collect()
    assert [(r.doc_no, r.depth, r.parent_id and r.parent_id[-1]) for r in rows] == [("A.1", 1, None), ("A.1.1", 2, "1"), ("A.1.1.1.1", 4, None), ("A.1.2", 2, "1"), ("A.1.2.1", 3, "4")]
    assert rows[0].content == "body\nline two" and rows[0].title == "Root" and rows[0].type == "Scope"


def test_front_matter(spark):
    files = [("a/document.md", "---\nid: 'x''y'\ndocNo: A.1\nname: \"Say \\\"hi\\\"\"\ntype: Core\n---\n\n# A.1 - T\n\nBody\n"), ("b/document.md", "---\nname: none\n---\nBody")]
    row, = readers.front_matter(spark.createDataFrame(files, "path string, text string")).collect()
    assert (row.id, row.title, row.content) == ("x'y", 'Say "hi"', "Body\n")
    both = readers.snapshot(spark.createDataFrame([("f", CORPUS)], "path string, text string"), readers.front_matter(spark.createDataFrame(files, "path string, text string")))
    assert both.count() == 6


def test_maps_and_tables(spark):
    one = lambda t: spark.createDataFrame([(t,)], "text string")
    assert {r.id: r.a for r in readers.json_map(one('{"k": {"a": 1}, "l": {}}'), "a: INT").collect()} == {"k": 1, "l": None}
    files = spark.createDataFrame([("h/x.json", '[{"d": "1"}, {"d": "2"}]'), ("h/_y.json", "[{}]"), ("h/z.json", "broken")], "path string, text string")
    assert [(r.doc_id, r.d) for r in readers.json_arrays(files, "d: STRING").collect()] == [("x", "1"), ("x", "2")]
    chained = readers.state_values(one('{"base": {"slot": 5, "values": {"0xa": {"f": null}}}}')).collect()
    flat = readers.state_values(one('{"block": 7, "values": {"0xa": {"f": "1"}}}')).collect()
    assert [tuple(r) for r in chained] == [("base", 5, "0xa", "f", None)] and [tuple(r) for r in flat] == [("ethereum", 7, "0xa", "f", "1")]
    table = "x\n| A | B |\n|---|---|\n| 1 | 2 |\n| 3 |\n"
    assert [r.cells for r in readers.pipe_table(spark.createDataFrame([("d", table), ("e", "| only |")], "id string, content string")).collect()] == [{"A": "1", "B": "2"}, {"A": "3", "B": ""}]
    rows = spark.createDataFrame([(1, "0xAB", "", "1", ""), (1, "0xcd", "N", "false", "0xEF")], "chain_id int, address string, name string, proxy string, implementation string")
    assert [tuple(r) for r in readers.contracts(rows).collect()] == [(1, "0xab", None, True, None), (1, "0xcd", "N", False, "0xef")]


def test_addresses(spark):
    a, b = "0x" + "aB" * 20, "0x" + "1" * 40
    body = f"The multisig address on the Base network is {a}. Treasury of Acme at address {b} holds USDS. Longer {a}0 is none."
    rows = {r.address: r for r in extraction.annotated(spark.createDataFrame([("d1", body), ("d2", f"again {a.lower()}")], "id string, content string")).collect()}
    assert set(rows) == {a.lower(), b} and rows[a.lower()].chain == "base" and "multisig" in rows[a.lower()].roles and rows[a.lower()].docs == ["d1", "d2"]
    assert rows[b].tokens == ["USDS"] and "treasury" in rows[b].roles
    places = extraction.addresses(spark.createDataFrame([("d1", body)], "id string, content string")).collect()
    assert [body[p.pos : p.pos + 42].lower() for p in places] == [p.address for p in places]


def test_rule_edges(spark):
    docs = [("1", "A.1", "T", None, "", 1), ("2", "A.1.0.6.1", "T", "1", "", 2), ("3", "A.1.0.3.1", "N", "1", "", 3), (f"{U}4", "A.2", "X", None, f"[a]({U}5)", 4), (f"{U}5", "A.3", "Instance Configuration Document Location", None, f"[b]({U}4) [c]({U}5)", 5)]
    df = spark.createDataFrame(docs, "id string, doc_no string, title string, parent_id string, content string, ord int")
    assert {(r.from_id[-1], r.to_id[-1], r.edge_type) for r in extraction.rule_edges(df).collect()} == {("2", "1", "active_data_for"), ("3", "1", "annotates"), ("5", "4", "located_at")}
    assert {(r.from_id[-1], r.to_id[-1]) for r in extraction.citations(df).collect()} == {("4", "5"), ("5", "4")}
    shown = {r.id[-1]: r.display_parent_id for r in hierarchy.display_parent(df).collect()}
    assert shown["2"] == "1" and shown["3"] == "1"


def test_change_classes(spark):
    v = lambda *rows: spark.createDataFrame(list(rows), "id string, title string, content string, path string")
    prev = v(("a", "t", "one two", "p"), ("b", "t", "x. y", "p"), ("c", "t", "colr of it", "p"), ("d", "t", "same", "p"), ("e", "t", "gone", "p"))
    curr = v(("a", "t", "one three", "p"), ("b", "t", "x. y -", "p"), ("c", "t", "colr of it an", "p"), ("d", "t", "same", "q"), ("f", "t", "new", "p"))
    assert {(r.id, r.change_type) for r in history.diff(prev, curr).collect()} == {("a", "modified"), ("b", "modified"), ("c", "modified"), ("d", "moved"), ("e", "removed"), ("f", "added")}
    assert {r.id: r.kind for r in history.change_size(history.token_changes(prev, curr)).collect()} == {"a": "semantic", "b": "lint", "c": "typo"}
    assert value(spark, history.title_kind(F.col("a")), a="Fixes a typo in X") == "typo" and value(spark, history.title_kind(F.col("a")), a="Lint it") == "lint"
    for title, kind in (("Spelling fixes", "typo"), ("Corrects typos", None), ("Correct typo", "typo"), ("Non-breaking spaces", "lint"), ("Fix typos in formatting", "lint"), ("Flint and steel", None), (None, None)):
        assert value(spark, history.title_kind(F.col("a").cast("string")), a=title or "") == kind
    got = value(spark, history.bullets(F.col("a")), a="x\n- **One** — first\n* **Two**\nplain")
    assert [tuple(x) for x in got] == [("One", "first"), ("Two", "")]


def test_query_strings(spark):
    row = search.parse_queries(spark.createDataFrame([('in:A.1 type:Core "big cat" word~2 -dog tail',)], "q string")).first()
    assert (row.scope, row.types, row.phrases, row.fuzzy, row.exclusions, row.rest) == ("A.1", ["Core"], ["big cat"], 2, ["dog"], "word tail")
    assert value(spark, search.ticker_phrases(F.col("a")), a="what of sUSDS or USDS and stUSDS9 aB") == ["sUSDS"]


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = changes.read_changes(spark, str(tmp_path / "in"), events.schema)
    for _ in range(2):  # the second run finds nothing new
        changes.append_new(stream, str(tmp_path / "out"), ["event_id"], str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.select("event_id").distinct().count()
    q = changes.usage(stream, 100.0).writeStream.format("memory").queryName("used").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = events.groupBy("user_id", F.window("ts", "120 minutes")).agg(F.sum("value"))
    assert spark.table("used").count() == want.count()
