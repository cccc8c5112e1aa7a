"""Search operators against brute force on hand-made rows."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope import catalog
from folioscope.operators import search


def test_all_vectors_are_neighbours(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist(), None if i % 3 == 0 else i % 10) for i in range(200)]
    rows[7] = (7, rows[50][1], 9)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.query_id, r["rank"]): r.doc_id for r in catalog.queries()["r10_all_vectors"](spark, str(tmp_path)).collect()}
    unit = np.array([r[1] for r in rows], np.float32).astype(float)
    unit /= np.sqrt((unit**2).sum(1, keepdims=True))
    near = np.round(unit @ unit.T, 9)
    want = {(f"D{q}", k): d for q in range(0, 200, 50) for k, d in enumerate(sorted((f"D{i}" for i in range(200)), key=lambda d, q=q: (-near[q, int(d[1:])], d))[:8])}
    assert got == want and {got["D50", 0], got["D50", 1]} == {"D50", "D7"}


@pytest.mark.parametrize("block", [3, 10_000])
def test_semantic_takes_more_queries_than_a_block(spark, block):
    rng = np.random.default_rng(2)
    vectors = [(f"v{i}", rng.normal(size=3).tolist()) for i in range(30)] + [("none", None), ("short", [1.0]), ("hole", [1.0, None, 0.0])]
    asked = [(i, rng.normal(size=3).tolist()) for i in range(20)] + [(99, None)]
    found = search.semantic(spark.createDataFrame(vectors, "doc_id string, embedding array<double>").repartition(3), spark.createDataFrame(asked, "query_id long, q_vector array<double>"), 2, block=block)
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    want = {(q, k, d) for q, x in asked[:20] for k, d in enumerate(sorted((d for d, _ in vectors[:30]), key=lambda d, x=x: -unit(x) @ unit(dict(vectors)[d]))[:2])}
    assert {(r.query_id, r["rank"], r.doc_id) for r in found.collect()} == want


def test_terms_stand_for_those_that_begin_with_them_in_all_fields(spark):
    docs = spark.createDataFrame([("a", "plan", "x.1", "en", "nothing"), ("b", "", "planet.2", "en", ""), ("c", "", "x.3", "en", "the planning plan"), ("d", "", "x.4", "en", "pla lan")], "id string, title string, doc_no string, type string, content string")
    asked = spark.createDataFrame([(1, "plan"), (2, "planet")], "query_id int, q string")
    found = search.lexical(search.postings(docs, ["title", "doc_no", "type", "content"]), search.query_terms(asked), prefix=True)
    rows = found.collect()
    assert {(r.query_id, r.doc_id, r.fields) for r in rows} == {(1, "a", "title"), (1, "b", "doc_no"), (1, "c", "content"), (2, "b", "doc_no")}
    assert all(r.score > 0 for r in rows)


def test_registered_search_reaches_beginnings_and_numbers(spark, tmp_path):
    spark.createDataFrame([(7, "alpha beta", "wiki", "en"), (8, "licensed gamma", "books", "en")], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "gam"), (2, "wiki")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.query_id, r.doc_id) for r in catalog.queries()["r2_prefix"](spark, str(tmp_path)).collect()}
    assert got == {(1, "D8"), (2, "D7")}


@pytest.mark.parametrize("name, table", [("o1_whole_order", "docs"), ("o2_whole_order", "docs"), ("g8_whole_tree", "docs"), ("o7_whole_history", "history")])
def test_whole_sorts_keep_every_row(spark, sf_dir, name, table):
    from folioscope.queries import Views

    assert catalog.queries()[name](spark, sf_dir).count() == getattr(Views(spark, sf_dir), table).count()


def test_similar_terms_count_bytes_as_their_sql_does(spark, tmp_path):
    spark.createDataFrame([(1, "anble anêle able anblé x"), (2, "éontion ontio ontiön trash tràsh license")], "doc_id long, text string").selectExpr("*", "'web' AS source", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = set(con.execute(catalog.oracle_sql()["r4_fuzzy_terms"]).fetchall())
    got = {(r.q, r.term) for r in catalog.queries()["r4_fuzzy_terms"](spark, str(tmp_path)).collect()}
    assert got == want == {("anble", "anble"), ("anble", "able"), ("ontion", "ontio"), ("trash", "trash"), ("license", "license")}


@pytest.mark.parametrize("prefix", [False, True])
def test_documents_scored_where_they_are_give_what_an_index_gives(spark, prefix):
    rng = np.random.default_rng(3)
    words = ["plan", "planet", "planning", "lan", "Änd", "and", "x1", "x12", "rare"]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(f"d{i}", text(2), f"n.{i}", "en" if i % 3 else "fr", text(int(rng.integers(0, 30)))) for i in range(60)]
    rows += [("e1", None, None, None, None), *[(f"c{i}", *rows[0][1:2], "n", "en", rows[0][4]) for i in range(20)]]
    docs = spark.createDataFrame(rows, "id string, title string, doc_no string, type string, content string").repartition(5)
    asked = spark.createDataFrame([(i, text(3), 1 + i % 7, "en" if i == 2 else None) for i in range(10)] + [(99, "", 3, None)], "query_id int, q string, k int, kind string")
    hits = search.lexical(search.postings(docs, list(search.BOOSTS)), search.query_terms(asked), prefix=prefix).withColumn("score", F.round("score", 9)).localCheckpoint()
    plain = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 8)) for r in df.collect())
    assert plain(search.best_documents(docs, asked, 5, prefix=prefix)) == plain(search.top(hits, 5))
    kinds = docs.groupBy(F.col("id").alias("doc_id")).agg(F.min("type").alias("type"))
    fit = hits.join(asked, "query_id").join(kinds, "doc_id").where("kind IS NULL OR kind = type")
    assert plain(search.best_documents(docs, asked, prefix=prefix, kind="type")) == plain(search.top(fit, 200).where("rank < k"))
    assert {tuple(r) for r in search.match_counts(docs, asked, prefix=prefix).collect()} == {tuple(r) for r in hits.groupBy("fields").agg(F.count("*")).collect()}
    assert sorted(search.matches(docs, asked, prefix=prefix).collect()) == sorted(hits.select("query_id", "doc_id").collect())


def test_a_task_sends_its_best_only(spark):
    from functools import partial

    sent = spark.sparkContext.broadcast({2: (pa.array([1]), np.array([[1.0, 0.0]]))})
    vectors = spark.createDataFrame([(f"v{i}", [-float(i % 50), 1.0]) for i in range(3000)], "doc_id string, v array<double>").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = vectors.mapInArrow(partial(search._best, k=3, sent=sent), "query_id long, doc_id string, score double").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r.doc_id for r in found] == ["v0", "v100", "v1000"]


@pytest.mark.parametrize("name", ["r2_prefix", "r2_lexical", "r9_prefix_reason", "r9_match_reason"])
def test_rows_of_one_id_are_one_document(spark, tmp_path, name):
    rng = np.random.default_rng(4)
    rows = [(i % 40, " ".join(rng.choice(["alpha", "alp", "beta", "gamma", "1", "12"], int(rng.integers(1, 20))))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'web' AS source", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(["alp beta", "12 1", "gamma we", "en none"])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert {tuple(r[c] for c in columns) for r in catalog.queries()[name](spark, str(tmp_path)).collect()} == set(want.fetchall())


def test_a_task_counts_only_terms_that_are_asked_for(spark):
    from folioscope.operators import scoring

    texts = ["Plan planet\x00planning a x1", "plan, PLAN; änd — ß2", "", "\x7f.. nothing"] * 50 + [f"own{i} plan" for i in range(100)]
    rows = spark.createDataFrame([(f"d{i}", None, t.lower(), "ab cd") for i, t in enumerate(texts)], "doc_id string, kind string, t0 string, t1 string").coalesce(1).toArrow()
    for prefix, want in ((False, {"plan": 200, "nothing": 50}), (True, {"plan": 200, "planet": 50, "planning": 50, "nothing": 50})):
        words = spark.sparkContext.broadcast(scoring.Words(pa.array(["plan", "nothing", "none"]), prefix))
        found = pa.Table.from_batches(scoring._counted(iter(rows.to_batches(64)), words, 2)).to_pylist()
        terms = {k: n for k, n in zip(scoring.hashed(pa.array(list(want))).view(np.int64).tolist(), want.values(), strict=True)}
        assert {r["hash"]: r["df"] for r in found if r["hash"] is not None} == terms
        assert [(r["field"], r["df"], r["all_terms"]) for r in found if r["hash"] is None] == [(0, 250, 50 * 4 + 50 * 4 + 50 + 200), (1, 300, 600)]


def test_terms_of_texts_are_those_of_the_index():
    import pyarrow as pa
    import pyarrow.compute as pc

    from folioscope.functions.text import TERM_BREAKS
    from folioscope.operators.scoring import split_terms

    texts = pa.array(["", "ab", "cd ef", "a bc-d e", "é êt ßß x", "日本 語", "..", "trail ", " lead", "", "x", "yz", "\U0001f600 \U0001f600\U0001f600", ""])
    for some in (texts, texts.slice(2, 7), texts.slice(0, 1), texts.slice(0, 0), texts.slice(9, 1)):
        lists = pc.split_pattern_regex(some, TERM_BREAKS).to_pylist()
        want = [[t for t in own if len(t) >= 2] for own in lists]
        terms, sizes = split_terms(some)
        assert terms.to_pylist() == sum(want, []) and sizes.tolist() == [len(own) for own in want]


def test_documents_alike_are_scored_once(spark, monkeypatch):
    docs = spark.createDataFrame([(f"O{n}", f"order {n}", f"x.{n}", "low" if n % 2 else "high", "") for n in range(500)] + [("D1", "or", "y", "low", "orders of low"), ("D2", "", "z", "low", "nothing")], "id string, title string, doc_no string, type string, content string").coalesce(1)
    asked = spark.createDataFrame([(1, "or low", 3, None), (2, "or", 400, "high"), (3, "order 4", 7, None), (4, "zz", 1, None), (5, "or", 2, "low")], "query_id int, q string, k int, type string")
    got = {}
    for r in search.best_documents(docs, asked.withColumnRenamed("type", "kind"), prefix=True, kind="type").collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.doc_id, r.score)
    whole = search.lexical(search.postings(docs, list(search.BOOSTS)), search.query_terms(asked), prefix=True)
    kinds = docs.select(F.col("id").alias("doc_id"), F.col("type").alias("doc_type"))
    want = {}
    rows = whole.join(asked.select("query_id", "k", "type"), "query_id").join(kinds, "doc_id").where("type IS NULL OR type = doc_type").collect()
    for r in sorted(rows, key=lambda r: (r.query_id, -round(r.score, 9), r.doc_id)):
        own = want.setdefault(r.query_id, {})
        if len(own) < min(r.k, search.MOST_BEST):
            own[len(own)] = (r.doc_id, round(r.score, 9))
    assert {q: {n: d for n, (d, _) in own.items()} for q, own in got.items()} == {q: {n: d for n, (d, _) in own.items()} for q, own in want.items()}
    assert all(abs(got[q][n][1] - s) < 1e-8 for q, own in want.items() for n, (_, s) in own.items())
    one, two = np.array([0, 1, 0, 1, 1]), np.array([0, 0, 1, 1, 2])
    alike = list(search.scoring._alike(one, two, np.array([0.5, 1.0, 0.5, 1.0, 1.0]), np.array(["a"] * 4, object), 2))
    assert [(w.tolist(), d.tolist()) for _, w, _, d in alike] == [([0, 1], [0, 1]), ([1], [2])]


def test_terms_are_counted_where_documents_are(spark):
    docs = spark.createDataFrame([("a", "The the cat", "x É été_a b7 b7"), ("b", None, ""), ("c", "q", "日本 語 the")], "id string, title string, content string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = search.scoring.term_counts(docs, ["title", "content"])
    assert rows(got) == rows(search.postings(docs, ["title", "content"])) and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
