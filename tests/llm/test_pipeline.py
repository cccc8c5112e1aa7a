"""The pipeline's stages on the smallest tables, against brute force where there is one."""

import corpus_pipeline
import pytest
from folioscope.llm.common import table

from .test_operators import brute_groups


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def test_near_copies(spark, docs, sf_dir):
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    groups = brute_groups([(r.doc_id, r.text) for r in docs.collect()], 5, 80, 100)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in groups.items() if c == d}


def test_near_copies_of_repeated_and_nameless_rows(spark, docs, sf_dir):
    text = "a b c d e f g h"
    rows = [(1, text), (1, text), (1, "other words stand here now and then"), (2, text), (None, text), (None, "only here are these words of mine"), (None, "only here are these words of mine"), (3, None), (4, None), (None, None), (5, "")]
    odd = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], docs.schema)
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in corpus_pipeline.drop_near_copies(spark, odd, sf_dir).collect())
    assert [k[1] for k in kept if not k[0]] == [1, 3, 4, 5] and [k[2] for k in kept if k[0]] == ["", "only here are these words of mine"]
    assert corpus_pipeline.drop_near_copies(spark, odd.limit(0), sf_dir).count() == 0


def test_toxic_ones_go(spark, docs, sf_dir):
    """The stage against the scores of the model that it learns."""
    from folioscope.llm import toxicity

    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    kept = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, s in score.items() if s < 0.7}


def brute_mixture(rows):
    """Words that each source gives: filled level by level, clamped at three times its size."""
    size = {}
    for source, n in rows:
        size[source] = size.get(source, 0) + n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, still = dict.fromkeys(names, 0.0), float(sum(size.values())), set(names)
    while still:
        share = {s: left * weight[s] / sum(weight[x] for x in still) for s in still}
        over = {s for s in still if share[s] > 3 * size[s]}
        for s in over or still:
            target[s] = 3.0 * size[s] if over else share[s]
        left -= sum(target[s] for s in over)
        still = still - over if over else set()
    return target


def test_mixture_brute_force(spark, docs, sf_dir):
    count = lambda t: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w])
    rows = [(r.doc_id, r.source, count(r.text)) for r in docs.collect()]
    target = brute_mixture([r[1:] for r in rows])
    size = {r[0]: r for r in rows}
    taken, often = dict.fromkeys(target, 0), {}
    for r in corpus_pipeline.mix_sources(spark, docs, sf_dir).collect():
        taken[r.source] += size[r.doc_id][2]
        often[r.doc_id] = often.get(r.doc_id, 0) + 1
    for s, want in target.items():
        own = [r for r in rows if r[1] == s]
        assert abs(taken[s] - want) <= max(r[2] for r in own)
        whole = int(want // sum(r[2] for r in own)) if any(r[2] for r in own) else 0
        assert all(whole <= often.get(r[0], 0) <= whole + 1 for r in own if r[2])


def test_tokens_brute_force(spark, docs, sf_dir):
    import zlib

    import numpy as np
    from folioscope.llm.queries import tokenizer_path
    from tokenizers import Tokenizer

    tokenizer, at, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in corpus_pipeline.write_tokens(spark, docs, sf_dir).collect()) == want


def test_benchmark(spark, docs, sf_dir):
    from folioscope.llm.decontaminate import contaminated

    found = {r.doc_id for r in contaminated(docs, table(spark, sf_dir, "benchmark")).collect()}
    assert found and {r.doc_id for r in corpus_pipeline.drop_benchmark(spark, docs, sf_dir).collect()} == {r.doc_id for r in docs.collect()} - found


def test_mixture_and_run(spark, docs, sf_dir):
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert mixed.columns == docs.columns and max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 3
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontaminate", "mixing", "token_output"]
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_benchmark_takes_rows_without_an_id(spark, docs, sf_dir):
    item = table(spark, sf_dir, "benchmark").first().text
    rows = [(1, f"before {item} after"), (None, f"before {item} after"), (None, f"{item} and some more"), (2, "clean words of nobody's benchmark at all"), (None, "other clean words of nobody at all"), (None, None), (3, "")]
    odd = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 9) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _found_id int")
    odd = odd.drop("_found_id").withColumn("found", odd["n_chars"]).withColumn("item_id", odd["n_chars"])
    kept = corpus_pipeline.drop_benchmark(spark, odd, sf_dir)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((d or 0, t or "") for d, t in rows[3:])
    assert corpus_pipeline.drop_benchmark(spark, odd.limit(0), sf_dir).count() == 0


def test_mixture_keeps_columns_with_its_own_names(spark, docs, sf_dir):
    clash = ["size", "source_size", "weight", "target", "copies", "taken"]
    some = docs.limit(40)
    for name in clash:
        some = some.withColumn(name, some["n_chars"] + len(name))
    got = corpus_pipeline.mix_sources(spark, some, sf_dir)
    rows = got.collect()
    assert got.columns == some.columns and rows and all(r[n] == r.n_chars + len(n) for r in rows for n in clash)
    plain = corpus_pipeline.mix_sources(spark, some.drop(*clash), sf_dir)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain.collect())


def test_toxic_rows_go_with_or_without_an_id(spark, docs, sf_dir):
    rejected = {r.doc_id for r in docs.collect()} - {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf_dir).collect()}
    toxic = docs.where(docs.doc_id.isin(list(rejected))) if rejected else docs.limit(0)
    odd = docs.unionByName(toxic.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars")).unionByName(docs.limit(1).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text", "lang", "source", "n_chars"))
    kept = corpus_pipeline.drop_toxic(spark, odd, sf_dir)
    assert kept.where("doc_id IS NULL").count() == 1
