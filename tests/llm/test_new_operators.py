"""Rule ensembles, whitening and the trie of conversations on hand-made rows and against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from folioscope.llm import prefix_trie, quality, queries, toxicity, whitening
from folioscope.llm.common import table
from pyspark.sql import functions as F

ODD = [(1, "One plain line of words."), (2, None), (3, ""), (4, " \t\n"), (5, "x " * 400_000), (6, "é́ 日本語 😀!!"), (6, "é́ 日本語 😀!!"), (None, "a b.\nc d.\nc d."), (7, "AB" * 300_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, "c") for r in ODD], "doc_id long, text string, s_words int, _words string")


def brute_statistics(text):
    import re

    text = text or ""
    words, lines = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w], text.split("\n")
    letters, share = sum(c.isalpha() for c in text), lambda a, b: a / b if b else 0.0
    n = len(words)
    return {
        "words": np.log1p(n), "word_length": share(letters, n), "longest_word": np.log1p(max(map(len, words), default=0)), "marks": share(len(text) - letters - n, n),
        "capitals": share(sum(c.isupper() for c in text), letters), "stops": share(text.count("."), n), "commas": share(text.count(","), n),
        "distinct_words": share(len(set(words)), n), "repeated_words": share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n),
        "line_words": np.log1p(share(n, len(lines))), "distinct_lines": share(len(set(lines)), len(lines)), "ended_lines": share(sum(x[-1:] in {".", "?", "!"} for x in lines), len(lines)),
    }


def test_statistics_brute_force(spark, odd, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").limit(60).unionByName(odd.select("doc_id", "text").where("doc_id < 6"))
    text = {r.doc_id: r.text for r in docs.dropDuplicates(["doc_id"]).collect()}
    rows = quality.with_statistics(docs.dropDuplicates(["doc_id"]), "doc_id").collect()
    for r in rows:
        for name, value in brute_statistics(text[r.doc_id]).items():
            assert r[f"s_{name}"] == pytest.approx(value), (r.doc_id, name)


def test_rules_are_found_weighed_and_compiled(spark, odd):
    rng = np.random.default_rng(1)
    x = rng.random((800, len(quality.NAMES)))
    at = quality.NAMES.index
    y = ((x[:, at("marks")] <= 0.6) & (x[:, at("distinct_words")] > 0.3)).astype(int)
    model = quality.fit_rules(x, y)
    fresh = rng.random((500, x.shape[1]))
    truth = (fresh[:, at("marks")] <= 0.6) & (fresh[:, at("distinct_words")] > 0.3)
    assert ((model.score(fresh) >= 0.5) == truth).mean() > 0.95 and 0 < len(model.rules) < 40
    strongest = max(model.rules, key=lambda r: abs(r.weight))
    assert {n for n, _, _ in strongest.parts} & {"marks", "distinct_words"} and strongest.parts[0][0] in str(strongest)
    rows = spark.createDataFrame([(n, *map(float, r)) for n, r in enumerate(fresh[:50])], ["n", *[f"s_{n}" for n in quality.NAMES]])
    got = {r.n: r.p for r in rows.select("n", model.column().alias("p")).collect()}
    assert [got[n] for n in range(50)] == pytest.approx(model.score(fresh[:50]).tolist())
    scored = quality.score_quality(odd, model).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in scored) and scored[0].asDict().keys() == {"doc_id", "score", "predicted"}
    assert quality.score_quality(odd.limit(0), model).count() == 0
    assert quality.fit_rules(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5] and quality.fit_rules(x[:9], np.ones(9, int)).score(x[:1])[0] > 0.9
    assert len(quality.fit_rules(np.zeros((40, x.shape[1])), np.arange(40) % 2).rules) == 0  # nothing to split on


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(2)
    r, y = rng.standard_normal((300, 40)), (rng.random(300) < 0.3).astype(int)
    y[r[:, 3] > 0.5] = 1
    weight = quality.even_weights(y)
    w, b = quality.lasso(r, y, weight, 0.05, (np.zeros(40), 0.0))
    slope = r.T @ (weight * (1 / (1 + np.exp(-(r @ w + b))) - y)) / 300
    assert 0 < (w != 0).sum() < 40 and np.all(np.abs(slope[w == 0]) <= 0.0502) and np.allclose(slope[w != 0], -0.05 * np.sign(w[w != 0]), atol=2e-3)


def auc(good, bad):
    return float((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2)


def test_quality_of_rows_not_learned_from(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.op11_quality(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(got.doc_id, got.held_out, strict=True))
    own = got[got.held_out & got.quality.isin([0, 1])]
    good, bad = (own.score[own.quality == v].to_numpy() for v in (1, 0))
    assert auc(good, bad) > 0.97 and (good >= 0.7).mean() > 0.95


def test_toxicity_of_rows_not_learned_from(spark):
    """Few labels: 51 toxic and 348 clean ones, of which 33 and 253 are learned from."""
    sf_dir = "/root/testdata/sf0.01"
    got = queries.op3_toxicity(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").toPandas()
    own = got[got.held_out & got.toxic.isin([0, 1])]
    toxic, clean = (own.score[own.toxic == v].to_numpy() for v in (1, 0))
    assert auc(toxic, clean) > 0.75 and own.score.nunique() > 50 and (clean >= 0.7).mean() < 0.05


def test_calibration():
    z = np.concatenate([np.random.default_rng(0).normal(m, 1, n) for m, n in ((0, 2000), (3, 50))])
    y = np.repeat([0, 1], [2000, 50])
    a, b = toxicity.calibrate(z, y)
    assert a > 0 and abs(-b / a - 1.5) < 0.3  # the middle, though one class is rare
    a, b = toxicity.calibrate(-z, y)
    assert a == 1.0 and toxicity.calibrate(z, np.zeros(len(z), int)) == (1.0, 0.0)


def test_one_long_text_does_not_end_the_sample(spark):
    rows = [(k, ("bad bad bad" if k % 2 else "good words here") + f" w{k % 5}") for k in range(60)] + [(100 + k, "long " * 5000) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(d, int("bad" in t)) for d, t in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, marks, sample_bytes=5000)
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert min(score[k] for k in range(1, 60, 2)) > max(score[k] for k in range(0, 60, 2))


def matrices():
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    yield (lambda a: a @ a.T)(rng.standard_normal((20, 25)))
    yield turn @ np.diag([7.0, 7, 7, 7 - 1e-10] + [1.0] * 26) @ turn.T
    yield np.diag([5.0, 5, 5, 5, 1, 0.5])
    yield np.ones((5, 5))
    yield np.array([[3.0]])
    yield np.array([[3.0, 1], [1, 2]])
    yield np.zeros((3, 3))
    yield -np.eye(4)
    yield np.diag(10.0 ** np.arange(-8, 8))


@pytest.mark.parametrize("matrix", list(matrices()))
def test_leading_components(matrix):
    values, rows = whitening.leading_components(matrix, 4)
    scale = np.abs(matrix).max() or 1
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:4], atol=1e-13 * scale * len(matrix))
    assert np.abs(matrix @ rows.T - rows.T * values).max() < 1e-12 * scale and np.abs(rows @ rows.T - np.eye(len(rows))).max() < 1e-13


def brute_whitening(vectors, k=4):
    x = np.array([[int(np.floor(c * 256)) for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    y = fit - total / n
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return n, ((n * x - total) ** 2).sum(1), (x - total / n) @ basis / np.sqrt(values), values / np.trace(y.T @ y / n)


def test_whitening_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()]
    rows += [(9000, rows[0][1]), (9000, rows[0][1]), (None, rows[1][1]), (9001, None), (9002, [None] * 64), (9003, [float("nan")] * 64), (9004, [float("inf")] + [0.0] * 63), (9005, []), (9006, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, 1, "y") for r in rows], "vec_id long, embedding array<float>, n int, component string").repartition(5)
    sound = [r for r in rows if r[1] and len(r[1]) == 64 and all(c is not None and np.isfinite(c) for c in r[1])]
    n, deviation, whitened, explained = brute_whitening([r[1] for r in sound])
    out = whitening.whiten(frame).toPandas()
    assert len(out) == 4 * len(sound) and out.vec_id.isna().sum() == 4 and set(out.n) == {n} and out.identity_error.max() < 1e-9 and out.identity_error.nunique() == 1
    want = {r[0]: (int(d), z) for r, d, z in zip(sound, deviation, whitened, strict=True)}
    sign = None
    for vec_id, own in out[out.vec_id.notna()].groupby("vec_id"):
        own = own.sort_values("component").drop_duplicates("component")
        assert {int(d) for d in own.deviation} == {want[int(vec_id)][0]} and np.allclose(own.explained, explained)
        z = want[int(vec_id)][1]
        assert np.allclose(np.abs(own.whitened), np.abs(z), atol=1e-9)
        new = np.sign(own.whitened.to_numpy() * z)
        sign = new if sign is None else sign
        assert np.all((new == sign) | (np.abs(z) < 1e-9))


def test_whitening_edges(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0 and whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], kind)).collect()
    assert len(same) == 4 and all(r.n == 1 and r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error == 0 for r in same)
    line = whitening.whiten(spark.createDataFrame([(k, [k / 2, -k / 4]) for k in range(5)], kind)).collect()
    assert {r.whitened is None for r in line if r.component == 2} == {True} and all(abs(r.explained - 1) < 1e-12 for r in line if r.component == 1)
    huge = whitening.whiten(spark.createDataFrame([(k, [k * 1e12, -3e12, 0.5]) for k in range(4)], kind), 1).collect()
    assert {r.vec_id: int(r.deviation) for r in huge} == {k: (4 * k * 256 * 10**12 - 6 * 256 * 10**12) ** 2 for k in range(4)}


def brute_trie(conversations):
    """Nodes from {id: [(role, text)]}, each sequence by itself."""
    members, ends = {}, {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for seq in members:
        if seq:
            kids.setdefault(seq[:-1], []).append(seq)

    def below(seq):
        out, todo = [], [seq]
        while todo:
            out.append(todo.pop())
            todo += kids.get(out[-1], [])
        return out

    for seq, who in members.items():
        sub = below(seq)
        saved = sum((len(members[s]) - 1) * len(s[-1][1].encode()) for s in sub if s)
        told = ",".join(map(str, sorted(ends.get(seq, []))))
        yield (min(who), len(seq), min(members[seq[:-1]]) if seq else None, len(who), len(kids.get(seq, [])), sum(s not in kids for s in sub), saved, hashlib.sha256(told.encode()).hexdigest())


def brute_rebranch(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def test_trie_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 16)
    monkeypatch.setattr(prefix_trie, "IDS_AT_ONCE", 3)
    rng = np.random.default_rng(3)
    rows = [(c, t, "user" if t % 2 else "assistant", f"t{t} {'abé'[int(rng.integers(0, 3))] if rng.random() < 0.1 else ''}") for c in range(-12, 40) for t in range(int(rng.integers(1, 24)))]
    rows += [(c, t, "user", "same") for c in range(100, 120) for t in range(9)] + [(200, t, "user", f"long {t}") for t in range(70)] + [(201, t, "user", f"long {t % 40}") for t in range(70)]
    rows += [(300, None, None, None), (300, 0, "user", None), (None, 0, "user", "lost"), (2**63 - 1, 0, "user", "end"), (-(2**63), 0, "user", "start")]
    frame = spark.createDataFrame([(*r, 7, 8) for r in rows], "conv_id long, turn int, role string, text string, depth int, bytes int").repartition(4)
    turns, ids = prefix_trie.rebranched(prefix_trie.numbered(frame))
    got = [tuple(r) for r in prefix_trie.prefix_trie(turns, ids).collect()]
    assert sorted(got, key=repr) == sorted(brute_trie(brute_rebranch(rows)), key=repr)
    # without the exchange of beginnings, and with repeated rows as turns of their own
    small = [(1, 0, "u", "a"), (1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "u", "b")]
    plain = prefix_trie.prefix_trie(prefix_trie.numbered(spark.createDataFrame(small, "conv_id long, turn int, role string, text string")))
    assert sorted((tuple(r) for r in plain.collect()), key=repr) == sorted(brute_trie({1: [("u", "a")] * 2, 2: [("u", "a"), ("u", "b")]}), key=repr)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.numbered(none)).count() == 0
    ids = spark.createDataFrame([(3,), (5,)], "conv_id long")
    root = prefix_trie.prefix_trie(prefix_trie.numbered(none), ids).collect()
    assert [tuple(r) for r in root] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]
