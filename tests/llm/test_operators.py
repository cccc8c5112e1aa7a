"""Each operator on hand-made rows with nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import chat, components, decontaminate, fm_index, mixing, near_vectors, ngram_join, pii, queries, sharding, substring, token_output, toxicity, words

DOCS = "doc_id long, text string, source string, size string, words string, spans string, component string, token string"


def table(spark, rows, width=8):
    return spark.createDataFrame([(*r, *["x"] * (width - len(r))) for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, "a b c d e f g", "s"), (2, "A b c d e f g", "s"), (3, None, None), (4, "", "s"), (5, " \t\n", None), (6, "one", "t"), (7, "one", "t"), (7, "one", "t"),
            (None, "a b c d e f g", "s"), (8, long, "t"), (9, long + " end", "t"), (10, "é́ ü 日本語 😀", "t")]
    return table(spark, rows)


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (None, 1), (2, 3), (5, 4)], "a long, b long")
    assert {tuple(r) for r in components.connected_components(links).collect()} == {(2, 2), (3, 2), (4, 2), (5, 2), (8, 8), (9, 8)}
    assert components.connected_components(links.where("a > 100")).count() == 0
    path = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components.connected_components(path).collect()} == {1}


def test_word_hashes():
    texts = [b"a bb  ccc\n", b"", b"ccc a", ("x" * 3_000_000).encode(), b"a " * 700_000]
    h, at = words.hash_words(texts)
    assert np.diff(at).tolist() == [3, 0, 2, 1, 700_000]
    assert h[0] == h[4] and h[2] == h[3] and len(set(h[at[4]:].tolist())) == 1 and h[0] == h[at[4]]


def test_mixing_edges(spark, odd):
    mixed = mixing.mix(odd, F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")).cast("long"), lambda s: mixing.cyclic_weights(s, (5.0, 2.0, 1.0)))
    rows = mixed.collect()
    assert len(rows) == 12 and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert sorted(map(tuple, mixed.repartition(7).select("doc_id", "taken").collect()), key=repr) == sorted(((r.doc_id, r.taken) for r in rows), key=repr)
    assert mixing.mix(odd.limit(0), F.lit(1), lambda s: mixing.cyclic_weights(s, (1.0,))).count() == 0
    assert mixing.repeat(mixed).count() == sum(r.copies for r in rows)


def test_water_level(spark):
    sources = spark.createDataFrame([("a", 10, 5.0), ("b", 100, 2.0), ("c", 1000, 1.0), ("d", 0, 5.0), ("e", 50, 0.0)], "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.water_level(sources).collect()}
    assert got["a"] == 30 and got["b"] == 300 and got["d"] == 0 and got["e"] == 0 and got["c"] == pytest.approx(830)
    assert sum(got.values()) == pytest.approx(1160)


def test_chat_fold_and_round_trip(spark):
    events = [("c", 1, "message", None, "user", "hi"), ("c", 2, "message", None, "assistant", "he"), ("c", 3, "delta", None, None, "llo"), ("c", 4, "message", None, "user", "again?"),
              ("c", 5, "message", None, "assistant", "old"), ("c", 6, "regenerate", 2, None, ""), ("c", 7, "delta", 2, None, "new"), ("c", 8, "edit", 1, None, "hey"),
              ("d", 1, "message", None, "user", r"<s> <\s> \<\\/s> [INST] x"), ("d", 1, "message", None, "user", r"<s> <\s> \<\\/s> [INST] x"), ("d", 2, "edit", 77, None, "lost"),
              ("e", 1, None, None, None, None), (None, 1, "message", None, "user", "x")]
    log = spark.createDataFrame([(*e, "x") for e in events], "conv_id string, seq long, kind string, target long, role string, text string, formatted string").repartition(3)
    read = {r.conv_id: r for r in chat.parse(chat.render(chat.fold(log))).collect()}
    assert [tuple(t) for t in read["c"].turns] == [("user", "hey"), ("assistant", "new")] and read["c"].learned == ["new"]
    assert [t.text for t in read["d"].turns] == [r"<s> <\s> \<\\/s> [INST] x"] * 2 and read["d"].learned == []
    assert "[INST]" not in read["d"].formatted and [tuple(t) for t in read["e"].turns] == [("", "")]
    assert chat.render(chat.fold(log.limit(0))).count() == 0
    again = chat.parse(chat.render(chat.fold(log)).withColumn("turns", F.lit(1)).unionByName(chat.render(chat.fold(log)).withColumn("turns", F.lit(2))))
    assert again.count() == 6 and again.columns == ["conv_id", "formatted", "loss_spans", "turns", "learned"]
    twice = spark.createDataFrame([(1, 5, "assistant", "b", 0), (1, 5, "assistant", "b", 0), (1, 5, "assistant", None, 0), (None, 1, None, "x", 0)], "conv_id long, pos long, role string, text string, turn int")
    both = {r.conv_id: r for r in chat.parse(chat.render(twice)).collect()}
    assert both[1].learned == ["", "b", "b"] and both[None].learned == []
    for r in read.values():
        assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == [chat_escape(t) for t in r.learned]


def chat_escape(text):
    import re

    return re.sub(r"([<\[])(\\*)(s>|r>|/s>|unk>|INST\]|/INST\])", r"\1\\\2\3", text)


def test_chat_long_conversation(spark):
    n = 20_000
    log = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("long").alias("target"),
                                F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é </s> "), F.col("id").cast("string")).alias("text"))
    read = chat.parse(chat.render(chat.fold(log))).first()
    assert [t.text for t in read.turns] == [f"é </s> {k}" for k in range(n)] and read.learned == [f"é </s> {k}" for k in range(1, n, 2)]


def test_toxicity(spark, odd):
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    def text(bad):
        w = [str(x) for x in rng.choice(vocabulary, 60)]
        for k in range(3 if bad else 0):
            w[k * 7] = str(rng.choice(["zwxqvut", "zwxqvuts", "xzwxqvu"]))
        return " ".join(w)
    y = np.array([k % 2 for k in range(300)])
    model = toxicity.fit([text(b) for b in y], y)
    split = lambda t: model.words([toxicity.plain(w) for w in t.split()]).mean()
    clean, bad, misspelt = (np.mean([split(t) for t in ts]) for ts in ([text(0) for _ in range(50)], [text(1) for _ in range(50)], [text(1).replace("zwxqvu", "zwxqvuu") for _ in range(50)]))
    assert model.score(np.array([clean]))[0] < 0.5 < model.score(np.array([misspelt]))[0] <= model.score(np.array([bad]))[0] + 0.2
    scored = toxicity.score_toxicity(odd, model).collect()
    assert len(scored) == 12 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in scored)
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0 and toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.fit([], np.zeros(0, np.int64)).score(np.zeros(1))[0] < 0.5
    docs = spark.createDataFrame([(k, text(b), "x") for k, b in enumerate(y)] * 2 + [(0, "zzz", "x"), (None, text(1), "x")], "doc_id long, text string, toxic string")
    marks = spark.createDataFrame([(k, int(b), "x") for k, b in enumerate(y)] + [(0, 1, "x"), (1, None, "x"), (9999, 1, "x")], "doc_id long, toxic int, text string")
    fitted = toxicity.train(docs, marks, sample=80)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs.dropDuplicates(["doc_id"]), fitted).collect() if r.doc_id}
    unseen = [k for k in got if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([got[k] for k in unseen if y[k]]) > np.mean([got[k] for k in unseen if not y[k]]) + 0.3
    small = toxicity.train(docs, marks, sample_bytes=10)
    assert {r.predicted for r in toxicity.score_toxicity(docs, small).collect()} == {0}


def test_scores_are_the_model_s(spark):
    """Scores of tasks against the model worked out word by word and n-gram by n-gram."""
    texts = ["ab, Cde ab! xyz", "", None, "---", "Ünïcødé wörds", "same " * 500]
    rng = np.random.default_rng(8)
    model = toxicity.Model(rng.normal(0, 1, toxicity.BUCKETS).astype(np.float32), 0.25, 1.5, -0.5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    for k, t in enumerate(texts):
        numbers = []
        for w in (t or "").split():
            w = toxicity.plain(w)
            own = toxicity.word_features([w])[0]
            marked = f"<{w}>"
            assert len(own) == 1 + sum(max(0, len(marked) - n + 1) for n in toxicity.N_GRAMS)
            numbers.append(np.mean(model.numbers[own].astype(np.float64)))
        z = np.mean(numbers) if numbers else 0.0
        assert got[k] == pytest.approx(1 / (1 + np.exp(-(1.5 * (z + 0.25) - 0.5))), abs=1e-6)


def brute_groups(rows, n, a, b):
    sets, inside = {}, {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        inside[d] = d
    def find(x):
        while inside[x] != x:
            x = inside[x]
        return x
    ids = [d for d in sets if d is not None and sets[d]]
    for i, x in enumerate(ids):
        for y in ids[:i]:
            o = len(sets[x] & sets[y])
            if b * o >= a * len(sets[x] | sets[y]):
                u, v = sorted((find(x), find(y)))
                inside[v] = u
    return {d: (len(s), find(d) if d is not None else None) for d, s in sets.items()}


def test_jaccard_edges(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = ngram_join.jaccard_groups(odd).collect()
    assert len(got) == 12
    want = brute_groups(rows, 3, 90, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert ngram_join.jaccard_groups(odd.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "RUN_BLOCK", block)
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 50, 60) for _ in range(6)]
    rows = []
    for k in range(150):
        w = base[k % 6].copy()
        change = rng.random(60) < rng.choice([0, 0.01, 0.03])
        w[change] = rng.integers(0, 50, change.sum())
        rows.append((int(rng.integers(0, 10_000)) * 200 + k, " ".join(map(str, w[: rng.integers(50, 61)]))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, a, b in ((3, 90, 100), (5, 80, 100)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(df, n, a, b).collect()}
        assert got == brute_groups(rows, n, a, b)


def test_trie_links_are_exact():
    rng = np.random.default_rng(1)
    for _ in range(40):
        sets = [np.unique(rng.integers(0, 30, rng.integers(1, 25)).astype(np.uint64)) for _ in range(12)]
        sets += [s.copy() for s in sets[:3]]
        label = np.arange(len(sets))
        ngram_join.Trie(sets).links(8, 10, label)
        want = np.arange(len(sets))
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                o = len(np.intersect1d(x, y))
                if 10 * o >= 8 * (len(x) + len(y) - o):
                    want[want == want[i]] = want[j]
        assert len(set(zip(label.tolist(), want.tolist()))) == len(set(label.tolist())) == len(set(want.tolist()))


def test_tokens_round_trip(spark, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    folder = token_output.write_tokens(odd, path)
    rows = sorted(token_output.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(path)
    texts = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = 0
    for row, (doc, text) in zip(rows, texts, strict=True):
        want = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert (row.doc_id, row.start, row.token_ids) == (doc, at, want)
        at += len(want)
    digests = token_output.token_digests(token_output.read_tokens(spark, folder)).collect()
    assert {r.start: r.ids_crc32 for r in digests} == {r.start: zlib.crc32(np.array(r.token_ids, "<u4").tobytes()) for r in rows}
    assert token_output.read_tokens(spark, token_output.write_tokens(odd.limit(0), path)).count() == 0


def test_pieces_are_the_tokenizer_s():
    encoder = token_output.PieceEncoder(queries.tokenizer_path(), 1)
    rng = np.random.default_rng(3)
    texts = ["it's 'S ...'s don''t x's,", "<|endoftext|> a", "a\x1cb\x85c\xa0d", "ΣΑΣ. é—a1b22"] + ["".join(rng.choice(list("ab'.,!-<>|é \n\xa0\x1c1ß日"), 30)) for _ in range(400)]
    ids, at = encoder.encode([t.encode() for t in texts])
    want = [[*e.ids, 1] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer(name):
    encoder = token_output.PieceEncoder(queries.tokenizer_path(name), 1)
    assert encoder.by_pieces == (name == "word_bpe_49k.json")
    texts = ["Hello  World's end", "tabs\tand\nlines ", "MiXeD 123abc <|endoftext|> x", "", "日本語 é"]
    ids, at = encoder.encode([t.encode() for t in texts])
    want = [[*e.ids, 1] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_a_range_reads_its_pages_alone(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id").cast("string")) for k in range(12)]).alias("text"), F.lit(1).alias("token_ids"))
    folder = token_output.write_tokens(docs.repartition(1), queries.tokenizer_path(), options={"parquet.page.size": "2048", "parquet.page.row.count.limit": "50"})
    whole = {r.doc_id: (r.start, r.token_ids) for r in token_output.read_tokens(spark, folder).collect()}
    some = token_output.read_tokens(spark, folder, 1000, 1019)
    assert {r.doc_id: (r.start, r.token_ids) for r in some.collect()} == {k: whole[k] for k in range(1000, 1020)}
    wanted = spark.read.schema(token_output.FILE_SCHEMA).parquet(folder).where("doc_id between 1000 and 1019").select("doc_id", "token_ids")
    wanted.collect()
    plan = wanted._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().apply(0)
    if "QueryStage" in leaf.getClass().getSimpleName():
        leaf = leaf.plan().collectLeaves().apply(0)
    assert "GreaterThanOrEqual(doc_id,1000)" in plan.toString()
    assert 20 <= leaf.metrics().apply("numOutputRows").value() < 500
    numbers = token_output.read_tokens(spark, folder).select("doc_id", "start")
    assert "token_ids" not in numbers._jdf.queryExecution().executedPlan().toString()


def test_pii(spark, odd):
    rows = [(1, "Mr. John Smith and Mrs. Jane Smith met Mr. John Smith. Call (212) 555-1234 or 212-555-1234, card 4111 1111 1111 1111 or 4111111111111111; A.B@X.org a.b@x.org 192.168.0.1"),
            (2, "192.168.0.1 and 192.168.0.2, a.b@x.org"), (3, None), (4, ""), (5, "v1.2.3.4.5 and 12345 stay"), (5, "v1.2.3.4.5 and 12345 stay")]
    got = pii.replace_entities(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, kinds int"), "key").collect()
    text = {r.doc_id: r.text for r in got}
    assert len(got) == 6 and text[3] is None and text[4] == "" and text[5] == rows[4][1]
    assert all(x not in text[1] for x in ("John", "Jane", "555-1234", "4111 1111", "a.b@x.org", "192.168.0.1"))
    w = text[1].split(" and ")
    assert w[0] == "Mr. " + text[1].split(" met Mr. ")[1].split(".")[0] and w[1].startswith("Mrs. ")
    one, two = text[2].split(" and ")[0], text[2].split(" and ")[1].split(",")[0]
    assert one != two and one in text[1] and text[2].split(", ")[1] in text[1]
    digits = "".join(c for c in text[1].split("card ")[1].split(" or ")[0] if c.isdigit())
    assert len(digits) == 16 and sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0
    assert pii.replace_entities(odd.limit(0), "key").count() == 0 and pii.replace_entities(odd, "key").count() == 12


def test_pii_leaves_no_name_of_these(spark):
    lines = ["Frau Müller Mr. Łukasz Żak", "Mrs. Anna-Maria O'Neil", "John Smith left, Dr. Ada Kerr and Mr. John Smith and Mr. Smith's", "Κύριος Παπαδόπουλος", "我见到王小明先生", "김철수 씨", "田中さん",
             "2001:db8::1 and 2001:0db8:0:0:0:0:0:1 abc::def", "DE89 3704 0044 0532 0130 00 DE89370400440532013000", "12 Long Hill Street, Hauptstraße 12", "+1 212-555-1234, 212-555-1234, (212) 555-1234",
             "+49 (0)30 1234567, +49 30 1234567", "Господин Иванов, Госпожа Анна Иванова", "Prof. Dr. Ada Kerr, Mr. J. Smith, Mary J. Watson", "a\x01b\x02 10.0.0.1 \x02\x03 \x01"]
    rows = {r.doc_id: r.text for r in pii.replace_entities(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), "key").collect()}
    for k, gone in enumerate(["Müller Łukasz Żak", "Anna Maria Neil", "John Smith Ada Kerr", "Παπαδόπουλος", "王小明", "김철수", "田中", "2001 db8", "8937 3704 0532", "Long Hill Haupt", "212 555 1234", "123 4567", "Иванов Анна Иванова", "Ada Kerr Smith Mary Watson", "10.0.0.1"]):
        assert not [g for g in gone.split() if g in rows[k]], rows[k]
    assert [rows[k].split()[0] for k in (0, 1, 3, 12)] == ["Frau", "Mrs.", "Κύριος", "Господин"] and rows[0].split()[2] == "Mr." and rows[4].startswith("我见到") and rows[4].endswith("先生")
    john, kerr = rows[2].split(" left, Dr. ")[0], rows[2].split(" left, Dr. ")[1].split(" and ")[0]
    assert f"Mr. {john} and Mr. {john.split()[1]}'s" in rows[2] and rows[13].startswith(f"Prof. Dr. {kerr}, Mr. ") and rows[13].split(", ")[1].endswith(john.split()[1])
    one, two, three = rows[10].split(", ")
    assert one == f"+1 {two}" and three == f"({two[:3]}) {two[4:]}" and rows[11].replace("(0)", "").split(", ")[0] == rows[11].split(", ")[1]
    assert rows[7].split(" and ")[0] == rows[7].split(" and ")[1].split()[0] and rows[7].startswith("fd") and rows[7].endswith(" abc::def")
    account = rows[8].split(" DE")[0].replace(" ", "")
    assert rows[8].endswith(account) and account.startswith("DE") and int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1
    assert rows[14].startswith("a\x01b\x02 10.") and rows[14].endswith(" \x02\x03 \x01")


def test_pii_brute_force(spark):
    """Mentions found by another engine of patterns; what stands between them stays, and what they mean decides what stands for them."""
    import regex

    rng = np.random.default_rng(12)
    say = lambda choices: choices[rng.integers(len(choices))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    kinds = [lambda: f"Mr. {say(['Tom', 'Ben', 'Karl'])} {say(['Reed', 'Wood', 'Stone', 'Hall'])}", lambda: f"Mrs. {say(['Reed', 'Wood', 'Stone', 'Hall'])}", lambda: f"u{digits(2)}@{say(['a.org', 'b.com'])}", lambda: f"192.168.{digits(1)}.{digits(1)}",
             lambda: f"+1 20{digits(1)}-555-010{digits(1)}", lambda: f"20{digits(1)}-555-010{digits(1)}", lambda: f"4{digits(3)} {digits(4)} {digits(4)} {digits(4)}", lambda: f"078-05-{digits(4)}", lambda: "plain words, 12 of them.", lambda: "\n"]
    texts = [" ; ".join(say(kinds)() for _ in range(rng.integers(0, 40))) for _ in range(200)]
    got = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()}
    pattern, entity, back = regex.compile(pii.PATTERN), {}, {}
    for k, text in enumerate(texts):
        found, new = list(pattern.finditer(text)), got[k].text
        assert got[k].n_entities == len(found)
        at, put = 0, 0
        for m, after in zip(found, [*[m.start() for m in found[1:]], len(text)][: len(found)], strict=True):
            assert new[put : put + m.start() - at] == text[at : m.start()]
            put += m.start() - at
            between = text[m.end() : after]
            end = new.index(between, put) if between else len(new)
            mention, drawn = m.group(), new[put:end]
            if mention.startswith("M"):
                assert drawn.split()[0] == mention.split()[0] and len(drawn.split()) == len(mention.split())
                words = list(zip(mention.split()[1:], drawn.split()[1:], strict=True))
                pairs = [("given", *w) for w in words[:-1]] + [("surname", *words[-1])]
            elif "@" in mention or mention.count(".") == 3:
                pairs = [("e", mention, drawn)]
            else:
                assert regex.sub("[0-9]", "0", drawn) == regex.sub("[0-9]", "0", mention)
                bare = lambda t: regex.sub("[^0-9]", "", t)[-10:] if t.startswith(("+", "2")) else regex.sub("[^0-9]", "", t)
                pairs = [(len(mention.removeprefix("+1 ")), bare(mention), bare(drawn))]
            for kind, a, b in pairs:
                assert entity.setdefault((kind, a), b) == b and back.setdefault((kind, b), a) == a and a != b
            at, put = m.end(), end
    assert len(entity) > 300


def test_many_surnames_of_one_script(spark):
    forms = spark.range(20_000).select(F.lit("surname").alias("kind"), F.concat(F.lit("ж"), F.translate(F.col("id").cast("string"), "0123456789", "абвгдежзий")).alias("form"))
    got = pii.surrogates(forms, "key").select("surrogate").distinct()
    assert got.count() == 20_000 and got.join(forms, got.surrogate == forms.form).isEmpty() and got.where(~F.col("surrogate").rlike(r"^\p{IsCyrillic}+$")).isEmpty()


def test_surrogates_collide_never(spark):
    forms = spark.createDataFrame([("card", f"{1000 + k * 7}") for k in range(20)] + [("ip", f"1.2.3.{k}") for k in range(50)], "kind string, form string")
    got = pii.surrogates(forms, "key").collect()
    assert len({(r.kind, r.surrogate) for r in got}) == 70 and not {(r.kind, r.surrogate) for r in got} & {(r.kind, r.form) for r in got}


@pytest.mark.parametrize("block", [1024, 4])
def test_near_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((5, 16))
    rows = [(k, (base[k % 5] + 0.12 * rng.standard_normal(16)).tolist(), k % 2) for k in range(80)]
    rows += [(100, rows[0][1], 0), (101, [0.0] * 16, 0), (102, None, 0), (103, [float("nan")] * 16, 0), (104, rows[0][1], None), (105, [1.0, None], 0), (106, [], 0), (107, [1.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string")
    got = {r.vec_id: r for r in near_vectors.near_groups(df).collect()}
    vectors = {k: np.array(e) / np.linalg.norm(e) for k, e, _ in rows[:81]}
    labels = {k: lab for k, _, lab in rows[:81]}
    near = {x: {y for y in vectors if y != x and labels[x] == labels[y] and vectors[x] @ vectors[y] >= 0.93} for x in vectors}
    for x in vectors:
        seen, todo = {x}, [x]
        while todo:
            todo += [y for y in near[todo.pop()] if y not in seen and not seen.add(y)]
        assert (got[x].n_links, got[x].component_id, got[x].kept) == (len(near[x]), min(seen), x == min(seen))
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in (101, 102, 103, 104, 105, 106, 107)) and got[None].component_id is None
    assert near_vectors.near_groups(df.limit(0)).count() == 0


def test_decontaminate(spark, odd):
    items = spark.createDataFrame([(1, "The quick, brown fox jumps over the lazy dog today again", "x"), (2, "a b", "x"), (5, "", "x"), (6, "-- !", "x"), (3, None, "x"), (None, "one two three four five six", "x")], "item_id long, text string, hash string")
    rows = [(1, "intro the QUICK brown fox jumps over the lazy dog today again outro " * 3, ""), (2, "the quick brown fox jumps over the lazy cat", ""), (3, None, ""), (1, "nothing", ""), (None, "the quick brown fox jumps over the lazy dog today again", "")]
    got = decontaminate.contaminated(table(spark, rows), items).collect()
    assert [(r.doc_id, r.item_id, r.found, r.item_shingles) for r in got] == [(1, 1, 7, 7)]
    short = spark.createDataFrame([(7, "what is the capital", "x"), (8, "Fox!", "x"), (9, "capital the is what", "x")], "item_id long, text string, hash string")
    asked = table(spark, [(1, "so, What is: the capital of it? capital", ""), (2, "is the capital what", ""), (3, "capital", ""), (4, "the fox", "")])
    assert {(r.doc_id, r.item_id, r.found, r.item_shingles) for r in decontaminate.contaminated(asked, short).collect()} == {(1, 7, 1, 1), (4, 8, 1, 1)}
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0 and decontaminate.contaminated(odd.limit(0), items).count() == 0


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_BYTES, 0])
def test_decontaminate_brute_force(spark, broadcast, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
    rng = np.random.default_rng(7)
    items = [(k, [int(x) for x in rng.integers(0, 40, rng.integers(1, 120))]) for k in range(60)]
    docs = []
    for k in range(120):
        w = [int(x) for x in rng.integers(0, 40, rng.integers(0, 60))]
        for _ in range(rng.integers(0, 3)):
            part = [x if rng.random() > 0.03 else 99 for x in items[rng.integers(0, 60)][1]]
            w = w + part + [int(x) for x in rng.integers(0, 40, 30)]
        docs.append((k, w))
    def runs(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = set()
    for i, iw in items:
        n = min(5, len(iw))
        q = runs(iw, n)
        want |= {(d, i, len(q), len(q & runs(dw, n))) for d, dw in docs if 10 * len(q & runs(dw, n)) >= 8 * len(q)}
    made = lambda rows, c: spark.createDataFrame([(k, " ".join(map(str, w))) for k, w in rows], f"{c} long, text string")
    got = {(r.doc_id, r.item_id, r.item_shingles, r.found) for r in decontaminate.contaminated(made(docs, "doc_id"), made(items, "item_id")).collect()}
    assert got == want and len(want) > 50


@pytest.mark.parametrize("shards", [1, 9, 10, 31, 38, 41, 57])
def test_sharding_law_at_any_count(spark, shards):
    rows = sharding.shard_documents(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), shards).collect()
    assert all(r.grown_shard in (r.shard, shards) for r in rows) and {r.shard for r in rows} == set(range(shards))
    assert {r.doc_id: r.shard for r in sharding.shard_documents(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("y").alias("text")), shards + 1).collect()} == {r.doc_id: r.grown_shard for r in rows}


@pytest.mark.parametrize("built", [None, 1, 2, 4, 5, 6, 9])
def test_sharding_descent_brute_force(spark, built):
    """Places against the draws of all nodes: a place's own draw is its region's, and how far its rack and it are behind the winners of their levels."""
    tree = [[[1.0, 2.0], [0.0, 1.0]], [[3.0]], [[0.5, 0.5], [2.0, 1.0], [0.0]]]
    weights = {(r,): sum(map(sum, region)) for r, region in enumerate(tree)}
    weights |= {(r, k): sum(rack) for r, region in enumerate(tree) for k, rack in enumerate(region)}
    weights |= {(r, k, s): w for r, region in enumerate(tree) for k, rack in enumerate(region) for s, w in enumerate(rack)}
    names = {path: "h" + "_".join(map(str, path)) for path in weights}
    hashes = spark.range(400).select("id", *[F.xxhash64("id", F.lit(7), *map(F.lit, path)).alias(n) for path, n in names.items()])
    got = {r.id: r.shard for r in sharding.place(spark.range(400), F.col("id"), tree, built=built).collect()}
    places = [p for p in weights if len(p) == 3][:built]
    for row in hashes.collect():
        draw = {p: -np.log((((row[n] % 2**64) >> 11) + 0.5) * 2.0**-53) / weights[p] if weights[p] else np.inf for p, n in names.items()}
        behind = lambda p: draw[p] - min(d for q, d in draw.items() if q[:-1] == p[:-1]) if weights[p] else np.inf
        assert got[row.id] == int(np.argmin([draw[p[:1]] + behind(p[:2]) + behind(p) for p in places]))


def test_sharding_shares_follow_weights_while_a_region_is_filled(spark):
    rows = sharding.place(spark.range(26_000), F.col("id"), sharding.topology(13), built=13).groupBy("shard").count().collect()
    assert {r.shard for r in rows} == set(range(13)) and all(abs(r["count"] - 2000) < 220 for r in rows)
    with pytest.raises(ValueError):
        sharding.place(spark.range(1), F.col("id"), [[[0.0, 1.0]]], built=1)


def test_sharding(spark, odd):
    got = sharding.shard_documents(odd).collect()
    assert len(got) == 12 and {r["size"] for r in got if r.doc_id == 3} == {16}
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.shard_documents(many).collect()
    assert all(r.grown_shard in (r.shard, 40) for r in rows) and 300 < sum(r.grown_shard == 40 for r in rows) < 700
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) < 650
    assert sharding.shard_documents(many.limit(0)).count() == 0


def test_sharding_moves_stay_in_changed_subtrees(spark):
    keys = spark.range(8000)
    before = [[[1.0, 1.0], [1.0, 2.0]], [[1.0, 1.0], [2.0]]]
    after = [[[1.0, 1.0], [1.0, 2.0]], [[1.0, 3.0], [2.0]]]
    moved = sharding.place(sharding.place(keys, F.col("id"), before, "a"), F.col("id"), after, "b").where("a <> b").collect()
    assert moved and all(r.b in (4, 5, 6) for r in moved)
    share = sharding.place(keys, F.col("id"), before, "a").groupBy("a").count().collect()
    assert all(abs(r["count"] / 8000 - (2 if r.a in (3, 6) else 1) / 9) < 0.02 for r in share)


def brute_kept(rows, window, by_text=False):
    first, out = {}, {}
    for d, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first.setdefault(tuple(w[i : i + window]), d) < d:
                gone[i : i + window] = [True] * window
        out[(d, t) if by_text else d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def test_substring(spark, odd, monkeypatch):
    got = substring.remove_repeats(odd, digest=True).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    assert len(got) == 12 and {r.doc_id: tuple(r)[1:] for r in got if r.doc_id is not None} == brute_kept(set(rows), 50)
    assert substring.remove_repeats(odd.limit(0)).count() == 0
    monkeypatch.setattr(substring, "SHARD_WORDS", 2000)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 400, (8, 300))
    rows = []
    for k in range(60):
        w = base[k % 8].copy()
        change = rng.random(300) < rng.choice([0, 0.01, 0.05])
        w[change] = rng.integers(0, 400, change.sum())
        rows.append((k * 3 % 61, " ".join(map(str, w[rng.integers(0, 100) : rng.integers(150, 301)]))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (50, 20):
        assert {r.doc_id: tuple(r)[1:] for r in substring.remove_repeats(df, window, digest=True).collect()} == brute_kept(rows, window)


@pytest.mark.parametrize("block", [100_000, 1500])
def test_substring_of_hot_anchors_and_repeated_ids(spark, block, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_WORDS", block)
    rng = np.random.default_rng(9)
    passage = " ".join(f"p{k}" for k in range(55))
    rows = [(k % 70, " ".join(f"a{x}" for x in rng.integers(0, 300, 30)) + f" {passage} " + " ".join(f"b{x}" for x in rng.integers(0, 300, 30))) for k in range(100)]
    rows += [(3, "short text"), (3, None), (99, rows[0][1]), (99, rows[0][1])]
    got = substring.remove_repeats(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, places int"), digest=True).collect()
    want = brute_kept({(d, t or "") for d, t in rows}, 50, by_text=True)
    assert sorted(tuple(r) for r in got) == sorted((d, *want[d, t or ""]) for d, t in rows)


def test_range_minimum():
    rng = np.random.default_rng(3)
    for n in (1, 31, 32, 33, 5000):
        values = rng.integers(0, 1000, n).astype(np.int32)
        low = rng.integers(0, n, 300)
        high = np.minimum(n, low + 1 + rng.integers(0, n, 300))
        assert fm_index.RangeMinimum(values)(low, high).tolist() == [values[a:b].min() for a, b in zip(low, high, strict=True)]
    for bits in (np.zeros(300, np.uint8), np.ones(300, np.uint8), rng.integers(0, 2, 300).astype(np.uint8), np.repeat([0, 1, 0], 100).astype(np.uint8)):
        assert fm_index.BitVector(bits).rank(np.arange(301)).tolist() == [0, *np.cumsum(bits)]


def test_fm_index():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sequences = [rng.integers(1, 6, rng.integers(1, 40)) for _ in range(20)]
        length, owner = np.array([len(s) for s in sequences]), rng.integers(0, 9, 20)
        at, text = np.concatenate([[0], np.cumsum(length)]), np.concatenate(sequences)
        index = fm_index.FMIndex(np.insert(text, at[1:], 0), at[1:] + np.arange(20), 5, np.repeat(owner, length + 1))
        covered = [np.zeros(n, bool) for n in length]
        for k, a, b in zip(*fm_index.matched_windows(index, text, at[:-1], length, owner, 4), strict=True):
            covered[k][a:b] = True
        seen = {}
        for s, o in zip(sequences, owner, strict=True):
            for i in range(len(s) - 3):
                seen[tuple(s[i : i + 4])] = min(o, seen.get(tuple(s[i : i + 4]), 99))
        for k, s in enumerate(sequences):
            want = np.zeros(len(s), bool)
            for i in range(len(s) - 3):
                want[i : i + 4] |= seen[tuple(s[i : i + 4])] < owner[k]
            assert (want == covered[k]).all()
