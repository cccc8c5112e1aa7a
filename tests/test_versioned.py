"""Tables that change by versions: what stays, what a replay and a loss change, and files by their hashes."""

import gzip
import hashlib
import os
from random import Random

import pytest
from folioscope.operators import digests, history, search, tables
from folioscope.operators.versioned import Conflict, Versioned
from folioscope.streaming import refresh
from pyspark.sql import functions as F


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{root}/data") for f in names if f.startswith("part-")}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upsert_touches_only_buckets_that_change(spark, tmp_path):
    store = Versioned(spark, f"file://{tmp_path}/t", buckets=8)
    schema = "id long, chain string, v string"
    first = spark.createDataFrame([(n, None if n % 3 else "a", f"v{n}") for n in range(40)] + [(None, None, "none")], schema)
    keys = ["id", "coalesce(chain, '')"]
    assert tuple(store.upsert("t", first, keys).first()) == (41, 0, 0, 0) and store.version() == 1
    before = {r["bucket"]: r["place"] for r in store._listed(None)}
    change = spark.createDataFrame([(3, "a", "new", False), (5, "", "empty is null", False), (7, None, "v7", False), (9, "a", None, True), (99, None, "x", True), (None, None, "none", None)], f"{schema}, gone boolean")
    assert tuple(store.upsert("t", change, keys, deleted="gone").first()) == (0, 2, 1, 3)
    after = {r["bucket"]: r["place"] for r in store._listed(None)}
    touched = {b for b in before if before[b] != after.get(b)}
    assert 0 < len(touched) <= 3 and store.version() == 2
    want = {n: ("new" if n == 3 else "empty is null" if n == 5 else f"v{n}") for n in range(40) if n != 9} | {None: "none"}
    assert {r.id: r.v for r in store.read("t", first.schema).collect()} == want
    assert {r.id for r in store.read("t", first.schema, version=1).collect()} == set(range(40)) | {None}
    assert tuple(store.upsert("t", change, keys, deleted="gone").first()) == (0, 0, 0, 6) and store.version() == 2
    assert tuple(store.upsert("t", change.limit(0), keys, deleted="gone").first()) == (0, 0, 0, 0)
    twice = spark.createDataFrame([(1, None, "older", 1), (1, None, "aaa newest", 2)], f"{schema}, at int")
    store.upsert("t", twice, keys, order="at")
    assert [r.v for r in store.read("t", first.schema).where("id = 1").collect()] == ["aaa newest"]


def test_a_loss_before_the_switch_changes_nothing(spark, tmp_path, monkeypatch):
    store = Versioned(spark, f"file://{tmp_path}/t", buckets=4)
    rows = spark.createDataFrame([(n, f"v{n}") for n in range(10)], "id long, v string")
    store.upsert("t", rows, ["id"], source="s", batch=0)
    had, written = rows_of(store.read("t", rows.schema)), files(f"{tmp_path}/t")
    publish = Versioned._publish
    monkeypatch.setattr(Versioned, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.upsert("t", rows.withColumn("v", F.lit("x")), ["id"], source="s", batch=1)
    assert rows_of(store.read("t", rows.schema)) == had and store.version() == 1 and files(f"{tmp_path}/t") > written and store.taken("s") == 0
    monkeypatch.setattr(Versioned, "_publish", publish)
    store.upsert("t", rows.withColumn("v", F.lit("x")), ["id"], source="s", batch=1)
    assert {r.v for r in store.read("t", rows.schema).collect()} == {"x"} and store.taken("s") == 1
    with pytest.raises(Conflict):
        store._publish(2, [("batch", "s", -1, None, 5)])


def brute_index(texts):
    import re

    out = []
    for doc, text in texts.items():
        words = [w for w in re.split(r"[^a-z0-9\x80-\U0010ffff]+", text.lower()) if len(w) >= 2]
        out += [(w, "content", doc, words.count(w), len(words)) for w in set(words)]
    return sorted(out)


def test_refresh_by_batches(spark, tmp_path, monkeypatch):
    store = Versioned(spark, f"file://{tmp_path}/c", buckets=4)
    row = lambda i, text, seq, removed=False: (i, "T", None, None, text, "p", seq, removed)
    batch = lambda *rows: spark.createDataFrame(list(rows), refresh.SECTIONS)
    index = lambda: sorted(tuple(r) for r in store.read("postings", spark.createDataFrame([], refresh.POSTINGS).schema).select("term", "field", "doc_id", "tf", "len").collect())
    refresh.refresh_batch(store, batch(row("a", "one two two", 1), row("b", "three", 1), row("c", "four", 1)), 0, ["content"])
    assert index() == brute_index({"a": "one two two", "b": "three", "c": "four"})
    second = batch(row("a", "one five", 2), row("a", "stale", 1), row("b", None, 3, True), row("d", "six six", 1), row("c", "four", 2))
    publish = Versioned._publish
    monkeypatch.setattr(Versioned, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        refresh.refresh_batch(store, second, 1, ["content"])
    monkeypatch.setattr(Versioned, "_publish", publish)
    assert index() == brute_index({"a": "one two two", "b": "three", "c": "four"})
    for _ in range(2):  # the lost batch comes again, and again
        refresh.refresh_batch(store, second, 1, ["content"])
        assert index() == brute_index({"a": "one five", "c": "four", "d": "six six"}) and store.version() == 2
    refresh.refresh_batch(store, batch(row("b", "back too late", 2), row(None, "nobody", 9)), 2, ["content"])
    assert index() == brute_index({"a": "one five", "c": "four", "d": "six six"})


def test_history_in_runs(spark, tmp_path):
    store = Versioned(spark, f"file://{tmp_path}/h", buckets=2)
    events = [(f"d{n % 4}", f"h{n // 2}", n // 2, "added" if n % 3 else "modified", n) for n in range(30)]
    df = spark.createDataFrame(events + events[:7], "doc_id string, commit_hash string, commit_seq int, change_type string, x int")
    for upto in (4, 9, 9, 15):
        history.resume(store, df.where(f"commit_seq <= {upto}"))
    want = {(d, h, c) for d, h, _, c, _ in events}
    got = [(r.doc_id, r.commit_hash, r.change_type) for r in store.read("entries", df.schema).collect()]
    assert len(got) == len(want) and set(got) == want and store.version() == 3
    counts = {r.change_type: r.n for r in store.read("counts", df.groupBy("change_type").agg(F.count("*").alias("n")).schema).collect()}
    assert counts == {k: sum(c == k for _, _, c in want) for k in ("added", "modified")}
    assert history.resume(store, df.limit(0)) == 14


def test_files_by_their_hashes(spark, tmp_path):
    contents = {f"f{n}.bin": bytes([n]) * (n * 1000 + 1) for n in range(6)}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    manifest = tables.file_manifest(spark, {"t": str(tmp_path)})
    assert {(r.file, r.bytes, r.sha256) for r in manifest.collect()} == {(n, len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items()}
    level = [hashlib.sha256(contents[n]).hexdigest() for n in sorted(contents)]
    while len(level) > 1:
        level = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(level[::2], level[1::2], strict=False)] + ([level[-1]] if len(level) % 2 else [])
    assert [tuple(r) for r in tables.merkle_roots(manifest).collect()] == [("t", 6, sum(map(len, contents.values())), level[0])]
    pinned = manifest.where("file <> 'f1.bin'").withColumn("sha256", F.when(F.col("file") == "f2.bin", "x").otherwise(F.col("sha256")))
    assert rows_of(tables.changed_files(manifest.where("file <> 'f5.bin'"), pinned)) == [("t", "f1.bin", "new"), ("t", "f2.bin", "changed"), ("t", "f5.bin", "missing")]


def test_large_files_are_hashed_by_blocks(spark, tmp_path, monkeypatch):
    data, mark = Random(3).randbytes(40_001), b"\xef\xbb\xbf"
    contents = {"a.bin": data, "b.bin": data + b"\n", "c.bin": mark + data, "d.bin": mark + data + b"\n\n", "e.bin": b"\n" * 9001, "f.bin": bytes(20_000), "g [x]*{y} 100%41.bin": b"\r\n" * 4000 + b"\r"}
    contents |= {"h.bin": data.replace(b"\n", b"") + b"\n", "i.bin": b"\n" + mark + data, "k.bin": data * 3, "l.bin": data[:1000], "m.bin": data[:1001]}
    (tmp_path / "t").mkdir()
    for name, content in contents.items():
        (tmp_path / "t" / name).write_bytes(content)
    (tmp_path / "z.gz").write_bytes(gzip.compress(data[:2000]))
    monkeypatch.setattr(tables, "WHOLE", 1000, raising=False)
    # what holds for files of 2 GB: the reader of whole files takes none of over 4,096 bytes
    conf = {"spark.sql.sources.binaryFile.maxLength": "4096", "spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted(tuple(r) for r in tables.file_manifest(spark, {"t": str(tmp_path / "t"), "z": str(tmp_path / "z.gz")}).collect())
        spark.conf.set("spark.sql.files.maxPartitionNum", "3")  # several blocks are one part
        again = sorted(tuple(r) for r in tables.file_manifest(spark, {"k": str(tmp_path / "t" / "k.bin")}).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.files.maxPartitionNum")
    want = sorted(("t", n, len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items())
    packed = (tmp_path / "z.gz").read_bytes()
    assert got == [*want, ("z", "z.gz", len(packed), hashlib.sha256(packed).hexdigest())]
    assert again == [("k", *next(w for w in want if w[1] == "k.bin")[1:])]


def test_no_task_reads_more_than_a_block(spark, tmp_path):
    content = Random(4).randbytes(50_000)
    (tmp_path / "a.bin").write_bytes(content)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = digests._lines(spark, f"file:{tmp_path}/a.bin")
        sizes = lines.rdd.glom().map(lambda rows: sum(len(r["value"]) + 1 for r in rows)).collect()
        longest = max(map(len, content.split(b"\n"))) + 1
        assert len(sizes) == 13 and max(sizes) <= 4096 + longest
        assert digests.chained(spark, {f"file:{tmp_path}/a.bin": len(content)}).popitem()[1] == hashlib.sha256(content).hexdigest()
        with pytest.raises(ValueError, match="50000 of 49000 bytes"):
            digests.chained(spark, {f"file:{tmp_path}/a.bin": len(content) - 1000})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_given_tables_are_hashed_whole(spark, sf_dir):
    roots = {r.name: r for r in __import__("folioscope.catalog", fromlist=["x"]).queries()["s14_files"](spark, sf_dir).collect()}
    data = open(f"{sf_dir}/orders.parquet", "rb").read()
    assert roots["orders"].root == hashlib.sha256(data).hexdigest() and roots["orders"].bytes == len(data) and len(roots) == 14


def test_hunks_between_lines_held_fast(spark):
    old = "\n".join(["a", "b", "c", "same", "same", "d", "e", "f", "g", "h"])
    new = "\n".join(["a", "B", "c", "same", "same", "same", "d", "f", "e", "g", "h", "i"])
    frame = lambda *rows: spark.createDataFrame(list(rows), "id string, title string, content string")
    got = history.placed_hunks(frame(("x", "t", old), ("y", "t", "same"), ("z", "t", None)), frame(("x", "t", new), ("y", "u", "same"), ("z", "t", "now\nhere"))).collect()
    told = {(r.id, r.hunk): (r.old_at, r.new_at, r.before, r.removed, r.added, r.after) for r in got}
    assert told["x", 0] == (1, 1, ["a"], ["b"], ["B"], ["c", "same"])
    assert told["x", 1] == (5, 5, ["same", "same"], [], ["same"], ["d", "e"])
    moved = [told["x", k] for k in (2, 3)]
    assert sum((m[3] for m in moved), []) == sum((m[4] for m in moved), []) and len(sum((m[3] for m in moved), [])) == 1  # e or f is moved past the other
    assert told["x", 4] == (10, 11, ["g", "h"], [], ["i"], []) and told["z", 0] == (0, 0, [], [""], ["now", "here"], []) and len(told) == 6
    many = history.shown_hunks(history.placed_hunks(frame(("m", "t", "a")), frame(("m", "t", "a" + "\nn" * 50)))).first()
    assert len(many.added) == 20 and many.more_added == 30
    assert history.placed_hunks(spark.createDataFrame([], "id string, title string, content string"), frame(("x", "t", "a"))).count() == 0


def test_rising_runs():
    from itertools import combinations
    from random import Random

    rng = Random(1)
    for _ in range(50):
        values = rng.sample(range(20), rng.randint(0, 8))
        kept = [v for v, k in zip(values, history._longest_rise(values), strict=True) if k]
        best = max((len(c) for n in range(len(values) + 1) for c in combinations(values, n) if list(c) == sorted(c)), default=0)
        assert kept == sorted(kept) and len(kept) == best


def test_kinds_of_changes(spark):
    frame = lambda rows: spark.createDataFrame([(k, "t" if c is not True else "u", o if isinstance(o, str) else "") for k, o, c in rows], "id string, title string, content string")
    texts = {"lint": ("a b c", "a  b c"), "typo": ("one of two", "one in two"), "semantic": ("one of two", "one for two"), "long": ("a", "a\nbbb")}
    old, new = ([(k, t[n], None) for k, t in texts.items()] + [("title", "x", True if n else None), ("same", "x", None)] for n in (0, 1))
    got = {r.id: r.kind for r in history.change_kinds(frame(old), frame(new)).collect()}
    assert got == {"lint": "lint", "typo": "typo", "semantic": "semantic", "long": "semantic", "title": None}


def test_search_index_is_the_same_by_terms_that_begin_others(spark):
    docs = spark.createDataFrame([(f"d{n}", f"them theme the other{n}", "x" * (n + 2)) for n in range(5)], "id string, title string, content string")
    asked = spark.createDataFrame([("q", "the them oth"), ("r", "them")], "query_id string, q string")
    got = {(r.query_id, r.doc_id): r.score for r in search.lexical(search.postings(docs, ["title", "content"]), search.query_terms(asked), prefix=True).collect()}
    free = {tuple(r) for r in search.prefix_free(search.query_terms(asked)).collect()}
    assert free == {("q", "the"), ("q", "oth"), ("r", "them")} and len(got) == 10 and all(got["q", f"d{n}"] > got["r", f"d{n}"] for n in range(5))


def test_changed_tokens_are_those_of_multisets(spark):
    from collections import Counter
    from random import Random

    rng = Random(5)
    text = lambda: " ".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))
    old = [(f"d{n}", text()) for n in range(60)] + [("null", None), ("both", None), ("gone", "x")]
    new = [(f"d{n}", text()) for n in range(60)] + [("null", "a a"), ("both", None), ("fresh", "x")]
    old += [("same", "k " * 50), ("ends", "p q r s q"), ("moved", "one two")]
    new += [("same", "k " * 50), ("ends", "p q q s q"), ("moved", "two one")]
    frame = lambda rows: spark.createDataFrame(rows, "id string, content string")
    split = lambda t: Counter([] if t is None else t.split(" "))
    a, b = dict(old), dict(new)
    want = Counter()
    for i in a.keys() & b.keys():
        for t, n in ((split(a[i]) - split(b[i])) + (split(b[i]) - split(a[i]))).items():
            want[i, t] = n
    found = history.token_changes(frame(old), frame(new))
    assert Counter((r.id, r.token) for r in found.collect()) == want and want["ends", "r"] == want["ends", "q"] == 1
    # long texts that differ in one word
    pairs = frame([(f"w{n}", f"{'same words ' * 200}{n} end") for n in range(40)]), frame([(f"w{n}", f"{'same words ' * 200}x end") for n in range(40)])
    df = history.token_changes(*pairs)
    assert df.count() == 80


def test_a_bucket_is_dealt_over_several_tasks(spark, tmp_path):
    store = Versioned(spark, f"file://{tmp_path}/t", buckets=1)
    rows = spark.createDataFrame([(n, f"v{n}" * 50) for n in range(400)], "id long, v string")
    had = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.upsert("t", rows, ["id"])
        store.upsert("t", rows.withColumn("v", F.when(F.col("id") == 7, "new").otherwise(F.col("v"))), ["id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", had)
    place = store._listed(None)[0]["place"]
    assert len([f for f in os.listdir(f"{tmp_path}/t/{place}") if f.startswith("part-")]) > 1
    assert {r.id: r.v for r in store.read("t", rows.schema).collect()} == {n: "new" if n == 7 else f"v{n}" * 50 for n in range(400)}


def test_changes_laid_beside_a_bucket_write_themselves_alone(spark, tmp_path):
    store = Versioned(spark, f"{tmp_path}/store", buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), "id string, n long")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k0 string")
    have = lambda version=None: {r.id: r.n for r in store.read("t", rows(("", 0)).schema, version).collect()}
    want = {f"k{n}": n for n in range(200)}
    store.replace({"t": (rows(*want.items()), keys(*want), ["id"])}, beside=True)
    first = {r["place"] for r in store._listed(None) if r["kind"] == "bucket"}
    seen = {1: dict(want)}
    for n in range(1, 8):
        old, new, gone = f"k{n}", f"new{n}", f"k{100 + n}"
        store.replace({"t": (rows((old, -n), (new, n), ("k0", n)), keys(old, new, gone, "k0", None), ["id"])}, beside=True)
        want |= {old: -n, new: n, "k0": n}
        want.pop(gone)
        seen[n + 1] = dict(want)
        assert have() == want
        if n == 1:  # the folders of rows that stay are named again, and only three rows are beside them
            places = {r["place"] for r in store._listed(None) if r["kind"] == "bucket"}
            assert first < places and sum(spark.read.parquet(f"{store.root}/{p}").count() for p in places - first) == 3
    assert all(have(v) == rows_then for v, rows_then in seen.items())
    assert max(sum(r["kind"] == "gone" and r["bucket"] == b for r in store._listed(None)) for b in range(4)) <= 4
    # without it a touched bucket is one folder again
    store.replace({"t": (rows(("k0", 99)), keys("k0", *[f"k{n}" for n in range(200)]), ["id"])})
    assert have() == {"k0": 99, **{f"new{n}": n for n in range(1, 8)}} and not [r for r in store._listed(None) if r["kind"] == "gone"]
