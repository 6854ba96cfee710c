"""Snapshots, filters, compaction, and the full-text index that follows the passages."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import retrieval as r
from shelfspark.sources import store as st
from shelfspark.sources.postings import Postings
from shelfspark.sources.store import Folder, Stale, Store, Table, packed


def passages(spark, rows):
    """Rows (id, path, text) as passages."""
    full = [(i, f"book of {p}", "t", "", p, "txt", "", -1, 0, 0, t, None) for i, p, t in rows]
    return spark.createDataFrame(full, st.SCHEMA.replace("vector array<float>", "vector array<float>"))


def test_packing():
    f = [Folder(str(i), size) for i, size in enumerate([5, 90, 40, 60, 120, 1])]
    bins = packed(f, 100)
    assert sorted(x.name for b in bins for x in b) == list("012345") and [x.name for x in bins[0]] == ["4"]
    assert all(len(b) == 1 or sum(x.size for x in b) <= 100 for b in bins) and len(bins) == 3


def test_filters_name_the_buckets(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "k string, v string", "k", 16, ("v",))
    make = lambda rows: spark.createDataFrame(rows, "k string, v string")
    t.append(make([(f"k{i}", f"v{i % 40}") for i in range(200)]))
    t.append(make([("late", "rare"), ("none", None)]))
    keys = lambda *v: spark.createDataFrame([(x,) for x in v], "v string")
    for v in ("v3", "rare", None):
        held = {r[0] for r in t.read().where(F.col("v").eqNullSafe(v)).select(t.bucket()).distinct().collect()}
        assert held <= set(t.may_hold("v", keys(v)))
    assert len(t.may_hold("v", keys("rare"))) <= 2 and t.may_hold("v", keys()) == []
    assert sorted(t.buckets_of(keys("k1", "k2"))) == sorted({r[0] for r in t.read().where("k IN ('k1', 'k2')").select(t.bucket()).collect()})
    assert t.touched(make([("x", "rare")]).select("v"), ["v"]) == t.buckets_of(spark.createDataFrame([("late",)], "k string"))


def test_two_writers(spark, tmp_path):
    one, two = (Table(spark, str(tmp_path / "t"), "k long, v long", "k", 4) for _ in range(2))
    rows = lambda *v: spark.createDataFrame([(x, x) for x in v], "k long, v long")
    one.append(rows(*range(40)))
    # appends of both stay; a change of buckets that the other has changed is refused, and nothing is lost
    put = two._put

    def slow(df):
        fresh = put(df)
        if not slow.done:
            slow.done = True
            one.append(rows(*range(40, 60)))
        return fresh

    slow.done, two._put = False, slow
    two.append(rows(*range(60, 80)))
    assert sorted(x.k for x in one.read().collect()) == list(range(80))
    slow.done = False
    with pytest.raises(Stale):
        two.write(rows(1))
    assert one.count() == 100
    slow.done = False
    for i in range(6):
        one.append(rows(200 + i))
    with_folders = sum(map(len, one.folders().values()))
    gone = two.compact(2)  # an append falls between; it stays
    assert gone > 0 and sum(map(len, one.folders().values())) < with_folders + 4 and one.count() == 126


def test_folders_stay_few_over_a_hundred_batches(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "k long, v long", "k", 2, ("v",))
    for i in range(100):
        t.append(spark.createDataFrame([(i, i), (i + 1000, i)], "k long, v long").coalesce(1))
        if i % 10 == 9:
            t.tidy()
            assert max(map(len, t.folders().values())) <= st.MOST_FOLDERS and len(t.snapshots()) <= st.KEEP
    assert t.count() == 200 and sorted(x.v for x in t.read().collect()) == sorted([*range(100)] * 2)
    assert len(t.files.names("data")) <= 2 * 10 + 2 * st.MOST_FOLDERS
    assert set(t.may_hold("v", spark.createDataFrame([(7,)], "v long"))) >= {x[0] for x in t.read().where("v = 7").select(t.bucket()).collect()}


def words(rng, n):
    return " ".join(rng.choices([f"word{i}" for i in range(30)] + ["Ärger", "naïve", "x1"], k=n))


def same(store, spark, k=5):
    asked = spark.createDataFrame([(0, "word1 word2 ärger"), (1, "word29 unknown"), (2, "x1"), (3, "")], "qid long, q string")
    terms = r.terms_of(asked)
    key = lambda df: sorted((x.qid, x.id, x.score, x["rank"]) for x in df.collect())
    whole = store.read().select("id", "text")
    assert key(store.index.search(terms, k)) == key(r.bm25(terms, whole, k))
    assert sorted(map(tuple, store.index.vocabulary().collect())) == sorted(map(tuple, r.vocabulary(whole).collect()))
    near = spark.createDataFrame([(0, "wird1 wrod22 x")], "qid long, q string")
    assert sorted(map(tuple, store.index.fuzzy_terms(near).collect())) == sorted(map(tuple, r.fuzzy_terms(near, whole).collect()))


def test_the_index_follows_the_passages(spark, tmp_path):
    rng = random.Random(1)
    store = Store(spark, str(tmp_path / "s"), buckets=4, indexed=True)
    rows = [(f"{p}:{i}", f"/b{p}", words(rng, rng.randint(0, 20))) for p in range(8) for i in range(3)]
    store.append(passages(spark, rows))
    same(store, spark)
    # one book is written anew, another goes, a third moves
    store.replace(passages(spark, [("1:0", "/b1", "word1 word1 ärger"), ("1:9", "/b1", "word29")]))
    same(store, spark)
    n = store.index.postings.count()
    store.change(spark.createDataFrame([("/b2",), ("/b3",)], "source_path string"), ["source_path"], lambda t: t.where("source_path <> '/b2'").withColumn("source_path", F.regexp_replace("source_path", "b3", "moved")))
    same(store, spark)
    assert store.index.postings.count() == n and store.index.dead.count() >= 6  # nothing was indexed again
    assert {x.source_path for x in store.index.passages.read().where("id LIKE '3:%'").collect()} == {"/moved"}
    store.tidy()
    same(store, spark)
    for p in range(4, 8):
        store.replace(passages(spark, [(f"{p}:n", f"/b{p}", words(rng, 9))]))
    store.tidy()
    same(store, spark)
    assert store.index.dead.count() == 0  # the dead were many, so the postings were written anew


@pytest.mark.parametrize("table", ["postings", "passages"])
def test_a_failed_change_is_put_right(spark, tmp_path, table):
    store = Store(spark, str(tmp_path / "s"), buckets=2, indexed=True)
    old = [("a", "/a", "word1 word2"), ("b", "/b", "word2")]
    store.append(passages(spark, old))
    broken, name = getattr(store.index, table), "append" if table == "postings" else "put_buckets"
    whole = getattr(broken, name)
    setattr(broken, name, lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.replace(passages(spark, [("a", "/a", "word3 ärger")]))
    setattr(broken, name, whole)
    store.reindex()
    same(store, spark)
    # and if the text of before comes back first
    setattr(broken, name, lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.replace(passages(spark, old[:1]))
    setattr(broken, name, whole)
    store.replace(passages(spark, [("a", "/a", "word3 ärger")]))
    same(store, spark)


def test_a_search_reads_no_text(spark, tmp_path, capsys):
    store = Store(spark, str(tmp_path / "s"), buckets=8, indexed=True)
    store.append(passages(spark, [(f"{i}", f"/{i}", f"word{i} word{i % 7}") for i in range(40)]))
    found = store.index.search(spark.createDataFrame([(0, "word3")], "qid long, term string"), 5)
    assert found.count() == 5
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema" in plan and "text:string" not in plan and isinstance(store.index, Postings)
    paths = {p for p in found.inputFiles() if "/terms/" in p}
    assert len({p.split("bucket=")[1].split("/")[0] for p in paths}) == 1 < len(store.index.postings.folders())


def test_a_batch_reads_few_folders(spark, tmp_path, monkeypatch):
    from shelfspark.operators import planner
    from shelfspark.sources.manifest import FILTERS, TABLES

    def table(name, schema, by, filters, rows):
        t = Table(spark, str(tmp_path / name), schema, by, 64, filters)
        t.write(spark.createDataFrame(rows, schema))
        return t

    n = 600
    states = table("state", TABLES["book_state"][0], "book_id", FILTERS["book_state"], [("c", f"b{i}", f"fp{i}", f"sig{i}", 1, f"/p{i}" if i % 3 else "") for i in range(n)])
    skips = table("skips", TABLES["skip_state"][0], "source_path", (), [("c", f"/s{i}", "cpu", f"f{i}", "no text", "v1") for i in range(n)])
    books = table("books", "book_id string, source_path string", "source_path", ("book_id",), [(f"b{i}", f"/p{i}") for i in range(n)])
    # unchanged, moved, known content, silenced, new
    rows = [(1, "/p1", "b1", "fp1", "sig1"), (2, "/new", "b1x", "fp2", "sig2"), (3, "/other", "b3x", "fpx", "sig3"), (4, "/s7", "b4x", "f7", "sigy"), (5, "/fresh", "b5x", "fpz", "sigz")]
    found = spark.createDataFrame(rows, "pos long, path string, book_id string, fp string, csig string")
    read: dict[str, int] = {}
    load = Table._load
    monkeypatch.setattr(Table, "_load", lambda self, folders: read.update({self.path: len(folders)}) or load(self, folders))
    held = planner.lookups(found, states, skips, books, "c")
    assert all(1 <= k <= 16 for k in read.values()) and len(read) == 3
    monkeypatch.undo()
    plan = lambda *x: sorted(map(tuple, planner.plan(found, *x, "cpu", "v1").collect()))
    mine = plan(*held)
    assert mine == plan(states.read(), skips.read(), books.read()) and {x[3] for x in mine} == {"unchanged", "remap", "silenced", "embed"}
