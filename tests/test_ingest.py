"""Ingest over files: plan, manifest, replays, failures, and the single writer."""

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import formats as fm
from shelfspark.operators import models
from shelfspark.sources.manifest import Busy, Manifest
from shelfspark.sources.store import Store, Table
from shelfspark.streaming import ingest as ing

TEXT = "# One\n" + "words of a book " * 120


class Bad:
    """An embedder that fails for texts with a word, and counts what it embeds in a file."""

    def __init__(self, log, word=None, fatal=False):
        self.log, self.word, self.fatal = log, word, fatal

    def __call__(self):
        plain = models.hashed_words(8)

        def embed(texts):
            if self.word and any(self.word in t for t in texts):
                raise ing.Fatal("no model") if self.fatal else RuntimeError("crashed")
            with open(self.log, "a") as f:
                f.write(f"{len(texts)}\n")
            return plain(texts)

        return embed


def embedded(log):
    return sum(map(int, log.read_text().split())) if log.exists() else 0


def outcomes(spark, work):
    rows = spark.read.parquet(f"{work}/outcomes").collect()
    return {(r.batch, r.path.rpartition("/")[2]): (r.outcome, r.reason) for r in rows}


def test_table_replaces_by_bucket(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "k string, v long", "k", 4)
    make = lambda rows: spark.createDataFrame(rows, "k string, v long")
    assert t.read().collect() == [] and t.folders() == {}
    t.replace(make([(f"k{i}", i) for i in range(20)]), ["k"])
    before = t.folders()
    t.replace(make([("k3", 33), ("k3", 34), (None, 1)]), ["k"])
    assert sorted((r.v for r in t.read().collect())) == sorted([*(i for i in range(20) if i != 3), 33, 34, 1])
    after = t.folders()
    assert sum(after.get(k) == v for k, v in before.items()) >= 2  # the buckets that weren't touched stand as they were
    t.replace(make([(None, 2)]), ["k"])
    assert [r.v for r in t.read().where("k IS NULL").collect()] == [2]
    t.change(make([("k5", 0)]).select("k"), ["k"], lambda x: x.where("k <> 'k5'").withColumn("k", F.when(F.col("v") == 6, "moved").otherwise(F.col("k"))))
    assert {r.v for r in t.read().collect()} >= {33, 34, 7} and 5 not in {r.v for r in t.read().collect()}
    n = t.count()
    t.append(make([("x", 100)]))
    t.write(t.read())
    t.vacuum(1)
    assert t.count() == n + 1 and len(t.snapshots()) == 1 and len(t.files.names("data")) == 1
    with pytest.raises(ValueError):
        t.replace(make([]), ["v"])


def test_second_run_embeds_nothing_and_moves_are_followed(spark, tmp_path):
    src, work, log = tmp_path / "src", str(tmp_path / "work"), tmp_path / "log"
    src.mkdir()
    for i in range(3):
        (src / f"b{i}.md").write_text(TEXT.replace("book", f"book{i}"))
    (src / "copy.md").write_text(TEXT.replace("book", "book0"))
    (src / "bad.docx").write_bytes(b"x")
    store = Store(spark, str(tmp_path / "store"), buckets=8)
    run = lambda: ing.run(spark, str(src), store, work, embedder=Bad(str(log)))
    run()
    first, told = embedded(log), {p: o for (_, p), (o, _) in outcomes(spark, work).items()}
    assert first == store.count() > 0 and sorted(told.values()) == ["duplicate", "indexed", "indexed", "indexed", "skipped"] and told["bad.docx"] == "skipped"
    assert all(len(r.vector) == 8 and r.text for r in store.read().collect())
    m = Manifest(spark, f"{work}/manifest")
    assert m.read("book_state").count() == 3 and [r.reason for r in m.read("skip_state").collect()][0]
    # everything again: nothing is embedded; the copy's content is known, so its passages go by its path
    files = spark.read.format("binaryFile").load(str(src))
    engine = ing.Engine(store, m, embedder=Bad(str(log)))
    again = embedded(log)
    ing.ingest_batch(engine, f"{work}/outcomes", files, 77)
    told = {p: o for (b, p), (o, _) in outcomes(spark, work).items() if b == 77}
    assert embedded(log) == again and set(told.values()) <= {"unchanged", "silenced", "remapped"} and told["bad.docx"] == "silenced"
    # a moved file keeps its passages under its new path
    n = store.count()
    (src / "b1.md").rename(src / "moved.md")
    ing.ingest_batch(engine, f"{work}/outcomes", spark.read.format("binaryFile").load(str(src / "moved.md")), 78)
    assert outcomes(spark, work)[78, "moved.md"][0] == "remapped" and embedded(log) == again and store.count() == n
    assert {r.source_path.rpartition("/")[2] for r in store.read().collect()} >= {"moved.md"} and m.read("book_state").count() == 3
    assert {(r.kind) for r in ing.progress(m.read("events")).collect()} >= {"indexed", "remapped"}


def test_bisect_retries_and_quarantines():
    seen = []

    def work(some, batch):
        seen.append((len(some), batch))
        if any(s["path"] == "bad" for s in some) or any(s["path"] == "large" for s in some) and batch > ing.MICRO_BATCH:
            raise RuntimeError("worker died")
        return {s["path"]: ("indexed", None) for s in some}

    steps = [{"path": p} for p in ("a", "b", "bad", "c", "large", "d", "e")]
    out = ing.bisect(steps, work)
    assert {p: o for p, (o, _) in out.items()} == {p: "quarantined" if p == "bad" else "indexed" for p in ("a", "b", "bad", "c", "large", "d", "e")}
    assert "worker died" in out["bad"][1] and seen.count((1, ing.MICRO_BATCH)) == 2
    assert ing.bisect([], work) == {} and ing.bisect(steps, work, stopping=lambda: True) == {}
    with pytest.raises(ing.Fatal):
        ing.bisect(steps, lambda *_: (_ for _ in ()).throw(ing.Fatal("no model")))


def test_a_book_that_breaks_the_embedder_is_quarantined(spark, tmp_path):
    src, work = tmp_path / "src", str(tmp_path / "work")
    src.mkdir()
    for i in range(3):
        (src / f"b{i}.md").write_text(TEXT.replace("book", "poison" if i == 1 else f"book{i}"))
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    engine = ing.Engine(store, Manifest(spark, f"{work}/manifest"), embedder=Bad(str(tmp_path / "log"), "poison"))
    ing.ingest_batch(engine, f"{work}/outcomes", spark.read.format("binaryFile").load(str(src)), 0)
    told = {p: o for (_, p), (o, _) in outcomes(spark, work).items()}
    assert told == {"b0.md": "indexed", "b1.md": "quarantined", "b2.md": "indexed"}
    skips = engine.manifest.read("skip_state").collect()
    assert len(skips) == 1 and "crashed" in skips[0].reason
    fatal = ing.Engine(Store(spark, str(tmp_path / "other"), buckets=4), Manifest(spark, f"{work}/m2"), embedder=Bad(str(tmp_path / "log"), "poison", True))
    with pytest.raises(Exception, match="Fatal"):
        ing.ingest_batch(fatal, f"{work}/o2", spark.read.format("binaryFile").load(str(src)), 0)
    assert fatal.manifest.read("skip_state").count() == 0


def test_one_writer_and_the_stop_flag(spark, tmp_path):
    m = Manifest(spark, str(tmp_path / "m"))
    m.acquire()
    with pytest.raises(Busy):
        Manifest(spark, str(tmp_path / "m")).acquire()
    m.release()
    m.acquire()
    assert not m.stopping()
    m.ask_to_stop()
    assert m.stopping()
    m.go_on()
    assert not m.stopping()
    # stopped before its first book: no outcome is final, nothing is lost
    (tmp_path / "a.md").write_text(TEXT)
    m.ask_to_stop()
    engine = ing.Engine(Store(spark, str(tmp_path / "s"), buckets=4), m)
    ing.ingest_batch(engine, str(tmp_path / "o"), spark.read.format("binaryFile").load(str(tmp_path / "a.md")), 0)
    assert [r.outcome for r in spark.read.parquet(str(tmp_path / "o")).collect()] == ["stopped"] and m.read("book_state").count() == 0


def test_deleting_a_collection(spark, tmp_path):
    m = Manifest(spark, str(tmp_path / "m"))
    m.upsert("collections", spark.createDataFrame([("a", "A", "x", 1), ("b", "B", "x", 2)], "collection_id string, name string, db_path string, created_at long"))
    m.upsert("conversations", spark.createDataFrame([("1", "t", ["a"], 1), ("2", "t", ["a", "b"], 1), ("3", "t", [], 1)], "conv_id string, title string, collection_ids array<string>, created_at long"))
    m.upsert("messages", spark.createDataFrame([("1", 0, "user", "q", 1), ("2", 0, "user", "q", 1)], "conv_id string, turn long, role string, text string, created_at long"))
    m.upsert("messages", spark.createDataFrame([("2", 0, "user", "newer", 1)], "conv_id string, turn long, role string, text string, created_at long"))
    m.delete_collection("a")
    assert [r.collection_id for r in m.read("collections").collect()] == ["b"]
    assert {r.conv_id: r.collection_ids for r in m.read("conversations").collect()} == {"2": ["b"], "3": []}
    assert [(r.conv_id, r.text) for r in m.read("messages").collect()] == [("2", "newer")]


def test_signatures_and_capped_reads(spark):
    big = bytes(range(256)) * 40
    rows = [(1, b"", 0), (2, b"abc", 3), (3, b"abc", 4), (4, None, 3), (5, big, len(big)), (6, big[:5000] + b"x" + big[5001:], len(big))]
    df = spark.createDataFrame(rows, "i int, content binary, length long")
    got = {r.i: r.s for r in df.select("i", fm.content_signature(F.col("content"), F.col("length"), 1000).alias("s")).collect()}
    assert got[3] == got[4] == "missing" and got[1].startswith("0:") and got[2].startswith("3:") and got[5] == got[6]
    whole = {r.i: r.s for r in df.select("i", fm.content_signature(F.col("content"), F.col("length")).alias("s")).collect()}
    assert whole[5] != whole[6] and whole[5].startswith("2800:")
    text = "aé日😀z"
    df = spark.createDataFrame([(n, text.encode()) for n in range(1, 13)], "n int, content binary")
    for n in range(1, 13):
        r = df.where(F.col("n") == n).select(fm.read_capped(F.col("content"), n).alias("x")).first().x
        assert r.text == text.encode()[:n].decode(errors="ignore") and r.bytes == 11 and r.truncated == (n < 11)
    caps = spark.createDataFrame([(["b", "a", None],), (["a", "b", "b"],), (["ab"],)], "c array<string>").select(fm.caps_version(F.col("c")).alias("v")).collect()
    assert caps[0].v == caps[1].v != caps[2].v


def test_display_paths(spark):
    files = spark.createDataFrame([(p,) for p in ("/a.pages", "/b.pdf", "/c.pdf", "/d.rtf", "/e.md")], "path string")
    copies = spark.createDataFrame([("/a.pages", "pdf", "/x/a.pdf"), ("/b.pdf", "ocr", "/x/b.pdf"), ("/b.pdf", "html", "/no"), ("/e.md", "html", "/no")], "path string, kind string, copy_path string")
    assert {r.path: r.shown for r in fm.display_paths(files, copies).collect()} == {"/a.pages": "/x/a.pdf", "/b.pdf": "/x/b.pdf", "/c.pdf": "/c.pdf", "/d.rtf": "/d.rtf", "/e.md": "/e.md"}
