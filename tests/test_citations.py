"""The citation metric over files that are read anew, and maintenance of a store against its files."""

from pyspark.sql import functions as F

from shelfspark.operators import citations, maintenance
from shelfspark.plans.file_queries import pdf
from shelfspark.sources.readers import discover


def passage(seed):
    return " ".join(f"{a}{seed}x{b}" for b in range(30) for a in ("alpha", "beta", "gamma"))


def test_metric(spark, tmp_path):
    one, two, three = passage("p"), passage("q"), passage("r")
    (tmp_path / "a.pdf").write_bytes(pdf("", one.ljust(2000) + two.ljust(2000) + three.ljust(2000)))
    (tmp_path / "b.fb2").write_text(f"<FictionBook><body><section><title><p>Chapter One</p></title><p>{one}</p></section><section><title><p>Chapter Two</p></title><p>{two}</p></section></body></FictionBook>")
    (tmp_path / "c.md").write_text(f"# Head\n\n{one}\n")
    (tmp_path / "bad.pdf").write_bytes(b"%PDF")
    p = f"file:{tmp_path}"
    rows = [
        ("1", "a", "T", f"{p}/a.pdf", None, 1, one), ("2", "a", "T", f"{p}/a.pdf", None, 1, two), ("3", "a", "T", f"{p}/a.pdf", None, 1, three), ("4", "a", "T", f"{p}/a.pdf", None, 2, passage("none")), ("5", "a", "T", f"{p}/a.pdf", None, None, one),
        ("6", "b", "T", f"{p}/b.fb2", "CHAPTER ONE", None, one), ("7", "b", "T", f"{p}/b.fb2", "Chapter One", None, two), ("8", "b", "T", f"{p}/b.fb2", "Unheard of", None, two), ("9", "b", "T", f"{p}/b.fb2", None, None, two), ("10", "b", "T", f"{p}/b.fb2", "Chapter Two", None, passage("none")),
        ("11", "c", "Т", f"{p}/c.md", None, None, one), ("12", "c", "Т", f"{p}/c.md", None, None, passage("none")), ("13", "d", "T", f"{p}/gone.md", None, None, one), ("14", "e", "T", f"{p}/bad.pdf", None, 1, one), ("15", "f", "T", f"{p}/x.mobi", None, None, one), ("16", "g", "T", f"{p}/x.html", None, None, one),
    ]
    view = spark.createDataFrame(rows, "id string, book_id string, title string, source_path string, chapter string, page long, text string")
    sampled = citations.sample(view, 10, 10)
    assert sampled.count() == len(rows)
    found = {r.id: r.outcome for r in citations.outcomes(sampled, discover(spark, str(tmp_path))).collect()}
    assert found == {
        "1": "direct", "2": "near", "3": "located", "4": "miss in chapter", "5": "chapterless located", "6": "direct", "7": "located", "8": "located", "9": "chapterless located", "10": "miss in chapter",
        "11": "chapterless located", "12": "chapterless miss", "13": "extract error", "14": "extract error", "15": "unverifiable", "16": "unverified family",
    }
    few = citations.sample(view, 1, 2).groupBy("family", "script").agg(F.countDistinct("book_id").alias("b"), F.max("book_id").alias("x"), F.count("*").alias("n")).collect()
    assert all(r.b == 1 and r.n <= 2 for r in few) and {(r.family, r.script) for r in few} >= {("pdf", "en"), ("text", "ru"), ("text", "en")}
    tally = citations.tally(citations.outcomes(sampled, discover(spark, str(tmp_path)))).collect()
    assert all(abs(sum(r.percent for r in tally if (r.family, r.script) == k) - 100) < 1 for k in {(r.family, r.script) for r in tally})


def test_maintenance(spark):
    rows = [("a", "/lib/a.pdf", "pdf"), ("b", "/lib/b.pdf", "epub"), ("c", "/lib/gone.md", "md"), ("d", "/far/away.md", "md"), ("e1", "/lib/e.epub", "epub"), ("e2", "/lib/e.epub", "epub"), ("v", "/lib/w.docx", "docx"), ("w", "/lib/w.epub", "epub")]
    store = spark.createDataFrame(rows, "book_id string, source_path string, format string")
    manifest = spark.createDataFrame([("a", "/lib/a.pdf"), ("lost", "/lib/lost.md"), ("e2", "/lib/e.epub"), ("far", "/far/x.md")], "book_id string, source_path string")
    disk = spark.createDataFrame([(p,) for _, p, _ in rows if "gone" not in p and "/far" not in p], "source_path string")
    found = maintenance.scan(store, manifest, disk, ["/far"]).cache()
    assert sorted((r.kind, r.book_id, r.detail) for r in found.collect()) == [("ids", "e1", "e2"), ("orphan", "c", None), ("stamp", "b", "pdf"), ("state", "lost", None), ("variant", "v", None)]
    left = {(r.book_id, r.format) for r in maintenance.mended(store, found).collect()}
    assert left == {("a", "pdf"), ("b", "pdf"), ("d", "md"), ("e2", "epub"), ("v", "docx"), ("w", "epub")}
    assert {r.root: r.affected for r in maintenance.affected(store, ["/far", "/none"]).collect()} == {"/far": 1, "/none": 0}
