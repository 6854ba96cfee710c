import time

import pytest

from shelfspark.sources.store import Store
from shelfspark.streaming import ingest, think


@pytest.mark.parametrize("text", ["a<think>b</think>c", "<think>x", "no <thin", "<<think>y</think></think>", "", "a<think></think>b<think>c</think>"])
@pytest.mark.parametrize("step", [1, 2, 3, 100])
def test_pieces_give_what_the_whole_gives(text, step):
    inside, held, said, thought = False, "", "", ""
    for i in range(0, len(text), step):
        inside, held, a, b = think.feed(inside, held, text[i : i + step])
        said, thought = said + a, thought + b
    said, thought = (said, thought + held) if inside else (said + held, thought)
    rest, a, b = text, "", ""
    while rest:
        x, _, rest = rest.partition("<think>")
        y, _, rest = rest.partition("</think>")
        a, b = a + x, b + y
    assert (said, thought) == (a, b)


def test_split_stream(spark, tmp_path):
    rows = [(1, 0, "a<th", False), (1, 1, "ink>b</thi", False), (1, 2, "nk>c<", True), (2, 0, "plain", True)]
    spark.createDataFrame(rows, "message long, seq int, piece string, last boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("message long, seq int, piece string, last boolean").parquet(str(tmp_path / "in"))
    q = think.split_stream(stream).writeStream.format("memory").queryName("split").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(x) for x in spark.table("split").collect()} == {(1, "ac<", "b", "done"), (2, "plain", "", "done")}


def test_a_message_without_a_last_piece_is_given_up(spark, tmp_path):
    schema = "message long, seq int, piece string, last boolean"
    spark.createDataFrame([(1, 0, "a<th", False)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = think.split_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 1500).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        until = time.monotonic() + 60
        while time.monotonic() < until and {x.ended for x in spark.table("idle").collect()} != {"open", "idle"}:
            time.sleep(0.5)
        assert {tuple(x) for x in spark.table("idle").collect()} == {(1, "a", "", "open"), (1, "<th", "", "idle")}
    finally:
        q.stop()


def test_ingest_takes_only_what_is_new(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.md").write_text("# A\n" + "word " * 200)
    (src / "bad.docx").write_bytes(b"x")
    store = Store(spark, str(tmp_path / "store"))
    ingest.ingest(spark, str(src), store, str(tmp_path / "work")).awaitTermination(120)
    first = store.count()
    assert first > 0
    (src / "b.txt").write_text("other " * 200)
    ingest.ingest(spark, str(src), store, str(tmp_path / "work")).awaitTermination(120)
    assert store.count() > first and {x.format for x in store.meta().collect()} == {"md", "txt"}
    out = spark.read.parquet(str(tmp_path / "work" / "outcomes")).collect()
    assert sorted((x.path.rpartition("/")[2], x.outcome) for x in out) == [("a.md", "indexed"), ("b.txt", "indexed"), ("bad.docx", "skipped")]


def test_windows_of_a_stream(spark, tmp_path):
    rows = [(f"2024-01-01 0{i // 6}:{i % 6}0:00", "a", i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "ts string, event_type string, user_id int").selectExpr("cast(ts as timestamp) ts", "event_type", "user_id")
    df.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    q = ingest.tumbling(stream).writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(x.n for x in spark.table("tumbling").collect()) == [6, 6, 6, 6, 6]
