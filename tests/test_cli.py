from shelfspark import cli
from shelfspark.config import Settings


def test_ingest_and_search(spark, tmp_path, capsys):
    src = tmp_path / "books"
    src.mkdir()
    (src / "sagas.md").write_text("# Sagas\n" + "a saga coordinates long transactions with compensation steps. " * 20)
    (src / "money.txt").write_text("index funds and investment horizons for patient engineers. " * 20)
    store = str(tmp_path / "store")
    cli.main(["--store", store, "ingest", str(src)])
    cli.main(["--store", store, "search", "investmenet for engineers"])
    cli.main(["--store", store, "titles"])
    cli.main(["--store", store, "ask", "What does a saga coordinate?"])
    cli.main(["--store", store, "plan-soak", str(src)])
    cli.main(["--store", store, "cite-metric", str(src)])
    (src / "money.txt").unlink()
    cli.main(["--store", store, "audit", str(src)])
    cli.main(["--store", store, "apply", str(src)])
    cli.main(["--store", store, "backfill-state", str(src)])
    cli.main(["--store", store, "events"])
    said = capsys.readouterr().out
    assert "compensation steps. [1]" in said and "stable" in said and "unchanged" in said and "chapterless located" in said and "orphan" in said and "1 findings put right" in said
    assert "passages" in said and "money" in said
    hits = cli.search(cli.Store(spark, store), "saga pattern xyz").collect()
    assert hits and hits[0].title == "sagas" and hits[0].chapter == "Sagas"
    assert {x.title for x in cli.Store(spark, store).meta().collect()} == {"sagas"}
    assert Settings().prompt_budget == 12902
