"""What is written beside the tables: Markdown artifacts, the notebook, theme maps and settings."""

from __future__ import annotations

import hashlib
import json
import tomllib
from dataclasses import asdict, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as tx
from .store import Files


def artifacts(answers: DataFrame) -> DataFrame:
    """(name, body) of answers (title, created, tags, text, sources): Markdown with a head of YAML, the text, and the sources as a list.

    Names are the titles' slugs; where several share one, the second and later by time of creation and text get -2, -3 and so on.
    """
    slug = F.coalesce(F.nullif(tx.slugify(F.col("title")), F.lit("")), F.lit("untitled"))
    turn = F.row_number().over(W.partitionBy("_slug").orderBy("created", "text"))
    tags = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("tags", F.array().cast("array<string>")), tx.yaml_quote), ", "), F.lit("]"))
    head = F.concat(F.lit("---\ntitle: "), tx.yaml_quote(F.coalesce("title", F.lit(""))), F.lit("\ncreated: "), tx.yaml_quote(F.coalesce(F.col("created").cast("string"), F.lit(""))), F.lit("\ntags: "), tags, F.lit("\n---\n\n"))
    listed = F.array_join(F.transform("sources", lambda s, i: F.concat(F.lit("- ["), (i + 1).cast("string"), F.lit("] "), s)), "\n")
    ending = F.when(F.coalesce(F.size("sources"), F.lit(0)) > 0, F.concat(F.lit("\n\n## Sources\n\n"), listed, F.lit("\n"))).otherwise(F.lit("\n"))
    rows = answers.withColumn("_slug", slug).withColumn("_turn", turn)
    name = F.concat("_slug", F.when(F.col("_turn") > 1, F.concat(F.lit("-"), F.col("_turn").cast("string"))).otherwise(F.lit("")), F.lit(".md"))
    return rows.select(name.alias("name"), F.concat(head, F.coalesce("text", F.lit("")), ending).alias("body"))


def write_artifacts(answers: DataFrame, path: str) -> list[str]:
    """Write each artifact as a file of its own, one at a time; a name that is there already gets the next number."""
    files, written = Files(answers.sparkSession, path), []
    for row in artifacts(answers).sort("name").toLocalIterator():
        stem, n, name = row.name.removesuffix(".md"), 2, row.name
        while not files.create(row.body, name):
            name, n = f"{stem}-{n}.md", n + 1
        written.append(name)
    return written


def write_notebook(spark: SparkSession, path: str, text: str) -> None:
    Files(spark, path).create(text, "notebook.md", overwrite=True)


def read_notebook(spark: SparkSession, path: str) -> str:
    files = Files(spark, path)
    return files.read_text("notebook.md") if "notebook.md" in files.names() else ""


def theme_key(collections: list[str]) -> str:
    """The name of a theme map: a hash of the collections that it covers, in whatever order."""
    return hashlib.sha256("\x00".join(sorted(set(collections))).encode()).hexdigest()[:16]


def write_themes(spark: SparkSession, path: str, collections: list[str], themes: list[dict]) -> None:
    Files(spark, path).create(json.dumps({"collections": sorted(set(collections)), "themes": themes}, ensure_ascii=False), "themes", f"{theme_key(collections)}.json", overwrite=True)


def read_themes(spark: SparkSession, path: str, collections: list[str]) -> list[dict] | None:
    """None without a map of just these collections."""
    files, name = Files(spark, path), f"{theme_key(collections)}.json"
    return json.loads(files.read_text("themes", name))["themes"] if name in files.names("themes") else None


def write_settings(spark: SparkSession, path: str, settings: Settings) -> None:
    Files(spark, path).create("".join(f"{k} = {json.dumps(v)}\n" for k, v in asdict(settings).items()), "settings.toml", overwrite=True)


def read_settings(spark: SparkSession, path: str) -> Settings:
    """What the file says, the usual values for all else; unknown names are passed over."""
    files = Files(spark, path)
    said = tomllib.loads(files.read_text("settings.toml")) if "settings.toml" in files.names() else {}
    return Settings(**{f.name: said[f.name] for f in fields(Settings) if f.name in said})
