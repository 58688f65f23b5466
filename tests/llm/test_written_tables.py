"""What operators leave in the shared folder."""

import os
import uuid

import pyarrow.parquet
from pyspark.sql import functions as F

from skyhue.llm import context_mixing
from skyhue.sources import staging


def test_written_tables_of_the_scores_are_small(spark, tmp_path, monkeypatch):
    """Texts are packed, and nodes are gone when their log probabilities are known."""
    monkeypatch.setattr(staging, "folder", lambda _: f"{tmp_path}/{uuid.uuid4().hex}")
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    size = df.agg(F.sum(F.octet_length("text"))).first()[0]
    scores = context_mixing.scored(df, F.col("doc_id") % 7 == 2)
    files = list(tmp_path.glob("*/*.parquet"))
    left = [pyarrow.parquet.ParquetFile(f).schema_arrow.names for f in files]
    assert sum(f.stat().st_size for f in files) < 8 * size and not any("text" in names for names in left)
    assert scores.count() == df.count()


def test_only_written_tables_are_discarded(spark, tmp_path):
    given = tmp_path / "given"
    spark.range(5).write.parquet(str(given))
    written = staging.materialize(spark.range(5), compression="zstd")
    path = written.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert os.path.exists(path)
    staging.discard(spark.read.parquet(str(given)))
    staging.discard(written)
    assert spark.read.parquet(str(given)).count() == 5 and not os.path.exists(path)
