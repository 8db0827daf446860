"""Small shared pieces: table reads, scratch tables and their removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import scratch_path

SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
}

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan with a declared schema (no footer-inference job)."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under ``spark.checkpoint.dir`` and scan it back: the
    lineage is cut, the size is known to the planner, and a lost executor costs
    only a reread."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> tuple[DataFrame, str, str]:
    """As ``written``, in buckets of ``column``: joins on it move no row of this
    side.  Also the names of the table and of its folder, for their removal."""
    path = scratch_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(buckets, column).option("path", path).saveAsTable(table, format="parquet")
    return df.sparkSession.table(table), table, path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that no later job reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def crc_mod5(doc_id) -> F.Column:
    """crc32 of the doc_id's decimal text, modulo 5 (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(5)
