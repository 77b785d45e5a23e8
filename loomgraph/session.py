"""Session helpers: where intermediate tables live and how lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session (tests) may name none: it takes a temporary folder and remembers it, so that one session
    uses one folder.  On a cluster such a folder would be another one on every machine, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.loomgraph.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.loomgraph.dir", found)
    return found.rstrip("/")


class Scratch:
    """Intermediate tables of one operator, written to the shared folder.

    A written table cuts the lineage, survives the loss of executors and gives the
    optimizer real sizes.  Tables that the result still reads stay; ``drop`` removes
    those that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/loomgraph-{name}-{uuid.uuid4().hex}"
        self.tables: set[str] = set()

    def cut(self, df: DataFrame, table: str, by: str | None = None) -> DataFrame:
        """``df`` written and read again; ``by``: a column of few values, of which readers of one read only its files."""
        path = f"{self.base}/{table}"
        self.tables.add(table)
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{table}")
            path.getFileSystem(conf).delete(path, True)
            self.tables.discard(table)

    def keep(self, *tables: str) -> None:
        """Drop all but these."""
        self.drop(*(self.tables - set(tables)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
