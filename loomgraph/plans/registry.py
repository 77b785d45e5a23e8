"""All registered queries of the core, by name, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import answers, files, graph, pipeline, problems, retrieval, vectors


def _wide(build):
    """Whole numbers as bigint, the width the SQL twins give."""

    def query(spark, sf_dir):
        df = build(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("bigint") for c, kind in df.dtypes if kind == "int"})

    return query


MODULES = (problems, graph, retrieval, answers, pipeline, files, vectors)
QUERIES = {k: f if m is problems else _wide(f) for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
