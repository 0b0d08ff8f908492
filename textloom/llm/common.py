"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.session import materialize


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as it lies there: large inputs have splits enough."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) and nothing else, so that no further column can clash; a null text is empty."""
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    return materialize(df, label)


def per_batch(df: DataFrame, make: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """Arrow batch in, columns out.  ``make`` returns the columns by name, or None for no rows."""
    fields = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)
        for batch in batches:
            # a batch may hold long texts: go through it in slices of a few MB
            for part in slices(batch):
                columns = make(part)
                if columns is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[f.name], type=f.type) for f in target], schema=target
                    )

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes."""
    rows = batch.num_rows
    step = max(1, int(rows * most / max(batch.nbytes, 1)))
    for start in range(0, rows, step):
        yield batch.slice(start, step)


def held_out(key: Column) -> Column:
    """Rows kept for testing: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def hash_sample(rows: DataFrame, group: str, most: int) -> tuple[DataFrame, dict]:
    """At most ``most`` rows of each group, those whose doc_id hashes lowest, and the groups' sizes.

    Which rows are picked depends on the ids alone.  A cut at a hash that about
    ``1.25 * most`` rows pass comes first, so that few rows shuffle however
    large a group is; only a group of less than about 1.25 times its expected
    share of low hashes could come out smaller.
    """
    sizes = {r[0]: r["n"] for r in rows.groupBy(group).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return rows, sizes
    size = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col(group)]
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) * size < (1 << 31) * F.lit(1.25 * most + 50)
    order = Window.partitionBy(group).orderBy(F.xxhash64("doc_id"), "doc_id")
    return rows.where(low).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank"), sizes
