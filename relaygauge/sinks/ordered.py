"""An archive stored in the order of its messages: what validates it moves no payload.

Messages lie in files by their bucket of offsets, sorted.  Spark knows that from the table's definition, so
positions and digests are computed where a bucket lies, and only counts and digests cross a shuffle.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from relaygauge.operators.positions import TOPIC_KEY, located_messages, offset_buckets
from relaygauge.schemas import MESSAGE
from relaygauge.sinks.files import Files

# Bytes of a stored file, about.
FILE_BYTES = 128 << 20
# Estimates above this are Spark's way to say that it cannot tell.
MOST_BYTES = 1 << 52
_LAYOUT = "layout.json"


def write_ordered(messages: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """Store messages at ``path``, which must be new, and give them back as stored.

    ``files`` is how many the buckets of offsets are dealt to; by default as many as the messages'
    estimated size asks for, or shuffle partitions where Spark has no estimate.  Payloads are shuffled here, once, and not again.
    """
    spark = messages.sparkSession
    if files is None:
        estimate = int(str(messages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        unknown = estimate > MOST_BYTES
        files = int(spark.conf.get("spark.sql.shuffle.partitions")) if unknown else max(1, -(-estimate // FILE_BYTES))
    located = located_messages(messages.select(*MESSAGE.names))
    keys = [*TOPIC_KEY, *offset_buckets()]
    name = _name(path)
    (
        located.repartition(files, *keys)
        .write.bucketBy(files, *keys)
        .sortBy("partition", "offset")
        .option("path", f"{path}/rows")
        .mode("error")
        .saveAsTable(name)
    )
    layout = json.dumps({"files": files, "columns": located.schema.jsonValue()})
    if not Files(spark, path).write_new(f"{path}/{_LAYOUT}", layout):
        raise ValueError(f"{path} holds an archive already")
    return spark.table(name)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_ordered`` stored, in this session or an earlier one."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        layout = json.loads(Files(spark, path).read(f"{path}/{_LAYOUT}"))
        columns = ", ".join(f"`{f['name']}` {f['type']}" for f in layout["columns"]["fields"])
        keys = ", ".join(f"`{k}`" for k in [*TOPIC_KEY, *offset_buckets()])
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) "
            f"SORTED BY (`partition`, `offset`) INTO {layout['files']} BUCKETS LOCATION '{path}/rows'"
        )
    return spark.table(name)


def _name(path: str) -> str:
    return f"ordered_{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:24]}"
