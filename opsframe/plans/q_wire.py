"""Samples through the wire format and back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from opsframe.sources import remote_write
from opsframe.sources.tables import read
from opsframe.storage import shared_folder

from .registry import query


@query("s3_remote_write_read_back", "SELECT event_type AS name, user_id::VARCHAR AS host, event_id % 3 = 0 AS tagged, epoch_us(ts) // 1000 AS t, value FROM events")
def s3_remote_write(spark, sf):
    remote_write.register(spark)
    path = f"{shared_folder(spark)}/opsframe-{uuid.uuid4().hex}/samples"
    tag = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("tag"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    labels = F.map_concat(F.create_map(F.lit("host"), F.col("user_id").cast("string")), tag)
    rows = read(spark, sf, "events").select(F.col("event_type").alias("name"), labels.alias("labels"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("t"), "value")
    # a series' samples in a row, so that few batches have it
    rows.repartition("name", "labels.host").sortWithinPartitions("name", "labels.host", F.map_contains_key("labels", "tag"), "t").write.format("remote_write").option("path", path).option("target", 1 << 16).mode("append").save()
    back = spark.read.format("remote_write").option("path", path).load()
    return back.select("name", F.col("labels")["host"].alias("host"), F.map_contains_key("labels", "tag").alias("tagged"), "t", "value")
