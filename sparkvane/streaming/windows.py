"""An extension beyond the batch surface: windowed counts of an event stream with a watermark, and sessions."""
from pyspark.sql import functions as F


def tumbling(events, ts="ts", by="event_type", size="1 day", late="2 days"):
    """Counts and sums per window and group; works on batch and streaming frames. Rows later than the watermark are dropped on a stream."""
    return (
        events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), F.col(by)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), by, "n", "total"))


def sessions(events, ts="ts", by="user_id", gap="30 minutes", late="2 days"):
    """Sessions of each group: a gap ends one."""
    return (
        events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(by)).agg(F.count("*").alias("n"))
        .select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"))


def stream(spark, folder, schema):
    """The parquet files of a folder as a stream, one file a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
