"""A scan that goes on: each batch of archives changes a stored state, in the months of candles that it touches only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from archlake.functions import dims
from archlake.functions import exprs as E
from archlake.operators import klines
from archlake.sources import landing
from archlake.sources.shared import cut
from archlake.sources.snapshots import Snapshot

#: What decides between two candles of one time, in this order: the later first day in the request, the layer, key and path of
#: the archive, and the row in it. The same order as planning.archive_order, but one that doesn't change when archives come.
ORDER = "first_day date, layer int, key string, path string, ordinal long"

_CANDLE = "open_time long, mask long, cells array<string>"


@dataclass
class IncrementalScan:
    """Stored candles of scan requests (request_id, symbol, dataset, interval, start, end) at a path.

    `layers/batch=<id>` holds the winning rows of each archive of a batch, `archives/batch=<id>` the archives themselves; the
    state is a Snapshot of the candles that win over all archives, by request and month. A batch's files are written first and
    the state is switched last, with the batch's id as its note: a batch that comes again changes nothing, and one that was
    lost half-way is done again from the start. Of an archive that comes again with other content only the last one counts.
    """

    spark: SparkSession
    path: str
    requests: DataFrame
    state: Snapshot = field(init=False)

    def __post_init__(self) -> None:
        self.path = self.path.rstrip("/")
        kind = self.requests.schema["request_id"].dataType.simpleString()
        self._keys = f"request_id {kind}, month string"
        self.state = Snapshot(self.spark, f"{self.path}/state", f"{self._keys}, {_CANDLE}, place struct<{ORDER.replace(' ', ':').replace(',:', ',')}>", ("request_id", "month"), ("open_time",))

    def done(self) -> int:
        """The last batch that has been applied, -1 if none has."""
        return int(self.state.current().note or -1)

    def _stored(self, name: str, shape: str, upto: int) -> DataFrame:
        schema = self.spark.createDataFrame([], shape).schema
        return self.spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType())])).parquet(f"{self.path}/{name}").where(F.col("batch") <= upto)

    def _winners(self, raw: DataFrame) -> DataFrame:
        """Rows of a batch inside the requests, one for each request, archive and time: of several the last one."""
        days = raw.select("path", "dataset", "symbol", "interval", "period", "key").distinct().withColumns({"first": E.key_first_day(F.col("key")), "last": E.key_last_day(F.col("key"))})
        asked = self.requests.select("request_id", "dataset", "symbol", "interval", "start", "end")
        layer = F.element_at(F.create_map(*[x for k, v in dims.LAYERS.items() for x in (F.lit(k), F.lit(v))]), F.col("period"))
        taking = days.join(asked, ["dataset", "symbol", "interval"]).where((F.col("first") <= F.col("end")) & (F.col("last") >= F.col("start"))).select(
            "request_id", "path", "key", layer.alias("layer"), F.greatest("start", "first").alias("first_day"), E.day_start_ms(F.col("start")).alias("from_ms"), (E.day_start_ms(F.col("end")) + dims.DAY_MS - 1).alias("to_ms")
        )
        rows = klines.candle_rows(landing.raw_rows(raw)).select("path", "ordinal", "open_time", "mask", F.when(F.col("mask") != 0, F.col("cells")).alias("cells"))
        met = rows.join(taking, "path").where(F.col("open_time").between(F.col("from_ms"), F.col("to_ms")))
        won = met.groupBy("request_id", "path", "open_time").agg(F.max(F.struct("ordinal", "mask", "cells", "first_day", "layer", "key")).alias("w"))
        month = F.date_format(E.day_of(F.col("open_time")), "yyyy-MM")
        return won.select("request_id", month.alias("month"), "open_time", "w.mask", "w.cells", "w.first_day", "w.layer", "w.key", "path", "w.ordinal")

    def apply(self, raw: DataFrame, batch: int) -> bool:
        """Take in landed rows (of archives that are new or have changed) as a batch; False if it has been taken in before."""
        if batch <= self.done():
            return False
        shape = f"{self._keys}, {_CANDLE}, {ORDER}"
        self._winners(raw).write.mode("overwrite").parquet(f"{self.path}/layers/batch={batch}")
        raw.select("path").distinct().write.mode("overwrite").parquet(f"{self.path}/archives/batch={batch}")
        layers, archives = self._stored("layers", shape, batch), self._stored("archives", "path string", batch)
        # months that the batch has rows in, or that its archives had rows in before
        came = archives.where(F.col("batch") == batch).select("path")
        touched = cut(layers.join(came, "path", "left_semi").select("request_id", "month").distinct())
        last = archives.groupBy("path").agg(F.max("batch").alias("batch"))

        def merged(_: DataFrame, __) -> DataFrame:
            rows = layers.join(last, ["path", "batch"], "left_semi").join(touched, ["request_id", "month"], "left_semi")
            place = F.struct(*[c.split()[0] for c in ORDER.split(", ")]).alias("place")
            won = rows.groupBy("request_id", "month", "open_time").agg(F.max_by(F.struct("mask", "cells"), place).alias("w"), F.max(place).alias("place"))
            return won.select("request_id", "month", "open_time", "w.mask", "w.cells", "place")

        self.state.replace(merged, touched, str(batch))
        return True

    def merged(self) -> DataFrame:
        """request_id, open_time, mask, cells (of bad candles) and place of every candle, as the batches so far have it."""
        return self.state.read().drop("month")

    def by_day(self) -> DataFrame:
        return klines.by_day(self.merged().select("request_id", "open_time", "mask"), self.requests)

    def catch_up(self, root: str) -> bool:
        """Take in all archives below root that are new, or whose file has changed, as the next batch."""
        listed = cut(landing.inventory(self.spark, root))
        version = ["path", "length", "modified"]
        seen = Snapshot(self.spark, f"{self.path}/seen", StructType([listed.schema[c] for c in (*version, "dataset")]), ("dataset",))
        new = cut(listed.join(seen.read(), version, "left_anti"))
        if new.isEmpty():
            return False
        self.apply(cut(landing.with_keys(landing.land_files(self.spark, new))), self.done() + 1)
        rows = new.select(*version, F.coalesce("dataset", F.lit("none")).cast(StringType()).alias("dataset"))
        seen.replace(lambda old, _: old.unionByName(rows), rows)
        return True
