"""Domain shapes derived from the given star-schema tables.

Every shape aggregates the raw rows on the map side first, so later windows
see one row per (key, day) however many raw rows there were.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.exprs import round_at
from tidebook.functions.text import feature_map
from tidebook.session import cut_lineage, tasks_for


def trade_order() -> Column:
    """Exact order of trades by (order, part, line, price) as one number.

    It has a fixed width, unlike a struct, so first and last prices are hash
    aggregates without a sort. A value too wide for its digits is an error."""
    digits = {"l_partkey": 12, "l_linenumber": 3}
    price = F.round(F.col("px") * 10000).cast("decimal(11,0)")
    key, fits = F.col("l_orderkey").cast("decimal(38,0)"), F.col("l_orderkey") < 10**12
    for c, n in digits.items():
        key = key * F.lit(10**n).cast("decimal(38,0)") + F.col(c).cast("decimal(38,0)")
        fits = fits & F.col(c).between(0, 10**n - 1)
    key = key * F.lit(10**11).cast("decimal(38,0)") + price
    return F.when(fits & (F.col("px") >= 0), key).otherwise(F.raise_error("trade key out of range")).cast("decimal(38,0)")


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def tasks(self, name: str) -> int:
        """Number of tasks for shuffles of a raw table's rows. The row count
        comes from the Parquet footers; no column is read."""
        key = f"_tasks_{name}"
        if key not in self.__dict__:
            self.__dict__[key] = tasks_for(self.spark, self.raw(name).count())
        return self.__dict__[key]

    def stored(self, shape: str) -> DataFrame:
        """A shape written once to the shared folder and read back, for plans
        that use it many times: the raw table is then scanned once."""
        key = f"_stored_{shape}"
        if key not in self.__dict__:
            self.__dict__[key] = cut_lineage(getattr(self, shape), shape)
        return self.__dict__[key]

    @cached_property
    def bars(self) -> DataFrame:
        """Daily price bars per brand."""
        li = self.raw("lineitem").select(
            "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate",
            round_at(F.col("l_extendedprice") / F.col("l_quantity"), 4).alias("px"),
        )
        pt = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
        t = li.join(pt, "l_partkey").withColumn("o", trade_order())
        return t.groupBy("symbol", F.to_date("l_shipdate").alias("date")).agg(
            F.min_by("px", "o").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
            F.max_by("px", "o").alias("close"), F.sum("l_quantity").alias("volume"),
        )

    @cached_property
    def bench(self) -> DataFrame:
        """Market average close per day."""
        return self.bars.groupBy("date").agg(F.avg("close").alias("close"))

    @cached_property
    def nav(self) -> DataFrame:
        """One price per fund and day, dealt by fund over as many tasks as the
        raw rows ask for: windows and groups by fund follow without a shuffle
        of their own. Raw rows are dealt by fund and day first, so that a fund
        with many of them is not one task."""
        n = self.tasks("lineitem")
        li = self.raw("lineitem").select(
            F.col("l_suppkey").alias("scheme_code"), F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity")
        return li.repartition(n, "scheme_code", "date").groupBy("scheme_code", "date").agg(
            round_at(F.sum("l_extendedprice") / F.sum("l_quantity"), 4).alias("nav")).repartition(n, "scheme_code")

    @cached_property
    def chain(self) -> DataFrame:
        """Monthly option-chain snapshots: 4 symbols, 3 expiries, 21 strikes."""
        snap = F.trunc("l_shipdate", "MM")
        return self.raw("lineitem").groupBy(
            (F.col("l_suppkey") % 4).alias("symbol"), snap.alias("snap_date"),
            F.date_add(snap, (3 + (F.col("l_partkey") % 3) * 7).cast("int")).alias("expiry"),
            (24000.0 + 50.0 * ((F.col("l_partkey") % 21) - 10)).alias("strike"),
            F.when(F.col("l_orderkey") % 2 == 0, "CE").otherwise("PE").alias("option_type"),
        ).agg(F.max("l_quantity").alias("ltp"), (F.sum("l_quantity").cast("bigint") * 100).alias("oi"))

    @cached_property
    def chain_w(self) -> DataFrame:
        """Weekly snapshots inside quarterly expiries: consecutive snapshots share an expiry."""
        ship = F.to_date("l_shipdate")
        return self.raw("lineitem").groupBy(
            F.lit(0).cast("bigint").alias("symbol"), F.trunc(ship, "week").alias("snap_date"),
            F.add_months(F.trunc(ship, "quarter"), 3).alias("expiry"),
            (24000.0 + 50.0 * ((F.col("l_partkey") % 11) - 5)).alias("strike"),
            F.when(F.col("l_orderkey") % 2 == 0, "CE").otherwise("PE").alias("option_type"),
        ).agg(F.max("l_quantity").alias("ltp"), (F.sum("l_quantity").cast("bigint") * 100).alias("oi"))

    @cached_property
    def chain_v(self) -> DataFrame:
        """The weekly chain in two versions: first figures on the snapshot's day, from the first lines of each order, and final ones ten days later."""
        ship, first = F.to_date("l_shipdate"), F.col("l_linenumber") <= 3
        price, size = F.col("l_quantity"), F.col("l_quantity")
        d = self.raw("lineitem").groupBy(
            F.lit(0).cast("bigint").alias("symbol"), F.trunc(ship, "week").alias("snap_date"), F.add_months(F.trunc(ship, "quarter"), 3).alias("expiry"),
            (24000.0 + 50.0 * ((F.col("l_partkey") % 11) - 5)).alias("strike"), F.when(F.col("l_orderkey") % 2 == 0, "CE").otherwise("PE").alias("option_type"),
        ).agg(F.max(F.when(first, price)).alias("_p1"), F.sum(F.when(first, size)).alias("_s1"), F.max(price).alias("_p2"), F.sum(size).alias("_s2"))
        v = lambda p, s, days: F.struct(F.col(p).alias("ltp"), (F.col(s).cast("bigint") * 100).alias("oi"), F.date_add("snap_date", days).alias("known_at"))
        d = d.withColumn("_v", F.explode(F.array(v("_p1", "_s1", 0), v("_p2", "_s2", 10)))).where("_v.ltp is not null")
        return d.select("symbol", "snap_date", "expiry", "strike", "option_type", "_v.*")

    @cached_property
    def chain_d(self) -> DataFrame:
        """Daily snapshots of five strikes with weekly Tuesday expiries."""
        ship = F.to_date("l_shipdate")
        return self.raw("lineitem").groupBy(
            F.lit(0).cast("bigint").alias("symbol"), ship.alias("snap_date"),
            F.date_add(F.trunc(F.date_add(ship, 5), "week"), 1).alias("expiry"),
            (24000.0 + 50.0 * ((F.col("l_partkey") % 5) - 2)).alias("strike"),
            F.when(F.col("l_orderkey") % 2 == 0, "CE").otherwise("PE").alias("option_type"),
        ).agg(F.max("l_quantity").alias("ltp"), (F.sum("l_quantity").cast("bigint") * 100).alias("oi"))

    @cached_property
    def settle_d(self) -> DataFrame:
        """Settlement spot per weekly expiry; some expiries have none."""
        v = self.vix.where("spot > 0")
        return v.select(F.lit(0).cast("bigint").alias("symbol"), F.col("date").alias("expiry"), (23950.0 + F.col("vix") * 3.0).alias("spot_expiry"))

    @cached_property
    def settle(self) -> DataFrame:
        """Settlement spot per symbol and expiry of the monthly chain; some expiries have none."""
        v = self.vix.where("spot > 0").select(F.col("date").alias("expiry"), (23950.0 + F.col("vix") * 3.0).alias("_s"))
        return self.chain.select("symbol", "expiry").distinct().join(v, "expiry").select("symbol", "expiry", (F.col("_s") + 40.0 * F.col("symbol")).alias("spot_expiry"))

    @cached_property
    def index_bars(self) -> DataFrame:
        """One index built from all symbols per day."""
        return self.bars.groupBy("date").agg(
            F.avg("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.avg("close").alias("close")).withColumn("symbol", F.lit("INDEX"))

    @cached_property
    def flows(self) -> DataFrame:
        signed = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
        return self.raw("orders").groupBy(
            F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("entity")
        ).agg(round_at(F.sum(signed), 2).alias("net_value"))

    @cached_property
    def day_flows(self) -> DataFrame:
        return self.flows.groupBy("date").agg(round_at(F.sum("net_value"), 2).alias("net_value"))

    @cached_property
    def vix(self) -> DataFrame:
        """Volatility index and spot per day; spot is 0 on thin days."""
        avg = F.avg("o_totalprice")
        return self.raw("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
            round_at(5 + avg / 15000.0, 1).alias("vix"),
            F.when(F.count(F.lit(1)) % 5 != 0, round_at(avg / 10.0, 2)).otherwise(0.0).alias("spot"),
        )

    @cached_property
    def market_events(self) -> DataFrame:
        top = F.max("o_totalprice")
        return self.raw("orders").groupBy(
            F.to_date("o_orderdate").alias("event_date"), F.col("o_orderpriority").alias("event_name")
        ).agg(F.when(top > 495000, "HIGH").when(top > 400000, "MEDIUM").otherwise("LOW").alias("impact"))

    @cached_property
    def holidays(self) -> DataFrame:
        return self.market_events.where("impact = 'HIGH'").select(
            F.col("event_date").alias("holiday_date"), F.lit("EX").alias("exchange")
        ).distinct()

    @cached_property
    def lots(self) -> DataFrame:
        """Step-function lot sizes per symbol, effective from quarter starts."""
        return self.bars.groupBy("symbol", F.trunc("date", "quarter").alias("effective_from")).agg(
            (25 * (1 + F.max("volume").cast("int") % 4)).alias("lot_size")
        )

    @cached_property
    def ticks(self) -> DataFrame:
        return self.raw("events").select(
            F.col("user_id").cast("string").alias("symbol"), "ts", "event_id",
            F.col("value").alias("ltp"), F.col("event_type").alias("side"),
        )

    @cached_property
    def outcomes(self) -> DataFrame:
        """Closed trades: one row per event, score from the JSON feature k."""
        e = self.raw("events")
        day = F.to_date("ts")
        return e.select(
            F.col("event_id").alias("trade_id"), (F.col("user_id") % 4).alias("symbol"), F.col("ts").alias("exit_time"),
            day.alias("exit_date"), F.date_sub(day, (F.col("event_id") % 5).cast("int")).alias("entry_date"),
            F.date_add(day, (F.col("event_id") % 7).cast("int")).alias("expiry"),
            (F.col("value") - 50).alias("pnl_pts"), F.col("event_type").alias("exit_reason"),
            F.col("props").alias("features_json"), F.try_element_at(feature_map("props"), F.lit("k")).alias("conf"),
            (1 + F.col("event_id") % 3).cast("int").alias("lots"), F.lit(50).alias("lot_size"),
            F.col("value").alias("entry_premium"),
        )

    @cached_property
    def funds(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("scheme_code"), F.col("s_name").alias("scheme_name"),
            F.col("s_nationkey").alias("scheme_category"), F.lit(1).alias("is_active"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        """Job runs: service by event type, failed when the value is small."""
        return self.raw("events").select(
            F.col("event_type").alias("service"), F.to_date("ts").alias("run_date"), F.col("ts").alias("started_at"),
            F.timestamp_seconds(F.unix_timestamp("ts") + (F.col("event_id") % 600)).alias("finished_at"),
            F.when(F.col("value") < 10, "failed").otherwise("success").alias("status"),
            F.col("value").cast("bigint").alias("rows_written"), F.col("event_id").alias("version"),
        )
