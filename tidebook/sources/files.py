"""Readers that turn raw files into table shapes. Each takes a path (a file,
folder or glob) and an explicit schema, so no inference pass runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.exprs import clip
from tidebook.functions.text import any_date, clean_number

# File layouts, date formats, entity names and flow limits.
OLD_LAYOUT = {
    "kind": "INSTRUMENT", "symbol": "SYMBOL", "expiry": "EXPIRY_DT", "strike": "STRIKE_PR", "option_type": "OPTION_TYP", "ltp": "CLOSE",
    "oi": "OPEN_INT", "oi_change": "CHG_IN_OI", "volume": "CONTRACTS",
}
NEW_LAYOUT = {
    "kind": "FinInstrmTp", "symbol": "TckrSymb", "expiry": "XpryDt", "strike": "StrkPric", "option_type": "OptnTp", "ltp": "ClsPric",
    "oi": "OpnIntrst", "oi_change": "ChngInOpnIntrst", "volume": "TtlTradgVol",
}
OLD_KIND, NEW_KIND = "OPTIDX", "IDO"
OLD_DATE, NEW_DATE = "dd-MMM-yyyy", "yyyy-MM-dd"
CHAIN_DATES = ("dd-MMM-yyyy", "dd-MM-yyyy")
FLOW_DATES = ("dd-MMM-yyyy", "dd-MMMM-yyyy")
FLOW_ENTITIES = {"FII/FPI": "FII", "FII/FPI *": "FII", "FII": "FII", "DII": "DII", "DII **": "DII"}
FLOW_LIMIT = 200_000.0
PARTICIPANTS = ("Client", "DII", "FII", "Pro", "TOTAL")
POSITION_PAIRS = ("fut_index", "fut_stock", "opt_index_call", "opt_index_put", "opt_stock_call", "opt_stock_put", "total")


def _strings(cols: Sequence[str]) -> str:
    return ", ".join(f"`{c}` string" for c in cols)


def read_strings(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.schema(_strings(columns)).option("header", True).option("enforceSchema", False).csv(path)


def _derivatives(df: DataFrame, layout: dict[str, str], kind: str, date_format: str, trade_date: Column, symbols: Sequence[str] | None) -> DataFrame:
    c = {k: F.trim(F.col(v)) for k, v in layout.items()}
    num = lambda k: F.coalesce(F.try_to_number(c[k], F.lit("999999999999.99")).cast("double"), c[k].try_cast("double"), F.lit(0.0))
    side = F.upper(c["option_type"])
    keep = (c["kind"] == kind) & side.isin("CE", "PE")
    if symbols is not None:
        keep = keep & c["symbol"].isin(*symbols)
    out = df.where(keep).select(
        c["symbol"].alias("symbol"), F.timestamp_seconds(F.unix_timestamp(trade_date.cast("timestamp")) + (15 * 60 + 30) * 60).alias("timestamp"),
        any_date(c["expiry"], [date_format]).alias("expiry"), num("strike").alias("strike"), side.alias("option_type"), num("ltp").alias("ltp"),
        num("oi").cast("long").alias("oi"), num("oi_change").cast("long").alias("oi_change"), num("volume").cast("long").alias("volume"))
    return out.where("expiry is not null")


def old_derivatives(df: DataFrame, trade_date: Column, symbols: Sequence[str] | None = None) -> DataFrame:
    """Old report layout: index options only, sides trimmed, missing numbers 0,
    rows with an unreadable expiry dropped, stamped 15:30."""
    return _derivatives(df, OLD_LAYOUT, OLD_KIND, OLD_DATE, trade_date, symbols)


def new_derivatives(df: DataFrame, trade_date: Column, symbols: Sequence[str] | None = None) -> DataFrame:
    return _derivatives(df, NEW_LAYOUT, NEW_KIND, NEW_DATE, trade_date, symbols)


def derivatives(spark: SparkSession, paths: dict[str, Sequence[str]], trade_date: str = "trade_date", symbols: Sequence[str] | None = None) -> DataFrame:
    """Layout dispatch where the layouts are known: ``paths`` lists files per
    layout ('old', 'new'). ``routed_derivatives`` reads each file's header."""
    parts = []
    for name, layout, parse in (("old", OLD_LAYOUT, old_derivatives), ("new", NEW_LAYOUT, new_derivatives)):
        if paths.get(name):
            df = spark.read.schema(_strings([*layout.values(), trade_date])).option("header", True).csv(list(paths[name]))
            parts.append(parse(df, F.to_date(trade_date), symbols))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


#: A comma outside quotes.
_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _cells(line: Column) -> Column:
    """Trimmed cells of a CSV line without their quotes; empty ones are null."""
    plain = lambda c: F.nullif(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit(""))
    return F.transform(F.split(line, _COMMA), plain)


def routed_derivatives(spark: SparkSession, paths: Sequence[str], trade_date: str = "trade_date", symbols: Sequence[str] | None = None) -> DataFrame:
    """Daily reports of either layout, told apart by each file's own header.

    Files are read as lines. A header is a line that names a layout's kind
    column; one row per file, it is joined to the file's lines, so a file may
    be split over tasks, and columns may stand in any order. Cells are picked
    by the header's names; a layout's parser reads the lines of its files.
    Files without a known header contribute nothing. Missing columns are null.
    """
    lines = spark.read.text(list(paths)).select(_cells(F.col("value")).alias("cells"), F.col("_metadata.file_path").alias("file"))
    kinds = {"old": OLD_LAYOUT["kind"], "new": NEW_LAYOUT["kind"]}
    is_header = F.arrays_overlap("cells", F.array(*(F.lit(k) for k in kinds.values())))
    headers = lines.where(is_header).groupBy("file").agg(F.max("cells").alias("header"))
    rows = lines.where(~F.coalesce(is_header, F.lit(False))).join(headers, "file")
    parts = []
    for name, layout, parse in (("old", OLD_LAYOUT, old_derivatives), ("new", NEW_LAYOUT, new_derivatives)):
        cell = lambda c: F.get("cells", F.array_position("header", F.lit(c)) - 1).alias(c)
        named = rows.where(F.array_contains("header", F.lit(kinds[name]))).select(*(cell(c) for c in [*layout.values(), trade_date]))
        parts.append(parse(named, F.to_date(trade_date), symbols))
    return parts[0].unionByName(parts[1])


_SIDE = "struct<expiryDate:string,lastPrice:double,openInterest:bigint,changeinOpenInterest:bigint,totalTradedVolume:bigint,impliedVolatility:double>"
CHAIN_JSON = f"symbol string, ts timestamp, records struct<underlyingValue:double, data:array<struct<strikePrice:double, expiryDate:string, CE:{_SIDE}, PE:{_SIDE}>>>"


def option_chain_json(df: DataFrame) -> DataFrame:
    """Nested chain documents to one row per strike and side. Sides without
    price and open interest, and rows without a readable expiry, are dropped."""
    item = df.where("records.underlyingValue <> 0").select("symbol", F.col("ts").alias("timestamp"), F.explode("records.data").alias("_d"))
    expiry = any_date(F.coalesce("_d.expiryDate", "_d.CE.expiryDate", "_d.PE.expiryDate"), CHAIN_DATES)
    sides = F.array(*[F.struct(F.lit(s).alias("option_type"), F.col(f"_d.{s}").alias("q")) for s in ("CE", "PE")])
    d = item.select("symbol", "timestamp", expiry.alias("expiry"), F.col("_d.strikePrice").alias("strike"), F.explode(sides).alias("_s"))
    z = lambda f, v: F.coalesce(F.col(f"_s.q.{f}"), F.lit(v))
    return d.where("_s.q is not null and expiry is not null").select(
        "symbol", "timestamp", "expiry", "strike", "_s.option_type", z("lastPrice", 0.0).alias("ltp"), z("impliedVolatility", 0.0).alias("iv"),
        z("openInterest", 0).alias("oi"), z("changeinOpenInterest", 0).alias("oi_change"), z("totalTradedVolume", 0).alias("volume"),
    ).where("ltp <> 0 or oi <> 0")


def participant_positions(df: DataFrame, entity: str = "Client Type") -> DataFrame:
    """Participant positions: five entities, commas stripped, net = long - short.
    Long and short columns are named ``<pair>_long`` and ``<pair>_short``."""
    d = df.where(F.trim(F.col(f"`{entity}`")).isin(*PARTICIPANTS))
    n = lambda c: clean_number(F.col(c)).cast("long")
    cols = []
    for p in POSITION_PAIRS:
        cols += [n(f"{p}_long").alias(f"{p}_long"), n(f"{p}_short").alias(f"{p}_short"), (n(f"{p}_long") - n(f"{p}_short")).alias(f"{p}_net")]
    return d.select("date", F.trim(F.col(f"`{entity}`")).alias("entity"), *cols)


def read_participant_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The file starts with a title line; rows before the header carry no
    known entity and fall out in ``participant_positions``."""
    return spark.read.schema(_strings(columns)).option("ignoreLeadingWhiteSpace", True).csv(path)


def flow_json(df: DataFrame) -> DataFrame:
    """Flow documents: category to entity, two date formats, comma numbers,
    values beyond the limit set to 0."""
    m = F.create_map(*[F.lit(x) for kv in FLOW_ENTITIES.items() for x in kv])
    ent = F.try_element_at(m, F.upper(F.trim("category")))
    def val(c):
        v = clean_number(c)
        return F.when(v == clip(v, -FLOW_LIMIT, FLOW_LIMIT), v).otherwise(0.0)

    return df.select(any_date("date", FLOW_DATES).alias("date"), ent.alias("entity"), val("buyValue").alias("buy_value"), val("sellValue").alias("sell_value"),
                     val("netValue").alias("net_value")).where("date is not null and entity is not null")


NAV_JSON = "scheme_code bigint, data array<struct<date:string, nav:string>>"


def nav_json(df: DataFrame, watermarks: DataFrame | None = None) -> DataFrame:
    """NAV documents: positive values after each fund's watermark."""
    d = df.select("scheme_code", F.explode("data").alias("_d")).select(
        "scheme_code", any_date("_d.date", ["dd-MM-yyyy"]).alias("date"), F.col("_d.nav").try_cast("double").alias("nav")).where("nav > 0 and date is not null")
    if watermarks is None:
        return d
    return d.join(watermarks, "scheme_code", "left").where(F.col("watermark").isNull() | (F.col("date") > F.col("watermark"))).drop("watermark")


def statements_long(df: DataFrame, lines: dict[str, Sequence[str]], keys: Sequence[str]) -> DataFrame:
    """Wide statements (one column per period) to one row per (key, period);
    each output line takes the first alias present, missing values 0."""
    periods = [c for c in df.columns if c not in (*keys, "line")]
    long = df.unpivot([*keys, "line"], periods, "period", "value")
    known = [a for al in lines.values() for a in al]
    g = long.where(F.col("line").isin(*known)).groupBy(*keys, "period").agg(
        *[F.max(F.when(F.col("line") == a, F.col("value"))).alias(f"_{i}") for i, a in enumerate(known)])
    out = []
    for name, al in lines.items():
        vals = [F.when(~F.isnan(F.col(f"_{known.index(a)}")), F.col(f"_{known.index(a)}")) for a in al]
        out.append(F.coalesce(*vals, F.lit(0.0)).alias(name))
    return g.select(*keys, F.to_date("period").alias("period"), *out)


def normalise_bars(df: DataFrame, symbol: Column, market: Column) -> DataFrame:
    """Raw bars (Date, Open, ...): lower-case columns, pre-1970 rows dropped,
    missing volume 0."""
    return df.where(F.col("Date") >= F.to_date(F.lit("1970-01-01"))).select(
        F.to_date("Date").alias("date"), symbol.alias("symbol"), market.alias("market"),
        *[F.col(c).cast("double").alias(c.lower()) for c in ("Open", "High", "Low", "Close")], F.coalesce(F.col("Volume").cast("long"), F.lit(0)).alias("volume"))
