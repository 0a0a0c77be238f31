"""Point-in-time features, labels, walk-forward models, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.functions.exprs import attach_row, flag, safe_div
from tidebook.functions.market import scorecard
from tidebook.operators.asof import asof_join, interval_hits
from tidebook.operators.calendar import week_of_month
from tidebook.operators.dedup import as_known
from tidebook.operators.recursive import adx, ewm_mean, rsi, supertrend
from tidebook.operators.rolling import Series, week_ending
from tidebook.operators.running import average_rank_auc
from tidebook.operators.stats import one_hot
from tidebook.plans.options import SNAP, chain_features, eod_summary
from tidebook.session import cut_lineage

# Model inputs, in their order.
FEATURES = [
    "straddle_pct", "ce_pe_ratio", "pcr_oi", "oi_conc_ce", "oi_conc_pe", "atm_oi_ratio", "iv_rank", "iv_percentile", "atm_ce_iv",
    "atm_pe_iv", "iv_skew", "pcr_eod", "ce_wall_pct", "pe_wall_pct", "max_pain_dist_pct", "client_call_net", "client_put_net",
    "client_pcr", "fii_call_net", "fii_put_net", "fii_pcr", "day_of_week", "week_of_month", "dte", "vix", "vix_z20", "term_slope",
    "atm_iv_7d", "straddle_z", "atr_percentile", "rsi14", "hv_ratio", "supertrend_dir", "cpr_width_pct", "iv_hv5_ratio", "adx14",
    "event_in_window", "days_to_event",
]


def weekly_pivot_width(bars: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Width of the previous week's central pivot, labelled by the Thursday a week ends on."""
    wk = bars.groupBy(*by, week_ending("date", "Thu").alias("week")).agg(
        F.max("high").alias("_h"), F.min("low").alias("_l"), F.max_by("close", "date").alias("_c"))
    s = Series(list(by), "week")
    width = (F.col("_h") - F.col("_l")) / 2 / ((F.col("_h") + F.col("_l") + F.col("_c")) / 3) * 100
    return wk.withColumn("_w", width).select(*by, "week", s.lag("_w").alias("cpr"))


def technical_signals(index_bars: DataFrame) -> DataFrame:
    """ATR percentile, RSI, volatility ratio, trend direction, pivot width and
    ADX per (symbol, date)."""
    by, s = ["symbol"], Series(["symbol"])
    k = 252**0.5 * 100
    d = index_bars.withColumn("_tr", s.true_range()).withColumn("_r", F.col("close") / s.lag("close") - 1)
    d = ewm_mean(d, by, "date", {"_atr14": ("_tr", 1 / 14, 1), "_atr7": ("_tr", 1 / 7, 1)})
    d = d.withColumn("_ap", F.col("_atr14") / F.col("close") * 100)
    d = d.withColumns({"atr_percentile": s.pct_rank("_ap", 252, 252), "hv5": s.std("_r", 5) * k, "hv20": s.std("_r", 20) * k})
    d = d.withColumn("hv_ratio", safe_div("hv5", "hv20"))
    d = rsi(d, by, "date", "close", [14], zero_loss="missing").withColumnRenamed("rsi_14", "rsi14")
    d = adx(d, by, "date")
    d = asof_join(d, weekly_pivot_width(index_bars), by, "date", "week", ["cpr"]).withColumnRenamed("cpr", "cpr_width_pct")
    return supertrend(d, by, "date", "_atr7").drop("_tr", "_r", "_atr14", "_atr7", "_ap")


def straddle_zscore(trades: DataFrame) -> DataFrame:
    """Credit against the mean and population std of its days to expiry."""
    d = trades.withColumn("dte", F.datediff("expiry", "entry_date"))
    st = d.where("net_credit > 0").groupBy("symbol", "dte").agg(F.avg("net_credit").alias("_m"), F.stddev_pop("net_credit").alias("_s"))
    return d.join(st, ["symbol", "dte"], "left").withColumn("straddle_z", safe_div(F.col("net_credit") - F.col("_m"), "_s")).drop("_m", "_s")


def participant_features(oi: DataFrame, entities: Sequence[str] = ("Client", "FII")) -> DataFrame:
    """Net call and put positions and put-call ratio per entity, as columns."""
    cl, cs, pl, ps = (F.col(f"opt_index_{x}") for x in ("call_long", "call_short", "put_long", "put_short"))
    d = oi.select("date", "entity", (cl - cs).cast("double").alias("call_net"), (pl - ps).cast("double").alias("put_net"),
                  ((pl + ps) / F.greatest(cl + cs, F.lit(1))).alias("pcr"))
    aggs = [F.max(F.when(F.col("entity") == e, F.col(m))).alias(f"{e.lower()}_{m}") for e in entities for m in ("call_net", "put_net", "pcr")]
    return d.groupBy("date").agg(*aggs)


def label(df: DataFrame, pnl: str, lot: Column, margin: Column) -> Column:
    """Profit of at least 1 % of the margin; any profit when the margin is unknown."""
    return flag(F.when(margin > 0, F.col(pnl) * lot >= 0.01 * margin).otherwise(F.col(pnl) > 0))


def feature_table(trades: DataFrame, chain: DataFrame, eod: DataFrame, iv_daily: DataFrame, skew: DataFrame, term: DataFrame,
                  tech: DataFrame, poi: DataFrame, vix: DataFrame, events: DataFrame, index: str | Column = "INDEX") -> DataFrame:
    """Feature rows per (symbol, expiry, entry date), all inputs as known on
    the entry day. Per-day inputs are one row per day; joins are equi joins.
    ``index`` names the series of ``tech`` that a trade follows: one for all,
    or an expression of its symbol."""
    snap = {"snap_date": "entry_date"}
    key = ["symbol", "expiry", "entry_date"]
    d = straddle_zscore(trades)
    cf = chain_features(chain).withColumnsRenamed(snap).drop("atm_strike")
    d = d.join(cf, key)
    e = eod.withColumnsRenamed(snap).select(
        "symbol", "entry_date", F.col("spot").alias("_spot"), F.col("pcr").alias("pcr_eod"),
        safe_div((F.col("ce_wall_strike") - F.col("spot")) * 100, "spot").alias("ce_wall_pct"),
        safe_div((F.col("spot") - F.col("pe_wall_strike")) * 100, "spot").alias("pe_wall_pct"),
        safe_div((F.col("max_pain_strike") - F.col("spot")) * 100, "spot").alias("max_pain_dist_pct"))
    d = d.join(e, ["symbol", "entry_date"], "left")
    iv = iv_daily.withColumnsRenamed(snap).select("symbol", "entry_date", "atm_ce_iv", "atm_pe_iv", "iv_rank", "iv_percentile")
    d = d.join(iv, ["symbol", "entry_date"], "left").join(skew.withColumnsRenamed(snap), key, "left")
    d = d.join(term.withColumnsRenamed(snap).select("symbol", "entry_date", "term_slope", "atm_iv_7d"), ["symbol", "entry_date"], "left")
    day = {"date": "entry_date"}
    s = Series(["_k"], "date")
    v = vix.select("date", "vix", F.lit(0).alias("_k"))
    sd = F.coalesce(F.nullif(s.std("vix", 20), F.lit(0.0)), F.lit(1.0))
    v = v.select("date", "vix", ((F.col("vix") - s.sma("vix", 20)) / sd).alias("vix_z20"))
    d = d.join(v.withColumnsRenamed(day), "entry_date", "left").join(poi.withColumnsRenamed(day), "entry_date", "left")
    t = tech.withColumnsRenamed(day).select(
        F.col("symbol").alias("_index"), "entry_date", "atr_percentile", "rsi14", "hv_ratio", "hv5", "supertrend_dir", "cpr_width_pct", "adx14")
    d = d.withColumn("_index", F.lit(index)).join(t, ["_index", "entry_date"], "left").drop("_index")
    mid = (F.col("atm_ce_iv") + F.col("atm_pe_iv")) / 2
    d = d.withColumn("iv_hv5_ratio", F.when((mid > 0) & (F.col("hv5") > 0), mid / F.col("hv5")))
    d = d.withColumns({"dte": F.col("dte").cast("double"), "day_of_week": F.weekday("expiry"), "week_of_month": week_of_month("expiry")})
    return interval_hits(d, events, "entry_date", "expiry", "event_date")


def scorecard_confidence(features: DataFrame) -> DataFrame:
    """Rule scorecard over a feature table; absent inputs are neutral."""
    c = lambda n, v: F.coalesce(F.col(n), F.lit(v))
    return features.withColumn("confidence", scorecard(
        c("iv_rank", 50.0), c("vix", 15.0), c("atr_percentile", 50.0), c("hv_ratio", 1.0), c("iv_hv5_ratio", 1.2), c("event_in_window", 0)))


def make_pipeline(kind: str, features: Sequence[str], label_col: str = "target", category: str | None = None) -> Pipeline:
    """Assembler (which stores the feature list) plus the chosen model. A
    ``category`` column enters as fitted 0/1 columns, unknown values as none."""
    asm = VectorAssembler(inputCols=[*features, *(["_hot"] if category else [])], outputCol="_raw", handleInvalid="keep")
    first = [StringIndexer(inputCol=category, outputCol="_number", handleInvalid="keep"), OneHotEncoder(inputCols=["_number"], outputCols=["_hot"]), asm] if category else [asm]
    if kind == "gbt":
        return Pipeline(stages=[*first, GBTClassifier(featuresCol="_raw", labelCol=label_col, maxDepth=3, maxIter=20, stepSize=0.05,
                                                   subsamplingRate=0.8, minInstancesPerNode=5, seed=42)])
    if kind == "lr":
        sc = StandardScaler(inputCol="_raw", outputCol="_sc", withMean=True)
        return Pipeline(stages=[*first, sc, LogisticRegression(featuresCol="_sc", labelCol=label_col, weightCol="_w", regParam=0.1, maxIter=30)])
    raise ValueError(kind)


def balanced(df: DataFrame, label_col: str = "target") -> DataFrame:
    """Class weights n / (2 * class count) from one aggregate."""
    n = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(label_col).alias("_p"))
    j = attach_row(df, n)
    w = F.when(F.col(label_col) == 1, F.col("_n") / (2 * F.greatest("_p", F.lit(1)))).otherwise(F.col("_n") / (2 * F.greatest(F.col("_n") - F.col("_p"), F.lit(1))))
    return j.withColumn("_w", w).drop("_n", "_p")


def _ready(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})


def walk_forward(df: DataFrame, date: str, features: Sequence[str], kind: str, *, train_months: int = 12, test_months: int = 1,
                 min_history: int = 60, min_train: int = 15) -> DataFrame:
    """Out-of-fold confidence: train on the months before each test month.

    The fold plan is one small aggregate (rows per month); each fold is a fit
    and transform over distributed data. The input is written once to the
    shared folder, so a lost executor re-reads it instead of recomputing it."""
    d = cut_lineage(_ready(df, features).withColumn("_month", F.trunc(date, "MM")), "walkforward")
    per = [(r[0], r[1]) for r in d.groupBy("_month").count().orderBy("_month").collect()]
    start, seen = None, 0
    for month, n in per:
        seen += n
        if seen > min_history:
            start = month
            break
    out, fold = None, 0
    months = [m for m, _ in per]
    while start is not None and start <= months[-1]:
        y, m = divmod(start.year * 12 + start.month - 1 + test_months, 12)
        end = start.replace(year=y, month=m + 1)
        y, m = divmod(start.year * 12 + start.month - 1 - train_months, 12)
        lo = start.replace(year=y, month=m + 1)
        n_train = sum(n for mo, n in per if lo <= mo < start)
        n_test = sum(n for mo, n in per if start <= mo < end)
        if n_train >= min_train and n_test:
            train = d.where((F.col("_month") >= F.lit(lo)) & (F.col("_month") < F.lit(start)))
            test = d.where((F.col("_month") >= F.lit(start)) & (F.col("_month") < F.lit(end)))
            model = make_pipeline(kind, features).fit(balanced(train))
            p = score(model, test).withColumn("fold", F.lit(fold))
            out = p if out is None else out.unionByName(p)
            fold += 1
        start = end
    if out is None:
        return d.withColumn("confidence", F.lit(0.0)).withColumn("fold", F.lit(0)).where(F.lit(False)).drop("_month")
    return out.drop("_month")


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    p = model.transform(df)
    return p.withColumn("confidence", vector_to_array("probability")[1]).drop("_number", "_hot", "_raw", "_sc", "rawPrediction", "probability", "prediction")


def final_model(df: DataFrame, features: Sequence[str], kind: str, category: str | None = None) -> PipelineModel:
    return make_pipeline(kind, features, category=category).fit(balanced(_ready(df, features)))


def pooled(df: DataFrame, symbols: Sequence) -> DataFrame:
    """All symbols in one table with one-hot symbol columns."""
    return one_hot(df, "symbol", symbols, "sym_")


def compare_models(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Rank AUC per model; the greatest AUC is marked best."""
    a = average_rank_auc(scored, by, "confidence", "target")
    top = a.agg(F.max("auc").alias("_m"))
    return attach_row(a, top).withColumn("best", flag(F.col("auc") == F.col("_m"))).drop("_m")


def calibration_sweep(scored: DataFrame, by: Sequence[str], date: str, pnl: str, thresholds: Sequence[int] = tuple(range(50, 96, 5)),
                      min_trades: int = 3) -> DataFrame:
    """Trades, per-year count, win rate and P&L above each score threshold."""
    c = F.col("confidence") * 100
    aggs = [F.datediff(F.max(date), F.min(date)).alias("_days")]
    for t in thresholds:
        hit = c >= t
        aggs += [F.count_if(hit).alias(f"n{t}"), F.avg(F.when(hit, F.col("target"))).alias(f"w{t}"), F.avg(F.when(hit, F.col(pnl))).alias(f"a{t}"),
                 F.sum(F.when(hit, F.col(pnl))).alias(f"s{t}")]
    g = scored.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{t}").alias("trades"), (F.col(f"w{t}") * 100).alias("win_rate"),
                              F.col(f"a{t}").alias("avg_pnl"), F.col(f"s{t}").alias("total_pnl")) for t in thresholds])
    d = g.select(*by, "_days", F.explode(rows).alias("_r")).select(*by, "_days", "_r.*").where(F.col("trades") >= min_trades)
    return d.withColumn("per_year", safe_div("trades", F.col("_days") / 365.25)).drop("_days")


def calibration_buckets(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Predicted against actual win rate in 10-point score buckets."""
    b = F.least(F.floor(F.col("confidence") * 10), F.lit(9)) * 10
    return scored.groupBy(*by, b.cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), (F.avg("confidence") * 100).alias("predicted"), (F.avg("target") * 100).alias("actual"))


def band_win_rate(scored: DataFrame, confidence: float, width: int = 10) -> DataFrame:
    c = F.round(F.col("confidence") * 100)
    return scored.where(c.between(int(confidence) - width, int(confidence) + width)).agg(
        F.count(F.lit(1)).alias("n"), F.avg("target").alias("win_rate"))


def explain(features: DataFrame) -> DataFrame:
    """Short reason codes per row, in order of importance."""
    f = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    iv, vx, pcr, atr, hv = f("iv_rank"), f("vix"), f("pcr_oi"), F.coalesce("atr_percentile", F.lit(50.0)), F.coalesce("hv_ratio", F.lit(1.0))
    lines = F.array(
        F.when(iv > 70, "+iv_rich").when(iv > 50, "+iv_above_average").when((iv > 0) & (iv < 25), "-iv_cheap").when(iv > 0, "!iv_moderate"),
        F.when(vx <= 0, None).when(vx < 13, "+vix_calm").when(vx < 17, "+vix_moderate").when(vx < 22, "!vix_elevated").when(vx < 28, "-vix_high").otherwise("-vix_extreme"),
        F.when(atr < 30, "+narrow_ranges").when(atr > 70, "-wide_ranges"),
        F.when(hv > 1.3, "-vol_accelerating").when(hv < 0.8, "+vol_decelerating"),
        F.when(pcr > 1.5, "!put_heavy").when((pcr > 0.7) & (pcr < 1.3), "+pcr_balanced"),
        F.when(F.coalesce("event_in_window", F.lit(0)) == 1, "+event_in_window"),
    )
    return features.withColumn("reasons", F.filter(lines, lambda x: x.isNotNull()))


def point_in_time(keys: DataFrame, daily: dict[str, tuple[DataFrame, str, list[str]]], as_of: str = "as_of") -> DataFrame:
    """Rebuild features as of past dates: every daily input is read at its
    newest row on or before the date."""
    d = keys.withColumn("_k", F.lit(0))
    for frame, on, cols in daily.values():
        by = ["symbol"] if "symbol" in frame.columns else ["_k"]
        src = frame if by == ["symbol"] else frame.withColumn("_k", F.lit(0))
        d = asof_join(d, src, by, as_of, on, cols)
    return d.drop("_k")


def visible_chain(days: DataFrame, versions: DataFrame, known: str = "known_at") -> DataFrame:
    """Chain rows as they were known on the days of ``days(symbol, as_of)``.

    ``versions`` is an insert-only chain: a correction is a further row of the
    same contract with a later ``known``. Of each day the newest snapshot that
    had any known row counts, and in it the first expiry after the day; days
    without such a snapshot or expiry give no row."""
    shots = versions.groupBy("symbol", F.col(known).alias("_known")).agg(F.max("snap_date").alias("snap_date"))
    newest = F.max("snap_date").over(W.partitionBy("symbol").orderBy("_known"))  # one row per symbol and day
    d = asof_join(days.select("symbol", "as_of").distinct(), shots.withColumn("snap_date", newest), ["symbol"], "as_of", "_known", ["snap_date"]).where("snap_date is not null")
    ahead = d.join(versions.select("symbol", "snap_date", "expiry", known), ["symbol", "snap_date"]).where((F.col(known) <= F.col("as_of")) & (F.col("expiry") > F.col("as_of")))
    d = ahead.groupBy("symbol", "as_of", "snap_date").agg(F.min("expiry").alias("expiry"))
    return as_known(d, versions, SNAP, ["strike", "option_type"], known, "as_of")


def rebuild_features(days: DataFrame, versions: DataFrame, daily: dict[str, tuple[DataFrame, str, list[str]]],
                     published: dict[str, tuple[DataFrame, str, list[str]]], events: DataFrame) -> DataFrame:
    """Feature rows as they would have been built on past days.

    Chain features, ratio, walls and max pain come from the versions known on
    the day; ``daily`` inputs are read at the snapshot's day, ``published``
    ones at the day itself by their date of publication."""
    seen = cut_lineage(visible_chain(days, versions), "visible")
    at = seen.select("symbol", "as_of", "snap_date", "expiry").distinct()
    # Two days may read one snapshot in different versions, so the day takes the snapshot's place.
    chain = seen.drop("snap_date").withColumnRenamed("as_of", "snap_date")
    eod = eod_summary(chain)
    e = eod.select(*SNAP, F.col("pcr").alias("pcr_eod"), *[
        safe_div((a - b) * 100, "spot").alias(n) for n, a, b in (
            ("ce_wall_pct", F.col("ce_wall_strike"), F.col("spot")), ("pe_wall_pct", F.col("spot"), F.col("pe_wall_strike")), ("max_pain_dist_pct", F.col("max_pain_strike"), F.col("spot")))])
    f = chain_features(chain).join(e, SNAP).withColumnRenamed("snap_date", "as_of")
    d = point_in_time(at.join(f, ["symbol", "as_of", "expiry"]), daily, "snap_date")
    d = point_in_time(d, published)
    d = d.withColumns({"dte": F.datediff("expiry", "snap_date"), "day_of_week": F.weekday("expiry"), "week_of_month": week_of_month("expiry")})
    return interval_hits(d, events, "snap_date", "expiry", "event_date")


def actual_outcomes(features: DataFrame, trades: DataFrame) -> DataFrame:
    """Rebuilt rows beside what each structure, entered on that snapshot, paid:
    the trade with the smallest parameters of a structure counts."""
    t = trades.groupBy("symbol", "expiry", F.col("entry_date").alias("snap_date"), "strategy").agg(F.min(F.struct("short_n", "wing_m", "pnl_pts")).alias("_t"))
    return features.join(t, ["symbol", "expiry", "snap_date"]).select(*features.columns, "strategy", "_t.*")


__all__ = [n for n in dir() if not n.startswith("_")] + ["SNAP"]
