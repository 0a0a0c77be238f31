"""SQL pieces shared by several checks. Smoothing is a recursive row walk here,
so it is independent of the blocked prefix sums used in the Spark plans."""

RSI_EMA = """
b0 as (select *, row_number() over (partition by symbol order by date) as rn,
       close - lag(close) over (partition by symbol order by date) as dl from bars),
rs as (select symbol, rn, greatest(dl,0.0) as ag14, greatest(-dl,0.0) as al14, greatest(dl,0.0) as ag5, greatest(-dl,0.0) as al5
       from b0 where rn = 2
       union all
       select b0.symbol, b0.rn, rs.ag14 + (greatest(b0.dl,0.0)-rs.ag14)/14.0, rs.al14 + (greatest(-b0.dl,0.0)-rs.al14)/14.0,
              rs.ag5 + (greatest(b0.dl,0.0)-rs.ag5)/5.0, rs.al5 + (greatest(-b0.dl,0.0)-rs.al5)/5.0
       from rs join b0 on b0.symbol = rs.symbol and b0.rn = rs.rn + 1),
em as (select symbol, rn, close as ema20 from b0 where rn = 1
       union all
       select b0.symbol, b0.rn, em.ema20 + (b0.close-em.ema20)*2.0/21.0 from em join b0 on b0.symbol = em.symbol and b0.rn = em.rn + 1)
"""

PRICE_FEATURES = RSI_EMA + """,
t0 as (select b0.*, case when b0.rn >= 20 then em.ema20 end as ema20,
       case when b0.rn >= 15 and rs.al14 > 0 then 100 - 100/(1+rs.ag14/rs.al14) else 0 end as rsi_14,
       case when b0.rn >= 6 and rs.al5 > 0 then 100 - 100/(1+rs.ag5/rs.al5) else 0 end as rsi_5,
       lag(b0.close) over (partition by b0.symbol order by b0.date) as pc
       from b0 left join rs using (symbol, rn) left join em using (symbol, rn)),
t1 as (select *, greatest(high-low, abs(high-pc), abs(low-pc)) as tr,
       case when rn >= 20 then avg(close) over w20 end as s20, case when rn >= 50 then avg(close) over w50 end as s50,
       case when rn >= 200 then avg(close) over w200 end as s200, stddev_samp(close) over w20 as sd20,
       avg(volume) over w5 as v5, stddev_samp(volume) over w5 as vs5, avg(volume) over w20 as v20, stddev_samp(volume) over w20 as vs20,
       max(close) over w252 as hi, lag(close,5) over w as c5, lag(close,20) over w as c20
       from t0 window w as (partition by symbol order by date),
       w5 as (partition by symbol order by date rows 4 preceding), w20 as (partition by symbol order by date rows 19 preceding),
       w50 as (partition by symbol order by date rows 49 preceding), w200 as (partition by symbol order by date rows 199 preceding),
       w252 as (partition by symbol order by date rows 251 preceding)),
t2 as (select *, close-s20 as x20, close-s50 as x50, close-ema20 as xe,
       case when rn >= 15 then avg(tr) over (partition by symbol order by date rows 13 preceding) else 0 end as atr_14 from t1),
pf as (select symbol, date, open, high, low, close, volume, rn as n_hist, rsi_14, rsi_5,
       case when lag(x20) over w < 0 and x20 >= 0 then 1 when lag(x20) over w > 0 and x20 <= 0 then -1 else 0 end as sma_20_cross,
       case when lag(x50) over w < 0 and x50 >= 0 then 1 when lag(x50) over w > 0 and x50 <= 0 then -1 else 0 end as sma_50_cross,
       case when lag(xe) over w < 0 and xe >= 0 then 1 when lag(xe) over w > 0 and xe <= 0 then -1 else 0 end as ema_20_cross,
       coalesce((close-s20)/s20*100,0) as price_vs_sma20, coalesce((close-s50)/s50*100,0) as price_vs_sma50,
       coalesce((close-s200)/s200*100,0) as price_vs_sma200,
       case when rn >= 6 and vs5 > 0 then (volume-v5)/vs5 else 0 end as volume_z5,
       case when rn >= 21 and vs20 > 0 then (volume-v20)/vs20 else 0 end as volume_z20,
       case when rn < 20 then 'flat' when v5/v20 > 1.1 then 'expanding' when v5/v20 < 0.9 then 'contracting' else 'flat' end as volume_trend,
       atr_14, atr_14/close*100 as atr_pct,
       case when rn >= 20 and sd20 > 0 then greatest(0.0, least(1.0, (close-(s20-2*sd20))/(4*sd20))) else 0.5 end as bb_position,
       coalesce((close-c5)/c5*100,0) as return_5d, coalesce((close-c20)/c20*100,0) as return_20d, (hi-close)/hi*100 as drawdown_pct
       from t2 window w as (partition by symbol order by date))
"""

MOVES = """mv as (select * from (select *, lag(close) over (partition by symbol order by date) as prev_close from bars) z
       where prev_close > 0 and abs((close-prev_close)/prev_close*100) >= {th}),
moves as (select *, (close-prev_close)/prev_close*100 as pct_change, case when close > prev_close then 'UP' else 'DOWN' end as direction,
       case when close > prev_close and open/prev_close >= 1.005 then 'gap_up' when close > prev_close then 'intraday_surge'
            when open/prev_close <= 0.995 then 'gap_down' else 'intraday_crash' end as event_type from mv)
"""

LABELS = """ld as (select *, lead(close,1) over w as c1, lead(close,2) over w as c2, lead(close,3) over w as c3, lead(close,5) over w as c5,
       lag(close) over w as prev_close from bars window w as (partition by symbol order by date)),
lr as (select *, case when close > prev_close then 'UP' else 'DOWN' end as direction, (c1-close)/close*100 as return_1d,
       (c3-close)/close*100 as return_3d, (c5-close)/close*100 as return_5d,
       case when c3 is not null then (least(c1,c2,c3)-close)/close*100 end as max_adverse_3d from ld),
lab as (select symbol, date as signal_date, direction, close as entry_price, return_1d, return_3d, return_5d, max_adverse_3d,
       case when (direction='UP' and return_1d >= 2) or (direction='DOWN' and return_1d <= -2) then 1 else 0 end as hit_2pct_1d,
       case when (direction='UP' and return_3d >= 2) or (direction='DOWN' and return_3d <= -2) then 1 else 0 end as hit_2pct_3d,
       case when (direction='UP' and return_5d >= 2) or (direction='DOWN' and return_5d <= -2) then 1 else 0 end as hit_2pct_5d
       from lr where prev_close > 0 and abs((close-prev_close)/prev_close*100) >= {th})
"""

NORM_CDF = "(case when {x} >= 0 then 1 - {t} else {t} end)"


def norm_cdf(x: str) -> str:
    """Polynomial normal CDF of a SQL expression."""
    k = f"(1/(1+0.2316419*abs({x})))"
    poly = f"{k}*(0.319381530+{k}*(-0.356563782+{k}*(1.781477937+{k}*(-1.821255978+{k}*1.330274429))))"
    tail = f"(exp(-0.5*({x})*({x}))/sqrt(2*pi())*{poly})"
    return NORM_CDF.format(x=f"({x})", t=tail)
