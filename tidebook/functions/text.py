"""Name classification, number cleaning and JSON maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebook.functions.exprs import col

# Keyword lists; order decides which entry wins.
FUND_HOUSES = [
    "SBI", "HDFC", "ICICI Prudential", "Axis", "Kotak", "Nippon India", "Mirae Asset", "Aditya Birla Sun Life",
    "UTI", "DSP", "Franklin Templeton", "Tata", "IDFC", "Sundaram", "Canara Robeco", "Invesco", "Motilal Oswal",
    "Edelweiss", "Parag Parikh", "Quant", "PGIM India", "Bandhan", "Navi", "WhiteOak", "Baroda BNP Paribas",
    "LIC", "JM Financial", "ITI", "Quantum", "Mahindra Manulife", "NJ", "Trust", "Bajaj Finserv", "Old Bridge",
    "Samco", "360 ONE", "HSBC", "Union", "BOI AXA",
]
SCHEME_TYPES = {
    "Equity": ["EQUITY", "FLEXI CAP", "LARGE CAP", "MID CAP", "SMALL CAP", "MULTI CAP", "ELSS", "FOCUSED", "THEMATIC",
               "SECTORAL", "CONTRA", "VALUE", "DIVIDEND YIELD"],
    "Debt": ["DEBT", "BOND", "GILT", "LIQUID", "MONEY MARKET", "OVERNIGHT", "ULTRA SHORT", "LOW DURATION",
             "SHORT DURATION", "MEDIUM DURATION", "LONG DURATION", "CREDIT RISK", "BANKING AND PSU", "CORPORATE BOND",
             "DYNAMIC BOND", "FLOATING RATE", "FIXED MATURITY"],
    "Hybrid": ["HYBRID", "BALANCED", "AGGRESSIVE", "CONSERVATIVE", "MULTI ASSET", "EQUITY SAVINGS", "ARBITRAGE"],
    "Commodity": ["GOLD", "SILVER", "COMMODITY"],
    "FoF": ["FUND OF FUND", "FOF", "OVERSEAS", "INTERNATIONAL", "GLOBAL"],
    "Index/ETF": ["INDEX", "ETF", "NIFTY", "SENSEX", "NEXT 50"],
}
SCHEME_CATEGORIES = {
    "ELSS": "ELSS", "LIQUID": "Liquid", "OVERNIGHT": "Overnight", "ULTRA SHORT": "Ultra Short Duration",
    "LOW DURATION": "Low Duration", "SHORT DURATION": "Short Duration", "MEDIUM DURATION": "Medium Duration",
    "LONG DURATION": "Long Duration", "GILT": "Gilt", "CREDIT RISK": "Credit Risk", "CORPORATE BOND": "Corporate Bond",
    "BANKING AND PSU": "Banking & PSU", "DYNAMIC BOND": "Dynamic Bond", "FLOATING RATE": "Floating Rate",
    "ARBITRAGE": "Arbitrage", "MULTI ASSET": "Multi Asset", "BALANCED ADVANTAGE": "Balanced Advantage",
    "AGGRESSIVE HYBRID": "Aggressive Hybrid", "CONSERVATIVE HYBRID": "Conservative Hybrid",
    "EQUITY SAVINGS": "Equity Savings", "LARGE AND MID": "Large & Mid Cap", "LARGE CAP": "Large Cap",
    "MID CAP": "Mid Cap", "SMALL CAP": "Small Cap", "MULTI CAP": "Multi Cap", "FLEXI CAP": "Flexi Cap",
    "FOCUSED": "Focused", "CONTRA": "Contra", "VALUE": "Value", "DIVIDEND YIELD": "Dividend Yield",
    "THEMATIC": "Thematic", "SECTORAL": "Sectoral", "INDEX": "Index", "ETF": "ETF", "GOLD": "Gold", "SILVER": "Silver",
    "FUND OF FUND": "Fund of Funds", "FOF": "Fund of Funds", "INTERNATIONAL": "International",
    "OVERSEAS": "International",
}


def first_keyword(text: Column, mapping: Sequence[tuple[str, str]], otherwise: Column) -> Column:
    """Label of the first keyword the text contains."""
    t = F.upper(text)
    return F.coalesce(*[F.when(t.contains(k), F.lit(v)) for k, v in mapping], otherwise)


def fund_house(name: str | Column, houses: Sequence[str] = FUND_HOUSES) -> Column:
    n = col(name)
    head = F.trim(F.substring_index(F.substring_index(n, " - ", 1), "(", 1))
    words = F.filter(F.split(head, r"\s+"), lambda w: w != "")
    return first_keyword(n, [(h.upper(), h) for h in houses], F.array_join(F.slice(words, 1, 2), " "))


def scheme_type(name: str | Column) -> Column:
    pairs = [(k, label) for label, keys in SCHEME_TYPES.items() for k in keys]
    return first_keyword(col(name), pairs, F.lit("Other"))


def scheme_category(name: str | Column) -> Column:
    return first_keyword(col(name), list(SCHEME_CATEGORIES.items()), F.lit("Other"))


def relevant_scheme(name: str | Column) -> Column:
    n = F.upper(col(name))
    growth = n.contains("GROWTH")
    fof = n.contains("FUND OF FUND") | n.contains(" FOF") | n.startswith("FOF ")
    abroad = n.contains("OVERSEAS") | n.contains("INTERNATIONAL") | n.contains("GLOBAL")
    return n.contains("ETF") | (growth & (n.contains("DIRECT") | fof | abroad))


def clean_number(c: str | Column) -> Column:
    """Thousands commas and blanks removed; anything unparsable, NaN or
    infinite becomes 0."""
    v = F.regexp_replace(F.trim(col(c).cast("string")), ",", "").try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def any_date(c: str | Column, formats: Sequence[str]) -> Column:
    """First format that parses, else NULL."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.trim(col(c)), F.lit(f))) for f in formats])


def valid_id(c: str | Column, pattern: str = r"^[A-Za-z0-9_.\-^&]{1,40}$") -> Column:
    return F.coalesce(col(c).rlike(pattern), F.lit(False))


def feature_map(c: str | Column) -> Column:
    """JSON object of numbers to a map; bad JSON gives NULL."""
    return F.from_json(col(c), "map<string,double>")


def feature_json(names: Sequence[str]) -> Column:
    """Struct of features to JSON; NULL and NaN features are left out."""
    return F.to_json(F.struct(*[F.when(~F.isnan(F.col(n)), F.col(n)).alias(n) for n in names]))


def missing_features(c: str | Column, names: Sequence[str]) -> Column:
    """Names that are absent or zero in a JSON feature map."""
    m = feature_map(c)
    arr = F.array(*[F.lit(n) for n in names])
    return F.filter(arr, lambda n: F.coalesce(F.try_element_at(m, n), F.lit(0.0)) == 0)
