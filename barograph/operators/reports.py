"""Exchange reports: find the market's table in a JSON payload, name its columns, and parse its rows.

A payload is one JSON text. Its tables come in three shapes: a list `tables`, numbered pairs `fields9` and
`data9`, or one pair of `fields` and `data` (`aaData`, or with capitals). All steps are column expressions, so
payloads are parsed where they lie, each on its own; a table is exploded only after its columns are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.functions import scalar

#: Column names of the two exchanges' reports by meaning, the first match counts.
TWSE_FIELDS = {
    "code": ["證券代號", "股票代號"], "name": ["證券名稱"], "volume": ["成交股數"], "amount": ["成交金額"], "open": ["開盤價"], "high": ["最高價"], "low": ["最低價"], "close": ["收盤價"],
    "txn": ["成交筆數"], "bid": ["最後揭示買價"], "bid_volume": ["最後揭示買量"], "ask": ["最後揭示賣價"], "ask_volume": ["最後揭示賣量"], "pe": ["本益比"],
}
TPEX_FIELDS = {
    "code": ["^代號$"], "name": ["^名稱$"], "open": ["^開盤"], "high": ["^最高$"], "low": ["^最低$"], "close": ["^收盤$"], "volume": ["^成交股數$"], "amount": ["^成交金額"],
    "txn": ["^成交筆數$"], "bid": ["^最後買價$"], "ask": ["^最後賣價$"],
}
REQUIRED = ["code", "open", "high", "low", "close", "volume", "amount"]
_TABLE = "struct<title:string,fields:array<string>,data:array<array<string>>>"


def field_index(fields: Column, patterns: list[str]) -> Column:
    """Position of the first normalised field name that any pattern fits, from 0, or null."""
    at = F.array_position(F.transform(fields, lambda f: scalar.header(f).rlike("|".join(patterns))), F.lit(True))
    return F.when(at > 0, (at - 1).cast("int"))


def _pair(fields: Column, data: Column, shape: Column) -> Column:
    return F.struct(shape.alias("shape"), F.from_json(fields, "array<string>").alias("fields"), F.from_json(data, "array<array<string>>").alias("data"))


def tables(payload: Column) -> Column:
    """All tables of a payload that have fields and rows, as array<struct<shape, fields, data>>."""
    top = F.from_json(payload, "map<string,string>")
    listed = F.coalesce(F.from_json(top["tables"], f"array<{_TABLE}>"), F.array().cast(f"array<{_TABLE}>"))
    listed = F.transform(listed, lambda t, i: F.struct(F.concat(F.lit("tables["), i.cast("string"), F.lit("]")).alias("shape"), t["fields"].alias("fields"), t["data"].alias("data")))
    keys = F.coalesce(F.map_keys(top), F.array().cast("array<string>"))
    numbered = F.array_sort(F.filter(keys, lambda k: k.rlike(r"^fields\d+$") & F.array_contains(keys, F.replace(k, F.lit("fields"), F.lit("data")))))
    numbered = F.transform(numbered, lambda k: _pair(F.get(F.filter(F.map_entries(top), lambda e: e["key"] == k), F.lit(0))["value"], F.get(F.filter(F.map_entries(top), lambda e: e["key"] == F.replace(k, F.lit("fields"), F.lit("data"))), F.lit(0))["value"], k))
    single = F.array(*[_pair(top[f], top[d], F.lit(f"{f}/{d}")) for f, d in (("fields", "data"), ("fields", "aaData"), ("Fields", "Data"))])
    return F.filter(F.concat(listed, numbered, single), lambda t: (F.size(t["fields"]) > 0) & (F.size(t["data"]) > 0))


def market_table(payloads: DataFrame, names: dict[str, list[str]], require: list[str] | None = None, payload: str = "payload") -> DataFrame:
    """Adds shape, fields and data of the longest table that has the required columns; null where none has."""
    need = require or REQUIRED
    fits = lambda t: F.forall(F.array(*[field_index(t["fields"], names[k]) for k in need]), lambda x: x.isNotNull())
    df = payloads.withColumn("_all", F.filter(tables(F.col(payload)), fits))
    longest = F.array_max(F.transform("_all", lambda t, i: F.struct(F.size(t["data"]).alias("n"), (-i).alias("i"))))
    best = F.get("_all", (-longest["i"]).cast("int"))
    return df.withColumn("_best", best).select("*", "_best.shape", "_best.fields", "_best.data").drop("_all", "_best")


def parse_report(payloads: DataFrame, names: dict[str, list[str]], source: str, payload: str = "payload") -> DataFrame:
    """A row for each report row, with `dropped`: why it is not a record, or null.

    payloads: trade_date, payload. Reports without a fitting table give no rows (see `unreadable`). Numbers that
    mark "no trade" are null, never 0; a P/E of 0 means "not applicable" and is null, as are the columns that an
    exchange does not report (TPEx: bid and ask volume, P/E).
    """
    found = market_table(payloads, names, payload=payload).where(F.col("shape").isNotNull())
    at = {k: field_index(F.col("fields"), p) for k, p in names.items()}
    rows = found.select("trade_date", *[v.alias(f"_{k}") for k, v in at.items()], F.explode("data").alias("_row"))
    text = lambda k: F.get("_row", F.col(f"_{k}")) if k in names else F.lit(None).cast("string")
    number = lambda k: scalar.parse_number(text(k))
    whole = lambda k: number(k).cast("long")
    code = F.trim(text("code"))
    pe = number("pe")
    dropped = F.when(~scalar.common_stock_code(code), "code_shape").when(number("volume").isNull() | number("amount").isNull(), "unparseable")
    return rows.select(
        "trade_date", code.alias("stock_id"), F.trim(text("name")).alias("security_name"), number("open").alias("open_price"), number("high").alias("high_price"), number("low").alias("low_price"),
        number("close").alias("close_price"), whole("volume").alias("volume"), whole("amount").alias("turnover_amount"), whole("txn").alias("transactions"), number("bid").alias("best_bid_price"),
        whole("bid_volume").alias("best_bid_volume"), number("ask").alias("best_ask_price"), whole("ask_volume").alias("best_ask_volume"), F.when(pe != 0, pe).alias("pe_ratio"), F.lit(source).alias("source"), dropped.alias("dropped"),
    )


def records(parsed: DataFrame) -> DataFrame:
    """The rows that are written."""
    return parsed.where(F.col("dropped").isNull()).drop("dropped")


def report_stats(parsed: DataFrame) -> DataFrame:
    """What each day's report was reduced to, cause by cause."""
    kept, shape = F.col("dropped").isNull(), F.col("dropped") == "code_shape"
    bare = kept & F.coalesce("open_price", "high_price", "low_price", "close_price").isNull()
    still = kept & (F.col("volume") == 0)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return parsed.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("rows_total"), count(~F.coalesce(shape, F.lit(False))).alias("rows_common_stock"), count(shape).alias("rows_excluded_by_code_shape"), count(F.col("dropped") == "unparseable").alias("rows_unparseable"),
        count(bare).alias("rows_without_prices"), count(still).alias("rows_zero_volume"), count(bare & still).alias("rows_no_trade_at_all"),
    )


def unreadable(payloads: DataFrame, names: dict[str, list[str]], payload: str = "payload") -> DataFrame:
    """Reports in which no table has the required columns, with the shapes that were looked at."""
    found = market_table(payloads, names, payload=payload).where(F.col("shape").isNull())
    return found.select("trade_date", F.transform(tables(F.col(payload)), lambda t: t["shape"]).alias("candidate_shapes"))


def month_scan(rows: DataFrame) -> DataFrame:
    """A stock's month: date of the republic's year, numbers with commas, to canonical columns."""
    n = lambda c: scalar.parse_number(F.col(c))
    return rows.select("stock_id", scalar.roc_date(F.col("date")).alias("trade_date"), n("open").alias("open_price"), n("high").alias("high_price"), n("low").alias("low_price"), n("close").alias("close_price"), n("capacity").cast("long").alias("volume"))
