"""Scalar expressions of the domain, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What reports write for a missing number.
MISSING_MARKS = ["", "--", "-", "X", "x"]
FULL_WIDTH, HALF_WIDTH = "０１２３４５６７８９．－", "0123456789.-"
TEXT_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd"]


def parse_number(s: Column) -> Column:
    """Commas, blanks and full-width blanks go; marks and anything unreadable are NULL, never 0."""
    bare = F.translate(F.regexp_replace(s, "[,\\s　]", ""), FULL_WIDTH, HALF_WIDTH)
    return F.when(~bare.isin(MISSING_MARKS), bare.try_cast("double"))


def common_stock_code(s: Column) -> Column:
    """B10"""
    return F.coalesce(F.trim(s).rlike(r"^[1-9]\d{3}$"), F.lit(False))


def provider_article_id(url: Column) -> Column:
    """ptt_{board}_{file}; NULL where the address has another form."""
    pattern = r"/bbs/([^/]+)/([^/]+)\.html"
    return F.when(url.rlike(pattern), F.concat(F.lit("ptt_"), F.regexp_extract(url, pattern, 1), F.lit("_"), F.regexp_extract(url, pattern, 2)))


def url_epoch(url: Column) -> Column:
    """The seconds in an article's address."""
    return F.nullif(F.regexp_extract(url, r"/M\.(\d{9,10})\.", 1), F.lit("")).try_cast("long")


def post_time(url: Column) -> Column:
    """Local time, eight hours ahead of the epoch in the address."""
    return F.timestamp_seconds(url_epoch(url) + 28800).cast("timestamp_ntz")


def parse_time(s: Column) -> Column:
    """H05, its full formats: the first that reads the text."""
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in TEXT_FORMATS])


def provider_symbol(stock_id: Column, market: Column) -> Column:
    """Raises for an unknown market."""
    return F.when(market == "TWSE", F.concat(stock_id, F.lit(".TW"))).when(market == "TPEX", F.concat(stock_id, F.lit(".TWO"))).when(market == "US", stock_id).otherwise(F.raise_error(F.concat(F.lit("unknown market "), F.coalesce(market, F.lit("NULL")))))


def push_count(s: Column) -> Column:
    """爆 is 100, X with anything is -10, numbers are themselves, the rest 0."""
    t = F.trim(s)
    return F.when(t == "爆", 100).when(F.startswith(t, F.lit("X")), -10).otherwise(F.coalesce(t.try_cast("int"), F.lit(0)))


def header(s: Column) -> Column:
    """Cut at a line break tag, all white space out."""
    return F.regexp_replace(F.regexp_replace(s, r"(?i)<br.*$", ""), "[\\s　]", "")


def keyword(s: Column) -> Column:
    """H10"""
    return F.replace(s, F.lit("*"), F.lit(""))


def roc_date(s: Column) -> Column:
    """Year of the republic, month and day to a date."""
    part = F.split(s, "/")
    return F.make_date(F.get(part, F.lit(0)).try_cast("int") + 1911, F.get(part, F.lit(1)).try_cast("int"), F.get(part, F.lit(2)).try_cast("int"))


def class_token(c: Column) -> Column:
    """H15"""
    return F.when(c == -1, "m1").when(c == 0, "0").when(c == 1, "p1").otherwise(F.raise_error("class out of range"))


def close_enough(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Equal within the tolerance, or both NULL."""
    return F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())


def rounded(x: Column, digits: int) -> Column:
    """The double nearest x * 10 ** digits without its fraction, as SQL on doubles has it: 0.285 is 28.499999999999996 hundredths, so 0.28; F.round goes by the digits shown and says 0.29."""
    unit = float(10**digits)
    return F.round(x * unit) / unit


def sentiment_band(s: Column) -> Column:
    """NULL counts as neutral."""
    return F.when(s >= 0.6, "positive").when(s <= 0.4, "negative").otherwise("neutral")


def bullishness(pos: Column, neg: Column) -> Column:
    """D04"""
    return F.log((1 + pos) / (1 + neg))


def agreement(pos: Column, neg: Column) -> Column:
    """0 where nothing is said either way."""
    ratio = F.try_divide(pos - neg, pos + neg)
    return F.when(pos + neg == 0, F.lit(0.0)).otherwise(1 - F.sqrt(1 - F.least(F.greatest(ratio * ratio, F.lit(0.0)), F.lit(1.0))))


def previous_weekday(d: Column) -> Column:
    """H12"""
    w = F.weekday(d)
    return F.date_sub(d, F.when(w == 0, 3).when(w == 6, 2).otherwise(1))


def forum_time(s: Column, reference: Column) -> Column:
    """H05 whole: a full stamp, a bare day at noon of the year that the reference (timestamp without zone) suggests, else the reference.

    Early in a year a bare October to December is the year before's.
    """
    t = F.trim(s)
    stamp = F.regexp_extract(t, r"^[A-Z][a-z]{2} +([A-Z][a-z]{2}) +(\d{1,2}) +(\d{2}:\d{2}:\d{2}) +(\d{4})$", 0)
    part = lambda i: F.regexp_extract(t, r"^[A-Z][a-z]{2} +([A-Z][a-z]{2}) +(\d{1,2}) +(\d{2}:\d{2}:\d{2}) +(\d{4})$", i)
    long_form = F.when(stamp != "", F.try_to_timestamp(F.concat_ws(" ", part(4), part(1), F.lpad(part(2), 2, "0"), part(3)), F.lit("yyyy MMM dd HH:mm:ss")))
    plain = [F.when(t.rlike(p), F.try_to_timestamp(t, F.lit(f))) for p, f in ((r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"), (r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$", "yyyy/MM/dd HH:mm:ss"), (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"), (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"))]
    month, day = F.regexp_extract(t, r"^(\d{1,2})[/-](\d{1,2})$", 1).try_cast("int"), F.regexp_extract(t, r"^(\d{1,2})[/-](\d{1,2})$", 2).try_cast("int")
    year = F.year(reference) - F.when((F.month(reference) <= 3) & (month >= 10), 1).otherwise(0)
    noon = F.try_make_timestamp_ntz(year, month, day, F.lit(12), F.lit(0), F.lit(0))
    return F.coalesce(long_form.cast("timestamp_ntz"), *[p.cast("timestamp_ntz") for p in plain], noon, reference.cast("timestamp_ntz"))


def market_of(source: Column) -> Column:
    """The market that a price source reports; the job fails for an unknown one."""
    return F.when(source == "twse_mi_index", "TWSE").when(source == "tpex_daily_quotes", "TPEX").otherwise(F.raise_error(F.concat(F.lit("unknown source "), F.coalesce(source, F.lit("NULL")))))


def weekdays_between(last: Column, target: Column, most: int = 30) -> Column:
    """Weekdays after `last` up to `target`; the job fails beyond `most` of them."""
    days = F.filter(F.when(last < target, F.sequence(F.date_add(last, 1), target)).otherwise(F.array().cast("array<date>")), lambda d: F.weekday(d) < 5)
    return F.when(F.size(days) > most, F.raise_error(F.lit("too many days to fill"))).otherwise(days)


def next_run(now: Column, hour: int = 15, minute: int = 35) -> Column:
    """The next weekday moment at the hour, today's if it is still ahead."""
    today, w = F.to_date(now), F.weekday(now)
    early = (w < 5) & (F.hour(now) * 60 + F.minute(now) < hour * 60 + minute)
    ahead = F.when(w == 4, 3).when(w == 5, 2).otherwise(1)
    return F.date_add(today, F.when(early, 0).otherwise(ahead)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute))


def cutoff_seconds(text: str | None) -> int:
    """Seconds of a HH:MM or HH:MM:SS cutoff, 15:30 where it can't be read."""
    import re

    m = re.fullmatch(r"\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*", text or "")
    h, i, s = (int(x or 0) for x in m.groups()) if m else (15, 30, 0)
    return h * 3600 + i * 60 + s if h < 24 and i < 60 and s < 60 else 55_800


def failure_kind(message: Column) -> Column:
    """The daily quota before the general one, as its message holds both; then what may be tried again."""
    m = F.coalesce(message, F.lit(""))
    low = F.lower(m)
    code = F.regexp_extract(m, r"HTTP (\d{3})", 1).try_cast("int")
    return F.when(F.contains(m, F.lit("PerDay")), "daily_quota").when(F.contains(low, F.lit("quota")), "quota").when(code.between(500, 599), "retriable").when(code.isNotNull(), "refused").when(low.rlike("timeout|timed out|connection|tls"), "retriable").otherwise("other")
