"""Queries of partitioned writes, exact quantiles, Merkle prints, block scans, calibrators, boosted trees and stored models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.operators import boosting, calibration, indicators, learners, merges, merkle, partitioned, selection, stored, universe
from barograph.plans.prices import SQL_TB, SQL_UNIVERSE
from barograph.plans.registry import query
from barograph.sources.fixtures import Views
from barograph.sources.shared import new_path

UNIVERSE = "effective_date date, stock_id string, median_turnover long, observation_days long, rank int, included boolean, exclusion_reason string"


@query("A26_snapshot_partitions", SQL_UNIVERSE + """, after AS (SELECT effective_date, stock_id, CASE WHEN year(effective_date) = 1996 AND rank > 10 THEN NULL ELSE rank END AS rank,
  CASE WHEN year(effective_date) = 1996 AND (rank > 10 OR exclusion_reason = 'outside_top_15') THEN 'outside_top_10' ELSE exclusion_reason END AS reason FROM universe)
SELECT effective_date, count(*) AS n, count(rank) AS included, md5(string_agg(stock_id || '|' || coalesce(CAST(rank AS VARCHAR), '') || '|' || coalesce(reason, ''), chr(10) ORDER BY stock_id)) AS print, year(effective_date) <> 1996 AS untouched FROM after GROUP BY 1""")
def snapshot_partitions(v: Views) -> DataFrame:
    """All snapshots are stored; those of 1996 come again with ten places instead of fifteen, twice under one token. Other partitions keep their files."""
    t = partitioned.Table(v.spark, new_path(v.spark, "universe"), UNIVERSE, ["effective_date", "stock_id"], "effective_date")
    built = lambda top: universe.build(v.bars, top=top, code_pattern=r"^Brand#[1-9][0-9]*$")
    t.merge(built(15), "first")
    before = t.files().withColumnsRenamed({"print": "_p"}).drop("files").collect()  # a row a month
    for _ in range(2):
        t.merge(built(10).where(F.year("effective_date") == 1996), "second")
    was = v.spark.createDataFrame(before, "effective_date date, _p string")
    same = t.files().join(was, "effective_date", "left").select("effective_date", F.coalesce(F.col("print") == F.col("_p"), F.lit(False)).alias("untouched"))
    row = F.concat_ws("|", "stock_id", F.coalesce(F.col("rank").cast("string"), F.lit("")), F.coalesce("exclusion_reason", F.lit("")))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("stock_id", row.alias("row")))), lambda x: x["row"]), "\n")  # one snapshot's stocks
    return t.read().groupBy("effective_date").agg(F.count(F.lit(1)).alias("n"), F.count("rank").alias("included"), F.md5(rows.cast("binary")).alias("print")).join(same, "effective_date")


LABELS = "stock_id string, trade_date date, label_reason string, triple_barrier int, year int"


@query("A22_affected_rows", ", t AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) <= 6) SELECT count(*) FILTER (volume % 11 <> 0) AS affected, count(*) AS expected, count(*) FILTER (volume % 11 <> 0) = count(*) AS complete FROM t")
def affected_rows(v: Views) -> DataFrame:
    """Tail labels are written to a table that lacks some of their rows; the update says how many it reached."""
    t = partitioned.Table(v.spark, new_path(v.spark, "labels"), LABELS, ["stock_id", "trade_date"], "year")
    labels = lambda df: df.select("stock_id", "trade_date", "label_reason", "triple_barrier", F.year("trade_date").alias("year"))
    t.merge(labels(indicators.triple_barrier(v.bars.where("volume % 11 <> 0"))), "base", "insert")
    tail = indicators.tail_labels(v.bars, 6)
    counts = t.merge(labels(tail), "tail", "update", ["label_reason", "triple_barrier"])
    return tail.agg(F.lit(counts["updated"]).cast("long").alias("affected"), F.count(F.lit(1)).alias("expected")).withColumn("complete", F.col("affected") == F.col("expected"))


@query("A22_tail_written", SQL_TB + "SELECT l.stock_id, l.trade_date, l.label_reason, l.triple_barrier FROM labels3 l QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) <= 6")
def tail_written(v: Views) -> DataFrame:
    """Labels made before the last five days came, and the tail's update: the last six days read back."""
    t = partitioned.Table(v.spark, new_path(v.spark, "labels"), LABELS, ["stock_id", "trade_date"], "year")
    labels = lambda df: df.select("stock_id", "trade_date", "label_reason", "triple_barrier", F.year("trade_date").alias("year"))
    t.merge(labels(indicators.triple_barrier(v.bars)).withColumns({"label_reason": F.lit("insufficient_data"), "triple_barrier": F.lit(None).cast("int")}), "base", "insert")
    t.merge(labels(indicators.tail_labels(v.bars, 6)), "tail", "update", ["label_reason", "triple_barrier"])
    return indicators.tail(t.read(), 6).select("stock_id", "trade_date", "label_reason", "triple_barrier")


PRICES = "stock_id string, trade_date date, close_price double, source string, year int"


@query("A15_lineage_upsert", """, n AS (SELECT *, CASE volume % 4 WHEN 0 THEN 'twse_mi_index' WHEN 1 THEN 'tpex_daily_quotes' WHEN 2 THEN 'rumour' END AS source FROM bars)
SELECT stock_id, trade_date, CASE WHEN volume % 4 < 2 THEN close_price + 1 ELSE close_price END AS close_price, CASE WHEN volume % 4 < 2 THEN source ELSE 'yfinance' END AS source FROM n WHERE volume % 4 < 2 OR volume % 3 <> 1
UNION ALL SELECT stock_id, trade_date, NULL, 'refused: ' || coalesce(source, 'NULL') FROM n WHERE volume % 4 >= 2""")
def lineage_upsert(v: Views) -> DataFrame:
    """Prices are there from an older source; new ones name theirs, some one that is not known or none: those are refused and told."""
    t = partitioned.Table(v.spark, new_path(v.spark, "prices"), PRICES, ["stock_id", "trade_date"], "year")
    b = v.bars.select("stock_id", "trade_date", "close_price", "volume", F.year("trade_date").alias("year"))
    t.merge(b.where("volume % 3 <> 1").withColumn("source", F.lit("yfinance")), "old")
    k = F.col("volume") % 4
    new = b.withColumn("close_price", F.col("close_price") + 1).withColumn("source", F.when(k == 0, "twse_mi_index").when(k == 1, "tpex_daily_quotes").when(k == 2, "rumour"))
    known, refused = merges.by_known_source(new, "source", ["yfinance", "twse_mi_index", "tpex_daily_quotes"])
    t.merge(known, "new")
    told = refused.select("stock_id", "trade_date", F.lit(None).cast("double").alias("close_price"), F.concat(F.lit("refused: "), F.coalesce("source", F.lit("NULL"))).alias("source"))
    return t.read().select("stock_id", "trade_date", "close_price", "source").unionByName(told)


ARTICLES = "article_id long, push_count long, boo_count long, source string"


@query("A16_A19_partitioned_writes", """, s AS (SELECT article_id, source, CASE WHEN article_id % 3 <> 0 THEN push_count END AS old, article_id % 2 = 0 AS had FROM articles)
SELECT 'once' AS step, CAST(0 AS BIGINT) AS inserted, count(*) FILTER (had AND old IS NULL) AS updated, count(*) FILTER (had) AS total FROM s UNION ALL SELECT 'insert', count(*) FILTER (NOT had), 0, count(*) FROM s UNION ALL SELECT 'again', 0, 0, count(*) FROM s""")
def partitioned_writes(v: Views) -> DataFrame:
    """Counts of three writes: NULLs filled once, missing rows inserted, and the same insert under another token."""
    t = partitioned.Table(v.spark, new_path(v.spark, "articles"), ARTICLES, ["article_id"], "source")
    a = v.articles.select("article_id", "push_count", "boo_count", "source")
    t.merge(a.where("article_id % 2 = 0").withColumn("push_count", F.when(F.col("article_id") % 3 != 0, F.col("push_count"))), "base")
    new, out = a.withColumn("push_count", F.lit(7).cast("long")), []
    for step, mode in (("once", "once"), ("insert", "insert"), ("again", "insert")):
        n = t.merge(new, step, mode, ["push_count"] if mode == "once" else None)
        out.append(t.read().agg(F.lit(step).alias("step"), F.lit(n["inserted"]).cast("long").alias("inserted"), F.lit(n["updated"]).cast("long").alias("updated"), F.count(F.lit(1)).alias("total")).first())
    return v.spark.createDataFrame(out, "step string, inserted long, updated long, total long")


@query("D39_I14_exact_quantiles", ", q AS (SELECT model, quantile_cont(vol, [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]) AS q FROM preds GROUP BY 1) SELECT model, CAST(i AS INTEGER) AS i, round(q[i + 1], 8) AS value FROM q, range(7) r(i)")
def exact_quantiles(v: Views) -> DataFrame:
    """Small bins and arrays, so that ranges are refined over several levels here too."""
    q = selection.quantiles(v.preds, "vol", [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0], ["model"], bins=16, gather=8)
    return q.select("model", F.posexplode("q").alias("i", "value")).withColumn("value", F.round("value", 8))


@query("D16_changed_months", ", c AS (SELECT stock_id, strftime(trade_date, '%Y-%m') AS month, count(*) AS rows_a, count(*) FILTER (volume % 89 <> 0) AS rows_b, count(*) FILTER (volume % 97 = 0 OR volume % 89 = 0) AS k FROM bars GROUP BY 1, 2) SELECT stock_id, month, rows_a, rows_b FROM c WHERE k > 0")
def changed_months(v: Views) -> DataFrame:
    """A copy of the bars with some volumes changed and some rows gone: found by descent from the two roots."""
    columns = ["stock_id", "trade_date", "volume"]
    b = v.bars.select(*columns)
    other = b.where("volume % 89 <> 0").withColumn("volume", F.when(F.col("volume") % 97 == 0, F.col("volume") + 1).otherwise(F.col("volume")))
    return merkle.changed(merkle.Tree(b, columns), merkle.Tree(other, columns))


SQL_ISO = """, g AS (SELECT k, x, sum(hit) AS s, count(*) AS n FROM (SELECT k, CASE k WHEN 1 THEN p WHEN 0 THEN round(1 - p, 3) ELSE round(abs(2 * p - 1), 3) END AS x, CAST(y3 = k AS INTEGER) AS hit FROM preds, (VALUES (-1), (0), (1)) c(k) WHERE fold < 3) GROUP BY 1, 2),
cum AS (SELECT *, sum(s) OVER w AS cs, sum(n) OVER w AS cn, row_number() OVER (PARTITION BY k ORDER BY x) AS i FROM g WINDOW w AS (PARTITION BY k ORDER BY x ROWS UNBOUNDED PRECEDING)),
pairs AS (SELECT a.k, a.i AS j, b.i AS m, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS mean FROM cum a JOIN cum b ON a.k = b.k AND b.i >= a.i),
least_ AS (SELECT k, j, m, min(mean) OVER (PARTITION BY k, j ORDER BY m DESC ROWS UNBOUNDED PRECEDING) AS lo FROM pairs),
iso AS (SELECT l.k, c.x, max(lo) AS v FROM least_ l JOIN cum c ON c.k = l.k AND c.i = l.m GROUP BY 1, 2),
told AS (SELECT event_id, c.k, CASE c.k WHEN 1 THEN p WHEN 0 THEN round(1 - p, 3) ELSE round(abs(2 * p - 1), 3) END AS x FROM preds, (VALUES (-1), (0), (1)) c(k) WHERE fold >= 3),
xs AS (SELECT DISTINCT k, x FROM told),
ends AS (SELECT xs.k, xs.x, max(iso.x) FILTER (iso.x <= xs.x) AS a, min(iso.x) FILTER (iso.x >= xs.x) AS b FROM xs JOIN iso USING (k) GROUP BY 1, 2),
cal AS (SELECT e.k, e.x, CASE WHEN a IS NULL THEN vb.v WHEN b IS NULL OR a = b THEN va.v ELSE va.v + (vb.v - va.v) * (e.x - a) / (b - a) END AS v FROM ends e LEFT JOIN iso va ON va.k = e.k AND va.x = a LEFT JOIN iso vb ON vb.k = e.k AND vb.x = b)
"""


@query("I17_I18_calibration", SQL_ISO + "SELECT event_id, x AS p, round(v, 8) AS calibrated FROM told JOIN cal USING (k, x) WHERE k = 1")
def isotonic_calibration(v: Views) -> DataFrame:
    """Isotonic calibration of class 1 against the rest, fitted on folds 0 to 2 and applied to 3 to 5."""
    df = v.preds.withColumn("hit", (F.col("y3") == 1).cast("int"))
    calibrator = calibration.fit(df.where("fold < 3"), "p", "hit", "fold", "isotonic", (0, 1, 2))
    return df.where("fold >= 3").select("event_id", "p", F.round(calibrator(F.col("p")), 8).alias("calibrated"))


@query("I17_M15_one_vs_rest", SQL_ISO + "SELECT event_id, round(v_m1 / t, 8) AS p_m1, round(v_0 / t, 8) AS p_0, round(v_1 / t, 8) AS p_1 FROM (SELECT *, CASE WHEN v_m1 + v_0 + v_1 >= 1e-9 THEN v_m1 + v_0 + v_1 END AS t FROM (SELECT event_id, max(v) FILTER (k = -1) AS v_m1, max(v) FILTER (k = 0) AS v_0, max(v) FILTER (k = 1) AS v_1 FROM told JOIN cal USING (k, x) GROUP BY 1))")
def three_classes(v: Views) -> DataFrame:
    """Three scores a row, one calibrator a class, shares of their sum; NULL where all are 0."""
    p = F.col("p")
    df = v.preds.withColumns({"s1": p, "s0": F.round(1 - p, 3), "s_1": F.round(F.abs(2 * p - 1), 3)})
    calibration.disjoint((0, 1, 2), (3, 4, 5))
    each = calibration.one_vs_rest(calibration.only_folds(df.where("fold < 3"), "fold", (0, 1, 2)), {-1: "s_1", 0: "s0", 1: "s1"}, "y3")
    told = df.where("fold >= 3").select("event_id", *[each[k](F.col(c)).alias(n) for k, c, n in ((-1, "s_1", "p_m1"), (0, "s0", "p_0"), (1, "s1", "p_1"))])
    total = F.col("p_m1") + F.col("p_0") + F.col("p_1")
    return told.select("event_id", *[F.round(F.when(total >= 1e-9, F.col(c) / total), 8).alias(c) for c in ("p_m1", "p_0", "p_1")])


BOOSTED = {"features": ["p", "vol", "ret"], "bins": 8, "rounds": 3, "depth": 2, "rate": 0.3, "penalty": 1.0}


def _sql_boosted(features: list[str], bins: int, rounds: int, depth: int, rate: float, penalty: float) -> str:
    """The same rounds as a chain of tables."""
    q = ", ".join(f"{k / bins!r}" for k in range(1, bins))
    out = [f"{c}_q AS (SELECT list_distinct(quantile_cont({c}, [{q}])) AS e FROM preds WHERE fold = (SELECT min(fold) FROM preds))" for c in features]
    b = ", ".join(f"len(list_filter({c}_q.e, lambda t: t < {c})) AS b{i}" for i, c in enumerate(features))
    out.append(f"r0 AS MATERIALIZED (SELECT event_id, fold, y, m.k AS m, fold < m.k AS train, {b}, 0.0::DOUBLE AS margin FROM preds JOIN (SELECT DISTINCT fold AS k FROM preds WHERE fold > (SELECT min(fold) FROM preds)) m ON fold <= m.k, {', '.join(f'{c}_q' for c in features)})")
    for r in range(rounds):
        cols = ", ".join(f"b{i}" for i in range(len(features)))
        out.append(f"n{r}_0 AS MATERIALIZED (SELECT *, 0 AS node, CAST(round((1 / (1 + exp(-margin)) - y) * 1000000) AS BIGINT) AS g, CAST(round(1 / (1 + exp(-margin)) * (1 - 1 / (1 + exp(-margin))) * 1000000) AS BIGINT) AS h FROM r{r})")
        for level in range(depth):
            t = f"n{r}_{level}"
            each = " UNION ALL ".join(f"SELECT m, node, {i} AS f, b{i} AS b, g, h FROM {t} WHERE train" for i in range(len(features)))
            out.append(f"s{t} AS MATERIALIZED (SELECT m, node, f, b, sum(g) AS g, sum(h) AS h FROM ({each}) GROUP BY ALL)")
            out.append(f"c{t} AS (SELECT m, node, f, b, sum(g) OVER w / 1e6::DOUBLE AS gl, sum(h) OVER w / 1e6::DOUBLE AS hl, sum(g) OVER (PARTITION BY m, node, f) / 1e6::DOUBLE AS g, sum(h) OVER (PARTITION BY m, node, f) / 1e6::DOUBLE AS h FROM s{t} WINDOW w AS (PARTITION BY m, node, f ORDER BY b ROWS UNBOUNDED PRECEDING))")
            out.append(f"p{t} AS MATERIALIZED (SELECT m, node, f, b FROM (SELECT *, round(gl * gl / (hl + {penalty}::DOUBLE) + (g - gl) * (g - gl) / (h - hl + {penalty}::DOUBLE) - g * g / (h + {penalty}::DOUBLE), 9) AS gain FROM c{t} WHERE hl > 0 AND h - hl > 0) WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY m, node ORDER BY gain DESC, f, b) = 1)")
            side = "CASE x.f " + " ".join(f"WHEN {i} THEN b{i}" for i in range(len(features))) + " END"
            out.append(f"n{r}_{level + 1} AS MATERIALIZED (SELECT a.event_id, a.fold, a.y, a.m, a.train, {', '.join('a.' + c for c in cols.split(', '))}, a.margin, 2 * a.node + coalesce(CAST({side} > x.b AS INTEGER), 0) AS node, a.g, a.h FROM {t} a LEFT JOIN p{t} x ON x.m = a.m AND x.node = a.node)")
        t = f"n{r}_{depth}"
        out.append(f"l{r} AS MATERIALIZED (SELECT m, node, -(sum(g) / 1e6::DOUBLE) / (sum(h) / 1e6::DOUBLE + {penalty}::DOUBLE) AS v FROM {t} WHERE train GROUP BY 1, 2)")
        out.append(f"r{r + 1} AS MATERIALIZED (SELECT a.event_id, a.fold, a.y, a.m, a.train, {', '.join('a.' + c for c in cols.split(', '))}, a.margin + {rate}::DOUBLE * coalesce(l.v, 0) AS margin FROM {t} a LEFT JOIN l{r} l ON l.m = a.m AND l.node = a.node)")
    return ", " + ",\n".join(out) + f"\nSELECT event_id, fold, round(1 / (1 + exp(-margin)), 6) AS probability FROM r{rounds} WHERE NOT train"


@query("I12_I15_boosted_trees", _sql_boosted(**BOOSTED))
def boosted_trees(v: Views) -> DataFrame:
    """Three rounds of depth two for each fold on the folds before it, all folds at once."""
    o = dict(BOOSTED)
    df = v.preds.select("event_id", "fold", "y", *o["features"])
    return boosting.fit_by_fold(df, o.pop("features"), "y", "fold", "event_id", **o).withColumn("probability", F.round("probability", 6))


@query("I21_I26_stored_model", """, f AS (SELECT stock_id, trade_date, close_price - open_price AS a, (high_price - low_price) AS b, CAST(volume % 100 AS DOUBLE) / 100 AS c, CAST(close_price > open_price AS INTEGER) AS y FROM bars), t AS (SELECT * FROM f WHERE trade_date < DATE '1997-01-01'),
s AS (SELECT count(*) + 0.001::DOUBLE AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) + 0.001 AS aa, sum(a * b) AS ab, sum(b * b) + 0.001 AS bb, sum(2 * y - 1) AS t, sum(a * (2 * y - 1)) AS ta, sum(b * (2 * y - 1)) AS tb FROM t),
d AS (SELECT *, n * (aa * bb - ab * ab) - sa * (sa * bb - ab * sb) + sb * (sa * ab - aa * sb) AS det FROM s),
w AS (SELECT (t * (aa * bb - ab * ab) - sa * (ta * bb - ab * tb) + sb * (ta * ab - aa * tb)) / det AS w0, (n * (ta * bb - ab * tb) - t * (sa * bb - ab * sb) + sb * (sa * tb - ta * sb)) / det AS wa, (n * (aa * tb - ta * ab) - sa * (sa * tb - ta * sb) + t * (sa * ab - aa * sb)) / det AS wb FROM d),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY trade_date DESC) = 1)
SELECT stock_id, trade_date, round(1 / (1 + exp(-least(greatest(w0 + wa * a + wb * b, -10), 10))), 6) AS probability, CASE WHEN 1 / (1 + exp(-(w0 + wa * a + wb * b))) >= 0.5 THEN 'UP' ELSE 'DOWN' END AS call, TRUE AS unchanged FROM l, w""")
def stored_model(v: Views) -> DataFrame:
    """A ridge model of the bars before 1997, stored, read again by its signature and applied to the newest bar of each stock."""
    names = ["a", "b"]
    f = v.bars.select("stock_id", "trade_date", (F.col("close_price") - F.col("open_price")).alias("a"), (F.col("high_price") - F.col("low_price")).alias("b"), (F.col("close_price") > F.col("open_price")).cast("int").alias("y"))
    made = {k: float(x) for k, x in learners.ridge_weights(f.where("trade_date < '1997-01-01'"), names, "y").items()}
    path = new_path(v.spark, "model")
    stored.save(v.spark, path, "ridge", names, "1997-01-01", made)
    read = stored.load(v.spark, path, "ridge", names, "1997-01-01")
    again = {k: read[k] for k in ["bias", *names]}  # summed in the same order
    last = stored.latest_rows(f)
    out = learners.ridge_predict(learners.ridge_predict(last, made).withColumnRenamed("probability", "_was"), again)
    call = F.when(F.col("probability") >= 0.5, "UP").otherwise("DOWN")
    return out.select("stock_id", "trade_date", F.round("probability", 6).alias("probability"), call.alias("call"), (F.col("_was") == F.col("probability")).alias("unchanged"))


@query("H20_file_digests", """, l AS (SELECT stock_id, trade_date, '{"close":' || CAST(CAST(round(close_price * 100) AS BIGINT) AS VARCHAR) || ',"day":"' || trade_date || '","volume":' || volume || '}' AS line FROM bars)
SELECT stock_id AS part, count(*) AS rows, sha256(string_agg(line || chr(10), '' ORDER BY trade_date)) AS sha256 FROM l GROUP BY 1""")
def file_digests(v: Views) -> DataFrame:
    """A panel written as canonical JSON lines, a file a stock, and what its files hold."""
    path = new_path(v.spark, "panel")
    line = F.to_json(F.struct(F.round(F.col("close_price") * 100).cast("long").alias("close"), F.col("trade_date").cast("string").alias("day"), "volume"))
    v.bars.select(F.col("stock_id").alias("part"), "trade_date", line.alias("line")).repartition("part").sortWithinPartitions("part", "trade_date").drop("trade_date").write.partitionBy("part").text(path)
    return stored.text_digests(v.spark, path)
