"""Counter, gauge and histogram analytics over a long table of samples (metric, label, ts, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ledger import micros, table

#: Upper bounds of histogram buckets; the last is infinite.
BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]


def counter(samples: DataFrame, *labels: str) -> DataFrame:
    return samples.groupBy(*labels).agg(F.count("*").alias("total"))


def histogram(samples: DataFrame, *labels: str, bounds: list[float] = BOUNDS) -> DataFrame:
    """labels, le (null: infinite), count of values up to le: cumulative; partial sums meet once a label."""
    sums = [F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = samples.groupBy(*labels).agg(*sums, F.count("value").alias(f"b{len(bounds)}"))
    rows = F.array(*(F.struct(F.lit(b).cast("double").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate([*bounds, None])))
    return wide.select(*labels, F.explode(rows).alias("x")).select(*labels, "x.le", "x.n")


def quantile(buckets: DataFrame, q: float, *labels: str) -> DataFrame:
    """labels and the q-quantile of each cumulative histogram, interpolated inside its bucket; a rank in the infinite
    bucket gives the largest finite bound; an empty histogram gives null."""
    w = Window.partitionBy(*labels).orderBy(F.asc_nulls_last("le"))
    total = F.max("n").over(Window.partitionBy(*labels))
    b = buckets.select(*labels, "le", "n", F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("low"), F.coalesce(F.lag("n").over(w), F.lit(0)).alias("before"), (total * q).alias("rank"))
    inside = b.where((F.col("n") >= F.col("rank")) & (F.col("rank") > 0))
    value = F.when(F.col("le").isNull(), F.col("low")).otherwise(F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("before")) / (F.col("n") - F.col("before")))
    found = inside.groupBy(*labels).agg(F.min_by(value, F.struct(F.col("le").isNull(), "le")).alias("v"))
    return buckets.select(*labels).distinct().join(found, list(labels), "left").select(*labels, F.round("v", 6).alias("quantile"))


def increases(samples: DataFrame, window: Column, *labels: str, seconds: int = 86_400) -> DataFrame:
    """labels, window and the counter's increase in it: the sum of differences of neighbours, where a fall counts as a
    restart from zero.  The window of a difference is that of its later sample; boundaries are not extrapolated.

    Neighbours are found within spans of seconds, and over one row a span, so that a label's samples are never in one task.
    """
    rows = samples.withColumn("_span", F.floor(micros("ts") / (seconds * 1_000_000)).cast("bigint"))
    last = rows.groupBy(*labels, "_span").agg(F.max_by("value", F.struct("ts", "seq")).alias("_last"))
    last = last.withColumn("_earlier", F.lag("_last").over(Window.partitionBy(*labels).orderBy("_span")))
    last = last.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(labels)), F.col("_span").alias("_s"), "_earlier")
    own = rows.withColumn("_before", F.lag("value").over(Window.partitionBy(*labels, "_span").orderBy("ts", "seq")))
    own = own.join(last, [F.col("_span") == F.col("_s"), *(F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(labels))])
    before = F.coalesce("_before", "_earlier")
    delta = F.when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    return own.select(*labels, window.alias("window"), delta.alias("d")).where("d IS NOT NULL").groupBy(*labels, "window").agg(F.sum("d").alias("increase"))


def day(c: str) -> Column:
    """Whole days since 1970 of a timestamp without zone."""
    return F.floor(micros(c) / 86_400_000_000).cast("bigint")


def rates(samples: DataFrame, *labels: str) -> DataFrame:
    """Per-second increase by day."""
    return increases(samples, day("ts"), *labels).select(*labels, "window", F.round(F.col("increase") / 86_400, 8).alias("rate"))


def error_ratio(samples: DataFrame, good: str) -> DataFrame:
    """100 x the increase of series whose label does not match good (a whole-label pattern), over that of all, by day."""
    inc = increases(samples, day("ts"), "label")
    bad = F.sum(F.when(~F.col("label").rlike(f"^(?:{good})$"), F.col("increase")).otherwise(0.0))
    return inc.groupBy("window").agg(F.round(100 * bad / F.sum("increase"), 6).alias("ratio"))


def exposition(samples: DataFrame, name: str) -> DataFrame:
    """The lines of a text exposition of a counter by label."""
    return counter(samples, "label").select(F.concat(F.lit(name), F.lit('{label="'), F.col("label"), F.lit('"} '), F.col("total").cast("string")).alias("line"))


def escaped(c: Column) -> Column:
    """A label's value as the text exposition writes it."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def exposition_of(kind: str, name: str, help_text: str, values: DataFrame) -> DataFrame:
    """place, line: the HELP and TYPE lines of a metric, and a line for each row of values (suffix, labels: a map, value)."""
    told = F.array_join(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"'))), ",")
    lines = values.select(F.lit(2).alias("place"), F.concat(F.lit(name), "suffix", F.when(F.size("labels") > 0, F.concat(F.lit("{"), told, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("line"))
    head = values.sparkSession.createDataFrame([(0, f"# HELP {name} {help_text}"), (1, f"# TYPE {name} {kind}")], "place int, line string")
    return head.unionByName(lines)


def requests_by(requests: DataFrame, *labels: str) -> DataFrame:
    """How many requests each combination of labels has, and their mean latency."""
    return requests.groupBy(*labels).agg(F.count("*").alias("total"), F.round(F.avg("latency"), 6).alias("mean_latency"))


def bucket_counters(samples: DataFrame, *labels: str, bounds: list[float] = BOUNDS) -> DataFrame:
    """A histogram's counters over time: labels, le (null: infinite), ts, seq and the count of values up to le so far."""
    w = Window.partitionBy(*labels).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    counts = [F.count_if(F.col("value") <= b if b is not None else F.col("value").isNotNull()).over(w).cast("double").alias(f"_b{i}") for i, b in enumerate([*bounds, None])]
    rows = F.array(*(F.struct(F.lit(b).cast("double").alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate([*bounds, None])))
    return samples.select(*labels, "ts", "seq", *counts).select(*labels, "ts", "seq", F.explode(rows).alias("x")).select(*labels, "ts", "seq", "x.le", F.col("x.n").alias("value"))


def rate_quantile(counters: DataFrame, q: float, window: Column, label: str, series: str) -> DataFrame:
    """label, window and the q-quantile of the histogram that the series' bucket increases in the window add up to."""
    inc = increases(counters, window, label, series, "le").groupBy(label, "window", "le").agg(F.sum("increase").alias("n"))
    return quantile(inc, q, label, "window")


def samples(s, d) -> DataFrame:
    return table(s, d, "events").select(F.col("event_type").alias("label"), F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"), "value")


def _exposition(rows: DataFrame) -> DataFrame:
    label = F.create_map(F.lit("label"), F.concat(F.col("label"), F.lit('"\\')))
    counted = counter(rows, "label").select(F.lit("").alias("suffix"), label.alias("labels"), F.col("total").alias("value"))
    gauge = rows.agg(F.max("seq").alias("value")).select(F.lit("").alias("suffix"), F.create_map().cast("map<string,string>").alias("labels"), "value")
    le = F.coalesce(F.col("le").cast("int").cast("string"), F.lit("+Inf"))
    buckets = histogram(rows, "label").select(F.lit("_bucket").alias("suffix"), F.create_map(F.lit("label"), F.col("label"), F.lit("le"), le).alias("labels"), F.col("n").alias("value"))
    sums = rows.groupBy("label").agg(F.count("value").alias("c"), F.sum("session").alias("s")).select(F.explode(F.array(F.struct(F.lit("_sum").alias("x"), F.col("s").alias("v")), F.struct(F.lit("_count").alias("x"), F.col("c").alias("v")))).alias("y"), "label")
    sums = sums.select(F.col("y.x").alias("suffix"), F.create_map(F.lit("label"), F.col("label")).alias("labels"), F.col("y.v").alias("value"))
    parts = [exposition_of("counter", "events_total", "Events.", counted), exposition_of("gauge", "last_event", "Last event.", gauge), exposition_of("histogram", "latency", "Latency.", buckets.unionByName(sums))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {
    "counter_by_label": lambda s, d: counter(samples(s, d), "label"),
    "latency_histogram": lambda s, d: histogram(samples(s, d), "label"),
    "gauge_latest": lambda s, d: samples(s, d).groupBy("session").agg(F.max_by("value", F.struct("ts", "seq")).alias("value")),
    "gauge_avg": lambda s, d: samples(s, d).groupBy("session").agg(F.max_by("value", F.struct("ts", "seq")).alias("value")).agg(F.round(F.avg("value"), 6).alias("mean")),
    "metrics_exposition": lambda s, d: exposition(samples(s, d), "events_total"),
    "prom_rate": lambda s, d: rates(samples(s, d), "session"),
    "prom_rate_by_label": lambda s, d: increases(samples(s, d), day("ts"), "label", "session").groupBy("label", "window").agg(F.round(F.sum("increase") / 86_400, 8).alias("rate")),
    "prom_rate_two_labels": lambda s, d: increases(samples(s, d).withColumn("kind", F.col("session") % 3), day("ts"), "label", "kind", "session").groupBy("label", "kind", "window").agg(F.round(F.sum("increase") / 86_400, 8).alias("rate")),
    "prom_rate_filtered": lambda s, d: rates(samples(s, d).where("label = 'purchase'"), "session"),
    "prom_rate_quantile_50": lambda s, d: rate_quantile(bucket_counters(samples(s, d), "label", "session"), 0.5, day("ts"), "label", "session"),
    "prom_rate_quantile_99": lambda s, d: rate_quantile(bucket_counters(samples(s, d), "label", "session"), 0.99, day("ts"), "label", "session"),
    "requests_by_status": lambda s, d: requests_by(samples(s, d).select(F.when(F.col("session") % 5 == 0, "NOT_FOUND").otherwise("SUCCESS").alias("status"), F.col("label").alias("type"), F.col("value").alias("latency")), "status", "type"),
    "metrics_exposition_whole": lambda s, d: _exposition(samples(s, d)),
    "prom_increase": lambda s, d: increases(samples(s, d), F.floor(micros("ts") / 3_600_000_000).cast("bigint"), "label").select("label", "window", F.round("increase", 4).alias("increase")),
    "prom_histogram_quantile": lambda s, d: quantile(histogram(samples(s, d), "label"), 0.95, "label"),
    "prom_error_ratio": lambda s, d: error_ratio(samples(s, d), "click|view"),
    "prom_mean_latency": lambda s, d: samples(s, d).groupBy("label").agg(F.round(F.sum("value") / F.count("value"), 6).alias("mean")),
}


def _inc(labels: str, window: str) -> str:
    return f"""d AS (SELECT {labels}, {window} AS "window", CASE WHEN value < p THEN value ELSE value - p END AS d FROM (
        SELECT *, event_type AS label, user_id AS session, lag(value) OVER (PARTITION BY {labels.replace("label", "event_type").replace("session", "user_id")} ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL)"""


_DAY = "epoch_us(ts) // 86400000000"
_HIST = "h AS (SELECT event_type AS label, le, count(value) FILTER (WHERE value <= le OR le IS NULL) AS n FROM events, unnest([" + ", ".join(map(str, BOUNDS)) + ", NULL]::DOUBLE[]) AS u(le) GROUP BY 1, 2)"
_LINES = """SELECT 0 AS place, '# HELP {0} {1}' AS line UNION ALL SELECT 1, '# TYPE {0} {2}' UNION ALL """


def _rate_quantile(q: float) -> str:
    bounds = ", ".join(map(str, BOUNDS))
    return f"""WITH e AS (SELECT event_type AS label, user_id AS session, ts, event_id, value, le FROM events, unnest([{bounds}, NULL]::DOUBLE[]) AS u(le)),
        c AS (SELECT *, count(value) FILTER (WHERE value <= le OR le IS NULL) OVER (PARTITION BY label, session, le ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM e),
        d AS (SELECT label, le, {_DAY} AS "window", n - lag(n) OVER (PARTITION BY label, session, le ORDER BY ts, event_id) AS d FROM c),
        h AS (SELECT label, "window", le, sum(d)::DOUBLE AS n FROM d WHERE d IS NOT NULL GROUP BY ALL),
        b AS (SELECT *, coalesce(lag(le) OVER w, 0.0) AS low, coalesce(lag(n) OVER w, 0) AS before, max(n) OVER (PARTITION BY label, "window") * {q}::DOUBLE AS rank FROM h WINDOW w AS (PARTITION BY label, "window" ORDER BY le NULLS LAST)),
        f AS (SELECT *, row_number() OVER (PARTITION BY label, "window" ORDER BY le NULLS LAST) AS r FROM b WHERE n >= rank AND rank > 0)
        SELECT k.label, k."window", round(CASE WHEN le IS NULL THEN low ELSE low + (le - low) * (rank - before) / (n - before) END, 6) AS quantile FROM (SELECT DISTINCT label, "window" FROM h) k LEFT JOIN f ON f.label = k.label AND f."window" = k."window" AND r = 1"""


SQL = {
    "prom_rate_two_labels": f'WITH {_inc("label, session", _DAY)} SELECT label, session % 3 AS kind, "window", round(sum(d) / 86400, 8) AS rate FROM d GROUP BY ALL',
    "prom_rate_filtered": f"""WITH {_inc("label, session", _DAY)} SELECT session, "window", round(sum(d) / 86400, 8) AS rate FROM d WHERE label = 'purchase' GROUP BY ALL""",
    "prom_rate_quantile_50": _rate_quantile(0.5),
    "prom_rate_quantile_99": _rate_quantile(0.99),
    "requests_by_status": "SELECT CASE WHEN user_id % 5 = 0 THEN 'NOT_FOUND' ELSE 'SUCCESS' END AS status, event_type AS type, count(*) AS total, round(avg(value), 6) AS mean_latency FROM events GROUP BY ALL",
    "metrics_exposition_whole": f"""WITH {_HIST} {_LINES.format("events_total", "Events.", "counter")} SELECT 2, 'events_total{{label="' || event_type || '\\"\\\\"}} ' || count(*) FROM events GROUP BY event_type
        UNION ALL {_LINES.format("last_event", "Last event.", "gauge")} SELECT 2, 'last_event ' || max(event_id) FROM events UNION ALL {_LINES.format("latency", "Latency.", "histogram")}
        SELECT 2, 'latency_bucket{{label="' || label || '",le="' || coalesce(le::INT::VARCHAR, '+Inf') || '"}} ' || n FROM h UNION ALL SELECT 2, 'latency_sum{{label="' || event_type || '"}} ' || sum(user_id) FROM events GROUP BY event_type
        UNION ALL SELECT 2, 'latency_count{{label="' || event_type || '"}} ' || count(value) FROM events GROUP BY event_type""",
    "counter_by_label": "SELECT event_type AS label, count(*) AS total FROM events GROUP BY 1",
    "latency_histogram": f"WITH {_HIST} SELECT label, le, n FROM h",
    "gauge_latest": "SELECT user_id AS session, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY 1",
    "gauge_avg": "SELECT round(avg(value), 6) AS mean FROM (SELECT arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY user_id)",
    "metrics_exposition": """SELECT 'events_total{label="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""",
    "prom_rate": f'WITH {_inc("session", _DAY)} SELECT session, "window", round(sum(d) / 86400, 8) AS rate FROM d GROUP BY 1, 2',
    "prom_rate_by_label": f'WITH {_inc("label, session", _DAY)} SELECT label, "window", round(sum(d) / 86400, 8) AS rate FROM d GROUP BY 1, 2',
    "prom_increase": f'WITH {_inc("label", "epoch_us(ts) // 3600000000")} SELECT label, "window", round(sum(d), 4) AS increase FROM d GROUP BY 1, 2',
    "prom_histogram_quantile": f"""WITH {_HIST}, b AS (SELECT label, le, n, coalesce(lag(le) OVER w, 0.0) AS low, coalesce(lag(n) OVER w, 0) AS before, max(n) OVER (PARTITION BY label) * 0.95::DOUBLE AS rank FROM h WINDOW w AS (PARTITION BY label ORDER BY le NULLS LAST)),
        f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY le NULLS LAST) AS r FROM b WHERE n >= rank AND rank > 0)
        SELECT label, round(CASE WHEN le IS NULL THEN low ELSE low + (le - low) * (rank - before) / (n - before) END, 6) AS quantile FROM f WHERE r = 1""",
    "prom_error_ratio": f"""WITH {_inc("label", _DAY)} SELECT "window", round(100 * sum(CASE WHEN label NOT IN ('click', 'view') THEN d ELSE 0 END) / sum(d), 6) AS ratio FROM d GROUP BY 1""",
    "prom_mean_latency": "SELECT event_type AS label, round(sum(value) / count(value), 6) AS mean FROM events GROUP BY 1",
}
