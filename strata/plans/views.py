"""Survey-shaped views over the driver's tables, in Spark and (as CTE bodies) in SQL.

Each view reads its whole table. Lines and frames are bounded by construction (a fixed run of ids),
so no key grows with the data unless the table's own key does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import spread

TRACES_PER_LINE = 40  # per channel
CHANNELS = ("RAD", "RA1", "RA2")
CLASS_OF_EVENT = {
    "click": "clear_point_reflector",
    "view": "elongated_linear_target",
    "purchase": "cavities",
    "signup": "intersecting_linear_and_point_reflector",
    "error": "disturbed_zone",
}

VIEW_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _case(column, mapping):
    out = None
    for key, value in mapping.items():
        out = F.when(column == key, value) if out is None else out.when(column == key, value)
    return out


def _sql_case(column: str, mapping: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


VIEW_SQL["traces"] = f"""
  SELECT vec_id // {3 * TRACES_PER_LINE} AS line_id,
         CASE vec_id % 3 WHEN 0 THEN 'RAD' WHEN 1 THEN 'RA1' ELSE 'RA2' END AS channel,
         CAST((vec_id % {3 * TRACES_PER_LINE}) // 3 AS INTEGER) AS trace,
         0.2 AS dt, 0.025 AS spacing, CAST(embedding AS DOUBLE[]) AS samples
  FROM embeddings"""


def traces(spark: SparkSession, sf: str) -> DataFrame:
    width = 3 * TRACES_PER_LINE
    vec = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        F.floor(vec / width).alias("line_id"),
        F.when(vec % 3 == 0, "RAD").when(vec % 3 == 1, "RA1").otherwise("RA2").alias("channel"),
        F.floor((vec % width) / 3).cast("int").alias("trace"),
        F.lit(0.2).alias("dt"),
        F.lit(0.025).alias("spacing"),
        F.col("embedding").cast("array<double>").alias("samples"),
    )


VIEW_SQL["samples"] = """
  SELECT line_id, channel, trace, dt, spacing, CAST(s AS INTEGER) AS sample, samples[s + 1] AS amp
  FROM traces, range(64) AS r(s)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return traces(spark, sf).select(
        "line_id", "channel", "trace", "dt", "spacing", F.posexplode("samples").alias("sample", "amp")
    )


VIEW_SQL["line_table"] = """
  SELECT line_id, channel, CAST(count(*) AS BIGINT) AS n_traces, 64 AS n_samples, 0.2 AS dt, 0.025 AS spacing,
         CASE WHEN line_id % 4 = 0 THEN 0.0 WHEN line_id % 4 = 1 AND channel = 'RA2' THEN 12.0
              ELSE 6.0 + line_id % 5 END AS header_dielectric,
         line_id % 3 = 0 AS has_calibrated_depth, line_id % 2 = 0 AS has_real_position
  FROM traces GROUP BY line_id, channel"""


def line_table(spark: SparkSession, sf: str) -> DataFrame:
    return (
        traces(spark, sf)
        .groupBy("line_id", "channel")
        .agg(F.count("*").alias("n_traces"))
        .select(
            "line_id", "channel", "n_traces",
            F.lit(64).alias("n_samples"), F.lit(0.2).alias("dt"), F.lit(0.025).alias("spacing"),
            F.when(F.col("line_id") % 4 == 0, 0.0)
            .when((F.col("line_id") % 4 == 1) & (F.col("channel") == "RA2"), 12.0)
            .otherwise(6.0 + F.col("line_id") % 5).alias("header_dielectric"),
            (F.col("line_id") % 3 == 0).alias("has_calibrated_depth"),
            (F.col("line_id") % 2 == 0).alias("has_real_position"),
        )
    )


VIEW_SQL["findings"] = f"""
  SELECT event_id AS finding_id, strftime(ts, '%Y-%m-%d') AS survey_id, user_id AS line_id,
         event_id // 16 AS frame_id, {_sql_case("event_type", CLASS_OF_EVENT)} AS class_name,
         least(value / 100, 1.0) AS confidence,
         CASE WHEN event_type <> 'signup' THEN (event_id % 400) * 0.025 END AS position_m,
         CASE WHEN event_type <> 'error' THEN value / 200 END AS depth_m,
         CASE WHEN event_type = 'error' THEN 'unavailable' WHEN user_id % 3 = 0 THEN 'calibrated' ELSE 'estimated' END AS depth_confidence,
         CASE WHEN event_type = 'signup' THEN 'unavailable' WHEN user_id % 2 = 0 THEN 'calibrated' ELSE 'estimated' END AS position_confidence,
         CAST((event_id * 7) % 560 AS DOUBLE) AS x1, CAST((event_id * 13) % 600 AS DOUBLE) AS y1,
         CAST((event_id * 7) % 560 + 12 + event_id % 60 AS DOUBLE) AS x2,
         CAST((event_id * 13) % 600 + 10 + event_id % 25 AS DOUBLE) AS y2, ts AS created_at
  FROM events"""


def findings(spark: SparkSession, sf: str) -> DataFrame:
    e, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    return table(spark, sf, "events").select(
        e.alias("finding_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("survey_id"),
        user.alias("line_id"),
        F.floor(e / 16).alias("frame_id"),
        _case(kind, CLASS_OF_EVENT).alias("class_name"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"),
        F.when(kind != "signup", (e % 400) * 0.025).alias("position_m"),
        F.when(kind != "error", F.col("value") / 200).alias("depth_m"),
        F.when(kind == "error", "unavailable").when(user % 3 == 0, "calibrated").otherwise("estimated").alias("depth_confidence"),
        F.when(kind == "signup", "unavailable").when(user % 2 == 0, "calibrated").otherwise("estimated").alias("position_confidence"),
        ((e * 7) % 560).cast("double").alias("x1"),
        ((e * 13) % 600).cast("double").alias("y1"),
        ((e * 7) % 560 + 12 + e % 60).cast("double").alias("x2"),
        ((e * 13) % 600 + 10 + e % 25).cast("double").alias("y2"),
        F.col("ts").alias("created_at"),
    )


VIEW_SQL["shape_detections"] = """
  SELECT finding_id AS detection_id, frame_id, x1, y1, x2, y2, confidence,
         CASE WHEN finding_id % 7 = 6 THEN 'unknown_shape' WHEN finding_id % 5 < 3 THEN 'point_reflector'
              WHEN finding_id % 5 = 3 THEN 'linear_reflector' ELSE 'disturbed_or_void' END AS shape,
         (finding_id % 11) * 0.8 AS peak,
         CASE finding_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS same_polarity
  FROM findings"""


def shape_detections(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("finding_id")
    return findings(spark, sf).select(
        i.alias("detection_id"), "frame_id", "x1", "y1", "x2", "y2", "confidence",
        F.when(i % 7 == 6, "unknown_shape").when(i % 5 < 3, "point_reflector")
        .when(i % 5 == 3, "linear_reflector").otherwise("disturbed_or_void").alias("shape"),
        ((i % 11) * F.lit(0.8)).alias("peak"),
        F.when(i % 3 == 0, True).when(i % 3 == 1, False).alias("same_polarity"),
    )


VIEW_SQL["login_events"] = """
  SELECT event_id, ts AS signed_at, CASE WHEN event_id % 2 = 0 THEN 'User' ELSE 'user' END || CAST(user_id % 40 AS VARCHAR) AS username, user_id % 40 AS user_id,
         CASE WHEN event_type IN ('error', 'click') THEN 'login_failed' ELSE 'login' END AS event,
         CASE WHEN event_id % 9 <> 0 THEN json_extract_string(props, '$.k') END AS ip
  FROM events"""


def login_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("signed_at"),
        F.concat(F.when(F.col("event_id") % 2 == 0, "User").otherwise("user"), (F.col("user_id") % 40).cast("string")).alias("username"),
        (F.col("user_id") % 40).alias("user_id"),
        F.when(F.col("event_type").isin("error", "click"), "login_failed").otherwise("login").alias("event"),
        F.when(F.col("event_id") % 9 != 0, F.get_json_object("props", "$.k")).alias("ip"),
    )


VIEW_SQL["label_events"] = """
  SELECT l_orderkey AS job, l_linenumber AS trace, l_linenumber * 0.4 AS time_ns,
         CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'N' THEN 'no' ELSE 'unsure' END AS decision,
         l_suppkey AS user_id, l_shipdate AS decided_at,
         l_partkey * 1000000 + CAST(l_extendedprice AS BIGINT) AS label_id
  FROM lineitem"""


def label_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("trace"),
        (F.col("l_linenumber") * F.lit(0.4)).alias("time_ns"),
        F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "N", "no").otherwise("unsure").alias("decision"),
        F.col("l_suppkey").alias("user_id"), F.col("l_shipdate").alias("decided_at"),
        (F.col("l_partkey") * 1000000 + F.rint("l_extendedprice").cast("long")).alias("label_id"),
    )


VIEW_SQL["callouts"] = """
  SELECT l_orderkey AS drawing, l_linenumber AS sheet, l_partkey AS part, l_suppkey AS supp, p_type AS utility,
         CASE WHEN l_discount < 0.1 THEN l_quantity / 25 END AS depth_m, 1.2 + (l_orderkey % 3) * 0.3 AS safe_path_m,
         CASE l_linestatus WHEN 'O' THEN 'ocr' ELSE 'text' END AS read_by, l_extendedprice AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey"""


def callouts(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("drawing"), F.col("l_linenumber").alias("sheet"), F.col("l_partkey").alias("part"),
            F.col("l_suppkey").alias("supp"), F.col("p_type").alias("utility"),
            F.when(F.col("l_discount") < 0.1, F.col("l_quantity") / 25).alias("depth_m"),
            (F.lit(1.2) + (F.col("l_orderkey") % 3) * 0.3).alias("safe_path_m"),
            F.when(F.col("l_linestatus") == "O", "ocr").otherwise("text").alias("read_by"),
            F.col("l_extendedprice").alias("price"),
        )
    )


VIEW_SQL["anchors"] = """
  SELECT o_custkey AS line_id, o_orderkey AS anchor_id, (o_orderkey % 997) * 2.5 AS chainage_m,
         12.9 + sin(o_orderkey % 997) * 0.01 AS lat, 77.5 + cos(o_orderkey % 991) * 0.01 AS lon,
         (o_orderkey % 23) * 0.01 AS accuracy_m, o_orderpriority AS source
  FROM orders"""


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        c.alias("line_id"), o.alias("anchor_id"), ((o % 997) * 2.5).alias("chainage_m"),
        (F.lit(12.9) + F.sin(o % 997) * 0.01).alias("lat"), (F.lit(77.5) + F.cos(o % 991) * 0.01).alias("lon"),
        ((o % 23) * 0.01).alias("accuracy_m"), F.col("o_orderpriority").alias("source"),
    )


VIEW_SQL["gps_fixes"] = """
  SELECT o_custkey AS line_id, o_orderkey AS fix_id, CAST(o_orderkey % 400 AS INTEGER) AS trace,
         12.9 + (o_custkey % 50) * 0.00001 + (o_orderkey % 400) * 0.00000022 * (CASE WHEN o_custkey % 4 = 0 THEN 0.1 ELSE 1 END) + (o_orderkey % 7) * 0.0000001 AS lat,
         77.5 + (o_custkey % 50) * 0.000004 + (o_orderkey % 400) * 0.00000008 + (o_orderkey % 5) * 0.0000001 AS lon
  FROM orders"""


def gps_fixes(spark: SparkSession, sf: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    lag = F.when(c % 4 == 0, 0.1).otherwise(1.0)
    return table(spark, sf, "orders").select(
        c.alias("line_id"), o.alias("fix_id"), (o % 400).cast("int").alias("trace"),
        (F.lit(12.9) + (c % 50) * 0.00001 + (o % 400) * 0.00000022 * lag + (o % 7) * 0.0000001).alias("lat"),
        (F.lit(77.5) + (c % 50) * 0.000004 + (o % 400) * 0.00000008 + (o % 5) * 0.0000001).alias("lon"),
    )


VIEW_SQL["reviews"] = """
  SELECT conv_id * 1000 + turn AS review_id, conv_id AS job,
         CASE WHEN turn % 2 = 0 THEN 'pick' ELSE 'candidate' END AS target_kind, turn // 2 AS target_id,
         CASE WHEN (conv_id + turn) % 5 = 0 THEN 'proposed' WHEN (conv_id + turn) % 4 = 1 THEN 'rejected' ELSE 'confirmed' END AS status,
         CASE role WHEN 'user' THEN ' Water pipe' WHEN 'assistant' THEN 'water pipe ' ELSE 'duct' END AS identity,
         length(text) % 12 AS decided_at, role AS reviewer
  FROM conversations"""


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    job, turn = F.col("conv_id"), F.col("turn")
    return table(spark, sf, "conversations").select(
        (job * 1000 + turn).alias("review_id"), job.alias("job"),
        F.when(turn % 2 == 0, "pick").otherwise("candidate").alias("target_kind"),
        F.floor(turn / 2).alias("target_id"),
        F.when((job + turn) % 5 == 0, "proposed").when((job + turn) % 4 == 1, "rejected").otherwise("confirmed").alias("status"),
        F.when(F.col("role") == "user", " Water pipe").when(F.col("role") == "assistant", "water pipe ").otherwise("duct").alias("identity"),
        (F.length("text") % 12).cast("long").alias("decided_at"), F.col("role").alias("reviewer"),
    )


VIEW_SQL["channel_picks"] = """
  SELECT l_orderkey AS line_id, CASE l_linenumber % 3 WHEN 0 THEN 'RAD' WHEN 1 THEN 'RA1' ELSE 'RA2' END AS channel,
         CAST(l_partkey % 40 AS INTEGER) AS trace, CAST(l_suppkey % 32 AS INTEGER) AS sample,
         l_extendedprice / 1000 AS strength, l_partkey * 100000 + l_suppkey AS pick_id
  FROM lineitem"""


def channel_picks(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("line_id"),
        F.when(n % 3 == 0, "RAD").when(n % 3 == 1, "RA1").otherwise("RA2").alias("channel"),
        (F.col("l_partkey") % 40).cast("int").alias("trace"), (F.col("l_suppkey") % 32).cast("int").alias("sample"),
        (F.col("l_extendedprice") / 1000).alias("strength"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("pick_id"),
    )


VIEW_SQL["apexes"] = """
  SELECT l_orderkey AS line_id, l_partkey * 100000 + l_suppkey AS apex_id,
         CASE l_linenumber % 3 WHEN 0 THEN 'RAD' WHEN 1 THEN 'RA1' ELSE 'RA2' END AS channel,
         (l_partkey % 80) * 0.025 AS position_m, l_quantity / 25 AS depth_m,
         CASE WHEN l_discount > 0.01 THEN 4 + l_discount * 100 END AS dielectric, l_linenumber * 5 + l_suppkey % 5 AS n_inliers,
         l_tax AS fit_r2
  FROM lineitem"""


def apexes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("line_id"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("apex_id"),
        F.when(n % 3 == 0, "RAD").when(n % 3 == 1, "RA1").otherwise("RA2").alias("channel"),
        ((F.col("l_partkey") % 80) * 0.025).alias("position_m"), (F.col("l_quantity") / 25).alias("depth_m"),
        F.when(F.col("l_discount") > 0.01, 4 + F.col("l_discount") * 100).alias("dielectric"),
        (n * 5 + F.col("l_suppkey") % 5).alias("n_inliers"), F.col("l_tax").alias("fit_r2"),
    )


VIEW_SQL["fits"] = """
  SELECT l_orderkey AS line_id, l_partkey * 100000 + l_suppkey AS fit_id, 0.03 + l_quantity / 125 AS velocity,
         sqrt(l_extendedprice) / 25 AS apex_time_ns, sqrt(l_extendedprice) / 1.25 AS apex_sample, l_linenumber * 3 AS n_inliers,
         256 AS n_samples
  FROM lineitem"""


def fits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("line_id"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("fit_id"),
        (F.lit(0.03) + F.col("l_quantity") / 125).alias("velocity"), (F.sqrt("l_extendedprice") / 25).alias("apex_time_ns"),
        (F.sqrt("l_extendedprice") / 1.25).alias("apex_sample"), (F.col("l_linenumber") * 3).alias("n_inliers"),
        F.lit(256).alias("n_samples"),
    )


VIEW_SQL["boxes"] = """
  SELECT line_id, channel, CAST(line_id * 100 + k * 10 + CASE channel WHEN 'RAD' THEN 0 WHEN 'RA1' THEN 1 ELSE 2 END AS BIGINT) AS box_id,
         CAST(2 + k * 7 + line_id % 5 AS INTEGER) AS x, CAST(16 + (k * 11 + line_id) % 20 AS INTEGER) AS y,
         CAST(8 + k * 2 AS INTEGER) AS w, CAST(10 + k * 3 AS INTEGER) AS h
  FROM line_table, range(4) AS r(k)"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    line, k = F.col("line_id"), F.col("k")
    channel = F.when(F.col("channel") == "RAD", 0).when(F.col("channel") == "RA1", 1).otherwise(2)
    return (
        line_table(spark, sf)
        .select("line_id", "channel", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
        .select(
            "line_id", "channel", (line * 100 + k * 10 + channel).alias("box_id"),
            (2 + k * 7 + line % 5).cast("int").alias("x"), (16 + (k * 11 + line) % 20).cast("int").alias("y"),
            (8 + k * 2).cast("int").alias("w"), (10 + k * 3).cast("int").alias("h"),
        )
    )


VIEW_SQL["words"] = """
  SELECT doc_id AS drawing, CAST(i AS INTEGER) AS word_id, list_extract(ws, CAST(i + 1 AS BIGINT)) AS text,
         CAST(i % 12 AS DOUBLE) * 8 AS x0, CAST(i % 12 AS DOUBLE) * 8 + 6 AS x1, CAST(i // 12 AS DOUBLE) * 5 AS top
  FROM (SELECT doc_id, string_split_regex(text, '\\s+') AS ws FROM documents), unnest(range(len(ws))) AS u(i)"""


def words(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("word_id")
    return (
        spread(table(spark, sf, "documents").select("doc_id", "text"))
        .select(F.col("doc_id").alias("drawing"), F.posexplode(F.split("text", r"\s+")).alias("word_id", "text"))
        .select(
            "drawing", "word_id", "text", ((i % 12) * 8.0).alias("x0"), ((i % 12) * 8.0 + 6).alias("x1"),
            (F.floor(i / 12) * 5.0).alias("top"),
        )
    )


VIEW_SQL["arch_points"] = """
  SELECT event_id // 40 AS line_id, 'RAD' AS channel, event_id // 40 AS box_id, CAST(event_id % 40 AS INTEGER) AS trace,
         CAST(round_even(sqrt(pow(20 + (event_id // 40) % 30, 2) + pow((event_id % 40 - 20) / (0.8 + ((event_id // 40) % 7) * 0.15), 2)) + (value - 50) / 20, 0) AS INTEGER) AS sample
  FROM events"""


def arch_points(spark: SparkSession, sf: str) -> DataFrame:
    """Noisy hyperbolas, forty points each, some of them far off the curve."""
    e = F.col("event_id")
    box = F.floor(e / 40)
    t0, k = 20 + box % 30, F.lit(0.8) + (box % 7) * 0.15
    t = F.sqrt(F.pow(t0, F.lit(2)) + F.pow((e % 40 - 20) / k, F.lit(2))) + (F.col("value") - 50) / 20
    return table(spark, sf, "events").select(
        box.alias("line_id"), F.lit("RAD").alias("channel"), box.alias("box_id"), (e % 40).cast("int").alias("trace"), F.rint(t).cast("int").alias("sample"))


VIEW_SQL["run_targets"] = """
  SELECT o_custkey AS site, o_orderkey AS target_id, CAST(o_orderkey % 5 AS INTEGER) AS line_rank, (o_orderkey * 37 % 1000) * 0.0012 AS east,
         (o_orderkey % 5) * 1.0 AS north, 0.8 + (o_orderkey * 13 % 100) * 0.004 AS depth_m FROM orders"""


def run_targets(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("site"), o.alias("target_id"), (o % 5).cast("int").alias("line_rank"), ((o * 37) % 1000 * F.lit(0.0012)).alias("east"),
        ((o % 5) * F.lit(1.0)).alias("north"), (F.lit(0.8) + ((o * 13) % 100) * 0.004).alias("depth_m"))


VIEW_SQL["track_points"] = """
  SELECT o_custkey AS line_id, o_custkey % 60 AS survey_id, o_orderkey AS point_id, (o_orderkey % 400) * 0.025 AS distance_m,
         100 + (o_orderkey % 400) * 0.025 * (0.6 + (o_custkey % 9) * 0.1) * (CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END) + (o_orderkey % 7) * 0.02 AS east,
         200 + (o_orderkey % 400) * 0.025 * 0.3 + (o_orderkey % 5) * 0.03 AS north FROM orders"""


def track_points(spark: SparkSession, sf: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    d = (o % 400) * F.lit(0.025)
    sign = F.when(c % 2 == 0, 1).otherwise(-1)
    return table(spark, sf, "orders").select(
        c.alias("line_id"), (c % 60).alias("survey_id"), o.alias("point_id"), d.alias("distance_m"),
        (100 + d * (F.lit(0.6) + (c % 9) * 0.1) * sign + (o % 7) * F.lit(0.02)).alias("east"), (200 + d * 0.3 + (o % 5) * F.lit(0.03)).alias("north"))


_NAMES = ("ELECTRIC", "WATER", "SEWER", "DRAIN", "UC", "OFC", "METALLIC", "GAS", "STORM")
VIEW_SQL["draw_rows"] = """
  SELECT l_orderkey AS drawing, 1 AS page, (l_partkey * 100000 + l_suppkey * 10 + l_linenumber) * 8 AS id, l_partkey, l_suppkey, l_linenumber, l_tax,
         CAST((l_partkey % 4) * 30 AS DOUBLE) AS x, CAST((l_suppkey % 6) * 11 AS DOUBLE) AS y, CAST(CAST(l_quantity AS INTEGER) // 10 AS VARCHAR) || '.' || CAST(CAST(l_quantity AS INTEGER) % 10 AS VARCHAR) AS num FROM lineitem"""
VIEW_SQL["draw_words"] = """
  SELECT drawing, page, id AS word_id, list_extract(['ELECTRIC', 'WATER', 'SEWER', 'DRAIN', 'UC', 'OFC', 'METALLIC', 'GAS', 'STORM'], CAST(l_partkey % 9 + 1 AS BIGINT)) AS text, x AS x0, x + 20 AS x1, y AS top, y + 4 AS bottom FROM draw_rows
  UNION ALL SELECT drawing, page, id + 1, CASE WHEN l_linenumber = 3 THEN 'Depth=' || num || 'm' ELSE 'Depth' END, x + l_linenumber % 3, x + 14, y + 5, y + 8 FROM draw_rows
  UNION ALL SELECT drawing, page, id + 2, num || 'm', x + 17, x + 25, y + 5.5, y + 8.5 FROM draw_rows WHERE l_tax < 0.06 AND l_linenumber <> 3
  UNION ALL SELECT drawing, page, id + 3, 'WATER', x + 23, x + 40, y + 0.5, y + 4.5 FROM draw_rows WHERE l_partkey % 9 = 8
  UNION ALL SELECT drawing, page, id + 4, 'CH-' || CAST(20 + (l_partkey % 4) * 10 AS VARCHAR), x, x + 8, y + 2, y + 4 FROM draw_rows WHERE l_linenumber > 4"""


def draw_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of one vendor page per order: names, depth labels, numbers, second names and ticks."""
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    q = F.col("l_quantity").cast("int")
    num = F.concat(F.floor(q / 10).cast("string"), F.lit("."), (q % 10).cast("string"))
    x, y = ((part % 4) * 30).cast("double"), ((F.col("l_suppkey") % 6) * 11).cast("double")
    ident = (part * 100000 + F.col("l_suppkey") * 10 + line) * 8
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (part % 9 + 1).cast("int"))

    def word(k, text, x0, x1, top, bottom, when):
        return F.when(when, F.struct((ident + k).alias("word_id"), text.alias("text"), x0.alias("x0"), x1.alias("x1"), top.alias("top"), bottom.alias("bottom")))

    always = F.lit(True)
    words_of_row = F.array_compact(F.array(
        word(0, name, x, x + 20, y, y + 4, always),
        word(1, F.when(line == 3, F.concat(F.lit("Depth="), num, F.lit("m"))).otherwise("Depth"), x + line % 3, x + 14, y + 5, y + 8, always),
        word(2, F.concat(num, F.lit("m")), x + 17, x + 25, y + 5.5, y + 8.5, (F.col("l_tax") < 0.06) & (line != 3)),
        word(3, F.lit("WATER"), x + 23, x + 40, y + 0.5, y + 4.5, part % 9 == 8),
        word(4, F.concat(F.lit("CH-"), (20 + (part % 4) * 10).cast("string")), x, x + 8, y + 2, y + 4, line > 4)))
    used = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax")
    rows = spread(used).select(F.col("l_orderkey").alias("drawing"), F.lit(1).alias("page"), F.explode(words_of_row).alias("w"))
    return rows.select("drawing", "page", "w.*")


def draw_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("drawing"), F.lit(1).alias("page"), F.lit(90.0).alias("width"), F.lit(200.0).alias("height")).distinct()


def printed_points(spark: SparkSession, sf: str) -> DataFrame:
    """Printed positions along roads, some of them misprinted; every other road has only its right-hand side."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    along = (o % 97) * 20.0
    off = F.when(o % 41 == 0, 0.01).otherwise(0.0)
    return table(spark, sf, "orders").select(
        F.concat(F.lit("Road "), c.cast("string"), F.when((c % 2 == 0) | (o % 2 == 0), " Rhs").otherwise(" Lhs")).alias("drawing"), along.alias("chainage_m"),
        (F.lit(12.9) + along / 110574.0 * 0.8 + off).alias("lat"), (F.lit(77.5) + along / 108500.0 * 0.6).alias("lon"))


VIEW_SQL["truth"] = """
  SELECT l_orderkey AS survey_id, l_linenumber * 100000 + l_partkey AS utility_id, (l_partkey % 80) * 0.03 AS distance_m, l_quantity / 25 AS depth_m FROM lineitem WHERE l_returnflag <> 'N'"""
VIEW_SQL["eval_picks"] = """
  SELECT l_orderkey AS survey_id, l_partkey * 1000 + l_suppkey AS pick_id, (l_suppkey % 80) * 0.03 AS x_m, (l_quantity + l_linenumber % 3) / 25 AS p_depth_m FROM lineitem"""


def truth(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").filter(F.col("l_returnflag") != "N").select(
        F.col("l_orderkey").alias("survey_id"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("utility_id"),
        ((F.col("l_partkey") % 80) * F.lit(0.03)).alias("distance_m"), (F.col("l_quantity") / 25).alias("depth_m"))


def eval_picks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("survey_id"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pick_id"),
        ((F.col("l_suppkey") % 80) * F.lit(0.03)).alias("x_m"), ((F.col("l_quantity") + F.col("l_linenumber") % 3) / 25).alias("p_depth_m"))
