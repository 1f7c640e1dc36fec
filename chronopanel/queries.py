"""Registered queries of the panel engine, each with an independent DuckDB query where SQL can express it.

The Spark side uses the library's operators (expansion to months, running
windows); the SQL side states the definition plainly (range joins per row).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import clean as C
from .operators import history as H
from .operators import joins as J
from .operators import quality as Q
from .operators import ranking as R
from .operators import windows as W
from .operators.quantiles import quantiles
from .plans import audit as A
from .plans import dimension as D
from .plans import models as M
from .plans import panel as P
from .plans.proxy import HI, LO, SPLITS, Tables
from .sources import io as S

#: Months whose entities count as seen.
EARLY = ("1996-01-01", "1996-06-01")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ITEMS = "items AS (SELECT l_partkey AS entity, l_suppkey, l_orderkey * 10 + l_linenumber AS event_id, CAST(l_shipdate AS DATE) AS d, CAST(l_quantity AS INT) AS q, l_returnflag, l_linestatus, l_orderkey FROM lineitem)"
PARTS = "parts AS (SELECT p_partkey AS entity, p_brand AS owner, p_type || '/' || p_size AS grp, p_name, p_size FROM part)"
ENTITIES = "entities AS (SELECT p.entity, p.entity AS code, owner, grp, first_date, CASE WHEN p_size % 10 = 0 THEN 'CANCELLED POST MARKET' ELSE 'MARKETED' END AS status, CASE WHEN p_size % 10 = 0 THEN DATE '2000-06-30' END AS status_date FROM parts p LEFT JOIN (SELECT entity, min(d) AS first_date FROM items GROUP BY 1) f ON p.entity = f.entity)"
EVENTS = "events_ AS (SELECT event_id, i.entity, d AS start, CASE WHEN NOT (l_linestatus = 'O' AND d >= DATE '2001-06-01') THEN d + q END AS stop, l_linestatus AS status, l_suppkey AS reporter, owner, grp, CASE WHEN NOT (l_linestatus = 'O' AND d >= DATE '2001-06-01') THEN q END AS duration FROM items i LEFT JOIN parts p ON i.entity = p.entity WHERE l_returnflag = 'R')"
EXITS = "exits AS (SELECT i.entity, d AS exit_date, owner, grp FROM items i LEFT JOIN parts p ON i.entity = p.entity WHERE l_returnflag = 'A' AND q = 50)"
COVERAGE = "coverage AS (SELECT entity, s_nationkey AS jurisdiction, l_linestatus AS type, l_linestatus = 'F' AS benefit, d AS start, d + 30 * q AS stop FROM items LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'N')"
TOKENS = "tokens AS (SELECT DISTINCT entity, upper(trim(unnest(string_split(p_name, ' ')))) AS token FROM parts), foreign_ AS (SELECT DISTINCT token, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + q AS stop FROM items i JOIN orders ON o_orderkey = l_orderkey JOIN tokens t ON i.entity = t.entity WHERE o_orderpriority = '1-URGENT')"
MONTHS = f"months AS (SELECT CAST(unnest(generate_series(DATE '{LO}', DATE '{HI}', INTERVAL 1 MONTH)) AS DATE) AS obs)"
SPINE = "spine AS (SELECT obs, e.entity, code, owner, grp, first_date FROM months JOIN entities e ON first_date <= obs AND obs <= CASE WHEN status LIKE 'CANCELLED%' THEN status_date ELSE DATE '9999-12-31' END)"
NOW = "now_ AS (SELECT DISTINCT s.entity, s.obs FROM spine s JOIN events_ e ON e.entity = s.entity AND e.start <= s.obs AND s.obs < coalesce(stop, DATE '9999-12-31'))"
LABELLED = NOW + ", soon AS (SELECT DISTINCT s.entity, s.obs FROM spine s JOIN events_ e ON e.entity = s.entity AND e.start > s.obs AND e.start <= s.obs + 90), labelled AS (SELECT s.*, CAST(n.entity IS NOT NULL AS INT) AS in_event, CASE WHEN n.entity IS NULL AND f.entity IS NOT NULL THEN 1 ELSE 0 END AS label FROM spine s LEFT JOIN now_ n ON s.entity = n.entity AND s.obs = n.obs LEFT JOIN soon f ON s.entity = f.entity AND s.obs = f.obs)"
M12 = "CAST(s.obs - INTERVAL 12 MONTH AS DATE)"
OWN = """own AS (SELECT s.entity, s.obs,
  count(DISTINCT CASE WHEN start >= CAST(s.obs - INTERVAL 12 MONTH AS DATE) THEN event_id END) AS events_12m, count(DISTINCT CASE WHEN start >= CAST(s.obs - INTERVAL 36 MONTH AS DATE) THEN event_id END) AS events_36m,
  count(DISTINCT event_id) AS events_all, count(DISTINCT event_id) > 0 AS was_ever, CAST(s.obs - max(start) AS INT) AS days_since_last, CAST(s.obs - min(start) AS INT) AS days_since_first,
  CAST(max(CASE WHEN stop < s.obs THEN duration END) AS INT) AS longest_days, CASE WHEN count(start) >= 2 THEN CAST(max(start) - min(start) AS DOUBLE) / (count(start) - 1) END AS mean_gap_days
  FROM spine s LEFT JOIN events_ e ON e.entity = s.entity AND start < s.obs GROUP BY s.entity, s.obs)"""
STANDING = "portfolio AS (SELECT m.obs, owner, count(DISTINCT entity) AS portfolio FROM months m JOIN entities ON first_date <= m.obs GROUP BY 1, 2)"
OWNER = STANDING + """, owner_counts AS (SELECT m.obs, owner, count(DISTINCT event_id) AS n12, count(DISTINCT CASE WHEN start >= CAST(m.obs - INTERVAL 3 MONTH AS DATE) THEN event_id END) AS n3 FROM months m JOIN events_ ON start < m.obs AND start >= CAST(m.obs - INTERVAL 12 MONTH AS DATE) GROUP BY 1, 2),
owner_rates AS (SELECT p.obs, p.owner, portfolio, coalesce(n12, 0) AS owner_events_12m, coalesce(n3, 0) AS owner_events_3m, coalesce(n12, 0)::DOUBLE / portfolio AS owner_rate_12m, coalesce(n3, 0)::DOUBLE / portfolio AS owner_rate_3m, coalesce(n3, 0)::DOUBLE / portfolio - coalesce(n12, 0)::DOUBLE / portfolio AS owner_rate_delta FROM portfolio p LEFT JOIN owner_counts c ON p.obs = c.obs AND p.owner = c.owner)"""
MARKET = "own_share AS (SELECT m.obs, grp, owner, count(DISTINCT entity) AS own_entities FROM months m JOIN entities ON first_date <= m.obs GROUP BY 1, 2, 3), market AS (SELECT obs, grp, CAST(sum(own_entities) AS BIGINT) AS group_entities, count(*) AS group_owners FROM own_share GROUP BY 1, 2)"
PEERS = """group12 AS (SELECT m.obs, grp, count(DISTINCT event_id) AS n FROM months m JOIN events_ ON start < m.obs AND start >= CAST(m.obs - INTERVAL 12 MONTH AS DATE) GROUP BY 1, 2),
own12 AS (SELECT m.obs, entity, count(DISTINCT event_id) AS n FROM months m JOIN events_ ON start < m.obs AND start >= CAST(m.obs - INTERVAL 12 MONTH AS DATE) GROUP BY 1, 2),
group_now AS (SELECT DISTINCT m.obs, grp FROM months m JOIN events_ ON start <= m.obs AND m.obs < coalesce(stop, DATE '9999-12-31')),
peers AS (SELECT s.entity, s.obs, greatest(coalesce(g.n, 0) - coalesce(o.n, 0), 0) AS peer_events_12m, CAST(gn.grp IS NOT NULL AND nn.entity IS NULL AS INT) AS peer_in_event_now FROM spine s LEFT JOIN group12 g ON s.obs = g.obs AND s.grp = g.grp LEFT JOIN own12 o ON s.obs = o.obs AND s.entity = o.entity LEFT JOIN group_now gn ON s.obs = gn.obs AND s.grp = gn.grp LEFT JOIN now_ nn ON s.obs = nn.obs AND s.entity = nn.entity)"""
EXITSIG = """gx AS (SELECT m.obs, grp, count(*) FILTER (WHERE exit_date >= CAST(m.obs - INTERVAL 12 MONTH AS DATE)) AS group_exits_12m, count(*) FILTER (WHERE exit_date >= CAST(m.obs - INTERVAL 36 MONTH AS DATE)) AS group_exits_36m, CAST(m.obs - max(exit_date) AS INT) AS days_since_group_exit FROM months m JOIN exits ON exit_date < m.obs GROUP BY 1, 2),
ox AS (SELECT m.obs, owner, count(*) AS owner_exits_12m FROM months m JOIN exits ON exit_date < m.obs AND exit_date >= CAST(m.obs - INTERVAL 12 MONTH AS DATE) GROUP BY 1, 2)"""
COVER = "cover AS (SELECT s.entity, s.obs, count(DISTINCT jurisdiction) AS n_jurisdictions, count(*) FILTER (WHERE benefit) AS n_benefit_rows FROM spine s LEFT JOIN coverage c ON c.entity = s.entity AND c.start <= s.obs AND s.obs < c.stop GROUP BY 1, 2)"
TYPES = "types AS (SELECT entity, max(CASE WHEN type = 'F' THEN 1 ELSE 0 END) AS is_generic, max(CASE WHEN type = 'O' THEN 1 ELSE 0 END) AS is_brand FROM coverage GROUP BY 1)"
FOREIGN = """tm AS (SELECT m.obs, token, max(CAST(stop >= m.obs AS INT)) AS on_, max(CAST(start >= CAST(m.obs - INTERVAL 12 MONTH AS DATE) AS INT)) AS new_ FROM months m JOIN foreign_ ON start < m.obs GROUP BY 1, 2),
hits AS (SELECT t.entity, tm.obs, CAST(sum(on_) AS BIGINT) AS a, CAST(sum(new_) AS BIGINT) AS b FROM tokens t JOIN tm ON t.token = tm.token GROUP BY 1, 2),
sig AS (SELECT s.entity, s.obs, CAST(s.entity IN (SELECT t.entity FROM tokens t JOIN foreign_ f ON t.token = f.token) AS INT) AS foreign_match, coalesce(a, 0) AS foreign_active, coalesce(b, 0) AS foreign_12m FROM spine s LEFT JOIN hits h ON s.entity = h.entity AND s.obs = h.obs)"""
BASE = f"WITH {ITEMS}, {PARTS}, {ENTITIES}, {EVENTS}, {MONTHS}, {SPINE}"
EV = f"WITH {ITEMS}, {PARTS}, {ENTITIES}, {EVENTS}"
PANEL = f"{BASE}, {EXITS}, {COVERAGE}, {TOKENS}, {LABELLED}, {OWN}, {OWNER}, {MARKET}, {PEERS}, {EXITSIG}, {COVER}, {TYPES}, {FOREIGN}, " + """panel AS (SELECT s.obs, s.entity, s.code, s.owner, s.grp, s.in_event, s.label, CAST(s.obs - s.first_date AS DOUBLE) / 365.25 AS age_years,
 events_12m, events_36m, events_all, was_ever, days_since_last, days_since_first, longest_days, mean_gap_days, days_since_last - mean_gap_days AS overdue_days,
 coalesce(portfolio, 0) AS portfolio, coalesce(owner_events_12m, 0) AS owner_events_12m, coalesce(owner_rate_12m, 0.0) AS owner_rate_12m, coalesce(owner_rate_3m, 0.0) AS owner_rate_3m, coalesce(owner_rate_delta, 0.0) AS owner_rate_delta,
 coalesce(group_entities - 1, 0) AS competing, coalesce(group_owners, 0) AS group_owners, coalesce(own_entities::DOUBLE / group_entities, 0.0) AS own_share, peer_events_12m, peer_in_event_now,
 coalesce(group_exits_12m, 0) AS group_exits_12m, coalesce(group_exits_36m, 0) AS group_exits_36m, days_since_group_exit, coalesce(owner_exits_12m, 0) AS owner_exits_12m, coalesce(owner_exits_12m::DOUBLE / portfolio, 0.0) AS owner_exit_rate_12m,
 n_jurisdictions, n_benefit_rows, coalesce(is_generic, 0) AS is_generic, coalesce(is_brand, 0) AS is_brand, foreign_match, foreign_active, foreign_12m
 FROM labelled s JOIN own o ON s.entity = o.entity AND s.obs = o.obs JOIN peers p ON s.entity = p.entity AND s.obs = p.obs JOIN cover c ON s.entity = c.entity AND s.obs = c.obs JOIN sig g ON s.entity = g.entity AND s.obs = g.obs
 LEFT JOIN types t ON s.entity = t.entity LEFT JOIN owner_rates r ON s.obs = r.obs AND s.owner = r.owner LEFT JOIN ox ON s.obs = ox.obs AND s.owner = ox.owner LEFT JOIN market m ON s.obs = m.obs AND s.grp = m.grp LEFT JOIN own_share w ON s.obs = w.obs AND s.grp = w.grp AND s.owner = w.owner LEFT JOIN gx ON s.obs = gx.obs AND s.grp = gx.grp)"""
TAGGED = "tagged AS (SELECT *, CASE " + " ".join(f"WHEN obs BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, (a, b) in SPLITS.items()) + " END AS split FROM {src} WHERE in_event = 0)"
SHORT = f"{BASE}, {LABELLED}, {OWN}, {OWNER}, short AS (SELECT l.*, events_12m, events_36m, events_all, was_ever, coalesce(owner_rate_12m, 0.0) AS owner_rate_12m FROM labelled l JOIN own o ON l.entity = o.entity AND l.obs = o.obs LEFT JOIN owner_rates r ON l.obs = r.obs AND l.owner = r.owner), " + TAGGED.format(src="short")
SCORED = SHORT + ", sc AS (SELECT *, events_12m::DOUBLE + 1e-6::DOUBLE * (('0x' || substr(md5(entity::VARCHAR || ':' || obs::VARCHAR || ':0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE) AS single, events_12m::DOUBLE + 0.01::DOUBLE * owner_rate_12m + 1e-9::DOUBLE * (('0x' || substr(md5(entity::VARCHAR || ':' || obs::VARCHAR || ':0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE) AS compound FROM tagged WHERE split = 'test'), sd AS (SELECT *, compound / (compound + 4) AS score, rank() OVER (PARTITION BY obs ORDER BY compound) + (count(*) OVER (PARTITION BY obs, compound) - 1) / 2.0::DOUBLE AS r1, rank() OVER (PARTITION BY obs ORDER BY single) + (count(*) OVER (PARTITION BY obs, single) - 1) / 2.0::DOUBLE AS r2 FROM sc), scored AS (SELECT * EXCLUDE (r1, r2), 2.0::DOUBLE * r1 + 1.0::DOUBLE * r2 AS blend FROM sd)"
LONG = SCORED + ", long_ AS (SELECT 'single' AS ranker, obs, entity, label, single AS score FROM scored UNION ALL SELECT 'compound', obs, entity, label, compound FROM scored UNION ALL SELECT 'blend', obs, entity, label, blend FROM scored)"
CURVES = """ranked AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY score DESC, entity{tie}) AS rn FROM {t}),
steps AS (SELECT {k}, score, count(*) AS n, CAST(sum(label) AS BIGINT) AS p FROM {t} GROUP BY {k}, score),
cum AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {k} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0::DOUBLE AS rk, sum(p) OVER (PARTITION BY {k} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (PARTITION BY {k} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS al FROM steps),
area AS (SELECT {k}, sum(p) AS pos, sum(n) - sum(p) AS neg, sum(rk * p) AS r, sum(p * tp / al::DOUBLE) AS ap FROM cum GROUP BY {k})"""


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- sources and sinks ---


@query("a01_read_tagged_csv", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN '2020' ELSE '2021' END AS source_year_label FROM orders")
def _(t):
    root = S.scratch_dir(t.spark, "tagged")
    for label, rest in (("2020", 0), ("2021", 1)):
        t.raw("orders").where(F.col("o_orderkey") % 2 == rest).select("o_orderkey", "o_orderpriority").write.option("header", "true").csv(f"{root}/{label}")
        S.rename_parts(t.spark, f"{root}/{label}", label)
    return S.read_tagged_csv(t.spark, f"{root}/*/*__*.csv", ["o_orderkey", "o_orderpriority"], "o_orderkey").drop("source_file")


@query("a02_read_headerless_extracts", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'P' THEN 'partial' ELSE 'open' END AS product_status_extract FROM orders WHERE o_orderstatus IS NOT NULL")
def _(t):
    root = S.scratch_dir(t.spark, "extracts")
    for suffix, status in (("_f", "F"), ("_p", "P"), ("_o", "O")):
        t.raw("orders").where(F.col("o_orderstatus") == status).select("o_orderkey", "o_orderpriority").write.option("emptyValue", "").csv(f"{root}/orders{suffix}.txt")
    return S.read_headerless_extracts(t.spark, root, "orders", ["o_orderkey", "o_orderpriority"], {"_f": "filled", "_p": "partial", "_none": "missing", "_o": "open"})


@query("a04_read_latest_json", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    root, rows = S.scratch_dir(t.spark, "snapshots"), t.raw("nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")
    for day, df in (("2020-01-01", rows.limit(3)), ("2020-02-01", rows)):  # one document each, of at most 25 nations
        df.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("results"))).alias("value")).coalesce(1).write.text(f"{root}/snapshot-{day}.json")
    return S.read_latest_json(t.spark, f"{root}/snapshot-*.json", rows.schema)


@query("a07_write_table", "SELECT o_orderkey, o_orderstatus, o_custkey FROM orders")
def _(t):
    path, df = S.scratch_dir(t.spark, "table"), t.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    S.write_table(df.limit(1), path)
    S.write_table(df, path, ["o_orderstatus"])
    return S.read_panel(t.spark, path, df.columns)


@query("a10_write_metrics", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    path = S.scratch_dir(t.spark, "metrics")
    S.write_metrics(t.raw("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")), path)
    return t.spark.read.schema("o_orderpriority string, n long").option("header", "true").csv(path)


@query("a03_drop_by_suffix", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t):
    return C.drop_by_suffix(t.raw("orders").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("priority_f")), "_f")


@query("a05_flatten_records", "SELECT event_id, event_type, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS k_list FROM events")
def _(t):
    k = F.get_json_object("props", "$.k")
    nested = t.raw("events").select("event_id", "event_type", F.struct(F.when(k.isNotNull(), F.array(k)).alias("k")).alias("inner"))
    return S.flatten_records(nested, ["event_id", "event_type"], {"k": "inner.k"}, {"k_list": "inner.k"})


@query("a06_clean_coverage_feed", "SELECT lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS program, l_returnflag AS kind, CAST(l_shipdate AS DATE) AS start_date FROM lineitem")
def _(t):
    feed = t.raw("lineitem").select(F.col("l_suppkey").cast("string").alias(" Program "), F.col("l_returnflag").alias("Kind"), F.col("l_shipdate").cast("string").alias("Start"))
    return S.clean_coverage_feed(feed, {"Program": "program", "Kind": "kind", "Start": "start_date"}, "program", ["start_date"], ["program", "kind", "start_date"])


@query("a08_load_report", "SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys, round(avg(CAST(o_orderdate IS NOT NULL AS DOUBLE)), 6) AS o_orderdate_share, round(avg(CAST(o_totalprice IS NOT NULL AS DOUBLE)), 6) AS o_totalprice_share FROM orders")
def _(t):
    return S.load_report(t.raw("orders"), "o_custkey", ["o_orderdate", "o_totalprice"])


@query("a09_read_panel", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(t):
    return S.read_panel(t.spark, f"{t.dir}/lineitem.parquet", ["l_orderkey", "l_quantity"])


# --- projections and cleaning ---


@query("b01_pad_id", "SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS id FROM orders")
def _(t):
    return t.raw("orders").select("o_orderkey", C.pad_id(F.col("o_orderkey")).alias("id"))


@query("b02_null_sentinel", "SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority, o_orderpriority <> '5-LOW' AS has_priority FROM orders")
def _(t):
    return t.raw("orders").select("o_orderkey", C.null_sentinel(F.col("o_orderpriority"), "5-LOW").alias("priority"), C.has_id(F.col("o_orderpriority"), "5-LOW").alias("has_priority"))


@query("b03_b04_b05_flags", "SELECT o_orderkey, nullif(o_orderstatus, 'P') IS NOT NULL AS has_value, upper(nullif(o_orderstatus, 'P')) = 'F' AS yes, coalesce(nullif(o_orderstatus, 'P') = 'F', false) AS yes_strict FROM orders")
def _(t):
    raw = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return t.raw("orders").select("o_orderkey", C.has_value(raw).alias("has_value"), C.flag_yes(raw, "F").alias("yes"), C.flag_yes_strict(raw, "F").alias("yes_strict"))


@query("b06_safe_date", "SELECT event_id, CAST(ts AS DATE) AS iso, CAST(ts AS DATE) AS us, CAST(ts AS DATE) AS named, CAST(NULL AS DATE) AS bad FROM events")
def _(t):
    d = F.col("ts")
    return t.raw("events").select("event_id", C.safe_date(d.cast("string")).alias("iso"), C.safe_date(F.date_format(d, "MM/dd/yyyy"), "MM/dd/yyyy").alias("us"), C.safe_date(F.upper(F.date_format(d, "dd-MMM-yyyy")), "dd-MMM-yyyy").alias("named"), C.safe_date(F.col("event_type"), "MM/dd/yyyy").alias("bad"))


@query("b07_safe_int", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, TRY_CAST(event_type AS INT) AS bad FROM events")
def _(t):
    return t.raw("events").select("event_id", C.safe_int(F.get_json_object("props", "$.k")).alias("k"), C.safe_int(F.col("event_type")).alias("bad"))


@query("b08_b09_normalize_text", "SELECT p_partkey, upper(trim(coalesce(nullif(p_type, 'x'), p_name))) AS kind, trim(p_name) AS p_name FROM part")
def _(t):
    df = C.trim_all(t.raw("part").select("p_partkey", "p_name", "p_type"), ["p_name"])
    return df.select("p_partkey", C.normalize_text(F.nullif(F.col("p_type"), F.lit("x")), F.col("p_name")).alias("kind"), "p_name")


@query("b10_rename_columns", "SELECT s_suppkey AS supplier_id, s_name AS name FROM supplier")
def _(t):
    return C.rename_columns(t.raw("supplier").select("s_suppkey", "s_name"), {"s_suppkey": "supplier_id", "s_name": "name"})


@query("b11_b12_era_filter", "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1999-03-14' AND l_partkey IS NOT NULL")
def _(t):
    df = t.raw("lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("d"), "l_partkey")
    return C.require_not_null(C.era_filter(df, "d", "1999-03-14"), ["l_partkey"]).drop("l_partkey")


@query("b13_b14_b15_status_flags", "SELECT p_partkey, p_type = 'ECONOMY' AS is_economy, substr(p_brand, 1, 3) AS brand_prefix, p_brand LIKE 'Brand#1%' AS first_brands FROM part")
def _(t):
    df = C.status_flags(t.raw("part"), "p_type", {"is_economy": "ECONOMY"})
    return df.select("p_partkey", "is_economy", C.prefix(F.col("p_brand"), 3).alias("brand_prefix"), C.like_prefix(F.col("p_brand"), "Brand#1").alias("first_brands"))


@query("b16_coerce_panel_types", "SELECT event_id, CAST(ts AS DATE) AS day, CAST(value AS DOUBLE) AS value, TRY_CAST(event_type AS DOUBLE) AS number, CAST(user_id AS VARCHAR) AS who FROM events")
def _(t):
    df = t.raw("events").select("event_id", F.col("ts").alias("day"), "value", F.col("event_type").alias("number"), F.col("user_id").alias("who"))
    return C.coerce_panel_types(df, dates=["day"], numerics=["value", "number"], categories=["who"])


@query("c01_month_series", f"SELECT n_nationkey, CAST(unnest(generate_series(DATE '{LO}', DATE '{HI}', INTERVAL 1 MONTH)) AS DATE) AS obs FROM nation")
def _(t):
    return t.raw("nation").select("n_nationkey", F.explode(C.month_series(LO, HI)).alias("obs"))


@query("c02_explode_delimited", "SELECT * FROM (SELECT p_partkey, upper(trim(unnest(string_split(replace(p_name, ' ', '|'), '|')))) AS token FROM part) WHERE token <> ''")
def _(t):
    df = t.raw("part").select("p_partkey", F.regexp_replace("p_name", " ", "|").alias("names"))
    return C.explode_delimited(df, "names").select("p_partkey", "token")


# --- joins ---


@query("j01_star_join", "SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(t):
    n, r = t.raw("nation"), t.raw("region")
    df = t.raw("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return df.select("s_suppkey", "s_name", "n_name", "r_name")


@query("j02_matched_flag", "SELECT o_orderkey, c_custkey IS NOT NULL AS matched FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def _(t):
    return J.seen_flag(t.raw("orders").select("o_orderkey", "o_custkey"), t.raw("customer").where("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "matched").drop("o_custkey")


@query("j04_stab_join", f"{BASE} SELECT s.entity, s.obs, e.event_id, e.start FROM spine s JOIN events_ e ON e.entity = s.entity AND e.start <= s.obs AND s.obs < coalesce(stop, DATE '9999-12-31')")
def _(t):
    spine = H.entity_month_spine(t.entities(), LO, HI).select("entity", "obs")
    return J.stab_join(spine, t.events().select("entity", "event_id", "start", "end")).select("entity", "obs", "event_id", "start")


@query("j05_forward_join", f"{BASE} SELECT s.entity, s.obs, count(*) AS n FROM spine s JOIN events_ e ON e.entity = s.entity AND e.start > s.obs AND e.start <= s.obs + 90 GROUP BY 1, 2")
def _(t):
    spine = H.entity_month_spine(t.entities(), LO, HI).select("entity", "obs")
    return J.forward_join(spine, t.events().select("entity", "start"), 90).groupBy("entity", "obs").agg(F.count("*").alias("n"))


@query("j06_asof_join", f"{BASE} SELECT s.entity, s.obs, count(e.start) AS n FROM spine s LEFT JOIN events_ e ON e.entity = s.entity AND e.start < s.obs GROUP BY 1, 2")
def _(t):
    spine = H.entity_month_spine(t.entities(), LO, HI).select("entity", "obs")
    return J.asof_join(spine, t.events().select("entity", "start")).groupBy("entity", "obs").agg(F.count("start").alias("n"))


@query("j07_asof_inner", f"{BASE} SELECT s.entity, s.obs, count(*) AS n, min(e.start) AS first_start, max(e.start) AS last_start FROM spine s JOIN events_ e ON e.entity = s.entity AND e.start < s.obs GROUP BY 1, 2")
def _(t):
    spine = H.entity_month_spine(t.entities(), LO, HI).select("entity", "obs")
    joined = J.asof_join(spine, t.events().select("entity", "start"), "inner")
    return joined.groupBy("entity", "obs").agg(F.count("*").alias("n"), F.min("start").alias("first_start"), F.max("start").alias("last_start"))


@query("j07_latest_before", f"{BASE} SELECT s.entity, s.obs, e.event_id, e.start, e.status FROM spine s ASOF JOIN (SELECT * FROM events_ QUALIFY row_number() OVER (PARTITION BY entity, start ORDER BY event_id DESC) = 1) e ON s.entity = e.entity AND e.start < s.obs")
def _(t):
    spine = H.entity_month_spine(t.entities(), LO, HI).select("entity", "obs")
    found = J.latest_before(spine, t.events().select("entity", "event_id", "start", "status"), ["event_id"], "inner")
    return found.select("entity", "obs", "last.event_id", "last.start", "last.status")


@query("j10_group_lookup", f"{EV} SELECT event_id, start, e.entity, p.grp FROM events_ e LEFT JOIN (SELECT entity, min(grp) AS grp FROM parts GROUP BY 1) p ON e.entity = p.entity")
def _(t):
    lookup = W.dedupe_first(t.parts().select("entity", "grp"), ["entity"], [F.col("grp").asc_nulls_last()])
    return t.events().drop("grp").join(lookup, "entity", "left").select("event_id", "start", "entity", "grp")


@query("j13_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def _(t):
    return J.anti(t.raw("customer").select("c_custkey"), t.raw("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("j14_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(t):
    return t.raw("customer").select("c_custkey").join(t.raw("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("j15_overlap_pairs", f"{EV} SELECT a.entity, a.event_id AS a_id, b.event_id AS b_id, a.start AS a_start, a.stop AS a_end, b.start AS b_start, b.stop AS b_end FROM events_ a JOIN events_ b ON a.entity = b.entity AND a.event_id < b.event_id AND b.start > a.start AND b.start < a.stop")
def _(t):
    return J.overlap_pairs(t.events())


@query("j17_rankers_side_by_side", LONG + ", rk AS (SELECT *, row_number() OVER (PARTITION BY ranker, obs ORDER BY score DESC, entity) AS rn FROM long_), h AS (SELECT ranker, obs, CAST(sum(CASE WHEN rn <= 10 THEN label ELSE 0 END) AS BIGINT) AS hits FROM rk GROUP BY 1, 2) SELECT obs, max(hits) FILTER (WHERE ranker = 'single') AS single, max(hits) FILTER (WHERE ranker = 'compound') AS compound, max(hits) FILTER (WHERE ranker = 'blend') AS blend FROM h GROUP BY obs")
def _(t):
    return R.compare_rankers(R.per_month_topk(P.ranked_long(t), [10, 25, 50, 100]), 10, ["single", "compound", "blend"])


# --- aggregations ---


@query("g01_filtered_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'R') AS returned, count(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'N') AS open_, count(DISTINCT l_partkey) AS any_ FROM lineitem GROUP BY 1")
def _(t):
    d = lambda c, n: F.expr(f"count(distinct l_partkey) filter (where {c})").alias(n)
    return t.raw("lineitem").groupBy("l_suppkey").agg(d("l_returnflag = 'R'", "returned"), d("l_returnflag = 'N'", "open_"), d("true", "any_"))


@query("g08_list_of_distinct", "SELECT p_brand, string_agg(DISTINCT p_type, ' + ' ORDER BY p_type) AS types FROM part GROUP BY 1")
def _(t):
    return t.raw("part").groupBy("p_brand").agg(F.expr("listagg(distinct p_type, ' + ') within group (order by p_type)").alias("types"))


@query("g09_primary_and_alternatives", "SELECT p_brand, min(p_type) AS primary_type, count(DISTINCT p_type) AS n_types, max(p_size) AS max_size FROM part GROUP BY 1")
def _(t):
    return t.raw("part").groupBy("p_brand").agg(F.min("p_type").alias("primary_type"), F.countDistinct("p_type").alias("n_types"), F.max("p_size").alias("max_size"))


@query("g10_one_row_of_several", "SELECT p_brand, max(p_type) AS p_type, max(p_name) AS p_name, max(p_size) AS p_size, max(p_retailprice) AS p_retailprice FROM part GROUP BY 1")
def _(t):
    columns = ["p_type", "p_name", "p_size", "p_retailprice"]
    return t.raw("part").groupBy("p_brand").agg(*[F.max(c).alias(c) for c in columns])


@query("g12_two_level", "SELECT p_type, CAST(sum(n) AS BIGINT) AS parts, count(*) AS owners FROM (SELECT p_type, p_brand, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1, 2) GROUP BY 1")
def _(t):
    own = t.raw("part").groupBy("p_type", "p_brand").agg(F.countDistinct("p_partkey").alias("n"))
    return own.groupBy("p_type").agg(F.sum("n").alias("parts"), F.count("*").alias("owners"))


@query("g14_percentiles", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.95) AS p95 FROM lineitem GROUP BY 1")
def _(t):
    return quantiles(t.raw("lineitem"), ["l_returnflag"], "l_quantity", {"p50": 0.5, "p95": 0.95})


@query("g15_monthly_profile", "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS n, count(*) FILTER (WHERE l_quantity > 40) AS large FROM lineitem GROUP BY 1")
def _(t):
    return t.raw("lineitem").groupBy(F.trunc("l_shipdate", "month").alias("month")).agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 40).alias("large"))


@query("g16_having", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return Q.check_unique_combination(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query("g18_null_profile", "SELECT count(*) AS n_rows, count(o_orderdate) AS n_o_orderdate, count(nullif(o_orderstatus, 'P')) AS n_status FROM orders")
def _(t):
    return A.null_profile(t.raw("orders").withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("P"))), ["o_orderdate", "status"])


@query("g20_group_means", SCORED + " SELECT label, count(*) AS n, round(avg(events_12m), 6) AS mean_12m, round(avg(events_all), 6) AS mean_all, round(avg(events_12m) / nullif(avg(events_all), 0), 6) AS ratio FROM scored GROUP BY 1")
def _(t):
    df = P.scored(t).groupBy("label").agg(F.count("*").alias("n"), F.avg("events_12m").alias("a"), F.avg("events_all").alias("b"))
    return df.select("label", "n", F.round("a", 6).alias("mean_12m"), F.round("b", 6).alias("mean_all"), F.round(F.try_divide("a", "b"), 6).alias("ratio"))


@query("g21_category_shares", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / sum(count(*) FILTER (WHERE o_orderstatus = 'F')) OVER () AS f_share, count(*) FILTER (WHERE o_orderstatus = 'O')::DOUBLE / sum(count(*) FILTER (WHERE o_orderstatus = 'O')) OVER () AS o_share FROM orders GROUP BY 1")
def _(t):
    df = t.raw("orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))
    total = df.agg(F.sum("f").alias("_f"), F.sum("o").alias("_o"))
    return df.crossJoin(total).select("o_orderpriority", "f", "o", (F.col("f").cast("double") / F.col("_f")).alias("f_share"), (F.col("o").cast("double") / F.col("_o")).alias("o_share"))  # one row


@query("g22_topk_medians", SCORED + ", tk AS (SELECT * FROM scored ORDER BY score DESC, entity, obs LIMIT 200) SELECT median(events_12m) AS m12, median(events_all) AS mall, median(score) AS mscore FROM tk")
def _(t):
    top = P.scored(t).orderBy(F.col("score").desc(), "entity", "obs").limit(200)
    return top.agg(F.median("events_12m").alias("m12"), F.median("events_all").alias("mall"), F.median("score").alias("mscore"))


# --- windows, sorts, sets ---


@query("w01_latest_status", "SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC NULLS LAST, o_orderkey) = 1")
def _(t):
    return W.latest_by(t.raw("orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("d")), ["o_custkey"], "d", ["o_orderkey"])


@query("w02_preference_dedupe", "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey) = 1")
def _(t):
    return W.prefer(t.raw("orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], "o_orderpriority", ["1-URGENT", "2-HIGH"], ["o_orderkey"])


@query("w04_lag_gap", f"{EV} SELECT entity, event_id, start, CAST(start - lag(start) OVER (PARTITION BY entity ORDER BY start, event_id) AS INT) AS gap FROM (SELECT DISTINCT entity, event_id, start FROM events_)")
def _(t):
    return W.lag_gap(t.events().select("entity", "event_id", "start").distinct(), ["entity"], "start", ["event_id"])


@query("w05_concentration", f"{BASE}, {LABELLED}, per AS (SELECT entity, sum(label) AS v FROM labelled GROUP BY 1), rk AS (SELECT *, row_number() OVER (ORDER BY v DESC, entity) AS rn, sum(v) OVER () AS total, count(*) FILTER (WHERE v > 0) OVER () AS ewp FROM per) SELECT n AS top_n, CAST(sum(v) AS BIGINT) AS positives, CAST(max(total) AS BIGINT) AS total, max(ewp) AS entities_with_positives, sum(v)::DOUBLE / max(total) AS share FROM rk JOIN (SELECT unnest([10, 50, 100]) AS n) ON rn <= n GROUP BY n")
def _(t):
    return A.positive_concentration(P.labelled_spine(t), [10, 50, 100])


@query("w06_average_rank", "SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0::DOUBLE AS rank FROM lineitem")
def _(t):
    return W.average_rank(t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity")


@query("w07_numbered", "SELECT row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank, s_suppkey, s_acctbal FROM supplier ORDER BY 1 LIMIT 10")
def _(t):
    order = [F.col("s_acctbal").desc(), F.col("s_suppkey")]
    return W.numbered(t.raw("supplier").select("s_suppkey", "s_acctbal").orderBy(*order).limit(10), order)


@query("l01_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return t.raw("orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query("l02_topk_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber, l_partkey) <= 5")
def _(t):
    df = t.raw("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").withColumn("_tie", F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_partkey"))
    return R.topk(df, ["l_suppkey"], 5, "l_extendedprice", "_tie").drop("_tie", "rank")


@query("l03_global_topk", SCORED + " SELECT entity, obs, score FROM scored ORDER BY score DESC NULLS LAST, entity * 1000000 + (year(obs) * 100 + month(obs)) LIMIT 100")
def _(t):
    df = P.scored(t).withColumn("_tie", F.col("entity") * 1000000 + F.year("obs") * 100 + F.month("obs"))
    return R.global_topk(df, 100, "score", "_tie").select("entity", "obs", "score")


@query("l04_distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def _(t):
    return t.raw("lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("l06_group_limit", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(t):
    return A.top_values(t.raw("lineitem"), "l_partkey", 20)


@query("f_scalar_functions", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INT) AS days, CAST(CAST(o_orderdate AS DATE) - INTERVAL 3 MONTH AS DATE) AS back, CAST(o_orderdate AS DATE) + 90 AS ahead, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, split_part(o_orderpriority, '-', 2) AS word, replace(o_orderpriority, '-', '_') AS under, greatest(o_custkey, 700) AS g, round(o_totalprice / 3, 2) AS third, CASE WHEN o_custkey % 3 > 0 THEN o_totalprice / (o_custkey % 3) ELSE 0 END AS ratio FROM orders")
def _(t):
    d = F.col("o_orderdate").cast("date")
    return t.raw("orders").select(
        "o_orderkey", F.datediff(d, F.lit("1995-01-01").cast("date")).alias("days"), F.add_months(d, -3).alias("back"), F.date_add(d, 90).alias("ahead"), F.trunc(d, "month").alias("month"),
        F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("word"), F.replace("o_orderpriority", F.lit("-"), F.lit("_")).alias("under"), F.greatest("o_custkey", F.lit(700)).alias("g"),
        F.round(F.col("o_totalprice") / 3, 2).alias("third"), H.guarded(F.col("o_totalprice"), F.col("o_custkey") % 3).alias("ratio"),
    )


# --- event history ---


@query("o00_entity_month_spine", f"{BASE} SELECT obs, entity, code, owner, grp, first_date FROM spine")
def _(t):
    return H.entity_month_spine(t.entities(), LO, HI)


@query("o01_forward_label", f"{BASE}, {LABELLED} SELECT obs, entity, in_event, label FROM labelled")
def _(t):
    return P.labelled_spine(t).select("obs", "entity", "in_event", "label")


@query("o01_positives_per_month", f"{BASE}, {LABELLED} SELECT obs, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 9) AS rate FROM labelled GROUP BY 1")
def positives_per_month(t):
    return P.labelled_spine(t).groupBy("obs").agg(F.count("*").alias("n"), F.sum("label").cast("bigint").alias("positives"), F.round(F.avg("label"), 9).alias("rate"))


@query("o02_prior_event_counts", f"{BASE}, {OWN} SELECT entity, obs, events_12m, events_36m, events_all, was_ever FROM own")
def _(t):
    return H.prior_event_counts(H.entity_spans(t.entities(), LO, HI), t.events(), LO, HI)


@query("o03_event_recency", f"{BASE}, {OWN} SELECT entity, obs, days_since_last, days_since_first FROM own")
def _(t):
    return H.event_recency(H.entity_spans(t.entities(), LO, HI), t.events(), LO, HI)


@query("o04_longest_prior", f"{BASE}, {OWN} SELECT entity, obs, longest_days FROM own")
def _(t):
    return H.longest_prior(H.entity_spans(t.entities(), LO, HI), t.events(), LO, HI)


@query("o05_event_cycle", f"{BASE}, {OWN} SELECT entity, obs, mean_gap_days, days_since_last - mean_gap_days AS overdue_days FROM own")
def _(t):
    return H.event_cycle(H.entity_spans(t.entities(), LO, HI), t.events(), LO, HI)


@query("o06_owner_portfolio", f"{BASE}, {STANDING} SELECT owner, obs, portfolio FROM portfolio")
def _(t):
    return H.owner_portfolio(t.entities(), LO, HI)


@query("o07_owner_event_rate", f"{BASE}, {OWNER} SELECT owner, obs, portfolio, owner_events_12m, owner_events_3m, owner_rate_12m, owner_rate_3m, owner_rate_delta FROM owner_rates")
def _(t):
    return H.owner_event_rate(t.entities(), t.events(), LO, HI)


@query("o08_market_structure", f"{BASE}, {MARKET} SELECT w.grp, w.owner, w.obs, own_entities, group_entities, group_owners, own_entities::DOUBLE / group_entities AS share FROM own_share w JOIN market m ON w.obs = m.obs AND w.grp = m.grp")
def _(t):
    total, own = H.market_structure(t.entities(), LO, HI)
    return own.join(total, ["grp", "obs"]).withColumn("share", H.guarded(F.col("own_entities"), F.col("group_entities")))


@query("o09_peer_events", f"{BASE}, {NOW}, {PEERS} SELECT entity, obs, peer_events_12m, peer_in_event_now FROM peers")
def _(t):
    return H.peer_events(H.entity_spans(t.entities(), LO, HI), t.events(), LO, HI)


@query("o10_exit_signals", f"{BASE}, {EXITS}, {EXITSIG} SELECT g.grp, g.obs, coalesce(group_exits_12m, 0) AS group_exits_12m, coalesce(group_exits_36m, 0) AS group_exits_36m, days_since_group_exit FROM (SELECT DISTINCT grp, obs FROM spine) g LEFT JOIN gx ON g.grp = gx.grp AND g.obs = gx.obs")
def _(t):
    return H.exit_signals(t.exits(), H.entity_month_spine(t.entities(), LO, HI), LO, HI)[0]


@query("o10_owner_exits", f"{BASE}, {EXITS}, {EXITSIG} SELECT owner, obs, owner_exits_12m FROM ox")
def _(t):
    return H.exit_signals(t.exits(), H.entity_month_spine(t.entities(), LO, HI), LO, HI)[1]


@query("o11_coverage_breadth", f"{BASE}, {COVERAGE}, {COVER} SELECT entity, obs, n_jurisdictions, n_benefit_rows FROM cover")
def _(t):
    return H.coverage_breadth(H.entity_spans(t.entities(), LO, HI), t.coverage(), LO, HI)


@query("o12_static_type_flags", f"WITH {ITEMS}, {COVERAGE}, {TYPES} SELECT * FROM types")
def _(t):
    return H.static_type_flags(t.coverage(), "type", {"is_generic": "F", "is_brand": "O"})


@query("o13_entity_age_years", f"{BASE} SELECT entity, obs, CAST(obs - first_date AS DOUBLE) / 365.25 AS age_years FROM spine")
def _(t):
    return H.entity_month_spine(t.entities(), LO, HI).select("entity", "obs", H.entity_age_years(F.col("first_date"), F.col("obs")).alias("age_years"))


@query("o14_token_bridge", f"{BASE}, {TOKENS}, {FOREIGN} SELECT * FROM sig")
def _(t):
    return H.token_bridge_signals(H.entity_spans(t.entities(), LO, HI), t.entity_tokens(), t.foreign_events(), LO, HI)


@query("o15_event_measures", f"WITH {ITEMS} SELECT event_id, d AS start, CASE WHEN d + (q - 5) >= d THEN q - 5 END AS duration_days, CAST(d - CAST(o_orderdate AS DATE) AS INT) AS lead_days, -5 AS estimate_error_days, d + (q - 5) < d AS suspect_dates FROM items JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'")
def _(t):
    df = t.items().where("l_returnflag = 'R'").join(t.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("asked")), "l_orderkey")
    df = df.withColumns({"planned": F.date_add("d", F.col("q")), "stopped": F.date_add("d", F.col("q") - 5)})
    return H.event_measures(df, "asked", "d", "planned", "stopped").select("event_id", F.col("d").alias("start"), "duration_days", "lead_days", "estimate_error_days", "suspect_dates")


DIMENSION = f"""WITH {ITEMS}, full_ AS (SELECT i.*, s_name, n_name, o_orderpriority, c_mktsegment FROM items i LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey),
words AS (SELECT p_partkey AS code, string_agg(DISTINCT w, ' + ' ORDER BY w) AS ingredients, count(DISTINCT w) AS ingredients_count FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1),
company AS (SELECT entity, min(s_name) AS company, count(DISTINCT s_name) AS company_count FROM full_ GROUP BY 1),
form AS (SELECT entity, min(l_returnflag) AS form, count(DISTINCT l_returnflag) AS form_count FROM full_ GROUP BY 1),
route AS (SELECT entity, min(n_name) AS route, count(DISTINCT n_name) AS route_count FROM full_ GROUP BY 1),
class AS (SELECT entity, max(o_orderpriority) AS class_code, max(c_mktsegment) AS class_name FROM full_ GROUP BY 1),
schedule AS (SELECT entity, min(o_orderpriority) AS schedule FROM full_ WHERE o_orderpriority IS NOT NULL GROUP BY 1),
status AS (SELECT entity, l_linestatus AS current_status, d AS current_status_since FROM full_ QUALIFY row_number() OVER (PARTITION BY entity ORDER BY d DESC NULLS LAST, l_linestatus DESC) = 1),
marketed AS (SELECT entity, min(d) AS first_marketed FROM full_ WHERE l_linestatus = 'F' GROUP BY 1),
dim AS (SELECT p_partkey AS code, p_brand AS owner, p_type || '/' || p_size AS grp, ingredients, coalesce(ingredients_count, 0) AS ingredients_count, company, coalesce(company_count, 0) AS company_count, form, coalesce(form_count, 0) AS form_count, route, coalesce(route_count, 0) AS route_count, class_code, class_name, schedule, coalesce(schedule_count, 0) AS schedule_count, current_status, current_status_since, first_marketed
FROM part LEFT JOIN words ON p_partkey = words.code LEFT JOIN company c ON p_partkey = c.entity LEFT JOIN form f ON p_partkey = f.entity LEFT JOIN route r ON p_partkey = r.entity LEFT JOIN class k ON p_partkey = k.entity LEFT JOIN (SELECT entity, schedule, (SELECT count(DISTINCT o_orderpriority) FROM full_ x WHERE x.entity = y.entity) AS schedule_count FROM schedule y) s ON p_partkey = s.entity LEFT JOIN status t ON p_partkey = t.entity LEFT JOIN marketed m ON p_partkey = m.entity)"""


def _codes(t: Tables) -> DataFrame:
    return t.parts().select(F.col("entity").alias("code"), "owner", "grp")


def _sides(t: Tables, keep: D.Keep = lambda rows, column: rows) -> dict[str, D.Side]:
    """Eight side tables of the parts: words, suppliers, forms, nations, classes, schedules, status history twice."""
    makers = t.raw("supplier").join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", "n_name")
    orders = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_orderpriority", "c_mktsegment")
    items = keep(t.items().select("entity", "l_suppkey", "l_orderkey", "l_returnflag", "l_linestatus", "d"), "entity")
    items = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(makers, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    items = items.withColumn("filled", F.when(F.col("l_linestatus") == "F", F.col("d"))).drop("l_suppkey", "s_suppkey", "l_orderkey", "o_orderkey")
    words = keep(t.parts(), "entity").select("entity", F.explode(F.split("p_name", " ")).alias("word"))
    side = lambda rows, value, how, at=None: D.Side(rows, how, "entity", value, at)
    return {
        "ingredients": side(words, "word", "list"), "company": side(items, "s_name", "first"), "form": side(items, "l_returnflag", "first"), "route": side(items, "n_name", "first"),
        "class_code": side(items, "o_orderpriority", "last"), "class_name": side(items, "c_mktsegment", "last"), "schedule": side(items, "o_orderpriority", "first"),
        "current_status": side(items, "l_linestatus", "latest", "d"), "first_marketed": side(items, "l_linestatus", "earliest", "filled"),
    }


@query("o16_build_dimension", DIMENSION + " SELECT * FROM dim")
def _(t):
    return D.build_dimension(_codes(t), _sides(t))


@query("o16_canonical_by_entity", DIMENSION + " SELECT * FROM dim WHERE grp IS NOT NULL QUALIFY row_number() OVER (PARTITION BY grp ORDER BY CASE current_status WHEN 'O' THEN 0 WHEN 'F' THEN 1 WHEN current_status THEN 2 ELSE 3 END, code) = 1")
def _(t):
    return D.canonical_dimension(_codes(t), lambda keep: _sides(t, keep), "grp", "current_status", ["O", "F"])


@query("o17_build_panel", PANEL + " SELECT * FROM panel")
def _(t):
    return P.build_panel(t)


@query("o18_exclude_and_split", SHORT + " SELECT obs, entity, label, split FROM tagged WHERE split IS NOT NULL")
def _(t):
    return P.exclude_and_split(P.labelled_spine(t)).select("obs", "entity", "label", "split")


@query("o18_split_of_a_monthly_table", SHORT + " SELECT obs, entity, label, split FROM tagged WHERE split = 'test'")
def _(t):
    path = S.scratch_dir(t.spark, "panel")
    P.write_by_month(P.labelled_spine(t), path)
    panel = S.read_panel(t.spark, path, ["obs", "entity", "label", "in_event"])
    return P.exclude_and_split(panel, {"test": SPLITS["test"]}).select("obs", "entity", "label", "split")


@query("o19_split_summary", SHORT + " SELECT split, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 9) AS rate, count(DISTINCT entity) AS entities, count(DISTINCT obs) AS months, min(obs) AS first_obs, max(obs) AS last_obs, count(*) FILTER (WHERE label IS NULL) AS null_labels FROM tagged WHERE split IS NOT NULL GROUP BY 1")
def _(t):
    return P.split_summary(P.exclude_and_split(P.labelled_spine(t)))


# --- scoring and metrics ---


@query("e04_tag_strata", SCORED + ", tr AS (SELECT DISTINCT entity FROM short WHERE in_event = 0 AND obs BETWEEN DATE '1996-01-01' AND DATE '1996-06-01'), tg AS (SELECT s.*, unnest(['overall', CASE WHEN events_all > 0 THEN 'warm' ELSE 'cold' END, CASE WHEN tr.entity IS NOT NULL THEN 'seen' ELSE 'unseen' END, CASE WHEN owner IN ('Brand#11', 'Brand#22') THEN 'class_' || owner ELSE 'class_other' END]) AS stratum FROM scored s LEFT JOIN tr ON s.entity = tr.entity) SELECT stratum, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM tg GROUP BY 1")
def _(t):
    early = P.exclude_and_split(P.labelled_spine(t, *EARLY), {"early": EARLY})
    return R.tag_strata(P.scored(t), early, "events_all", "owner", ["Brand#11", "Brand#22"]).groupBy("stratum").agg(F.count("*").alias("n"), F.sum("label").cast("bigint").alias("positives"))


@query("e05_precision_at_k", SCORED + ", " + CURVES.format(k="obs", t="scored", tie="") + " SELECT obs, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(CASE WHEN rn <= 10 THEN label ELSE 0 END) AS BIGINT) AS hits_10, CAST(sum(CASE WHEN rn <= 100 THEN label ELSE 0 END) AS BIGINT) AS hits_100, CASE WHEN sum(label) > 0 AND sum(label) < count(*) AND count(*) >= 10 THEN sum(CASE WHEN rn <= 10 THEN label ELSE 0 END) / 10.0::DOUBLE END AS p_at_10, CASE WHEN sum(label) > 0 AND sum(label) < count(*) AND count(*) >= 100 THEN sum(CASE WHEN rn <= 100 THEN label ELSE 0 END) / 100.0::DOUBLE END AS p_at_100 FROM ranked GROUP BY obs")
def _(t):
    return R.precision_at_k(P.scored(t), ["obs"], [10, 100])


@query("e06_roc_auc", SCORED + ", " + CURVES.format(k="obs", t="scored", tie="") + " SELECT obs, round(CASE WHEN pos > 0 AND neg > 0 THEN (r - pos * (pos + 1) / 2.0::DOUBLE) / (pos::DOUBLE * neg) END, 9) AS roc_auc FROM area")
def _(t):
    return R.roc_auc(P.scored(t), ["obs"]).withColumn("roc_auc", F.round("roc_auc", 9))


@query("e07_pr_auc", SCORED + ", " + CURVES.format(k="obs", t="scored", tie="") + " SELECT obs, round(CASE WHEN pos > 0 AND neg > 0 THEN ap / pos END, 9) AS pr_auc FROM area")
def _(t):
    return R.pr_auc(P.scored(t), ["obs"]).withColumn("pr_auc", F.round("pr_auc", 9))


@query("e08_brier", SCORED + " SELECT obs, round(avg((score - label) * (score - label)), 9) AS brier FROM scored GROUP BY 1")
def _(t):
    return R.brier(P.scored(t), ["obs"]).withColumn("brier", F.round("brier", 9))


METRICS = " SELECT {k}, n, positives, p_at_10, p_at_50, positives::DOUBLE / n AS base_rate, round(CASE WHEN pos > 0 AND neg > 0 THEN (r - pos * (pos + 1) / 2.0::DOUBLE) / (pos::DOUBLE * neg) END, 9) AS roc_auc, round(CASE WHEN pos > 0 AND neg > 0 THEN ap / pos END, 9) AS pr_auc, brier FROM (SELECT {k}, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, CASE WHEN sum(label) > 0 AND sum(label) < count(*) AND count(*) >= 10 THEN sum(CASE WHEN rn <= 10 THEN label ELSE 0 END) / 10.0::DOUBLE END AS p_at_10, CASE WHEN sum(label) > 0 AND sum(label) < count(*) AND count(*) >= 50 THEN sum(CASE WHEN rn <= 50 THEN label ELSE 0 END) / 50.0::DOUBLE END AS p_at_50, round(avg((score - label) * (score - label)), 9) AS brier FROM ranked GROUP BY {k}) b JOIN area USING ({k})"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("roc_auc", "pr_auc", "brier")})


CLASSES = ["Brand#11", "Brand#22", "Brand#33"]


@query("e09_metrics_by_stratum", SCORED + ", tr AS (SELECT DISTINCT entity FROM short WHERE in_event = 0 AND obs BETWEEN DATE '1996-01-01' AND DATE '1996-06-01'), tg AS (SELECT s.*, s.entity * 1000000 + year(obs) * 100 + month(obs) AS tie, unnest(['overall', CASE WHEN events_all > 0 THEN 'warm' ELSE 'cold' END, CASE WHEN tr.entity IS NOT NULL THEN 'seen' ELSE 'unseen' END, CASE WHEN owner IN ('Brand#11', 'Brand#22', 'Brand#33') THEN 'class_' || owner ELSE 'class_other' END]) AS stratum FROM scored s LEFT JOIN tr ON s.entity = tr.entity), tt AS (SELECT stratum, label, score, tie AS entity FROM tg), " + CURVES.format(k="stratum", t="tt", tie="") + METRICS.format(k="stratum"))
def _(t):
    early = P.exclude_and_split(P.labelled_spine(t, *EARLY), {"early": EARLY})
    df = R.tag_strata(P.scored(t), early, "events_all", "owner", CLASSES)
    df = df.withColumn("entity", F.col("entity") * 1000000 + F.year("obs") * 100 + F.month("obs"))
    return _rounded(R.compute_metrics(df, ["stratum"], [10, 50]))


@query("e10_monthly_metrics", SCORED + ", " + CURVES.format(k="obs", t="scored", tie="") + METRICS.format(k="obs"))
def _(t):
    return _rounded(R.compute_metrics(P.scored(t), ["obs"], [10, 50]))


@query("e11_e12_heuristics_blend", SCORED + " SELECT obs, entity, single, compound, blend FROM scored")
def _(t):
    return P.blended(t).select("obs", "entity", "single", "compound", "blend")


TOPK = LONG + ", rk AS (SELECT *, row_number() OVER (PARTITION BY ranker, obs ORDER BY score DESC, entity) AS rn FROM long_), mon AS (SELECT ranker, obs, k, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(CASE WHEN rn <= k THEN label ELSE 0 END) AS BIGINT) AS hits, CASE WHEN sum(label) > 0 AND sum(label) < count(*) AND count(*) >= k THEN sum(CASE WHEN rn <= k THEN label ELSE 0 END) / k::DOUBLE END AS p_at_k FROM rk CROSS JOIN (SELECT unnest([10, 25, 50, 100]) AS k) GROUP BY 1, 2, 3)"


@query("e13_per_month_topk", TOPK + " SELECT * FROM mon")
def _(t):
    return R.per_month_topk(P.ranked_long(t), [10, 25, 50, 100])


@query("e14_summarize_topk", TOPK + " SELECT ranker, k, round(avg(p_at_k), 9) AS mean_p, round(median(p_at_k), 9) AS median_p, min(p_at_k) AS min_p, max(p_at_k) AS max_p, round(avg(hits), 9) AS mean_hits, round(avg(positives::DOUBLE / n), 9) AS base_rate, round(avg(p_at_k) / nullif(avg(positives::DOUBLE / n), 0), 9) AS lift FROM mon GROUP BY 1, 2")
def _(t):
    df = R.summarize_topk(R.per_month_topk(P.ranked_long(t), [10, 25, 50, 100]))
    return df.withColumns({c: F.round(c, 9) for c in ("mean_p", "median_p", "mean_hits", "base_rate", "lift")})


@query("e15_relative_lift", TOPK + ", s AS (SELECT ranker, avg(p_at_k) AS p FROM mon WHERE k = 50 GROUP BY 1) SELECT round(max(p) FILTER (WHERE ranker = 'blend'), 9) AS p, round(max(p) FILTER (WHERE ranker = 'single'), 9) AS p_base, round((max(p) FILTER (WHERE ranker = 'blend') - max(p) FILTER (WHERE ranker = 'single')) / nullif(max(p) FILTER (WHERE ranker = 'single'), 0), 9) + 0.0::DOUBLE AS gain FROM s")
def _(t):
    df = R.relative_lift(R.summarize_topk(R.per_month_topk(P.ranked_long(t), [10, 25, 50, 100])), 50, "blend", "single")
    return df.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in df.columns})  # a zero has no sign


def _bins(n: int) -> str:
    points = ", ".join(repr(i / n) for i in range(n + 1))
    return SCORED + f", ed AS (SELECT list_sort(list_distinct(quantile_cont(score, [{points}]))) AS e FROM scored), bn AS (SELECT s.*, len(list_filter(e[2:], lambda x: x < score)) AS bin FROM scored s, ed)"


@query("e17_reliability_table", _bins(20) + " SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(avg(score), 9) AS mean_score, round(avg(label), 9) AS positive_rate FROM bn GROUP BY 1")
def _(t):
    return R.reliability_table(P.scored(t), 20).withColumns({"mean_score": F.round("mean_score", 9), "positive_rate": F.round("positive_rate", 9)})


@query("e19_score_deciles", _bins(10) + " SELECT CAST(bin AS INT) AS bin, count(*) AS n, min(score) AS least, max(score) AS most FROM bn GROUP BY 1")
def _(t):
    return R.score_bins(P.scored(t), 10).groupBy("bin").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


@query("e20_fixed_buckets", f"{BASE} SELECT entity, obs, CASE WHEN a > 0 AND a <= 1 THEN 'to 1' WHEN a > 1 AND a <= 3 THEN '1 to 3' WHEN a > 3 AND a <= 100 THEN 'over 3' END AS bucket FROM (SELECT entity, obs, CAST(obs - first_date AS DOUBLE) / 365.25 AS a FROM spine)")
def _(t):
    age = H.entity_age_years(F.col("first_date"), F.col("obs"))
    return H.entity_month_spine(t.entities(), LO, HI).select("entity", "obs", R.fixed_buckets(age, [0, 1, 3, 100], ["to 1", "1 to 3", "over 3"]).alias("bucket"))


@query("e21_group_pr_auc", SCORED + ", " + CURVES.format(k="owner", t="scored", tie=", obs") + " SELECT owner, CAST(pos + neg AS BIGINT) AS n, CAST(pos AS BIGINT) AS positives, round(ap / pos, 9) AS pr_auc, pos::DOUBLE / (pos + neg) AS base_rate, round(ap / pos / (pos::DOUBLE / (pos + neg)), 9) AS lift FROM area WHERE pos + neg >= 50 AND pos >= 5 AND neg > 0")
def _(t):
    df = R.group_pr_auc(P.scored(t), "owner", 50)
    return df.withColumns({"pr_auc": F.round("pr_auc", 9), "lift": F.round("lift", 9)})


@query("e22_worst_misses", SCORED + " SELECT entity, obs, score FROM scored WHERE label = 1 ORDER BY score, entity, obs LIMIT 50")
def _(t):
    return R.worst_misses(P.scored(t), 50).select("entity", "obs", "score")


@query("e22_confident_false_positives", SCORED + " SELECT entity, obs, score FROM scored WHERE label = 0 ORDER BY score DESC, entity, obs LIMIT 50")
def _(t):
    return R.confident_false_positives(P.scored(t), 50).select("entity", "obs", "score")


@query("e22_missed_by_entity", SCORED + " SELECT entity, count(*) AS misses, max(score) AS best_score FROM scored WHERE label = 1 AND score < 0.5 GROUP BY 1 ORDER BY misses DESC, entity LIMIT 50")
def _(t):
    return R.missed_by_entity(P.scored(t), 0.5, 50)


@query("e23_top_picks", SCORED + ", b AS (SELECT entity, score, label FROM scored WHERE obs = (SELECT max(obs) FROM scored) ORDER BY score DESC, entity LIMIT 10) SELECT entity, score, label, row_number() OVER (ORDER BY score DESC, entity) AS rank, p_name AS name FROM b LEFT JOIN part ON p_partkey = entity")
def _(t):
    names = t.parts().select("entity", F.col("p_name").alias("name"))
    return R.top_picks(P.scored(t).select("obs", "entity", "label", "score"), names, 10).drop("obs")


@query("e23_cold_top_picks", SCORED + ", b AS (SELECT entity, score, label FROM scored WHERE obs = (SELECT max(obs) FROM scored) AND events_12m = 0 ORDER BY score DESC, entity LIMIT 10) SELECT entity, score, label, row_number() OVER (ORDER BY score DESC, entity) AS rank, p_name AS name FROM b LEFT JOIN part ON p_partkey = entity")
def _(t):
    names = t.parts().select("entity", F.col("p_name").alias("name"))
    return R.top_picks(P.scored(t).select("obs", "entity", "label", "score", "events_12m"), names, 10, "events_12m").drop("obs", "events_12m")


@query("e24_decile_capture", _bins(10) + " SELECT CAST(sum(label) AS BIGINT) AS positives, CAST(sum(CASE WHEN bin = 0 THEN label ELSE 0 END) AS BIGINT) AS bottom, CAST(sum(CASE WHEN bin < 3 THEN label ELSE 0 END) AS BIGINT) AS bottom_3, CAST(sum(CASE WHEN bin = (SELECT max(bin) FROM bn) THEN label ELSE 0 END) AS BIGINT) AS top FROM bn")
def _(t):
    return R.decile_capture(P.scored(t))


# --- data quality ---


@query("q01_q06_unique", "SELECT l_orderkey * 10 + l_linenumber AS event_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return Q.check_unique(t.items(), "event_id")


@query("q02_not_null", "SELECT unnest(['not_null(o_orderkey)', 'not_null(status)']) AS check, unnest([count(*) FILTER (WHERE o_orderkey IS NULL), count(*) FILTER (WHERE nullif(o_orderstatus, 'P') IS NULL)]) AS n_failed FROM orders")
def _(t):
    return Q.check_not_null(t.raw("orders").withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("P"))), ["o_orderkey", "status"])


@query("q03_accepted_values", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def _(t):
    return Q.check_accepted_values(t.raw("orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("q04_relationship", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t):
    return Q.check_relationship(t.raw("orders").select("o_custkey", "o_orderkey"), "o_custkey", t.raw("customer").where("c_acctbal > 0"), "c_custkey")


@query("q05_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity < 2 OR l_quantity > 49) AND l_returnflag = 'R'")
def _(t):
    return Q.check_range(t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), "l_quantity", 2, 49, F.col("l_returnflag") == "R").drop("l_returnflag")


@query("q07_equal_rowcount", f"{BASE}, {LABELLED} SELECT (SELECT count(*) FROM spine) AS rows_a, (SELECT count(*) FROM labelled) AS rows_b, (SELECT count(*) FROM spine) = (SELECT count(*) FROM labelled) AS equal")
def _(t):
    return Q.check_equal_rowcount(H.entity_month_spine(t.entities(), LO, HI), P.labelled_spine(t))


@query("q_summary", "SELECT 'unique(o_orderkey)' AS check, count(*) AS n_failed FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'range(o_totalprice)', count(*) FROM orders WHERE o_totalprice < 1000")
def _(t):
    o = t.raw("orders")
    return Q.summary({"unique(o_orderkey)": Q.check_unique(o, "o_orderkey"), "range(o_totalprice)": Q.check_range(o, "o_totalprice", 1000)})


# --- audit reports ---


@query("u01_duplicate_ids", f"{EV}, per AS (SELECT event_id, count(*) AS n FROM events_ GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_ids, count(*) FILTER (WHERE n > 1) AS dup_ids, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS dup_rows FROM per")
def _(t):
    return A.duplicate_ids(t.events(), "event_id")


@query("u01_duplicate_rows", f"{EV} SELECT event_id, entity, start, count(*) OVER (PARTITION BY event_id) AS n FROM events_ QUALIFY n > 1")
def _(t):
    return A.duplicate_rows(t.events().select("event_id", "entity", "start"), "event_id")


@query("u02_same_start", f"{EV} SELECT entity, start, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events_ GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return A.same_start(t.events())


@query("u03_overlaps", f"{EV} SELECT count(*) AS pairs, count(DISTINCT a.entity) AS entities FROM events_ a JOIN events_ b ON a.entity = b.entity AND a.event_id < b.event_id AND b.start > a.start AND b.start < a.stop")
def _(t):
    return A.overlaps(t.events())


@query("u04_missing_from_dimension", f"{EV}, dim AS (SELECT entity FROM parts WHERE p_size <= 40) SELECT count(DISTINCT entity) AS ids, count(*) AS n_rows, count(DISTINCT entity) FILTER (WHERE entity NOT IN (SELECT entity FROM dim)) AS missing_ids, count(*) FILTER (WHERE entity NOT IN (SELECT entity FROM dim)) AS missing_rows FROM events_")
def _(t):
    return A.missing_from_dimension(t.events(), t.parts().where("p_size <= 40"), "entity")


@query("u05_after_cancellation", f"{EV} SELECT count(*) AS events, count(DISTINCT e.entity) AS entities, round(avg(e.start - n.status_date), 6) AS mean_days FROM events_ e JOIN entities n ON e.entity = n.entity WHERE n.status LIKE 'CANCELLED%' AND e.start > n.status_date")
def _(t):
    return A.after_cancellation(t.events(), t.entities())


@query("u06_events_per_month", f"{EV} SELECT CAST(date_trunc('month', start) AS DATE) AS month, count(*) AS n FROM events_ GROUP BY 1")
def _(t):
    return A.per_month(t.events())


LAG = "WITH l AS (SELECT CAST(l_shipdate AS DATE) AS d, CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS INT) AS lag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _lags(t: Tables) -> DataFrame:
    return t.items().join(t.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("o")), "l_orderkey").select("d", F.datediff("d", "o").alias("lag"))


@query("u07_lag_percentiles", LAG + " SELECT count(lag) AS n, round(avg(lag), 6) AS mean, min(lag) AS least, max(lag) AS most, quantile_cont(lag, 0.5) AS p50, quantile_cont(lag, 0.95) AS p95, count(*) FILTER (WHERE lag < 0) AS negative FROM l")
def _(t):
    return A.lag_percentiles(_lags(t), "lag")


@query("u08_late_share", LAG + " SELECT CAST(date_trunc('month', d) AS DATE) AS month, count(*) AS n, count(*) FILTER (WHERE lag > 60) AS late, round(100.0::DOUBLE * count(*) FILTER (WHERE lag > 60) / count(*), 4) AS late_percent FROM l GROUP BY 1")
def _(t):
    return A.late_share(_lags(t), "d", "lag", 60)


@query("u09_several_statuses", "WITH k AS (SELECT l_partkey, string_agg(DISTINCT l_returnflag, ' + ' ORDER BY l_returnflag) AS combo, count(DISTINCT l_returnflag) AS n, count(DISTINCT l_linestatus) AS a FROM lineitem GROUP BY 1) SELECT combo, count(*) AS n_keys, count(*) FILTER (WHERE a > 1) AS inconsistent FROM k WHERE n > 1 GROUP BY 1")
def _(t):
    return A.several_statuses(t.raw("lineitem"), "l_partkey", "l_returnflag", "l_linestatus")


@query("u10_exit_shape", f"WITH {ITEMS}, {PARTS}, {ENTITIES}, {EXITS} SELECT count(*) AS n_rows, count(DISTINCT x.entity) AS entities, count(DISTINCT x.entity) FILTER (WHERE status LIKE 'CANCELLED%') AS cancelled, min(exit_date) AS first_exit, max(exit_date) AS last_exit FROM exits x LEFT JOIN entities e ON x.entity = e.entity")
def _(t):
    return A.exit_shape(t.exits(), t.entities())


@query("u11_event_then_exit", f"{EV}, {EXITS}, b AS (SELECT e.s, x.x FROM (SELECT entity, min(start) AS s FROM events_ GROUP BY 1) e JOIN (SELECT entity, min(exit_date) AS x FROM exits GROUP BY 1) x ON e.entity = x.entity) SELECT count(*) AS both, count(*) FILTER (WHERE s < x) AS event_first, round(avg(x - s) FILTER (WHERE s < x), 6) AS mean_days FROM b")
def _(t):
    return A.event_then_exit(t.events(), t.exits())


@query("u12_owner_stability", "WITH p AS (SELECT DISTINCT p_brand, p_type FROM part) SELECT (SELECT count(DISTINCT p_brand) FROM p) AS codes, (SELECT count(*) FROM (SELECT p_brand FROM p GROUP BY 1 HAVING count(*) > 1)) AS codes_many_names, (SELECT count(DISTINCT p_type) FROM p) AS names, (SELECT count(*) FROM (SELECT p_type FROM p GROUP BY 1 HAVING count(*) > 1)) AS names_many_codes")
def _(t):
    return A.owner_stability(t.raw("part"), "p_brand", "p_type")


@query("u13_date_patterns", f"{EV} SELECT count(*) AS n_rows, count(start) AS with_start, count(stop) AS with_end, count(*) FILTER (WHERE start IS NOT NULL AND stop IS NULL) AS open, count(*) FILTER (WHERE start > DATE '2001-06-01') AS future_start, count(*) FILTER (WHERE stop < start) AS inverted FROM events_")
def _(t):
    return A.date_patterns(t.events(), "2001-06-01")


@query("u14_lifetime_distribution", f"{EV}, per AS (SELECT entity, count(DISTINCT event_id) AS n FROM events_ GROUP BY 1) SELECT count(*) AS entities, round(avg(n), 6) AS mean, min(n) AS least, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75, quantile_cont(n, 0.95) AS p95, max(n) AS most FROM per")
def _(t):
    return A.lifetime_distribution(t.events())


@query("u15_label_crosstab", f"{BASE}, {LABELLED} SELECT count(*) AS n_rows, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE in_event = 1) AS excluded, count(*) FILTER (WHERE label = 1 AND in_event = 1) AS both FROM labelled")
def _(t):
    return A.label_crosstab(P.labelled_spine(t))


@query("u17_extremes", f"{BASE}, {OWNER} SELECT owner, obs, portfolio, owner_rate_12m FROM owner_rates ORDER BY owner_rate_12m DESC, owner, obs LIMIT 20")
def _(t):
    return A.extremes(H.owner_event_rate(t.entities(), t.events(), LO, HI).select("owner", "obs", "portfolio", "owner_rate_12m"), 20)


@query("u18_positives_per_entity", f"{BASE}, {LABELLED}, per AS (SELECT entity, sum(label) AS n FROM labelled GROUP BY 1) SELECT count(*) AS entities, count(*) FILTER (WHERE n = 0) AS without, round(avg(n), 6) AS mean, quantile_cont(CAST(n AS BIGINT), 0.5) AS p50, quantile_cont(CAST(n AS BIGINT), 0.95) AS p95, CAST(max(n) AS BIGINT) AS most FROM per")
def _(t):
    return A.positives_per_entity(P.labelled_spine(t))


@query("u19_top_values", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return A.top_values(t.raw("part"), "p_type", 10)


@query("u20_source_counts", "SELECT 'orders' AS source, count(*) AS n_rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'part', count(*) FROM part")
def _(t):
    return A.source_counts({n: t.raw(n) for n in ("orders", "lineitem", "events", "part")})


@query("u21_tables_by_schema", "SELECT n AS schema, count(*) AS n_tables, CAST(sum(r) AS BIGINT) AS n_rows FROM (SELECT 'dimension' AS n, count(*) AS r FROM part UNION ALL SELECT 'dimension', count(*) FROM supplier UNION ALL SELECT 'dimension', count(*) FROM nation UNION ALL SELECT 'fact', count(*) FROM orders UNION ALL SELECT 'fact', count(*) FROM lineitem) GROUP BY 1")
def _(t):
    schemas = {"dimension": ("part", "supplier", "nation"), "fact": ("orders", "lineitem")}
    return A.schema_counts({(schema, n): t.raw(n) for schema, names in schemas.items() for n in names})


# --- models (no SQL form) ---

#: Rounds at most, and rounds without a better area before boosting stops; fewer than the library's own, to end in minutes.
BOOST = (120, 15)


@query("e01_e02_logistic")
def _(t):
    df = P.modelled(t)
    train = df.where("split = 'train'")
    return M.predict(M.fit_logistic(train, M.SIGNS), df.where("split = 'test'")).select("obs", "entity", "label", "score")


@query("e03_boosted")
def _(t):
    df = P.modelled(t)
    return M.predict(M.fit_binned(df.where("split = 'train'"), df.where("split = 'val'"), *BOOST), df.where("split = 'test'")).select("obs", "entity", "label", "score")


@query("e16_sign_check")
def _(t):
    df = P.modelled(t)
    return M.sign_check(M.predict(M.fit_logistic(df.where("split = 'train'"), M.SIGNS), df.where("split = 'test'")), M.SIGNS)


@query("e18_feature_importance")
def _(t):
    df = P.modelled(t)
    return M.feature_importance(M.fit_binned(df.where("split = 'train'"), df.where("split = 'val'"), *BOOST), df)
