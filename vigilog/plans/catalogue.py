"""The registered queries over the log tables, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import counts, diagnose, entities, forest, robust, timing
from ..session import materialise
from ..sources import ingest
from . import detect, evaluate

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "detect_events"
EVENTS = detect.Log("event_id", "ts", ["user_id", "event_type"], ["value"], entity=("user_id",))


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


@query("SELECT event_id, count(event_type) OVER (PARTITION BY event_type) AS n, round(ln(1 + count(event_type) OVER (PARTITION BY event_type)), 6) AS conc FROM events")
def value_concentration(spark, d):
    return counts.value_counts(read(spark, d, "events"), "event_type", "n").select("event_id", "n", r6(F.log1p("n")).alias("conc"))


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem")
def joint_context(spark, d):
    return counts.joint_counts(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "n").select("l_orderkey", "l_linenumber", "n")


@query("""WITH c AS (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT greatest(10.0, quantile_disc(n, 0.99)) AS cut FROM (SELECT DISTINCT n FROM c))
SELECT l_orderkey, l_linenumber, n, CAST(cut AS DOUBLE) AS cut, n > 1 AND n >= cut AS fires FROM lineitem JOIN c USING (l_quantity), t""")
def numeric_reuse(spark, d):
    df = read(spark, d, "lineitem")
    made = counts.value_counts(df, "l_quantity", "n").crossJoin(F.broadcast(counts.adaptive_cut(df, ["l_quantity"], 10)))
    return made.select("l_orderkey", "l_linenumber", "n", "cut", ((F.col("n") > 1) & (F.col("n") >= F.col("cut"))).alias("fires"))


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS s, o_orderpriority AS p FROM orders)
SELECT o_orderkey, count(s) OVER (PARTITION BY s) AS alone, count(*) OVER (PARTITION BY s, p) AS joint FROM o""")
def missing_aware_counts(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("s"), F.col("o_orderpriority").alias("p"))
    return counts.joint_counts(counts.value_counts(df, "s", "alone"), ["s", "p"], "joint").select("o_orderkey", "alone", "joint")


_CHARS = """WITH v AS (SELECT DISTINCT text FROM {t} WHERE text IS NOT NULL), c AS (SELECT text, ch, count(*) AS c FROM (SELECT text, unnest(string_split(text, '')) AS ch FROM v WHERE text <> '') GROUP BY 1, 2),
m AS (SELECT text, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e, count(*) / sum(c) AS u FROM c GROUP BY 1)"""


@query(_CHARS.format(t="documents") + " SELECT doc_id, round(coalesce(e, 0), 6) AS entropy, round(coalesce(u, 0), 6) AS unique_ratio FROM documents LEFT JOIN m USING (text) WHERE text IS NOT NULL")
def text_measures(spark, d):
    df = read(spark, d, "documents").select("doc_id", "text")
    return df.join(text.text_measures(df, "text"), "text").select("doc_id", r6("entropy").alias("entropy"), r6("unique_ratio").alias("unique_ratio"))


@query(_CHARS.format(t="documents") + """, n AS (SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1), t AS (SELECT greatest(10.0, quantile_disc(n, 0.99)) AS cut FROM (SELECT DISTINCT n FROM n))
SELECT doc_id, n.n > 1 AND n.n >= cut AS repeat_value, coalesce(e, 0) > 0 AND coalesce(e, 0) <= 1.5 AND length(text) >= 5 AS low_entropy FROM documents JOIN n USING (text) LEFT JOIN m USING (text), t""")
def text_rules(spark, d):
    df = read(spark, d, "documents").select("doc_id", "text").filter("text is not null")
    made = counts.value_counts(df, "text", "n").join(text.text_measures(df, "text"), "text").crossJoin(F.broadcast(counts.adaptive_cut(df, ["text"], 10)))
    low = (F.col("entropy") > 0) & (F.col("entropy") <= 1.5) & (F.char_length("text") >= 5)
    return made.select("doc_id", ((F.col("n") > 1) & (F.col("n") >= F.col("cut"))).alias("repeat_value"), low.alias("low_entropy"))


@query("""WITH k AS (SELECT 'p_name' AS "column", p_name AS v FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'p_type', p_type FROM part), c AS (SELECT "column", v, count(*) AS c FROM k WHERE v IS NOT NULL GROUP BY 1, 2),
a AS (SELECT "column", count(*) AS n_distinct, sum(CASE WHEN c >= 12 THEN c ELSE 0 END) / sum(c) AS m, avg(CASE WHEN left(v, 1) IN ('.', ':', '_', '-', '/') THEN 1.0 ELSE 0.0 END) AS p,
avg(CASE WHEN (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[.:_/-]')) OR length(v) >= 7 THEN 1.0 ELSE 0.0 END) AS s FROM c GROUP BY 1)
SELECT "column", n_distinct, round(m, 6) AS repeat_mass, round(p, 6) AS path_share, round(s, 6) AS structured, p >= 0.9 AS is_path, n_distinct <= 200 AND s < 0.5 AS is_vocabulary FROM a""")
def value_shapes(spark, d):
    made = text.shape(read(spark, d, "part"), ["p_name", "p_brand", "p_type"])
    return made.select("column", "n_distinct", r6("repeat_mass").alias("repeat_mass"), r6("path_share").alias("path_share"), r6("structured").alias("structured"), "is_path", "is_vocabulary")


@query("""WITH k AS (SELECT 'c_name' AS name, c_name AS v FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer)
SELECT name, count(DISTINCT CASE WHEN lower(trim(v)) NOT IN ('', 'na', 'n/a', 'null', 'none', 'nan', '-') THEN v END) AS n_unique, count(*) - count(CASE WHEN lower(trim(v)) NOT IN ('', 'na', 'n/a', 'null', 'none', 'nan', '-') THEN v END) AS n_missing,
CASE name WHEN 'c_name' THEN 'identifier' WHEN 'c_mktsegment' THEN 'categorical' ELSE 'numeric' END AS role FROM k GROUP BY name""")
def role_inference(spark, d):
    df = read(spark, d, "customer").select("c_name", "c_mktsegment", F.col("c_nationkey").cast("string"))
    schema = ingest.infer_schema(df)
    return spark.createDataFrame([(c.name, c.n_unique, c.n_missing, c.role) for c in schema.columns], "name string, n_unique long, n_missing long, role string")


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, regexp_extract(url, '[?&]ref=([^&#]*)', 1) AS ref, regexp_extract(url, '[?&]utm_source=([^&#]*)', 1) AS utm_source FROM pages""")
def url_expand(spark, d):
    df = ingest.expand_urls(read(spark, d, "pages").select("page_id", "url"), ["url"], order="page_id")
    pick = [F.col(f"url__{k}").alias(k) for k in ("path", "page", "ref", "utm_source")]
    return df.select("page_id", *pick)


@query("SELECT o_orderkey, CAST(coalesce(hour(o_orderdate), 0) AS INTEGER) AS hour, count(o_orderdate) OVER (PARTITION BY o_orderdate) AS same_instant FROM orders")
def hour_same_instant(spark, d):
    made = counts.value_counts(read(spark, d, "orders"), "o_orderdate", "same_instant")
    return made.select("o_orderkey", F.coalesce(F.hour("o_orderdate"), F.lit(0)).alias("hour"), "same_instant")


_US = "epoch_us(ts)"


@query(f"SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY {_US} RANGE BETWEEN 300000000 PRECEDING AND 300000000 FOLLOWING) AS burst FROM events")
def burst_window(spark, d):
    return timing.burst_counts(read(spark, d, "events"), ["event_type"], "ts", 600).select("event_id", "burst")


_RUNS = f"""WITH g AS (SELECT event_id, event_type, ({_US} - lag({_US}) OVER (PARTITION BY event_type ORDER BY {_US}, event_id)) / 1e6 AS gap, {_US} AS us FROM events),
r AS (SELECT *, coalesce(sum(CASE WHEN gap > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY us, event_id), 0) AS run FROM g),
s AS (SELECT event_type, run, count(*) AS run_size, avg(CASE WHEN gap <= 600 THEN gap END) AS m, stddev_pop(CASE WHEN gap <= 600 THEN gap END) AS sd FROM r GROUP BY 1, 2)"""


@query(_RUNS + " SELECT event_id, CAST(run AS BIGINT) AS run, run_size, round(CASE WHEN run_size >= 3 AND m > 0 THEN sd ELSE 999 END, 3) AS dt_std, round(CASE WHEN run_size >= 3 AND m > 0 THEN sd / m ELSE 999 END, 6) AS dt_cv FROM r JOIN s USING (event_type, run)")
def runs_cadence(spark, d):
    made = timing.runs(read(spark, d, "events"), ["event_type"], "ts", "event_id", 600)
    return made.select("event_id", "run", "run_size", F.round("dt_std", 3).alias("dt_std"), r6("dt_cv").alias("dt_cv"))


_GRID = """WITH t AS (SELECT DISTINCT epoch_us(o_orderdate) AS us FROM orders WHERE o_orderdate IS NOT NULL), g AS (SELECT us - lag(us) OVER (ORDER BY us) AS gap FROM t), s AS (SELECT gap, count(*) AS n FROM g WHERE gap > 0 GROUP BY 1 ORDER BY n DESC, gap LIMIT 1)"""


@query(_GRID + " SELECT gap, n FROM s")
def timestamp_grid(spark, d):
    return timing.grid(read(spark, d, "orders"), "o_orderdate")


@query(_GRID + """, p AS (SELECT us % gap AS phase FROM t, s GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, coalesce(least((epoch_us(o_orderdate) - phase + gap) % gap, gap - (epoch_us(o_orderdate) - phase + gap) % gap) <= 1000, false) AS on_grid FROM orders, s, p""")
def on_grid(spark, d):
    return timing.on_grid(read(spark, d, "orders"), "o_orderdate").select("o_orderkey", "on_grid")


_BINS = """b AS (SELECT event_id, user_id, event_type, CAST(greatest(((row_number() OVER (ORDER BY value, event_id) - 1) * 8 + count(*) OVER () - 2) // (count(*) OVER () - 1) - 1, 0) AS INTEGER) AS bin FROM events WHERE value IS NOT NULL)"""


@query(f"WITH {_BINS} SELECT event_id, bin FROM b")
def quantile_bins(spark, d):
    return entities.quantile_bins(read(spark, d, "events"), "value", ["event_id"]).select("event_id", "bin")


_DIVERSITY = f"""WITH {_BINS}, k AS (SELECT user_id, 'event_type' AS col, event_type AS v FROM b UNION ALL SELECT user_id, 'bin', CAST(bin AS VARCHAR) FROM b), c AS (SELECT user_id, col, v, count(*) AS c FROM k GROUP BY 1, 2, 3),
e AS (SELECT user_id, col, sum(c) AS volume, CASE WHEN sum(c) > 1 THEN (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(sum(c)) ELSE 0 END AS d FROM c GROUP BY 1, 2), m AS (SELECT user_id, CAST(max(volume) AS BIGINT) AS volume, CASE WHEN max(volume) < 2 THEN 1.0 ELSE avg(d) END AS diversity FROM e GROUP BY 1)"""


def _diversity(spark, d):
    binned = entities.quantile_bins(read(spark, d, "events"), "value", ["event_id"])
    return binned, entities.diversity(binned, "user_id", ["event_type", "bin"])


@query(_DIVERSITY + " SELECT user_id, volume, round(diversity, 6) AS diversity FROM m")
def entity_diversity(spark, d):
    return _diversity(spark, d)[1].select("user_id", "volume", r6("diversity").alias("diversity"))


@query(_DIVERSITY + """, t AS (SELECT least(0.2, coalesce(quantile_cont(round(diversity, 12), 0.1), 0)) AS cut FROM b JOIN m USING (user_id) WHERE volume >= 12)
SELECT event_id, round(cut, 6) AS cut, volume >= 12 AND round(diversity, 12) <= cut AS fires FROM b JOIN m USING (user_id), t""")
def entity_monotony(spark, d):
    rows, per = _diversity(spark, d)
    joined = rows.join(per, "user_id")
    fires = (F.col("volume") >= 12) & (F.round("diversity", 12) <= F.col("cut"))
    return joined.crossJoin(F.broadcast(entities.monotony_cut(joined))).select("event_id", r6("cut").alias("cut"), fires.alias("fires"))


_LINKS = "l AS (SELECT 'C' || o_custkey AS cust, 'S' || l_suppkey AS supp, l_returnflag AS flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _links(spark, d):
    joined = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    links = joined.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("cust"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("supp"), F.col("l_returnflag").alias("flag"))
    return materialise(links, "links")


@query(f"""WITH {_LINKS} SELECT 'cust' AS "column", cust AS value, count(DISTINCT supp) AS degree FROM l GROUP BY 2 UNION ALL SELECT 'supp', supp, count(DISTINCT cust) FROM l GROUP BY 2""")
def entity_degree(spark, d):
    return entities.degrees(_links(spark, d), ["cust", "supp"])


_GRAPH = f"""WITH {_LINKS}, n AS (SELECT 'cust' AS col, cust AS value, supp AS other, flag FROM l UNION ALL SELECT 'supp', supp, cust, flag FROM l), dg AS (SELECT col, value, count(DISTINCT other) AS degree, count(*) AS volume FROM n GROUP BY 1, 2),
f AS (SELECT col, value, flag, count(*) AS c FROM n GROUP BY 1, 2, 3), dv AS (SELECT col, value, CASE WHEN sum(c) > 1 THEN (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(sum(c)) ELSE 1 END AS diversity FROM f GROUP BY 1, 2), g AS (SELECT * FROM dg JOIN dv USING (col, value))"""


@query(_GRAPH + """ SELECT col AS "column", value, degree, CAST(0 AS BIGINT) AS reverse_degree, volume, round(diversity, 6) AS diversity FROM g""")
def actor_graph(spark, d):
    made = entities.actor_graph(_links(spark, d), ["cust", "supp"], ["flag"])
    return made.withColumn("diversity", r6("diversity"))


@query("""WITH l AS (SELECT 'k' || (o_custkey * 7 + l_quantity // 10) % 400 AS a, 'k' || (l_suppkey * 11 + l_linenumber) % 600 AS b, l_returnflag AS flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT 'a' AS col, a AS value, b AS other FROM l UNION ALL SELECT 'b', b, a FROM l), g AS (SELECT col, value, count(DISTINCT CASE WHEN other <> value THEN other END) AS degree FROM n GROUP BY 1, 2)
SELECT x.col AS "column", x.value, x.degree, coalesce(y.degree, 0) AS reverse_degree FROM g x LEFT JOIN g y ON x.value = y.value AND x.col <> y.col""".replace("l_quantity // 10", "CAST(floor(l_quantity / 10) AS BIGINT)"))
def reverse_degree(spark, d):
    joined = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = lambda c, n: F.concat(F.lit("k"), (c % n).cast("string"))
    links = joined.select(named(F.col("o_custkey") * 7 + F.floor(F.col("l_quantity") / 10), 400).alias("a"), named(F.col("l_suppkey") * 11 + F.col("l_linenumber"), 600).alias("b"), F.col("l_returnflag").alias("flag"))
    return entities.actor_graph(materialise(links, "links"), ["a", "b"], ["flag"]).select("column", "value", "degree", "reverse_degree")


_PAIR = """WITH p AS (SELECT 'S' || l_suppkey AS a, 'P' || l_partkey % 500 AS b FROM lineitem), q AS (SELECT 'supplier' AS col, a, b FROM p UNION ALL SELECT 'part', b, a FROM p),
n AS (SELECT col, a, count(*) AS n, count(DISTINCT b) AS met FROM q GROUP BY 1, 2 HAVING count(*) >= 12), m AS (SELECT col, b, count(*) / sum(count(*)) OVER (PARTITION BY col) AS share FROM q GROUP BY 1, 2),
x AS (SELECT col, n, sum(1 - pow(1 - share, n)) AS expected FROM (SELECT DISTINCT col, n FROM n) JOIN m USING (col) GROUP BY 1, 2)"""


@query(_PAIR + """ SELECT col AS "column", CASE col WHEN 'part' THEN 'supplier' ELSE 'part' END AS other, count(*) AS recurring_values, round(sum(n * met / expected) / sum(n), 6) AS selectivity FROM n JOIN x USING (col, n) GROUP BY col""")
def counterpart_selectivity(spark, d):
    pairs = read(spark, d, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("supplier"), F.concat(F.lit("P"), (F.col("l_partkey") % 500).cast("string")).alias("part"))
    return diagnose.selectivity(pairs, [("supplier", "part"), ("part", "supplier")]).withColumn("selectivity", r6("selectivity"))


_AUDITED = """WITH k AS (SELECT 'l_suppkey' AS col, CAST(l_suppkey AS VARCHAR) AS v FROM lineitem UNION ALL SELECT 'l_quantity', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) FROM lineitem UNION ALL SELECT 'l_shipped', strftime(l_shipdate, '%Y-%m') FROM lineitem),
c AS (SELECT col, v, count(*) AS c, (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[.:_/-]')) OR length(v) >= 7 AS s FROM k WHERE v IS NOT NULL GROUP BY 1, 2)"""


def _audited(spark, d):
    return read(spark, d, "lineitem").select("l_suppkey", "l_quantity", F.date_format("l_shipdate", "yyyy-MM").alias("l_shipped")), ["l_suppkey", "l_quantity", "l_shipped"]


@query(_AUDITED + """, a AS (SELECT col, count(*) AS n_distinct, count(*) FILTER (c >= 12) AS recurring, CAST(coalesce(sum(c) FILTER (c >= 12), 0) AS DOUBLE) / sum(c) AS mass, avg(CASE WHEN s THEN 1.0 ELSE 0 END) AS st FROM c GROUP BY 1)
SELECT col AS "column", n_distinct, recurring, round(mass, 6) AS repeat_mass, n_distinct <= 200 AND st < 0.5 AS is_vocabulary, n_distinct > 50 AND recurring >= 2 AND mass >= 0.3 AND NOT (n_distinct <= 200 AND st < 0.5) AS would_qualify FROM a""")
def actor_audit(spark, d):
    return diagnose.actor_audit(*_audited(spark, d)).withColumn("repeat_mass", r6("repeat_mass"))


@query(_AUDITED + """, e AS (SELECT col, CASE WHEN regexp_full_match(v, '[0-9]+') THEN length(v) END AS len, count(*) AS n, sum(CASE WHEN s THEN 1 ELSE 0 END) AS st, sum(CASE WHEN left(v, 1) IN ('.', ':', '_', '-', '/') THEN 1 ELSE 0 END) AS le, sum(length(regexp_replace(v, '[^.:_/-]', '', 'g'))) AS se FROM c GROUP BY 1, 2)
SELECT col AS "column", round(sum(st) / sum(n), 6) AS structured_fraction, round(sum(le) / sum(n), 6) AS leading_separator_fraction, round(sum(se) / sum(n), 6) AS mean_separator_count, round(coalesce(sum(n) FILTER (len IS NOT NULL), 0) / sum(n), 6) AS pure_digit_fraction,
round(max(n) FILTER (len IS NOT NULL) / sum(n) FILTER (len IS NOT NULL), 6) AS dominant_digit_length_share FROM e GROUP BY 1""")
def value_grammar(spark, d):
    made = diagnose.grammar(*_audited(spark, d))
    return made.select("column", *[r6(c).alias(c) for c in made.columns[1:]])


@query(_GRAPH + """, t AS (SELECT quantile_cont(degree, 0.99) AS floor FROM g WHERE degree >= 3) SELECT value, degree, volume FROM g, t WHERE col = 'supp' AND volume >= 12 AND degree >= floor AND degree >= 10 AND round(diversity, 12) <= 0.2""")
def asymmetric_degree(spark, d):
    return entities.asymmetric(entities.actor_graph(_links(spark, d), ["cust", "supp"], ["flag"]), "supp").select("value", "degree", "volume")


_Z = """WITH m AS (SELECT median(value) AS md FROM events), a AS (SELECT median(abs(value - md)) AS mad, stddev_pop(value) AS sd FROM events, m),
z AS (SELECT event_id, value, (value - md) / CASE WHEN mad > 0 THEN 1.4826 * mad WHEN sd > 0 THEN sd ELSE 1 END AS z FROM events, m, a)"""


@query(_Z + " SELECT event_id, round(z, 6) AS z FROM z")
def robust_z(spark, d):
    return robust.robust_z(read(spark, d, "events"), ["value"]).select("event_id", r6("value__z").alias("z"))


@query(_Z + ", s AS (SELECT min(abs(z)) AS lo, max(abs(z)) AS hi FROM z) SELECT event_id, round((abs(z) - lo) / (hi - lo), 6) AS score FROM z, s")
def deviation_score(spark, d):
    return robust.deviation_score(read(spark, d, "events"), ["value"], "score").select("event_id", r6("score").alias("score"))


@query("SELECT event_id, round((rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0) / count(*) OVER (), 6) AS percentile FROM events")
def percentile_rank(spark, d):
    return robust.percentile_ranks(read(spark, d, "events"), "value").select("event_id", r6("percentile").alias("percentile"))


@query("""WITH m AS (SELECT median(l_quantity) AS q, median(l_discount) AS d, median(l_tax) AS x FROM lineitem), a AS (SELECT median(abs(l_quantity - q)) AS qa, median(abs(l_discount - d)) AS da, median(abs(l_tax - x)) AS xa FROM lineitem, m),
k AS (SELECT l_orderkey * 10 + l_linenumber AS id, unnest([0, 1, 2]) AS ord, unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax]) AS value, unnest([(l_quantity - q) / (1.4826 * qa), (l_discount - d) / (1.4826 * da), (l_tax - x) / (1.4826 * xa)]) AS z FROM lineitem, m, a WHERE l_quantity >= 49),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY round(abs(z), 9) DESC, ord) AS INTEGER) AS place FROM k) SELECT id, feature, value, round(z, 6) AS z, place FROM r WHERE place <= 2""")
def feature_deviations(spark, d):
    df = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_discount", "l_tax")
    made = robust.feature_deviations(df, "id", ["l_quantity", "l_discount", "l_tax"], F.col("l_quantity") >= 49, 2)
    return made.select("id", "feature", "value", r6("z").alias("z"), "place")


@query("""WITH p AS (SELECT value, row_number() OVER (ORDER BY value DESC, event_id) AS r, count(*) OVER () AS n, min(value) OVER () AS lo, max(value) OVER () AS hi FROM events)
SELECT round(value, 6) AS threshold FROM p ORDER BY round(abs((value - lo) / (hi - lo) - (1 - (r - 1) / (n - 1))), 12) DESC, r LIMIT 1""")
def knee_geometric(spark, d):
    return robust.geometric_knee(read(spark, d, "events"), "value", "event_id").select(r6("threshold").alias("threshold"))


@query("SELECT event_id, value > q AS over FROM events, (SELECT quantile_cont(value, 0.98) AS q FROM events)")
def rate_cap(spark, d):
    df = read(spark, d, "events")
    return df.select("event_id", (F.col("value") > F.lit(counts.quantiles(df, ["value"], [0.98]).get(("value", 0.98)))).alias("over"))


# The whole detection of the event table: features, rules, deviation score, knee and decision.
_DETECT = f"""WITH e AS (SELECT event_id, ts, {_US} AS us, user_id, event_type, value FROM events),
c AS (SELECT *, count(user_id) OVER (PARTITION BY user_id) AS un, count(event_type) OVER (PARTITION BY event_type) AS tn, count(*) OVER (PARTITION BY user_id, event_type) AS cn, count(value) OVER (PARTITION BY value) AS vn, count(ts) OVER (PARTITION BY ts) AS sn,
count(*) OVER (PARTITION BY user_id, event_type ORDER BY us RANGE BETWEEN 300000000 PRECEDING AND 300000000 FOLLOWING) AS bn, (us - lag(us) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id)) / 1e6 AS gap FROM e),
r0 AS (SELECT *, coalesce(sum(CASE WHEN gap > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id), 0) AS run FROM c),
s0 AS (SELECT user_id, event_type, run, count(*) AS rn, avg(CASE WHEN gap <= 600 THEN gap END) AS m, stddev_pop(CASE WHEN gap <= 600 THEN gap END) AS sd FROM r0 GROUP BY 1, 2, 3),
r AS (SELECT r0.*, rn, CASE WHEN rn >= 3 AND m > 0 THEN sd ELSE 999 END AS dstd, CASE WHEN rn >= 3 AND m > 0 THEN sd / m ELSE 999 END AS dcv FROM r0 JOIN s0 USING (user_id, event_type, run)),
{_BINS}, dk AS (SELECT user_id, 'event_type' AS col, event_type AS v FROM b UNION ALL SELECT user_id, 'bin', CAST(bin AS VARCHAR) FROM b), dc AS (SELECT user_id, col, v, count(*) AS c FROM dk GROUP BY 1, 2, 3),
de AS (SELECT user_id, col, sum(c) AS volume, CASE WHEN sum(c) > 1 THEN (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(sum(c)) ELSE 0 END AS d FROM dc GROUP BY 1, 2), dv AS (SELECT user_id, CAST(max(volume) AS BIGINT) AS volume, round(CASE WHEN max(volume) < 2 THEN 1.0 ELSE avg(d) END, 12) AS low FROM de GROUP BY 1),
a AS (SELECT * FROM r JOIN dv USING (user_id)),
t AS (SELECT (SELECT greatest(50.0, quantile_disc(n, 0.99)) FROM (SELECT DISTINCT count(*) AS n FROM events GROUP BY user_id)) AS uc, (SELECT greatest(50.0, quantile_disc(n, 0.99)) FROM (SELECT DISTINCT count(*) AS n FROM events GROUP BY user_id, event_type)) AS cc,
(SELECT greatest(10.0, quantile_disc(n, 0.99)) FROM (SELECT DISTINCT count(*) AS n FROM events GROUP BY value)) AS vc, (SELECT greatest(4.0, quantile_disc(n, 0.99)) FROM (SELECT DISTINCT count(*) AS n FROM events GROUP BY ts)) AS sc,
(SELECT least(0.2, coalesce(quantile_cont(low, 0.1), 0)) FROM a WHERE volume >= 12) AS dcut, (SELECT count(DISTINCT user_id) >= 20 FROM events) AS u20, (SELECT count(DISTINCT value) >= 20 FROM events) AS v20, (SELECT median(dstd) FROM r WHERE dstd < 999) AS mstd, (SELECT median(dcv) FROM r WHERE dstd < 999) AS mcv, (SELECT median(value) FROM events) AS mval),
f AS (SELECT a.*, CASE WHEN u20 AND un >= uc THEN 0.08 ELSE 0 END AS w1, CASE WHEN v20 AND vn > 1 AND vn >= vc THEN 0.12 ELSE 0 END AS w2, CASE WHEN cn >= cc THEN 0.10 ELSE 0 END AS w3, CASE WHEN sn >= sc THEN 0.40 ELSE 0 END AS w4, CASE WHEN bn >= 5 THEN 0.35 ELSE 0 END AS w5,
CASE WHEN rn >= 8 AND dcv <= 0.5 THEN 0.40 ELSE 0 END AS w6, CASE WHEN volume >= 12 AND low <= dcut THEN 0.70 ELSE 0 END AS w7, CASE WHEN dstd < 999 THEN dstd ELSE coalesce(mstd, 0) END AS fstd, CASE WHEN dstd < 999 THEN dcv ELSE coalesce(mcv, 0) END AS fcv, coalesce(value, mval) AS fval FROM a, t),
h AS (SELECT *, round(least(1.0, w4 + w5 + w6 + w7 + least(w1 + w2 + w3, 0.24)), 9) AS heuristic FROM f),
x AS (SELECT event_id, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]) AS k, unnest([ln(1 + un), ln(1 + tn), ln(1 + cn), fval, ln(1 + vn), CAST(coalesce(hour(ts), 0) AS DOUBLE), ln(1 + sn), ln(1 + bn), CASE WHEN dstd < 999 THEN 1.0 ELSE 0.0 END, ln(1 + fstd), ln(1 + fcv), low]) AS x FROM h),
xm AS (SELECT k, median(x) AS md, stddev_pop(x) AS sd FROM x GROUP BY 1), xa AS (SELECT k, median(abs(x - md)) AS mad FROM x JOIN xm USING (k) GROUP BY 1),
z AS (SELECT event_id, sum(abs((x - md) / CASE WHEN mad > 0 THEN 1.4826 * mad WHEN sd > 0 THEN sd ELSE 1 END)) / 12 AS raw FROM x JOIN xm USING (k) JOIN xa USING (k) GROUP BY 1), zz AS (SELECT min(raw) AS lo, max(raw) AS hi FROM z),
ml AS (SELECT event_id, round((raw - lo) / (hi - lo), 9) AS ml_score FROM z, zz),
p AS (SELECT ml_score AS v, row_number() OVER (ORDER BY ml_score DESC, event_id) AS pos, count(*) OVER () AS n, min(ml_score) OVER () AS lo, max(ml_score) OVER () AS hi FROM ml),
g AS (SELECT *, round(1 - (v - lo) / (hi - lo) - (pos - 1) / (n - 1), 12) AS d FROM p), gp AS (SELECT *, CASE WHEN d >= lag(d) OVER (ORDER BY pos) AND d > lead(d) OVER (ORDER BY pos) THEN 1 ELSE 0 END AS peak FROM g),
gs AS (SELECT *, sum(peak) OVER (ORDER BY pos) AS st FROM gp), ge AS (SELECT st, arg_min(v, pos) AS v, arg_min(d, pos) AS top, min(d) AS low, any_value(n) AS n, min(pos) AS pos FROM gs WHERE st > 0 GROUP BY 1),
th AS (SELECT greatest(coalesce((SELECT v FROM ge WHERE low < top - 1 / (n - 1) ORDER BY pos LIMIT 1), (SELECT v FROM g ORDER BY round(abs(d), 12) DESC, pos LIMIT 1)), (SELECT quantile_cont(ml_score, 0.98) FROM ml)) AS threshold),
q AS (SELECT h.*, ml_score, threshold, heuristic >= 0.7 AS hb, ml_score > threshold AS mb, greatest(heuristic, ml_score) AS combined FROM h JOIN ml USING (event_id), th),
o AS (SELECT *, hb OR mb AS is_bot, CASE WHEN hb AND mb THEN 1 WHEN hb THEN 2 WHEN mb THEN 3 ELSE 0 END AS tier FROM q)"""


@query(_DETECT + " SELECT event_id, un AS user_n, vn AS value_n, sn AS time_n, bn AS burst_n, CAST(heuristic AS DOUBLE) AS heuristic FROM h")
def rule_scores(spark, d):
    made = detect.apply_rules(detect.features(read(spark, d, "events"), EVENTS, 600), EVENTS)[0]
    return made.select("event_id", F.col("user_id__n").alias("user_n"), F.col("value__n").alias("value_n"), F.col("same_time__n").alias("time_n"), F.col("burst__n").alias("burst_n"), "heuristic")


def _decided(spark, d):
    """The detection by deviation scores, which SQL can express; ``forest_scores`` runs the forest."""
    return detect.detect(read(spark, d, "events"), EVENTS, 600, backend="deviation")


@query(_DETECT + " SELECT event_id, CAST(heuristic AS DOUBLE) AS heuristic, round(ml_score, 6) AS ml_score, is_bot, tier, round(combined, 6) AS combined FROM o")
def detect_events(spark, d):
    return _decided(spark, d).frame.select("event_id", "heuristic", r6("ml_score").alias("ml_score"), "is_bot", "tier", r6("combined").alias("combined"))


@query(_DETECT + """ SELECT count(*) AS n_rows, CAST(sum(CASE WHEN is_bot THEN 1 ELSE 0 END) AS BIGINT) AS n_flagged, round(avg(CASE WHEN is_bot THEN 1.0 ELSE 0 END), 6) AS rate, round(avg(CASE WHEN hb THEN 1.0 ELSE 0 END), 6) AS heuristic_rate, round(avg(CASE WHEN mb THEN 1.0 ELSE 0 END), 6) AS ml_rate,
count(*) FILTER (tier = 0) AS tier_0, count(*) FILTER (tier = 1) AS tier_1, count(*) FILTER (tier = 2) AS tier_2, count(*) FILTER (tier = 3) AS tier_3 FROM o""")
def detect_summary(spark, d):
    made = detect.summary(_decided(spark, d))
    return made.select(*[r6(c).alias(c) if c.endswith("rate") else F.col(c) for c in made.columns])


_HITS = """, hits AS (SELECT *, unnest([1, 2, 3, 4, 5, 6, 7]) AS k, unnest([w1, w2, w3, w4, w5, w6, w7]) AS w, unnest(['concentration', 'numeric_reuse', 'context_cluster', 'same_instant_burst', 'local_burst', 'regular_timing', 'entity_monotony']) AS rule_id, unnest(['user_id value holds ' || un || ' rows', 'value number occurs ' || vn || ' times', 'context holds ' || cn || ' rows', sn || ' rows at the same instant',
bn || ' rows of the context close in time', 'run of ' || rn || ' rows at a regular pace (cv ' || format('{:.2f}', dcv) || ')', 'entity repeats itself (diversity ' || format('{:.2f}', low) || ' over ' || volume || ' rows)']) AS reason FROM o)"""


@query(_DETECT + _HITS + " SELECT rule_id, reason, count(*) AS n FROM hits WHERE w > 0 AND is_bot GROUP BY 1, 2 ORDER BY n DESC, rule_id, reason LIMIT 10")
def top_reasons(spark, d):
    return detect.top_reasons(_decided(spark, d)).select("rule_id", "reason", "n")


@query(_DETECT + _HITS + ", hr AS (SELECT event_id, string_agg(reason, '; ' ORDER BY k) AS reasons FROM hits WHERE w > 0 GROUP BY 1) SELECT event_id, round(combined, 6) AS combined, tier, coalesce(reasons, '') AS reasons FROM (SELECT * FROM o WHERE is_bot ORDER BY combined DESC, event_id LIMIT 500) LEFT JOIN hr USING (event_id)")
def selected_events(spark, d):
    return detect.selected(_decided(spark, d)).select("event_id", r6("combined").alias("combined"), "tier", F.array_join("reasons", "; ").alias("reasons"))


@query(_DETECT + _HITS + """, ho AS (SELECT *, round(least(1.0, w4 + w5 + w6 + w7 - CASE WHEN k > 3 THEN w ELSE 0 END + least(w1 + w2 + w3 - CASE WHEN k <= 3 THEN w ELSE 0 END, 0.24)), 9) AS rest FROM hits WHERE w > 0)
SELECT rule_id, count(*) AS fires, count(*) FILTER (event_type = 'purchase') AS true_fires, count(*) FILTER (hb AND rest < 0.7 AND NOT mb) AS lost FROM ho GROUP BY 1""")
def rule_attribution(spark, d):
    return evaluate.attribution(_decided(spark, d).frame.withColumn("planted", (F.col("event_type") == "purchase").cast("int")))


def _forest_sql(depth: int = 12, trees: int = 100, sample: int = 4096, seed: int = 7) -> str:
    """The forest over (value, n) of the events, level by level: each node's digest draws, and the way of all rows through them."""
    from ..operators.forest import UNIT

    u = lambda *parts: f"(CAST('0x' || substr(md5(concat_ws('|', {seed}, {', '.join(parts)})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"
    number = lambda d, k: f"CAST('0x' || substr({d}, {4 * k + 1}, 4) AS BIGINT)"
    normal = lambda d: f"((({' + '.join(number(d, k) for k in range(8))}) / 65536.0::DOUBLE - 4.0::DOUBLE) * {UNIT!r}::DOUBLE)"
    parts = [f"""e AS MATERIALIZED (SELECT event_id, coalesce(value, 0) AS x0, CAST(count(event_type) OVER (PARTITION BY event_type) AS DOUBLE) AS x1 FROM events), size AS (SELECT count(*) AS held FROM e),
r0 AS MATERIALIZED (SELECT t.tree, 1 AS node, event_id, x0, x1 FROM e, range({trees}) t(tree), size WHERE held <= {sample} OR {u("t.tree", "event_id")} < {sample}.0::DOUBLE / held)"""]
    for d in range(depth):
        parts.append(f"""b{d} AS (SELECT tree, node, count(*) AS n, min(x0) AS l0, max(x0) AS h0, min(x1) AS l1, max(x1) AS h1 FROM r{d} GROUP BY 1, 2),
f{d} AS (SELECT *, h0 > l0 AND (h1 <= l1 OR md5(concat_ws('|', {seed}, tree, node, 'feature', 0)) < md5(concat_ws('|', {seed}, tree, node, 'feature', 1))) AS first, h0 > l0 AND h1 > l1 AS two, md5(concat_ws('|', {seed}, tree, node, 'weight', 0)) AS d1, md5(concat_ws('|', {seed}, tree, node, 'weight', 1)) AS d2 FROM b{d} WHERE n > 1 AND (h0 > l0 OR h1 > l1) AND {d} < (SELECT ceil(log2(greatest(2, least({sample}, held)))) FROM size)),
w{d} AS (SELECT *, {normal("d1")} AS w1, CASE WHEN two THEN {normal("d2")} ELSE 0 END AS w2, {u("tree", "node", "'point'", "0")} AS u1, {u("tree", "node", "'point'", "1")} AS u2, CASE WHEN first THEN l0 ELSE l1 END AS la, CASE WHEN first THEN h0 ELSE h1 END AS ha, CASE WHEN first = two THEN l1 ELSE l0 END AS lb, CASE WHEN first = two THEN h1 ELSE h0 END AS hb FROM f{d}),
n{d} AS MATERIALIZED (SELECT tree, node, first, two, w1, w2, w1 * (la + u1 * (ha - la)) + w2 * (lb + u2 * (hb - lb)) AS cut FROM w{d}),
r{d + 1} AS MATERIALIZED (SELECT tree, 2 * node + CASE WHEN (CASE WHEN first THEN x0 ELSE x1 END) * w1 + (CASE WHEN first = two THEN x1 ELSE x0 END) * w2 >= cut THEN 1 ELSE 0 END AS node, event_id, x0, x1 FROM r{d} JOIN n{d} USING (tree, node)),
k{d} AS (SELECT b.tree, b.node, {d} + CASE WHEN n > 1 THEN 2 * (ln(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n ELSE 0 END AS path FROM b{d} b ANTI JOIN n{d} USING (tree, node))""")
    parts.append(f"""k{depth} AS (SELECT tree, node, {depth} + CASE WHEN count(*) > 1 THEN 2 * (ln(count(*) - 1) + 0.5772156649015329) - 2.0 * (count(*) - 1) / count(*) ELSE 0 END AS path FROM r{depth} GROUP BY 1, 2),
usual AS (SELECT avg(CASE WHEN n > 1 THEN 2 * (ln(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n ELSE 0 END) AS c, count(*) AS trees FROM b0), leaves AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM k{d}" for d in range(depth + 1))}),
nodes AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM n{d}" for d in range(depth))}), p0 AS MATERIALIZED (SELECT event_id, x0, x1, tree, 1 AS node FROM e, (SELECT DISTINCT tree FROM r0))""")
    for d in range(depth):
        parts.append(f"""p{d + 1} AS MATERIALIZED (SELECT event_id, x0, x1, p.tree, CASE WHEN cut IS NULL THEN p.node ELSE 2 * p.node + CASE WHEN (CASE WHEN first THEN x0 ELSE x1 END) * w1 + (CASE WHEN first = two THEN x1 ELSE x0 END) * w2 >= cut THEN 1 ELSE 0 END END AS node FROM p{d} p LEFT JOIN nodes n ON p.tree = n.tree AND p.node = n.node)""")
    return f"""WITH {", ".join(parts)}
SELECT event_id, round(pow(2.0, -(sum(coalesce(path, floor(log2(p.node)))) / any_value(trees)) / any_value(c)), 6) AS ml_score FROM p{depth} p LEFT JOIN leaves l ON p.tree = l.tree AND p.node = l.node, usual GROUP BY event_id"""


@query(_forest_sql())
def forest_scores(spark, d):
    df = counts.value_counts(read(spark, d, "events"), "event_type", "n")
    return forest.forest_scores(df, ["value", "n"], "event_id").select("event_id", r6("ml_score").alias("ml_score"))


@query("""WITH x AS (SELECT l.doc_id, l.toxic = 1 AS planted, l.quality = 0 OR d.n_chars < 400 AS is_bot, d.lang FROM labels l JOIN documents d USING (doc_id)), g AS (SELECT CAST(NULL AS VARCHAR) AS archetype, planted, is_bot FROM x UNION ALL SELECT lang, planted, is_bot FROM x WHERE planted),
a AS (SELECT archetype, sum(CASE WHEN planted THEN 1 ELSE 0 END) AS p, sum(CASE WHEN is_bot THEN 1 ELSE 0 END) AS f, sum(CASE WHEN planted AND is_bot THEN 1 ELSE 0 END) AS r FROM g GROUP BY 1)
SELECT archetype, CAST(p AS BIGINT) AS planted, CAST(f AS BIGINT) AS flagged, CAST(r AS BIGINT) AS recovered, round(CASE WHEN p > 0 THEN r / p ELSE 0 END, 6) AS recall, round(CASE WHEN f > 0 THEN r / f ELSE 0 END, 6) AS precision FROM a""")
def planted_metrics(spark, d):
    x = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id")
    x = x.select("doc_id", (F.col("toxic") == 1).alias("planted"), ((F.col("quality") == 0) | (F.col("n_chars") < 400)).alias("is_bot"), F.col("lang").alias("archetype"))
    return evaluate.metrics(x).withColumn("recall", r6("recall")).withColumn("precision", r6("precision"))


@query("""WITH b AS (SELECT *, CASE WHEN starts_with(trim(o_orderpriority), '1-') THEN 1 WHEN starts_with(trim(o_orderpriority), '4-') OR starts_with(trim(o_orderpriority), '5-') THEN 0 END AS planted FROM orders),
m AS (SELECT * FROM (SELECT * FROM b WHERE planted = 1 ORDER BY o_orderdate NULLS LAST, o_orderkey LIMIT 500) UNION ALL SELECT * FROM b WHERE planted = 0)
SELECT o_orderkey, o_custkey, planted FROM m""")
def labelled_slice(spark, d):
    made = evaluate.slice_mix(read(spark, d, "orders"), "o_orderpriority", "o_orderdate", "o_orderkey", ("1-",), ("4-", "5-"), 500)
    return made.select("o_orderkey", "o_custkey", "planted")
