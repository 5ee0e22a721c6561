"""All queries of the engine proper, by name, with the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.functions import temporal, text
from quillmask.functions.generalise import generalised
from quillmask.operators import actions, coverage, detect, generate, profile, quality, relationships
from quillmask.operators.actions import Policy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _profile_sql(name: str, columns: list[str]) -> str:
    cells = " UNION ALL ".join(f"SELECT {i} AS column_index, '{c}' AS column_name, trim(coalesce({c}::VARCHAR, '')) AS v FROM {name}" for i, c in enumerate(columns))
    return rf"""
WITH cells AS ({cells}), t AS (SELECT *, CASE WHEN regexp_matches(v, '^[+-]?[0-9]+(\.[0-9]+)?$') THEN v::DOUBLE END AS x FROM cells)
SELECT column_index, column_name, count(*) AS observed, count(*) FILTER (v <> '') AS non_empty, count(*) FILTER (v = '') AS empty, count(DISTINCT v) FILTER (v <> '') AS distinct_values,
  min(length(v)) FILTER (v <> '') AS min_length, max(length(v)) FILTER (v <> '') AS max_length, count(x) AS numeric_count, min(x) AS minimum, max(x) AS maximum, round(avg(x), 4) AS mean,
  round(quantile_cont(x, 0.05), 6) AS p05, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95
FROM t GROUP BY ALL"""


def _profile(df: DataFrame, columns: list[str]) -> DataFrame:
    p = profile.column_profiles(df, columns)
    return p.select(
        "column_index", "column_name", "observed", "non_empty", "empty", F.col("distinct").alias("distinct_values"), "min_length", "max_length", "numeric_count", "minimum", "maximum",
        F.round("mean", 4).alias("mean"), F.round(F.col("quantiles")[1], 6).alias("p05"), F.round(F.col("quantiles")[3], 6).alias("p50"), F.round(F.col("quantiles")[5], 6).alias("p95"),
    )


LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query(_profile_sql("lineitem", LINEITEM))
def profile_lineitem(spark, d):
    return _profile(table(spark, d, "lineitem"), LINEITEM)


@query(_profile_sql("customer", CUSTOMER))
def profile_customer(spark, d):
    return _profile(table(spark, d, "customer"), CUSTOMER)


@query("""SELECT 'p_name' AS column_name, count(*) FILTER (p_name = upper(p_name)) AS case_upper, count(*) FILTER (p_name = lower(p_name)) AS case_lower FROM part
UNION ALL SELECT 'p_type', count(*) FILTER (p_type = upper(p_type)), count(*) FILTER (p_type = lower(p_type)) FROM part""")
def profile_case_histogram(spark, d):
    return profile.column_profiles(table(spark, d, "part"), ["p_name", "p_type"]).select("column_name", "case_upper", "case_lower")


@query("""WITH c AS (SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR, count(*) FROM orders GROUP BY ALL)
SELECT column_name, value, n, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM c QUALIFY rank <= 20""")
def profile_top_values(spark, d):
    return profile.top_values(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("SELECT column_name, key, n FROM (SELECT 'p_name' AS column_name, length(p_name)::INTEGER AS key, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'p_brand', length(p_brand)::INTEGER, count(*) FROM part GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY n DESC, key) <= 10")
def profile_common_lengths(spark, d):
    return profile.common_lengths(table(spark, d, "part"), ["p_name", "p_brand"])


@query(r"SELECT 'l_extendedprice' AS column_name, length(regexp_extract(l_extendedprice::VARCHAR, '\.([0-9]+)$', 1))::INTEGER AS key, count(*) AS n FROM lineitem GROUP BY ALL")
def profile_decimal_places(spark, d):
    return profile.decimal_places(table(spark, d, "lineitem"), ["l_extendedprice"])


_SHAPE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\p{{Lu}}', chr(1), 'g'), '\p{{Ll}}', chr(2), 'g'), '\p{{N}}', '9', 'g'), '\s', '␠', 'g')"


def _shape_sql(c: str) -> str:
    return f"replace(replace({_SHAPE.format(c)}, chr(1), 'A'), chr(2), 'a')"


@query(f"SELECT column_name, key, n FROM (SELECT 'c_name' AS column_name, {_shape_sql('c_name')} AS key, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'c_mktsegment', {_shape_sql('c_mktsegment')}, count(*) FROM customer GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY n DESC, key) <= 10")
def profile_shapes(spark, d):
    return profile.shapes(table(spark, d, "customer"), ["c_name", "c_mktsegment"])


@query("SELECT 'c_name' AS column_name, regexp_extract(c_name, '^([A-Za-z]{2,12})[0-9_./#-]', 1) AS key, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'c_mktsegment', NULL, 0 WHERE false")
def profile_structural_groups(spark, d):
    return profile.structural_groups(table(spark, d, "customer"), ["c_name", "c_mktsegment"])


@query()
def profile_estimated_distinct(spark, d):
    return profile.estimated_distinct(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_returnflag"])


@query()
def profile_top_values_sketch(spark, d):
    return profile.top_values_sketch(table(spark, d, "lineitem"), "l_partkey")


@query()
def profile_sample_values(spark, d):
    return profile.sample_values(table(spark, d, "part"), PART)


@query()
def profile_reservoir(spark, d):
    return profile.reservoir(table(spark, d, "lineitem"), "l_extendedprice")


_MONEY = "CASE c_custkey % 4 WHEN 0 THEN '$' || c_acctbal::VARCHAR WHEN 1 THEN 'AUD ' || c_acctbal::VARCHAR WHEN 2 THEN (c_custkey % 90)::VARCHAR || '%' ELSE '0' || (c_custkey % 90)::VARCHAR END"


def _money(df: DataFrame):
    b, k = df["c_acctbal"].cast("string"), df["c_custkey"]
    return F.when(k % 4 == 0, F.concat(F.lit("$"), b)).when(k % 4 == 1, F.concat(F.lit("AUD "), b)).when(k % 4 == 2, F.concat((k % 90).cast("string"), F.lit("%"))).otherwise(F.concat(F.lit("0"), (k % 90).cast("string")))


@query(rf"""WITH t AS (SELECT c_custkey, {_MONEY} AS t FROM customer), b AS (SELECT c_custkey, t, regexp_replace(t, '^(\$|AUD )|%$', '', 'g') AS b FROM t)
SELECT c_custkey, b::DOUBLE AS value, CASE WHEN t LIKE '$%' OR t LIKE 'AUD%' THEN 'CURRENCY_LIKE' WHEN t LIKE '%\%' ESCAPE '\' THEN 'PERCENTAGE' WHEN b LIKE '%.%' THEN 'DECIMAL' ELSE 'INTEGER' END AS kind,
length(regexp_extract(b, '\.([0-9]+)$', 1))::INTEGER AS decimal_places, CASE WHEN t LIKE '$%' THEN '$' WHEN t LIKE 'AUD%' THEN 'AUD' END AS currency_marker, length(regexp_replace(b, '[^0-9]', '', 'g'))::INTEGER AS digit_count, regexp_matches(b, '^[-+]?0[0-9]') AS leading_zero FROM b""")
def numeric_tokens(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", text.numeric_token(_money(c)).alias("t")).select("c_custkey", "t.*")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN -abs(c_acctbal) ELSE c_acctbal END AS value FROM customer")
def business_numbers(spark, d):
    c = table(spark, d, "customer")
    shown = F.when(c["c_custkey"] % 3 == 0, F.concat(F.lit("("), F.abs("c_acctbal").cast("string"), F.lit(")"))).otherwise(F.concat(c["c_acctbal"].cast("string")))
    return c.select("c_custkey", text.business_number(shown).alias("value"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN true WHEN event_type = 'error' THEN false END AS flag, event_type = 'purchase' AS missing FROM events")
def boolean_and_missing_tokens(spark, d):
    e = table(spark, d, "events")
    word = F.when(e["event_type"].isin("click", "view"), " Yes ").when(e["event_type"] == "error", "off").when(e["event_type"] == "purchase", "not available").otherwise("other")
    return e.select("event_id", text.boolean(word).alias("flag"), text.is_missing_sentinel(word).alias("missing"))


@query(f"SELECT event_id, {_shape_sql('props')} AS shape FROM events")
def value_shapes(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", text.value_shape(e["props"]).alias("shape"))


@query("SELECT p_partkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS fnv FROM part")
def stable_hashes(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", text.fnv1a(p["p_name"]).alias("fnv"))


@query(r"""SELECT p_partkey, len(regexp_extract_all(v, '[^\s,;|/]+'))::INTEGER AS items, len(regexp_extract_all(v, '[\s,;|/]+'))::INTEGER AS separators FROM (SELECT p_partkey, p_name || '; ' || p_brand || '|' || p_type AS v FROM part)""")
def multi_value_cells(spark, d):
    p = table(spark, d, "part")
    tokens = text.multi_value_tokens(F.concat(p["p_name"], F.lit("; "), p["p_brand"], F.lit("|"), p["p_type"]))
    kinds = lambda k: F.size(F.filter("tokens", lambda t: t["kind"] == k))
    return p.select("p_partkey", tokens.alias("tokens")).select("p_partkey", kinds("ITEM").alias("items"), kinds("SEPARATOR").alias("separators"))


_NOTE = "'Call +61 ' || (400000000 + c_custkey)::VARCHAR || ' or mail c' || c_custkey::VARCHAR || '@shop.example.com about ACCT ' || (10000 + c_custkey)::VARCHAR || ' no ' || (1234567 + c_custkey)::VARCHAR"


@query(rf"""SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_NOTE}, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b', '[EMAIL]', 'g'), '\+?\d[\d ()-]{{7,}}\d', '[PHONE_OR_NUMBER]', 'g'),
'(?i)\b(?:ID|REF|CASE|ACCOUNT|ACCT)[- _:#]*[A-Z0-9-]{{4,}}\b', '[IDENTIFIER]', 'g'), '\b\d{{6,}}\b', '[NUMBER]', 'g') AS note FROM customer""")
def text_sanitise(spark, d):
    c = table(spark, d, "customer")
    k = c["c_custkey"]
    note = F.concat(F.lit("Call +61 "), (k + 400000000).cast("string"), F.lit(" or mail c"), k.cast("string"), F.lit("@shop.example.com about ACCT "), (k + 10000).cast("string"), F.lit(" no "), (k + 1234567).cast("string"))
    return c.select("c_custkey", text.sanitised(note).alias("note"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '''=' || c_name WHEN c_custkey % 5 = 1 THEN '-' || abs(c_acctbal)::VARCHAR WHEN c_custkey % 5 = 2 THEN '''@' || c_name WHEN c_custkey % 5 = 3 THEN '''-x' || c_name ELSE c_name END AS cell FROM customer")
def excel_guard(spark, d):
    c = table(spark, d, "customer")
    k, n = c["c_custkey"] % 5, c["c_name"]
    cell = F.when(k == 0, F.concat(F.lit("="), n)).when(k == 1, F.concat(F.lit("-"), F.abs("c_acctbal").cast("string"))).when(k == 2, F.concat(F.lit("@"), n)).when(k == 3, F.concat(F.lit("-x"), n)).otherwise(n)
    return c.select("c_custkey", text.excel_safe(cell).alias("cell"))


def _weighted(weights: tuple[int, ...], less: int = 0) -> str:
    return " + ".join(f"({w} * (substr(v, {i + 1}, 1)::INTEGER - {less if i == 0 else 0}))" for i, w in enumerate(weights))


@query(f"""WITH t AS (SELECT o_orderkey, (51000000000 + o_orderkey * 7)::VARCHAR AS v FROM orders), n AS (SELECT o_orderkey, (100000000 + o_orderkey * 3)::VARCHAR AS v FROM orders)
SELECT t.o_orderkey, t.abn, n.tfn, n.acn FROM (SELECT o_orderkey, ({_weighted(text.AU_WEIGHTS["ABN"][0], 1)}) % 89 = 0 AS abn FROM t) t
JOIN (SELECT o_orderkey, ({_weighted(text.AU_WEIGHTS["TFN"][0])}) % 11 = 0 AS tfn, (10 - ({_weighted(text.AU_WEIGHTS["ACN"][0])}) % 10) % 10 = substr(v, 9, 1)::INTEGER AS acn FROM n) n USING (o_orderkey)""")
def au_checksums(spark, d):
    o = table(spark, d, "orders")
    abn, nine = (o["o_orderkey"] * 7 + 51000000000).cast("string"), (o["o_orderkey"] * 3 + 100000000).cast("string")
    return o.select("o_orderkey", text.au_identifier_valid(abn, "ABN").alias("abn"), text.au_identifier_valid(nine, "TFN").alias("tfn"), text.au_identifier_valid(nine, "ACN").alias("acn"))


@query("""WITH m AS (SELECT c_custkey, c_acctbal AS x, pow(10, greatest(0, floor(log10(CASE WHEN c_acctbal = 0 THEN 1 ELSE abs(c_acctbal) END)) - 2)) AS m FROM customer)
SELECT c_custkey, (floor(x / m) * m)::BIGINT::VARCHAR || '-' || (floor(x / m) * m + m - m)::BIGINT::VARCHAR AS low, (floor(x / (m * 5)) * (m * 5))::BIGINT::VARCHAR || '-' || (floor(x / (m * 5)) * (m * 5) + m * 5 - m)::BIGINT::VARCHAR AS medium,
(floor(x / (m * 10)) * (m * 10))::BIGINT::VARCHAR || '-' || (floor(x / (m * 10)) * (m * 10) + m * 10 - m)::BIGINT::VARCHAR AS high FROM m""")
def generalise_numeric_band(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", *[generalised(c["c_acctbal"], "balance", "DECIMAL", level=level).alias(level.lower()) for level in ("LOW", "MEDIUM", "HIGH")])


@query("SELECT p_partkey, (p_size // 10 * 10)::VARCHAR || '-' || (p_size // 10 * 10 + 9)::VARCHAR AS age, substr(lpad((p_partkey % 9000)::VARCHAR, 4, '0'), 1, 2) || '**' AS postcode, 'Text length ' || (greatest(1, length(p_name) - 1) // 20 * 20 + 1)::VARCHAR || '-' || (greatest(1, length(p_name) - 1) // 20 * 20 + 20)::VARCHAR AS length FROM part")
def generalise_age_postcode_text(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", generalised(p["p_size"], "age").alias("age"), generalised(F.lpad((p["p_partkey"] % 9000).cast("string"), 4, "0"), "post code").alias("postcode"), generalised(p["p_name"], "notes").alias("length"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-01') AS low, strftime(o_orderdate, '%Y-01-01') AS medium, (year(o_orderdate) // 10 * 10)::VARCHAR || '-01-01' AS high FROM orders")
def generalise_dates(spark, d):
    o = table(spark, d, "orders")
    day = o["o_orderdate"].cast("date").cast("string")
    return o.select("o_orderkey", *[generalised(day, "ordered", "DATE", level=level).alias(level.lower()) for level in ("LOW", "MEDIUM", "HIGH")])


@query("SELECT c_custkey, 'Synthetic Market Segment Group ' || (list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(c_mktsegment, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 10 + 1)::VARCHAR AS segment FROM customer")
def generalise_category_group(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", generalised(c["c_mktsegment"], "marketSegment", "CATEGORY").alias("segment"))


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 45 DAY, '%Y-%m-%d') AS ymd, strftime(o_orderdate - INTERVAL 10 DAY, '%d/%m/%Y') || ' 09:30' AS dmy, strftime(o_orderdate + INTERVAL 400 DAY, '%m.%d.%Y') AS mdy FROM orders")
def shift_dates(spark, d):
    o = table(spark, d, "orders")
    day = o["o_orderdate"]
    dmy = F.concat(F.date_format(day, "dd/MM/yyyy"), F.lit(" 09:30"))
    return o.select("o_orderkey", temporal.shifted_date(F.date_format(day, "yyyy-MM-dd"), 45).alias("ymd"), temporal.shifted_date(dmy, -10, "DMY").alias("dmy"), temporal.shifted_date(F.date_format(day, "MM.dd.yyyy"), 400, "MDY").alias("mdy"))


@query("SELECT event_id, strftime(ts + INTERVAL 135 MINUTE, '%H:%M') AS later, strftime(ts - INTERVAL 600 MINUTE, '%H:%M:%S') AS earlier FROM events")
def shift_times(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", temporal.shifted_time(F.date_format("ts", "HH:mm"), 135).alias("later"), temporal.shifted_time(F.date_format("ts", "HH:mm:ss"), -600).alias("earlier"))


@query("SELECT c_custkey, 'Customer#' || lpad((c_custkey + 125)::VARCHAR, 9, '0') AS moved FROM customer")
def shift_number_segment(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", temporal.shifted_segment(c["c_name"], 125).alias("moved"))


@query("WITH g AS (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) SELECT count(*) AS groups, count(*) FILTER (n < 3) AS small_groups, coalesce(sum(n) FILTER (n < 3), 0)::BIGINT AS small_rows, min(n) AS smallest FROM g")
def combination_risk(spark, d):
    return quality.combination_risk(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@query("WITH s AS (SELECT c_mktsegment AS v, count(*) / sum(count(*)) OVER () AS p FROM customer GROUP BY 1), o AS (SELECT c_mktsegment AS v, count(*) / sum(count(*)) OVER () AS q FROM customer WHERE c_acctbal > 5000 GROUP BY 1) SELECT round(least(1, sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2), 9) AS distance FROM s FULL JOIN o USING (v)")
def category_distance(spark, d):
    c = table(spark, d, "customer")
    return quality.category_distance(c, c.where("c_acctbal > 5000"), "c_mktsegment").select(F.round("distance", 9).alias("distance"))


@query("""WITH s AS (SELECT count(*) n, avg(l_extendedprice) m, min(l_extendedprice) lo, max(l_extendedprice) hi, quantile_cont(l_extendedprice, [0.05, 0.25, 0.5, 0.75, 0.95]) q FROM lineitem), o AS (SELECT count(*) n, avg(l_extendedprice) m, min(l_extendedprice) lo, max(l_extendedprice) hi, quantile_cont(l_extendedprice, [0.05, 0.25, 0.5, 0.75, 0.95]) q FROM lineitem WHERE l_returnflag = 'R'),
x AS (SELECT abs(s.m - o.m) / sp AS ms, list_max(list_transform([1, 2, 3, 4, 5], lambda i: abs(s.q[i] - o.q[i]))) / sp AS qs, o.lo >= s.lo AND o.hi <= s.hi AS r, o.n AS n FROM s, o, (SELECT greatest(abs(q[5] - q[1]), 0.1 * (hi - lo), 0.01 * abs(m), 1e-12) AS sp FROM s))
SELECT round(ms, 9) AS mean_shift, round(qs, 9) AS quantile_shift, r AS in_range, CASE WHEN ms <= greatest(0.08, 3 / sqrt(n)) AND qs <= greatest(0.1, 3 / sqrt(n)) AND r THEN 'PASS' ELSE 'REVIEW' END AS verdict FROM x""")
def numeric_comparison(spark, d):
    l = table(spark, d, "lineitem")
    out = quality.numeric_comparison(l, l.where("l_returnflag = 'R'"), "l_extendedprice")
    return out.select(F.round("mean_shift", 9).alias("mean_shift"), F.round("quantile_shift", 9).alias("quantile_shift"), "in_range", "verdict")


@query("WITH c AS (SELECT count(*) AS c FROM orders GROUP BY o_custkey), t AS (SELECT sum(c) AS t FROM c) SELECT round(sum(1 - pow(1 - c / t, 500)), 6) AS expected FROM c, t")
def expected_distinct(spark, d):
    return quality.expected_distinct(table(spark, d, "orders"), "o_custkey", 500).select(F.round("expected", 6).alias("expected"))


@query("SELECT (SELECT count(DISTINCT c_name) FROM customer WHERE c_acctbal < 0) AS reused, (SELECT count(DISTINCT c_name) FROM customer WHERE c_acctbal < 0) + (SELECT count(*) FROM supplier) AS output_distinct")
def source_reuse(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    out = c.where("c_acctbal < 0").select("c_name").union(s.select(F.col("s_name").alias("c_name")))
    return quality.source_reuse(out, c, "c_name")


@query("SELECT count(*) AS orphans FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def orphan_keys(spark, d):
    return quality.orphans(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer").where("c_acctbal > 0"), "c_custkey").agg(F.count(F.lit(1)).alias("orphans"))


@query("SELECT c_custkey::VARCHAR AS parent_key, count(o_orderkey) AS children FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(o_orderkey) NOT BETWEEN 5 AND 12")
def cardinality_violations(spark, d):
    return quality.cardinality_violations(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer"), "c_custkey", 5, 12)


@query("SELECT (count(*) - count(DISTINCT o_custkey))::BIGINT AS duplicate_rows FROM orders")
def duplicate_keys(spark, d):
    return quality.duplicate_keys(table(spark, d, "orders"), "o_custkey")


@query("SELECT 'p_name' AS column_name, count(*) AS filled, count(DISTINCT p_name) AS distinct_values, round(1 - count(DISTINCT p_name) / count(*), 9) AS duplicate_rate FROM part UNION ALL SELECT 'p_brand', count(*), count(DISTINCT p_brand), round(1 - count(DISTINCT p_brand) / count(*), 9) FROM part")
def uniqueness(spark, d):
    return quality.uniqueness(table(spark, d, "part"), ["p_name", "p_brand"]).select("column_name", "filled", F.col("distinct").alias("distinct_values"), F.round("duplicate_rate", 9).alias("duplicate_rate"))


@query("SELECT p_partkey, p_brand, p_type FROM part QUALIFY p_type IS DISTINCT FROM first_value(p_type) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def dependency_violations(spark, d):
    return quality.dependency_violations(table(spark, d, "part"), "p_brand", "p_type", F.col("p_partkey")).select("p_partkey", "p_brand", "p_type")


@query("SELECT CASE WHEN l_shipdate IS NULL OR o_orderdate IS NULL THEN 'NOT_EVALUATED' WHEN o_orderdate <= l_shipdate THEN 'VALID' ELSE 'VIOLATION' END AS status, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def date_order(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return quality.date_order(j, F.col("o_orderdate"), F.col("l_shipdate"))


@query("SELECT 'c_nationkey' AS column_name, count(*) FILTER (c_nationkey <> n_nationkey)::BIGINT AS violations FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'label', count(*) FILTER (CASE WHEN c_custkey % 7 = 0 THEN 'X' ELSE n_name END <> n_name)::BIGINT FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def linked_violations(spark, d):
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 7 == 0, "X").otherwise(F.col("n_name")).alias("label"))
    return quality.linked_violations(c, "c_nationkey", n, "n_nationkey", [("c_nationkey", "n_nationkey"), ("label", "n_name")])


@query(f"SELECT count(*) FILTER ({_shape_sql('c_name')} = 'Aaaaaaaa#999999999')::BIGINT AS conforming, count(*) AS checked FROM customer")
def shape_conformance(spark, d):
    return quality.shape_conformance(table(spark, d, "customer"), "c_name", ["Aaaaaaaa#999999999"])


@query("""WITH w AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r FROM customer), v AS (SELECT c_nationkey * 1000 + c_custkey % 97 AS y, row_number() OVER (ORDER BY c_nationkey * 1000 + c_custkey % 97, c_custkey) AS r FROM customer)
SELECT c_custkey, y::VARCHAR AS c_acctbal FROM w JOIN v USING (r)""")
def rank_alignment(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal"), "c_nationkey")
    out = c.select("c_custkey", (F.col("c_nationkey") * 1000 + F.col("c_custkey") % 97).cast("string").alias("c_acctbal"))
    return relationships.rank_aligned(c, out, "c_acctbal", "c_custkey")


@query("SELECT unnest(['c_acctbal:NON_EMPTY', 'c_mktsegment:NON_EMPTY']) AS scenario, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'c_acctbal:NUMERIC_MAX', count(*) FROM customer WHERE c_acctbal = (SELECT max(c_acctbal) FROM customer) UNION ALL SELECT 'c_acctbal:NUMERIC_MIN', count(*) FROM customer WHERE c_acctbal = (SELECT min(c_acctbal) FROM customer)")
def scenario_matches(spark, d):
    c = table(spark, d, "customer")
    rows = {r["column_name"]: r.asDict() for r in profile.column_profiles(c, ["c_acctbal", "c_mktsegment"]).collect()}
    found = coverage.scenarios(c, rows, {"c_acctbal": "DECIMAL", "c_mktsegment": "CATEGORY"})
    found = [s for s in found if s.kind in ("NON_EMPTY", "NUMERIC_MIN", "NUMERIC_MAX")]
    return coverage.matched(c, found).select(F.explode("scenario_ids").alias("scenario")).groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))


@query()
def scenario_candidates(spark, d):
    c = table(spark, d, "customer")
    rows = {r["column_name"]: r.asDict() for r in profile.column_profiles(c, CUSTOMER).collect()}
    return coverage.candidates(c, coverage.scenarios(c, rows, {"c_acctbal": "DECIMAL", "c_mktsegment": "CATEGORY"}), "c_custkey")


@query(f"SELECT substr({_shape_sql('p_brand')}, 1, 24) || ':' || (length(p_brand) // 8)::VARCHAR || '|' || substr({_shape_sql('p_type')}, 1, 24) || ':' || (length(p_type) // 8)::VARCHAR AS signature, count(*) AS n FROM part GROUP BY 1")
def row_signatures(spark, d):
    p = table(spark, d, "part")
    return p.groupBy(coverage.signature(p, ["p_brand", "p_type"]).alias("signature")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH n AS (SELECT count(*) AS n FROM customer), p AS (SELECT DISTINCT (i * n) // 40 AS k FROM n, range(40) t(i)) SELECT c_custkey, c_name FROM customer JOIN p ON c_custkey = k")
def even_sample(spark, d):
    c = table(spark, d, "customer")
    return coverage.even_sample(c, "c_custkey", c.count(), 40).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 5")
def stratified_rows(spark, d):
    return coverage.stratified(table(spark, d, "orders"), "o_orderpriority", "o_orderkey", 5).select("o_orderkey", "o_orderpriority")


@query("SELECT n_nationkey, n_name, (i + 1)::INTEGER AS use FROM nation, range(30) t(i) WHERE i < n_nationkey % 3 + 1")
def template_schedule(spark, d):
    n = table(spark, d, "nation")
    return coverage.scheduled(n.select("n_nationkey", "n_name", (F.col("n_nationkey") % 3 + 1).alias("uses")), "uses")


MASK = [Policy("c_custkey", "KEEP"), Policy("c_name", "SHIFT", "ALPHANUMERIC_CODE", params={"offset": 7}), Policy("c_nationkey", "CLEAR"), Policy("c_acctbal", "GENERALISE", "DECIMAL"), Policy("c_mktsegment", "DROP")]


@query("""WITH m AS (SELECT *, c_acctbal AS x, pow(10, greatest(0, floor(log10(CASE WHEN c_acctbal = 0 THEN 1 ELSE abs(c_acctbal) END)) - 2)) * 5 AS s FROM customer)
SELECT c_custkey::VARCHAR AS c_custkey, 'Customer#' || lpad((c_custkey + 7)::VARCHAR, 9, '0') AS c_name, '' AS c_nationkey, (floor(x / s) * s)::BIGINT::VARCHAR || '-' || (floor(x / s) * s + s - s / 5)::BIGINT::VARCHAR AS c_acctbal FROM m""")
def mask_customer(spark, d):
    return actions.transformed(table(spark, d, "customer"), MASK)


@query()
def mask_customer_recommended(spark, d):
    from quillmask.plans.masking import mask

    return mask(table(spark, d, "customer"))


@query()
def mask_replaced_and_resampled(spark, d):
    plan = [Policy("o_orderkey", "PATTERN_REPLACE", "NUMERIC_ID"), Policy("o_orderstatus", "RESAMPLE", "CATEGORY"), Policy("o_orderpriority", "REPLACE", "CATEGORY")]
    return actions.transformed(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), plan)


@query("SELECT count(*) AS values, count(*) AS replacements FROM (SELECT DISTINCT c_name FROM customer)")
def unique_replacements(spark, d):
    return actions.unique_mapping(table(spark, d, "customer"), "c_name").agg(F.count_distinct("original").alias("values"), F.count_distinct("replacement").alias("replacements"))


@query()
def analysis_of_customer(spark, d):
    return detect.analysis_frame(table(spark, d, "customer"))


@query("SELECT unnest(['NUMERIC_DIFFERENCE', 'NUMERIC_RATIO', 'BOOLEAN_FROM_POSITIVE']) AS kind, unnest(['a,b', 'a,c', 'a,f']) AS columns, (SELECT count(*) FROM customer) - unnest([0, (SELECT count(*) FROM customer WHERE c_acctbal = 0), 0]) AS support")
def relationship_mining(spark, d):
    c = table(spark, d, "customer").select(F.col("c_acctbal").alias("a"), (F.col("c_acctbal") + 12.5).alias("b"), (F.col("c_acctbal") * 4).alias("c"), (F.col("c_acctbal") > 0).cast("string").alias("f"), "c_custkey")
    rules = relationships.mined(c, ["a", "b", "c"], ["f"], F.col("c_custkey"))
    rows = [(r.kind, ",".join(r.columns), r.support) for r in rules if r.columns[0] == "a"]
    return spark.createDataFrame(rows, "kind string, columns string, support long")


@query("SELECT s_suppkey, s_suppkey::VARCHAR AS code, 'Test description for ' || s_suppkey::VARCHAR AS description, s_acctbal * 2 AS doubled FROM supplier")
def relationship_enforcement(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("code"), F.lit("?").alias("description"), F.col("s_acctbal"), F.lit(0.0).alias("doubled"))
    rules = [relationships.Rule("CODE_DESCRIPTION", ("code", "description")).confirmed(), relationships.Rule("NUMERIC_RATIO", ("s_acctbal", "doubled"), options={"constant": 2.0}).confirmed()]
    return relationships.enforced(s, rules).drop("s_acctbal")


@query("SELECT code, column_name, count(*) AS n FROM (SELECT 'BLANK' AS code, o_orderpriority AS column_name FROM orders UNION ALL SELECT 'RANGE', o_orderstatus FROM orders) GROUP BY ALL ORDER BY n DESC, code, column_name LIMIT 4")
def issue_groups(spark, d):
    o = table(spark, d, "orders")
    issues = o.select(F.lit("BLANK").alias("code"), F.col("o_orderpriority").alias("column_name")).union(o.select(F.lit("RANGE"), "o_orderstatus"))
    return quality.issue_groups(issues)


@query("SELECT 'ORD-' || lpad((10 + i * 3)::VARCHAR, 7, '0') AS order_id, 'Item ' || 'ORD-' || lpad((10 + i * 3)::VARCHAR, 7, '0') AS label, 'x' AS fixed FROM range(500) t(i)")
def generate_sequences(spark, d):
    t = generate.Table("t", (generate.Field("order_id", "sequence", {"prefix": "ORD-", "start": 10, "step": 3, "width": 7}), generate.Field("label", "template", {"source": "order_id", "prefix": "Item "}), generate.Field("fixed", "constant", {"value": "x"})), 500, "order_id")
    return generate.generated(spark, [t])["t"].drop("g_row")


@query("SELECT unnest(['orders', 'appointments']) AS child, 0::BIGINT AS orphans, 0::BIGINT AS too_many, 0::BIGINT AS wrong_lookups")
def generate_connected_tables(spark, d):
    t = generate.generated(spark, generate.connected_scenario())
    out = None
    for child, most, copied in (("orders", 5, [("customer_segment", "customer_segment")]), ("appointments", 3, [])):
        orphans = quality.orphans(t[child], "person_id", t["people"], "person_id").agg(F.count(F.lit(1)).alias("orphans"))
        many = quality.cardinality_violations(t[child], "person_id", t["people"], "person_id", 0, most).agg(F.count(F.lit(1)).alias("too_many"))
        wrong = quality.linked_violations(t[child], "person_id", t["people"], "person_id", copied).agg(F.coalesce(F.sum("violations"), F.lit(0)).alias("wrong_lookups")) if copied else spark.range(1).select(F.lit(0).cast("long").alias("wrong_lookups"))
        row = orphans.crossJoin(many).crossJoin(wrong).select(F.lit(child).alias("child"), "orphans", "too_many", "wrong_lookups")  # one row each
        out = row if out is None else out.union(row)
    return out


@query("SELECT c_custkey, 'c_mktsegment' AS column_name, c_mktsegment AS before, lower(c_mktsegment) AS after FROM customer")
def source_output_difference(spark, d):
    from quillmask.sources.sinks import difference

    c = table(spark, d, "customer")
    return difference(c, c.withColumn("c_mktsegment", F.lower("c_mktsegment")), "c_custkey", ["c_name", "c_mktsegment"])


# ---- numbers whatever their size, sketches, warnings


@query(r"""WITH x AS (SELECT o_totalprice * 1000 AS big, o_totalprice / 1e9::DOUBLE AS small FROM orders), t AS (SELECT 'big' AS column_name, big AS v FROM x UNION ALL SELECT 'small', small FROM x)
SELECT column_name, count(v) AS numeric_count, min(v) AS minimum, max(v) AS maximum, round(avg(v), 9) AS mean, quantile_cont(v, 0.5) AS p50, 'EXACT' AS distinct_status FROM t GROUP BY column_name""")
def profile_large_and_small_doubles(spark, d):
    o = table(spark, d, "orders").select((F.col("o_totalprice") * 1000).alias("big"), (F.col("o_totalprice") / F.lit(1e9)).alias("small"))
    p = profile.column_profiles(o)
    return p.select("column_name", "numeric_count", "minimum", "maximum", F.round("mean", 9).alias("mean"), F.col("quantiles")[3].alias("p50"), "distinct_status")


@query("""SELECT 'l_extendedprice' AS column_name, count(*) AS observed, min(l_extendedprice) AS minimum, max(l_extendedprice) AS maximum, 'ESTIMATED' AS distinct_status, true AS near FROM lineitem
UNION ALL SELECT 'l_returnflag', count(*), NULL, NULL, 'EXACT', true FROM lineitem""")
def profile_by_sketches(spark, d):
    l = table(spark, d, "lineitem")
    p = profile.column_profiles(l, ["l_extendedprice", "l_returnflag"], profile.Limits(exact_values=50))
    true = l.agg(F.count_distinct("l_extendedprice").alias("n"))
    near = F.abs(F.col("distinct") - F.when(F.col("distinct_status") == "ESTIMATED", F.col("n")).otherwise(F.col("distinct"))) <= 0.05 * F.col("n")
    return p.crossJoin(F.broadcast(true)).select("column_name", "observed", "minimum", "maximum", "distinct_status", near.alias("near"))  # one row


@query("SELECT 'UNIQUE_TRACKING_LIMIT_REACHED' AS code, 'p_name' AS column_name, (SELECT count(DISTINCT p_name) FROM part) AS n UNION ALL SELECT 'PROFILE_VALUE_TRUNCATED', 'p_name', (SELECT count(DISTINCT p_name) FROM part WHERE length(p_name) > 8) UNION ALL SELECT 'COLUMN_PROFILE_LIMIT_REACHED', 'p_size', 3")
def profile_warnings(spark, d):
    return profile.warnings(table(spark, d, "part"), ["p_name", "p_brand", "p_size"], profile.Limits(unique_values=30, columns=2, value_length=8)).where("column_name <> 'p_brand'")


@query(rf"""SELECT c_custkey, CASE WHEN length(v) > 24 THEN length(substr(v, 1, 6)) + 18 ELSE length(v) END::INTEGER AS tracked, v = '' AS empty, length(v)::INTEGER AS length, CASE WHEN regexp_matches(v, '^[+-]?[0-9]+(\.[0-9]+)?$') THEN v::DOUBLE END AS number
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN c_acctbal::VARCHAR WHEN 2 THEN c_name || ' ' || c_mktsegment ELSE c_name END AS v FROM customer)""")
def normalised_values(spark, d):
    c = table(spark, d, "customer")
    k = c["c_custkey"] % 4
    v = F.when(k == 0, F.lit("  ")).when(k == 1, F.concat(F.lit(" "), c["c_acctbal"].cast("string"))).when(k == 2, F.concat("c_name", F.lit(" "), "c_mktsegment")).otherwise(c["c_name"])
    return c.select("c_custkey", text.normalised_value(v, 24).alias("n")).select("c_custkey", F.length("n.value").alias("tracked"), "n.empty", "n.length", F.col("n.numeric.value").alias("number"))


# ---- dates and times as people write them


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 40 DAY, '%d %b %Y') AS day_first, strftime(o_orderdate - INTERVAL 3 DAY, '%B %d, %Y') AS month_first, year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS sorted FROM orders WHERE month(o_orderdate) <> 5")
def shift_named_months(spark, d):
    o = table(spark, d, "orders").where(F.month("o_orderdate") != 5)  # May alone doesn't say whether names are short
    day = o["o_orderdate"]
    a, b = F.date_format(day, "dd MMM yyyy"), F.date_format(day, "MMMM dd, yyyy")
    return o.select("o_orderkey", temporal.shifted_date(a, 40, "DNY").alias("day_first"), temporal.shifted_date(b, -3, "NDY").alias("month_first"), temporal.order_key(a, "DNY").alias("sorted"))


@query("SELECT event_id, strftime(ts + INTERVAL 75 MINUTE, '%H.%M.%S') AS dotted, strftime(ts + INTERVAL 75 MINUTE, '%H:%M') || '+10:00' AS zoned FROM events")
def shift_dotted_and_zoned_times(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", temporal.shifted_time(F.date_format("ts", "HH.mm.ss"), 75).alias("dotted"), temporal.shifted_time(F.concat(F.date_format("ts", "HH:mm"), F.lit("+10:00")), 75).alias("zoned"))


@query("""SELECT layout, kind, count(*) AS n FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'YMD' WHEN 1 THEN CASE WHEN day(o_orderdate) > 12 THEN 'DMY' ELSE 'AMBIGUOUS' END WHEN 2 THEN 'DNY' END AS layout,
CASE o_orderkey % 4 WHEN 0 THEN 'DATETIME' WHEN 3 THEN 'TIME' ELSE 'DATE' END AS kind FROM orders) GROUP BY ALL""")
def temporal_layouts(spark, d):
    from quillmask.operators.validate import temporal_kind

    o = table(spark, d, "orders")
    k, day = o["o_orderkey"] % 4, o["o_orderdate"]
    v = F.when(k == 0, F.date_format(day, "yyyy-MM-dd HH:mm")).when(k == 1, F.date_format(day, "dd/MM/yyyy")).when(k == 2, F.date_format(day, "d-MMM-yy")).otherwise("10.45 pm")
    return o.select(v.alias("v")).groupBy(temporal.layout_of(F.col("v")).alias("layout"), temporal_kind(F.col("v")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# ---- drawing from distributions


@query("SELECT x AS value, coalesce(sum(n) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_rank, (sum(n) OVER (ORDER BY x))::BIGINT AS end_rank, coalesce(lead(x) OVER (ORDER BY x), x) AS next_value FROM (SELECT l_extendedprice AS x, count(*) AS n FROM lineitem GROUP BY 1)")
def resample_stretches(spark, d):
    from quillmask.operators.resample import stretches

    s = stretches(table(spark, d, "lineitem"), "l_extendedprice", True)
    return s.select(F.col("r_value").alias("value"), F.col("r_from").alias("first_rank"), F.col("r_to").alias("end_rank"), F.col("r_next").alias("next_value"))


@query("SELECT count(*) AS rows, min(c_acctbal) AS minimum, max(c_acctbal) AS maximum, count(DISTINCT c_mktsegment) AS segments, 0::BIGINT AS unknown_segments, 0::BIGINT AS far_from_source FROM customer")
def resample_keeps_distribution(spark, d):
    """Draws in strata: extremes and all values come back, and no sorted draw is far from the source's."""
    from quillmask.functions.ordinals import with_rank
    from quillmask.functions.stored import stored
    from quillmask.operators.resample import stratified_share

    c = stored(with_rank(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), "c_custkey", [], "ordinal"))  # keys may have gaps
    n = c.count()
    share = stratified_share(F.col("ordinal"), n, 1, "x", True)
    out = stored(actions.transformed(c, [Policy("c_custkey"), Policy("c_acctbal", "RESAMPLE", "DECIMAL"), Policy("c_mktsegment", "RESAMPLE", "CATEGORY"), Policy("ordinal")], F.col("c_custkey"), shares={"c_acctbal": share}))
    x = out.select(F.col("c_acctbal").cast("double").alias("x"), "c_custkey")
    ranks = with_rank(x, "x", ["c_custkey"], "rank").join(with_rank(c.select(F.col("c_acctbal").alias("y"), F.col("c_custkey").alias("k")), "y", ["k"], "rank"), "rank")
    spread = c.agg(((F.max("c_acctbal") - F.min("c_acctbal")) * 0.1).alias("spread"))
    far = ranks.crossJoin(F.broadcast(spread)).agg(F.count_if(F.abs(F.col("x") - F.col("y")) > F.col("spread")).alias("far_from_source"))  # one row
    unknown = out.join(c.select(F.col("c_mktsegment").alias("known")).distinct(), F.col("c_mktsegment") == F.col("known"), "left_anti").agg(F.count(F.lit(1)).alias("unknown_segments"))
    facts = x.agg(F.count(F.lit(1)).alias("rows"), F.min("x").alias("minimum"), F.max("x").alias("maximum")).crossJoin(out.agg(F.count_distinct("c_mktsegment").alias("segments")))
    return facts.crossJoin(unknown).crossJoin(far)  # one row each


# ---- checks of outputs


@query("""SELECT * FROM (SELECT 'OUTPUT_TYPE_MISMATCH' AS code, 'ERROR' AS severity, 'amount' AS column_name, count(*) FILTER (c_custkey % 7 = 0) AS n FROM customer UNION ALL SELECT 'OUTPUT_TYPE_MISMATCH', 'ERROR', 'flag', count(*) FILTER (c_custkey % 5 = 0) FROM customer
UNION ALL SELECT 'INTERNAL_TEMPLATE_LEAK', 'ERROR', 'note', count(*) FILTER (c_custkey % 11 = 0) FROM customer UNION ALL SELECT 'OUTPUT_TYPE_MISMATCH', 'ERROR', 'day', count(*) FILTER (c_custkey % 13 = 0) FROM customer UNION ALL SELECT 'OUTPUT_TYPE_MISMATCH', 'ERROR', 'band', count(*) FILTER (c_custkey % 3 = 0) FROM customer) WHERE n > 0""")
def validate_cells(spark, d):
    from quillmask.operators import validate

    k = F.col("c_custkey")
    out = table(spark, d, "customer").select(
        F.when(k % 7 == 0, "12.5.1").when(k % 7 == 1, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("amount"), F.when(k % 5 == 0, "maybe").otherwise("Yes").alias("flag"),
        F.when(k % 11 == 0, validate.template("NAME", "x")).otherwise("").alias("note"), F.when(k % 13 == 0, "2024-02-30").otherwise("3 Mar 2024").alias("day"), F.when(k % 3 == 0, "many").otherwise("10-19").alias("band"), F.lit("?").alias("kept"),
    )
    kinds = [Policy("amount", "RESAMPLE", "DECIMAL"), Policy("flag", "REPLACE", "BOOLEAN"), Policy("note", "REPLACE", "GENERAL_TEXT"), Policy("day", "SHIFT", "DATE", params={"offset": 1}), Policy("band", "GENERALISE", "INTEGER", params={"strategy": "NUMERIC_BAND"}), Policy("kept", "KEEP", "INTEGER")]
    return validate.cell_issues(out, kinds)


@query("""SELECT 'SAME_ID_RELATIONSHIP_VIOLATION' AS code, 'ERROR' AS severity, 'a,b' AS column_name, count(*) FILTER (o_orderkey % 9 = 0) AS n FROM orders UNION ALL SELECT 'DATE_RELATIONSHIP_VIOLATION', 'ERROR', 'first,second', count(*) FILTER (o_orderkey % 10 = 0) FROM orders
UNION ALL SELECT 'BUSINESS_RULE_VIOLATION', 'ERROR', 'x,y', count(*) FILTER (o_orderkey % 8 = 0) FROM orders UNION ALL SELECT 'BUSINESS_RULE_VIOLATION', 'ERROR', 'flag,x', count(*) FILTER (o_orderkey % 6 = 0) FROM orders UNION ALL SELECT 'SHIFT_GROUP_ORDER_VIOLATION', 'ERROR', 'first,second,third', count(*) FILTER (o_orderkey % 10 = 0) FROM orders""")
def validate_rules(spark, d):
    from quillmask.operators import validate
    from quillmask.operators.relationships import Rule

    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    out = table(spark, d, "orders").select(
        k.cast("string").alias("a"), F.when(k % 9 == 0, "other").otherwise(k.cast("string")).alias("b"), day.cast("string").alias("first"), F.when(k % 10 == 0, F.date_sub(day, 1)).otherwise(F.date_add(day, 1)).cast("string").alias("second"), F.date_add(day, 5).cast("string").alias("third"),
        F.col("o_totalprice").alias("x"), F.when(k % 8 == 0, F.lit(-5.0)).otherwise(F.col("o_totalprice") * 2).alias("y"), F.when(k % 6 == 0, "no").otherwise("yes").alias("flag"),
    )
    rules = [Rule("SAME_ID", ("a", "b")), Rule("DATE_ORDER", ("first", "second")), Rule("NUMERIC_RATIO", ("x", "y"), options={"constant": 2.0}), Rule("POSITIVE_FROM_BOOLEAN", ("flag", "x")), Rule("DATE_TIME_SHIFT_GROUP", ("first", "second", "third"))]
    return validate.rule_issues(out, [r.confirmed() for r in rules])


@query("""SELECT 'GENERATED_NULL_COUNT_MISMATCH' AS code, 'ERROR' AS severity, 'size' AS column_name, abs(count(*) FILTER (p_partkey % 4 = 0) - round(count(*) * 0.1))::BIGINT AS n FROM part UNION ALL SELECT 'GENERATED_VALUE_OUTSIDE_RULES', 'ERROR', 'size', count(*) FILTER (p_partkey % 4 <> 0 AND p_size > 30) FROM part
UNION ALL SELECT 'GENERATED_VALUE_OUTSIDE_RULES', 'ERROR', 'kind', count(*) FILTER (p_partkey % 5 = 0) FROM part UNION ALL SELECT 'GENERATED_UNIQUENESS_RELAXED', 'WARNING', 'kind', count(*) - count(DISTINCT p_partkey % 5 = 0) FROM part""")
def validate_generated(spark, d):
    from quillmask.operators import validate

    p = table(spark, d, "part")
    out = p.select(F.when(p["p_partkey"] % 4 == 0, "").otherwise(p["p_size"].cast("string")).alias("size"), F.when(p["p_partkey"] % 5 == 0, "odd").otherwise("even").alias("kind"))
    fields = [generate.Field("size", "integer", {"minimum": 1, "maximum": 30}, 0.1), generate.Field("kind", "category", {"values": ["even"], "unique": True})]
    return validate.generated_issues(out, fields, p.count())


@query("""WITH s AS (SELECT count(*) AS rows, count(x) AS n, count(DISTINCT x) AS support, avg(x) AS mean, min(x) AS lo, max(x) AS hi, quantile_cont(x, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q FROM (SELECT l_extendedprice AS x FROM lineitem)),
o AS (SELECT count(*) AS rows, count(x) AS n, count(DISTINCT x) AS support, avg(x) AS mean, min(x) AS lo, max(x) AS hi, quantile_cont(x, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q FROM (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS x FROM lineitem WHERE l_returnflag = 'A')),
e AS (SELECT sum(1 - pow(1 - c / t, (SELECT rows FROM o))) AS support FROM (SELECT count(*) AS c, sum(count(*)) OVER () AS t FROM lineitem GROUP BY l_extendedprice)),
m AS (SELECT s.*, o.rows AS o_rows, o.n AS o_n, o.support AS o_support, o.lo AS o_lo, o.hi AS o_hi, o.mean AS o_mean, greatest(abs(s.q[6] - s.q[2]), abs(s.hi - s.lo) * 0.1, abs(s.mean) * 0.01) AS spread, 3 / sqrt(least(s.n, o.n)) AS slack, o.q AS oq, e.support AS expected FROM s, o, e),
f AS (SELECT *, abs(o_mean - mean) / spread AS mean_shift, list_max(list_transform([2, 3, 4, 5, 6], lambda i: abs(oq[i] - q[i]))) / spread AS inner_shift, list_max(list_transform([1, 7], lambda i: abs(oq[i] - q[i]))) / spread AS tail_shift, o_n / o_rows - n / rows AS rate_shift FROM m)
SELECT round(rate_shift, 9) AS rate_shift, round(mean_shift, 9) AS mean_shift, round(inner_shift, 9) AS quantile_shift, round(tail_shift, 9) AS tail_shift, abs(rate_shift) <= 0.05 AS rate_ok, o_support >= greatest(1, ceil(expected * 0.7)) AS support_ok, mean_shift <= greatest(0.08, slack) AS mean_ok,
inner_shift <= greatest(0.1, slack) AND tail_shift <= greatest(0.1, slack, 0.12) AS quantiles_ok, CASE WHEN o_rows * 0.01 >= 5 THEN tail_shift <= greatest(0.12, slack) END AS tails_ok, o_lo >= lo AND o_hi <= hi AS range_ok FROM f""")
def numeric_checks(spark, d):
    from quillmask.operators import compare

    l = table(spark, d, "lineitem")
    out = l.where("l_returnflag = 'A'").withColumn("l_extendedprice", F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")))
    said = compare.numeric_checks(l, out, "l_extendedprice")
    return said.select(*[F.round(c, 9).alias(c) for c in ("rate_shift", "mean_shift", "quantile_shift", "tail_shift")], "rate_ok", "support_ok", "mean_ok", "quantiles_ok", "tails_ok", "range_ok")


@query("SELECT 'ORPHAN_FOREIGN_KEY' AS \"check\", 'orders' AS table_name, 'o_custkey' AS column_name, count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)) AS n FROM orders UNION ALL SELECT 'DUPLICATE_PRIMARY_KEY', 'orders', 'o_orderkey', count(*) - count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'DUPLICATE_PRIMARY_KEY', 'customer', 'c_custkey', 0")
def dataset_integrity(spark, d):
    from quillmask.plans.masking import integrity_model

    tables = {"orders": table(spark, d, "orders"), "customer": table(spark, d, "customer").where("c_nationkey < 20")}
    return integrity_model(tables, {"orders": "o_orderkey", "customer": "c_custkey"}, [("orders", "o_custkey", "customer")])


@query("""
WITH o AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE c_mktsegment END AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey), n AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT 'DUPLICATE_PRIMARY_KEY' AS "check", 'customer' AS table_name, 'c_custkey' AS column_name, 0 AS n UNION ALL SELECT 'CARDINALITY_VIOLATION', 'orders', 'o_custkey', count(*) FROM n WHERE n NOT BETWEEN 5 AND 12
UNION ALL SELECT 'LINKED_RULE_VIOLATION', 'orders', 'o_custkey', count(*) FILTER (segment <> c_mktsegment) FROM o""")
def dataset_links(spark, d):
    from quillmask.plans.masking import integrity_model

    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    segments = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("c_mktsegment")).alias("segment"))
    return integrity_model({"orders": segments, "customer": c}, {"customer": "c_custkey"}, [], [("orders", "o_custkey", "customer", 5, 12)], [("orders", "o_custkey", "customer", [("segment", "c_mktsegment")])])


@query("SELECT 'day' AS column_name, count(*) AS filled, count(*) FILTER (o_orderkey % 5 <> 0) AS readable, false AS ready FROM orders UNION ALL SELECT 'code', count(*), count(*), true FROM orders")
def shift_readiness(spark, d):
    from quillmask.plans.masking import shift_readiness as readiness

    o = table(spark, d, "orders")
    cells = o.select(F.when(o["o_orderkey"] % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), F.concat(F.lit("O-"), o["o_orderkey"].cast("string")).alias("code"))
    return readiness(cells, [Policy("day", "SHIFT", "DATE", params={"offset": 3}), Policy("code", "SHIFT", "ALPHANUMERIC_CODE", params={"offset": 3})])


@query("SELECT 'c_mktsegment:CATEGORY_COMMON:0' AS scenario, 'CATEGORY_COMMON' AS kind, 65 AS weight, count(*) FILTER (c_acctbal > 9000 AND c_mktsegment = (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS n, CASE WHEN count(*) FILTER (c_acctbal > 9000 AND c_mktsegment = (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) > 0 THEN 'COVERED' ELSE 'MISSING' END AS status FROM customer")
def coverage_of_output(spark, d):
    c = table(spark, d, "customer")
    rows = {r["column_name"]: r.asDict() for r in profile.column_profiles(c, ["c_mktsegment"]).collect()}
    rows["c_mktsegment"]["top"] = [(r["value"], r["n"]) for r in profile.top_values(c, ["c_mktsegment"]).orderBy("rank").collect()]
    found = [s for s in coverage.scenarios(c, rows, {"c_mktsegment": "CATEGORY"}) if s.id.endswith("CATEGORY_COMMON:0")]
    return coverage.coverage_view(c.where("c_acctbal > 9000"), found)


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, '\"' || c_mktsegment || '\", ok' AS note FROM customer")
def delimited_round_trip(spark, d):
    """Written as delimited text, then read with delimiter and header found by themselves."""
    import uuid

    from quillmask.sources import delimited, sinks

    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", F.concat(F.lit('"'), "c_mktsegment", F.lit('", ok')).alias("note"))
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/quillmask-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    sinks.write_delimited(c, path)
    return delimited.read_delimited(spark, path, header=True)[0].select("c_custkey", "c_name", "note")
