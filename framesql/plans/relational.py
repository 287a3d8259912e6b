"""One query per operator. Doubles are rounded, sums of integers are cast, and every limited query has a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesql import functions, operators

SQL = {
    # scans, projections, filters
    "scan_table": "SELECT r_regionkey, r_name FROM region",
    "scan_derived": "SELECT k, n FROM (SELECT n_nationkey AS k, n_name AS n FROM nation) AS d",
    "select_constant": "SELECT 1 AS one, 'x' AS x, CAST(NULL AS INT) AS nothing",
    "select_star": "SELECT * FROM nation WHERE n_regionkey = 2",
    "project_arith": "SELECT l_orderkey, l_linenumber, l_quantity + 1 AS plus, l_quantity - l_tax AS minus, l_extendedprice * (1 - l_discount) AS times, l_extendedprice / l_quantity AS ratio, -l_quantity AS negative FROM lineitem",
    "project_int_division": "SELECT o_orderkey, o_orderkey / 2 AS half, o_orderkey % 7 AS rest FROM orders",
    "project_null_division": "SELECT p_partkey, p_retailprice / NULLIF(p_size - 10, 0) AS v FROM part",
    "filter_cmp": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000 AND o_orderstatus <> 'F'",
    "filter_double_equals": "SELECT o_orderkey FROM orders WHERE o_orderstatus == 'P'",
    "filter_and_or_not": "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND (o_totalprice < 50000 OR o_custkey < 100)",
    "filter_three_valued": "SELECT p_partkey FROM part WHERE NOT (NULLIF(p_size, 5) > 10)",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'c%' OR p_name LIKE '%_dget'",
    "filter_not_like": "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT LIKE '%URGENT' AND o_orderpriority NOT LIKE '5%'",
    "filter_like_null": "SELECT COUNT(*) AS n FROM part WHERE NULLIF(p_type, 'PROMO') LIKE '%O%'",
    "filter_between": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "filter_in": "SELECT p_partkey FROM part WHERE p_size IN (1, 7, 14) AND p_type IN ('PROMO', 'SMALL')",
    "filter_date": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-02-01'",
    "filter_quoted_text": "SELECT doc_id FROM documents WHERE text LIKE '%it''s%' OR lang = 'de'",
    "is_null": "SELECT SUM(CASE WHEN NULLIF(o_orderstatus, 'P') IS NULL THEN 1 ELSE 0 END)::BIGINT AS nulls, SUM(CASE WHEN NULLIF(o_orderstatus, 'P') IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS others FROM orders",
    "is_true": "SELECT o_orderkey FROM orders WHERE (NULLIF(o_orderstatus, 'P') = 'F') IS TRUE",
    "case_when": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders",
    "concat_text": "SELECT c_custkey, c_name || '/' || c_mktsegment AS label FROM customer",
    "null_safe_equality": "SELECT COUNT(*) AS n FROM part WHERE NULLIF(p_size, 3) IS NOT DISTINCT FROM NULL",
    "boolean_values": "SELECT n_nationkey, n_regionkey = 1 AS first, TRUE AS yes, NOT (n_regionkey = 1) AS other FROM nation",
    # casts
    "cast_date": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders",
    "cast_timestamp": "SELECT o_orderkey FROM orders WHERE o_orderdate > CAST('2000-05-05 00:00:00' AS TIMESTAMP)",
    "cast_string": "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS c, CAST(NULL AS TEXT) AS nothing FROM orders",
    "cast_numeric": "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS INT8) AS a, CAST(l_linenumber AS SMALLINT) AS b, CAST(l_linenumber AS FLOAT8) AS c, l_orderkey::DOUBLE AS d, CAST(CAST(l_orderkey AS VARCHAR) AS BIGINT) AS e FROM lineitem",
    "cast_bool": "SELECT n_nationkey, CAST(n_regionkey AS BOOLEAN) AS b FROM nation",
    "try_cast": "SELECT n_nationkey, TRY_CAST(n_name AS INT) AS n, TRY_CAST(SUBSTRING(n_name, 8) AS INT) AS m FROM nation",
    # joins
    "join_inner": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "join_using_names": "SELECT d.doc_id, d.lang, l.quality FROM documents AS d JOIN labels AS l USING (doc_id)",
    "join_multi_key": "SELECT a.l_orderkey, a.l_linenumber FROM lineitem AS a JOIN lineitem AS b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1",
    "join_expr_key": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey + 1 = r_regionkey + 1",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 300000",
    "join_full": "SELECT a.k AS a, b.k AS b FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) AS a FULL JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 8) AS b ON a.k = b.k",
    "join_cross": "SELECT a.r_name AS a, b.r_name AS b FROM region AS a CROSS JOIN region AS b",
    "join_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation AS a JOIN nation AS b ON a.n_nationkey < b.n_nationkey",
    "join_residual_outer": "SELECT n_nationkey, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND n_nationkey > r_regionkey * 5",
    "join_semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "join_semi_syntax": "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "join_anti_syntax": "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')",
    "join_self": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier AS a, supplier AS b WHERE a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "join_comma_where": "SELECT c_name, n_name FROM customer, nation WHERE c_nationkey = n_nationkey AND c_acctbal > 9000",
    "join_null_keys": "SELECT COUNT(*) AS n FROM (SELECT NULLIF(n_regionkey, 0) AS k FROM nation) AS a JOIN (SELECT NULLIF(r_regionkey, 0) AS k FROM region) AS b ON a.k = b.k",
    "join_five_tables": "SELECT r_name, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 0) AS v FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY r_name",
    "join_interval": "SELECT a.event_id AS a, b.event_id AS b FROM events AS a JOIN events AS b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '1' HOUR",
    # aggregation
    "agg_count_star": "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus",
    "agg_count_col_nulls": "SELECT o_orderstatus, COUNT(NULLIF(o_orderpriority, '1-URGENT')) AS n FROM orders GROUP BY o_orderstatus",
    "agg_count_distinct": "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus",
    "agg_sum": "SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS q, CAST(SUM(l_linenumber) AS BIGINT) AS lines, CAST(SUM(NULLIF(l_linenumber, l_linenumber)) AS BIGINT) AS nothing FROM lineitem GROUP BY l_returnflag",
    "agg_sum_expression": "SELECT l_linestatus, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 0) AS charge FROM lineitem GROUP BY l_linestatus",
    "agg_avg": "SELECT l_returnflag, ROUND(AVG(l_quantity / 2), 4) AS half, ROUND(AVG(l_linenumber), 4) AS line FROM lineitem GROUP BY l_returnflag",
    "agg_min_max": "SELECT o_orderpriority, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high, MIN(o_orderdate) AS first, MAX(o_orderstatus) AS last FROM orders GROUP BY o_orderpriority",
    "agg_stddev": "SELECT l_returnflag, ROUND(STDDEV(l_quantity), 4) AS s FROM lineitem GROUP BY l_returnflag",
    "agg_variance": "SELECT l_returnflag, ROUND(VARIANCE(l_quantity), 4) AS v FROM lineitem GROUP BY l_returnflag",
    "agg_population": "SELECT l_returnflag, ROUND(STDDEV_POP(l_quantity), 4) AS s, ROUND(VAR_POP(l_quantity), 4) AS v FROM lineitem GROUP BY l_returnflag",
    "agg_global_multi": "SELECT COUNT(*) AS n, ROUND(SUM(o_totalprice), 0) AS total, MIN(o_orderkey) AS low, MAX(o_orderkey) AS high, ROUND(AVG(o_totalprice), 2) AS mean FROM orders",
    "agg_global_empty": "SELECT COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders WHERE o_orderkey < 0",
    "agg_group_expr": "SELECT o_custkey % 10 AS g, COUNT(*) AS n FROM orders GROUP BY o_custkey % 10",
    "agg_null_group": "SELECT NULLIF(o_orderstatus, 'P') AS g, COUNT(*) AS n FROM orders GROUP BY NULLIF(o_orderstatus, 'P')",
    "agg_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND SUM(o_totalprice) > 1000000",
    "agg_post_project": "SELECT l_returnflag, ROUND(100 * SUM(l_discount) / SUM(l_quantity), 6) AS r FROM lineitem GROUP BY l_returnflag",
    "agg_filter": "SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_totalprice > 200000) AS n FROM orders GROUP BY o_orderstatus",
    "agg_median": "SELECT o_orderstatus, ROUND(MEDIAN(o_totalprice), 2) AS m FROM orders GROUP BY o_orderstatus",
    "agg_bool": "SELECT o_orderstatus, BOOL_AND(o_totalprice > 1000) AS every_one, BOOL_OR(o_totalprice > 400000) AS some FROM orders GROUP BY o_orderstatus",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "distinct_rows": "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer",
    "group_no_agg": "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment",
    # sort and limit
    "sort_multi_mixed": "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment ASC, c_acctbal DESC, c_custkey",
    "sort_nulls": "SELECT p_partkey, NULLIF(p_size, 10) AS s FROM part ORDER BY NULLIF(p_size, 10) DESC NULLS FIRST, p_partkey ASC NULLS LAST",
    "sort_nulls_default": "SELECT p_partkey, NULLIF(p_size, 50) AS s FROM part ORDER BY s DESC, p_partkey",
    "sort_expression": "SELECT o_orderkey, o_totalprice / 3 AS v FROM orders ORDER BY o_totalprice * -1, o_orderkey",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25",
    "limit_in_subquery": "SELECT AVG(x) AS mean FROM (SELECT o_orderkey AS x FROM orders ORDER BY o_orderkey LIMIT 100) AS d",
    # set operations
    "union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region",
    "union_distinct": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey AS k FROM region",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "intersect_all": "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT r_regionkey AS k FROM region",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'",
    "except_all": "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey AS k FROM region",
    # subqueries
    "cte_columns": "WITH c (k, n) AS (SELECT c_nationkey, COUNT(*) FROM customer GROUP BY c_nationkey) SELECT n_name, n FROM c JOIN nation ON k = n_nationkey",
    "cte_reuse": "WITH c AS (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey) SELECT a.k FROM c AS a WHERE a.n = (SELECT MAX(n) FROM c)",
    "derived_alias_cols": "SELECT k, n FROM (SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey) AS d (k, n) WHERE n > 10",
    "scalar_uncorrelated": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)",
    "scalar_in_having": "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > (SELECT COUNT(*) / 25.0 FROM customer)",
    "scalar_correlated": "SELECT a.o_orderkey FROM orders AS a WHERE a.o_totalprice = (SELECT MAX(b.o_totalprice) FROM orders AS b WHERE b.o_custkey = a.o_custkey)",
    "exists": "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 49)",
    "not_exists": "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)",
    "exists_neq": "SELECT DISTINCT a.l_orderkey FROM lineitem AS a WHERE EXISTS (SELECT 1 FROM lineitem AS b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey AND b.l_returnflag = 'R')",
    "in_subquery": "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)",
    "not_in_subquery": "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)",
    "not_in_null": "SELECT COUNT(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 0) FROM region)",
    "in_nested": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1))",
    "values_rows": "SELECT k, v FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t (k, v)",
    # functions
    "extract_year": "SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, COUNT(*) AS n FROM orders GROUP BY EXTRACT(YEAR FROM o_orderdate)",
    "extract_parts": "SELECT o_orderkey, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS BIGINT) AS d FROM orders",
    "date_interval": "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate >= DATE '1998-12-01' - INTERVAL '90' DAY AND o_orderdate < DATE '1998-12-01' + INTERVAL '3' MONTH",
    "date_interval_column": "SELECT o_orderkey, CAST(o_orderdate + INTERVAL '10' DAY AS DATE) AS later FROM orders",
    "substring": "SELECT c_custkey, SUBSTRING(c_mktsegment, 1, 2) AS code FROM customer WHERE SUBSTRING(c_mktsegment, 1, 2) IN ('BU', 'MA')",
    "text_functions": "SELECT c_custkey, LOWER(c_name) AS l, UPPER(c_mktsegment) AS u, CAST(LENGTH(c_name) AS BIGINT) AS n, TRIM('  ' || c_mktsegment || ' ') AS t, REPLACE(c_name, 'C', 'k') AS r FROM customer",
    "math_functions": "SELECT c_custkey, ABS(c_acctbal) AS a, CAST(FLOOR(c_acctbal) AS BIGINT) AS f, CAST(CEIL(c_acctbal) AS BIGINT) AS c, SQRT(ABS(c_acctbal)) AS s, POWER(c_acctbal / 1000, 2) AS p FROM customer",
    "conditional_functions": "SELECT p_partkey, COALESCE(NULLIF(p_size, 3), -1) AS c, GREATEST(p_size, 20) AS g, LEAST(p_size, 20) AS l FROM part",
    # windows
    "window_rank": "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r FROM orders",
    "window_running": "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS running FROM orders",
    "window_frames": "SELECT o_orderkey, CAST(SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS near, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first, CAST(NTILE(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS quarter FROM orders",
    "window_lag": "SELECT o_orderkey, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders",
    # operators and functions that mean something else in Spark
    "qualify": "SELECT o_custkey, o_orderkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "unnest": "SELECT n_nationkey, e FROM nation, UNNEST([n_nationkey, n_regionkey + 100]) AS u(e)",
    "list_index": "SELECT vec_id, embedding[1] AS first, embedding[-1] AS last, embedding[100000] AS beyond FROM embeddings",
    "power_operator": "SELECT p_partkey, ROUND(p_size ^ 2 - 2 ** 3, 4) AS v FROM part",
    "floor_division": "SELECT o_orderkey, o_orderkey // 7 AS q, (LENGTH(o_orderpriority) + 1) // 2 AS half FROM orders",
    "log_base": "SELECT p_partkey, ROUND(LOG(p_retailprice), 6) AS l FROM part",
    "day_of_week": "SELECT o_orderkey, CAST(DAYOFWEEK(o_orderdate) AS BIGINT) AS d, CAST(EXTRACT(DOW FROM o_orderdate) AS BIGINT) AS e FROM orders",
    "star_exclude": "SELECT * EXCLUDE (c_name) FROM customer",
    "agg_list": "SELECT n_regionkey, ARRAY_TO_STRING(LIST_SORT(LIST(n_name)), ',') AS names, CAST(LEN(ARRAY_TO_STRING(LIST_SORT(ARRAY_AGG(n_name)), '')) AS BIGINT) AS chars FROM nation GROUP BY n_regionkey",
    "agg_quantile": "SELECT o_orderstatus, ROUND(QUANTILE_CONT(o_totalprice, 0.25), 2) AS q FROM orders GROUP BY o_orderstatus",
    "agg_arg_max": "SELECT o_custkey, ARG_MAX(o_orderkey, o_totalprice) AS dear, ARG_MIN(o_orderkey, o_totalprice) AS cheap FROM orders GROUP BY o_custkey",
    "cast_decimal": "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DECIMAL(12, 2)) AS q, CAST(CAST(l_discount AS NUMERIC(6, 2)) AS VARCHAR) AS d FROM lineitem",
    "recursive_cte": "WITH RECURSIVE r (n, s) AS (SELECT 1, 1 UNION ALL SELECT n + 1, s + n + 1 FROM r WHERE n < 20) SELECT n, s, n_name FROM r JOIN nation ON n = n_nationkey",
    "lateral_join": "SELECT r_name, m FROM region, LATERAL (SELECT MAX(n_nationkey) AS m FROM nation WHERE n_regionkey = r_regionkey) AS q",
    "json_value": "SELECT event_id, CAST(JSON_EXTRACT_STRING(props, '$.k') AS BIGINT) AS k FROM events",
    "bitwise": "SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 8 AS o FROM nation",
    "filter_ilike": "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b%'",
    "regexp": "SELECT doc_id FROM documents WHERE REGEXP_MATCHES(text, '[0-9]{4}-[0-9]{2}')",
    "except_of_null_list": "SELECT p_size, CAST(SUM(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls FROM (SELECT p_size, UNNEST(LIST(NULLIF(p_type, 'PROMO'))) AS x FROM part GROUP BY p_size) AS q GROUP BY p_size",
    # plain SQL over the other tables
    "documents_by_language": "SELECT lang, COUNT(*) AS n, CAST(SUM(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang",
    "conversations_turns": "SELECT role, COUNT(*) AS n, MAX(turn) AS last FROM conversations GROUP BY role",
    "events_by_type": "SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS v FROM events GROUP BY event_type",
}


def _text_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nation.groupBy("n_regionkey").agg(functions.sum_text(F.col("n_name"), F.col("n_nationkey")).alias("names"))


def _frame_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    joined = operators.join(nation, region, F.expr("n_regionkey = r_regionkey"), "left")
    return operators.aggregate(joined, ["r_name"], having="n > 1", n=("count", "*"), low=("min", "n_nationkey"))


def _frame_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.top(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice"), 7, "-o_totalprice", "o_orderkey", offset=3)


def _frame_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(c).alias("k")) for t, c in (("nation", "n_regionkey"), ("region", "r_regionkey")))
    return operators.combine("except", a, b, every=True)


def _pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated values spare the pass that would look for them."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


FRAME_QUERIES = {"frame_pivot": _pivot, "agg_string_concat": _text_sum, "frame_join_aggregate": _frame_join, "frame_top": _frame_top, "frame_except_all": _frame_except}
FRAME_SQL = {
    "frame_pivot": "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS F, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS O, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority",
    "agg_string_concat": "SELECT n_regionkey, string_agg(n_name, '' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey",
    "frame_join_aggregate": "SELECT r_name, COUNT(*) AS n, MIN(n_nationkey) AS low FROM nation LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY r_name HAVING COUNT(*) > 1",
    "frame_top": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 3",
    "frame_except_all": "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey AS k FROM region",
}
