"""The registered T-SQL queries over the test tables, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

import zipfile
from collections.abc import Callable
from functools import lru_cache
from io import BytesIO

from pyspark.sql import DataFrame, SparkSession

from . import store
from .engine import Engine, Session
from .errors import from_spark
from .sources import files, infer, served, shapes

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@lru_cache(8)
def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """One engine for a folder, like that of a server that goes on; its tables are looked at when a statement names them."""
    return Engine(spark).register_parquet(sf_dir, list(TABLES))


FLAGSHIP = """SELECT TOP 5 c.c_mktsegment AS seg, COUNT(*) AS n, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS rev
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderdate >= '1995-01-01' GROUP BY c.c_mktsegment ORDER BY rev DESC"""

#: name: (T-SQL, SQL of DuckDB)
SQL: dict[str, tuple[str, str]] = {
    "flagship": (FLAGSHIP, "SELECT c_mktsegment AS seg, CAST(count(*) AS INT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1 ORDER BY rev DESC LIMIT 5"),
    "proj_star_alias": ("SELECT n.*, [n_name] AS 'label', n_regionkey key2 FROM nation n", "SELECT *, n_name AS label, n_regionkey AS key2 FROM nation"),
    "dummy_from": ("SELECT 1 AS one, 'x' AS t WHERE 1 = 1", "SELECT 1 AS one, 'x' AS t"),
    "filter_between_in": ("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand IN ('brand#12', 'BRAND#23 ', 'Brand#34')", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 20 AND lower(p_brand) IN ('brand#12', 'brand#23', 'brand#34')"),
    "like_sets": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '[A-M]%' AND p_name NOT LIKE '%[xyz]'", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-m].*', 'is') AND NOT regexp_matches(p_name, '.*[xyz]$', 'is')"),
    "like_prefix": ("SELECT p_partkey FROM part WHERE p_type LIKE 'STANDARD%' OR p_type LIKE '%brass%'", "SELECT p_partkey FROM part WHERE lower(p_type) LIKE 'standard%' OR lower(p_type) LIKE '%brass%'"),
    "null_3vl": ("SELECT p_partkey FROM part WHERE NOT (NULLIF(p_size, 10) > 3) OR NULLIF(p_size, 7) IS NULL", "SELECT p_partkey FROM part WHERE NOT (NULLIF(p_size, 10) > 3) OR NULLIF(p_size, 7) IS NULL"),
    "case_iif_choose": ("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS tier, IIF(o_orderstatus = 'f', 1, 0) AS is_f, CHOOSE(1 + CAST(o_orderkey % 3 AS int), 'a', 'b', 'c') AS ch FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS tier, CASE WHEN lower(o_orderstatus) = 'f' THEN 1 ELSE 0 END AS is_f, CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS ch FROM orders"),
    "int_arith": ("SELECT o_orderkey, -CAST(o_custkey AS int) / 7 AS q, o_custkey % 7 AS m, o_custkey * 2 + 1 AS t, CAST(o_custkey AS int) & 6 AS b, o_totalprice / 4 AS f FROM orders", "SELECT o_orderkey, CAST(-(o_custkey // 7) AS INT) AS q, o_custkey % 7 AS m, o_custkey * 2 + 1 AS t, CAST(o_custkey AS INT) & 6 AS b, o_totalprice / 4 AS f FROM orders"),
    "text_coercion": ("SELECT n_nationkey, '5' + n_nationkey AS five, n_name + '!' AS bang FROM nation WHERE n_nationkey = '7' OR n_nationkey > ' 20 '", "SELECT n_nationkey, CAST(5 + n_nationkey AS BIGINT) AS five, n_name || '!' AS bang FROM nation WHERE n_nationkey = 7 OR n_nationkey > 20"),
    "collation": ("SELECT RTRIM(UPPER(c_mktsegment)) AS seg, COUNT(*) AS n FROM (SELECT CASE c_custkey % 2 WHEN 0 THEN UPPER(c_mktsegment) ELSE LOWER(c_mktsegment) + '  ' END AS c_mktsegment FROM customer) d GROUP BY UPPER(c_mktsegment)", "SELECT upper(c_mktsegment) AS seg, CAST(count(*) AS INT) AS n FROM customer GROUP BY 1"),
    "join_inner": ("SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0"),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000"),
    "join_right": ("SELECT s.s_suppkey, n.n_name FROM supplier s RIGHT OUTER JOIN nation n ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 5000", "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON n_nationkey = s_nationkey AND s_acctbal > 5000"),
    "join_full": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 9) b ON a.n_nationkey = b.n_nationkey", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 9) b ON a.n_nationkey = b.n_nationkey"),
    "join_cross": ("SELECT n_name, r_name FROM nation, region", "SELECT n_name, r_name FROM nation, region"),
    "join_theta": ("SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey < n.n_nationkey AND n.n_regionkey <> 2", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey AND n_regionkey <> 2"),
    "join_self": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "join_crosskind": ("SELECT d.k, n.n_name FROM nation n JOIN (SELECT CAST(r_regionkey AS nvarchar(9)) AS k FROM region) d ON d.k = n.n_regionkey", "SELECT CAST(r_regionkey AS VARCHAR) AS k, n_name FROM nation JOIN region ON r_regionkey = n_regionkey"),
    "apply_values": ("SELECT o.o_orderkey, v.k FROM orders o CROSS APPLY (VALUES (o.o_custkey), (o.o_orderkey + 1)) v(k)", "SELECT o_orderkey, o_custkey AS k FROM orders UNION ALL SELECT o_orderkey, o_orderkey + 1 FROM orders"),
    "apply_top": ("SELECT c.c_custkey, x.o_orderkey FROM customer c CROSS APPLY (SELECT TOP 2 o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey) x", "SELECT o_custkey AS c_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2 AND o_custkey IN (SELECT c_custkey FROM customer)"),
    "apply_outer": ("SELECT c.c_custkey, x.n FROM customer c OUTER APPLY (SELECT MAX(o.o_totalprice) AS n FROM orders o WHERE o.o_custkey = c.c_custkey HAVING COUNT(*) > 12) x", "SELECT c_custkey, n FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS n FROM orders GROUP BY 1 HAVING count(*) > 12) ON o_custkey = c_custkey"),
    "group_expr_having": ("SELECT YEAR(o_orderdate) AS y, COUNT(*) AS n, COUNT_BIG(o_orderkey) AS nb FROM orders GROUP BY YEAR(o_orderdate) HAVING COUNT(*) > 1", "SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(count(*) AS INT) AS n, count(o_orderkey) AS nb FROM orders GROUP BY 1 HAVING count(*) > 1"),
    "agg_distinct": ("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS ds, SUM(DISTINCT l_linenumber) AS sl FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(count(DISTINCT l_suppkey) AS INT) AS ds, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS sl FROM lineitem GROUP BY 1"),
    "agg_stats": ("SELECT l_linestatus, ROUND(STDEV(l_quantity), 6) AS sd, ROUND(STDEVP(l_quantity), 6) AS sp, ROUND(VAR(l_quantity), 6) AS v, ROUND(VARP(l_quantity), 6) AS vp FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 6) AS v, round(var_pop(l_quantity), 6) AS vp FROM lineitem GROUP BY 1"),
    "agg_avg_int": ("SELECT p_brand, AVG(p_size) AS a, ROUND(AVG(p_retailprice), 4) AS f, SUM(p_size) AS s FROM part GROUP BY p_brand", "SELECT p_brand, CAST(sum(p_size) // count(p_size) AS INT) AS a, round(avg(p_retailprice), 4) AS f, CAST(sum(p_size) AS BIGINT) AS s FROM part GROUP BY 1"),
    "agg_minmax_text": ("SELECT MIN(p_name) AS lo, MAX(p_name) AS hi, MAX(p_size) - MIN(p_size) AS spread, COUNT(*) AS n FROM part", "SELECT min(p_name) AS lo, max(p_name) AS hi, CAST(max(p_size) - min(p_size) AS BIGINT) AS spread, CAST(count(*) AS INT) AS n FROM part"),
    "agg_string": ("SELECT n_regionkey, STRING_AGG(n_name, ', ') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY lower(n_name) DESC) AS names FROM nation GROUP BY 1"),
    "set_union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "set_union_all": ("SELECT n_name AS t FROM nation UNION ALL SELECT r_name FROM region", "SELECT n_name AS t FROM nation UNION ALL SELECT r_name FROM region"),
    "set_except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000"),
    "set_intersect": ("SELECT n_nationkey AS k FROM nation INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0", "SELECT n_nationkey AS k FROM nation INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0"),
    "set_mixed": ("SELECT n_nationkey AS k FROM nation UNION ALL SELECT '7' UNION ALL SELECT 2.5", "SELECT CAST(n_nationkey AS DOUBLE) AS k FROM nation UNION ALL SELECT 7.0 UNION ALL SELECT 2.5"),
    "set_left_assoc": ("SELECT n_nationkey AS k FROM nation UNION SELECT 99 INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey = 1", "(SELECT n_nationkey AS k FROM nation UNION SELECT 99) INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey = 1"),
    "cte_chain": ("WITH a AS (SELECT o_custkey AS k, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT k, s FROM a WHERE s > 500000) SELECT c.c_mktsegment AS seg, COUNT(*) AS n FROM b JOIN customer c ON c.c_custkey = b.k GROUP BY c.c_mktsegment", "WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY 1), b AS (SELECT * FROM a WHERE s > 500000) SELECT c_mktsegment AS seg, CAST(count(*) AS INT) AS n FROM b JOIN customer ON c_custkey = k GROUP BY 1"),
    "derived_nested": ("SELECT d.r, MAX(d.n) AS top_n FROM (SELECT x.n_regionkey AS r, COUNT(*) AS n FROM (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey) x GROUP BY x.n_regionkey) d GROUP BY d.r", "SELECT n_regionkey AS r, CAST(count(*) AS INT) AS top_n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "values_from": ("SELECT v.a, v.b FROM (VALUES (1, '2'), (3, 4), (NULL, 5)) AS v(a, b)", "SELECT * FROM (VALUES (1, 2), (3, 4), (NULL, 5)) v(a, b)"),
    "sub_scalar": ("SELECT c_custkey, c_acctbal - (SELECT AVG(c_acctbal) FROM customer) > 0 AS x FROM customer".replace(" > 0 AS x", " AS x"), "SELECT c_custkey, c_acctbal - (SELECT avg(c_acctbal) FROM customer) AS x FROM customer"),
    "sub_correlated": ("SELECT c.c_custkey, (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c", "SELECT c_custkey, CAST(coalesce(n, 0) AS INT) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey"),
    "sub_exists": ("SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT * FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)"),
    "sub_not_exists": ("SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "sub_in": ("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)"),
    "sub_not_in_null": ("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 3) FROM region)", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 3) FROM region)"),
    "sub_any_all": ("SELECT p_partkey FROM part p WHERE p_size > ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND p_retailprice >= ALL (SELECT p2.p_retailprice FROM part p2 WHERE p2.p_brand = p.p_brand)", "SELECT p_partkey FROM (SELECT *, max(p_retailprice) OVER (PARTITION BY p_brand) AS top FROM part) WHERE p_size > (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 1) AND p_retailprice >= top"),
    "sub_order_by": ("SELECT TOP 10 c.c_custkey FROM customer c ORDER BY (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c.c_custkey) DESC, c.c_custkey", "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey ORDER BY coalesce(n, 0) DESC, c_custkey LIMIT 10"),
    "sub_having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) = (SELECT MAX(d.n) FROM (SELECT COUNT(*) AS n FROM orders GROUP BY o_custkey) d)", "SELECT o_custkey, CAST(count(*) AS INT) AS n FROM orders GROUP BY 1 HAVING count(*) = (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey))"),
    "win_rank": ("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, RANK() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS rk, DENSE_RANK() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS dr FROM orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS rk, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS dr FROM orders"),
    "win_ntile": ("SELECT o_orderkey, NTILE(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t FROM orders", "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t FROM orders"),
    "win_lag_lead": ("SELECT o_orderkey, LAG(o_totalprice, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b, LEAD(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a FROM orders", "SELECT o_orderkey, lag(o_totalprice, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a FROM orders"),
    "win_lag_dynamic": ("SELECT o_orderkey, LAG(o_orderkey, CAST(o_orderkey % 3 AS int), -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders", "SELECT o_orderkey, coalesce(CASE o_orderkey % 3 WHEN 0 THEN o_orderkey WHEN 1 THEN lag(o_orderkey, 1) OVER w ELSE lag(o_orderkey, 2) OVER w END, -1) AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"),
    "win_first_last": ("SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f, LAST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM orders", "SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM orders"),
    "win_frame_rows": ("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 2 PRECEDING) AS m FROM orders", "SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS INT) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 2 PRECEDING) AS m FROM orders"),
    "win_running": ("SELECT event_id, SUM(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s, AVG(user_id) OVER (PARTITION BY event_type) AS a FROM events", "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS s, CAST(sum(user_id) OVER (PARTITION BY event_type) // count(user_id) OVER (PARTITION BY event_type) AS BIGINT) AS a FROM events"),
    "win_frame_range": ("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM orders", "SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INT) AS n FROM orders"),
    "sort_nulls_top": ("SELECT TOP 40 p_partkey, NULLIF(p_size, 10) AS z FROM part ORDER BY NULLIF(p_size, 10), p_partkey", "SELECT p_partkey, NULLIF(p_size, 10) AS z FROM part ORDER BY z NULLS FIRST, p_partkey LIMIT 40"),
    "top_percent": ("SELECT TOP 10 PERCENT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey", "SELECT c_custkey FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rn, count(*) OVER () AS n FROM customer) WHERE rn <= ceil(n * 10 / 100)"),
    "top_ties": ("SELECT TOP 5 WITH TIES p_partkey, p_size FROM part ORDER BY p_size DESC", "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 5"),
    "offset_fetch": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey OFFSET 25 ROWS FETCH NEXT 50 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 25"),
    "distinct": ("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer ORDER BY c_nationkey", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer"),
    "str_fns": ("SELECT p_partkey, LEN(p_name) AS ln, UPPER(p_name) AS u, LEFT(p_name, 3) AS l3, RIGHT(p_name, 2) AS r2, SUBSTRING(p_name, 0, 4) AS s, CHARINDEX('A', p_name) AS ci, REVERSE(p_name) AS rv, REPLACE(p_name, 'a', '_') AS rp, STUFF(p_name, 2, 2, 'ZZ') AS st, CONCAT(p_name, NULL, p_size) AS cc, QUOTENAME(p_name) AS q, REPLICATE('ab', 2) AS rr, PATINDEX('%[aeiou]%', p_name) AS px FROM part", "SELECT p_partkey, CAST(length(rtrim(p_name)) AS INT) AS ln, upper(p_name) AS u, left(p_name, 3) AS l3, right(p_name, 2) AS r2, substring(p_name, 1, 3) AS s, CAST(instr(lower(p_name), 'a') AS INT) AS ci, reverse(p_name) AS rv, replace(p_name, 'a', '_') AS rp, CASE WHEN length(p_name) >= 2 THEN left(p_name, 1) || 'ZZ' || substring(p_name, 4) END AS st, p_name || p_size AS cc, '[' || replace(p_name, ']', ']]') || ']' AS q, 'abab' AS rr, CAST(CASE WHEN regexp_matches(p_name, '[aeiou]', 'i') THEN length(regexp_extract(p_name, '^([^aeiou]*)[aeiou]', 1, 'i')) + 1 ELSE 0 END AS INT) AS px FROM part"),
    "math_fns": ("SELECT c_custkey, ABS(c_acctbal) AS a, FLOOR(c_acctbal) AS f, CEILING(c_acctbal) AS c, SIGN(c_acctbal) AS s, ROUND(c_acctbal, 1) AS r, SQRT(ABS(c_acctbal)) AS q, SQUARE(c_custkey) AS sq, POWER(2, 10) AS p, LOG10(1000.0) AS l, PI() AS pi FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, CAST(sign(c_acctbal) AS INT) AS s, CAST(round(CAST(c_acctbal AS DECIMAL(18, 4)), 1) AS DOUBLE) AS r, sqrt(abs(c_acctbal)) AS q, CAST(c_custkey * c_custkey AS DOUBLE) AS sq, 1024 AS p, 3.0::DOUBLE AS l, pi() AS pi FROM customer"),
    "date_parts": ("SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, DATEPART(quarter, o_orderdate) AS q, DATEPART(dayofyear, o_orderdate) AS dy, DATEPART(weekday, o_orderdate) AS w, DATENAME(month, o_orderdate) AS mn FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(quarter(o_orderdate) AS INT) AS q, CAST(dayofyear(o_orderdate) AS INT) AS dy, CAST(dayofweek(o_orderdate) + 1 AS INT) AS w, monthname(o_orderdate) AS mn FROM orders"),
    "datediff": ("SELECT o_orderkey, DATEDIFF(year, o_orderdate, '2000-06-15') AS y, DATEDIFF(month, o_orderdate, '2000-06-15') AS m, DATEDIFF(day, o_orderdate, '2000-06-15') AS d, DATEDIFF(hour, o_orderdate, '2000-06-15 10:30') AS h FROM orders", "SELECT o_orderkey, CAST(date_diff('year', o_orderdate, TIMESTAMP '2000-06-15') AS INT) AS y, CAST(date_diff('month', o_orderdate, TIMESTAMP '2000-06-15') AS INT) AS m, CAST(date_diff('day', o_orderdate, TIMESTAMP '2000-06-15') AS INT) AS d, CAST(date_diff('hour', o_orderdate, TIMESTAMP '2000-06-15 10:30:00') AS INT) AS h FROM orders"),
    "dateadd_eomonth": ("SELECT o_orderkey, DATEADD(month, 1, o_orderdate) AS m, DATEADD(day, -3, o_orderdate) AS d, EOMONTH(o_orderdate) AS e FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS m, o_orderdate - INTERVAL 3 DAY AS d, CAST(last_day(o_orderdate) AS TIMESTAMP) AS e FROM orders"),
    "convert_styles": ("SELECT o_orderkey, CONVERT(varchar(10), o_orderdate, 120) AS iso, CONVERT(varchar(10), o_orderdate, 101) AS us, CONVERT(varchar(8), o_orderdate, 112) AS packed FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%m/%d/%Y') AS us, strftime(o_orderdate, '%Y%m%d') AS packed FROM orders"),
    "try_cast": ("SELECT p_partkey, TRY_CAST(p_name AS int) AS a, TRY_CONVERT(float, SUBSTRING(p_brand, 7, 2)) AS b, CAST(p_retailprice AS int) AS c FROM part", "SELECT p_partkey, TRY_CAST(p_name AS INT) AS a, TRY_CAST(substring(p_brand, 7, 2) AS DOUBLE) AS b, CAST(trunc(p_retailprice) AS INT) AS c FROM part"),
    "cast_text": ("SELECT p_partkey, CAST(p_size AS varchar(1)) AS one, CAST(p_name AS char(6)) AS padded, CAST(p_partkey AS nvarchar(20)) AS k FROM part", "SELECT p_partkey, CASE WHEN p_size < 10 THEN CAST(p_size AS VARCHAR) ELSE '*' END AS one, rpad(left(p_name, 6), 6, ' ') AS padded, CAST(p_partkey AS VARCHAR) AS k FROM part"),
    "isnull_coalesce": ("SELECT p_partkey, ISNULL(NULLIF(p_size, 10), -1) AS i, COALESCE(NULLIF(p_size, 10), NULLIF(p_size, 11), 0) AS c, GREATEST(p_size, 25) AS g, LEAST(p_size, 25) AS l FROM part", "SELECT p_partkey, coalesce(NULLIF(p_size, 10), -1) AS i, coalesce(NULLIF(p_size, 10), NULLIF(p_size, 11), 0) AS c, greatest(p_size, 25) AS g, least(p_size, 25) AS l FROM part"),
    "pricing_summary": ("SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, ROUND(AVG(l_discount), 6) AS disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(avg(l_discount), 6) AS disc, CAST(count(*) AS INT) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"),
    "agg_count_big": ("SELECT o_orderstatus, COUNT_BIG(*) AS n, COUNT_BIG(DISTINCT o_custkey) AS d FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS d FROM orders GROUP BY 1"),
    "agg_all": ("SELECT p_brand, SUM(ALL p_size) AS s, COUNT(ALL NULLIF(p_size, 10)) AS n, MAX(ALL p_type) AS m FROM part GROUP BY p_brand", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS s, CAST(count(NULLIF(p_size, 10)) AS INT) AS n, max(p_type) AS m FROM part GROUP BY 1"),
    "agg_in_expr": ("SELECT p_brand, MAX(p_size) - MIN(p_size) + COUNT(*) * 2 AS x, CASE WHEN AVG(p_size) > 25 THEN 'big' ELSE 'small' END AS b, IIF(COUNT(*) > 1, SUM(p_size) % 7, -1) AS m FROM part GROUP BY p_brand", "SELECT p_brand, CAST(max(p_size) - min(p_size) + count(*) * 2 AS BIGINT) AS x, CASE WHEN sum(p_size) // count(p_size) > 25 THEN 'big' ELSE 'small' END AS b, CAST(CASE WHEN count(*) > 1 THEN sum(p_size) % 7 ELSE -1 END AS BIGINT) AS m FROM part GROUP BY 1"),
    "agg_distinct_text": ("SELECT o_orderpriority, COUNT(DISTINCT UPPER(o_orderstatus)) AS d, SUM(o_custkey) AS s, MIN(DISTINCT o_orderstatus) AS m FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, CAST(count(DISTINCT upper(o_orderstatus)) AS INT) AS d, CAST(sum(o_custkey) AS BIGINT) AS s, min(o_orderstatus) AS m FROM orders GROUP BY 1"),
    "group_spelling": ("SELECT t, COUNT(*) AS n FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN LOWER(o_orderpriority) WHEN 1 THEN o_orderpriority + ' ' ELSE o_orderpriority END AS t FROM orders) d GROUP BY t", "SELECT o_orderpriority AS t, CAST(count(*) AS INT) AS n FROM orders GROUP BY 1"),
    "distinct_spelling": ("SELECT DISTINCT t FROM (SELECT TOP 1 WITH TIES n_name AS t FROM nation ORDER BY 1 - n_regionkey / 9) d", "SELECT DISTINCT n_name AS t FROM nation"),
    "win_subquery_arg": ("SELECT n_nationkey, NTILE((SELECT COUNT(*) FROM region)) OVER (ORDER BY n_nationkey) AS t, LAG(n_nationkey, (SELECT MIN(r_regionkey) + 2 FROM region)) OVER (ORDER BY n_nationkey) AS l FROM nation", "SELECT n_nationkey, ntile(5) OVER (ORDER BY n_nationkey) AS t, lag(n_nationkey, 2) OVER (ORDER BY n_nationkey) AS l FROM nation"),
    "table_hint": ("SELECT n.n_name, r.r_name FROM nation n WITH (NOLOCK) JOIN region AS r WITH (NOLOCK, INDEX(1)) ON r.r_regionkey = n.n_regionkey OPTION (RECOMPILE)", "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey"),
    "set_order": ("SELECT n_nationkey AS k, n_name AS t FROM nation UNION ALL SELECT 99, 'last' UNION SELECT r_regionkey, r_name FROM region ORDER BY k DESC, 2 OFFSET 1 ROWS FETCH NEXT 9 ROWS ONLY", "SELECT * FROM (SELECT n_nationkey AS k, n_name AS t FROM nation UNION SELECT 99, 'last' UNION SELECT r_regionkey, r_name FROM region) ORDER BY k DESC, t LIMIT 9 OFFSET 1"),
    "pred_cond_ctx": ("SELECT p_partkey, IIF(p_size > 10 AND NOT p_size = 20 OR p_brand LIKE '%3', 1, 0) AS a, CASE WHEN NOT (p_size BETWEEN 5 AND 9) THEN 'out' ELSE 'in' END AS b FROM part WHERE NOT (p_size IN (1, 2)) AND (p_name IS NOT NULL)", "SELECT p_partkey, CASE WHEN p_size > 10 AND NOT p_size = 20 OR p_brand LIKE '%3' THEN 1 ELSE 0 END AS a, CASE WHEN NOT (p_size BETWEEN 5 AND 9) THEN 'out' ELSE 'in' END AS b FROM part WHERE p_size NOT IN (1, 2)"),
    "sub_two_levels": ("SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_extendedprice > 10 * c.c_acctbal AND l.l_quantity > 40))", "SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_extendedprice > 10 * c_acctbal AND l_quantity > 40"),
    "sub_two_levels_count": ("SELECT n.n_nationkey, (SELECT COUNT(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_custkey IN (SELECT o.o_custkey FROM orders o WHERE o.o_custkey % 25 = n.n_nationkey)) AS n FROM nation n", "SELECT n_nationkey, CAST(count(c_custkey) AS INT) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 25 = n_nationkey AND c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1"),
    "like_column": ("SELECT p.p_partkey, d.k FROM part p JOIN (VALUES (1, '%[aeiou]r%', '!'), (2, '[^A-M]%', '!'), (3, 'a!%%', '!'), (4, '_o%', '~')) d(k, pat, esc) ON p.p_name LIKE d.pat ESCAPE d.esc", "SELECT p_partkey, k FROM part JOIN (VALUES (1, '.*[aeiou]r.*'), (2, '[^A-M].*'), (3, 'a%.*'), (4, '.o.*')) d(k, rx) ON regexp_full_match(p_name, rx, 'is')"),
    "patindex_column": ("SELECT p.p_partkey, d.k, PATINDEX(d.pat, p.p_name) AS i FROM part p CROSS JOIN (VALUES (1, '%[aeiou]%'), (2, '%an%')) d(k, pat)", "SELECT p_partkey, k, CAST(CASE k WHEN 1 THEN CASE WHEN regexp_matches(p_name, '[aeiou]', 'i') THEN length(regexp_extract(p_name, '^([^aeiou]*)[aeiou]', 1, 'i')) + 1 ELSE 0 END ELSE instr(lower(p_name), 'an') END AS INT) AS i FROM part CROSS JOIN (VALUES (1), (2)) d(k)"),
    "agg_string_sep": ("SELECT n_regionkey, STRING_AGG(LOWER(n_name) + '!', CHAR(43) + ' ') WITHIN GROUP (ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(lower(n_name) || '!', '+ ' ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY 1"),
    "cte_shared": ("WITH a AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT x.k, x.n + y.n AS n FROM a x JOIN a y ON y.k = x.k), c AS (SELECT x.k, x.n + y.n AS n FROM b x JOIN b y ON y.k = x.k) SELECT k, n FROM c WHERE n > (SELECT AVG(n) FROM c)", "WITH a AS (SELECT o_custkey AS k, 4 * count(*) AS n FROM orders GROUP BY 1) SELECT k, n FROM a WHERE n > (SELECT sum(n) // count(*) FROM a)"),
    "fn_lengths": ("SELECT n_nationkey, DATALENGTH(n_name + ' ') AS d, LEN(n_name + '  ') AS l, SPACE(2) + n_name AS sp, LTRIM('  ' + n_name) AS lt, RTRIM(n_name + ' ') + '|' AS rt, TRIM(' ' + n_name + ' ') AS tr, TRIM('AI' FROM n_name) AS tx, LOWER(n_name) AS lo FROM nation", "SELECT n_nationkey, CAST(length(n_name) + 1 AS INT) AS d, CAST(length(n_name) AS INT) AS l, '  ' || n_name AS sp, n_name AS lt, n_name || '|' AS rt, n_name AS tr, trim(n_name, 'AIai') AS tx, lower(n_name) AS lo FROM nation"),
    "fn_concat_ws": ("SELECT p_partkey, CONCAT_WS('-', p_brand, NULLIF(p_size, 10), p_type) AS c FROM part", "SELECT p_partkey, concat_ws('-', p_brand, CAST(NULLIF(p_size, 10) AS VARCHAR), p_type) AS c FROM part"),
    "fn_exp_log": ("SELECT p_partkey, ROUND(EXP(p_size / 20.0), 4) AS e, ROUND(LOG(p_retailprice), 4) AS ln, ROUND(LOG(p_retailprice, 2), 4) AS l2 FROM part", "SELECT p_partkey, round(exp(p_size / 20.0), 4) AS e, round(ln(p_retailprice), 4) AS ln, round(ln(p_retailprice) / ln(2), 4) AS l2 FROM part"),
    "fn_chars": ("SELECT p_partkey, ASCII(p_name) AS a, UNICODE(p_type) AS u, CHAR(65 + p_size % 26) AS c, NCHAR(960 + p_size % 10) AS g, TRANSLATE(p_type, 'AEI', '123') AS t, STR(p_size) AS s FROM part", "SELECT p_partkey, CAST(ascii(p_name) AS INT) AS a, CAST(unicode(p_type) AS INT) AS u, chr(65 + p_size % 26) AS c, chr(960 + p_size % 10) AS g, translate(p_type, 'AEI', '123') AS t, CAST(p_size AS VARCHAR) AS s FROM part"),
    "fn_properties": ("SELECT FULLTEXTSERVICEPROPERTY('IsFullTextInstalled') AS f, CONNECTIONPROPERTY('net_transport') AS c, COLLATIONPROPERTY('SQL_Latin1_General_CP1_CI_AS', 'LCID') AS l, DATABASEPROPERTYEX('master', 'Status') AS s, SERVERPROPERTY('EngineEdition') AS e", "SELECT 0 AS f, 'TCP' AS c, 1033 AS l, 'ONLINE' AS s, 3 AS e"),
    "ctx_now": ("SELECT n_nationkey, DATEDIFF(minute, GETDATE(), SYSDATETIME()) AS m, IIF(GETUTCDATE() > '2020-01-01', 1, 0) AS later, DATEDIFF(day, CURRENT_TIMESTAMP, SYSUTCDATETIME()) AS d FROM nation", "SELECT n_nationkey, 0 AS m, 1 AS later, 0 AS d FROM nation"),
    "ctx_object": ("SELECT t.name, IIF(OBJECT_ID(t.name) = t.object_id, 1, 0) AS same, OBJECT_ID(t.name + 'x') AS none, IIF(OBJECT_ID('dbo.[Nation]') > 0, 1, 0) AS known, OBJECTPROPERTY(OBJECT_ID('nation'), 'IsTable') AS tab FROM sys.tables t", "SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events']) AS name, 1 AS same, CAST(NULL AS INT) AS none, 1 AS known, 1 AS tab"),
    "ctx_perm": ("SELECT IS_SRVROLEMEMBER('sysadmin') AS a, IS_MEMBER('db_owner') AS b, HAS_PERMS_BY_NAME('nation', 'OBJECT', 'SELECT') AS c, HAS_DBACCESS('master') AS d, PERMISSIONS() AS e", "SELECT 0 AS a, 0 AS b, 0 AS c, 1 AS d, 0 AS e"),
    "ctx_sid": ("SELECT IIF(SUSER_SID() IS NULL, 1, 0) AS s, SUSER_ID() AS i, SUSER_SNAME() AS n, USER_ID() AS u, ORIGINAL_LOGIN() AS o", "SELECT 1 AS s, CAST(NULL AS INT) AS i, 'sa' AS n, 1 AS u, 'sa' AS o"),
    "ctx_misc": ("SELECT @@LANGUAGE AS l, @@NESTLEVEL AS n, @@FETCH_STATUS AS f, @@SERVERNAME AS s, HOST_NAME() AS h, DB_ID() AS d, fn_syspolicy_is_automation_enabled() AS p, IIF(@@SPID > 50, 1, 0) AS id", "SELECT 'us_english' AS l, 0 AS n, 0 AS f, 'localhost' AS s, 'localhost' AS h, 1 AS d, 0 AS p, 1 AS id"),
    "cast_bit": ("SELECT p_partkey, CAST(p_size - 10 AS bit) AS b, CAST(CASE p_size % 2 WHEN 0 THEN 'FALSE' ELSE '1' END AS bit) AS m, TRY_CAST(p_name AS bit) AS x FROM part", "SELECT p_partkey, p_size <> 10 AS b, p_size % 2 = 1 AS m, CAST(NULL AS BOOLEAN) AS x FROM part"),
    "cast_decimal": ("SELECT p_partkey, CAST(p_retailprice AS decimal(12, 1)) AS d, CAST(p_size AS numeric(5)) AS n, TRY_CAST(p_retailprice * 100000 AS decimal(5, 2)) AS o, CAST(CAST(p_retailprice AS decimal(9, 3)) AS varchar(20)) AS t FROM part", "SELECT p_partkey, CAST(CAST(CAST(p_retailprice AS DECIMAL(18, 6)) AS DECIMAL(12, 1)) AS DOUBLE) AS d, CAST(p_size AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS o, CAST(CAST(p_retailprice AS DECIMAL(18, 3)) AS VARCHAR) AS t FROM part"),
    "cast_money": ("SELECT p_partkey, CAST(p_retailprice / 8 AS money) AS m, CAST(CAST(p_retailprice AS money) AS varchar(30)) AS t, TRY_CAST(p_retailprice * 1000 AS smallmoney) AS o FROM part", "SELECT p_partkey, CAST(CAST(CAST(p_retailprice / 8 AS DECIMAL(18, 10)) AS DECIMAL(18, 4)) AS DOUBLE) AS m, CAST(CAST(p_retailprice AS DECIMAL(18, 2)) AS VARCHAR) AS t, CASE WHEN p_retailprice * 1000 < 214748.3647 THEN CAST(CAST(p_retailprice * 1000 AS DECIMAL(18, 4)) AS DOUBLE) END AS o FROM part"),
    "cast_datetime": ("SELECT o_orderkey, CAST(t AS datetime) AS d, TRY_CAST(t + 'x' AS datetime) AS n, CAST('9:05 pm' + LEFT(t, 0) AS datetime) AS c FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CONVERT(varchar(30), o_orderdate, 120) WHEN 1 THEN CONVERT(varchar(30), o_orderdate, 101) WHEN 2 THEN CONVERT(varchar(30), o_orderdate, 112) WHEN 3 THEN CONVERT(varchar(30), o_orderdate, 106) WHEN 4 THEN CAST(o_orderdate AS varchar(30)) ELSE CONVERT(varchar(30), o_orderdate, 126) END AS t FROM orders) d", "SELECT o_orderkey, o_orderdate AS d, CAST(NULL AS TIMESTAMP) AS n, TIMESTAMP '1900-01-01 21:05:00' AS c FROM orders"),
    "cast_from_datetime": ("SELECT o_orderkey, CAST(o_orderdate AS float) AS f, CAST(o_orderdate AS int) AS i, CAST(o_orderdate AS varchar(30)) AS t, CAST(o_orderdate AS date) AS d FROM orders", "SELECT o_orderkey, CAST(date_diff('day', TIMESTAMP '1900-01-01', o_orderdate) AS DOUBLE) AS f, CAST(date_diff('day', TIMESTAMP '1900-01-01', o_orderdate) AS INT) AS i, strftime(o_orderdate, '%b ') || lpad(CAST(day(o_orderdate) AS VARCHAR), 2, ' ') || strftime(o_orderdate, ' %Y 12:00AM') AS t, o_orderdate AS d FROM orders"),
    "blank_number": ("SELECT n_nationkey + CAST(' ' AS int) AS a, n_nationkey + LEFT(n_name, 0) AS b, IIF('' = 0, 1, 0) AS z FROM nation WHERE n_nationkey <> ''", "SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_nationkey AS BIGINT) AS b, 1 AS z FROM nation WHERE n_nationkey <> 0"),
    "bit_text": ("SELECT p_partkey FROM part WHERE CAST(p_size - 10 AS bit) = 'false' OR CAST(p_size - 11 AS bit) = '0'", "SELECT p_partkey FROM part WHERE p_size IN (10, 11)"),
    "headings": ("SELECT n_nationkey AS [the key], n_name AS \"it's\", n_regionkey 'third' FROM nation", "SELECT n_nationkey AS \"the key\", n_name AS \"it's\", n_regionkey AS third FROM nation"),
    "meta_is_empty": ("SELECT (SELECT COUNT(*) FROM INFORMATION_SCHEMA.VIEWS) + (SELECT COUNT(*) FROM INFORMATION_SCHEMA.ROUTINES) + (SELECT COUNT(*) FROM INFORMATION_SCHEMA.TABLE_CONSTRAINTS) + (SELECT COUNT(*) FROM sys.foreign_keys) AS n", "SELECT CAST(0 AS BIGINT) AS n"),
    "meta_schemata": ("SELECT CATALOG_NAME AS c, SCHEMA_NAME AS s FROM INFORMATION_SCHEMA.SCHEMATA WHERE SCHEMA_NAME = 'dbo'", "SELECT 'master' AS c, 'dbo' AS s"),
    "sys_databases": ("SELECT d.name, d.compatibility_level AS lvl, d.state_desc AS st, d.is_read_only AS ro, d.recovery_model_desc AS rm, d.is_published | d.is_distributor AS pub, m.mirroring_role_desc AS role FROM sys.databases d LEFT JOIN sys.database_mirroring m ON m.database_id = d.database_id", "SELECT 'master' AS name, 160 AS lvl, 'ONLINE' AS st, true AS ro, 'SIMPLE' AS rm, 0 AS pub, CAST(NULL AS VARCHAR) AS role"),
    "meta_dbo": ("SELECT o.name AS t, u.name AS u FROM dbo.sysobjects o CROSS JOIN dbo.sysusers u WHERE o.name LIKE '%ion'", "SELECT unnest(['region', 'nation']) AS t, 'dbo' AS u"),
}

#: Batches whose last result is the answer.
BATCHES: dict[str, tuple[str, str | None]] = {
    "batch_while": ("DECLARE @i int = 0, @s int = 0; WHILE @i < 5 BEGIN SET @i += 1; IF @i = 3 CONTINUE; SET @s += @i END SELECT @i AS i, @s AS s", "SELECT 5 AS i, 12 AS s"),
    "batch_try": ("BEGIN TRY SELECT 1 / 0 AS x END TRY BEGIN CATCH SELECT ERROR_NUMBER() AS n, ERROR_SEVERITY() AS v END CATCH", "SELECT 8134 AS n, 16 AS v"),
    "temp_dml": ("SELECT n_nationkey AS k, n_name AS t INTO #n FROM nation; DELETE FROM #n WHERE k > 20; UPDATE #n SET t = t + '*' WHERE k < 5; INSERT #n VALUES (100, 'new'); SELECT * FROM #n", "SELECT n_nationkey AS k, CASE WHEN n_nationkey < 5 THEN n_name || '*' ELSE n_name END AS t FROM nation WHERE n_nationkey <= 20 UNION ALL SELECT 100, 'new'"),
    "exec_sql": ("DECLARE @n int; EXEC sp_executesql N'SELECT @o = COUNT(*) FROM nation WHERE n_regionkey = @r', N'@r int, @o int OUTPUT', @r = 1, @o = @n OUTPUT; SELECT @n AS n", "SELECT CAST(count(*) AS INT) AS n FROM nation WHERE n_regionkey = 1"),
    "select_assign": ("DECLARE @s nvarchar(max) = ''; SELECT @s = @s + r_name + ';' FROM region ORDER BY r_regionkey; SELECT @s AS s", "SELECT string_agg(r_name || ';', '' ORDER BY r_regionkey) AS s FROM region"),
    "tran_count": ("BEGIN TRAN; BEGIN TRAN; COMMIT; SELECT @@TRANCOUNT AS n; ROLLBACK; SELECT @@TRANCOUNT AS n, @@ERROR AS e", "SELECT 0 AS n, 0 AS e"),
    "info_schema_tables": ("SELECT TABLE_NAME AS t FROM INFORMATION_SCHEMA.TABLES", "SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events']) AS t"),
    "info_schema_columns": ("SELECT COLUMN_NAME AS c, DATA_TYPE AS d, ORDINAL_POSITION AS p FROM INFORMATION_SCHEMA.COLUMNS WHERE TABLE_NAME = 'nation'", "SELECT * FROM (VALUES ('n_nationkey', 'int', 1), ('n_name', 'nvarchar', 2), ('n_regionkey', 'int', 3)) v(c, d, p)"),
    "sys_tables": ("SELECT t.name AS t, COUNT(*) AS n FROM sys.tables t JOIN sys.columns c ON c.object_id = t.object_id WHERE t.name IN ('region', 'nation') GROUP BY t.name", "SELECT 'region' AS t, 2 AS n UNION ALL SELECT 'nation', 3"),
    "sp_columns": ("CREATE TABLE #c (q nvarchar(128), o nvarchar(128), t nvarchar(128), c nvarchar(128), d int, n nvarchar(128), p int, l int, s int, r int, u int, k nvarchar(254), f nvarchar(4000), sd int, sub int, oct int, pos int, isn nvarchar(254), ss int); INSERT #c EXEC sp_columns @table_name = 'region'; SELECT t, c, n, pos FROM #c", "SELECT * FROM (VALUES ('region', 'r_regionkey', 'int', 1), ('region', 'r_name', 'nvarchar', 2)) v(t, c, n, pos)"),
    "sp_tables": ("CREATE TABLE #t (q nvarchar(128), o nvarchar(128), t nvarchar(128), k nvarchar(32), r nvarchar(254)); INSERT #t EXEC sp_tables; SELECT o, t, k FROM #t", "SELECT 'dbo' AS o, unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events']) AS t, 'TABLE' AS k"),
    "assign_row_count": ("DECLARE @a int, @n int; SELECT @a = n_nationkey FROM nation WHERE n_regionkey = 2 ORDER BY n_nationkey; SET @n = @@ROWCOUNT; SELECT @a AS a, @n AS n", "SELECT max(n_nationkey) AS a, CAST(count(*) AS INT) AS n FROM nation WHERE n_regionkey = 2"),
    "assign_fold": ("DECLARE @n int = 0, @s nvarchar(max) = ''; SELECT @n += 1, @s = @s + CASE WHEN @n % 100 = 0 THEN LEFT(c_name, 1) ELSE '' END FROM customer ORDER BY c_custkey; SELECT @n AS n, LEN(@s) AS l, @@ROWCOUNT AS r", "SELECT CAST(count(*) AS INT) AS n, CAST(count(*) // 100 AS INT) AS l, CAST(count(*) AS INT) AS r FROM customer"),
    "throw_raiserror": ("DECLARE @n int; BEGIN TRY RAISERROR('no %s of %d', 16, 3, 'row', 7) END TRY BEGIN CATCH SET @n = ERROR_STATE(); BEGIN TRY THROW 50007, 'again', 2 END TRY BEGIN CATCH SELECT @n AS s, ERROR_NUMBER() AS n, ERROR_MESSAGE() AS m END CATCH END CATCH", "SELECT 3 AS s, 50007 AS n, 'again' AS m"),
    "xp_msver": ("CREATE TABLE #v (i int, n nvarchar(60), v int, c nvarchar(max)); INSERT #v EXEC xp_msver; SELECT i, n, v FROM #v WHERE i < 4 OR i = 20", "SELECT * FROM (VALUES (1, 'ProductName', NULL), (2, 'ProductVersion', NULL), (3, 'Language', 1033), (20, 'Product ID', NULL)) v(i, n, v)"),
    "sp_rowsets": ("CREATE TABLE #s (c nvarchar(128), s nvarchar(128), o nvarchar(128)); INSERT #s EXEC sp_schemata_rowset; CREATE TABLE #c (c nvarchar(128), d nvarchar(128)); INSERT #c EXEC sp_catalogs_rowset; SELECT s.c, s.s, s.o, c.d FROM #s s JOIN #c c ON c.c = s.c", "SELECT 'master' AS c, 'dbo' AS s, 'dbo' AS o, CAST(NULL AS VARCHAR) AS d"),
    "tmp_create_drop": ("CREATE TABLE #a (k int NOT NULL, t nvarchar(20)); INSERT #a SELECT n_nationkey, n_name FROM nation; DROP TABLE #a; CREATE TABLE #a (k bigint, f float); INSERT #a (f, k) SELECT o_totalprice, o_orderkey FROM orders; TRUNCATE TABLE #a; INSERT #a VALUES (1, 2.5), (3, NULL); DROP TABLE IF EXISTS #none; SELECT k, f FROM #a", "SELECT * FROM (VALUES (1::BIGINT, 2.5::DOUBLE), (3, NULL)) v(k, f)"),
    "context_fns": ("SELECT DB_NAME() AS d, SCHEMA_NAME() AS s, SERVERPROPERTY('Collation') AS c, @@MAX_PRECISION AS p, USER_NAME() AS u", "SELECT 'master' AS d, 'dbo' AS s, 'SQL_Latin1_General_CP1_CI_AS' AS c, 38 AS p, 'dbo' AS u"),
}


def _single(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).query(sql)


def _batch(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        return e.answer(sql, session=Session(e)).df

    return run


def _numbers(*batches: str) -> Callable[[SparkSession, str], DataFrame]:
    """Of batches by their place: how many results each gives, and the numbers of its errors."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, out = engine(spark, sf_dir), []
        for i, sql in enumerate(batches):
            a = e.answer(sql, session=Session(e))
            if not a.errors and a.results:
                try:
                    a.results[-1].df.collect()
                except Exception as x:  # of a row, while it is read
                    a.errors.append(from_spark(x))
            out.append((i, len(a.results), ",".join(str(x.number) for x in a.errors)))
        return spark.createDataFrame(out, "batch int, results int, errors string")

    return run


def _rows(*rows: tuple) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({i}, {n}, {chr(39)}{e}{chr(39)})' for i, (n, e) in enumerate(rows))}) v(batch, results, errors)"


def _reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session forgets."""
    e = engine(spark, sf_dir)
    s = Session(e)
    e.answer("SELECT n_nationkey AS k INTO #k FROM nation; BEGIN TRAN; SET XACT_ABORT ON", session=s)
    before = e.answer("SELECT COUNT(*) AS n FROM #k", session=s).df.first().n
    s.reset()
    after = e.answer("SELECT COUNT(*) AS n FROM #k", session=s).errors[0].number
    return spark.createDataFrame([(before, after, s.tran_count, int(s.xact_abort))], "before int, after int, open int, abort int")


#: name: (batches, for each how many results and which errors it gives)
REFUSALS = {
    "grouping_sets": (("SELECT n_regionkey FROM nation GROUP BY ROLLUP(n_regionkey)", "SELECT n_regionkey FROM nation GROUP BY CUBE(n_regionkey)", "SELECT n_regionkey FROM nation GROUP BY GROUPING SETS ((n_regionkey), ())"), ((0, "50000"),) * 3),
    "nested_aggregate": (("SELECT SUM(COUNT(*)) AS n FROM nation GROUP BY n_regionkey", "SELECT AVG(MAX(n_nationkey) + 1) AS n FROM nation", "SELECT n_name FROM nation WHERE COUNT(*) > 1"), ((0, "130"), (0, "130"), (0, "147"))),
    "set_width": (("SELECT 1 AS a UNION SELECT 1, 2", "SELECT 1 AS a, 2 AS b EXCEPT SELECT 1", "SELECT 1 AS a INTERSECT SELECT 1"), ((0, "205"), (0, "205"), (1, ""))),
    "cte_refused": (("WITH c(a) AS (SELECT 1 AS x) SELECT a FROM c", "WITH c AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM c) SELECT n FROM c", "WITH c AS (SELECT 1) SELECT * FROM c"), ((0, "50000"), (0, "50000"), (0, "8155"))),
    "write_refuse": (("INSERT nation VALUES (1, 'x', 1)", "UPDATE nation SET n_name = 'x'", "DELETE FROM nation", "DROP TABLE nation", "CREATE TABLE t (a int)", "TRUNCATE TABLE nation", "SELECT * INTO t FROM nation", "MERGE nation USING region ON 1 = 1"), ((0, "50000"),) * 8),
    "bat_compile": (("SELECT 1 AS a; SELECT @x AS b", "SELECT 1 AS a; SELECT 2 AS", "SELECT 1 AS a; BREAK", "DECLARE @x int = 3; SELECT @x AS b; SELECT 4 AS c"), ((0, "137"), (0, "102"), (0, "135"), (2, ""))),
    "goes_on": (("SELECT 1 / 0 AS a; SELECT 2 AS b", "SET XACT_ABORT ON; SELECT 1 AS a; SELECT 1 / 0 AS b; SELECT 2 AS c", "SELECT 1 AS a; SELECT CAST('x' AS int) AS b; SELECT 2 AS c", "SELECT 1 AS a; SELECT nope FROM nation; SELECT 2 AS c", "EXEC('SELECT * FROM nope'); SELECT 2 AS c", "RAISERROR('x', 16, 1); SELECT 1 AS a", "THROW 50001, 'x', 1; SELECT 1 AS a", "COMMIT; DROP TABLE #none; EXEC nope; SELECT 1 AS a"), ((2, "8134"), (2, "8134"), (2, "245"), (0, "207"), (1, "208"), (1, "50000"), (0, "50001"), (1, "3902,3701,2812"))),
    "run_time_errors": (("SELECT CAST('a' AS float) AS x", "SELECT CAST('a' AS datetime) AS x", "SELECT CAST(300 AS tinyint) AS x", "SELECT LOG(-1) AS x", "SELECT DATEADD(year, 9000, '2024-01-01') AS x", "SELECT TRANSLATE('a', 'ab', 'c') AS x", "SELECT SUBSTRING('a', 1, -1) AS x", "SELECT (SELECT n_nationkey FROM nation) AS x"), ((1, "8114"), (1, "241"), (1, "220"), (1, "3623"), (1, "517"), (1, "9828"), (1, "536"), (1, "512"))),
}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).query(FLAGSHIP)


def _json_nest(spark: SparkSession, sf_dir: str) -> DataFrame:
    walks = [{"id": i, "guide": {"name": f"n{i}"}, "stops": [{"at": f"s{i}{k}", "marks": [1, k]} for k in range(i)]} for i in range(1, 5)]
    e = Engine(spark)
    for n, df in shapes.tables(spark, {"results": walks}, name="walks", expand=True).items():
        e.register(n or "walks", df)
    return e.query("SELECT w.id, [guide.name] AS who, s.stops_index AS place, s.at FROM walks w LEFT JOIN walks_stops s ON s.walks_id = w.id")


def _locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.register("trees", shapes.tables(spark, {"oak": 41.5, "elm": 27.0, "ash": 19.25})[""])
    e.register("days", shapes.tables(spark, {"lat": [52, 48, 60], "sky": ["fog", "sun", "hail"]})[""])
    return e.query("SELECT t.[key] AS k, t.value AS v, d.sky AS n FROM trees t CROSS JOIN days d")


def _xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "<list>" + "".join(f'<item id="{i}"><name>n{i}</name><price>{i}.5</price></item>' for i in range(1, 6)) + "</list>"
    e = Engine(spark)
    e.register("items", shapes.tables(spark, files.xml_document(text.encode()))[""])
    return e.query("SELECT [@id] AS id, name, CAST(price AS float) * 2 AS dbl FROM items")


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "<table><caption>Prices</caption><tr><th>Name<th>Cost</tr>" + "".join(f"<tr><td>p{i}<td>{i * 3}</tr>" for i in range(4)) + "</table>"
    e = Engine(spark)
    e.register("prices", infer.from_records(spark, files.html_tables(text)["Prices"], True))
    return e.query("SELECT Name AS n, Cost + 1 AS c FROM prices")


def _xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.register("sheet", infer.from_records(spark, files.workbook(example_workbook())["People"]))
    return e.query("SELECT name, joined, score * 2 AS twice FROM sheet")


def example_workbook() -> bytes:
    """A small .xlsx with text, numbers and dates."""
    ns, out = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', BytesIO()
    cell = lambda r, c, v, s="": f'<c r="{c}{r}"{s}>' + (f"<v>{v}</v></c>" if not isinstance(v, str) else f"<is><t>{v}</t></is></c>")
    text = ' t="inlineStr"'
    rows = f'<row r="1">{cell(1, "A", "name", text)}{cell(1, "B", "joined", text)}{cell(1, "C", "score", text)}</row>'
    rows += "".join(f'<row r="{r}">{cell(r, "A", f"p{r}", text)}{cell(r, "B", 45_000 + r, " s=" + chr(34) + "1" + chr(34))}{cell(r, "C", r + 0.5)}</row>' for r in range(2, 6))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="People" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of the shared folder, read by the executors."""
    lines = ["id,name,score,code", '1,"a, b",78,007', "2,,99.5,010", "3,c,,100"]
    path = store.write_lines(spark, lines)
    e = Engine(spark)
    e.register("people", files.csv(spark, path))
    return e.query("SELECT id + 1 AS id, name, score, code FROM people")


SOURCES = {"src_json_nest": _json_nest, "src_locate": _locate, "src_xml": _xml, "src_html": _html, "src_xlsx": _xlsx, "src_csv_infer": _csv}
SOURCES_SQL = {
    "src_json_nest": "SELECT CAST(i AS INT) AS id, 'n' || i AS who, CAST(k AS INT) AS place, 's' || i || k AS at FROM range(1, 5) a(i), range(0, 4) b(k) WHERE k < i",
    "src_locate": "SELECT k, v, n FROM (VALUES ('oak', 41.5::DOUBLE), ('elm', 27.0), ('ash', 19.25)) a(k, v), (VALUES ('fog'), ('sun'), ('hail')) b(n)",
    "src_xml": "SELECT CAST(i AS VARCHAR) AS id, 'n' || i AS name, (i + 0.5)::DOUBLE * 2 AS dbl FROM range(1, 6) t(i)", "src_html": "SELECT 'p' || i AS n, CAST(i * 3 + 1 AS BIGINT) AS c FROM range(0, 4) t(i)",
    "src_xlsx": "SELECT 'p' || i AS name, TIMESTAMP '1899-12-30' + CAST(45000 + i AS INT) * INTERVAL 1 DAY AS joined, (i + 0.5)::DOUBLE * 2 AS twice FROM range(2, 6) t(i)",
    "src_csv_infer": "SELECT * FROM (VALUES (2::BIGINT, 'a, b', 78.0::DOUBLE, '007'), (3, NULL, 99.5, '010'), (4, 'c', NULL, '100')) v(id, name, score, code)",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{k: _single(v[0]) for k, v in SQL.items()}, **{k: _batch(v[0]) for k, v in BATCHES.items()}, **{k: _numbers(*v[0]) for k, v in REFUSALS.items()}, "session_reset": _reset, **SOURCES, **served.QUERIES,
}
ORACLE_SQL: dict[str, str] = {
    **{k: v[1] for k, v in SQL.items()}, **{k: v[1] for k, v in BATCHES.items() if v[1]}, **{k: _rows(*v[1]) for k, v in REFUSALS.items()},
    "session_reset": "SELECT CAST(count(*) AS INT) AS before, 208 AS after, 0 AS open, 0 AS abort FROM nation", **SOURCES_SQL, **served.ORACLE_SQL,
}
