"""The query surface: statements that Spark and the SQL oracle read alike.

Tables are written in braces. Sums of doubles go through DECIMAL, so that the
order of addition never shows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

TWINS = {
    # scans, projections, predicates
    "scan_filter_project": "SELECT l_orderkey, l_partkey, l_quantity AS qty, l_extendedprice * 1 AS price FROM {lineitem} WHERE l_quantity < 5 AND l_returnflag = 'R'",
    "scan_star": "SELECT n.* FROM {nation} n",
    "predicate_between": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderkey NOT BETWEEN 100 AND 5000",
    "predicate_in_list": "SELECT o_orderkey, o_orderpriority FROM {orders} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')",
    "predicate_like": "SELECT p_partkey, p_type FROM {part} WHERE p_type LIKE '%A%' AND p_name NOT LIKE 'x%'",
    "predicate_null": "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM {orders} WHERE nullif(o_orderstatus, 'F') IS NULL OR nullif(o_orderpriority, '5-LOW') IS NOT NULL",
    "expr_case": "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 20000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS done FROM {orders}",
    "expr_cast": "SELECT o_orderkey, CAST(o_orderkey AS INTEGER) AS k, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey AS VARCHAR(20)) AS txt FROM {orders}",
    "expr_arithmetic": "SELECT l_orderkey, l_linenumber, l_linenumber + 2 * 3 - 1 AS a, l_linenumber % 3 AS m, -l_linenumber AS n, l_linenumber & 3 AS b_and, l_linenumber | 8 AS b_or, l_quantity / 4 AS q FROM {lineitem}",
    "expr_concat": "SELECT c_custkey, c_name || '/' || c_mktsegment AS tag FROM {customer}",
    "expr_row_value": "SELECT o_orderkey FROM {orders} WHERE (o_orderstatus, o_orderpriority) IN (SELECT o_orderstatus, o_orderpriority FROM {orders} WHERE o_orderkey < 20)",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}",
    # subqueries
    "exists_semi": "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)",
    "not_exists_anti": "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
    "in_subquery": "SELECT s_suppkey FROM {supplier} WHERE s_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)",
    "not_in_subquery": "SELECT p_partkey FROM {part} WHERE p_partkey NOT IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 45)",
    "scalar_subquery": "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT max(o_totalprice) * 0.9 FROM {orders})",
    "correlated_scalar": "SELECT c.c_custkey, (SELECT count(*) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS n FROM {customer} c",
    "derived_table": "SELECT seg, n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM {customer} GROUP BY c_mktsegment) t WHERE n > 1",
    "join_group": "SELECT r.r_name, n.n_name, s.s_suppkey FROM {region} r JOIN ({nation} n JOIN {supplier} s ON s.s_nationkey = n.n_nationkey) ON n.n_regionkey = r.r_regionkey",
    "values_source": "SELECT t.k, t.v, n.n_name FROM (VALUES (0, 'a'), (1, 'b'), (99, 'z')) AS t(k, v) LEFT JOIN {nation} n ON n.n_nationkey = t.k",
    "cte_chain": "WITH big AS (SELECT o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > 50000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c.c_name, per.n FROM per JOIN {customer} c ON c.c_custkey = per.o_custkey",
    "cte_recursive": "WITH RECURSIVE walk(k, depth) AS (SELECT 0, 0 UNION ALL SELECT k + 2, depth + 1 FROM walk WHERE depth < 12) SELECT walk.k, walk.depth, n.n_name FROM walk JOIN {nation} n ON n.n_nationkey = walk.k",
    # joins
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'",
    "join_right": "SELECT o.o_orderkey, c.c_custkey FROM {orders} o RIGHT JOIN {customer} c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000",
    "join_full": "SELECT s.s_suppkey, c.c_custkey FROM (SELECT * FROM {supplier} WHERE s_suppkey < 40) s FULL JOIN (SELECT * FROM {customer} WHERE c_custkey BETWEEN 20 AND 60) c ON s.s_suppkey = c.c_custkey",
    "join_cross": "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n",
    "join_natural": "SELECT r_name, a.k FROM (SELECT n_regionkey AS r_regionkey, n_nationkey AS k FROM {nation}) a NATURAL JOIN {region}",
    "join_using": "SELECT k, a.n, b.m FROM (SELECT o_custkey AS k, count(*) AS n FROM {orders} GROUP BY o_custkey) a JOIN (SELECT c_custkey AS k, c_nationkey AS m FROM {customer}) b USING (k)",
    "join_theta": "SELECT a.n_name AS low, b.n_name AS high FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "join_self": "SELECT a.o_orderkey AS first_key, b.o_orderkey AS next_key FROM {orders} a JOIN {orders} b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate AND a.o_orderkey < b.o_orderkey",
    "join_star": "SELECT r.r_name, count(*) AS n, CAST(sum(CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
    # aggregation
    "agg_group_having": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS qty, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM {lineitem} GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10",
    "agg_avg": "SELECT o_orderpriority, round(avg(CAST(o_totalprice AS DECIMAL(18, 2))), 2) AS mean FROM {orders} GROUP BY o_orderpriority",
    "agg_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS total FROM {orders} GROUP BY o_orderstatus",
    "agg_filter": "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) AS n FROM {orders} GROUP BY o_custkey",
    "agg_global": "SELECT count(*) AS n, count(nullif(l_linenumber, 1)) AS others, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day FROM {lineitem}",
    "agg_expression_key": "SELECT l_linenumber % 2 AS odd, count(*) AS n FROM {lineitem} GROUP BY l_linenumber % 2",
    "agg_total": "SELECT o_orderstatus, coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) FILTER (WHERE o_orderkey < 0) AS DOUBLE), CAST(0 AS DOUBLE)) AS total FROM {orders} GROUP BY o_orderstatus",
    # windows
    "win_rank": "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)",
    "win_ntile": "SELECT o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS BIGINT) AS q FROM {orders}",
    "win_rows": "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS run, count(*) OVER (PARTITION BY o_custkey) AS n FROM {orders}",
    "win_range": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS near FROM {events}",
    "win_navigation": "SELECT o_orderkey, lag(o_orderkey) OVER w AS prev_key, lead(o_orderkey, 2) OVER w AS next_key, first_value(o_orderkey) OVER w AS first_key FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win_distribution": "SELECT s_suppkey, round(percent_rank() OVER (ORDER BY s_suppkey), 6) AS pr, round(cume_dist() OVER (ORDER BY s_suppkey), 6) AS cd FROM {supplier}",
    # order, limit, sets
    "order_nulls": "SELECT o_orderkey, k FROM (SELECT o_orderkey, nullif(o_orderkey % 7, 0) AS k FROM {orders}) t ORDER BY k ASC NULLS FIRST, o_orderkey LIMIT 40",
    "topk": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "limit_offset": "SELECT c_custkey, c_name FROM {customer} ORDER BY c_custkey LIMIT 15 OFFSET 10",
    "set_union": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "set_union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}",
    "set_intersect": "SELECT c_nationkey AS k FROM {customer} WHERE c_custkey < 50 INTERSECT SELECT s_nationkey FROM {supplier}",
    "set_except": "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_suppkey < 20",
    # scalar functions
    "fn_string": "SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, CAST(length(p_type) AS BIGINT) AS n, substr(p_type, 2, 4) AS part, trim('  ' || p_brand || ' ') AS t, replace(p_type, 'A', 'a') AS r, ltrim('  x') AS lt, rtrim('x  ') AS rt FROM {part}",
    "fn_math": "SELECT p_partkey, abs(-p_size) AS a, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, round(sqrt(p_size), 6) AS s, round(ln(p_size), 6) AS l, round(pow(p_size, 2), 3) AS p, CAST(sign(p_size - 20) AS INTEGER) AS sg FROM {part}",
    "fn_conditional": "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'done') AS st, nullif(o_orderpriority, '5-LOW') AS pr FROM {orders}",
    "fn_date": "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d FROM {orders}",
}


def query(name: str):
    """The Spark side of a twin statement."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = set(re.findall(r"\{(\w+)\}", TWINS[name]))
        return spark.sql(TWINS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})

    run.__name__ = name
    return run


def oracle(name: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", TWINS[name])
