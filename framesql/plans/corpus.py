"""Twenty-two decision-support queries on the tables at hand.

The tables have no part-supplier relation; where a query needs it, it is derived from line items.
"""

from __future__ import annotations

_PARTSUPP = "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, MIN(l_extendedprice / l_quantity) AS ps_supplycost, SUM(l_quantity) AS ps_availqty FROM lineitem GROUP BY l_partkey, l_suppkey)"

SQL = {
    "q01": """SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 0) AS sum_qty, ROUND(SUM(l_extendedprice), 0) AS sum_base_price,
        ROUND(SUM(l_extendedprice * (1 - l_discount)), 0) AS sum_disc_price, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 0) AS sum_charge,
        ROUND(AVG(l_quantity), 4) AS avg_qty, ROUND(AVG(l_extendedprice), 2) AS avg_price, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS count_order
        FROM lineitem WHERE l_shipdate <= DATE '2001-09-01' - INTERVAL '90' DAY
        GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "q02": f"""WITH ps AS {_PARTSUPP}
        SELECT s_acctbal, s_name, n_name, p_partkey FROM part, supplier, ps, nation, region
        WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size <= 15 AND p_type LIKE '%O' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
          AND ps_supplycost = (SELECT MIN(p2.ps_supplycost) FROM ps AS p2, supplier AS s2, nation AS n2, region AS r2
                               WHERE p_partkey = p2.ps_partkey AND s2.s_suppkey = p2.ps_suppkey AND s2.s_nationkey = n2.n_nationkey AND n2.n_regionkey = r2.r_regionkey AND r2.r_name = 'EUROPE')
        ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "q03": """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
        FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
          AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "q04": """SELECT o_orderpriority, COUNT(*) AS order_count FROM orders
        WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-07-01' + INTERVAL '3' MONTH
          AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
        GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "q05": """SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
          AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'
        GROUP BY n_name ORDER BY revenue DESC""",
    "q06": """SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
        WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "q07": """SELECT supp_nation, cust_nation, l_year, ROUND(SUM(volume), 2) AS revenue FROM (
          SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(EXTRACT(YEAR FROM l_shipdate) AS BIGINT) AS l_year, l_extendedprice * (1 - l_discount) AS volume
          FROM supplier, lineitem, orders, customer, nation AS n1, nation AS n2
          WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
            AND ((n1.n_name = 'NATION_15' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_15'))) AS shipping
        GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    "q08": """SELECT o_year, ROUND(SUM(CASE WHEN nation_name = 'NATION_15' THEN volume ELSE 0 END) / SUM(volume), 6) AS mkt_share FROM (
          SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation_name
          FROM part, supplier, lineitem, orders, customer, nation AS n1, nation AS n2, region
          WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
            AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type = 'ECONOMY') AS all_nations
        GROUP BY o_year ORDER BY o_year""",
    "q09": f"""SELECT nation_name, o_year, ROUND(SUM(amount), 0) AS sum_profit FROM (
          SELECT n_name AS nation_name, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity AS amount
          FROM part, supplier, lineitem, {_PARTSUPP} AS partsupp, orders, nation
          WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey
            AND p_name LIKE '%widget%') AS profit
        GROUP BY nation_name, o_year ORDER BY nation_name, o_year DESC""",
    "q10": """SELECT c_custkey, c_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1996-10-01' + INTERVAL '3' MONTH
          AND l_returnflag = 'R' AND c_nationkey = n_nationkey
        GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "q11": f"""WITH ps AS {_PARTSUPP}
        SELECT ps_partkey, ROUND(SUM(ps_supplycost * ps_availqty), 0) AS total FROM ps, supplier, nation
        WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_15' GROUP BY ps_partkey
        HAVING SUM(ps_supplycost * ps_availqty) > (SELECT SUM(ps_supplycost * ps_availqty) * 0.0005 FROM ps, supplier, nation
                                                   WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_15')
        ORDER BY total DESC, ps_partkey""",
    "q12": """SELECT l_linestatus, CAST(SUM(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
          CAST(SUM(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
        FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND o_orderdate < l_shipdate
        GROUP BY l_linestatus ORDER BY l_linestatus""",
    "q13": """SELECT c_count, COUNT(*) AS custdist FROM (
          SELECT c_custkey, COUNT(o_orderkey) FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '5%' GROUP BY c_custkey) AS c_orders (c_custkey, c_count)
        GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "q14": """SELECT ROUND(100.00 * SUM(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / SUM(l_extendedprice * (1 - l_discount)), 4) AS promo_revenue
        FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-09-01' + INTERVAL '1' MONTH""",
    "q15": """WITH revenue (supplier_no, total_revenue) AS (
          SELECT l_suppkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) FROM lineitem
          WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-01' + INTERVAL '3' MONTH GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT MAX(total_revenue) FROM revenue) ORDER BY s_suppkey""",
    "q16": f"""SELECT p_brand, p_type, p_size, COUNT(DISTINCT ps_suppkey) AS supplier_cnt FROM {_PARTSUPP} AS partsupp, part
        WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#12' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
          AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
        GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "q17": """SELECT ROUND(SUM(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part
        WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity < (SELECT 0.2 * AVG(b.l_quantity) FROM lineitem AS b WHERE b.l_partkey = p_partkey)""",
    "q18": """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, ROUND(SUM(l_quantity), 2) AS quantity FROM customer, orders, lineitem
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 300) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
        GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "q19": """SELECT ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem, part
        WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity >= 1 AND l_quantity <= 11 AND p_size BETWEEN 1 AND 25 AND p_type IN ('SMALL', 'PROMO'))
           OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity >= 10 AND l_quantity <= 20 AND p_size BETWEEN 1 AND 40 AND p_type IN ('MEDIUM', 'LARGE'))""",
    "q20": f"""SELECT s_name FROM supplier, nation WHERE s_suppkey IN (
          SELECT ps_suppkey FROM {_PARTSUPP} AS partsupp WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'large%')
            AND ps_availqty > (SELECT 0.5 * SUM(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'))
          AND s_nationkey = n_nationkey AND n_name IN ('NATION_15', 'NATION_2', 'NATION_3') ORDER BY s_name""",
    "q21": """SELECT s_name, COUNT(*) AS numwait FROM supplier, lineitem AS l1, orders, nation
        WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R'
          AND EXISTS (SELECT * FROM lineitem AS l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
          AND NOT EXISTS (SELECT * FROM lineitem AS l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
          AND s_nationkey = n_nationkey
        GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "q22": """SELECT code, COUNT(*) AS numcust, ROUND(SUM(c_acctbal), 2) AS totacctbal FROM (
          SELECT SUBSTRING(c_mktsegment, 1, 2) AS code, c_acctbal FROM customer
          WHERE SUBSTRING(c_mktsegment, 1, 2) IN ('BU', 'MA') AND c_acctbal > (SELECT AVG(c2.c_acctbal) FROM customer AS c2 WHERE c2.c_acctbal > 0.00 AND SUBSTRING(c2.c_mktsegment, 1, 2) IN ('BU', 'MA'))
            AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderdate >= DATE '1997-01-01')) AS custsale
        GROUP BY code ORDER BY code""",
}
