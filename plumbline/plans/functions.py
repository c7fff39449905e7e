"""Scalar functions, casts and arithmetic."""

from __future__ import annotations

from plumbline.plans.text import sql_query as q

q("fn_arithmetic", "SELECT l_orderkey, l_linenumber, l_orderkey + l_linenumber * 2 - 3 AS a, -l_linenumber AS b, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS c, l_orderkey % 7 AS d FROM lineitem")
q("fn_division", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 6) AS a, round(l_orderkey / l_linenumber, 6) AS b, round(7 / 2 / l_linenumber * 3, 6) AS c FROM lineitem")
q("fn_division_zero", "SELECT n_nationkey, CASE WHEN isnan(n_nationkey / n_regionkey) THEN 'nan' WHEN n_nationkey / n_regionkey > 1e300 THEN 'inf' ELSE 'number' END AS a, -1 / n_regionkey < -1e300 AS b, isnan(0 / (n_regionkey - n_regionkey)) AS c, round(n_nationkey / NULLIF(n_regionkey, 0), 9) AS d FROM nation")
q("fn_integer_division", "SELECT n_nationkey, CAST((n_nationkey - 12) // 5 AS BIGINT) AS a, CAST(n_nationkey // 4 * 2 AS BIGINT) AS b, (n_nationkey - 12) % 5 AS c FROM nation")
q("fn_decimal_arithmetic", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DOUBLE) AS a, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) + CAST(l_tax AS DECIMAL(4,2)) AS DOUBLE) AS b, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) - 1.25 AS DOUBLE) AS c FROM lineitem")
q("fn_decimal_compare", "SELECT count(*) AS n FROM lineitem WHERE CAST(l_discount AS DECIMAL(4,2)) = 0.05 AND CAST(l_extendedprice AS DECIMAL(12,2)) > 1000.005")
q("fn_abs_round", "SELECT n_nationkey, abs(n_nationkey - 12) AS a, round((n_nationkey - 12) * 0.5e0) AS b, round(n_nationkey / 7.0, 3) AS c, CAST(abs(-2.5) AS DOUBLE) AS d FROM nation")
q("fn_substring", "SELECT p_partkey, substring(p_name, 2, 3) AS a, substr(p_name, -3) AS b, substring(p_name FROM 1 FOR 4) AS c, substring(p_name, 0, 3) AS d, substring(p_name, -4, 2) AS e, substr(p_name, 4) AS f FROM part")
q("fn_substring_computed", "SELECT n_nationkey, substring(n_name, n_nationkey - 5, n_regionkey - 1) AS a, substring(n_name, n_regionkey - 2, 4) AS b FROM nation")
q("fn_strlen", "SELECT doc_id, strlen(text) AS bytes, lang FROM documents")
q("fn_regexp_replace", r"SELECT p_partkey, regexp_replace(p_type, '([A-Z]+) ([A-Z]+)', '\2-\1') AS a, regexp_replace(p_brand, '[0-9]', 'N') AS b, regexp_replace(p_name, '^(.)(.*)$', '\1') AS c, regexp_replace(p_name, 'e', 'E', 'g') AS d FROM part")
q("fn_upper_lower", "SELECT doc_id, upper(text) AS up, lower(text) AS low FROM documents")
q("fn_upper_sharp_s", "SELECT upper('straße') AS a, lower('ÀÉ') AS b, upper('ça') AS c")
q("fn_concat", "SELECT n_nationkey, concat(n_name, '-', NULLIF(n_regionkey, 1)) AS a, concat(NULLIF(n_name, n_name)) AS b FROM nation")
q("fn_coalesce", "SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 1), NULLIF(n_nationkey, 2), -1) AS a, COALESCE(NULLIF(n_name, 'FRANCE'), 'none') AS b FROM nation")
q("fn_case_searched", "SELECT l_returnflag, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'middle' ELSE 'large' END AS size, count(*) AS n FROM lineitem GROUP BY 1, 2")
q("fn_case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS a FROM orders")
q("fn_case_lazy", "SELECT n_nationkey, CASE WHEN n_regionkey <> 0 THEN CAST(n_nationkey // n_regionkey AS BIGINT) ELSE -1 END AS a FROM nation")
q("fn_casts", "SELECT l_orderkey, l_linenumber, CAST(l_quantity / 4 AS INTEGER) AS a, CAST(CAST(l_quantity AS DECIMAL(9,2)) / 8 AS BIGINT) AS b, CAST(l_linenumber AS DOUBLE) AS c, CAST(l_orderkey AS VARCHAR) AS d, l_linenumber::BIGINT AS e FROM lineitem")
q("fn_cast_decimal_rounds", "SELECT n_nationkey, CAST(CAST((n_nationkey - 12.5) AS DECIMAL(6,1)) AS INTEGER) AS a, CAST(CAST((n_nationkey - 12.25) AS DECIMAL(6,2)) AS DECIMAL(5,1))::DOUBLE AS b, CAST((n_nationkey - 12) * 0.5e0 AS INTEGER) AS c FROM nation")
q("fn_cast_text", "SELECT CAST('12' AS INTEGER) AS a, CAST('2020-02-29' AS DATE) AS b, CAST('1.50' AS DECIMAL(5,2))::DOUBLE AS c, CAST('2020-02-29 10:11:12' AS TIMESTAMP) AS d")
q("fn_extract", "SELECT o_orderkey, EXTRACT(year FROM o_orderdate) AS y, EXTRACT(quarter FROM o_orderdate) AS q, EXTRACT(month FROM o_orderdate) AS m, EXTRACT(week FROM o_orderdate) AS w, EXTRACT(day FROM o_orderdate) AS d, EXTRACT(dow FROM o_orderdate) AS dow, EXTRACT(isodow FROM o_orderdate) AS isodow, EXTRACT(doy FROM o_orderdate) AS doy, EXTRACT(isoyear FROM o_orderdate) AS iy FROM orders")
q("fn_extract_time", "SELECT event_id, EXTRACT(hour FROM ts) AS h, EXTRACT(minute FROM ts) AS m, EXTRACT(second FROM ts) AS s, EXTRACT(millisecond FROM ts) AS ms, EXTRACT(microsecond FROM ts) AS us, round(EXTRACT(epoch FROM ts), 3) AS e FROM events")
q("fn_extract_long", "SELECT o_orderkey, EXTRACT(decade FROM o_orderdate) AS a, EXTRACT(century FROM o_orderdate) AS b, EXTRACT(millennium FROM o_orderdate) AS c FROM orders")
q("fn_date_trunc", "SELECT event_id, date_trunc('hour', ts) AS h, date_trunc('day', ts) AS d, date_trunc('week', ts) AS w, date_trunc('month', ts) AS m, date_trunc('minute', ts) AS mi FROM events")
q("fn_date_trunc_long", "SELECT o_orderkey, date_trunc('year', o_orderdate) AS y, date_trunc('quarter', o_orderdate) AS q, date_trunc('decade', o_orderdate) AS d, date_trunc('century', o_orderdate) AS c FROM orders")
q("fn_date_arithmetic", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS a, CAST(o_orderdate AS DATE) - 1 AS b FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-02-28'")
q("fn_epoch_ms", "SELECT event_id, epoch_ms(event_id * 1000 + 1500) AS t FROM events")
q("fn_constant_folding", "SELECT o_orderkey FROM orders WHERE o_orderkey < 2 * 1000 AND o_totalprice > 2.0 / 3.0 * 100000")
