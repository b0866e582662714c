"""Registration of queries with their oracle, and the SQL views that the oracles share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: DuckDB views by name; `oracle` puts in front of a query those that it names.
VIEWS = {
    "items": """
    SELECT l_orderkey AS group_id,
           substr('ABCDEFG', l_linenumber, 1) || CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_suppkey % 4 + 1 AS varchar) ELSE '' END AS item_code,
           l_linenumber AS line_no, p_name AS item_name,
           CASE WHEN l_linenumber = 7 THEN 'OTHER' ELSE 'STANDARD' END AS item_type,
           CASE WHEN l_tax = 0.08 THEN NULL ELSE l_extendedprice END AS label,
           CASE WHEN l_discount = 0 THEN NULL ELSE round(l_discount * 5000) END AS points,
           list_sort(list_distinct(string_split(p_name || ' ' || lower(p_type), ' '))) AS tags
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity,
              l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem) l
    JOIN part ON l_partkey = p_partkey WHERE rn = 1""",
    "item_stats": """
    SELECT l_orderkey AS group_id, l_linenumber AS line_no, CAST(sum(l_quantity) AS bigint) AS popularity
    FROM lineitem WHERE l_quantity > 3 GROUP BY 1, 2""",
    "groups_": """
    SELECT o_orderkey AS group_id, o_orderpriority AS group_type, o_orderstatus AS phase, CAST(epoch(o_orderdate) AS bigint) AS start_time FROM orders""",
    "merged": """
    SELECT i.*, s.popularity, g.group_type, g.phase, g.start_time
    FROM items i LEFT JOIN item_stats s USING (group_id, line_no) LEFT JOIN groups_ g USING (group_id)""",
    "model": """
    SELECT group_id, line_no, item_code, item_name, item_type, label, tags, group_type, phase, start_time,
           regexp_extract(upper(item_code), '^([A-Z]+)', 1) AS index_letter,
           coalesce(try_cast(regexp_extract(item_code, '(\\d+)$', 1) AS bigint), 0) AS index_number,
           ascii(item_code) - 64 AS index_rank,
           coalesce(points, 0.0) AS points, CAST(points IS NOT NULL AS int) AS has_points,
           coalesce(popularity, 0) AS popularity, CAST(popularity IS NULL AS int) AS popularity_missing,
           ln(1 + coalesce(popularity, 0)) AS log_popularity, len(tags) AS tag_count
    FROM merged WHERE item_type = 'STANDARD' AND label IS NOT NULL""",
    "aged": """
    SELECT *, popularity / age_days AS per_day, ln(1 + popularity / age_days) AS log_per_day
    FROM (SELECT m.*, greatest(coalesce((a.t - start_time) / 86400.0::double, 1.0), 1.0) AS age_days
          FROM model m, (SELECT max(start_time) + 86400 AS t FROM groups_) a)""",
    "docs_": """
    SELECT d.doc_id, text, lang, source, quality AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "time_ranks": """
    SELECT start_time, row_number() OVER (ORDER BY start_time) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT start_time FROM model)""",
    "time_split": """
    SELECT m.group_id, m.line_no, CASE WHEN rk <= a THEN 'train' WHEN rk <= a + b THEN 'valid' ELSE 'test' END AS split_name,
           CASE WHEN rk <= a THEN 0 WHEN rk <= a + b THEN 1 ELSE 2 END AS fold
    FROM model m JOIN (SELECT *, n * 70 // 100 + CAST(l > 0 AND r1 >= r2 AS int) AS a, n * 15 // 100 + CAST(CASE WHEN r1 >= r2 THEN l > 1 ELSE l > 0 END AS int) AS b
                       FROM (SELECT *, n * 70 % 100 AS r1, n * 15 % 100 AS r2, n - n * 70 // 100 - 2 * (n * 15 // 100) AS l FROM time_ranks)) t USING (start_time)""",
    "group_split": """
    SELECT m.group_id, m.line_no, CASE WHEN rk <= a THEN 'train' WHEN rk <= a + b THEN 'valid' ELSE 'test' END AS split_name,
           CASE WHEN rk <= a THEN 0 WHEN rk <= a + b THEN 1 ELSE 2 END AS fold
    FROM model m JOIN (SELECT *, n * 70 // 100 + CAST(l > 0 AND r1 >= r2 AS int) AS a, n * 15 // 100 + CAST(CASE WHEN r1 >= r2 THEN l > 1 ELSE l > 0 END AS int) AS b
                       FROM (SELECT *, n * 70 % 100 AS r1, n * 15 % 100 AS r2, n - n * 70 // 100 - 2 * (n * 15 // 100) AS l
                             FROM (SELECT group_id, row_number() OVER (ORDER BY md5('42:' || group_id), group_id) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM model)))) t USING (group_id)""",
    # Predictions of models that SQL can fit: the train mean, and train means by a column.
    "joined": """
    SELECT m.*, s.strategy, s.split_name FROM aged m JOIN (SELECT 'forward' AS strategy, * FROM time_split UNION ALL SELECT 'grouped', * FROM group_split) s USING (group_id, line_no)""",
    # Sums from which the coefficients of ridge models with one or two features follow; the penalty 1 is on standardised inputs.
    "sums": """
    SELECT strategy, avg(label) AS my, avg(index_rank) AS m1, avg(log_popularity) AS m2, avg(log_per_day) AS m3,
           var_pop(index_rank) * (1 + 1.0::double / count(*)) AS a1, var_pop(log_popularity) * (1 + 1.0::double / count(*)) AS a2, var_pop(log_per_day) * (1 + 1.0::double / count(*)) AS a3,
           covar_pop(index_rank, log_popularity) AS c2, covar_pop(index_rank, log_per_day) AS c3, covar_pop(label, index_rank) AS y1, covar_pop(label, log_popularity) AS y2, covar_pop(label, log_per_day) AS y3
    FROM joined WHERE split_name = 'train' GROUP BY 1""",
    "predictions": """
    SELECT strategy, model_name, split_name, group_id, line_no, item_code, start_time, label AS actual, my + CASE model_name WHEN 'mean' THEN 0
      WHEN 'rank' THEN (index_rank - m1) * y1 / a1 WHEN 'popularity' THEN (log_popularity - m2) * y2 / a2
      WHEN 'full' THEN (index_rank - m1) * (y1 * a2 - y2 * c2) / (a1 * a2 - c2 * c2) + (log_popularity - m2) * (y2 * a1 - y1 * c2) / (a1 * a2 - c2 * c2)
      ELSE (index_rank - m1) * (y1 * a3 - y3 * c3) / (a1 * a3 - c3 * c3) + (log_per_day - m3) * (y3 * a1 - y1 * c3) / (a1 * a3 - c3 * c3) END AS predicted
    FROM joined JOIN sums USING (strategy), (VALUES ('mean'), ('rank'), ('popularity'), ('full'), ('full_aged')) v(model_name)""",
    "metrics": """
    SELECT strategy, model_name, split_name, count(*) AS n, avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) ** 2)) AS rmse,
           1 - sum((predicted - actual) ** 2) / (var_pop(actual) * count(*)) AS r2,
           avg(CAST(abs(predicted - actual) <= 10000 AS int)) AS within_1, avg(CAST(abs(predicted - actual) <= 20000 AS int)) AS within_2
    FROM predictions GROUP BY 1, 2, 3""",
}


def oracle(body: str) -> str:
    """The query behind the views it needs."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name, view in VIEWS.items():
            if re.search(rf"\b{name}\b", text) and name not in need:
                visit(view)
                if name not in need:
                    need.append(name)

    visit(body)
    heads = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in need)
    body = body.strip()
    if not heads:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its oracle where SQL can express it."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = oracle(sql)
        return f

    return put
