"""DuckDB oracle SQL for the registered queries.

DuckDB only sees the supplied tables, so every statement starts from the same
``readings`` derivation (FIXTURES.md section 1), written independently of the
Spark code. Doubles are rounded the same way on both sides.
"""

from __future__ import annotations

READINGS_CTE = """readings AS (
  SELECT
    md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
                  CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y-%m-%d'))) AS row_id,
    p_brand AS product,
    l_returnflag AS test_code,
    l_orderkey AS order_no,
    CASE l_linenumber % 3 WHEN 0 THEN '  100%  liquid milk ' WHEN 1 THEN '100% powder'
         ELSE '50% liquid milk + 50%   powder' END AS batch_source,
    CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linestatus = 'F' THEN 'Da Vinci' ELSE 'Original' END AS method,
    CASE l_suppkey % 3 WHEN 0 THEN 'SW6' WHEN 1 THEN 'SW5' ELSE 'SW9' END AS swirl,
    CASE WHEN l_quantity = 13 THEN NULL ELSE l_quantity END AS feed_flow,
    l_extendedprice AS heat_temp,
    l_extendedprice * 1.1 + l_tax AS heat_temp_2,
    l_discount AS discount,
    CASE WHEN CAST(round(l_tax * 100) AS BIGINT) = 3 THEN 'n/a'
         ELSE CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR) END AS tax_text,
    p_size AS size,
    l_linestatus AS line_status,
    'P1' AS plant,
    p_retailprice AS unit_cost,
    CASE WHEN l_suppkey % 50 = 0 THEN '#' ELSE CAST(l_linenumber AS VARCHAR) END AS result_int,
    CAST(CAST(0.40 + l_tax + l_discount AS DECIMAL(4,2)) AS VARCHAR) AS result_dbl,
    CASE WHEN l_quantity > 25 AND l_discount < 0.08 THEN 1 ELSE 0 END AS result_flow,
    CASE l_orderkey % 4 WHEN 0 THEN 'A+' WHEN 1 THEN 'A-' WHEN 2 THEN 'A' ELSE 'B' END AS result_grade,
    CAST(l_linenumber % 4 AS VARCHAR) AS result_code,
    CAST(10 * (l_suppkey % 5 + 1) AS VARCHAR) AS result_foam
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

SCORED_CTE = """scored AS (
  SELECT row_id, label, score,
         CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction,
         CASE WHEN b < 179 THEN 'train' WHEN b < 217 THEN 'test' ELSE 'val' END AS split,
         CAST(f % 10 AS INTEGER) AS fold
  FROM (
    SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
                         CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y-%m-%d'))) AS row_id,
           CASE WHEN l_quantity > 25 AND l_discount < 0.08 THEN 1 ELSE 0 END AS label,
           (l_partkey % 101) / 100.0 AS score
    FROM lineitem) s0,
  LATERAL (SELECT CAST(('0x' || substr(row_id, 1, 2)) AS INTEGER) AS b,
                  CAST(('0x' || substr(row_id, 3, 2)) AS INTEGER) AS f) s1
)"""

# Labelled views per target (B1 -> B2 -> null rule -> S1-S3 -> B4 -> S4 -> label).
LAB_CTES = {
    "t1": """lab AS (
  SELECT * EXCLUDE (product, plant, test_code, result_code, result_int, result_dbl, result_flow,
                    result_grade, result_foam, method, swirl, batch_source),
         CASE method WHEN 'Da Vinci' THEN 0 WHEN 'Original' THEN 1 END AS method,
         CASE swirl WHEN 'SW6' THEN 0 WHEN 'SW5' THEN 1 END AS swirl,
         CASE trim(regexp_replace(batch_source, '\\s+', ' ', 'g'))
              WHEN '100% liquid milk' THEN 0 WHEN '100% powder' THEN 1
              WHEN '50% liquid milk + 50% powder' THEN 2 END AS batch_source,
         CASE CAST(result_code AS INTEGER) WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 0 END AS label
  FROM readings
  WHERE product = 'Brand#13' AND test_code IN ('A', 'N', 'R') AND method IS NOT NULL AND feed_flow IS NOT NULL
    AND batch_source IS NOT NULL AND swirl IS NOT NULL)""",
    "t2": """lab AS (
  SELECT * EXCLUDE (product, order_no, batch_source, method, result_int, result_dbl, result_flow,
                    result_grade, result_code, result_foam, swirl),
         CASE swirl WHEN 'SW6' THEN 0 WHEN 'SW5' THEN 1 END AS swirl,
         CASE WHEN CAST(result_int AS INTEGER) IN (0, 1, 2, 3) THEN 1 ELSE 0 END AS label
  FROM readings
  WHERE product = 'Brand#13' AND test_code IN ('N') AND feed_flow IS NOT NULL AND result_int IS DISTINCT FROM '#')""",
    "t3": """lab AS (
  SELECT * EXCLUDE (product, order_no, batch_source, method, result_int, result_dbl, result_flow,
                    result_grade, result_code, result_foam, swirl),
         CASE swirl WHEN 'SW6' THEN 0 WHEN 'SW5' THEN 1 END AS swirl,
         CASE WHEN CAST(result_foam AS INTEGER) IN (10, 20) THEN 1 ELSE 0 END AS label
  FROM readings
  WHERE product = 'Brand#13' AND test_code IN ('R') AND feed_flow IS NOT NULL)""",
    "t4": """lab AS (
  SELECT * EXCLUDE (product, plant, test_code, result_int, result_dbl, result_flow, result_grade,
                    result_code, result_foam, method, swirl, batch_source),
         CASE method WHEN 'Da Vinci' THEN 0 WHEN 'Original' THEN 1 END AS method,
         CASE swirl WHEN 'SW6' THEN 0 WHEN 'SW5' THEN 1 END AS swirl,
         CASE trim(regexp_replace(batch_source, '\\s+', ' ', 'g'))
              WHEN '100% liquid milk' THEN 0 WHEN '100% powder' THEN 1
              WHEN '50% liquid milk + 50% powder' THEN 2 END AS batch_source,
         CASE WHEN result_grade = 'A' THEN 1 ELSE 0 END AS label
  FROM readings
  WHERE product = 'Brand#13' AND test_code IN ('A') AND method IS NOT NULL AND feed_flow IS NOT NULL
    AND batch_source IS NOT NULL AND swirl IS NOT NULL AND result_grade IS DISTINCT FROM '#')""",
    "t5": """lab AS (
  SELECT * EXCLUDE (product, order_no, batch_source, method, result_int, result_dbl, result_flow,
                    result_grade, result_code, result_foam, swirl),
         CASE swirl WHEN 'SW6' THEN 0 WHEN 'SW5' THEN 1 END AS swirl,
         CASE WHEN CAST(result_dbl AS DOUBLE) BETWEEN 0.49 AND 0.51 THEN 1 ELSE 0 END AS label
  FROM readings
  WHERE product = 'Brand#13' AND test_code IN ('N') AND feed_flow IS NOT NULL)""",
    "t6": """lab AS (
  SELECT * EXCLUDE (product, order_no, batch_source, method, result_int, result_dbl, result_flow,
                    result_grade, result_code, result_foam, swirl),
         CASE swirl WHEN 'SW6' THEN 0 WHEN 'SW5' THEN 1 END AS swirl,
         CASE WHEN result_grade IN ('A+', 'A-') THEN 1 ELSE 0 END AS label
  FROM readings
  WHERE product = 'Brand#13' AND test_code IN ('R') AND feed_flow IS NOT NULL)""",
}


def with_readings(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((READINGS_CTE,) + ctes) + "\n" + body


def with_lab(target: str, body: str, *ctes: str) -> str:
    return with_readings(body, LAB_CTES[target], *ctes)


def with_scored(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((SCORED_CTE,) + ctes) + "\n" + body


def melt_sql(src: str, variables: list[str], ids: list[str] = (), text: bool = False) -> str:
    """UNION ALL melt: (ids..., variable, value) with TRY_CAST to DOUBLE (or text)."""
    idc = "".join(f"{i}, " for i in ids)
    cast = "VARCHAR" if text else "DOUBLE"
    parts = [f"SELECT {idc}'{v}' AS variable, TRY_CAST({v} AS {cast}) AS value FROM {src}" for v in variables]
    return "\nUNION ALL ".join(parts)


def numeric_statistics_sql(src_ctes: tuple[str, ...], src: str, variables: list[str], wrap) -> str:
    names = " UNION ALL ".join(f"SELECT '{v}' AS variable" for v in variables)
    body = f"""SELECT n.variable,
       CAST(coalesce(s.unique_count, 0) AS BIGINT) AS unique_count,
       round(s.mn, 2) AS "min", round(s.mx, 2) AS "max", round(s.mean, 2) AS mean,
       round(s.med, 2) AS median, round(mo.value, 2) AS "mode",
       round(s.sd, 2) AS sd, round(s.vr, 2) AS var
FROM ({names}) n
LEFT JOIN (SELECT variable, count(DISTINCT value) AS unique_count, min(value) AS mn, max(value) AS mx,
                  avg(value) AS mean, quantile_cont(value, 0.5) AS med,
                  stddev_samp(value) AS sd, var_samp(value) AS vr
           FROM v GROUP BY variable) s ON s.variable = n.variable
LEFT JOIN (SELECT variable, value FROM (
             SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY count(*) DESC, value) AS rn
             FROM v GROUP BY variable, value) WHERE rn = 1) mo ON mo.variable = n.variable"""
    melt = f"v AS (SELECT * FROM ({melt_sql(src, variables)}) WHERE value IS NOT NULL AND NOT isnan(value))"
    return wrap(body, *src_ctes, melt)
