"""DuckDB text of the fixture views (FIXTURES.md), used as CTEs by the oracle SQL.

The five strikes and two option types are generated with ``unnest`` (a fixed
fan-out per row, like the Spark side's ``explode``) rather than joins.
"""

SECURITY_PRICE_CTE = """
fx_o AS (SELECT CAST(o_orderdate AS DATE) AS date, MAX(o_totalprice)/100 AS px,
  MIN(o_custkey % 20) AS lo, MAX(o_custkey % 20) AS hi, COUNT(*) AS n FROM orders GROUP BY 1),
fx_u AS (SELECT CAST(200000 + l_suppkey AS INTEGER) AS securityid, CAST(l_shipdate AS DATE) AS date,
  CAST(500 + CAST(SUM(l_quantity) AS BIGINT) % 40 AS DOUBLE) AS px FROM lineitem GROUP BY 1, 2),
security_price AS (
SELECT 108105 AS securityid, date, px AS closeprice, px - CAST(1 AS DOUBLE) AS bidlow, px + CAST(1 AS DOUBLE) AS askhigh FROM fx_o
UNION ALL SELECT 117801, date, CAST(NULL AS DOUBLE), CASE WHEN date >= DATE '2001-06-01' AND day(date) = 23 THEN CAST(0 AS DOUBLE) ELSE CAST(10 AS DOUBLE)+lo END,
  CASE WHEN date >= DATE '2001-06-01' AND day(date) = 23 THEN CAST(0 AS DOUBLE) WHEN date < DATE '2001-06-01' OR day(date) <> 24 THEN CAST(12 AS DOUBLE)+hi END FROM fx_o
UNION ALL SELECT 152892, date, CAST(NULL AS DOUBLE), CAST(80 AS DOUBLE)+lo+hi, CAST(90 AS DOUBLE)+2*hi FROM fx_o
UNION ALL SELECT 145764, date, CAST(NULL AS DOUBLE), CAST(20 AS DOUBLE)+lo, CAST(22 AS DOUBLE)+hi+n FROM fx_o
UNION ALL SELECT securityid, date, px, px - CAST(1 AS DOUBLE), px + CAST(1 AS DOUBLE) FROM fx_u
UNION ALL SELECT 300000, date, px, px - CAST(1 AS DOUBLE), px + CAST(1 AS DOUBLE) FROM fx_u WHERE securityid = 200001
UNION ALL SELECT 300000, date, px + CAST(1 AS DOUBLE), px, px + CAST(2 AS DOUBLE) FROM fx_u WHERE securityid = 200001 AND day(date) = 27)"""

SECURITY_PRICE_GAPPY_CTE = """
security_price_gappy AS (
SELECT securityid, date, closeprice, bidlow,
  CASE WHEN securityid = 145764 AND day(date) = 17 THEN NULL ELSE askhigh END AS askhigh
FROM security_price
WHERE NOT (securityid = 152892 AND day(date) = 13) AND NOT (securityid = 145764 AND day(date) = 5))"""

OPTION_PRICE_CTE = """
fx_s AS (SELECT securityid, date, closeprice AS px, CAST(FLOOR(closeprice/25) AS BIGINT)*25 AS ctr,
   LEAD(date,1) OVER w AS d1, LEAD(date,2) OVER w AS d2, LEAD(closeprice,1) OVER w AS px1
   FROM security_price WHERE securityid = 108105 OR securityid BETWEEN 200000 AND 299999
   WINDOW w AS (PARTITION BY securityid ORDER BY date)),
fx_sk AS (SELECT *, unnest([-2, -1, 0, 1, 2]) AS k FROM fx_s),
fx_skc AS (SELECT *, unnest(['C', 'P']) AS cp FROM fx_sk),
fx_q0 AS (
  SELECT securityid, 0 AS kind, cp, (ctr+25*k)*1000 AS strike, date, d1 AS expiration, px, CAST(4 AS DOUBLE)+ABS(k) AS tv FROM fx_skc WHERE d1 IS NOT NULL
  UNION ALL SELECT securityid, 1, cp, (ctr+25*k)*1000, date, d2, px, CAST(7 AS DOUBLE)+ABS(k) FROM fx_skc WHERE d2 IS NOT NULL
  UNION ALL SELECT securityid, 2, cp, (ctr+25*k)*1000, d1, d1, px1, CAST(0.5 AS DOUBLE) FROM fx_skc WHERE d1 IS NOT NULL),
fx_q AS (SELECT *, unnest(range(CASE WHEN securityid <> 108105 AND day(date) = 13 THEN 2 ELSE 1 END)) AS copy FROM fx_q0
  WHERE securityid = 108105 OR NOT ((kind = 2 AND day(date) = 7) OR (cp = 'P' AND day(date) = 11))),
fx_p AS (SELECT *, GREATEST(CASE WHEN cp='C' THEN px-strike/CAST(1000 AS DOUBLE) ELSE strike/CAST(1000 AS DOUBLE)-px END, CAST(0 AS DOUBLE))+tv AS mid,
  securityid <> 108105 AND kind < 2 AND day(date) = 19 AS free FROM fx_q),
option_price AS (
SELECT securityid, cp AS callput, strike, date, expiration,
  CASE WHEN free THEN CAST(0 AS DOUBLE) ELSE mid - CAST(0.25 AS DOUBLE) END AS bestbid,
  CASE WHEN free THEN CAST(0 AS DOUBLE) ELSE mid + CAST(0.25 AS DOUBLE) END AS bestoffer FROM fx_p)"""


def with_fixtures(body_ctes: str, final: str, gappy: bool = False) -> str:
    """Assemble ``WITH <fixture views>, <body ctes> <final select>``."""
    parts = [SECURITY_PRICE_CTE, OPTION_PRICE_CTE]
    if gappy:
        parts.append(SECURITY_PRICE_GAPPY_CTE)
    ctes = ",".join(parts)
    if body_ctes.strip():
        ctes += ",\n" + body_ctes
    return f"WITH {ctes}\n{final}"
