"""The views of ``sources.tables`` as plain SQL, used by the SQL twins of the jobs."""

VIEWS = """
lottery AS (
  SELECT DISTINCT cast(substr(o_orderpriority,1,1) AS int) AS lottery_id, o_orderpriority AS code,
         1 AS min_number, 45 AS max_number, 4 AS numbers_to_select, 1 AS super_min, 16 AS super_max
  FROM orders),
draws AS (
  SELECT cast(substr(o_orderpriority,1,1) AS int) AS lottery_id, o_orderkey AS draw_number,
         cast(o_orderdate AS date) AS draw_date,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS jackpot,
         CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 10 END AS winners,
         cast(o_custkey % 16 + 1 AS int) AS super_number, o_orderkey % 50 = 49 AS is_deleted
  FROM orders),
members AS (
  SELECT l_orderkey AS draw_number, cast(l_partkey % 45 + 1 AS int) AS number,
         min(l_linenumber) AS line
  FROM lineitem GROUP BY 1, 2),
draw_numbers AS (
  SELECT d.lottery_id, d.draw_number, d.is_deleted, m.number,
         cast(row_number() OVER (PARTITION BY m.draw_number ORDER BY m.line, m.number) AS int) AS position
  FROM members m JOIN draws d ON d.draw_number = m.draw_number),
numbers AS (SELECT lottery_id, draw_number, position, number FROM draw_numbers WHERE NOT is_deleted),
baskets AS (
  SELECT *, row_number() OVER (PARTITION BY lottery_id ORDER BY draw_number) - 1 AS idx
  FROM draws
  WHERE NOT is_deleted AND draw_number IN (SELECT draw_number FROM members))
"""

RAW_DRAWS = """
tokens AS (
  SELECT o_orderkey, string_agg(cast(number AS varchar), ',' ORDER BY line, number) AS plain
  FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_linenumber AS line,
               cast(l_partkey % 45 + 1 AS int) AS number FROM lineitem)
  GROUP BY 1),
raw_base AS (
  SELECT cast(substr(o_orderpriority,1,1) AS int) AS lottery_id, o.o_orderkey AS k,
    CASE WHEN o.o_orderkey % 101 = 0 THEN 'abc' WHEN o.o_orderkey % 103 = 0 THEN '-5'
         ELSE cast(o.o_orderkey AS varchar) END AS draw_number,
    CASE WHEN o.o_orderkey % 97 = 0 THEN '2023-13-40' WHEN o.o_orderkey % 89 = 0 THEN '05/01/2024'
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS draw_date,
    CASE WHEN o.o_orderkey % 83 = 0 THEN concat_ws(',', plain, 'x')
         WHEN o.o_orderkey % 79 = 0 THEN concat_ws(',', plain, '99')
         WHEN o.o_orderkey % 73 = 0 THEN concat_ws(',', ' ', plain, '')
         ELSE coalesce(plain, '') END AS numbers,
    CASE WHEN o.o_orderkey % 71 = 0 THEN '17' WHEN o.o_orderkey % 67 = 0 THEN 'seven'
         WHEN o.o_orderkey % 5 = 0 THEN '' ELSE cast(o_custkey % 16 + 1 AS varchar) END AS super_number,
    CASE WHEN o.o_orderkey % 61 = 0 THEN 'not-a-decimal' WHEN o_orderstatus = 'P' THEN ''
         ELSE cast(cast(o_totalprice AS decimal(18,2)) AS varchar) END AS jackpot,
    CASE WHEN o.o_orderkey % 59 = 0 THEN '-5' WHEN o_custkey % 3 = 0 THEN ' '
         ELSE cast(o_custkey % 10 AS varchar) END AS winners
  FROM orders o LEFT JOIN tokens t ON t.o_orderkey = o.o_orderkey),
raw_draws AS (
  SELECT lottery_id, k * 2 + c AS row_number, draw_number, draw_date, numbers, super_number, jackpot, winners
  FROM raw_base, (VALUES (2), (3)) v(c) WHERE c = 2 OR k % 53 = 0)
"""


def with_views(body: str) -> str:
    """Prefix ``body`` (a SELECT, or ``name AS (...), ... SELECT``) with the shared views."""
    views = VIEWS.strip() + (",\n" + RAW_DRAWS.strip() if "raw_draws" in body else "")
    body = body.strip()
    if body.split(maxsplit=1)[0].upper() == "SELECT":
        return f"WITH {views}\n{body}"
    return f"WITH {views},\n{body}"
