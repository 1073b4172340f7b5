"""DuckDB statements that compute every registered query independently of Spark.

``statement`` puts the needed common table expressions in front of a query, so each result is
one self-contained statement over the raw tables.
"""

from __future__ import annotations

import re

BRAND = "CAST(substr(p_brand, 7) AS INT)"
CODE_NUM = "CAST(substr(offense_code, 7) AS INT)"
MONTH_ID = "o_custkey * 1000 + (year(o_orderdate) - 1995) * 12 + month(o_orderdate)"

PARTS = {
    "agencies": """
        SELECT c_custkey AS agency_id, c_name AS pub_agency_name, c_mktsegment AS agency_type_name,
          n_name AS county_name, r_name AS state_abbr, c_nationkey * 1000 + 500 AS population,
          'ORI' || c_custkey AS legacy_ori,
          CASE WHEN c_custkey % 10 = 0 THEN 'ORI' || (c_custkey + 1) END AS covered_by_legacy_ori,
          'Submitting ' || n_name AS submitting_agency_name,
          CASE c_custkey % 3 WHEN 0 THEN 'Cities' WHEN 1 THEN 'Counties' ELSE 'State' END AS population_group_desc,
          CASE WHEN c_custkey % 2 = 0 THEN 'All places' END AS parent_pop_group_desc,
          CAST(y.data_year AS INT) AS data_year
        FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey,
          (SELECT DISTINCT year(o_orderdate) AS data_year FROM orders) y""",
    "nibrs_incident": f"""
        SELECT o_orderkey AS incident_id, o_custkey AS agency_id, o_orderdate AS incident_date,
          CAST(year(o_orderdate) AS INT) AS data_year, {MONTH_ID} AS nibrs_month_id, {MONTH_ID} AS did,
          CASE WHEN o_orderstatus = 'F' THEN CAST(left(o_orderpriority, 1) AS INT) ELSE 6 END
            AS cleared_except_id, o_orderdate + INTERVAL 45 DAY AS submission_date
        FROM orders""",
    "nibrs_month": f"""
        SELECT DISTINCT {MONTH_ID} AS nibrs_month_id, {MONTH_ID} AS did, o_custkey AS agency_id,
          CAST(year(o_orderdate) AS INT) AS data_year, CAST(month(o_orderdate) AS INT) AS month_num,
          CASE WHEN count(*) OVER (PARTITION BY {MONTH_ID}) > 1 THEN 'I' ELSE 'Z' END AS reported_status
        FROM orders""",
    "nibrs_offense": f"""
        SELECT DISTINCT l_orderkey * 100 + {BRAND} AS offense_id, l_orderkey AS incident_id,
          p_brand AS offense_code,
          CASE WHEN (l_orderkey + {BRAND}) % 10 = 0 THEN 'A' ELSE 'C' END AS attempt_complete_flag,
          (l_orderkey + {BRAND}) % 7 AS location_id
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "nibrs_offense_type": f"""
        SELECT DISTINCT p_brand AS offense_code, 'Offense ' || p_brand AS offense_name,
          CASE {BRAND} % 3 WHEN 0 THEN 'Person' WHEN 1 THEN 'Property' ELSE 'Society' END AS crime_against,
          'Category ' || ({BRAND} % 5) AS offense_category_name
        FROM part""",
    "nibrs_arrestee": f"""
        SELECT l_orderkey AS incident_id,
          CASE WHEN l_linestatus = 'F' THEN p_brand ELSE 'Brand#' || ({BRAND} % 25 + 1) END AS offense_code,
          l_shipdate AS arrest_date, CASE WHEN l_linenumber = 1 THEN 'M' ELSE 'N' END AS multiple_indicator,
          CAST(floor(l_quantity) AS INT) % 5 AS race_id
        FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'""",
    "nibrs_cleared_except": """
        SELECT * FROM (VALUES (1, 'A', 'Death of Offender'), (2, 'B', 'Prosecution Declined'),
          (3, 'C', 'In Custody of Other Jurisdiction'), (4, 'D', 'Victim Refused to Cooperate'),
          (5, 'E', 'Juvenile/No Custody'), (6, 'N', 'Not Applicable'))
          AS t(cleared_except_id, cleared_except_code, cleared_except_name)""",
    "nibrs_location_type": """
        SELECT DISTINCT l_orderkey % 7 AS location_id, 'L' || (l_orderkey % 7) AS location_code,
          'Location ' || (l_orderkey % 7) AS location_name
        FROM lineitem""",
    "nibrs_victim": """
        SELECT l_orderkey * 1000 + nth AS victim_id, l_orderkey AS incident_id,
          n_regionkey AS race_id, s_nationkey AS ethnicity_id, l_suppkey % 100 AS age_id,
          CAST(l_suppkey % 100 AS SMALLINT) AS age_num
        FROM order_suppliers JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey""",
    "order_suppliers": """
        SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS nth
        FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A')""",
    "nibrs_offender": """
        SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS offender_id,
          l_orderkey AS incident_id, l_partkey % 5 AS race_id
        FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'N')""",
    "nibrs_victim_offense": f"""
        SELECT DISTINCT s.l_orderkey * 1000 + s.nth AS victim_id, s.l_orderkey * 100 + {BRAND} AS offense_id
        FROM lineitem l JOIN order_suppliers s ON s.l_orderkey = l.l_orderkey AND s.l_suppkey = l.l_suppkey
          JOIN part ON p_partkey = l.l_partkey WHERE l.l_returnflag = 'A'""",
    "ref_race": "SELECT r_regionkey AS race_id, r_name AS race_code FROM region",
    "nibrs_ethnicity": "SELECT n_nationkey AS ethnicity_id, n_name AS ethnicity_code FROM nation",
    "nibrs_age": "SELECT DISTINCT l_suppkey % 100 AS age_id, 'A' || (l_suppkey % 100) AS age_code FROM lineitem",
    "acs_rows": """
        SELECT 'Census Tract ' || (7000 + c_custkey) || CASE WHEN c_custkey % 2 = 0 THEN '.01' ELSE '' END
            || ', ' || n_name || ', ' || r_name AS NAME,
          CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS DP03_0062E,
          CAST(CAST(floor(c_acctbal * 2) AS BIGINT) AS VARCHAR) AS DP03_0063E,
          CAST(CAST(floor(c_acctbal / 2) AS BIGINT) AS VARCHAR) AS DP03_0066E,
          CAST(CAST(floor(c_acctbal * 3) AS BIGINT) AS VARCHAR) AS DP03_0067E,
          CAST(r_regionkey AS VARCHAR) AS state, CAST(n_nationkey AS VARCHAR) AS county,
          CAST(7000 + c_custkey AS VARCHAR) AS tract
        FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "features": """
        SELECT (7000 + s_suppkey) || CASE WHEN s_suppkey % 2 = 0 THEN '.01' ELSE '.00' END AS GEODESC,
          CAST(24000 + s_nationkey AS VARCHAR) AS CNTY2010, s_name AS place,
          '{"type":"Point","coordinates":[' || s_suppkey || ',' || s_nationkey || ']}' AS geometry
        FROM supplier""",
    "income": """
        SELECT CASE WHEN contains(number, '.') THEN number ELSE number || '.00' END AS TRACT,
          NAME AS "Census Tract", CAST(DP03_0062E AS BIGINT) AS "Median Income",
          DP03_0063E AS "Mean Income", CAST(DP03_0066E AS BIGINT) AS "10th Percentile Income",
          CAST(DP03_0067E AS BIGINT) AS "90th Percentile Income"
        FROM (SELECT *, regexp_extract(NAME, '^[^,]* ([^ ,]+)', 1) AS number FROM acs_rows)""",
    "placed": """
        SELECT i.incident_id, o.offense_id, i.incident_date, i.cleared_except_id, o.offense_code,
          n.offense_name, o.attempt_complete_flag, a.agency_id, a.pub_agency_name, a.agency_type_name,
          a.county_name, a.population, a.state_abbr, i.data_year, i.submission_date, a.submitting_agency_name,
          a.population_group_desc, a.parent_pop_group_desc
        FROM nibrs_offense o JOIN nibrs_offense_type n USING (offense_code)
          JOIN nibrs_incident i USING (incident_id)
          JOIN agencies a ON a.agency_id = i.agency_id AND a.data_year = i.data_year""",
    "per_incident": """
        SELECT incident_id, incident_date, submission_date, cleared_except_id, pub_agency_name, agency_type_name,
          submitting_agency_name, county_name, population_group_desc, parent_pop_group_desc, population,
          count(*) AS offenses_count,
          string_agg(offense_name, ',,,,, ' ORDER BY offense_name) AS offenses
        FROM placed GROUP BY ALL""",
    "hits": """
        SELECT p.incident_id, p.county_name, p.state_abbr, p.data_year, p.offense_name,
          p.cleared_except_id, count(*) AS count_arrests
        FROM nibrs_arrestee r JOIN placed p USING (incident_id, offense_code) GROUP BY ALL""",
    "month_incidents": """
        SELECT i.* FROM nibrs_month m JOIN agencies a ON a.agency_id = m.agency_id AND a.data_year = m.data_year
          JOIN nibrs_incident i ON i.nibrs_month_id = m.nibrs_month_id
        WHERE m.data_year = 1996 AND a.state_abbr = 'ASIA'""",
}

REASONS = {
    1: "death_offender",
    2: "prosecution_declined",
    3: "custody_elsewhere",
    4: "victim_uncooperative",
    5: "juvenile_release",
}
REASON_COUNTS = ", ".join(
    f"count(*) FILTER (cleared_except_id = {k}) AS clearances_exceptional_{name}" for k, name in REASONS.items()
)
REASON_NAMES = ", ".join(f"clearances_exceptional_{name}" for name in REASONS.values())
REASON_SUMS = ", ".join(
    f"CAST(sum(clearances_exceptional_{name}) AS BIGINT) AS clearances_exceptional_{name}" for name in REASONS.values()
)


def rounded(part: str, whole: str) -> str:
    """Hundredths of a percent, half up, in whole numbers."""
    return f"((20000 * ({part}) + ({whole})) // (2 * ({whole})))"


def clearances(keys: str) -> str:
    """Counts per group of the placed offenses, with the arrests of incidents not excepted."""
    return f"""
      (SELECT {keys}, offense_count, coalesce(normal, 0) AS clearances_normal,
         CAST(coalesce(arrests, 0) AS BIGINT) AS arrests, exceptional AS clearances_exceptional_total,
         {REASON_NAMES}
       FROM (SELECT {keys}, count(*) AS offense_count,
               count(*) FILTER (cleared_except_id BETWEEN 1 AND 5) AS exceptional, {REASON_COUNTS}
             FROM placed GROUP BY ALL)
       LEFT JOIN (SELECT {keys}, count(*) AS normal, sum(count_arrests) AS arrests
                  FROM hits WHERE cleared_except_id = 6 GROUP BY ALL) USING ({keys}))"""


def rates(keys: str, source: str) -> str:
    total = "clearances_normal + clearances_exceptional_total"
    return f"""
      SELECT {keys}, offense_count, {total} AS clearances_total,
        CAST({rounded(total, "offense_count")} AS DOUBLE) / 100 AS clearance_ratio_total_percent,
        CAST({rounded("clearances_normal", "offense_count")} AS DOUBLE) / 100
          AS clearance_ratio_normal_percent,
        CAST({rounded("clearances_exceptional_total", "offense_count")} AS DOUBLE) / 100
          AS clearance_ratio_exceptional_percent,
        clearances_normal, clearances_exceptional_total, arrests, {REASON_NAMES}
      FROM {source}"""


def unmatched(matched: str) -> str:
    return f"""(SELECT r.* FROM nibrs_arrestee r
      WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.incident_id = r.incident_id AND {matched}))"""


def by_agency(matched: str) -> str:
    return f"""
      SELECT pub_agency_name, offense_code, offense_name, arrests FROM (
        SELECT agency_id, pub_agency_name, u.offense_code, max(offense_name) AS offense_name,
          count(*) AS arrests
        FROM {unmatched(matched)} u JOIN nibrs_incident USING (incident_id)
          JOIN agencies USING (agency_id, data_year) JOIN nibrs_offense_type n ON n.offense_code = u.offense_code
        GROUP BY ALL)"""


LANDED = """
    SELECT CAST(year(o_orderdate) AS INT) AS data_year, o_custkey AS agency_id, o_orderkey AS incident_id,
      o_custkey * 1000 + (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS nibrs_month_id,
      o_orderdate + INTERVAL 45 DAY AS submission_date,
      CASE WHEN o_orderkey % 2 = 0 THEN 'R' END AS report_date_flag,
      CAST(CASE WHEN o_orderstatus = 'F' THEN left(o_orderpriority, 1) ELSE '6' END AS SMALLINT) AS cleared_except_id,
      CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 90 MINUTE END AS cleared_except_date,
      'C' AS data_home, 'F' AS orig_format, o_orderkey * 10 AS did,
      CASE o_orderkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN '' END AS cargo_theft_flag,
      o_orderdate AS incident_date, CAST(o_orderkey % 24 AS SMALLINT) AS incident_hour,
      CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN 'status "' || o_orderstatus || '", checked'
        END AS incident_status
    FROM orders"""

AGE_TEXT = """CASE l_suppkey % 50 WHEN 0 THEN 'NS' WHEN 1 THEN 'NN' WHEN 2 THEN 'NB' WHEN 3 THEN 'BB'
    ELSE CAST(l_suppkey % 50 AS VARCHAR) END"""


def demographic(codes: str, key: str, column: str) -> str:
    return f"""
      SELECT offense_name, {column}, people, cleared,
        CAST({rounded("cleared", "people")} AS DOUBLE) / 100 AS cleared_percent
      FROM (SELECT n.offense_name, c.{column}, count(*) AS people,
              count(*) FILTER (i.cleared_except_id <> 6 OR r.incident_id IS NOT NULL) AS cleared
            FROM nibrs_victim_offense vo JOIN nibrs_victim v USING (victim_id)
              JOIN nibrs_offense o USING (offense_id) JOIN nibrs_incident i ON i.incident_id = o.incident_id
              JOIN nibrs_offense_type n ON n.offense_code = o.offense_code JOIN {codes} c USING ({key})
              LEFT JOIN (SELECT DISTINCT incident_id, offense_code FROM nibrs_arrestee) r
                ON r.incident_id = o.incident_id AND r.offense_code = o.offense_code
            GROUP BY ALL)"""


def offender_clearance() -> str:
    """Offenders are tied to every offense of their incident."""
    return f"""
      SELECT offense_name, race_code, people, cleared,
        CAST({rounded("cleared", "people")} AS DOUBLE) / 100 AS cleared_percent
      FROM (SELECT n.offense_name, c.race_code, count(*) AS people,
              count(*) FILTER (i.cleared_except_id <> 6 OR r.incident_id IS NOT NULL) AS cleared
            FROM nibrs_offender v JOIN nibrs_offense o ON o.incident_id = v.incident_id
              JOIN nibrs_incident i ON i.incident_id = o.incident_id
              JOIN nibrs_offense_type n ON n.offense_code = o.offense_code JOIN ref_race c USING (race_id)
              LEFT JOIN (SELECT DISTINCT incident_id, offense_code FROM nibrs_arrestee) r
                ON r.incident_id = o.incident_id AND r.offense_code = o.offense_code
            GROUP BY ALL)"""


def violations(source: str, conditions: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, count(*) AS violations FROM {source} WHERE {condition}"
        for name, condition in conditions.items()
    )


KEPT = {
    "nibrs_month": "nibrs_month WHERE data_year <> 1996",
    "nibrs_incident": "nibrs_incident WHERE did NOT IN (SELECT did FROM nibrs_month WHERE data_year = 1996)",
}
GONE = "(SELECT incident_id FROM nibrs_incident JOIN nibrs_month m USING (did) WHERE m.data_year = 1996)"
for _name in ("nibrs_offense", "nibrs_arrestee", "nibrs_victim"):
    KEPT[_name] = f"{_name} WHERE incident_id NOT IN {GONE}"
KEPT["nibrs_victim_offense"] = f"""nibrs_victim_offense
    WHERE victim_id IN (SELECT victim_id FROM nibrs_victim WHERE incident_id NOT IN {GONE})
      AND offense_id IN (SELECT offense_id FROM nibrs_offense WHERE incident_id NOT IN {GONE})"""

# The declared checks of the columns that the star tables have, as table, kind of check, columns
# and limit, codes or parent. References bear the name of the parent's key.
CHECKS = """
agencies primary_key agency_id,data_year
agencies not_null agency_id
agencies not_null data_year
agencies length pub_agency_name 100
agencies length agency_type_name 100
agencies length county_name 100
agencies length state_abbr 2
agencies length legacy_ori 25
agencies length covered_by_legacy_ori 25
agencies length submitting_agency_name 200
agencies length population_group_desc 100
agencies length parent_pop_group_desc 100
nibrs_incident primary_key incident_id
nibrs_incident not_null incident_id
nibrs_incident not_null agency_id
nibrs_incident not_null nibrs_month_id
nibrs_incident not_null cleared_except_id
nibrs_month primary_key did
nibrs_month not_null nibrs_month_id
nibrs_month not_null did
nibrs_month not_null agency_id
nibrs_month not_null month_num
nibrs_month length reported_status 10
nibrs_month domain reported_status I,Z,U
nibrs_offense primary_key offense_id
nibrs_offense not_null offense_id
nibrs_offense not_null incident_id
nibrs_offense not_null offense_code
nibrs_offense not_null location_id
nibrs_offense length offense_code 5
nibrs_offense length attempt_complete_flag 1
nibrs_offense domain attempt_complete_flag A,C
nibrs_offense row_limit incident_id 10
nibrs_offense_type primary_key offense_code
nibrs_offense_type not_null offense_code
nibrs_offense_type length offense_code 5
nibrs_offense_type length offense_name 100
nibrs_offense_type length crime_against 100
nibrs_offense_type length offense_category_name 100
nibrs_arrestee not_null incident_id
nibrs_arrestee not_null offense_code
nibrs_arrestee not_null race_id
nibrs_arrestee length offense_code 5
nibrs_arrestee length multiple_indicator 1
nibrs_cleared_except primary_key cleared_except_id
nibrs_cleared_except not_null cleared_except_id
nibrs_cleared_except length cleared_except_code 1
nibrs_cleared_except length cleared_except_name 100
nibrs_location_type primary_key location_id
nibrs_location_type not_null location_id
nibrs_location_type length location_code 2
nibrs_location_type length location_name 100
nibrs_victim primary_key victim_id
nibrs_victim not_null victim_id
nibrs_victim not_null incident_id
nibrs_victim row_limit incident_id 999
nibrs_victim_offense primary_key victim_id,offense_id
nibrs_victim_offense not_null victim_id
nibrs_victim_offense not_null offense_id
nibrs_offender primary_key offender_id
nibrs_offender not_null offender_id
nibrs_offender not_null incident_id
nibrs_offender row_limit incident_id 99
ref_race primary_key race_id
ref_race not_null race_id
ref_race not_null race_code
ref_race length race_code 2
nibrs_ethnicity primary_key ethnicity_id
nibrs_ethnicity not_null ethnicity_id
nibrs_ethnicity length ethnicity_code 1
nibrs_age primary_key age_id
nibrs_age not_null age_id
nibrs_age length age_code 2
nibrs_month foreign_key agency_id,data_year agencies
nibrs_incident foreign_key agency_id,data_year agencies
nibrs_incident foreign_key cleared_except_id nibrs_cleared_except
nibrs_incident foreign_key did nibrs_month
nibrs_offender foreign_key incident_id nibrs_incident
nibrs_offender foreign_key race_id ref_race
nibrs_offense foreign_key incident_id nibrs_incident
nibrs_offense foreign_key offense_code nibrs_offense_type
nibrs_offense foreign_key location_id nibrs_location_type
nibrs_arrestee foreign_key incident_id nibrs_incident
nibrs_arrestee foreign_key offense_code nibrs_offense_type
nibrs_arrestee foreign_key race_id ref_race
nibrs_victim foreign_key incident_id nibrs_incident
nibrs_victim foreign_key age_id nibrs_age
nibrs_victim foreign_key race_id ref_race
nibrs_victim foreign_key ethnicity_id nibrs_ethnicity
nibrs_victim_offense foreign_key victim_id nibrs_victim
nibrs_victim_offense foreign_key offense_id nibrs_offense
"""


def report() -> str:
    """One row for each of ``CHECKS``."""
    parts = []
    for check in CHECKS.strip().splitlines():
        table, kind, columns, limit = (check.split() + [""])[:4]
        listed = columns.replace(",", ", ")
        grouped = f"SELECT 1 FROM {table} GROUP BY {listed} HAVING count(*)"
        codes = ", ".join(f"'{code}'" for code in limit.split(","))
        first = columns.split(",")[0]
        count = {
            "primary_key": f"SELECT count(*) FROM ({grouped} > 1)",
            "not_null": f"SELECT count(*) FROM {table} WHERE {columns} IS NULL",
            "length": f"SELECT count(*) FROM {table} WHERE length(rtrim({columns})) > {limit}",
            "domain": f"SELECT count(*) FROM {table} WHERE {columns} NOT IN ({codes})",
            "row_limit": f"SELECT count(*) FROM ({grouped} > {limit})",
            "foreign_key": f"SELECT count(*) FROM {table} ANTI JOIN {limit} USING ({listed}) WHERE {first} IS NOT NULL",
        }[kind]
        detail = f"{columns}->{limit}" if kind == "foreign_key" else columns
        parts.append(
            f"SELECT '{table}' AS table_name, '{kind}' AS check_name, '{detail}' AS detail, "
            f"CAST(({count}) AS BIGINT) AS violations"
        )
    return " UNION ALL ".join(parts)


MANIFEST = """
    SELECT c_custkey, c_name AS name, 'relational_database' AS type, r_name AS source,
      '2023-01-01' AS date_added, strftime(DATE '2023-01-01' + CAST(c_custkey % 400 AS INT), '%Y-%m-%d')
        AS last_fetched, '/data/' || c_name || '.csv' AS path,
      CASE WHEN c_custkey % 2 = 0 THEN 'annual' ELSE 'monthly' END AS ttl, '' AS key_column,
      c_mktsegment AS description, n_name
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""

SURVIVAL = """
    SELECT offense_name, days, CAST(sum(ended) OVER (PARTITION BY offense_name ORDER BY days DESC) AS BIGINT) AS at_risk,
      arrested, ended - arrested AS still_open
    FROM (
      SELECT offense_name, CAST(greatest(date_diff('day', begun, coalesce(arrested_at, DATE '1998-06-30')), 0) AS INT) AS days,
        count(arrested_at) AS arrested, count(*) AS ended
      FROM (SELECT o.incident_id, n.offense_name, CAST(i.incident_date AS DATE) AS begun,
              (SELECT min(CAST(r.arrest_date AS DATE)) FROM nibrs_arrestee r WHERE r.incident_id = o.incident_id
                 AND r.offense_code = o.offense_code AND CAST(r.arrest_date AS DATE) <= DATE '1998-06-30') AS arrested_at
            FROM (SELECT DISTINCT incident_id, offense_code FROM nibrs_offense) o JOIN nibrs_incident i USING (incident_id)
              JOIN nibrs_offense_type n USING (offense_code)
            WHERE CAST(i.incident_date AS DATE) <= DATE '1998-06-30')
      GROUP BY ALL)"""

QUERIES = {
    "csv_roundtrip": LANDED,
    "csv_encoding": f"SELECT * REPLACE ('Clôturé ' || (incident_id % 10) AS incident_status) FROM ({LANDED})",
    "header_drift": f"""
        SELECT kind, CAST(position AS INT) AS position, declared_name, header_name, filled_rows FROM (
          SELECT 'renamed' AS kind, 5 AS position, 'cargo_theft_flag' AS declared_name, 'cargo_flag' AS header_name,
            count(cargo_theft_flag) FILTER ((incident_id // 4) % 4 = 1) AS filled_rows FROM ({LANDED})
          UNION ALL SELECT 'renamed', 12, 'incident_status', 'status',
            count(incident_status) FILTER ((incident_id // 4) % 4 = 1) FROM ({LANDED})
          UNION ALL SELECT 'surplus', 16, NULL, 'note',
            count(*) FILTER ((incident_id // 4) % 4 = 2 AND incident_id % 5 = 0) FROM ({LANDED})
          UNION ALL SELECT 'short', 15, 'did', NULL, 0)""",
    "manifest_tags": f"""
        SELECT name, type, source, date_added, last_fetched, path, ttl, key_column, description,
          tag_key, tag_value
        FROM ({MANIFEST}) LEFT JOIN (
          SELECT c_custkey, 'county' AS tag_key, n_name AS tag_value FROM ({MANIFEST}) WHERE c_custkey % 3 < 2
          UNION ALL SELECT c_custkey, 'segment', description FROM ({MANIFEST}) WHERE c_custkey % 3 = 0)
          USING (c_custkey)""",
    "manifest_due": f"""
        SELECT name, source, last_fetched, ttl, strftime(next_fetch, '%Y-%m-%d') AS next_fetch
        FROM (SELECT *, CAST(CAST(last_fetched AS DATE) + CASE ttl WHEN 'annual' THEN INTERVAL 12 MONTH
          ELSE INTERVAL 1 MONTH END AS DATE) AS next_fetch FROM ({MANIFEST}))
        WHERE next_fetch < DATE '2024-01-01'""",
    "acs_rows_parse": "SELECT * FROM acs_rows",
    "acs_whole_documents": "SELECT * FROM acs_rows",
    "acs_county_rows": "SELECT * FROM acs_rows WHERE state = '3' AND county = '3'",
    "acs_tract_key": 'SELECT "Census Tract" AS NAME, TRACT FROM income',
    "acs_income": "SELECT * FROM income",
    "geo_features_scan": "SELECT GEODESC, CNTY2010, place, geometry FROM features",
    "geo_features_whole": "SELECT GEODESC, CNTY2010, place, geometry FROM features",
    "geo_county_tracts": "SELECT GEODESC AS TRACT, GEODESC, CNTY2010, geometry FROM features WHERE CNTY2010 = '24003'",
    "tract_income_join": """SELECT f.GEODESC, f.CNTY2010, f.geometry, i.*
        FROM features f JOIN income i ON i.TRACT = f.GEODESC""",
    "tract_value_layer": """SELECT f.GEODESC AS TRACT, f.geometry, i."Median Income"
        FROM features f LEFT JOIN income i ON i.TRACT = f.GEODESC""",
    "tract_features_json": """SELECT '{"type":"Feature","properties":{"TRACT":"' || i.TRACT || '","Median Income":'
        || i."Median Income" || '},"geometry":' || f.geometry || '}' AS feature
        FROM features f JOIN income i ON i.TRACT = f.GEODESC""",
    "yearly_append": LANDED,
    "incremental_drop_load": LANDED,
    "publish_summary": f"""
        SELECT *, 'orders' AS source, '2024-01-01' AS retrieved
        FROM ({rates("county_name, data_year, offense_name", clearances("county_name, data_year, offense_name"))})""",
    "publish_versions": f"""
        SELECT *, CASE data_year WHEN 1996 THEN 'orders again' ELSE 'orders' END AS source,
          CASE data_year WHEN 1996 THEN '2024-02-01' ELSE '2024-01-01' END AS retrieved
        FROM ({rates("county_name, data_year, offense_name", clearances("county_name, data_year, offense_name"))})""",
    "quarantine_load": """
        SELECT o_orderkey AS incident_id, CASE WHEN o_orderkey % 40 > 2 THEN CAST(year(o_orderdate) AS INT) END AS data_year,
          CASE WHEN o_orderkey % 40 > 2 THEN '' ELSE 'type or number of fields' END AS reason FROM orders""",
    "bucketed_clearance_rates": rates("county_name, offense_name", clearances("county_name, offense_name")),
    "bucketed_unmatched_arrests": f"""
        SELECT incident_id, offense_code, count(*) AS arrests FROM {unmatched('true')} GROUP BY ALL""",
    "incremental_clearances": rates(
        "county_name, data_year, offense_name", clearances("county_name, data_year, offense_name")
    ),
    "local_tract_match": r"""
        WITH known AS (
          SELECT NAME AS name, CAST(tract AS BIGINT) - 7000 AS o_custkey,
            CASE WHEN contains(number, '.') THEN number ELSE number || '.00' END AS TRACT
          FROM (SELECT *, regexp_extract(NAME, '^[^,]* ([^ ,]+)', 1) AS number FROM acs_rows)
        ), local AS (
          SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN name WHEN 1 THEN upper(name)
            WHEN 2 THEN replace(name, 'Census', 'Cencus') WHEN 3 THEN replace(name, ', ', ' / ')
            WHEN 4 THEN replace(name, 'Census Tract', 'Tract') WHEN 5 THEN replace(name, 'Census', 'Cesnus')
            WHEN 6 THEN replace(name, 'Tract ', 'Tract 9') END AS place
          FROM orders JOIN known USING (o_custkey)
        ), names AS (SELECT DISTINCT place AS name, NULL AS TRACT FROM local UNION ALL SELECT name, TRACT FROM known),
        read AS (
          SELECT name, TRACT, list_transform(regexp_extract_all(name, '\d+(?:\.\d+)?'), lambda n: regexp_replace(n, '\.0+$', ''))
            AS numbers, trim(regexp_replace(regexp_replace(lower(name), '\d+(?:\.\d+)?', ' ', 'g'), '[^\p{L}]+', ' ', 'g')) AS words
          FROM names
        ), pairs AS (
          SELECT a.name, k.TRACT, levenshtein(a.words, k.words) AS edits
          FROM read a JOIN read k ON a.TRACT IS NULL AND k.TRACT IS NOT NULL AND a.numbers = k.numbers
          WHERE levenshtein(a.words, k.words) <= least(2, length(a.words) // 5)
        ), best AS (
          SELECT name, edits, min(TRACT) AS TRACT, count(DISTINCT TRACT) AS rivals FROM pairs p
          WHERE edits = (SELECT min(edits) FROM pairs q WHERE q.name = p.name) GROUP BY ALL)
        SELECT o_orderkey, place, CASE WHEN rivals = 1 THEN TRACT END AS TRACT, CAST(edits AS INT) AS edits,
          CASE WHEN rivals IS NULL THEN 'none' WHEN rivals > 1 THEN 'ambiguous' WHEN edits = 0 THEN 'exact' ELSE 'near' END AS match
        FROM local LEFT JOIN best ON best.name = place""",
    "pk_violations": """SELECT l_orderkey, l_linenumber, count(*) AS rows_with_key FROM lineitem
        GROUP BY ALL HAVING count(*) > 1""",
    "fk_orphans": """SELECT incident_id, count(*) AS orphan_rows FROM nibrs_arrestee
        WHERE incident_id NOT IN (SELECT incident_id FROM nibrs_victim) GROUP BY ALL""",
    "null_violations": violations(
        "(SELECT o.offense_id, o.location_id, r.offense_code FROM nibrs_arrestee r "
        "LEFT JOIN nibrs_offense o USING (incident_id, offense_code))",
        {name: f"{name} IS NULL" for name in ("offense_id", "location_id", "offense_code")},
    ),
    "length_violations": violations(
        "placed",
        {
            f"{name}": f"length(rtrim({name})) > {limit}"
            for name, limit in {"offense_name": 15, "county_name": 8, "offense_code": 5}.items()
        },
    ),
    "type_violations": violations(
        f"(SELECT {AGE_TEXT} AS age_num, l_returnflag FROM lineitem)",
        {name: f"TRY_CAST({name} AS SMALLINT) IS NULL AND {name} IS NOT NULL" for name in ("age_num", "l_returnflag")},
    ),
    "domain_violations": violations(
        "lineitem", {"l_returnflag": "l_returnflag NOT IN ('A', 'N')", "l_linestatus": "l_linestatus NOT IN ('O')"}
    ),
    "cardinality_violations": """SELECT incident_id, count(*) AS child_rows FROM nibrs_offense
        GROUP BY ALL HAVING count(*) > 7""",
    "validation_report": report(),
    "age_recode": f"""
        SELECT l_orderkey, l_linenumber, l_suppkey, CAST(CASE age WHEN 'NS' THEN '-1' WHEN 'NN' THEN '-2'
          WHEN 'NB' THEN '-3' WHEN 'BB' THEN '-4' ELSE age END AS INT) AS age_num
        FROM (SELECT *, {AGE_TEXT} AS age FROM lineitem)""",
    "cascade_subset": f"SELECT victim_id, offense_id FROM {KEPT['nibrs_victim_offense']}",
    "cascade_stored": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS kept_rows FROM {kept}" for name, kept in KEPT.items()
    ),
    "cascade_counts": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS kept_rows FROM {kept}" for name, kept in KEPT.items()
    ),
    "point_lookup": "SELECT * FROM nibrs_arrestee WHERE offense_code = 'Brand#9'",
    "code_lookup": "SELECT * FROM nibrs_location_type",
    "arrests_filtered": """
        SELECT p.incident_id, p.county_name, p.offense_name, count(*) AS count_arrests
        FROM placed p JOIN nibrs_arrestee r USING (incident_id, offense_code)
        WHERE p.cleared_except_id <> 6 AND r.multiple_indicator = 'M' AND offense_code = 'Brand#13'
        GROUP BY ALL""",
    "victim_decode": """
        SELECT v.victim_id, v.incident_id, r.race_code, e.ethnicity_code
        FROM nibrs_victim v LEFT JOIN ref_race r USING (race_id) LEFT JOIN nibrs_ethnicity e USING (ethnicity_id)""",
    "incident_offenses": """
        SELECT incident_id, offense_id, incident_date, cleared_except_id, offense_code, offense_name,
          attempt_complete_flag, agency_id, pub_agency_name, agency_type_name, county_name, population,
          submission_date, submitting_agency_name, population_group_desc, parent_pop_group_desc
        FROM placed""",
    "incident_offenses_aggregated": "SELECT * FROM per_incident",
    "incident_offenses_single": "SELECT * FROM per_incident WHERE offenses_count = 1",
    "incident_offenses_multiple": "SELECT * FROM per_incident WHERE offenses_count > 1",
    "county_offenses": "SELECT offense_name, county_name, count(*) AS offense_count FROM placed GROUP BY ALL",
    "county_incident_arrests": """SELECT incident_id, county_name, offense_name, count_arrests
        FROM hits WHERE cleared_except_id = 6""",
    "county_arrests_agg": """
        SELECT county_name, offense_name, count(*) AS clearances_normal,
          CAST(sum(count_arrests) AS BIGINT) AS arrests
        FROM hits WHERE cleared_except_id = 6 GROUP BY ALL""",
    "county_exceptional_agg": f"""
        SELECT county_name, offense_name, {REASON_COUNTS}, count(*) AS clearances_exceptional_total
        FROM placed WHERE cleared_except_id IN (1, 2, 3, 4, 5) GROUP BY ALL""",
    "county_clearances_all": f"SELECT * FROM {clearances('county_name, offense_name')}",
    "county_clearance_rates": rates("county_name, offense_name", clearances("county_name, offense_name")),
    "state_county_clearance": rates(
        "state_abbr, county_name, offense_name", clearances("state_abbr, county_name, offense_name")
    ),
    "taxonomy_clearance": rates(
        "county_name, category",
        f"""(SELECT county_name, offense_category_name AS category, CAST(sum(offense_count) AS BIGINT) AS offense_count,
              CAST(sum(clearances_normal) AS BIGINT) AS clearances_normal, CAST(sum(arrests) AS BIGINT) AS arrests,
              CAST(sum(clearances_exceptional_total) AS BIGINT) AS clearances_exceptional_total,
              {REASON_SUMS}
            FROM {clearances("county_name, offense_name")} JOIN nibrs_offense_type USING (offense_name) GROUP BY ALL)""",
    ),
    "clearance_trend": f"""
        WITH yearly AS (
          SELECT county_name, offense_name, data_year, offense_count,
            clearances_normal + clearances_exceptional_total AS clearances_total,
            {rounded("clearances_normal + clearances_exceptional_total", "offense_count")} AS hundredths
          FROM {clearances("county_name, data_year, offense_name")})
        SELECT y.county_name, y.offense_name, y.data_year, y.offense_count, y.clearances_total,
          CAST(y.hundredths AS DOUBLE) / 100 AS clearance_ratio_total_percent,
          CAST(y.hundredths - e.hundredths AS DOUBLE) / 100 AS percent_change
        FROM yearly y LEFT JOIN yearly e ON e.data_year = y.data_year - 1
          AND e.county_name IS NOT DISTINCT FROM y.county_name AND e.offense_name IS NOT DISTINCT FROM y.offense_name""",
    "normal_clearance_report": f"""
        SELECT offense_name, county_name, offense_count, clearances_normal AS cleared_normally_count, arrests,
          CAST({rounded("clearances_normal", "offense_count")} AS DOUBLE) / 100 AS solved_crime_ratio
        FROM {clearances("county_name, offense_name")}""",
    "total_arrests": "SELECT CAST(sum(count_arrests) AS BIGINT) AS total_arrests FROM hits WHERE cleared_except_id = 6",
    "unmatched_arrests": f"SELECT incident_id, offense_code, count(*) AS arrests FROM {unmatched('true')} GROUP BY ALL",
    "unmatched_arrests_by_code": f"SELECT offense_code, count(*) AS arrests FROM {unmatched('true')} GROUP BY ALL",
    "unmatched_arrests_by_agency_narrow": by_agency("true"),
    "unmatched_arrests_by_agency": by_agency("h.cleared_except_id = 6"),
    "county_offense_arrests": """SELECT incident_id, count_arrests AS arrests FROM hits
        WHERE county_name = 'NATION_3' AND offense_name ILIKE '%BRAND#2%'""",
    "exceptional_with_arrest": """SELECT incident_id, county_name, offense_name, count_arrests FROM hits
        WHERE cleared_except_id <> 6""",
    "exceptional_by_code": f"""
        SELECT county_name, offense_name, {REASON_NAMES} FROM (
          SELECT county_name, offense_name, cleared_except_code, {REASON_COUNTS}
          FROM placed JOIN nibrs_cleared_except USING (cleared_except_id)
          WHERE cleared_except_id <> 6 GROUP BY ALL)""",
    "offense_count_distribution": """
        SELECT offenses_count AS offensecount, count(*) AS thecount,
          CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) AS percentage_records
        FROM per_incident GROUP BY offenses_count""",
    "offense_totals": "SELECT offense_name, count(*) AS offensecount FROM placed GROUP BY ALL",
    "distinct_clearance_codes": "SELECT DISTINCT cleared_except_id FROM nibrs_incident ORDER BY 1 LIMIT 1",
    "state_year_incidents": """SELECT incident_id, agency_id, incident_date, data_year, nibrs_month_id, did,
        cleared_except_id, submission_date FROM month_incidents""",
    "state_year_offense": """SELECT o.* FROM nibrs_offense o JOIN month_incidents USING (incident_id)
        WHERE offense_code = 'Brand#9'""",
    "victim_demographics": """
        SELECT r.race_code, g.age_code, v.age_num, e.ethnicity_code
        FROM nibrs_victim v JOIN nibrs_victim_offense vo USING (victim_id)
          JOIN nibrs_offense o ON o.offense_id = vo.offense_id AND o.offense_code = 'Brand#9'
          JOIN month_incidents i ON i.incident_id = v.incident_id
          JOIN ref_race r USING (race_id) JOIN nibrs_age g USING (age_id) JOIN nibrs_ethnicity e USING (ethnicity_id)""",
    "offense_locations": """
        SELECT location_code, location_name, count(*) AS offenses
        FROM nibrs_offense o JOIN month_incidents USING (incident_id) JOIN nibrs_location_type USING (location_id)
        WHERE offense_code = 'Brand#9' GROUP BY ALL""",
    "agency_coverage_chains": """
        WITH RECURSIVE chained AS (
          SELECT agency_id, data_year, legacy_ori, 'ORI' || CASE WHEN agency_id % 20 < 5 OR agency_id % 20 = 10 THEN agency_id + 1
            WHEN agency_id % 20 = 11 THEN agency_id - 1 END AS covered_by FROM agencies
        ), direct AS (
          SELECT agency_id, data_year, count(DISTINCT month_num) AS months FROM nibrs_month
          WHERE reported_status IN ('I', 'Z') GROUP BY ALL HAVING count(DISTINCT month_num) >= 3
        ), taking AS (
          SELECT data_year, legacy_ori, 0 AS covered, agency_id FROM chained SEMI JOIN direct USING (agency_id, data_year)
          UNION
          SELECT c.data_year, c.legacy_ori, 1, c.agency_id
          FROM chained c JOIN taking t ON t.legacy_ori = c.covered_by AND t.data_year = c.data_year)
        SELECT agency_id, data_year, coalesce(max(months), 0) AS months_reported, max(covered) AS covered
        FROM taking LEFT JOIN direct USING (agency_id, data_year) GROUP BY ALL""",
    "arrest_survival": f"""
        WITH counted AS ({SURVIVAL})
        SELECT offense_name, days, at_risk, arrested, still_open,
          round(product(1 - arrested / at_risk) OVER (PARTITION BY offense_name ORDER BY days), 6) AS without_arrest FROM counted""",
    "median_time_to_arrest": f"""
        WITH counted AS ({SURVIVAL}), shares AS (
          SELECT *, round(product(1 - arrested / at_risk) OVER (PARTITION BY offense_name ORDER BY days), 6) AS without_arrest FROM counted)
        SELECT offense_name, max(at_risk) AS offenses, CAST(sum(arrested) AS BIGINT) AS arrested,
          min(days) FILTER (without_arrest <= 0.5) AS median_days FROM shares GROUP BY ALL""",
    "agency_participation": """
        WITH direct AS (
          SELECT agency_id, data_year, count(DISTINCT month_num) AS months FROM nibrs_month
          WHERE reported_status IN ('I', 'Z') GROUP BY ALL HAVING count(DISTINCT month_num) >= 3),
        covered AS (
          SELECT DISTINCT a.agency_id, d.data_year FROM agencies a
          JOIN agencies c ON c.legacy_ori = a.covered_by_legacy_ori AND c.data_year = a.data_year
          JOIN direct d ON d.agency_id = c.agency_id AND d.data_year = c.data_year)
        SELECT agency_id, data_year, coalesce(months, 0) AS months_reported,
          CASE WHEN c.agency_id IS NULL THEN 0 ELSE 1 END AS covered
        FROM (SELECT * FROM direct SEMI JOIN agencies USING (agency_id, data_year)) d
          FULL JOIN covered c USING (agency_id, data_year)""",
    "cleared_without_arrest": """
        SELECT incident_id, offense_id, county_name, offense_name FROM placed p
        WHERE incident_id IN (SELECT incident_id FROM hits WHERE cleared_except_id = 6)
          AND NOT EXISTS (SELECT 1 FROM nibrs_arrestee r
            WHERE r.incident_id = p.incident_id AND r.offense_code = p.offense_code)""",
    "time_to_arrest": """
        SELECT offense_name, count(*) AS arrests, count(*) FILTER (days < 0) AS negative_gaps,
          CAST(sum(days) AS DOUBLE) / count(days) AS mean_days, CAST(median(days) AS DOUBLE) AS median_days
        FROM (SELECT n.offense_name, date_diff('day', CAST(i.incident_date AS DATE), CAST(r.arrest_date AS DATE)) AS days
              FROM nibrs_arrestee r JOIN nibrs_incident i USING (incident_id)
                JOIN nibrs_offense_type n USING (offense_code)) GROUP BY ALL""",
    "arrests_by_race": f"""
        SELECT offense_name, race_code, arrests, CAST({rounded("arrests", "total")} AS DOUBLE) / 100
          AS percent_of_offense
        FROM (SELECT offense_name, race_code, count(*) AS arrests,
                CAST(sum(count(*)) OVER (PARTITION BY offense_name) AS BIGINT) AS total
              FROM nibrs_arrestee JOIN nibrs_offense_type USING (offense_code) JOIN ref_race USING (race_id)
              GROUP BY offense_name, race_code)""",
    "clearance_by_demographic": demographic("ref_race", "race_id", "race_code"),
    "clearance_by_offender": offender_clearance(),
    "sql_views": f"""
        SELECT o.county_name, o.offense_name, o.offense_count, c.clearances_normal, c.clearances_exceptional_total
        FROM (SELECT offense_name, county_name, count(*) AS offense_count FROM placed GROUP BY ALL) o
          JOIN {clearances('county_name, offense_name')} c USING (county_name, offense_name)
        WHERE offense_name ILIKE '%brand#1%'""",
    "clearance_by_ethnicity": demographic("nibrs_ethnicity", "ethnicity_id", "ethnicity_code"),
    "incidents_per_capita": """
        SELECT county_name, data_year, CAST(sum(coalesce(n, 0)) AS BIGINT) AS incidents, CAST(sum(population) AS BIGINT) AS population,
          CAST(sum(coalesce(n, 0)) AS DOUBLE) * 1000 / CAST(sum(population) AS DOUBLE) AS incidents_per_capita
        FROM agencies
          LEFT JOIN (SELECT agency_id, data_year, count(*) AS n FROM nibrs_incident GROUP BY ALL) USING (agency_id, data_year)
        GROUP BY county_name, data_year""",
    "arrest_top_offense": f"""
        SELECT top_code, count(*) AS arrests, count(*) FILTER (offense_code = top_code) AS arrests_for_top
        FROM nibrs_arrestee JOIN (
          SELECT incident_id, arg_min(offense_code, {CODE_NUM}) AS top_code FROM nibrs_offense
          GROUP BY incident_id HAVING count(*) > 1) USING (incident_id)
        GROUP BY ALL""",
}


def statement(query: str) -> str:
    """The query behind the common table expressions it needs, each after those it uses."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in PARTS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(query)
    if not needed:
        return query
    parts = ",\n".join(f"{name} AS ({PARTS[name]})" for name in needed)
    return f"WITH {parts}\nSELECT * FROM ({query})"


def statements() -> dict[str, str]:
    return {name: statement(query) for name, query in QUERIES.items()}
