"""Star-schema order data presented as the declared tables.

Orders stand in for incidents, customers for agencies, order lines for offenses, arrests and
victims, part brands for offense codes. Jobs then run unchanged on either kind of data.
Columns that order data cannot supply are typed NULLs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspan.session import fit_shuffles
from civicspan.sources.datasets import Tables

# Customers and suppliers are unique, so tract numbers cut into ranges bound every document.
RESPONSE_ROWS = 500
ACS_VARIABLES = ["DP03_0062E", "DP03_0063E", "DP03_0066E", "DP03_0067E"]
ACS_GEOGRAPHY = ["state", "county", "tract"]
BRAND_NUMBER = "int(substr(p_brand, 7))"
CODE_NUMBER = "int(substr(offense_code, 7))"
# The first and last year of the orders.
ORDER_YEARS = (1995, 2001)


class Star:
    """Builders over one folder of order data. Nothing is read before a table is asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._read: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def _places(self) -> DataFrame:
        nation, region = self.raw("nation"), self.raw("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey)

    def _placed_customers(self) -> DataFrame:
        customer, places = self.raw("customer"), self._places()
        return customer.join(places, customer.c_nationkey == places.n_nationkey)

    def _branded_lines(self) -> DataFrame:
        line, part = self.raw("lineitem"), self.raw("part")
        return line.join(part, line.l_partkey == part.p_partkey)

    def agencies(self) -> DataFrame:
        return self._placed_customers().selectExpr(
            "c_custkey AS agency_id",
            "explode(sequence({}, {})) AS data_year".format(*ORDER_YEARS),
            "c_name AS pub_agency_name",
            "c_mktsegment AS agency_type_name",
            "n_name AS county_name",
            "r_name AS state_abbr",
            "c_nationkey * 1000 + 500 AS population",
            "concat('ORI', c_custkey) AS legacy_ori",
            "CASE WHEN c_custkey % 10 = 0 THEN concat('ORI', c_custkey + 1) END AS covered_by_legacy_ori",
            "concat('Submitting ', n_name) AS submitting_agency_name",
            "elt(int(c_custkey % 3) + 1, 'Cities', 'Counties', 'State') AS population_group_desc",
            "if(c_custkey % 2 = 0, 'All places', NULL) AS parent_pop_group_desc",
        )

    def nibrs_incident(self) -> DataFrame:
        month_id = "o_custkey * 1000 + (year(o_orderdate) - 1995) * 12 + month(o_orderdate)"
        return self.raw("orders").selectExpr(
            "o_orderkey AS incident_id",
            "o_custkey AS agency_id",
            "o_orderdate AS incident_date",
            "year(o_orderdate) AS data_year",
            f"{month_id} AS nibrs_month_id",
            f"{month_id} AS did",
            "CASE WHEN o_orderstatus = 'F' THEN int(substr(o_orderpriority, 1, 1)) ELSE 6 END AS cleared_except_id",
            "o_orderdate + INTERVAL 45 DAYS AS submission_date",
        )

    def nibrs_month(self) -> DataFrame:
        month_id = "agency_id * 1000 + (data_year - 1995) * 12 + month_num"
        reports = self.raw("orders").selectExpr(
            "o_custkey AS agency_id", "year(o_orderdate) AS data_year", "month(o_orderdate) AS month_num"
        )
        return (
            reports.groupBy("agency_id", "data_year", "month_num")
            .count()
            .selectExpr(
                f"{month_id} AS nibrs_month_id",
                f"{month_id} AS did",
                "agency_id",
                "data_year",
                "month_num",
                "if(count > 1, 'I', 'Z') AS reported_status",
            )
        )

    def nibrs_offense(self) -> DataFrame:
        # Distinct over the two columns that determine a row, so that the rows stay hashed by
        # (incident_id, offense_code) and the jobs' first grouping needs no other shuffle.
        pairs = self._branded_lines().selectExpr("l_orderkey AS incident_id", "p_brand AS offense_code").distinct()
        return pairs.selectExpr(
            f"incident_id * 100 + {CODE_NUMBER} AS offense_id",
            "incident_id",
            "offense_code",
            f"if((incident_id + {CODE_NUMBER}) % 10 = 0, 'A', 'C') AS attempt_complete_flag",
            f"(incident_id + {CODE_NUMBER}) % 7 AS location_id",
        )

    def nibrs_offense_type(self) -> DataFrame:
        codes = self.raw("part").selectExpr("p_brand AS offense_code").distinct()
        return codes.selectExpr(
            "offense_code",
            "concat('Offense ', offense_code) AS offense_name",
            f"elt({CODE_NUMBER} % 3 + 1, 'Person', 'Property', 'Society') AS crime_against",
            f"concat('Category ', {CODE_NUMBER} % 5) AS offense_category_name",
        )

    def nibrs_arrestee(self) -> DataFrame:
        return (
            self._branded_lines()
            .filter("l_returnflag = 'R'")
            .selectExpr(
                "l_orderkey AS incident_id",
                f"if(l_linestatus = 'F', p_brand, concat('Brand#', {BRAND_NUMBER} % 25 + 1)) AS offense_code",
                "l_shipdate AS arrest_date",
                "if(l_linenumber = 1, 'M', 'N') AS multiple_indicator",
                "int(l_quantity) % 5 AS race_id",
            )
        )

    def nibrs_cleared_except(self) -> DataFrame:
        # The six clearance codes.
        codes = """
          (1, 'A', 'Death of Offender'), (2, 'B', 'Prosecution Declined'),
          (3, 'C', 'In Custody of Other Jurisdiction'), (4, 'D', 'Victim Refused to Cooperate'),
          (5, 'E', 'Juvenile/No Custody'), (6, 'N', 'Not Applicable')"""
        return self.spark.sql(
            f"SELECT * FROM VALUES {codes} AS t(cleared_except_id, cleared_except_code, cleared_except_name)"
        )

    def nibrs_location_type(self) -> DataFrame:
        ids = self.raw("lineitem").selectExpr("l_orderkey % 7 AS location_id").distinct()
        return ids.selectExpr(
            "location_id", "concat('L', location_id) AS location_code", "concat('Location ', location_id) AS location_name"
        )

    def _people(self, return_flag: str, number: str) -> DataFrame:
        """Order lines of one kind with a ``person_id`` for each order and ``number``.

        People are counted within their order, of which an incident's documented limit of 999 leaves room
        for all, so ids stay apart however large the numbers are.
        """
        within = f"dense_rank() OVER (PARTITION BY l_orderkey ORDER BY {number})"
        lines = self.raw("lineitem").filter(F.col("l_returnflag") == return_flag)
        return lines.selectExpr("l_orderkey", "l_suppkey", "l_partkey", f"l_orderkey * 1000 + {within} AS person_id")

    def nibrs_victim(self) -> DataFrame:
        supplier, nation = self.raw("supplier"), self.raw("nation")
        origin = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        pairs = self._people("A", "l_suppkey").select("person_id", "l_orderkey", "l_suppkey").distinct()
        return pairs.join(origin, pairs.l_suppkey == origin.s_suppkey).selectExpr(
            "person_id AS victim_id",
            "l_orderkey AS incident_id",
            "n_regionkey AS race_id",
            "s_nationkey AS ethnicity_id",
            "l_suppkey % 100 AS age_id",
            "CAST(l_suppkey % 100 AS smallint) AS age_num",
        )

    def nibrs_victim_offense(self) -> DataFrame:
        lines, part = self._people("A", "l_suppkey"), self.raw("part")
        return (
            lines.join(part, lines.l_partkey == part.p_partkey)
            .selectExpr("person_id AS victim_id", f"l_orderkey * 100 + {BRAND_NUMBER} AS offense_id")
            .distinct()
        )

    def nibrs_offender(self) -> DataFrame:
        people = self._people("N", "l_partkey").select("person_id", "l_orderkey", "l_partkey").distinct()
        return people.selectExpr(
            "person_id AS offender_id", "l_orderkey AS incident_id", "l_partkey % 5 AS race_id"
        )

    def ref_race(self) -> DataFrame:
        return self.raw("region").selectExpr("r_regionkey AS race_id", "r_name AS race_code")

    def nibrs_ethnicity(self) -> DataFrame:
        return self.raw("nation").selectExpr("n_nationkey AS ethnicity_id", "n_name AS ethnicity_code")

    def nibrs_age(self) -> DataFrame:
        ids = self.raw("lineitem").selectExpr("l_suppkey % 100 AS age_id").distinct()
        return ids.selectExpr("age_id", "concat('A', age_id) AS age_code")

    def acs_rows(self) -> DataFrame:
        """Census-like rows, all columns as text."""
        return self._placed_customers().selectExpr(
            """concat('Census Tract ', 7000 + c_custkey, if(c_custkey % 2 = 0, '.01', ''), ', ', n_name,
                 ', ', r_name) AS NAME""",
            "string(floor(c_acctbal)) AS DP03_0062E",
            "string(floor(c_acctbal * 2)) AS DP03_0063E",
            "string(floor(c_acctbal / 2)) AS DP03_0066E",
            "string(floor(c_acctbal * 3)) AS DP03_0067E",
            "string(r_regionkey) AS state",
            "string(n_nationkey) AS county",
            "string(7000 + c_custkey) AS tract",
        )

    def geo_features(self) -> DataFrame:
        tracts = self.raw("supplier").selectExpr(
            "concat(7000 + s_suppkey, if(s_suppkey % 2 = 0, '.01', '.00')) AS GEODESC",
            "string(24000 + s_nationkey) AS CNTY2010",
            "s_name",
            """concat('{"type":"Point","coordinates":[', s_suppkey, ',', s_nationkey, ']}') AS geometry""",
        )
        return tracts.selectExpr(
            "GEODESC",
            "CNTY2010",
            "map('GEODESC', GEODESC, 'CNTY2010', CNTY2010, 'NAME', s_name) AS properties",
            "geometry",
        )

    def manifest_documents(self) -> DataFrame:
        """One manifest document per customer, with none, one or two tags."""
        county, segment = "struct('county' AS key, n_name AS value)", "struct('segment' AS key, c_mktsegment AS value)"
        source = f"""struct(
            c_name AS name, 'relational_database' AS type, r_name AS source, '2023-01-01' AS date_added,
            string(date_add(DATE '2023-01-01', int(c_custkey % 400))) AS last_fetched,
            concat('/data/', c_name, '.csv') AS path, if(c_custkey % 2 = 0, 'annual', 'monthly') AS ttl,
            '' AS key_column, c_mktsegment AS description,
            slice(array({county}, {segment}), 1, elt(int(c_custkey % 3) + 1, 2, 1, 0)) AS tags)"""
        return self._placed_customers().selectExpr(f"to_json(struct(array({source}) AS data_manifests)) AS value")

    def acs_documents(self) -> DataFrame:
        """Responses of one county with a header row and at most ``RESPONSE_ROWS`` tracts."""
        names = ["NAME", *ACS_VARIABLES, *ACS_GEOGRAPHY]
        header = F.array(*[F.lit(name) for name in names])
        batch = F.expr(f"bigint(tract) div {RESPONSE_ROWS}").alias("batch")
        rows = self.acs_rows().groupBy("state", "county", batch).agg(F.collect_list(F.array(*names)).alias("rows"))
        return rows.select(F.to_json(F.concat(F.array(header), "rows")).alias("value"))

    def feature_documents(self) -> DataFrame:
        """Feature collections of at most ``RESPONSE_ROWS`` tracts."""
        feature = F.concat(
            F.lit('{"type":"Feature","properties":'),
            F.to_json("properties"),
            F.lit(',"geometry":'),
            "geometry",
            F.lit("}"),
        )
        batch = F.expr(f"bigint(split_part(GEODESC, '.', 1)) div {RESPONSE_ROWS}").alias("batch")
        grouped = self.geo_features().groupBy(batch).agg(F.collect_list(feature).alias("features"))
        return grouped.select(
            F.concat(
                F.lit('{"type":"FeatureCollection","features":['), F.array_join("features", ","), F.lit("]}")
            ).alias("value")
        )


STAR_TABLES = [
    "agencies",
    "nibrs_incident",
    "nibrs_month",
    "nibrs_offense",
    "nibrs_offense_type",
    "nibrs_arrestee",
    "nibrs_cleared_except",
    "nibrs_location_type",
    "nibrs_victim",
    "nibrs_victim_offense",
    "nibrs_offender",
    "ref_race",
    "nibrs_ethnicity",
    "nibrs_age",
]


def star_tables(spark: SparkSession, folder: str) -> Tables:
    """The tables over one folder; the session's shuffles are fitted to its order lines, the largest of them."""
    star = Star(spark, folder)
    fit_shuffles(spark, star.raw("lineitem").count())
    builders: dict[str, Callable[[], DataFrame]] = {name: getattr(star, name) for name in STAR_TABLES}
    return Tables(builders)
