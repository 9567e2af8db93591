"""The election tables, derived from the order tables by joins and sums.

Stations are customers, municipalities nations, counties regions; an order's
status, priority and date say which election it voted in, its lines' parts whom
for.  Surrogate keys are composed from the natural ones.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plebis import schema

FIRST_NAMES = ("Ana", "Đuro", "Željka", "Marko", "Ćiril", "Iva", "Šime", "Luka", "Nives", "Zdenka", "Tena", "Vjekoslav", "Rok", "Lucija")
LAST_NAMES = (
    "Anić", "Babić", "Čačić", "Ćosić", "Drašković", "Đapić", "Erceg", "Filipović", "Grgić", "Hoić", "Ivšić", "Jurić", "Kos",
    "Lončar", "Ljubić", "Matić", "Nović", "Njegač", "Oreč", "Pešić", "Radoš", "Šarić", "Tadić", "Vukoja", "Žanić",
)


def new_folder(spark: SparkSession, what: str) -> str:
    """A new folder among those that the cluster shares; a temporary one only on a single
    machine whose session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="plebis-")
    return f"{base}/{what}-{uuid.uuid4().hex}"


class Tables:
    """The election tables over one folder; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def written(self) -> Tables:
        """The same tables over votes that are written once, as nine tables come from them."""
        folder = f"{new_folder(self.spark, 'votes')}"
        self.votes.write.parquet(folder)
        again = Tables(self.spark, self.sf_dir)
        again.__dict__["votes"] = self.spark.read.parquet(folder)
        return again

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def county(self) -> DataFrame:
        return self.raw("region").select(
            F.col("r_regionkey").cast("long").alias("id"),
            F.lpad((F.col("r_regionkey") + 1).cast("string"), 2, "0").alias("code"),
            F.col("r_name").alias("name"),
        )

    @cached_property
    def municipality(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").cast("long").alias("id"),
            F.col("n_regionkey").cast("long").alias("county_id"),
            F.col("n_name").alias("name"),
            F.when(F.col("n_nationkey") % 2 == 0, "grad").otherwise("općina").alias("type"),
        )

    @cached_property
    def polling_station(self) -> DataFrame:
        key = F.col("c_custkey").cast("string")
        return self.raw("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_nationkey").cast("long").alias("municipality_id"),
            F.when(F.length(key) < 6, F.lpad(key, 6, "0")).otherwise(key).alias("number"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("location"),
            F.concat_ws(" ", "c_mktsegment", (F.col("c_custkey") % 20).cast("string")).alias("address"),
        )

    @cached_property
    def election_type(self) -> DataFrame:
        return self.spark.createDataFrame(list(schema.ELECTION_TYPES), "id long, slug string, name string")

    @cached_property
    def votes(self) -> DataFrame:
        """One row an order line, with the keys of what it voted for."""
        town = F.col("c_nationkey") % 2 == 0
        priority = F.substring("o_orderpriority", 1, 1)
        local = (
            F.when(priority == "5", 3)
            .when(priority == "1", F.when(town, 4).otherwise(5))
            .when(priority == "2", F.when(town, 6).otherwise(7))
            .when(priority == "3", 8)
            .otherwise(9)
        )
        area = F.col("c_nationkey") % 13
        number = F.when(area < 10, area + 1).when(area == 10, 11).when(area == 11, 121).otherwise(122)
        orders = (
            self.raw("orders")
            .join(self.raw("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .select(
                "o_orderkey",
                F.col("c_custkey").alias("polling_station_id"),
                F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(local).cast("long").alias("type_id"),
                F.year("o_orderdate").alias("year"),
                F.month("o_orderdate").alias("month"),
                F.to_date("o_orderdate").alias("date"),
                F.when(F.col("o_orderstatus") == "O", number).alias("district"),
            )
            .withColumn("round_number", F.when(F.col("type_id").isin(2, 3) | (F.col("month") <= 8), 1).otherwise(2))
            .withColumn("election_id", F.col("type_id") * 10000 + F.col("year"))
            .withColumn("round_id", F.col("election_id") * 10 + F.col("round_number"))
            .withColumn("district_id", F.col("election_id") * 1000 + F.col("district"))
        )
        parts = self.raw("part").select(
            "p_partkey",
            F.substring_index("p_brand", "#", -1).cast("int").alias("brand"),
            (F.col("p_partkey") % 14 + 1).cast("int").alias("position"),
        )
        lines = self.raw("lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("votes"), "l_returnflag")
        return (
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .withColumn("list_id", F.col("round_id") * 100000 + F.coalesce("district", F.lit(0)) * 100 + F.col("brand"))
        )

    @cached_property
    def election(self) -> DataFrame:
        return self.votes.groupBy(F.col("election_id").alias("id"), F.col("type_id").alias("election_type_id"), "year").agg(
            F.min("date").alias("date")
        ).withColumn(
            "name", F.when(F.col("election_type_id") == 3, F.concat(F.lit("Europski izbori "), F.col("year").cast("string"))).otherwise("")
        )

    @cached_property
    def election_round(self) -> DataFrame:
        return self.votes.select(F.col("round_id").alias("id"), "election_id", "round_number").distinct()

    @cached_property
    def electoral_district(self) -> DataFrame:
        return (
            self.votes.where("district_id is not null")
            .select(F.col("district_id").alias("id"), "election_id", F.col("district").alias("number"))
            .distinct()
            .withColumn("name", F.concat(F.col("number").cast("string"), F.lit(". IZBORNA JEDINICA")))
        )

    @cached_property
    def electoral_list(self) -> DataFrame:
        brand = F.col("brand").cast("string")
        name = F.concat(
            F.lit("LISTA "),
            brand,
            F.when(F.col("brand") % 3 == 0, F.concat(F.lit(", PARTNER "), (F.col("brand") % 5).cast("string")))
            .when(F.col("brand") % 3 == 1, F.lit("\nSAVEZ"))
            .otherwise(""),
        )
        return (
            self.votes.select(F.col("list_id").alias("id"), F.col("round_id").alias("election_round_id"), "district_id", "brand")
            .distinct()
            .select("id", "election_round_id", "district_id", name.alias("name"))
        )

    @cached_property
    def person(self) -> DataFrame:
        first = F.element_at(F.array(*map(F.lit, FIRST_NAMES)), F.col("position"))
        last = F.element_at(F.array(*map(F.lit, LAST_NAMES)), F.col("brand"))
        from plebis.functions.names import normalize_person_name

        return (
            self._people.withColumn("first_name", first)
            .withColumn("last_name", last)
            .select(
                F.col("id"),
                "first_name",
                "last_name",
                normalize_person_name(F.concat_ws(" ", "first_name", "last_name")).alias("normalized_name"),
            )
        )

    @cached_property
    def _people(self) -> DataFrame:
        return (
            self.raw("part")
            .select(
                F.substring_index("p_brand", "#", -1).cast("int").alias("brand"),
                (F.col("p_partkey") % 14 + 1).cast("int").alias("position"),
            )
            .distinct()
            .withColumn("id", (F.col("brand") * 100 + F.col("position")).cast("long"))
        )

    @cached_property
    def candidacy(self) -> DataFrame:
        lists = self.electoral_list.select(F.col("id").alias("electoral_list_id"), (F.col("id") % 100).cast("int").alias("brand"))
        people = self._people.select(F.col("id").alias("person_id"), "brand", F.col("position").alias("position_on_list"))
        return lists.join(F.broadcast(people), "brand").select(
            (F.col("electoral_list_id") * 100 + F.col("position_on_list")).alias("id"), "person_id", "electoral_list_id", "position_on_list"
        )

    @cached_property
    def candidate_result(self) -> DataFrame:
        return self.votes.groupBy(
            (F.col("list_id") * 100 + F.col("position")).alias("candidacy_id"), "polling_station_id"
        ).agg(F.sum("votes").alias("votes"))

    @cached_property
    def list_result(self) -> DataFrame:
        return self.votes.groupBy(F.col("list_id").alias("electoral_list_id"), "polling_station_id").agg(F.sum("votes").alias("votes"))

    @cached_property
    def turnout(self) -> DataFrame:
        return (
            self.votes.groupBy(F.col("round_id").alias("election_round_id"), "polling_station_id")
            .agg(
                F.sum("votes").alias("ballots_cast"),
                F.sum(F.when(F.col("l_returnflag") != "R", F.col("votes")).otherwise(0)).alias("valid_ballots"),
            )
            .select(
                "election_round_id",
                "polling_station_id",
                (F.col("ballots_cast") * 2).alias("registered_voters"),
                "ballots_cast",
                "valid_ballots",
                (F.col("ballots_cast") - F.col("valid_ballots")).alias("invalid_ballots"),
            )
        )


def _sql_list(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


#: The same tables in SQL, to be followed by further common tables or a query.
PRELUDE = f"""
WITH county AS (
  SELECT r_regionkey::BIGINT AS id, lpad((r_regionkey + 1)::VARCHAR, 2, '0') AS code, r_name AS name FROM region),
municipality AS (
  SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS county_id, n_name AS name,
         CASE WHEN n_nationkey % 2 = 0 THEN 'grad' ELSE 'općina' END AS type FROM nation),
polling_station AS (
  SELECT c_custkey::BIGINT AS id, c_nationkey::BIGINT AS municipality_id,
         CASE WHEN length(c_custkey::VARCHAR) < 6 THEN lpad(c_custkey::VARCHAR, 6, '0') ELSE c_custkey::VARCHAR END AS number,
         c_name AS name, c_mktsegment AS location, c_mktsegment || ' ' || (c_custkey % 20)::VARCHAR AS address FROM customer),
election_type AS (
  SELECT id::BIGINT AS id, slug, name FROM (VALUES {', '.join(map(str, schema.ELECTION_TYPES))}) t(id, slug, name)),
votes0 AS (
  SELECT c_custkey::BIGINT AS polling_station_id, l_quantity::BIGINT AS votes, l_returnflag, o_orderdate::DATE AS date,
         year(o_orderdate)::INT AS year, month(o_orderdate) AS month,
         split_part(p_brand, '#', 2)::INT AS brand, (p_partkey % 14 + 1)::INT AS position,
         (CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE CASE left(o_orderpriority, 1) WHEN '5' THEN 3
           WHEN '1' THEN CASE WHEN c_nationkey % 2 = 0 THEN 4 ELSE 5 END
           WHEN '2' THEN CASE WHEN c_nationkey % 2 = 0 THEN 6 ELSE 7 END WHEN '3' THEN 8 ELSE 9 END END)::BIGINT AS type_id,
         CASE WHEN o_orderstatus = 'O' THEN CASE WHEN c_nationkey % 13 < 10 THEN c_nationkey % 13 + 1
           WHEN c_nationkey % 13 = 10 THEN 11 WHEN c_nationkey % 13 = 11 THEN 121 ELSE 122 END END::INT AS district
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
votes1 AS (
  SELECT *, type_id * 10000 + year AS election_id, CASE WHEN type_id IN (2, 3) OR month <= 8 THEN 1 ELSE 2 END AS round_number FROM votes0),
votes2 AS (SELECT *, election_id * 10 + round_number AS round_id, election_id * 1000 + district AS district_id FROM votes1),
votes AS (SELECT *, round_id * 100000 + coalesce(district, 0) * 100 + brand AS list_id FROM votes2),
election AS (
  SELECT election_id AS id, type_id AS election_type_id, year, min(date) AS date,
         CASE WHEN type_id = 3 THEN 'Europski izbori ' || year::VARCHAR ELSE '' END AS name FROM votes GROUP BY ALL),
election_round AS (SELECT DISTINCT round_id AS id, election_id, round_number FROM votes),
electoral_district AS (
  SELECT DISTINCT district_id AS id, election_id, district AS number, district::VARCHAR || '. IZBORNA JEDINICA' AS name
  FROM votes WHERE district_id IS NOT NULL),
electoral_list AS (
  SELECT DISTINCT list_id AS id, round_id AS election_round_id, district_id,
         'LISTA ' || brand::VARCHAR || CASE brand % 3 WHEN 0 THEN ', PARTNER ' || (brand % 5)::VARCHAR WHEN 1 THEN chr(10) || 'SAVEZ' ELSE '' END AS name
  FROM votes),
people AS (
  SELECT DISTINCT split_part(p_brand, '#', 2)::INT AS brand, (p_partkey % 14 + 1)::INT AS position,
         (split_part(p_brand, '#', 2)::INT * 100 + p_partkey % 14 + 1)::BIGINT AS id FROM part),
person AS (
  SELECT id, {_sql_list(FIRST_NAMES)}[position] AS first_name, {_sql_list(LAST_NAMES)}[brand] AS last_name,
         upper(replace(replace(strip_accents({_sql_list(FIRST_NAMES)}[position] || ' ' || {_sql_list(LAST_NAMES)}[brand]), 'Đ', 'D'), 'đ', 'd'))
           AS normalized_name FROM people),
candidacy AS (
  SELECT l.id * 100 + p.position AS id, p.id AS person_id, l.id AS electoral_list_id, p.position AS position_on_list
  FROM electoral_list l JOIN people p ON p.brand = l.id % 100),
candidate_result AS (
  SELECT list_id * 100 + position AS candidacy_id, polling_station_id, sum(votes)::BIGINT AS votes FROM votes GROUP BY ALL),
list_result AS (SELECT list_id AS electoral_list_id, polling_station_id, sum(votes)::BIGINT AS votes FROM votes GROUP BY ALL),
turnout AS (
  SELECT round_id AS election_round_id, polling_station_id, (sum(votes) * 2)::BIGINT AS registered_voters, sum(votes)::BIGINT AS ballots_cast,
         sum(CASE WHEN l_returnflag <> 'R' THEN votes ELSE 0 END)::BIGINT AS valid_ballots,
         sum(CASE WHEN l_returnflag <> 'R' THEN 0 ELSE votes END)::BIGINT AS invalid_ballots
  FROM votes GROUP BY ALL)
"""
