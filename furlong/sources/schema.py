"""The five tables of the model, their keys, and databases of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

HORSES = "horse_id string NOT NULL, name string NOT NULL, sex string, birth_year int, birth_date string, color string, breeder string, owner string, total_earnings bigint, total_starts int, total_wins int, profile_scraped int"
RACES = "race_id string NOT NULL, year int NOT NULL, date string, race_name string NOT NULL, track string, grade string, grade_weight double, surface string, distance int, going string, weather string, num_runners int, url string"
ENTRIES = "race_id string NOT NULL, horse_name string NOT NULL, horse_id string, position int, finish_time string, jockey string, trainer string, weight double, odds double, horse_weight string, age int, sex string, passing_positions string, margin string"
PEDIGREE = "horse_id string NOT NULL, horse_name string, sire_id string, sire_name string, dam_id string, dam_name string, grandsire_id string, grandsire_name string, dam_sire_id string, dam_sire_name string"
PEDIGREE_TREE = "horse_id string NOT NULL, horse_name string, ancestor_id string, ancestor_name string, generation int, line string NOT NULL"
TABLES = {"horses": HORSES, "races": RACES, "race_entries": ENTRIES, "pedigree": PEDIGREE, "pedigree_tree": PEDIGREE_TREE}
KEYS = {"horses": ["horse_id"], "races": ["race_id"], "race_entries": ["race_id", "horse_name"], "pedigree": ["horse_id"], "pedigree_tree": ["horse_id", "line"]}
DEFAULTS = {"races": {"grade": "G1", "grade_weight": 1.0}, "horses": {"profile_scraped": 0}}
#: Columns that hold texts of several kinds before repair.
UNCLEAN = {"races": ["distance"], "race_entries": ["weight", "odds", "age"]}


def schema(table: str, raw: bool = False) -> T.StructType:
    """raw: as tables land, before repair, where some columns hold texts of several kinds."""
    fields = T.StructType.fromDDL(TABLES[table]).fields
    texts = UNCLEAN.get(table, []) if raw else []
    return T.StructType([T.StructField(f.name, T.StringType(), True) if f.name in texts else f for f in fields])


def typed(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in its types; values that cannot be read are null, missing columns get their defaults or null."""
    from pyspark.sql import functions as F

    default = DEFAULTS.get(table, {})
    column = lambda f: F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(default.get(f.name)).cast(f.dataType)
    return df.select(*[column(f).alias(f.name) for f in schema(table).fields])


def create(spark: SparkSession, database: str, raw: bool = False) -> None:
    """The five tables in a database, empty, as Parquet; tables that are there stay."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name in TABLES:
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema(name, raw).fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({fields}) USING PARQUET")


def copy(spark: SparkSession, source: str, target: str, change: dict | None = None) -> None:
    """A new database of the same tables; change has a function from DataFrame to DataFrame for each table that is to differ.
    No column of a table must be unique but its key, so translated names may fall together."""
    spark.sql(f"DROP DATABASE IF EXISTS {target} CASCADE")
    spark.sql(f"CREATE DATABASE {target}")
    for t in spark.catalog.listTables(source):
        if t.isTemporary:
            continue
        rows = spark.table(f"{source}.{t.name}")
        (change or {}).get(t.name, lambda x: x)(rows).write.format("parquet").saveAsTable(f"{target}.{t.name}")
