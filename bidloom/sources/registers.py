"""Company registers as they are kept: tables of several versions, look-ups saved as JSON, and what is still to be looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidloom.sources.extracts import CATEGORIES

#: What a search reads of the register; older files lack some of it.
REGISTRY = (
    "inn", "name", "full_name", "ogrn", "region_code", "region_name", "city", "okved_main", "okved_main_name", "okved_extra", "msp_category", "employees", "products", "msp_since", "in_dataset",
)
#: Fields of a saved look-up that count.
RECORD = (
    "inn string, name_ex string, ogrn string, nptype string, regioncode string, citytype string, cityname string, okved1 string, okved1name string, category string, od2_sschr long, "
    "phone string, email string, has_licenses boolean, is_hitech boolean, has_contracts boolean, dtregistry string"
)


def registry_scan(spark: SparkSession, *paths: str, columns: tuple[str, ...] = REGISTRY) -> DataFrame:
    """The columns over Parquet files of several versions; one that a file lacks is null there, one that all lack is null everywhere. Only these columns are read."""
    rows = spark.read.option("mergeSchema", True).parquet(*paths)
    held = set(rows.columns)
    out = rows.select(*[F.col(c) if c in held else F.lit(None).cast("string").alias(c) for c in columns])
    return out.withColumn("in_dataset", F.coalesce(F.col("in_dataset").cast("boolean"), F.lit(False))) if "in_dataset" in columns else out


def registry_records(saved: DataFrame) -> DataFrame:
    """Registry rows of saved look-ups. saved: data (JSON). Malformed ones and those without a number go."""
    r = saved.select(F.from_json("data", RECORD).alias("d")).select("d.*").filter("inn is not null")
    filled = lambda c: F.nullif(c, F.lit(""))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    category = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])[F.col("category")]
    return r.select(
        "inn", F.col("name_ex").alias("name"), "ogrn", F.when(F.col("nptype") == "IP", "ИП").otherwise("ЮЛ").alias("kind"), F.col("regioncode").alias("region_code"),
        filled(F.concat_ws(" ", filled(F.col("citytype")), filled(F.col("cityname")))).alias("city"), F.col("okved1").alias("okved_main"), F.col("okved1name").alias("okved_main_name"),
        category.alias("msp_category"), F.col("od2_sschr").alias("employees"), "phone", "email", flag("has_licenses"), flag("is_hitech"), flag("has_contracts"), filled(F.left("dtregistry", F.lit(10))).alias("msp_since"),
    )


def without_nulls(rows: DataFrame, key: str = "inn") -> DataFrame:
    """key, record: the other columns as JSON, nulls and NaN left out."""
    value = lambda f: F.nanvl(F.col(f.name), F.lit(None)) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
    return rows.select(key, F.to_json(F.struct(*[value(f).alias(f.name) for f in rows.schema if f.name != key]), {"ignoreNullFields": "true"}).alias("record"))


def to_fetch(asked: DataFrame, cache: DataFrame, most_wanted: Column) -> DataFrame:
    """inn, place: numbers that the cache never saw, most wanted first. asked: inn and what most_wanted needs; cache: inn, a null payload counts as seen."""
    wanted = asked.groupBy("inn").agg(F.max(most_wanted).alias("wanted")).join(cache.select("inn"), "inn", "left_anti")
    counts = wanted.groupBy("wanted").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("wanted")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("wanted").orderBy("inn"))
    return wanted.withColumn("within", within).join(counts, "wanted").select("inn", (F.col("before") + F.col("within")).alias("place"))


def shown(cards: DataFrame, role: str | None = None, size: str | None = None, most: int = 10, page: int = 0) -> DataFrame:
    """A page of each query's cards with a role and a size, in their order. cards: query_id, place, and role and size_class where they are asked for."""
    kept = cards if role is None else cards.filter(F.col("role") == role)
    kept = kept if size is None else kept.filter(F.col("size_class") == size)
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return kept.withColumn("at", at).filter(F.col("at").between(page * most + 1, (page + 1) * most))


def key_figures(cards: DataFrame, totals: DataFrame) -> DataFrame:
    """query_id, total_candidates, verified, flagged (on the register of unfair suppliers), listed. cards: query_id, status, in_rnp; totals: query_id, total_candidates."""
    counts = cards.groupBy("query_id").agg(F.count_if(F.col("status") == "verified").alias("verified"), F.count_if("in_rnp").alias("flagged"), F.count("*").alias("listed"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return totals.join(counts, "query_id", "left").select("query_id", "total_candidates", zero("verified"), zero("flagged"), zero("listed"))
