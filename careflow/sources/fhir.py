"""FHIR bundles as record tables: nested JSON by ``VARIANT``, entries exploded in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Resource types, and where each column of a table is found in a resource.
REFERENCE = {"patient_id": ("$.subject.reference", "string"), "encounter_id": ("$.encounter.reference", "string")}
CODE = {"code": ("$.code.coding[0].code", "string"), "display": ("$.code.coding[0].display", "string")}
TABLES = {
    "patients": ("Patient", {"id": ("$.id", "string"), "family": ("$.name[0].family", "string"), "given": ("$.name[0].given[0]", "string"), "gender": ("$.gender", "string"), "birth_date": ("$.birthDate", "date")}),
    "encounters": ("Encounter", {"id": ("$.id", "string"), **REFERENCE, "class": ("$.class.code", "string"), "status": ("$.status", "string"), "start": ("$.period.start", "timestamp"), "end": ("$.period.end", "timestamp")}),
    "conditions": ("Condition", {"id": ("$.id", "string"), **REFERENCE, **CODE, "onset": ("$.onsetDateTime", "timestamp")}),
    "observations": ("Observation", {"id": ("$.id", "string"), **REFERENCE, **CODE, "value": ("$.valueQuantity.value", "double"), "unit": ("$.valueQuantity.unit", "string"), "at": ("$.effectiveDateTime", "timestamp")}),
    "medications": ("MedicationRequest", {"id": ("$.id", "string"), **REFERENCE, "code": ("$.medicationCodeableConcept.coding[0].code", "string"), "display": ("$.medicationCodeableConcept.coding[0].display", "string"), "status": ("$.status", "string"), "at": ("$.authoredOn", "timestamp")}),
    "procedures": ("Procedure", {"id": ("$.id", "string"), **REFERENCE, **CODE, "start": ("$.performedPeriod.start", "timestamp"), "end": ("$.performedPeriod.end", "timestamp")}),
}


def read(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """(origin, text): a bundle a line, or a bundle a file."""
    if whole_files:
        return spark.read.format("binaryFile").load(path).select(F.col("path").alias("origin"), F.decode("content", "UTF-8").alias("text"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("origin"), F.col("value").alias("text"))


def entries(bundles: DataFrame) -> DataFrame:
    """(origin, place, kind, resource, problem) of every entry of (origin, text).

    A text that is no JSON or no bundle gives one row with a problem and no place; so does an entry without resource, type or id, with its place. An empty
    bundle gives none.
    """
    parsed = bundles.select("origin", "text", F.try_parse_json("text").alias("b"))
    is_bundle = F.try_variant_get("b", "$.resourceType", "string").eqNullSafe(F.lit("Bundle"))
    bad = parsed.filter(~is_bundle).select("origin", F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("variant").alias("resource"), F.when(F.col("b").isNull(), "not JSON").otherwise("not a bundle").alias("problem"))
    parsed = parsed.filter(is_bundle).select("origin", F.try_variant_get("b", "$.entry", "variant").alias("entry"))
    parsed.createOrReplaceTempView("_fhir_bundles")
    rows = bundles.sparkSession.sql("SELECT origin, e.pos AS place, e.value AS v FROM _fhir_bundles, LATERAL variant_explode(entry) AS e")
    rows = rows.select("origin", "place", F.try_variant_get("v", "$.resource", "variant").alias("resource"))
    rows = rows.withColumn("kind", F.try_variant_get("resource", "$.resourceType", "string"))
    problem = F.when(F.col("resource").isNull(), "no resource").when(F.col("kind").isNull(), "no type").when(F.try_variant_get("resource", "$.id", "string").isNull(), "no id")
    return rows.select("origin", "place", "kind", "resource", problem.alias("problem")).unionByName(bad)


def table(found: DataFrame, name: str) -> DataFrame:
    """One of ``TABLES`` from entries without a problem; what a resource lacks, or has in another type, is null. References keep their last part only."""
    kind, columns = TABLES[name]
    at = lambda c, place, to: (F.regexp_extract(F.try_variant_get("resource", place, "string"), r"([^/:]+)$", 1) if c in REFERENCE else F.try_variant_get("resource", place, to)).alias(c)
    rows = found.filter((F.col("kind") == kind) & F.col("problem").isNull()).select(*(at(c, place, to) for c, (place, to) in columns.items()))
    return rows.select(*(F.nullif(F.col(c), F.lit("")).alias(c) if c in REFERENCE else F.col(c) for c in columns))


def problems(found: DataFrame) -> DataFrame:
    """(origin, place, problem) of what could not be read."""
    return found.filter(F.col("problem").isNotNull()).select("origin", "place", "problem")
