"""Company-facts documents landed once, a row for each concept and unit, with the facts as VARIANT.

A document's text is parsed a single time, when it lands. The rows lie in ranges of tag and symbol, so a reader that wants
a few concepts names them and skips the files and row groups of all others; it never parses JSON again. The facts keep every
field that the document has, also those that no schema of today declares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.schemas import CORRUPT, FACT
from ledgerlens.sources.company_facts import NAMESPACES

_CONCEPT = T.StructType([T.StructField("units", T.MapType(T.StringType(), T.VariantType()))])
#: As `schemas.COMPANY_FACTS`, but what a unit holds is kept as it came.
LANDED_DOCUMENT = T.StructType([
    T.StructField("facts", T.MapType(T.StringType(), T.MapType(T.StringType(), _CONCEPT))),
    T.StructField(CORRUPT, T.StringType()),
])
LANDED = "symbol string, part int, ns string, ns_order int, tag string, unit_place int, unit string, facts variant, batch long"


def land_documents(texts: DataFrame, folder: str, batch: int, namespaces: tuple[str, ...] = NAMESPACES) -> None:
    """Parse (symbol, part, text) documents and write their concepts as a batch; one that is run again replaces its files.

    Unreadable and empty documents leave no rows (`parse_report` counts them); a null among the units is no unit's facts. Rows of
    one tag may hold a third of all facts: ranges are cut by symbol as well, so no task takes a tag whole.
    """
    parsed = texts.select("symbol", "part", F.from_json("text", LANDED_DOCUMENT, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
    }).alias("doc"))
    readable = F.when(F.col(f"doc.{CORRUPT}").isNull(), F.col("doc.facts"))
    order = F.array_position(F.array(*[F.lit(n) for n in namespaces]), F.col("ns")).cast("int") - 1
    concepts = parsed.select("symbol", "part", F.explode_outer(readable).alias("ns", "concepts")).filter(F.col("ns").isin(*namespaces)).select(
        "symbol", "part", "ns", order.alias("ns_order"), F.explode("concepts").alias("tag", "concept"),
    )
    units = concepts.select("symbol", "part", "ns", "ns_order", "tag", F.posexplode(F.map_entries("concept.units")).alias("unit_place", "entry"))
    rows = units.select("symbol", "part", "ns", "ns_order", "tag", "unit_place", F.col("entry.key").alias("unit"), F.col("entry.value").alias("facts"))
    placed = rows.repartitionByRange("tag", "symbol").sortWithinPartitions("tag", "symbol")
    placed.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch}")


def read_landed(spark: SparkSession, folder: str, tags: list[str] | None = None) -> DataFrame:
    """Landed rows of all batches, of the concepts in `tags` alone if they are given."""
    rows = spark.read.schema(LANDED).option("basePath", folder).parquet(folder)
    return rows if tags is None else rows.filter(F.col("tag").isin(*tags))


def landed_facts(landed: DataFrame, units: str = "first") -> DataFrame:
    """One row per fact, with the columns and the order of `explode_facts`.

    A field that is absent or of another type is null, and the rest of its fact is read; facts that are no array are none.
    """
    chosen = landed.filter("unit_place = 0") if units == "first" else landed
    held = F.expr("try_variant_get(facts, '$', 'array<variant>')")
    facts = chosen.select("symbol", "part", "ns", "ns_order", "tag", "unit_place", "unit", F.posexplode(held).alias("idx", "fact"))
    fields = {f.name: F.expr(f"try_variant_get(fact, '$.{f.name}', '{f.dataType.simpleString()}')") for f in FACT}
    dates = ("start", "end", "filed")
    return facts.select(
        "symbol", "ns", "ns_order", "tag", "unit", F.struct("ns_order", "unit_place", "part", "idx").alias("pos"),
        *[(F.try_to_date(value) if name in dates else value).alias(name) for name, value in fields.items()],
    )
