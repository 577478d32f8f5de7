"""Nested documents of which single elements may be broken: those go to quarantine, the rest of the document stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from followgraph import schemas
from followgraph.session import written

NO_JSON = "document is no JSON object"
NO_LIST = "followers are no list"
NO_OBJECT = "element is no object"
NO_ALIAS = "element has no permalink"
_NUMBERS = [f.name for f in schemas.FOLLOWER.fields if f.dataType.typeName() == "long"]


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line): one document a line, as text."""
    return spark.read.schema("line string").text(path)


def _is(kind: str, value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def followers_of(lines: DataFrame, column: str = "line") -> tuple[DataFrame, DataFrame]:
    """((alias, position, follower), (alias, position, text, reason)) of documents with ``alias`` and ``followers``.

    ``follower`` has the fields of ``schemas.FOLLOWER``; ``position`` counts the elements of a document from 0, broken ones included.
    An element is broken if it is no object, has no text as ``permalink``, or has something else than a whole number or nothing as a count. What
    is broken as a document comes with a null position. Documents without followers give no rows. Both parts read one written table.
    """
    parsed = lines.select(F.col(column).alias("text"), F.try_parse_json(F.col(column)).alias("doc"))
    # what parses and begins with a brace is an object; the schema of a whole document would cost as much as parsing it
    parsed = parsed.withColumn("whole", F.col("doc").isNotNull() & F.col("text").rlike(r"\A[ \t\r\n]*\{"))
    alias = F.when(F.col("whole"), F.try_variant_get("doc", "$.alias", "string"))
    parsed = parsed.withColumn("alias", alias)
    array = F.when(F.col("whole"), F.try_variant_get("doc", "$.followers", "array<variant>"))
    parsed = parsed.withColumn("list", array)
    named = F.when(F.col("whole"), F.try_variant_get("doc", "$.followers", "variant"))
    absent = named.isNull() | _is("VOID", named)
    no_document = F.when(~F.col("whole"), NO_JSON).when(F.col("list").isNull() & ~absent, NO_LIST)
    elements = parsed.withColumn("no_document", no_document).select(
        "alias",
        "no_document",
        F.when(F.col("no_document").isNotNull(), F.col("text")).alias("text"),
        F.posexplode_outer("list").alias("position", "element"),
    )
    elements = elements.where("position is not null or no_document is not null").withColumn("position", F.col("position").cast("bigint"))
    field = lambda name, kind: F.try_variant_get("element", f"$.{name}", kind)
    permalink = F.try_variant_get("element", "$.permalink", "variant")
    wrong = F.lit(None).cast("string")
    for name in reversed(_NUMBERS):
        value = F.try_variant_get("element", f"$.{name}", "variant")
        no_number = value.isNotNull() & ~_is("VOID", value) & ~_is("BIGINT", value)
        wrong = F.when(no_number, f"{name} is no number").otherwise(wrong)
    reason = (
        F.when(_is("STRING", permalink), wrong)  # what has a permalink is an object
        .when(F.col("element").isNull() | ~_is("OBJECT", F.col("element")), NO_OBJECT)
        .otherwise(NO_ALIAS)
    )
    checked = elements.withColumn("reason", F.coalesce("no_document", reason))
    struct = F.struct(*[field(f.name, f.dataType.simpleString()).alias(f.name) for f in schemas.FOLLOWER.fields])
    sound = F.col("reason").isNull()
    text = F.coalesce("text", F.when(~sound, F.to_json("element")))
    # parsed and checked once for both parts
    checked = written(checked.select("alias", "position", F.when(sound, struct).alias("follower"), text.alias("text"), "reason"), "elements")
    return checked.where(sound).select("alias", "position", "follower"), checked.where(~sound).select("alias", "position", "text", "reason")
