"""The project's baskets: one per coded segment; the record owns its baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.labels import dimension_of, framework_rows, label_key


def _owner(prefix: str) -> Column:
    """Record as text; a null record_id counts as one id of its own."""
    return F.concat_ws("#", F.lit(prefix), F.coalesce(F.col("record_id").cast("string"), F.lit("null")))


def _columns(scope: Column, items: Column) -> list[Column]:
    return [scope.alias("scope"), F.col("owner"), F.concat_ws("#", "owner", F.coalesce("pos", F.lit(-1))).alias("basket"), items.alias("items"), F.col("saved_at").alias("version"), F.col("saved_at"), F.col("received_at")]


def dimension_baskets(records: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Baskets of framework dimensions, one per entry of ``segments``.

    The basket id is record_id and the segment's position, since segment_id is unique
    only inside a record and may be null. Rows of one record_id give the same baskets. A
    record without segments or framework gives one basket without items, so that a later
    row of it withdraws what an earlier one held.
    """
    rows, fw = framework_rows(frameworks), F.col("_meta.framework_id")
    seg = records.select(fw.alias("fw"), _owner("r").alias("owner"), "saved_at", "received_at", F.posexplode_outer("segments.codes").alias("pos", "codes"))
    items = F.when(F.col("fw").isNotNull(), F.transform("codes", lambda c: dimension_of(rows, F.col("fw"), c["dimension"])))
    return seg.select(*_columns(F.col("fw"), items))


def label_baskets(open_records: DataFrame, codebooks: DataFrame) -> DataFrame:
    """Baskets of open-code labels in their codebook's spelling, one per entry of ``open_segments``.

    The label decides, code_id is not looked at. Labels that the record's codebook does
    not hold are no items; segments without items stay as baskets without items.
    """
    known = (
        codebooks.select(F.col("codebook_id").alias("scope"), F.explode("codes.label").alias("item"))
        .filter("item is not null").select("scope", label_key(F.col("item")).alias("key"), "item")
        .groupBy("scope", "key").agg(F.min("item").alias("item"))
    )
    seg = open_records.select(F.col("_meta.codebook_id").alias("scope"), _owner("o").alias("owner"), "saved_at", "received_at", F.posexplode_outer("open_segments.open_codes").alias("pos", "codes"))
    raw = seg.select("scope", "owner", "saved_at", "received_at", "pos", F.explode_outer(F.array_distinct(F.transform("codes", lambda c: label_key(c["label"])))).alias("key"))
    found = raw.join(known, ["scope", "key"], "left").groupBy("scope", "owner", "saved_at", "received_at", "pos").agg(F.collect_set("item").alias("items"))
    return found.select(*_columns(F.col("scope"), F.col("items")))
