"""Sinks: merged JSON, tables of a report, provenance, forked copies, session ids, highlighted files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_payload(records: DataFrame) -> DataFrame:
    """(record_id, json): each record as JSON without fields that start with an underscore, except _meta."""
    keep = [c for c in records.columns if not c.startswith("_") or c == "_meta"]
    return records.select("record_id", F.to_json(F.struct(*keep)).alias("json"))


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Every sheet of a report as a table of its own below ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{path}/{name}")


def save_records(records: DataFrame, path: str) -> None:
    """Records as JSON lines by framework; an existing folder is not overwritten."""
    records.withColumn("framework", F.coalesce("_meta.framework_id", F.lit("none"))).write.mode("errorifexists").partitionBy("framework").json(path)


def with_meta(records: DataFrame, **values: str) -> DataFrame:
    """Records with fields of ``_meta`` set; its other fields stay, a null ``_meta`` gets these alone."""
    have = {f.name for f in records.schema["_meta"].dataType.fields}
    unknown = set(values) - have
    if unknown:
        raise ValueError(f"_meta has no {sorted(unknown)}")
    fields = [(F.lit(values[n]).cast(f.dataType) if n in values else F.col(f"_meta.{n}")).alias(n) for f in records.schema["_meta"].dataType.fields for n in (f.name,)]
    return records.withColumn("_meta", F.struct(*fields))


def fork(records: DataFrame, new_base: int) -> DataFrame:
    """Copies of reference records under new ids that name their origin."""
    return records.withColumn("derived_from", F.col("record_id")).withColumn("record_id", F.col("record_id") + F.lit(new_base))


def unique_names(records: DataFrame, name: Column) -> DataFrame:
    """File names: the cleaned name, numbered from the second of one name on."""
    from pyspark.sql import Window

    base = F.regexp_replace(F.coalesce(name, F.lit("record")), r"[^\p{L}\p{N}_-]+", "_")
    n = F.row_number().over(Window.partitionBy("__base").orderBy("record_id"))
    return records.withColumn("__base", base).withColumn("file_name", F.when(n == 1, F.concat("__base", F.lit(".json"))).otherwise(F.concat("__base", F.lit("_"), n, F.lit(".json")))).drop("__base")


def session_id(unit_ids: Column, seed: Column) -> Column:
    """Eight hex digits of the MD5 of the ids' JSON array and the seed."""
    quoted = F.transform(unit_ids, lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    return F.substring(F.md5(F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"), seed.cast("string"))), 1, 8)


def provenance(records: DataFrame) -> DataFrame:
    """(record_id, key, value) of how each record came about; 'not recorded' where nothing is known."""
    fields = {"framework": "_meta.framework_id", "source": "_meta.source", "coded_at": "_meta.coded_at", "endpoint": "_meta.endpoint.endpoint", "model": "_meta.endpoint.model", "locality": "_meta.endpoint.data_locality", "windows": "_meta.chunking.n_chunks"}
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.col(c).cast("string"), F.lit("not recorded")).alias("value")) for k, c in fields.items()])
    return records.select("record_id", F.explode(rows).alias("p")).select("record_id", "p.*")


def endpoint_rows(records: DataFrame) -> DataFrame:
    """Endpoints in use with their record counts."""
    e = lambda c: F.coalesce(F.col(f"_meta.endpoint.{c}"), F.lit("not recorded")).alias(c)
    return records.select(e("endpoint"), e("provider"), e("model"), e("data_locality")).groupBy("endpoint", "provider", "model", "data_locality").agg(F.count("*").alias("records"))


def highlighted(docs: DataFrame, pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, content): a Word file per document with its pieces (start_pos, end_pos, colour) highlighted."""
    per = pieces.groupBy(key).agg(F.collect_list(F.struct("start_pos", "end_pos", "colour")).alias("pieces"))
    rows = docs.select(key, "text").join(per, key, "left")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from codeloom.sources.docx import write_docx

        for b in batches:
            out = [write_docx(t or "", [(x["start_pos"], x["end_pos"], x["colour"]) for x in p or []]) for t, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[key, "content"])

    return rows.mapInArrow(run, f"`{key}` {kind}, content binary")


def structure_svg(columns: list[tuple[str, list[str]]], width: int = 900, font: int = 15) -> str:
    """Data structure drawing: one column of wrapped boxes per (title, entries); wide characters count double."""
    from xml.sax.saxutils import escape

    def wrap(text: str, room: int) -> list[str]:
        lines, line, used = [], "", 0
        for ch in text:
            w = 2 if ord(ch) > 0x2E7F else 1
            if used + w > room:
                lines.append(line)
                line, used = "", 0
            line, used = line + ch, used + w
        return [*lines, line] if line else lines or [""]

    each, out, height = width // max(1, len(columns)), [], 0
    for i, (title, entries) in enumerate(columns):
        x, y = i * each + 10, 30
        out.append(f'<text x="{x}" y="{y}" font-size="{font + 3}" font-weight="bold">{escape(title)}</text>')
        for e in entries:
            lines = wrap(e, int((each - 40) / (font * 0.56)))
            h = len(lines) * (font + 5) + 10
            out.append(f'<rect x="{x}" y="{y + 10}" width="{each - 20}" height="{h}" fill="none" stroke="#555" rx="4"/>')
            out += [f'<text x="{x + 8}" y="{y + 12 + (font + 5) * (k + 1) - 4}" font-size="{font}">{escape(t)}</text>' for k, t in enumerate(lines)]
            y += h + 14
        height = max(height, y + 30)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif">{"".join(out)}</svg>'
