"""Open coding: codebooks that grow, similar labels, merging, concentration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.labels import clean_label, clean_text, label_key

EXAMPLES = 8


def open_code_rows(open_records: DataFrame) -> DataFrame:
    """(record_id, codebook_id, seg_pos, code_pos, code_id, label, clean label, key) of every entry."""
    seg = open_records.select("record_id", F.col("_meta.codebook_id").alias("codebook_id"), "saved_at", F.posexplode("open_segments").alias("seg_pos", "s")).filter("s is not null")
    return seg.select("record_id", "codebook_id", "saved_at", "seg_pos", "s.quote", F.posexplode("s.open_codes").alias("code_pos", "c")).filter("c is not null").select(
        "record_id", "codebook_id", "saved_at", "seg_pos", "quote", "code_pos", "c.code_id", "c.label", clean_label(F.col("c.label")).alias("clean"), label_key(F.col("c.label")).alias("key"))


def absorb(rows: DataFrame) -> DataFrame:
    """Codebook replayed from raw labels: (codebook_id, code_no, label, count, first record), numbered by first appearance.

    The sequential book of the windows gives the same codes: a label is created the first
    time its key appears and reused later. Ranking is per codebook over its different keys
    only, which are pre-aggregated.
    """
    order = F.struct("saved_at", "record_id", "seg_pos", "code_pos")
    per = rows.filter("key is not null and key <> ''").groupBy("codebook_id", "key").agg(F.min(order).alias("first"), F.min_by("clean", order).alias("label"), F.count("*").alias("count"))
    w = Window.partitionBy("codebook_id").orderBy("first")
    return per.withColumn("code_no", F.row_number().over(w)).select("codebook_id", "code_no", F.format_string("c%03d", F.col("code_no")).alias("code_id"), "label", "count", F.col("first.record_id").alias("first_record"))


def codebook_stats(codebooks: DataFrame) -> DataFrame:
    """Per codebook: codes, applications, singletons, greatest count, codes without definition."""
    c = codebooks.select("codebook_id", F.explode_outer("codes").alias("c"))
    one = lambda x: F.sum(F.coalesce(x, F.lit(False)).cast("int"))
    return c.groupBy("codebook_id").agg(F.count("c.label").alias("codes"), F.coalesce(F.sum("c.count"), F.lit(0)).alias("applications"), one(F.col("c.count") == 1).alias("singletons"), F.max("c.count").alias("most"),
                                        one(F.col("c.label").isNotNull() & (F.coalesce(F.trim("c.definition"), F.lit("")) == "")).alias("undefined"))


def concentration(codebooks: DataFrame) -> DataFrame:
    """Share of the two most used codes and of singletons, per codebook."""
    c = codebooks.select("codebook_id", F.explode("codes").alias("c")).select("codebook_id", "c.label", F.coalesce("c.count", F.lit(0)).alias("n"))
    r = c.withColumn("r", F.row_number().over(Window.partitionBy("codebook_id").orderBy(F.desc("n"), "label")))
    return r.groupBy("codebook_id").agg(F.try_divide(F.sum(F.when(F.col("r") <= 2, F.col("n"))).cast("double"), F.sum("n").cast("double")).alias("top2"), F.avg((F.col("n") == 1).cast("double")).alias("singleton_share"))


def run_summary(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and range of a value over repeated runs."""
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.median(value).alias("median"), F.min(value).alias("low"), F.max(value).alias("high"))


def bigrams(c: Column) -> Column:
    """Set of character bigrams of the letters and digits of a text, lower case; one character is its own gram."""
    k = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    pairs = F.transform(F.sequence(F.lit(1), F.length(k) - 1), lambda i: k.substr(i, F.lit(2)))
    return F.when(F.length(k) == 0, F.array().cast("array<string>")).when(F.length(k) == 1, F.array(k)).otherwise(F.array_distinct(pairs))


def dice_pairs(labels: DataFrame, keys: list[str], label: str = "label", least: float = 0.5) -> DataFrame:
    """(keys, label_a, label_b, dice) of different labels with bigram Dice of at least ``least``, label_a < label_b.

    Exact by prefix filtering: with grams in order of rarity, two sets of Dice >= t share a
    gram among the first |s| - ceil(o) + 1 of each, o = t / (2 - t) * |s| being the least
    overlap that a set of this size needs. Only prefixes are joined, so frequent grams do
    not pair everything with everything; candidates are then checked on their whole sets.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be in (0, 1]")
    sets = labels.filter(F.col(label).isNotNull()).select(*keys, F.col(label).alias("label")).distinct().withColumn("grams", bigrams(F.col("label"))).filter(F.size("grams") > 0)
    freq = sets.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("f"))
    ranked = sets.select(*keys, "label", F.explode("grams").alias("g")).join(freq, "g").groupBy(*keys, "label").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("o"))
    need = F.ceil(F.size("o") * F.lit(least / (2 - least)) - F.lit(1e-9))
    prefix = ranked.select(*keys, "label", F.explode(F.slice("o", F.lit(1), (F.size("o") - need + 1).cast("int"))).alias("p"), F.transform("o", lambda x: x["g"]).alias("grams"))
    a = prefix.select(*keys, F.col("p.g").alias("g"), F.col("label").alias("label_a"), F.col("grams").alias("ga"))
    b = prefix.select(*keys, F.col("p.g").alias("g"), F.col("label").alias("label_b"), F.col("grams").alias("gb"))
    sa, sb = F.size("ga"), F.size("gb")
    cand = a.join(b, [*keys, "g"]).filter((F.col("label_a") < F.col("label_b")) & (2 * F.least(sa, sb) >= least * (sa + sb))).select(*keys, "label_a", "label_b", "ga", "gb").distinct()
    return cand.withColumn("dice", 2.0 * F.size(F.array_intersect("ga", "gb")) / (sa + sb)).filter(F.col("dice") >= least).drop("ga", "gb")


def grow_books(windows: DataFrame, coder: Callable[[str, list[dict]], list[dict]], book: str = "codebook_id", order: tuple[str, ...] = ("record_id", "chunk")) -> DataFrame:
    """Open coding in which every window sees the codes of those before it: one row per code given.

    ``windows``: ``book``, the ``order`` columns and text. ``coder(text, codes)`` gets the book so
    far (label, definition, count in order of creation) and returns segments with
    ``open_codes`` (label, definition). Result: book, order columns, seg_pos, code_pos,
    quote, code_id, label, created, error. A label is the code of the first label with its
    key; a window whose coder fails keeps one row with the error. A book's windows depend
    on one another, so a book is one task; its texts pass through in batches, what is held
    is the book.
    """
    keys = [book, *order]
    slim = windows.select(*keys, "text")
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    names = [*keys, "seg_pos", "code_pos", "quote", "code_id", "label", "created", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books: dict = {}
        now = None
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                if row[0] != now:
                    now, books = row[0], {}
                given = [dict(c) for c in books.values()]
                try:
                    segments = coder(row[-1], given)
                except Exception as e:  # noqa: BLE001
                    out.append((*row[:-1], None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                for i, segment in enumerate(segments):
                    for j, c in enumerate(segment.get("open_codes") or []):
                        label = clean_text(c.get("label"))
                        if not label:
                            continue
                        known = books.get(label.lower())
                        if known is None:
                            books[label.lower()] = known = {"code_id": f"c{len(books) + 1:03d}", "label": label, "definition": c.get("definition") or "", "count": 0}
                        known["count"] += 1
                        out.append((*row[:-1], i, j, segment.get("quote"), known["code_id"], known["label"], known["count"] == 1, None))
            yield pd.DataFrame(out, columns=names)

    ordered = slim.repartition(F.col(book)).sortWithinPartitions(*keys)
    return ordered.mapInPandas(run, f"{head}, seg_pos int, code_pos int, quote string, code_id string, label string, created boolean, error string")


def merge_codes(codes: DataFrame, mapping: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(codebook_id, label, count, merged_from[, examples]) after mapping (codebook_id, label, into).

    Counts add up; of the examples, where ``codes`` has them, the first ``examples`` are
    kept, those of the code that stays before those of the codes merged into it.
    """
    m = codes.join(mapping, ["codebook_id", "label"], "left").withColumn("target", F.coalesce("into", "label"))
    agg = [F.sum("count").alias("count"), F.array_sort(F.collect_set(F.when(F.col("into").isNotNull(), F.col("label")))).alias("merged_from")]
    if "examples" in codes.columns:
        parts = F.array_sort(F.collect_list(F.struct(F.col("into").isNotNull().alias("o"), "label", F.slice(F.coalesce("examples", F.array().cast(codes.schema["examples"].dataType)), 1, examples).alias("e"))))
        agg.append(F.slice(F.flatten(F.transform(parts, lambda x: x["e"])), 1, examples).alias("examples"))
    return m.groupBy("codebook_id", F.col("target").alias("label")).agg(*agg)


def rewrite_labels(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Labels of records after a merge; a label counts once per segment."""
    m = rows.join(mapping, ["codebook_id", "label"], "left").withColumn("label", F.coalesce("into", "label")).drop("into")
    return m.dropDuplicates(["record_id", "codebook_id", "seg_pos", "label"])


def accept_all(codes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Greedy acceptance of suggested merges: (codebook_id, label, into).

    Pairs from the most similar on; the label with the greater current count stays. Order
    matters, so a codebook is folded as a whole (one codebook's pairs, not the corpus).
    """
    rows = pairs.select("codebook_id", "label_a", "label_b", "dice")
    counts = codes.groupBy("codebook_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "count"))).alias("counts"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        count = dict(pdf["counts"].iloc[0])
        into: dict[str, str] = {}

        def root(x: str) -> str:
            while x in into:
                x = into[x]
            return x

        for r in pdf.sort_values(["dice", "label_a", "label_b"], ascending=[False, True, True]).itertuples():
            a, b = root(r.label_a), root(r.label_b)
            if a == b:
                continue
            keep, gone = (a, b) if count.get(a, 0) >= count.get(b, 0) else (b, a)
            into[gone] = keep
            count[keep] = count.get(keep, 0) + count.get(gone, 0)
        return pd.DataFrame([(pdf["codebook_id"].iloc[0], x, root(x)) for x in sorted(into)], columns=["codebook_id", "label", "into"])

    return rows.join(counts, "codebook_id").groupBy("codebook_id").applyInPandas(one, "codebook_id string, label string, into string")


def drop_rare(codes: DataFrame, least: int = 2) -> DataFrame:
    """Codes used at least ``least`` times."""
    return codes.filter(F.col("count") >= least)


def prompt_codes(codes: DataFrame, n: int = 60) -> DataFrame:
    """The most used codes of every codebook (a top-k list), ties by number."""
    w = Window.partitionBy("codebook_id").orderBy(F.desc("count"), "code_no")
    return codes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def to_framework(codes: DataFrame) -> DataFrame:
    """Codebook as a framework table without polarity: (framework_id, dim_ord, dimension, short_code, label_en); without any code it is refused."""
    if codes.isEmpty():
        raise ValueError("no code is left to make a framework of")
    return codes.select(F.col("codebook_id").alias("framework_id"), (F.col("code_no") - 1).alias("dim_ord"), F.regexp_replace(F.lower("label"), r"[^\p{L}\p{N}]+", "_").alias("dimension"), F.upper(F.col("code_id")).alias("short_code"), F.col("label").alias("label_en"))


def map_to_reference(uses: DataFrame, reference: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Open codes (unit_id, label) against reference dimensions (unit_id, dimension), per label.

    mapped: one dimension in more than half of the units; outside: no unit has a dimension;
    else mixed; unlocated: in no unit at all, for the labels of ``codes`` where given.
    Of equally common dimensions the first by name.
    """
    units = uses.filter("unit_id is not null and label is not null").select("unit_id", "label").distinct()
    shared = units.join(reference.filter("dimension is not null").select("unit_id", "dimension").distinct(), "unit_id", "left")
    top = shared.filter("dimension is not null").groupBy("label", "dimension").agg(F.count("*").alias("n")).groupBy("label").agg(F.min(F.struct((-F.col("n")).alias("n"), "dimension")).alias("top"))
    out = units.groupBy("label").agg(F.count("*").alias("units")).join(top, "label", "left")
    if codes is not None:
        out = codes.select("label").filter("label is not null").distinct().join(out, "label", "left")
    kind = F.when(F.col("units").isNull(), "unlocated").when(F.col("top").isNull(), "outside").when(-F.col("top.n") / F.col("units") > 0.5, "mapped").otherwise("mixed")
    return out.select("label", kind.alias("kind"), F.when(kind == "mapped", F.col("top.dimension")).alias("dimension"))
