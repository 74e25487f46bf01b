"""Themes over first-order items, and clusters of codes."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.distributed import running

#: Most codes that are clustered as a whole (a codebook or framework, not a corpus).
MAX_CODES = 5_000


def theme_table(members: DataFrame, items: DataFrame) -> DataFrame:
    """Per theme: items, respondents, thin (fewer than two respondents), first quote. ``members``: theme_id, global_id; unknown ids are dropped."""
    x = members.select("theme_id", "global_id").distinct().join(items, "global_id")
    return x.groupBy("theme_id").agg(F.count("*").alias("items"), F.countDistinct("respondent").alias("respondents"), F.min_by("quote", "global_id").alias("exemplar")).withColumn("thin", F.col("respondents") < 2)


def theme_case_matrix(members: DataFrame, items: DataFrame) -> DataFrame:
    """(theme_id, respondent, n) of the cells that occur."""
    return members.select("theme_id", "global_id").distinct().join(items, "global_id").groupBy("theme_id", "respondent").agg(F.count("*").alias("n"))


def support(matrix: DataFrame, items: DataFrame) -> DataFrame:
    """Respondents per theme and their share of all respondents."""
    people = items.agg(F.countDistinct("respondent").alias("all")).withColumn("one", F.lit(1))
    g = matrix.groupBy("theme_id").agg(F.count("*").alias("respondents")).withColumn("one", F.lit(1))
    return g.join(people, "one").select("theme_id", "respondents", (F.col("respondents") / F.col("all")).alias("support_rate"))


def theme_by_code(members: DataFrame, items: DataFrame) -> DataFrame:
    """(theme_id, code, n) over the items' existing codes."""
    return members.select("theme_id", "global_id").distinct().join(items, "global_id").select("theme_id", F.explode("existing_codes").alias("code")).groupBy("theme_id", "code").agg(F.count("*").alias("n"))


def unassigned(members: DataFrame, items: DataFrame) -> DataFrame:
    """Items in no theme."""
    return items.join(members.select("global_id").distinct(), "global_id", "left_anti")


def renumber(themes: DataFrame, dimension_order: list[str]) -> DataFrame:
    """Themes T01.. by dimension order, then id; themes of other dimensions last."""
    order = F.array(*[F.lit(d) for d in dimension_order])
    pos = F.array_position(order, F.coalesce("aggregate_dimension", F.lit("")))
    return themes.withColumn("new_id", F.format_string("T%02d", F.row_number().over(Window.orderBy(F.when(pos == 0, 10**6).otherwise(pos), "theme_id"))))


def merged_members(merges: DataFrame, batches: DataFrame) -> DataFrame:
    """(theme_id, global_id, ord): members of final themes through the provisional numbers they were merged from.

    Numbers that no provisional theme has are dropped; an id keeps its first place.
    """
    x = merges.select("theme_id", F.posexplode("merged_from").alias("m", "number")).join(batches.select("number", F.posexplode("member_ids").alias("k", "global_id")), "number")
    return x.groupBy("theme_id", "global_id").agg(F.min(F.struct("m", "k")).alias("o")).withColumn("ord", F.row_number().over(Window.partitionBy("theme_id").orderBy("o"))).drop("o")


def cluster(codes: list[tuple[str, float]], distance: dict[tuple[str, str], float], k: int | None = None, limit: float = 0.85) -> list[list[str]]:
    """Average-linkage clusters of at most MAX_CODES codes: merged until ``k`` remain or the mean distance exceeds ``limit``.

    Ties go to the first pair in the current order; a merged cluster goes to the end. Pairs
    without a distance are 1 apart. Result by summed weight, then first name.
    """
    if len(codes) > MAX_CODES:
        raise ValueError(f"more than {MAX_CODES} codes")
    weight = dict(codes)
    names = [c for c, _ in codes]
    groups: list[list[str]] = [[c] for c in names]
    d = lambda a, b: distance.get((a, b), distance.get((b, a), 1.0))
    # mean distances between groups, kept up to date by the weighted average of the merged ones
    mean = {(i, j): d(groups[i][0], groups[j][0]) for i in range(len(groups)) for j in range(i + 1, len(groups))}
    alive = list(range(len(groups)))
    while len(alive) > max(1, k or 1):
        (i, j), v = min(((p, mean[p]) for a, x in enumerate(alive) for p in ((x, y) for y in alive[a + 1 :])), key=lambda t: t[1])
        if k is None and v > limit:
            break
        new = len(groups)
        groups.append(groups[i] + groups[j])
        alive = [x for x in alive if x not in (i, j)]
        m = lambda a, b: mean[a, b] if (a, b) in mean else mean[b, a]
        for x in alive:
            mean[x, new] = (len(groups[i]) * m(x, i) + len(groups[j]) * m(x, j)) / len(groups[new])
        alive.append(new)
    out = [groups[x] for x in alive]
    return sorted(out, key=lambda g: (-sum(weight.get(c, 0) for c in g), g[0]))


def cluster_codes(codes: DataFrame, distances: DataFrame, group: str, k: int | None = None, limit: float = 0.85) -> DataFrame:
    """(group, cluster, code) per ``group`` (a codebook): codes (group, code, weight), distances (group, code_a, code_b, distance).

    One codebook is one task; it holds at most MAX_CODES codes.
    """
    pairs = distances.groupBy(group).agg(F.collect_list(F.struct("code_a", "code_b", "distance")).alias("pairs"))
    kind = codes.schema[group].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("code")
        raw = pdf["pairs"].iloc[0]
        dist = {(p["code_a"], p["code_b"]): p["distance"] for p in (raw if raw is not None else [])}
        clusters = cluster(list(zip(pdf["code"], pdf["weight"])), dist, k, limit)
        return pd.DataFrame([(pdf[group].iloc[0], i, c) for i, g in enumerate(clusters) for c in g], columns=[group, "cluster", "code"])

    return codes.select(group, "code", "weight").join(pairs, group, "left").groupBy(group).applyInPandas(one, f"`{group}` {kind}, cluster int, code string")


def cluster_dimension(clusters: DataFrame, code_dimension: DataFrame) -> DataFrame:
    """Suggested dimension per cluster: the only one its codes have, else null."""
    x = clusters.join(code_dimension, "code", "left").groupBy("cluster").agg(F.collect_set("dimension").alias("d"))
    return x.select("cluster", F.when(F.size("d") == 1, F.col("d")[0]).alias("dimension"))


def first_order_items(long: DataFrame) -> DataFrame:
    """Segments as items (global_id, respondent, segment_id, quote, existing_codes), numbered by record and position."""
    seg = long.groupBy("record_id", "seg_pos").agg(F.first("respondent").alias("respondent"), F.first("segment_id").alias("segment_id"), F.first("quote").alias("quote"), F.array_sort(F.collect_set("code")).alias("existing_codes"))
    return running(seg, ["record_id", "seg_pos"], number="__no").withColumn("global_id", F.format_string("G%04d", F.col("__no"))).drop("__no")


def induce(items: DataFrame, generate: Callable[[list[dict]], list[dict]], batch: int = 60, done: DataFrame | None = None) -> DataFrame:
    """Provisional themes per batch of items from an injected generator: (batch, themes JSON, error). Batches in ``done`` are skipped."""
    numbered = running(items, ["global_id"], number="__no").withColumn("batch", F.floor((F.col("__no") - 1) / batch).cast("int")).drop("__no")
    if done is not None:
        numbered = numbered.join(done.select("batch").distinct(), "batch", "left_anti")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            out, error = json.dumps(generate(pdf.sort_values("global_id")[["global_id", "quote"]].to_dict("records")), ensure_ascii=False), None
        except Exception as e:  # noqa: BLE001
            out, error = None, f"{type(e).__name__}: {e}"
        return pd.DataFrame([(int(pdf["batch"].iloc[0]), out, error)], columns=["batch", "themes", "error"])

    return numbered.select("batch", "global_id", "quote").groupBy("batch").applyInPandas(one, "batch int, themes string, error string")


def contract_verdict(answers: DataFrame) -> DataFrame:
    """Share of conforming answers (the first per id counts) and verdict: ok from .9, shaky from .6, else failing."""
    first = answers.groupBy("id").agg(F.min_by("conforming", "ord").alias("c"))
    r = first.agg(F.avg(F.col("c").cast("double")).alias("rate"))
    return r.withColumn("verdict", F.when(F.col("rate") >= 0.9, "ok").when(F.col("rate") >= 0.6, "shaky").otherwise("failing"))


#: Fixed value: the smallest batch of items that makes sense.
SMALLEST_BATCH = 5


def fit_batch(sizes: list[int], room: int | None, start: int = 60) -> int | None:
    """Largest batch (steps of ten down to 20, then of five) whose longest run of items fits in ``room`` tokens; null where not even five fit, ``start`` without a limit."""
    if room is None or not sizes:
        return start
    steps = [*range(start, 20, -10), *range(min(start, 20 if start > 20 else start), SMALLEST_BATCH - 1, -5)]
    return next((n for n in steps if all(sum(sizes[i : i + n]) <= room for i in range(0, len(sizes), n))), None)


def aggregate(provisional: DataFrame, generate: Callable[[list[dict]], list[dict]], dimensions: list[str]) -> tuple[DataFrame, DataFrame]:
    """Stage 2: final themes from provisional ones (batch, name, member_ids) by an injected generator.

    The generator gets all provisional themes (as many as stage 1 makes of a study; more than
    ``MAX_CODES`` are refused) and returns themes with ``merged_from``. Result: (themes,
    members): themes as :func:`migrate_themes` leaves them with their number; members
    (theme_id, global_id) through ``merged_from``. Provisional ids: P001 in order of batch
    and name.
    """
    rows = provisional.orderBy("batch", "name").limit(MAX_CODES + 1).collect()
    if len(rows) > MAX_CODES:
        raise ValueError(f"more than {MAX_CODES} provisional themes")
    given = [{"provisional_id": f"P{i:03d}", "name": r["name"], "member_ids": list(r.member_ids or [])} for i, r in enumerate(rows, 1)]
    members = {g["provisional_id"]: g["member_ids"] for g in given}
    final = [migrate_theme(t, i, dimensions) for i, t in enumerate(generate(given), 1)]
    spark = provisional.sparkSession
    themes = spark.createDataFrame([tuple(t[k] for k in THEME_FIELDS) for t in final], THEME_SCHEMA)
    pairs = [(t["theme_id"], m) for t in final for m in dict.fromkeys([*t["member_ids"], *(m for p in t["merged_from"] for m in members.get(p, []))])]
    return themes, spark.createDataFrame(pairs, "theme_id string, global_id string")


#: Fields of themes, their earlier names, and the values of two of them.
THEME_FIELDS = ("theme_id", "theme_name", "theme_definition", "aggregate_dimension", "dimension_rationale", "frame_relation", "polarity_tendency", "member_ids", "merged_from")
THEME_SCHEMA = ", ".join(f"{f} {'array<string>' if f in ('member_ids', 'merged_from') else 'string'}" for f in THEME_FIELDS)
EARLIER = {"theme_id": "主題ID", "theme_name": "主題名稱", "theme_definition": "主題定義", "aggregate_dimension": "聚合維度", "dimension_rationale": "維度歸屬理由", "frame_relation": "框架關係", "polarity_tendency": "極性傾向", "member_ids": "構成ID", "merged_from": "合併自"}
RELATIONS = {"aligned": "aligned", "extends": "extends", "contradicts": "contradicts", "吻合": "aligned", "延伸": "extends", "矛盾": "contradicts"}
TENDENCIES = {"P": "P", "N": "N", "mixed": "mixed", "混合": "mixed"}


def migrate_theme(raw: dict | None, number: int, dimensions: list[str], aliases: dict[str, str] | None = None) -> dict:
    """A theme of any shape in the present one: unknown dimensions become unassigned, unknown relations aligned, unknown tendencies mixed, a missing id its number. Idempotent."""
    get = lambda k, d: (raw or {}).get(k, (raw or {}).get(EARLIER[k], d))
    dimension = (aliases or {}).get(get("aggregate_dimension", ""), get("aggregate_dimension", ""))
    return {
        "theme_id": get("theme_id", None) or f"T{number:02d}", "theme_name": get("theme_name", (raw or {}).get("name", "")), "theme_definition": get("theme_definition", (raw or {}).get("definition", "")),
        "aggregate_dimension": dimension if dimension in dimensions else "unassigned", "dimension_rationale": get("dimension_rationale", ""),
        "frame_relation": RELATIONS.get(get("frame_relation", ""), "aligned"), "polarity_tendency": TENDENCIES.get(get("polarity_tendency", ""), "mixed"),
        "member_ids": list(get("member_ids", None) or []), "merged_from": list(get("merged_from", None) or [])}


def migrate_themes(rows: DataFrame, dimensions: list[str], aliases: dict[str, str] | None = None, theme: str = "theme") -> DataFrame:
    """Adds the fields of :func:`migrate_theme` to rows with a theme's JSON (``theme``) and its number in its set (``number``)."""

    @F.pandas_udf(THEME_SCHEMA)
    def run(t: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for x, k in zip(t, n):
            try:
                raw = json.loads(x) if x else {}
            except ValueError:
                raw = {}
            out.append(migrate_theme(raw if isinstance(raw, dict) else {}, int(k), dimensions, aliases))
        return pd.DataFrame(out, columns=list(THEME_FIELDS))

    return rows.withColumn("__t", run(F.col(theme), F.col("number"))).select("*", "__t.*").drop("__t")


def themes_json(rows: DataFrame) -> DataFrame:
    """(batch, name, member_ids) from the generator's JSON."""
    shape = "array<struct<name:string,member_ids:array<string>>>"
    return rows.filter("themes is not null").select("batch", F.explode(F.from_json("themes", shape)).alias("t")).select("batch", "t.*")


