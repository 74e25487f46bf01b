"""Items that appear together: a persistent, incremental pair table.

A folder holds five parquet tables, each in hash buckets whose files are replaced bucket by
bucket: ``owners`` (what each owner's baskets held last, and of which version), ``pairs``,
``items`` and ``scopes`` (counts), and ``scores``. A manifest per version names the current
files; it is written last, so a batch counts wholly or not at all, and opening the folder
again goes on where it was left. The version of a manifest can be written once: of two
writers one fails.

A batch is compared with the stored rows of the buckets it falls in. Only owners that
changed emit signed deltas (-1 for what their baskets held, +1 for what they hold), which
are pre-aggregated and merged into the buckets they fall in. Scores are recomputed for the
scopes touched since they were last asked for; those of other scopes stay as stored.

Defined results
---------------
* An item counts once per basket; null items and baskets without items count nowhere.
* Baskets belong to an owner (column ``owner``; a basket without that column is its own
  owner). A row of an owner with a later ``version`` replaces all its baskets, those it no
  longer names are withdrawn; earlier rows change nothing, whenever they arrive. Of equal
  versions the greater baskets hold. Null versions are the earliest, null baskets are left
  out, a null owner counts as one.
* Ratio of a pair: n_ab * N / (n_a * n_b), N the scope's baskets with at least one item.
* Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import scratch_path, small

#: Rows that a bucket should hold; their number is fixed when the table is made.
BUCKET_ROWS, MOST_BUCKETS = 1_000_000, 4_096
KEYS = {"owners": ["owner"], "pairs": ["scope", "item_a", "item_b"], "items": ["scope", "item"], "scopes": ["scope"], "scores": ["scope", "item_a", "item_b"]}
SCHEMAS = {
    "owners": "owner string, version {version}, baskets array<struct<basket:string,scope:string,items:array<string>>>",
    "pairs": "scope string, item_a string, item_b string, n bigint", "items": "scope string, item string, n bigint", "scopes": "scope string, n bigint",
    "scores": "scope string, item_a string, item_b string, n_ab bigint, n_a bigint, n_b bigint, n_all bigint, ratio double"}


class PairTable:
    """Persistent, bucketed counts of items and pairs per scope; see the module."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        self.spark, self.path = spark, (path or scratch_path(spark, "pairs")).rstrip("/")
        self.state = {"version": 0, "buckets": buckets, "type": None, "files": {t: {} for t in KEYS}, "stale": []}
        root = self._path(self.path)
        self.fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if self.fs.exists(root):
            names = [f.getPath().getName() for f in self.fs.listStatus(root)]
            last = max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)
            if last:
                self.state = json.loads(spark.read.text(f"{self.path}/manifest-{last}.json", wholetext=True).first()[0])

    @property
    def version(self) -> int:
        """Number of the last change."""
        return self.state["version"]

    def _path(self, path: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _commit(self, state: dict) -> None:
        """Make ``state`` the current one."""
        state["version"] = self.version + 1
        out = self.fs.create(self._path(f"{self.path}/manifest-{state['version']}.json"), False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self.state = state

    def _next(self) -> dict:
        return json.loads(json.dumps(self.state))

    def vacuum(self) -> None:
        """Delete the files and manifests that the current version does not use."""
        used = {p for files in self.state["files"].values() for p in files.values()} | set(self.state["stale"])
        for f in self.fs.listStatus(self._path(self.path)):
            name = f.getPath().getName()
            if name.startswith("manifest-"):
                if name != f"manifest-{self.version}.json":
                    self.fs.delete(f.getPath(), True)
            elif not any(p.split("/")[0] == name for p in used):
                self.fs.delete(f.getPath(), True)
            else:
                for b in self.fs.listStatus(f.getPath()):
                    at = f"{name}/{b.getPath().getName()}"
                    if b.isDirectory() and at not in used and name not in used:
                        self.fs.delete(b.getPath(), True)

    def _schema(self, table: str, state: dict) -> str:
        return SCHEMAS[table].format(version=state["type"])

    def _bucket(self, table: str, state: dict) -> Column:
        return F.pmod(F.xxhash64(*KEYS[table]), F.lit(state["buckets"])).cast("int")

    def read(self, table: str, only: set[int] | None = None, state: dict | None = None) -> DataFrame:
        """Current rows of a table, or of some of its buckets."""
        state = state or self.state
        paths = [f"{self.path}/{p}" for b, p in sorted(state["files"][table].items()) if only is None or int(b) in only]
        schema = self._schema(table, state) if state["type"] else SCHEMAS[table].format(version="string")
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _store(self, state: dict, table: str, df: DataFrame) -> None:
        """Replace the buckets that ``df`` has rows for. A bucket is written by several tasks where there are more tasks than buckets."""
        at = f"{table}-{uuid.uuid4().hex}"
        tasks = max(state["buckets"], int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        salt = F.pmod(F.xxhash64(F.lit(1), *KEYS[table]), F.lit(-(-tasks // state["buckets"])))
        df.withColumn("bucket", self._bucket(table, state)).repartition(tasks, "bucket", salt).write.partitionBy("bucket").parquet(f"{self.path}/{at}")
        for f in self.fs.listStatus(self._path(f"{self.path}/{at}")):
            name = f.getPath().getName()
            if name.startswith("bucket="):
                state["files"][table][name.split("=")[1]] = f"{at}/{name}"

    def _touched(self, state: dict, table: str, df: DataFrame) -> set[int]:
        """Buckets that the rows of ``df`` fall in: at most ``MOST_BUCKETS`` numbers."""
        return {r.b for r in df.select(self._bucket(table, state).alias("b")).distinct().collect()}

    def _merge(self, state: dict, table: str, deltas: DataFrame) -> None:
        """Add signed deltas to the counts of the buckets they fall in; zero counts stay as rows, so that an emptied bucket is replaced, too."""
        if state["files"][table]:
            stored = self.read(table, self._touched(state, table, deltas), state)
            deltas = stored.unionByName(deltas).groupBy(*KEYS[table]).agg(F.sum("n").alias("n"))
        self._store(state, table, deltas)

    def _log(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        at = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{at}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{at}"), at

    @staticmethod
    def _owners(batch: DataFrame) -> DataFrame:
        """(owner, version, baskets) of a batch: the baskets of each owner's latest rows, those with items."""
        owner = F.coalesce(F.col("owner" if "owner" in batch.columns else "basket").cast("string"), F.lit(""))
        items = F.array_sort(F.array_distinct(F.filter(F.col("items"), lambda x: x.isNotNull())))
        one = F.struct("version", F.col("basket").cast("string").alias("basket"), F.coalesce("scope", F.lit("")).alias("scope"), F.coalesce(items, F.array().cast("array<string>")).alias("items"))
        got = batch.select(owner.alias("owner"), one.alias("b")).groupBy("owner").agg(F.max(F.struct("b.version")).alias("v"), F.collect_set("b").alias("all"))
        latest = F.array_sort(F.filter("all", lambda x: x["version"].eqNullSafe(F.col("v.version")) & x["basket"].isNotNull()))
        # Of one basket twice in a version the greater one.
        single = F.filter(latest, lambda x, i: ~F.coalesce(F.try_element_at(latest, i + 2)["basket"] == x["basket"], F.lit(False)))
        slim = F.transform(F.filter(single, lambda x: F.size(x["items"]) > 0), lambda x: F.struct(x["basket"].alias("basket"), x["scope"].alias("scope"), x["items"].alias("items")))
        return got.select("owner", F.col("v.version").alias("version"), slim.alias("baskets"))

    def apply(self, batch: DataFrame) -> DataFrame:
        """Take a batch (scope, basket, items, version and possibly owner); returns the scopes it touched."""
        state = self._next()
        state["type"] = state["type"] or batch.schema["version"].dataType.simpleString()
        new, none = self._owners(batch), F.array().cast("array<struct<basket:string,scope:string,items:array<string>>>")
        if state["files"]["owners"]:
            # A batch that reaches a part of the buckets reads that part only.
            new, _ = self._log(new, "batch")
            old = self.read("owners", self._touched(state, "owners", new), state).select("owner", F.col("version").alias("old_version"), F.col("baskets").alias("old"), F.lit(True).alias("known"))
            later = F.struct("version", "baskets") > F.struct(F.col("old_version").alias("version"), F.col("old").alias("baskets"))
            new = new.join(old, "owner", "left").filter(F.col("known").isNull() | later).select("owner", "version", "baskets", F.coalesce("old", none).alias("old"))
        else:
            new = new.select("owner", "version", "baskets", none.alias("old"))
        changed, _ = self._log(new, "changes")
        if state["buckets"] is None:
            state["buckets"] = min(MOST_BUCKETS, max(8, 1 << (changed.count() // BUCKET_ROWS).bit_length()))
        sides = F.array(F.struct(F.col("baskets").alias("b"), F.lit(1).cast("bigint").alias("n")), F.struct(F.col("old").alias("b"), F.lit(-1).cast("bigint").alias("n")))
        signed = changed.filter("baskets <> old").select(F.explode(sides).alias("d")).select(F.explode("d.b").alias("b"), "d.n").select("b.scope", "b.items", "n")
        total = F.sum("n").alias("n")
        # Item by item with those after it, so that no row holds all pairs of a basket.
        firsts = signed.filter("size(items) > 1").select("scope", "n", "items", F.posexplode("items").alias("i", "item_a"))
        pairs = firsts.select("scope", "n", "item_a", F.explode(F.expr("slice(items, i + 2, size(items))")).alias("item_b"))
        self._merge(state, "pairs", pairs.groupBy(*KEYS["pairs"]).agg(total).filter("n <> 0"))
        self._merge(state, "items", signed.select("scope", "n", F.explode("items").alias("item")).groupBy("scope", "item").agg(total).filter("n <> 0"))
        self._merge(state, "scopes", signed.groupBy("scope").agg(total).filter("n <> 0"))
        rows = changed.select("owner", "version", "baskets")
        if state["files"]["owners"]:
            kept = self.read("owners", self._touched(state, "owners", rows), state).join(rows.select("owner"), "owner", "left_anti")
            rows = kept.unionByName(rows)
        self._store(state, "owners", rows)
        touched, at = self._log(signed.select("scope").distinct(), "touched")
        state["stale"].append(at)
        self._commit(state)
        return touched

    def scores(self, touched: DataFrame | None = None) -> DataFrame:
        """Pairs with counts and ratio; with ``touched`` only of those scopes.

        Those of the scopes touched since the last call are recomputed and stored first.
        """
        if self.state["stale"]:
            state = self._next()
            stale = small(self.spark.read.schema("scope string").parquet(*[f"{self.path}/{p}" for p in state["stale"]]).distinct())
            pairs, items, scopes = (self.read(t).filter("n > 0") for t in ("pairs", "items", "scopes"))
            items, scopes = items.join(stale, "scope", "left_semi"), scopes.join(stale, "scope", "left_semi")
            n = lambda name: F.col("n").alias(name)
            ratio = F.col("n_ab") * F.col("n_all").cast("double") / (F.col("n_a").cast("double") * F.col("n_b"))
            fresh = (
                pairs.select("scope", "item_a", "item_b", n("n_ab")).join(stale, "scope", "left_semi")
                .join(small(items.select("scope", F.col("item").alias("item_a"), n("n_a"))), ["scope", "item_a"])
                .join(small(items.select("scope", F.col("item").alias("item_b"), n("n_b"))), ["scope", "item_b"])
                .join(small(scopes.select("scope", n("n_all"))), "scope")
                .select(*KEYS["scores"], "n_ab", "n_a", "n_b", "n_all", ratio.alias("ratio"))
            )
            if state["files"]["scores"]:
                # Every bucket that holds a row of these scopes is written anew, also where no pair is left.
                stored = self.read("scores")
                hit = self._touched(state, "scores", stored.join(stale, "scope", "left_semi")) | self._touched(state, "scores", fresh)
                fresh = self.read("scores", hit).join(stale, "scope", "left_anti").unionByName(fresh)
                for b in hit:
                    state["files"]["scores"].pop(str(b), None)
            self._store(state, "scores", fresh)
            state["stale"] = []
            self._commit(state)
        out = self.read("scores")
        return out if touched is None else out.join(touched, "scope", "left_semi")


def count_pairs(baskets: DataFrame, batches: list[Column] | None = None, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """Scores of all baskets, fed to a :class:`PairTable` in the given batches.

    ``batches`` are conditions on the baskets, taken one after the other; rows that meet
    none of them are taken last.
    """
    table = PairTable(baskets.sparkSession, path, buckets)
    conditions = [F.coalesce(c, F.lit(False)) for c in batches or []]
    before: list[Column] = []
    for c in [*conditions, F.lit(True)]:
        rest = reduce(lambda x, y: x & y, [~b for b in before], F.lit(True))
        table.apply(baskets.filter(c & rest))
        before.append(c)
    return table.scores()
