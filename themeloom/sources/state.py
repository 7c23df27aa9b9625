"""A keyed feed as a snapshot by buckets of keys and the deltas since.

One writer at a time adds deltas, numbered upwards.  Adding costs what the batch costs:
a snapshot is laid out by a hash of the key, so only the buckets that a batch touches are
read, and the number of rows is kept with every delta instead of being counted.  The
table itself is only rewritten by :func:`compact`, which also drops what no reader of
the last two versions can need.

Pages of a run may arrive in any order.  A bad page ends its run, also if later pages were
taken in before; so rows of pages keep their run and page until the run is closed, and a
reader leaves out those beyond its end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.operators import feeds
from themeloom.operators.scale import checked_broadcast
from themeloom.session import materialize
from themeloom.sources import tables
from themeloom.sources.storage import children, delete, exists, make_folder

ITEM = "batch="
# Rows of a bucket, and the most buckets of a snapshot.
ROWS_PER_BUCKET = 50_000
MAX_BUCKETS = 4096
NO_END = 2**31 - 1
PAGES = "run string, page int, good boolean, last boolean"
ENDS = "run string, end int"


def _done(spark: SparkSession, path: str) -> int:
    """Number of the last delta that the snapshot contains."""
    meta = tables.snapshot_meta(spark, path)
    return -1 if meta is None else meta.first()["last_batch"]


def _complete(spark: SparkSession, path: str) -> list[int]:
    found = [
        int(c.removeprefix(ITEM)) for c in children(spark, f"{path}/deltas")
        if c.startswith(ITEM) and exists(spark, f"{path}/deltas/{c}/_SUCCESS")
    ]
    return sorted(found)


def pending(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete deltas that the snapshot lacks."""
    done = _done(spark, path)
    return [b for b in _complete(spark, path) if b > done]


def _marks(spark: SparkSession, path: str, folder: str) -> dict[str, int]:
    """The largest number of each name among the marks ``name-number`` of a folder."""
    out: dict[str, int] = {}
    for name, number in (c.rsplit("-", 1) for c in children(spark, f"{path}/{folder}")):
        out[name] = max(int(number), out.get(name, -1))
    return out


def next_batch(spark: SparkSession, path: str) -> int:
    """A number that no delta has or was promised."""
    return max([_done(spark, path), *_complete(spark, path), *_marks(spark, path, "taken").values()]) + 1


def number_of(spark: SparkSession, path: str, run: str, batch_id: int) -> int | None:
    """The delta number of a stream's batch; none if the snapshot contains the batch.

    A stream counts its batches from 0 again with every fresh checkpoint, so its
    own numbers do not tell batches apart.  The number is written down before the
    delta, and a repeated batch gets the same one.
    """
    if batch_id <= _marks(spark, path, "folded").get(run, -1):
        return None
    name = f"{run}-{batch_id}"
    number = _marks(spark, path, "taken").get(name)
    if number is not None and number <= _done(spark, path):
        if number in _complete(spark, path):
            return None
        # Never completed, and later deltas have been folded: it needs a new place.
        number = None
    if number is None:
        number = next_batch(spark, path)
        make_folder(spark, f"{path}/taken/{name}-{number}")
    return number


def append_delta(
    batch: DataFrame, path: str, kind: str, number: int, pages: DataFrame | None = None, added: int | None = None
) -> None:
    """Store what can still win of a batch; the same number again replaces it.

    ``added`` says how many keys the batch adds to the feed, where the caller knows.
    With ``pages`` (run, page, good, last) the batch is part of paged runs: it has the
    columns ``run`` and ``seq``, and what can win is kept for each page, since a page may
    turn out to lie beyond the end of its run.
    """
    spark = batch.sparkSession
    name = f"{ITEM}{number}"
    if pages is not None:
        pages.write.mode("overwrite").parquet(f"{path}/pages/{name}")
        kept = feeds.reduce_pages(batch, kind)
    else:
        kept = feeds.reduce_batch(batch, kind).withColumn("run", F.lit(None).cast("string"))
    spark.createDataFrame([(added,)], "added bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/notes/{name}")
    # Readers know a delta by this, so it is written last.
    kept.write.mode("overwrite").parquet(f"{path}/deltas/{name}")


def _numbered(spark: SparkSession, path: str, folder: str, numbers: list[int], schema: str) -> DataFrame:
    """What is stored beside some deltas, with the delta's number as ``batch``."""
    there = set(children(spark, f"{path}/{folder}"))
    names = [f"{ITEM}{b}" for b in numbers if f"{ITEM}{b}" in there]
    if not names:
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").option("basePath", f"{path}/{folder}").parquet(
        *[f"{path}/{folder}/{n}" for n in names])


def _ends(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    """(run, end): pages from ``end`` on do not count."""
    seen = _numbered(spark, path, "pages", numbers, PAGES).select(
        "run", F.least(
            F.when(~F.col("good"), F.col("page")), F.when(F.col("last"), F.col("page") + 1)).alias("end"))
    known = tables.beside_snapshot(spark, path, "ends")
    if known is not None:
        seen = seen.unionByName(known)
    return seen.groupBy("run").agg(F.min("end").alias("end")).where(F.col("end").isNotNull())


def _live(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    """The rows of some deltas, without pages beyond the end of their run."""
    deltas = spark.read.option("basePath", f"{path}/deltas").parquet(*[f"{path}/deltas/{ITEM}{b}" for b in numbers])
    if not any(c.startswith(ITEM) for c in children(spark, f"{path}/pages")):
        return deltas.drop("run")
    ends = checked_broadcast(_ends(spark, path, numbers).select(F.col("run").alias("_run"), "end"))
    within = F.col("seq") < F.coalesce("end", F.lit(NO_END)).cast("bigint") * feeds.PAGE_STRIDE
    return deltas.join(ends, F.col("run") == F.col("_run"), "left").where(within).drop("run", "_run", "end")


def _merged(stored: DataFrame | None, deltas: DataFrame, kind: str) -> DataFrame:
    return feeds.upsert(stored, feeds.reduce_deltas(deltas, kind), kind).drop("seq")


def read_state(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """The feed as of now, one row per key; none if nothing was ever stored."""
    stored, todo = tables.read_snapshot(spark, path), pending(spark, path)
    return _merged(stored, _live(spark, path, todo), kind) if todo else stored


def read_touched(spark: SparkSession, path: str, kind: str, keys: DataFrame) -> DataFrame | None:
    """The rows of the feed whose key is among ``keys`` (one column, distinct).

    Of the snapshot, only buckets that can hold them are read.
    """
    stored, todo = tables.read_buckets(spark, path, keys), pending(spark, path)
    key = feeds.KEYS[kind]
    asked = checked_broadcast(keys.select(F.col(keys.columns[0]).alias("_asked")))
    same = F.col(key).eqNullSafe(F.col("_asked"))
    if stored is not None:
        stored = stored.join(asked, same, "left_semi")
    if not todo:
        return stored
    return _merged(stored, _live(spark, path, todo).join(asked, same, "left_semi"), kind)


def total(spark: SparkSession, path: str, kind: str) -> int:
    """Rows of the feed: those of the snapshot and what each delta added, where that is known."""
    meta, todo = tables.snapshot_meta(spark, path), pending(spark, path)
    if todo:
        known = _numbered(spark, path, "notes", todo, "added bigint").agg(
            F.count("added").alias("n"), F.coalesce(F.sum("added"), F.lit(0)).alias("added")).first()
        if known["n"] < len(todo):
            return read_state(spark, path, kind).count()
        return (meta.first()["total"] if meta is not None else 0) + known["added"]
    return meta.first()["total"] if meta is not None else 0


def _closed(spark: SparkSession, path: str, todo: list[int]) -> list[int]:
    """The first deltas all of whose runs are closed.

    A run is closed when its end is known and every page before has arrived, or when
    another run has begun since its last page.
    """
    log = _numbered(spark, path, "pages", todo, PAGES)
    ends = _ends(spark, path, todo)
    runs = log.join(ends, "run", "left").groupBy("run").agg(
        F.min("batch").alias("first"), F.max("batch").alias("last"), F.max("end").alias("end"), F.min("page").alias("start"),
        F.count_distinct(F.when(F.col("page") < F.col("end"), F.col("page"))).alias("pages"),
    ).collect()
    opened = [
        r["first"] for r in runs
        if (r["end"] is None or r["pages"] < r["end"] - min(r["start"], 1)) and not any(o["first"] > r["last"] for o in runs)
    ]
    return [b for b in todo if b < min(opened, default=NO_END)]


def compact(spark: SparkSession, path: str, kind: str, at: Column | None = None) -> DataFrame | None:
    """Fold deltas into a new snapshot version; returns the feed as of now.

    Deltas with pages of an open run wait, and so do those after them.
    """
    todo = _closed(spark, path, pending(spark, path))
    if todo:
        stored = tables.read_snapshot(spark, path)
        folded = materialize(_merged(stored, _live(spark, path, todo), kind), "folded")
        buckets = 1 << max(0, math.ceil(math.log2(max(1, folded.count() / ROWS_PER_BUCKET))))
        tables.write_snapshot(
            folded, path, at, last_batch=todo[-1], key=feeds.KEYS[kind], buckets=min(buckets, MAX_BUCKETS),
            beside={"ends": _ends(spark, path, todo)})
        _expire(spark, path)
    return read_state(spark, path, kind)


def _expire(spark: SparkSession, path: str) -> None:
    """Drop old versions, and the deltas that every version left contains.

    A reader that began with the version before the last still finds its deltas.  Of
    the batches of a stream, the last one folded is noted: a stream repeats no other.
    """
    left = tables.expire_versions(spark, path, "meta")
    oldest = min(tables.version_meta(spark, v).first()["last_batch"] for v in left)
    complete, folded = set(_complete(spark, path)), _marks(spark, path, "folded")
    for name, number in _marks(spark, path, "taken").items():
        if number <= oldest:
            run, batch_id = name.rsplit("-", 1)
            if number in complete and int(batch_id) > folded.get(run, -1):
                make_folder(spark, f"{path}/folded/{run}-{batch_id}")
                if run in folded:
                    delete(spark, f"{path}/folded/{run}-{folded[run]}")
                folded[run] = int(batch_id)
            delete(spark, f"{path}/taken/{name}-{number}")
    for folder in ("deltas", "pages", "notes"):
        for c in children(spark, f"{path}/{folder}"):
            if c.startswith(ITEM) and int(c.removeprefix(ITEM)) <= oldest:
                delete(spark, f"{path}/{folder}/{c}")
