"""Reading drafts, one JSON file per source and stock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.operators.merge import MERGED_DIR
from themeloom.schemas import DRAFT_BODY, KNOWN_KEYS, QUOTE_FIELDS
from themeloom.sources.files import file_name, list_files, read_files
from themeloom.sources.storage import in_reach

# Fixed value: a file beside the drafts that is none.
UNIVERSE_STEM = "stock_list"


def decoded(path):
    """A file path without its percent escapes; a plus sign is no blank here."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_drafts(spark: SparkSession, root: str) -> DataFrame:
    """All drafts below ``root/{source}/{code}.json`` with one schema.

    The source is the parent folder and the code the file stem; merged output
    and the stock list are skipped.  Keys without a column of their own, other
    than private ones, are kept as text in ``extra``.  Tasks list and open the files;
    only a store that tasks cannot open is listed by the driver.
    """
    source = F.regexp_extract("path", r"([^/]+)/[^/]+\.json$", 1)
    code = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    draft = (source != MERGED_DIR) & (code != UNIVERSE_STEM)
    if in_reach(spark, root):
        # File sources pass over empty files and these names.
        name = file_name()
        hidden = name.startswith(".") | (name.startswith("_") & ~name.contains("="))
        found = list_files(spark, root, ".json", deep=True).where((F.col("size") > 0) & ~hidden & draft)
        files = read_files(found, root)
    else:
        files = (
            spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
            .text(root, wholetext=True)
            .select(decoded(F.col("_metadata.file_path")).alias("path"), "value")
            .where(draft)
        )
    return parse_drafts(files.select(source.alias("source"), code.alias("code"), "value"))


def parse_drafts(files: DataFrame) -> DataFrame:
    """Drafts from (source, code, value) with the JSON text in ``value``."""
    body = F.from_json("value", DRAFT_BODY.simpleString())
    keys = F.from_json("value", "map<string,string>")
    extra = F.map_filter(keys, lambda k, _: ~k.startswith("_") & ~k.isin(*KNOWN_KEYS))
    parsed = files.select("source", "code", body.alias("b"), extra.alias("extra"))
    return parsed.select(
        "source", "code",
        *[F.col(f"b.{f}").alias(f) for f in ("name", "concepts", "concepts_ths", "info", "industry")],
        *[F.col(f"b.{f}").alias(f) for f in QUOTE_FIELDS],
        F.col("b._meta").alias("_meta"),
        "extra",
    )


def conform_draft(df: DataFrame, source: str) -> DataFrame:
    """A job's result with (code, ...) as a draft table; missing columns are null."""
    types = {f.name: f.dataType for f in DRAFT_BODY.fields}
    columns = [
        (F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in types.items()
    ]
    extra = F.col("extra") if "extra" in df.columns else F.lit(None).cast("map<string,string>")
    return df.select(F.lit(source).alias("source"), "code", *columns, extra.alias("extra"))
