"""Table schemas.  Quote numbers stay text, as the sources deliver them."""

from __future__ import annotations

from pyspark.sql import types as T

# Quote fields that a merged record folds into its info map.
QUOTE_FIELDS = (
    "price", "prev_close", "open", "volume", "turnover", "turnover_rate", "pe",
    "high", "low", "amplitude", "market_cap_float", "market_cap_total", "pb",
)
# Draft keys with a column of their own; others are open keys.
KNOWN_KEYS = ("code", "name", "concepts", "concepts_ths", "info", "industry") + QUOTE_FIELDS

CONCEPT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
])
META = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("stock_code", T.StringType()),
    T.StructField("collected_at", T.StringType()),
])
TEXT_MAP = T.MapType(T.StringType(), T.StringType())
TEXT_LIST = T.ArrayType(T.StringType())
VECTOR = T.ArrayType(T.DoubleType())

# What one draft file may hold; the code comes from the file name.
DRAFT_BODY = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("concepts", TEXT_LIST),
        T.StructField("concepts_ths", T.ArrayType(CONCEPT)),
        T.StructField("info", TEXT_MAP),
        T.StructField("industry", T.StringType()),
    ]
    + [T.StructField(f, T.StringType()) for f in QUOTE_FIELDS]
    + [T.StructField("_meta", META)]
)

# Feed envelopes.  Details of a mover are text, since a number type would turn
# what is no number into null.
ACTION_STOCK = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("article", T.StructType([
        T.StructField("action_info", T.StructType([
            T.StructField("time", T.StringType()),
            T.StructField("num", T.StringType()),
            T.StructField("day", T.StringType()),
            T.StructField("edition", T.StringType()),
            T.StructField("shares_range", T.StringType()),
            T.StructField("reason", T.StringType()),
            T.StructField("expound", T.StringType()),
            T.StructField("is_crawl", T.StringType()),
        ])),
    ])),
])
ACTION_FIELD = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("list", T.ArrayType(ACTION_STOCK)),
])
INDUSTRY_ITEM = T.StructType([
    T.StructField("industry_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("keyword", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("create_time", T.StringType()),
    T.StructField("update_time", T.StringType()),
    T.StructField("browsers_count", T.LongType()),
])
TIMELINE_EVENT = T.StructType([
    T.StructField("article_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("timeline", T.StructType([
        T.StructField("date", T.StringType()),
        T.StructField("grade", T.LongType()),
        T.StructField("create_time", T.StringType()),
        T.StructField("theme_list", T.ArrayType(
            T.StructType([T.StructField("name", T.StringType())])
        )),
    ])),
])


def _envelope(data: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("errCode", T.StringType()),
        T.StructField("msg", T.StringType()),
        T.StructField("data", data),
    ])


ENVELOPES = {
    # Entries stay JSON text here, since some may be no objects at all.
    "action": _envelope(TEXT_LIST),
    "industry": _envelope(T.StructType([
        T.StructField("hasNext", T.BooleanType()),
        T.StructField("result", T.ArrayType(INDUSTRY_ITEM)),
    ])),
    "timeline": _envelope(T.ArrayType(T.StructType([
        T.StructField("list", T.ArrayType(TIMELINE_EVENT)),
    ]))),
}
