"""Explicit schemas of what is read from landed files."""

from __future__ import annotations

from pyspark.sql import types as T

FEED_MEMBER = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("published", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("disabled_in_lists", T.BooleanType()),
        T.StructField("category_id", T.IntegerType()),
        T.StructField("category", T.StructType([T.StructField("title", T.StringType())])),
        T.StructField(
            "author",
            T.StructType(
                [
                    T.StructField("firstname", T.StringType()),
                    T.StructField("lastname", T.StringType()),
                ]
            ),
        ),
    ]
)

FEED_PAGE = T.StructType(
    [
        T.StructField("page", T.IntegerType()),
        T.StructField("totalItems", T.LongType()),
        T.StructField("member", T.ArrayType(FEED_MEMBER)),
    ]
)
