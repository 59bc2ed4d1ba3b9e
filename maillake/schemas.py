"""Table schemas."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T

ADDRESS = T.StructType([T.StructField("name", T.StringType()), T.StructField("email", T.StringType())])
ADDRESSES = T.ArrayType(ADDRESS)

PART = T.StructType(
    [
        T.StructField("part_index", T.IntegerType()),
        T.StructField("is_multipart", T.BooleanType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("disposition", T.StringType()),
        T.StructField("filename_header", T.StringType()),
        T.StructField("content_id_header", T.StringType()),
        T.StructField("charset", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)

ATTACHMENT = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("saved_path", T.StringType()),
        T.StructField("content_id", T.StringType()),
    ]
)

# What the Arrow parse adds to a raw row. The texts are still as the header carried them.
PARSED_HEADERS = T.StructType(
    [
        T.StructField("subject", T.StringType()),
        T.StructField("subject_decoded", T.StringType()),
        T.StructField("message_id_header", T.StringType()),
        T.StructField("in_reply_to_header", T.StringType()),
        T.StructField("references_header", T.StringType()),
        T.StructField("from_list", ADDRESSES),
        T.StructField("to", ADDRESSES),
        T.StructField("cc", ADDRESSES),
        T.StructField("bcc", ADDRESSES),
        T.StructField("date_header", T.StringType()),
        T.StructField("date_utc", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
PARSED_BODY = T.StructType([T.StructField("html_text", T.StringType()), T.StructField("parts", T.ArrayType(PART))])

# One exported message.
EXPORT_FIELDS = (
    "uid", "mailbox", "message_id", "conversation_id", "customer_email_normalized", "customer_id", "session_id",
    "subject", "subject_canonical", "date_header", "date_utc", "from", "to", "cc", "bcc", "in_reply_to", "references",
    "body_text", "body_html", "attachments", "flags", "fetch_ts_utc", "provider_thread_id",
)

EXPORT = T.StructType(
    [
        T.StructField(
            name,
            {
                "from": ADDRESS,
                "to": ADDRESSES,
                "cc": ADDRESSES,
                "bcc": ADDRESSES,
                "references": T.ArrayType(T.StringType()),
                "attachments": T.ArrayType(ATTACHMENT),
                "flags": T.ArrayType(T.StringType()),
            }.get(name, T.StringType()),
        )
        for name in EXPORT_FIELDS
    ]
)

_ARROW = {
    T.StringType: pa.string(),
    T.BinaryType: pa.binary(),
    T.IntegerType: pa.int32(),
    T.LongType: pa.int64(),
    T.BooleanType: pa.bool_(),
}


def arrow_type(kind: T.DataType) -> pa.DataType:
    """Arrow counterpart of the types used above."""
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind])
    return _ARROW[type(kind)]
