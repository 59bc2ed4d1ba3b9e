"""Raw messages to parsed tables. The Arrow stage reads MIME; everything after it is Catalyst."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import ids, names
from ..functions.clean import is_blank
from ..functions.subjects import canonical_subject
from .message_rows import message_values, parsing_policy, row_size
from .text import flat_text

BATCH_BYTES = 32 * 1024 * 1024


def header_block(content: Column | str) -> Column:
    """The bytes up to and including the first blank line, or everything when there is none."""
    data = F.col(content) if isinstance(content, str) else content
    # The bytes are searched as they are: as text they would be decoded with all attachments. The first of the
    # blank lines ends the header; four bytes from its start hold it.
    text = data.cast("string")
    head = F.substring_index(F.substring_index(F.substring_index(text, "\r\n\r\n", 1), "\n\n", 1), "\r\r", 1)
    head = F.substring_index(head, "\n\r\n", 1)
    length = F.octet_length(head.cast("binary"))
    return F.when(length < F.octet_length(data), F.substring(data, F.lit(1), length + 4)).otherwise(data)


def _parse(raw: DataFrame, body: bool, keep_payload: bool, html_nodes: bool) -> DataFrame:
    kept = [f for f in raw.schema.fields if f.name != "content"]
    added = [*schemas.PARSED_HEADERS.fields, *(schemas.PARSED_BODY.fields if body else [])]
    arrow_fields = [pa.field(f.name, schemas.arrow_type(f.dataType)) for f in added]
    limit = BATCH_BYTES

    def emit(batch: pa.RecordBatch, start: int, rows: list[dict]) -> pa.RecordBatch:
        arrays = batch.slice(start, len(rows)).columns
        new = [pa.array([r.get(f.name) for r in rows], type=f.type) for f in arrow_fields]
        return pa.RecordBatch.from_arrays(arrays + new, names=batch.schema.names + [f.name for f in arrow_fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        policy = parsing_policy()
        for batch in batches:
            contents = batch.column(batch.schema.get_field_index("content"))
            rest = batch.drop_columns(["content"])
            rows: list[dict] = []
            start = held = 0
            for content in contents:
                rows.append(message_values(content.as_py(), body, keep_payload, html_nodes, policy))
                held += row_size(rows[-1])
                if held >= limit:
                    yield emit(rest, start, rows)
                    start, held, rows = start + len(rows), 0, []
            if rows:
                yield emit(rest, start, rows)

    return raw.mapInArrow(run, T.StructType([*kept, *added]))


def _finish_headers(parsed: DataFrame) -> DataFrame:
    """Header texts to the normalised columns."""
    nobody = F.struct(F.lit("").alias("name"), F.lit("").alias("email"))
    return (
        parsed.withColumns(
            {
                "message_id": ids.header_id("message_id_header"),
                "in_reply_to": ids.header_id("in_reply_to_header"),
                "references": ids.header_ids("references_header"),
                "subject_canonical": canonical_subject(F.coalesce("subject_decoded", "subject")),
                "from": F.coalesce(F.get("from_list", F.lit(0)), nobody),
            }
        )
        .drop("message_id_header", "in_reply_to_header", "references_header", "subject_decoded", "from_list")
    )


def parse_headers(raw: DataFrame) -> DataFrame:
    """RAW -> header table. Only the header block of each message reaches the Python workers."""
    cut = raw.withColumn("content", header_block("content"))
    return _finish_headers(_parse(cut, body=False, keep_payload=False, html_nodes=False))


def parse_messages(
    raw: DataFrame, keep_payload: bool = False, html_mode: str = "nodes", attachments_dir: str | None = None
) -> DataFrame:
    """RAW -> one row per message with headers, bodies, attachments and parts, without a shuffle.

    The parts stay nested in their message, so choosing the body and listing the attachments needs no
    grouping. ``keep_payload`` carries the part bytes along (for saving attachments); sizes and hashes
    are there either way. ``html_mode`` is ``nodes`` (text nodes on lines) or ``flat`` (one line).
    """
    if html_mode not in ("nodes", "flat"):
        raise ValueError(f"unknown html_mode {html_mode!r}")
    parsed = _finish_headers(_parse(raw, True, keep_payload, html_mode == "nodes"))
    return choose_body(parsed, html_mode).withColumn("attachments", attachments_of(F.col("parts"), attachments_dir))


def is_attachment(part: Column) -> Column:
    """Marked attachment or inline, or named without a disposition. Inline text is an attachment too."""
    disposition = part["disposition"]
    named = part["filename_header"].isNotNull() & disposition.isNull()
    return ~part["is_multipart"] & (F.coalesce(disposition.isin("attachment", "inline"), F.lit(False)) | named)


def is_body(part: Column, content_type: str) -> Column:
    return (
        ~part["is_multipart"]
        & ~is_attachment(part)
        & (part["content_type"] == content_type)
        & ~is_blank(part["text"])
    )


def _first_text(parts: Column, content_type: str) -> Column:
    return F.get(F.filter(parts, lambda p: is_body(p, content_type)), F.lit(0))["text"]


def choose_body(parsed: DataFrame, html_mode: str = "nodes") -> DataFrame:
    """First plain text, and then no HTML; else the first HTML with its text; else empty texts."""
    picked = parsed.withColumns(
        {
            "_plain": _first_text(F.col("parts"), "text/plain"),
            "_html": _first_text(F.col("parts"), "text/html"),
        }
    )
    picked = picked.withColumn("_html", F.when(F.col("_plain").isNull(), F.col("_html")))
    if html_mode == "flat":
        picked = flat_text(picked, "_html", "html_text")
    return picked.withColumns(
        {
            "body_text": F.coalesce("_plain", "html_text", F.lit("")),
            "body_html": F.coalesce("_html", F.lit("")),
        }
    ).drop("_plain", "_html", "html_text")


def filename(part: Column) -> Column:
    return F.when(part["filename_header"].isNotNull(), names.sanitize_filename(part["filename_header"]))


def planned_path(folder: str | None, name: Column, part_index: Column) -> Column:
    """The file an attachment of a message (columns ``mailbox`` and ``uid``) is saved as."""
    if folder is None:
        return F.lit(None).cast("string")
    return names.saved_path(folder, "mailbox", names.stored_name(name, "mailbox", "uid", part_index))


def attachments_of(parts: Column, folder: str | None = None) -> Column:
    """Parts of a message -> its attachment records, in walk order."""
    return F.transform(
        F.filter(F.coalesce(parts, F.array().cast(T.ArrayType(schemas.PART))), is_attachment),
        lambda p: F.struct(
            F.coalesce(filename(p), F.lit("")).alias("filename"),
            p["content_type"].alias("content_type"),
            p["size"].alias("size"),
            p["sha256"].alias("sha256"),
            planned_path(folder, F.coalesce(filename(p), F.lit("")), p["part_index"]).alias("saved_path"),
            names.content_id(p["content_id_header"]).alias("content_id"),
        ),
    )


def explode_parts(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per MIME part, containers included, with ``keys`` of the message in front."""
    return parsed.select(*(keys or ("mailbox", "uid")), F.inline("parts"))
