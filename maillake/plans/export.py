"""The export: raw messages to one nested record per message."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.roles import parse_domains
from ..operators import analytics, attachments, enrich, mime, people, quality, skew
from ..sources import messages, side_inputs, sinks


def run_timestamp() -> str:
    """The time of a run as UTC text; one value for all its records."""
    return datetime.now(UTC).isoformat().replace("+00:00", "Z")


def to_export(
    parsed: DataFrame,
    crm: DataFrame,
    agency_domains: Iterable[str],
    tenant: str = "default",
    fetch_ts_utc: str | None = None,
    keys: tuple[str, ...] = ("mailbox", "uid"),
    headers: DataFrame | None = None,
) -> DataFrame:
    """Parsed messages -> the 23 export fields (plus ``mailbox_ord`` and ``uid_n`` where present).

    ``flags`` and ``provider_thread_id`` are taken along when the raw table had them. ``headers`` are the records of a
    header pass: a message has the header and the conversation id found there, and its own ones where there are none.
    Without them the full messages, parsed once, give both.
    """
    if headers is None:
        keyed = people.with_roles(parsed, agency_domains)
    else:
        full = enrich.with_header_index(parsed, people.with_roles(headers, agency_domains), keys)
        keyed = people.with_roles(full, agency_domains).withColumn("conversation_id", F.coalesce("_known", "conversation_id"))
    full = enrich.with_customer_id(keyed, crm, tenant, keys)
    if "flags" not in full.columns:
        full = full.withColumn("flags", F.array().cast("array<string>"))
    thread = F.col("provider_thread_id") if "provider_thread_id" in full.columns else F.lit(None).cast("string")
    full = full.withColumns(
        {
            "flags": F.coalesce("flags", F.array().cast("array<string>")),
            "provider_thread_id": F.when(thread != "", thread),
            "fetch_ts_utc": F.lit(fetch_ts_utc or run_timestamp()),
        }
    )
    extra = [c for c in ("mailbox_ord", "uid_n") if c in full.columns]
    return full.select(*schemas.EXPORT_FIELDS, *extra)


def in_order(exported: DataFrame) -> DataFrame:
    """Mailbox order, then uid order, text uids last: a range-partitioned sort, opt-in."""
    return exported.orderBy("mailbox_ord", F.col("uid_n").asc_nulls_last(), "uid")


def slim(parsed: DataFrame, keep_payload: bool) -> DataFrame:
    """Parsed messages without the part texts, which the chosen body repeats; parts go altogether without bytes."""
    if not keep_payload:
        return parsed.drop("parts")
    texts = ("text", "charset")
    return parsed.withColumn("parts", F.transform("parts", lambda p: p.dropFields(*texts)))


@dataclass
class ExportJob:
    """Parameters of a full export run."""

    raw_path: str
    out_path: str
    mailboxes: list[str]
    raw_form: str = "parquet"
    out_form: str = "ndjson"
    limit: int | None = None
    agency_domains: str = ""
    tenant: str = "default"
    crm_path: str | None = None
    crm_form: str = "json"
    attachments_dir: str | None = None
    html_mode: str = "nodes"
    ordered: bool = False
    fetch_ts_utc: str = field(default_factory=run_timestamp)

    def run(self, spark: SparkSession) -> DataFrame:
        """Write ``messages``, ``quarantine``, ``staging`` and, when asked for, attachments; return counts per mailbox.

        Messages are parsed once into the staging table; everything else reads that table.
        """
        raw = messages.read_mailboxes(spark, self.raw_path, self.mailboxes, self.raw_form, self.limit)
        keep = self.attachments_dir is not None
        staging = f"{self.out_path}/staging"
        parsed = slim(mime.parse_messages(raw, keep, self.html_mode, self.attachments_dir), keep)
        parsed.write.mode("overwrite").parquet(staging)
        good, bad = quality.split_bad_rows(spark.read.parquet(staging))
        bad.write.mode("overwrite").parquet(f"{self.out_path}/quarantine")
        if keep:
            good = self._save(spark, good)
        crm = side_inputs.read_crm_map(spark, self.crm_path, self.crm_form)
        exported = to_export(
            good, crm, parse_domains(self.agency_domains), self.tenant, self.fetch_ts_utc, ("mailbox_ord", "mailbox", "uid")
        )
        exported = (in_order(exported) if self.ordered else exported).select(*schemas.EXPORT_FIELDS)
        target = f"{self.out_path}/messages"
        if self.out_form == "ndjson":
            sinks.write_ndjson(exported, target)
        else:
            sinks.write_parquet(exported, target, arrange=not self.ordered)
        # One record per good message: two narrow columns of the staging table say how many were written.
        return analytics.messages_per_mailbox(spark.read.parquet(staging).where("error is null").select("mailbox"))

    def _save(self, spark: SparkSession, good: DataFrame) -> DataFrame:
        """Save attachment files; the records already name them, so only failures have to be joined back."""
        table = f"{self.out_path}/saved"
        keys = ("mailbox_ord", "mailbox", "uid")
        saved = attachments.save_files(attachments.inventory(good, *keys), self.attachments_dir)
        saved.select(*keys, "stored_name", "saved_path").write.mode("overwrite").parquet(table)
        # A message has no more failed files than attachments, so the list is no larger than the message.
        failed = spark.read.parquet(table).where("saved_path is null")
        failed = failed.groupBy(*keys).agg(F.collect_list("stored_name").alias("_failed"))
        small = skew.measured_bytes(failed) <= skew.BROADCAST_BYTES
        joined = good.join(F.broadcast(failed) if small else failed, list(keys), "left")
        name = r"([^/]+)\z"
        kept = F.transform(
            "attachments",
            lambda a: a.withField(
                "saved_path",
                F.when(
                    ~F.coalesce(
                        F.array_contains("_failed", F.regexp_extract(a["saved_path"], name, 1)), F.lit(False)
                    ),
                    a["saved_path"],
                ),
            ),
        )
        return joined.withColumn("attachments", kept).drop("_failed")
