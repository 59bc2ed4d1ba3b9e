"""Mailbox selection, limits and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import skew
from .lineage import Scratch

# Width of the uid ranges counted before the exact cut. Mailbox uids are 32-bit, so one mailbox has at
# most 65,536 ranges and one range at most 65,536 messages.
UID_RANGE = 65_536
PREVIEW = 5


def parse_mailbox_list(text: str | None) -> list[str]:
    """Mailbox names from comma-separated text: order and repetitions are kept, blanks dropped."""
    return [name.strip() for name in (text or "").split(",") if name.strip()]


def requested(spark: SparkSession, names: list[str]) -> DataFrame:
    """The requested mailboxes with their position."""
    return spark.createDataFrame(list(enumerate(names)), "mailbox_ord int, mailbox string")


def list_mailboxes(raw: DataFrame) -> DataFrame:
    """Distinct mailboxes. On a table partitioned by mailbox no column is read, though every file is opened."""
    return raw.select("mailbox").distinct()


def select_mailboxes(raw: DataFrame, names: list[str]) -> DataFrame:
    """Messages of the requested mailboxes; one named twice comes twice, a missing one is skipped.

    The list of names is the caller's argument, so the broadcast side is as small as that list.
    """
    spark = raw.sparkSession
    wanted = raw.where(F.col("mailbox").isin(sorted(set(names))))
    return wanted.join(F.broadcast(requested(spark, names)), "mailbox")


def missing_mailboxes(raw: DataFrame, names: list[str]) -> DataFrame:
    """Requested mailboxes without any message or folder; only the requested ones are scanned."""
    asked = raw.where(F.col("mailbox").isin(sorted(set(names))))
    return requested(raw.sparkSession, names).join(list_mailboxes(asked), "mailbox", "left_anti")


def profile(raw: DataFrame, names: DataFrame, readable: DataFrame | None = None) -> DataFrame:
    """Message count per requested mailbox: 0 when empty, -1 when it cannot be opened.

    ``readable`` lists the mailboxes that can be opened; by default those that have messages.
    """
    counts = raw.groupBy("mailbox").agg(F.count(F.lit(1)).alias("n"))
    known = counts.select("mailbox") if readable is None else readable.select("mailbox")
    flagged = names.join(known.distinct().withColumn("_open", F.lit(True)), "mailbox", "left")
    joined = flagged.join(counts, "mailbox", "left")
    n = F.when(F.col("_open").isNull(), F.lit(-1)).otherwise(F.coalesce("n", F.lit(0)))
    return joined.select("mailbox", "mailbox_ord", n.cast("long").alias("messages"))


def preview(names: DataFrame, first: int = PREVIEW) -> DataFrame:
    """Number of mailboxes, and the first few names joined by commas."""
    total = names.agg(F.count(F.lit(1)).alias("mailboxes"), F.lit(None).cast("string").alias("preview"))
    head = names.orderBy("mailbox_ord", "mailbox").limit(first)
    ordered = F.array_sort(F.collect_list(F.struct("mailbox_ord", "mailbox")))
    text = F.array_join(F.transform(ordered, lambda e: e["mailbox"]), ",")
    shown = head.agg(F.lit(None).cast("long").alias("mailboxes"), text.alias("preview"))
    return total.unionByName(shown).agg(F.max("mailboxes").alias("mailboxes"), F.max("preview").alias("preview"))


def _text_rank(uid: Column) -> Column:
    """Text uids have no order of their own; that of their MD5 deals them evenly over ranges."""
    return F.md5(F.coalesce(uid, F.lit("")).cast("binary"))


def _ends(slim: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Where the limit of each group falls: the first place with a row left out, and how many rows of it stay.

    ``slim`` has ``by``, ``_place``, its ``_range`` and the group's ``_limit``; groups within their limit are left out.
    Rows are counted per range, then per place in the one range where the limit falls, both combined before the
    shuffle, so many rows of one place meet nowhere.
    """
    counts = slim.groupBy(*by, "_limit", "_range").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    totals = counts.withColumn("_upto", F.sum("_n").over(running))
    before = F.col("_upto") - F.col("_n")
    cut = totals.where((F.col("_upto") > F.col("_limit")) & (before <= F.col("_limit")))
    cut = cut.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_range").alias("_at"), before.alias("_before"))
    # One row per group over its limit; the list of ends is no longer than this one.
    small = skew.measured_bytes(cut) <= skew.BROADCAST_BYTES
    match = F.col("_range") == F.col("_at")
    for i, c in enumerate(by):
        match &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inside = slim.join(F.broadcast(cut) if small else cut, match)
    places = inside.groupBy(*by, "_limit", "_before", "_place").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*by).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    reached = places.withColumn("_upto", F.col("_before") + F.sum("_n").over(order))
    stays = F.col("_limit") - (F.col("_upto") - F.col("_n"))
    left_out = reached.withColumn("_stays", stays).where((F.col("_upto") > F.col("_limit")) & (F.col("_stays") >= 0))
    return left_out.select(*by, F.col("_place").alias("_end"), "_stays")


def _beside_ends(df: DataFrame, ends: DataFrame, by: tuple[str, ...], spread_by: list[str]) -> DataFrame:
    """Rows with the end of their group, if it has one. ``ends`` is stored."""
    named = ends.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_end", "_stays")
    if skew.measured_bytes(ends) <= skew.BROADCAST_BYTES:
        match = F.lit(True)
        for i, c in enumerate(by):
            match &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
        return df.join(F.broadcast(named), match, "left").drop(*[f"_by{i}" for i in range(len(by))])
    keyed = df.withColumn("_box", F.to_json(F.struct(*by)))
    sided = ends.select(F.to_json(F.struct(*by)).alias("_key"), "_end", "_stays")
    return skew.lookup(keyed, sided, "_box", "_key", [*by, *spread_by], skew.heavy_keys(keyed, "_box")).drop("_box")


def _row_hash(df: DataFrame) -> Column:
    """A hash of the whole row; columns with maps, which have no order, take no part."""
    return F.xxhash64(*[F.col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def limit_per_mailbox(
    df: DataFrame,
    limit: int | None,
    by: tuple[str, ...] = ("mailbox",),
    uid: str = "uid_n",
    width: int = UID_RANGE,
    text: str = "uid",
) -> DataFrame:
    """The first ``limit`` messages of each mailbox in uid order; null or <= 0 means all.

    Messages whose uid is no number (null ``uid_n``) come after the others, in the order of the MD5 of their
    uid text. A window over whole mailboxes would sort the largest one in one task. Instead uid ranges, then the places
    inside one range, are counted, and the place of the first message left out filters the messages of each mailbox.
    If several messages have that place (equal uids, or none), those with the smallest hash of the row stay, and of equal
    rows as many as the limit allows. Works for any limit, and wide columns are shuffled only for such messages.
    """
    if limit is None or limit <= 0:
        return df
    scratch = Scratch(df.sparkSession, "limits")
    named = F.col(text) if text in df.columns else F.lit(None).cast("string")
    rank = F.when(F.col(uid).isNull(), _text_rank(named)).otherwise(F.lit(""))
    no_number, number = F.col(uid).isNull(), F.coalesce(F.col(uid), F.lit(0)).cast("long")
    shown = F.when(no_number, F.coalesce(named, F.lit(""))).otherwise(F.lit(""))
    place = F.struct(no_number.alias("t"), number.alias("n"), rank.alias("h"), shown.alias("u"))
    # Text uids have 65,536 ranges by the first digits of the MD5.
    range_ = F.struct(no_number.alias("t"), F.floor(number / width).alias("r"), F.left(rank, F.lit(4)).alias("h"))
    slim = df.select(*by, place.alias("_place"), range_.alias("_range"), F.lit(limit).cast("long").alias("_limit"))
    ends = scratch.write(_ends(slim, by), "ends")
    joined = _beside_ends(df.withColumn("_place", place), ends, by, ["_place"])
    kept = joined.where(F.col("_end").isNull() | (F.col("_place") < F.col("_end"))).select(*df.columns)
    shared = ends.where("_stays > 0")
    if shared.isEmpty():
        return kept
    return kept.unionByName(_first_of_place(joined.where(F.col("_place") == F.col("_end")), shared, df.columns, by, scratch))


def _first_of_place(rows: DataFrame, ends: DataFrame, columns: list[str], by: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """Of messages that share the place where the limit falls, ``_stays`` for each mailbox."""
    own = rows.where("_stays > 0").drop("_end")
    hashed = own.select(*columns, "_stays", _row_hash(own.select(*columns)).alias("_place"))
    slim = hashed.select(*by, "_place", F.shiftright("_place", 48).alias("_range"), F.col("_stays").alias("_limit"))
    last = scratch.write(_ends(slim, by), "last-places")
    joined = _beside_ends(hashed.drop("_stays"), last, by, ["_place"])
    before = joined.where(F.col("_end").isNull() | (F.col("_place") < F.col("_end"))).select(*columns)
    # Rows of one hash are one row here: it comes back as often as it may.
    equal = joined.where((F.col("_place") == F.col("_end")) & (F.col("_stays") > 0))
    one = equal.groupBy(*by, "_stays").agg(F.first(F.struct(*columns)).alias("_row"))
    copies = one.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_stays"))).alias("_nth"))
    return before.unionByName(copies.select("_row.*"))


def drop_repeated(df: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Keep the first message of each message id; messages without an id all stay.

    The first is the least by ``keys`` (default: position and name of the mailbox, number and text of the uid, as
    far as they are there), nulls last; of several rows there the one with the smallest hash. All is found on narrow rows,
    combined before the shuffle, so a message repeated in a third of the mailboxes does not gather in one task. The wide
    rows only look up whether they are listed; just rows that share id and place are shuffled.
    """
    keys = keys or tuple(c for c in ("mailbox_ord", "mailbox", "uid_n", "uid") if c in df.columns)
    scratch = Scratch(df.sparkSession, "repeated")
    place = F.struct(*[x for k in keys for x in (F.col(k).isNull().alias(f"{k}_null"), F.col(k).alias(k))])
    narrow = df.where(F.col("message_id").isNotNull()).select("message_id", place.alias("_place"))
    places = narrow.groupBy("message_id", "_place").agg(F.count(F.lit(1)).alias("_rows"))
    first = places.groupBy("message_id").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_places"))
    # Only ids with several rows go on, so what is listed is as short as the repetitions.
    several = places.join(first.withColumnRenamed("message_id", "_id"), F.col("message_id") == F.col("_id"))
    wins = F.col("_place") == F.col("_first")
    listed = several.where((F.col("_places") > 1) & ~wins | wins & (F.col("_rows") > 1))
    listed = scratch.write(listed.select("_id", F.col("_place").alias("_at"), wins.alias("_wins")), "listed")
    small = skew.measured_bytes(listed) <= skew.BROADCAST_BYTES
    placed = df.withColumn("_place", place)
    same = (F.col("message_id") == F.col("_id")) & (F.col("_place") == F.col("_at"))
    kept = placed.join(F.broadcast(listed) if small else listed, same, "left_anti").select(*df.columns)
    shared = listed.where("_wins")
    if shared.isEmpty():
        return kept
    rows = placed.join(F.broadcast(shared) if small else shared, same, "left_semi").select(*df.columns)
    one = rows.groupBy("message_id").agg(F.min_by(F.struct(*df.columns), _row_hash(df)).alias("_row"))
    return kept.unionByName(one.select("_row.*"))
