"""File, attachment and mailbox names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import as_col, strip

# Longest file name kept whole, and what is kept of longer ones.
MAX_NAME, BASE_KEPT, EXT_KEPT = 255, 200, 50
# Fixed value: characters replaced in file names.
UNSAFE = r'[/\\:*?"<>|\r\n\t]+'
FOLDER_HASH = 10

_SPLIT = r"(?s)\A(\.*[^.].*)(\.[^.]*)\z"


def extension(name: Column | str) -> Column:
    """Text from the last dot, leading dots not counted; empty when there is none."""
    return F.regexp_extract(as_col(name), _SPLIT, 2)


def base_name(name: Column | str) -> Column:
    col = as_col(name)
    return F.left(col, F.length(col) - F.length(extension(col)))


def sanitize_filename(value: Column | str) -> Column:
    """A safe file name; blank or null becomes ``attachment``. Encoded words must be decoded before."""
    safe = F.regexp_replace(as_col(value), UNSAFE, "_")
    bare = F.btrim(strip(safe), F.lit("."))
    name = F.coalesce(F.regexp_replace(bare, r"\A\z", "attachment"), F.lit("attachment"))
    cut = F.concat(F.left(base_name(name), F.lit(BASE_KEPT)), F.lit("_trunc"), F.left(extension(name), F.lit(EXT_KEPT)))
    return F.when(F.length(name) > MAX_NAME, cut).otherwise(name)


def sanitize_mailbox(value: Column | str) -> Column:
    """A mailbox name usable as one path step."""
    safe = F.regexp_replace(strip(value), r"/", "_")
    safe = F.regexp_replace(safe, r"[^A-Za-z0-9_.-]+", "_")
    return F.when(safe != "", safe).otherwise(F.lit("mailbox"))


def mailbox_folder(value: Column | str) -> Column:
    """A folder of its own for each mailbox: the usable name and the start of a hash of the raw one.

    Names that only differ in replaced characters, and names made of dots, get folders apart and inside.
    """
    raw = F.coalesce(as_col(value), F.lit(""))
    return F.concat(sanitize_mailbox(raw), F.lit("-"), F.left(F.sha2(raw, 256), F.lit(FOLDER_HASH)))


def stored_name(filename: Column | str, mailbox: Column | str, uid: Column | str, part_index: Column | str) -> Column:
    """``{base}_{uid}_{part_index}{ext}``; nameless parts get a name made of mailbox, uid and index."""
    suffix = F.concat(F.lit("_"), as_col(uid), F.lit("_"), as_col(part_index).cast("string"))
    default = F.concat(F.lit("attachment_"), sanitize_mailbox(mailbox), suffix)
    given = as_col(filename)
    name = F.when(given != "", given).otherwise(default)
    return F.concat(base_name(name), suffix, extension(name))


def saved_path(folder: str, mailbox: Column | str, stored: Column) -> Column:
    """Where an attachment is saved: one folder per mailbox, so equal uids of two mailboxes do not collide."""
    return F.concat(F.lit(f"{folder.rstrip('/')}/"), mailbox_folder(mailbox), F.lit("/"), stored)


def content_id(value: Column | str) -> Column:
    """Content-ID without its angle brackets; null stays null."""
    text = strip(value)
    inner = F.regexp_extract(text, r"\A<(.+?)>\z", 1)
    return strip(F.when(inner != "", inner).otherwise(text))
