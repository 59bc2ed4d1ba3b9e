"""RFC 2047 encoded words."""

from __future__ import annotations

from email.header import decode_header, make_header

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .clean import as_col


def decode(value: str | None) -> str:
    """Decoded text; the original when it cannot be decoded, empty for nothing."""
    if not value:
        return ""
    if "=?" not in value:
        return value
    try:
        return str(make_header(decode_header(value)))
    except Exception:
        return value


@F.pandas_udf(StringType())
def _decode(values: pd.Series) -> pd.Series:
    return values.map(decode, na_action="ignore").astype(object)


# The usual form: perhaps a plain beginning that ends with a blank, then encoded words of one charset, apart by blanks.
CHARSETS = ("utf-8", "iso-8859-1")
_BASE64 = r"(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?"
_QUOTED = r"(?:=[0-9A-Fa-f]{2}|[!-<>@-~])*"
_WORD = rf"=\?CS\?(?:[Bb]\?{_BASE64}|[Qq]\?{_QUOTED})\?="
_FORM = rf"\A(?:[!-<>-~](?:[ -<>-~]*[!-<>-~])? )?{_WORD}(?: +{_WORD})*\z"


def _word_hex(word: Column) -> Column:
    """The bytes of an encoded word as hexadecimal digits."""
    kind = F.lower(F.split_part(word, F.lit("?"), F.lit(3)))
    held = F.split_part(word, F.lit("?"), F.lit(4))
    units = F.regexp_extract_all(F.replace(held, F.lit("_"), F.lit(" ")), F.lit("=[0-9A-Fa-f]{2}|[^=]"), F.lit(0))
    quoted = F.array_join(F.transform(units, lambda u: F.when(F.length(u) == 3, F.substr(u, F.lit(2))).otherwise(F.hex(u))), "")
    return F.when(kind == "b", F.hex(F.try_to_binary(held, F.lit("base64")))).otherwise(quoted)


def decode_common(value: Column | str) -> Column:
    """Decoded text of headers in the usual form, in UTF-8 or Latin-1; else null. Catalyst only."""
    text = as_col(value)
    found = F.lit(None).cast("string")
    for charset in CHARSETS:
        word = _WORD.replace("CS", f"(?i:{charset})")
        words = F.regexp_extract_all(text, F.lit(word), F.lit(0))
        data = F.unhex(F.array_join(F.transform(words, _word_hex), ""))
        as_text = data.cast("string")
        decoded = F.when(F.is_valid_utf8(as_text), as_text) if charset == "utf-8" else F.decode(data, charset)
        before = F.regexp_extract(text, r"\A([!-<>-~][ -<>-~]* )?", 1)
        shaped = text.rlike(_FORM.replace("CS", f"(?i:{charset})"))
        found = F.when(shaped, F.concat(before, decoded)).otherwise(found)
    return found


def decode_words(value: Column | str) -> Column:
    """Decode encoded words of a header column.

    The usual form is decoded by Catalyst; rows without ``=?`` and those of the usual form pass through the Arrow stage as nulls.
    """
    text = as_col(value)
    common = decode_common(text)
    odd = text.contains("=?") & common.isNull()
    return F.coalesce(common, _decode(F.when(odd, text)), text, F.lit(""))
