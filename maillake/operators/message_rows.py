"""Per-message helper of the Arrow parse: one raw message to the values of one row (standard library only)."""

from __future__ import annotations

import codecs
import contextlib
import email
import hashlib
import re
from collections import OrderedDict
from email.headerregistry import HeaderRegistry
from email.message import Message
from email.policy import EmailPolicy, default
from email.utils import getaddresses

from ..functions.dates import utc_text
from ..functions.html import text_nodes
from ..functions.words import decode

# Headers of these plain shapes read the same with or without the structured header parser, which
# is many times slower than the rest of the parse.
_ATOM = r"[A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)*"
_SPEC = rf"{_ATOM}@{_ATOM}"
_NAME = r'(?:[A-Za-z0-9]+(?: [A-Za-z0-9]+)*|"[A-Za-z0-9]+(?:(?:, |[ .])[A-Za-z0-9]+)*")'
_BOX = rf"(?:{_SPEC}|{_NAME} <{_SPEC}>)"
PLAIN_ADDRESSES = re.compile(rf"{_BOX}(?:, {_BOX})*")
PLAIN_TEXT = re.compile(r"[!-~]+(?:[ \t]+[!-~]+)*")
PLAIN_ID = re.compile(rf"<{_SPEC}>")
LINE_END = re.compile(r"\r\n|\r|\n")


# Parsed headers keep their parse trees, many times the size of their text; so the texts are what is bounded.
CACHED_TEXT = 256 * 1024
CACHED_HEADER = 1024


class RememberedHeaders(HeaderRegistry):
    """The standard header classes, with parsed headers kept: the same values recur within and across messages.

    Long headers are not kept; when the kept texts pass the bound, the ones not used for longest go.
    """

    def __init__(self) -> None:
        super().__init__()
        self.classes: dict[str, type] = {}
        self.parsed: OrderedDict[tuple[str, str], str] = OrderedDict()
        self.held = 0

    def __getitem__(self, name: str) -> type:
        name = name.lower()
        if name not in self.registry:
            name = ""
        if name not in self.classes:
            self.classes[name] = super().__getitem__(name)
        return self.classes[name]

    def __call__(self, name: str, value: str) -> str:
        key = (name, value)
        header = self.parsed.get(key)
        if header is not None:
            self.parsed.move_to_end(key)
            return header
        header = super().__call__(name, value)
        if len(value) <= CACHED_HEADER:
            self.parsed[key] = header
            self.held += len(name) + len(value)
            while self.held > CACHED_TEXT:
                (old_name, old_value), _ = self.parsed.popitem(last=False)
                self.held -= len(old_name) + len(old_value)
        return header


def parsing_policy() -> EmailPolicy:
    """The default policy with remembered headers; one per task."""
    return default.clone(header_factory=RememberedHeaders())


def clean(text: str | None) -> str | None:
    """Lone surrogates cannot be stored as UTF-8."""
    return None if text is None else text.encode("utf-8", "replace").decode("utf-8")


class Headers:
    """First occurrence of each header, skipping the structured parser for plain values."""

    def __init__(self, message: Message) -> None:
        self.message = message
        self.raw: dict[str, str] = {}
        for name, value in message.raw_items():
            self.raw.setdefault(name.lower(), value)

    def get(self, name: str, plain: re.Pattern | None) -> str | None:
        value = self.raw.get(name)
        if value is None:
            return None
        if plain is not None:
            line = LINE_END.sub("", value)
            if "=?" not in line and plain.fullmatch(line):
                return line
        return str(self.message.get(name))

    def addresses(self, name: str) -> list[dict]:
        value = self.get(name, PLAIN_ADDRESSES)
        if not value:
            return []
        return [
            {"name": clean(decode(shown).strip()), "email": clean((address or "").strip())}
            for shown, address in getaddresses([value])
        ]


def header_values(message: Message) -> dict:
    headers = Headers(message)
    subject = decode(headers.get("subject", PLAIN_TEXT))
    date = headers.get("date", None) or None
    return {
        "subject": clean(subject),
        "subject_decoded": clean(decode(subject)) if "=?" in subject else None,
        "message_id_header": clean(headers.get("message-id", PLAIN_ID)),
        "in_reply_to_header": clean(headers.get("in-reply-to", PLAIN_TEXT)),
        "references_header": clean(headers.get("references", PLAIN_TEXT)),
        "from_list": headers.addresses("from"),
        "to": headers.addresses("to"),
        "cc": headers.addresses("cc"),
        "bcc": headers.addresses("bcc"),
        "date_header": clean(date),
        "date_utc": utc_text(date),
    }


def codec_of(charset: str | None) -> str:
    """A text codec for a charset name; UTF-8 for missing and unknown names."""
    try:
        found = codecs.lookup(charset or "utf-8")
        return found.name if found._is_text_encoding else "utf-8"
    except (LookupError, ValueError):
        return "utf-8"


def part_bytes(part: Message) -> bytes:
    """Transfer-decoded payload; text that cannot be decoded is encoded as it stands, and no payload is empty."""
    with contextlib.suppress(Exception):
        return part.get_payload(decode=True) or b""
    stored = part.get_payload()
    return stored.encode(codec_of(part.get_content_charset()), "ignore") if isinstance(stored, str) else b""


def charset_text(data: bytes, charset: str | None) -> str:
    """Bytes as text; what the codec cannot read is replaced."""
    return codecs.decode(data, codec_of(charset), "replace")


def part_values(index: int, part: Message, keep_payload: bool) -> dict:
    row = {"part_index": index, "is_multipart": part.is_multipart(), "content_type": clean(part.get_content_type())}
    if row["is_multipart"]:
        return row
    data = part_bytes(part)
    name, content_id = part.get_filename(), part.get("Content-ID")
    disposition = part.get_content_disposition()
    attached = disposition in ("attachment", "inline") or bool(name) and disposition is None
    row |= {
        "disposition": clean(disposition),
        "filename_header": clean(decode(name)) if name else None,
        "content_id_header": clean(str(content_id)) if content_id else None,
        "size": len(data),
        "sha256": hashlib.sha256(data).hexdigest(),
        "payload": data if keep_payload and attached else None,
    }
    if row["content_type"] in ("text/plain", "text/html"):
        charset = part.get_content_charset()
        row |= {"charset": clean(charset), "text": clean(charset_text(data, charset))}
    return row


def has_body(parts: list[dict], content_type: str) -> str | None:
    """First non-blank text of a type among the parts that are not attachments."""
    for part in parts:
        inside = part.get("disposition") not in ("attachment", "inline")
        named = part.get("filename_header") is not None and part.get("disposition") is None
        if inside and not named and part["content_type"] == content_type and (part.get("text") or "").strip():
            return part["text"]
    return None


def message_values(
    content: bytes | None, body: bool, keep_payload: bool, html_nodes: bool, policy: EmailPolicy = default
) -> dict:
    """Values of one row; a failure fills ``stage`` and ``error`` instead of stopping the job."""
    values: dict = {}
    stage = "scan"
    try:
        if content is None:
            raise ValueError("no content")
        stage = "parse"
        message = email.message_from_bytes(content, policy=policy)
        stage = "headers"
        values |= header_values(message)
        if body:
            stage = "body"
            parts = [part_values(i, p, keep_payload) for i, p in enumerate(message.walk(), 1)]
            values["parts"] = parts
            if html_nodes and has_body(parts, "text/plain") is None:
                page = has_body(parts, "text/html")
                values["html_text"] = clean(text_nodes(page)) if page else None
        return values
    except Exception as problem:
        return {"stage": stage, "error": clean(f"{type(problem).__name__}: {problem}")}


def row_size(values: dict) -> int:
    """Rough size of a row, to bound output batches."""
    parts = values.get("parts") or []
    return 1000 + sum(len(p.get("text") or "") + len(p.get("payload") or b"") for p in parts)
