"""HTML to text."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .clean import as_col, collapse

# Elements dropped with their content, elements whose strings do not count as text,
# and elements that never have an end tag.
DROPPED = {"script", "style", "noscript"}
NOT_TEXT = {"template", "rt", "rp"}
VOID = {
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img",
    "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr",
}

# Scripts and styles with their content, and the white space that is reduced. The opening tag ends at its first ">": were it allowed to run on,
# a page cut off inside a script would be searched once for every later ">".
SCRIPTS = r"(?is)<(script|style)[^>]*+>.*?</\1>"

# Entities decoded without leaving the JVM; &amp; goes last because decoding is a single pass.
COMMON_ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": "\xa0", "&copy;": "\xa9",
    "&middot;": "\xb7", "&rsquo;": "\u2019", "&lsquo;": "\u2018", "&rdquo;": "\u201d", "&ldquo;": "\u201c",
    "&ndash;": "\u2013", "&mdash;": "\u2014", "&hellip;": "\u2026", "&bull;": "\u2022", "&euro;": "\u20ac",
    "&#8217;": "\u2019", "&#8211;": "\u2013", "&#160;": "\xa0", "&amp;": "&",
}


class _TextNodes(HTMLParser):
    """Collects the text nodes of one document."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.open: list[str] = []
        self.counts: Counter[str] = Counter()  # of open tags, as the stack may be long
        self.hidden = 0
        self.pending: list[str] = []
        self.nodes: list[str] = []

    def flush(self) -> None:
        text = "".join(self.pending)
        self.pending.clear()
        if not text or self.hidden:
            return
        if not text.strip("\n\t\x0c\r ") and not self.counts["pre"] and not self.counts["textarea"]:
            text = "\n" if "\n" in text else " "
        self.nodes.append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        if tag not in VOID:
            self.open.append(tag)
            self.counts[tag] += 1
            self.hidden += tag in DROPPED or tag in NOT_TEXT

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.flush()

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if self.counts[tag]:
            while True:
                closed = self.open.pop()
                self.counts[closed] -= 1
                self.hidden -= closed in DROPPED or closed in NOT_TEXT
                if closed == tag:
                    break

    def handle_data(self, data: str) -> None:
        self.pending.append(data)

    def handle_entityref(self, name: str) -> None:
        known = html5.get(name + ";")
        self.pending.append(known if known is not None else "&" + name)

    def handle_charref(self, name: str) -> None:
        self.pending.append(unescape(f"&#{name};") or "\N{REPLACEMENT CHARACTER}")

    def handle_comment(self, data: str) -> None:
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment


def bare_of_scripts(document: str) -> str:
    """What is left when ``SCRIPTS`` is removed, in linear time: tags are found once, ends looked up."""
    ends = {kind: [m.start() for m in re.finditer(rf"(?i)</{kind}>", document)] for kind in ("script", "style")}
    closing = [m.start() for m in re.finditer(">", document)]
    out, at = [], 0
    for m in re.finditer(r"(?i)<(script|style)", document):
        if m.start() < at:
            continue
        kind = m.group(1).lower()
        tag_end = bisect_left(closing, m.end())
        if tag_end == len(closing):
            break
        end = bisect_left(ends[kind], closing[tag_end] + 1)
        if end < len(ends[kind]):
            out.append(document[at : m.start()])
            at = ends[kind][end] + len(kind) + 3
    return "".join(out) + document[at:]


def text_nodes(document: str | None) -> str:
    """Text nodes joined by new lines, without scripts and styles; blanks collapsed.

    A document the parser gives up on is read by removing its tags.
    """
    if not document:
        return ""
    parser = _TextNodes()
    try:
        parser.feed(document)
        parser.close()
    except Exception:
        head, angle, tail = bare_of_scripts(document).rpartition(">")
        bare = re.sub(r"<[^>]+>", " ", head + angle) + tail
        return " ".join(unescape(bare).split())
    parser.flush()
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(parser.nodes))
    return re.sub(r"[ \t]{2,}", " ", text).strip()


@F.pandas_udf(StringType())
def _text_nodes(documents: pd.Series) -> pd.Series:
    return documents.map(text_nodes, na_action="ignore").astype(object)


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(unescape, na_action="ignore").astype(object)


def nodes(document: Column | str) -> Column:
    """Text of a document node by node (Arrow batches)."""
    text = as_col(document)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(_text_nodes(text))


@F.pandas_udf(StringType())
def _bare_of_scripts(documents: pd.Series) -> pd.Series:
    return documents.map(bare_of_scripts, na_action="ignore").astype(object)


def without_scripts(document: Column | str) -> Column:
    """A page without its scripts and styles.

    An opening tag behind the last end tag of its kind would be searched to the end of the page for nothing; pages
    with such tags are read by a scan in Python instead of the pattern.
    """
    text = F.coalesce(as_col(document), F.lit(""))
    spare = F.lit(False)
    for kind in ("script", "style"):
        spare = spare | F.substring_index(F.lower(text), f"</{kind}>", -1).contains(f"<{kind}")
    by_pattern = F.regexp_replace(F.when(~spare, text), SCRIPTS, "")
    return F.coalesce(by_pattern, _bare_of_scripts(F.when(spare, text)))


def without_tags(document: Column | str) -> Column:
    """Every tag a blank. Entities still encoded.

    The text behind the last ``>`` holds no tag. It is set aside, since every ``<`` in it would be searched to
    its end for nothing.
    """
    text = as_col(document)
    tail = F.substring_index(text, ">", -1)
    head = F.left(text, F.length(text) - F.length(tail))
    return F.concat(F.regexp_replace(head, r"<[^>]++>", " "), tail)


def decoded(bare: Column | str) -> Column:
    """Entities of tag-free text decoded and white space collapsed.

    Python decodes the texts with unusual entities; the other rows pass through the same Arrow stage as nulls.
    """
    text = as_col(bare)
    usual = "|".join(e[1:] for e in COMMON_ENTITIES)
    unusual = text.rlike(rf"&(?!(?:{usual}))(?:#|[A-Za-z])")
    plain = text
    for entity, char in COMMON_ENTITIES.items():
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return collapse(F.coalesce(_unescape(F.when(unusual, text)), plain))
