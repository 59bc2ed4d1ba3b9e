"""URL filters by a bit-parallel wildcard automaton.

Rules become globs over the canonical URL (host in lower case, then the path). All globs are packed into one
row of 64-bit words, one bit per glob position, and a Shift-And step per byte moves every glob of every URL of
a batch at once: ``state = (((state << 1) | starts) & accepts[byte]) | (state & stays[byte])``. In a glob ``*``
stands for any run of bytes without ``/`` and ``**`` for any run.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule; repeated URLs are
judged alike; an empty table gives an empty one; columns of the input are kept, and the added ``host``,
``path``, ``rule`` and ``verdict`` replace columns of the same name. URLs of any length are read to the end of
their path or until only finished globs are alive.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
CHUNK_BYTES = 1 << 22


class Rule(NamedTuple):
    """A rule fits its host and the host's subdomains if the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the registered query; fixed values.
RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)


def escaped(text: str) -> str:
    """Text as a glob that stands for itself."""
    return "".join("\\" + c if c in "*\\" else c for c in text)


def globs_of(rule: Rule) -> list[str]:
    """The globs of a rule: the host itself, and any labels before it."""
    tail = f"{escaped(rule.host)}{escaped(rule.path)}**"
    return [tail, f"*.{tail}"]


class Automaton:
    """Packed masks of globs. Bit 0 of a glob is its start; a literal adds a bit, a star loops on the last one."""

    def __init__(self, globs: Sequence[str]) -> None:
        literals: list[list[int]] = []
        stars: list[dict[int, bool]] = []
        for glob in globs:
            data, own, loops, i = glob.encode(), [], {}, 0
            while i < len(data):
                if data[i] == 42:
                    deep = data[i + 1 : i + 2] == b"*"
                    loops[len(own)] = loops.get(len(own), False) or deep
                    i += 1 + deep
                else:
                    i += data[i] == 92
                    own.append(data[i])
                    i += 1
            literals.append(own)
            stars.append(loops)
        bits = sum(len(own) + 1 for own in literals)
        self.words = max(1, -(-bits // 64))
        self.accepts = np.zeros((256, self.words), np.uint64)
        self.stays = np.zeros((256, self.words), np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        self.final = np.zeros(self.words, np.uint64)
        self.done = np.zeros(self.words, np.uint64)
        self.ends: list[int] = []
        at = 0
        for own, loops in zip(literals, stars):
            self._set(self.first, at)
            for k, byte in enumerate(own):
                self._set(self.accepts[byte], at + k + 1)
            for k, deep in loops.items():
                for byte in range(256):
                    if deep or byte != 47:
                        self._set(self.stays[byte], at + k)
            end = at + len(own)
            self._set(self.final, end)
            if loops.get(len(own)):
                self._set(self.done, end)
            self.ends.append(end)
            at = end + 1

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def run(self, texts: Sequence[bytes]) -> np.ndarray:
        """Final states of all texts, one row of words each."""
        out = np.zeros((len(texts), self.words), np.uint64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(lengths, kind="stable")[::-1]
        # Texts of like length side by side; the padding of a chunk is bounded.
        i = 0
        while i < len(order):
            widest = max(1, int(lengths[order[i]]))
            part = order[i : i + max(1, CHUNK_BYTES // widest)]
            out[part] = self._run_chunk([texts[k] for k in part], lengths[part])
            i += len(part)
        return out

    def _run_chunk(self, texts: list[bytes], lengths: np.ndarray) -> np.ndarray:
        width = int(lengths[0])
        grid = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)
        state = np.repeat(self.first[None, :], len(texts), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        alive = len(texts)
        for k in range(width):
            while alive and lengths[alive - 1] <= k:  # longest first, so ended texts are the last ones
                alive -= 1
            now = state[:alive]
            if k % 64 == 63 and not (now & ~self.done).any():
                break  # only globs that accept whatever follows
            byte = grid[:alive, k]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:alive] = (moved & self.accepts[byte]) | (now & self.stays[byte])
        return state

    def matched(self, states: np.ndarray, glob: int) -> np.ndarray:
        end = self.ends[glob]
        return (states[:, end // 64] >> np.uint64(end % 64)) & np.uint64(1) == 1


def split_url(url: str) -> tuple[Column, Column]:
    """Canonical host and path of a URL column."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url)))
    host_raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host_raw) + 1, F.length(url)), r"\A[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(host_raw, upper, upper.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", default: str = ALLOW) -> DataFrame:
    """Pages with the longest rule that fits their URL and its verdict; else ``default``.

    Of rules of the same length the one listed first counts.
    """
    ranked = sorted(rules, key=lambda r: -len(r.text))
    globs = [g for r in ranked for g in globs_of(r)]

    def longest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton(globs)
        for urls in batches:
            states = automaton.run([u.encode("utf-8", "surrogatepass") for u in urls])
            found = np.full(len(urls), -1, np.int32)
            for rank in reversed(range(len(ranked))):
                fits = automaton.matched(states, 2 * rank) | automaton.matched(states, 2 * rank + 1)
                found[fits] = rank
            yield pd.Series(found)

    rank_of = F.pandas_udf(longest, "int")
    host, path = split_url(url)
    split = pages.withColumns({"host": host, "path": path})
    ranked_pages = split.withColumn("_rank", rank_of(F.concat("host", "path")))
    rule = verdict = F.lit(None).cast("string")
    if ranked:
        texts, verdicts = (F.array(*map(F.lit, column)) for column in zip(*[(r.text, r.verdict) for r in ranked]))
        rule = F.when(F.col("_rank") >= 0, F.get(texts, F.col("_rank")))
        verdict = F.when(F.col("_rank") >= 0, F.get(verdicts, F.col("_rank")))
    judged = ranked_pages.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.lit(default))})
    return judged.drop("_rank")
