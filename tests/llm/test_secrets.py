import base64
import bz2
import gzip
import hashlib
import lzma
import os
import random
import re
import subprocess
import sys
import urllib.parse
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from maillake.llm import secrets as sc
from maillake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
KEY = "AKIA" + "Q7" * 9
SECRET = 'password = "hunter2hunter2"'


def plain_scan(text):
    """The three patterns as they are stated."""
    text = text or ""
    out = []
    pattern = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(pattern, text):
        if not re.search("[\u017f\u212a]", m.group(1)) and len(m.group(2)) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def layers(text):
    base, more, _, _ = sc.scan_layers(text)
    assert [str(f) for f in base] == plain_scan(text)
    return [str(f) for f in more]


def test_nested_layers_map_to_the_original_text():
    for wrap in (
        lambda b: base64.b64encode(b).decode(),
        lambda b: base64.urlsafe_b64encode(b).decode().rstrip("="),
        lambda b: base64.b64encode(gzip.compress(b)).decode(),
        lambda b: base64.b64encode(zlib.compress(b)).decode(),
        lambda b: base64.b64encode(zstandard.compress(b)).decode(),
        lambda b: base64.b64encode(base64.b64encode(b)).decode(),
        lambda b: base64.b64encode(urllib.parse.quote(b.decode(), safe="").encode()).decode(),
    ):
        coded = wrap(f"é see {KEY} there".encode())
        text = f"ööö {coded} end"
        (found,) = layers(text)
        kind, start, end = found.split(":")
        assert kind == "access" and 4 <= int(start) < int(end) <= 4 + len(coded)


def test_url_and_unicode_escapes_keep_exact_places():
    text = f"x {urllib.parse.quote(SECRET, safe='')} y"
    assert layers(text) == [f"assign:2:{len(text) - 2 - 3}"]
    escaped = "".join(f"\\u{ord(c):04x}" for c in KEY)
    assert layers(f"ß {escaped} z") == [f"access:2:{2 + len(escaped)}"]


def test_cycles_and_junk_end():
    assert layers("%25" * 1000 + " " + "%2525" * 200) == []
    assert layers("A" * 200000) == [] and layers("%%%% \\u \\uZZZZ ==== =") == []
    assert layers("x" * 300000 + " " + "aB3" * 100000) == []


def test_compressed_parts_have_no_limit():
    """What lies behind many megabytes of blanks, or of letters without any, is found; the part has one span."""
    for filler in (b" " * 5_000_000, b"x" * 3_000_000 + b" ", b"ab cd\n" * 700_000):
        for pack in (gzip.compress, zlib.compress, zstandard.compress, bz2.compress, lzma.compress):
            bomb = base64.b64encode(pack(filler + KEY.encode() + b" " + filler)).decode()
            base, more, n, unscanned = sc.scan_layers("see " + bomb)
            assert [str(f) for f in more] == [f"access:4:{4 + len(bomb)}"] and unscanned == 0


def test_runs_longer_than_a_window_are_counted_and_scanned(monkeypatch):
    monkeypatch.setattr(sc, "WINDOW", 1000)
    monkeypatch.setattr(sc, "LONGEST", 4000)
    data = b"x," * 4000 + KEY.encode() + b"-" + b"y," * 4000
    base, more, n, unscanned = sc.scan_layers(base64.b64encode(gzip.compress(data)).decode())
    assert [f.kind for f in more] == [1] and unscanned > 0


def test_a_large_layer_takes_little_memory():
    code = """
import base64, resource, sys, zlib
from maillake.llm import secrets as sc
engine, parts = zlib.compressobj(1, wbits=31), []
words = [b"w%d " % i for i in range(200_000)]
for k in range(160):
    parts.append(engine.compress(b"".join(words[k:]) + b"line\\n"))
parts.append(engine.compress(b" AKIA" + b"Q7" * 9 + b" ") + engine.flush())
text = base64.b64encode(b"".join(parts)).decode()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
base, more, n, cut = sc.scan_layers(text)
assert 1 in [f.kind for f in more] and cut == 0
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 400_000  # KB, for more than 200 MB


def opened(text, found, depth=0):
    """All texts that a text holds, by decoding whole runs plainly and without places."""
    for run in re.findall(r"\S+", text):
        inner = []
        if "%" in run:
            inner.append(urllib.parse.unquote(run, errors="replace"))
        if "\\u" in run:
            inner.append(re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m.group(1), 16)), run))
        if re.fullmatch(r"[A-Za-z0-9+/]{16,}={0,2}", run) and len(run) % 4 == 0:
            data = base64.b64decode(run)
            for unpack in (gzip.decompress, zlib.decompress, bz2.decompress, lambda b: b):
                try:
                    inner.append(unpack(data).decode())
                    break
                except Exception:  # another kind
                    pass
        for one in inner:
            if one != run and one not in found and depth < 9:
                found.add(one)
                opened(one, found, depth + 1)
    return found


def test_random_nestings_against_plain_decoding():
    """The kinds of secrets in all layers, and spans that enclose just the coded part."""
    rng = random.Random(12)
    codings = [
        lambda t: base64.b64encode(t.encode()).decode(),
        lambda t: base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode(),
        lambda t: base64.b64encode(bz2.compress(t.encode())).decode(),
        lambda t: base64.b64encode(zlib.compress(t.encode())).decode(),
        lambda t: urllib.parse.quote(t, safe=""),
        lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    ]
    for _ in range(150):
        inner = " ".join(rng.choice([KEY, SECRET, "0123456789abcdef" * 2, "plain words", "\u00e9 \u00df"]) for _ in range(rng.randint(1, 3)))
        for _ in range(rng.randint(1, 4)):
            inner = rng.choice(codings)(f"{rng.choice(['', 'note '])}{inner}")
        text = f"head {inner} tail"
        kinds = {s.split(":")[0] for t in opened(text, set()) for s in plain_scan(t)}
        spans = [s.split(":") for s in layers(text)]
        here = {s.split(":")[0] for s in plain_scan(text)}
        assert {k for k, _, _ in spans} | here == kinds | here, text[:200]
        assert all(5 <= int(a) < int(b) <= 5 + len(inner) for _, a, b in spans)


def test_rules_of_the_base():
    for text in ("token: secret: abcdefghijkl", "PASSWORD='abc-def=ghi_jkl'", "\u017fecret=abcdefghijkl", "to\u212aen=abcdefghijklm", "toKen=abcdefghijklm",
                 "AKIA1234567890123 AKIA12345678901234", "0123456789abcdeF 0123456789abcdef0", "apikey=api_key=aaaaaaaaaaaa"):
        assert [str(f) for f in sc.scan(text)] == plain_scan(text)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, KEY), (3, KEY), (None, KEY), (4, "w " * 300000 + KEY)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(n) for n in ("Layers", "_text", "c0", "t", "Base_Spans")])
    got = sorted((str(r["doc_id"]), r["base_spans"]) for r in sc.find_secrets(docs).collect())
    assert got[0] == ("1", []) and got[1] == ("2", []) and len(got) == 6
    assert got[4] == ("4", [f"access:600000:{600000 + len(KEY)}"])
    assert sc.find_secrets(docs.limit(0)).count() == 0


def test_the_query_against_plain_patterns(spark):
    got = {r["doc_id"]: r for r in QUERIES["op9_secrets"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        base, r = plain_scan(d["text"]), got[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(b.startswith(k) for b in base) for k in sc.KINDS)
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(base) <= set(spans)
        keyed = [(int(s.split(":")[1]), sc.KINDS.index(s.split(":")[0])) for s in spans]
        assert keyed == sorted(keyed)


def test_wrapped_base64():
    rng = np.random.default_rng(2)
    noise = "".join(rng.choice(list("abcxyz .,\n"), 900))
    for size in (64, 76):
        for pack in (lambda b: b, gzip.compress, zlib.compress, zstandard.compress):
            for end in ("\n", "\r\n", "\n    "):
                coded = base64.b64encode(pack(f"{noise} {KEY} {noise}".encode())).decode()
                lines = [coded[i : i + size] for i in range(0, len(coded), size)]
                for before in ("Cert: ", "ContentOfTheMessage1\n"):
                    assert any(f.startswith("access:") for f in layers(f"{before}{end.join(lines)}\n\nend"))


def test_secrets_beside_bytes_that_are_no_utf8():
    assert any(f.startswith("assign:") for f in layers("caf%E9&password%3Dhunter2hunter2"))
    for data in (f"\x01 {KEY} ".encode(), b"\xe9 " + KEY.encode() + b" \xff", KEY.encode("utf-16"), f" {KEY} ".encode("utf-16-be")):
        assert any(f.startswith("access:") for f in layers(base64.b64encode(data).decode()))


def test_broken_streams_keep_what_was_unpacked():
    for pack in (gzip.compress, zlib.compress):
        data = pack(f"{KEY} ".encode() + np.random.default_rng(1).bytes(4000).hex().encode())
        assert any(f.startswith("access:") for f in layers(base64.b64encode(data[: len(data) // 2]).decode()))
