import math
import re
import zlib

import numpy as np
import pytest

from maillake.llm import language as lg
from maillake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [1, 2, 4, 6, 7, 40])
def test_codewords_differ(n):
    code = lg.codewords(n)
    assert len({tuple(r) for r in code}) == n and set(np.unique(code)) <= {-1.0, 1.0}


def test_held_out_accuracy(spark):
    rows = QUERIES["op6_language"](spark, SF).collect()
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(known)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    test = [r for r in rows if r["held_out"]]
    wrong = [r for r in test if r["lang_pred"] != known[r["doc_id"]]]
    assert len(wrong) <= 0.01 * len(test)
    assert sum(r["ambiguous"] for r in rows) <= 0.01 * len(rows)


def plain_features(text):
    """Shares of n-grams as they are stated, one by one."""
    letters = "".join(c if c.isascii() and c.islower() or ord(c) >= 170 else " " for c in text.lower())
    letters = re.sub(" +", " ", letters)
    counts = [0] * lg.DIMENSIONS
    for order in lg.ORDERS:
        for i in range(len(letters) - order + 1):
            gram = 0
            for c in letters[i : i + order]:
                gram = (gram * 0x100000001B3 + ord(c)) % 2**64
            counts[((gram * 0x9E3779B97F4A7C15 + order) % 2**64 >> 40) % lg.DIMENSIONS] += 1
    total = sum(counts)
    return [math.sqrt(c / total) if total else 0.0 for c in counts]


def plain_decoding(model, row):
    """Loss-weighted decoding written out: each bit's loss for each codeword, weighted by the trust in the bit."""
    margins = [sum(x * w for x, w in zip(row, column) if x) + b for column, b in zip(model.weights.T.tolist(), model.bias.tolist())]
    losses = []
    for word in model.code.tolist():
        losses.append(sum(t * math.log1p(math.exp(-m * bit)) for m, bit, t in zip(margins, word, model.trust.tolist())))
    scale = len(margins) / sum(model.trust.tolist())
    likes = [math.exp(-(loss - min(losses)) * scale) for loss in losses]
    order = sorted(range(len(likes)), key=lambda i: -likes[i])
    score = [x / sum(likes) for x in likes]
    return order[0], score[order[0]], score[order[0]] - score[order[1]]


def test_the_query_against_plain_features_and_decoding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    apart = docs.withColumn("held_out", lg.held_out())
    model = lg.train(apart.where("not held_out"))
    got = {r["doc_id"]: r for r in QUERIES["op6_language"](spark, "/root/testdata/sf0.001").collect()}
    for d in docs.orderBy("doc_id").collect():
        text, r = d["text"] or "", got[d["doc_id"]]
        if len(text) > 3000:
            continue
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        row = plain_features(text)
        assert np.allclose(lg.features(text), row, atol=1e-5)
        best, score, gap = plain_decoding(model, row)
        assert r["score"] == pytest.approx(score, abs=1e-3) and (r["lang_pred"] == model.languages[best] or gap < 1e-3)
        assert r["ambiguous"] == (gap < lg.CLOSE) or abs(gap - lg.CLOSE) < 1e-3


def test_wrong_bits_are_corrected():
    """With nine languages a codeword is still the nearest with some bits wrong."""
    code = lg.codewords(9)
    bits = code.shape[1]
    apart = min((code[i] != code[j]).sum() for i in range(9) for j in range(i))
    model = lg.Model([str(i) for i in range(9)], code, np.zeros((1, bits), np.float32), np.zeros(bits, np.float32), np.ones(bits, np.float32))
    rng = np.random.default_rng(1)
    for k in range(9):
        for _ in range(20):
            margins = code[k] * 3
            wrong = rng.choice(bits, (apart - 1) // 2, replace=False)
            margins[wrong] *= -1
            model.bias = margins.astype(np.float32)
            assert model.predict(np.zeros((1, 1), np.float32))[0][0] == k


def test_edge_rows(spark):
    learn = [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)]
    model = lg.train(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    rows = [(1, None), (2, ""), (3, "123 %%%"), (4, "the dog " * 300000), (4, "the dog"), (None, "le chien"), (5, "été")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as _text", "1 as Score", "'z' as LANG_PRED", "3 as c0", "4 as t")
    got = [(r["doc_id"], r["lang_pred"]) for r in lg.identify(docs, model).collect()]
    assert sorted(got, key=str)[:6] == sorted(
        [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "fr"), (5, got[-1][1])], key=str
    )[:6]
    nothing = lg.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in lg.identify(docs, nothing).collect()} == {"und"}
    assert lg.identify(docs.limit(0), model).count() == 0


def test_too_many_labels(spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "'a b' as text", "cast(id as string) as lang")
    with pytest.raises(ValueError):
        lg.train(docs)
