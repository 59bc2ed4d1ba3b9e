import random

import numpy as np

from maillake.llm import decontaminate as dc
from maillake.llm.queries import QUERIES
from maillake.llm.store import scratch

from .helpers import words

SF = "/root/testdata/sf0.01"


def text_of(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(n))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_length_is_the_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        assert dc.common_length(dc.masks_of(np.array(a)), len(a), b) == lcs(a, b)


def found(spark, docs, items, blocks=None):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = dc.find_items(d, b, scratch(spark, "test")).collect()
    assert len(out) == len(docs)
    return [(r["doc_id"], r["item_ids"]) for r in sorted(out, key=lambda r: str(r["doc_id"]))]


def test_the_query_against_verbatim_search(spark):
    flat = lambda t: " " + " ".join(words(t)) + " "
    items = [(r["item_id"], flat(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op2_decontaminate"](spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        held = [i for i, t in items if t in flat(d["text"])]
        assert got[d["doc_id"]]["item_ids"] == held and got[d["doc_id"]]["contaminated"] == bool(held)


def test_paraphrases_long_items_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(dc, "SLICE_WORDS", 1000)
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 2)
    question = text_of(1, 40) + ". Answer: " + text_of(2, 4)
    swapped = question.split(" ")
    for i in range(0, 40, 4):
        swapped[i] = "other" + swapped[i]
    wrong = " ".join(swapped[:-4] + ["not", "this", "answer", "here"])
    long_item = text_of(3, 300)
    items = [(1, question), (2, long_item), (3, text_of(4, 20)), (4, text_of(5, 25)), (5, None), (6, "")]
    for shift in range(0, 16, 3):
        pad = text_of(100 + shift, 50 + shift)
        docs = [(1, f"{pad} {question} {pad}"), (2, f"{pad} {' '.join(swapped)} {pad}"), (3, f"{pad} {wrong} {pad}"),
                (4, text_of(6, 2900 + shift) + " " + text_of(4, 20) + " " + text_of(7, 3000)), (5, f"{pad} {long_item}"),
                (6, text_of(8, 3000)), (7, None), (8, ""), (9, text_of(5, 25)), (9, text_of(5, 25))]
        got = found(spark, docs, items)
        assert got == [(1, [1]), (2, [1]), (3, []), (4, [3]), (5, [2]), (6, []), (7, []), (8, []), (9, [4]), (9, [4])]
        break_early = shift >= 6
        if break_early:
            break


def test_paraphrases_of_the_rare_words_at_all_offsets(spark):
    rng = random.Random(9)
    vocabulary = text_of(20, 2000).split(" ")
    plain = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs = [(i, " ".join(plain(100))) for i in range(300)]
    item = plain(24)
    other = list(item)
    for k, i in enumerate((1, 5, 9, 13, 17, 21)):
        item[i] = other[i] = f"rare{k}"
        if k < 4:
            other[i] = f"changed{k}"
    held = [(1000 + shift, " ".join(plain(40 + shift) + other + plain(40))) for shift in range(8)]
    got = dict(found(spark, docs + held, [(1, " ".join(item))]))
    assert [k for k, own in got.items() if own] == [k for k, _ in held]


def test_the_bound_by_rare_words_loses_nothing(spark, monkeypatch):
    """The same findings as if every candidate went on to the longest common subsequence."""
    rng = random.Random(4)
    vocabulary = text_of(30, 400).split(" ")
    plain = lambda n: [rng.choice(vocabulary[: rng.choice([20, 400])]) for _ in range(n)]
    items = [(i, " ".join(plain(rng.randint(3, 70))) + rng.choice(["", ". Answer: " + " ".join(plain(4))])) for i in range(30)]
    docs = []
    for i in range(150):
        own = items[rng.randrange(30)][1].split(" ")
        for _ in range(rng.randrange(1 + len(own) // 2)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        docs.append((i, " ".join(plain(rng.randrange(80)) + own + plain(rng.randrange(80)))))
    docs.append((1000, " ".join(w for _, t in docs for w in t.split(" "))))
    monkeypatch.setattr(dc, "SLICE_WORDS", 3000)
    bounded = found(spark, docs, items)
    monkeypatch.setattr(dc.Slice, "possible", lambda self, counts, rare, block, begin, item: np.ones(len(item), bool))
    assert bounded == found(spark, docs, items) and sum(len(ids) for _, ids in bounded) > 40


def test_paraphrases_against_subsequences_at_all_places(spark):
    """Items whose words are there in order, by brute force over all places of a text, are found."""
    rng = random.Random(14)
    vocabulary = text_of(31, 3000).split(" ")
    plain = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, plain(rng.randint(16, 60))) for i in range(25)]
    docs = []
    for i in range(200):
        own = list(items[i % 25][1])
        for at in rng.sample(range(len(own)), int(rng.choice([0, 0.1, 0.2, 0.5]) * len(own))):
            own[at] = rng.choice(vocabulary)
        docs.append((i, plain(rng.randrange(60)) + own + plain(rng.randrange(60))))
    got = dict(found(spark, [(k, " ".join(t)) for k, t in docs], [(k, " ".join(t)) for k, t in items]))
    wanted = missed = 0
    for key, text in docs:
        for number, words_ in items:
            size = len(words_)
            places = range(0, max(1, len(text) - size + 1), 4)
            best = max(lcs(words_, text[p : p + size + 8]) for p in places) if set(words_) & set(text) else 0
            if best >= dc.WHOLE * size:
                wanted += 1
                missed += number not in got[key]
            elif number in got[key]:
                # Found nearby with more room, or at the share of a paraphrase with its answer: never below that.
                assert lcs(words_, text) >= dc.PARAPHRASE * size
    assert wanted >= 100 and missed == 0


def test_empty_tables_and_clashing_columns(spark):
    item = text_of(1, 30)
    assert found(spark, [(1, item)], []) == [(1, [])]
    assert found(spark, [], [(1, item)]) == []
    names = "doc_id long, text string, Item_IDs string, overlap int, _text int, c0 int, t int, key int"
    docs = spark.createDataFrame([(1, item, "x", 2, 3, 4, 5, 6)], names)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    (row,) = dc.find_items(docs, bench, scratch(spark, "test")).collect()
    assert row["item_ids"] == [7] and row["overlap"] == 1.0 and row["text"] == item and row["c0"] == 4


def blocks(stored):
    kinds = (np.uint16, np.uint8, np.uint8)
    rows = stored.where("terms is not null").select("terms", "times", "sizes").collect()
    return [tuple(np.frombuffer(data, kind) for data, kind in zip(row, kinds)) for row in rows]


def test_the_space_is_fitted_on_all_passages(spark):
    texts = spark.range(26_000).selectExpr("array_join(transform(sequence(1, 50), i -> concat('w', id * i % 9973)), ' ') as text")
    own = blocks(dc.passages(texts))
    assert sum(len(sizes) for _, _, sizes in own) == 52_000  # of 48 words and of 2 words
    assert sum(int(times.sum()) for _, times, _ in own) == 1_300_000


def test_products_with_all_passages_against_dense_matrices(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_PASSAGES", 9)
    rng = random.Random(21)
    vocabulary = text_of(22, 300).split(" ")
    docs = [" ".join(rng.choice(vocabulary[: rng.choice([5, 300])]) for _ in range(rng.choice([0, 1, 7, 48, 49, 500]))) for _ in range(60)]
    frame = spark.createDataFrame([(t,) for t in [*docs, None]], "text string").repartition(3)
    tables = scratch(spark, "test")
    stored = tables.write(dc.passages(frame), "passages")
    counts, total, n = dc.term_counts(stored)
    hashed = [dc.terms_of(words).tolist() for words in dc._hashed(docs)]
    assert total == 61 and n == sum(map(len, hashed))
    assert all(counts[t] == sum(t in own for own in hashed) for own in hashed for t in own)
    idf = dc.idf_of(counts, total)
    matrix = []
    for own in hashed:
        for at in range(0, len(own), dc.PASSAGE):
            row = np.zeros(dc.TERMS)
            for t in set(part := own[at : at + dc.PASSAGE]):
                row[t] = (1 + np.log(part.count(t))) * idf[t]
            matrix.append(row / np.linalg.norm(row))
    matrix = np.array(matrix)
    q = np.random.default_rng(3).standard_normal((dc.TERMS, 6)).astype(np.float32)
    rows = stored.where("terms is not null").select("terms", "times", "sizes")
    got = dc._gram_product(rows, idf, q, tables, "product")
    assert np.allclose(got, matrix.T @ (matrix @ q), atol=1e-3)


def test_items_and_documents_of_a_few_words_are_part_of_the_fit(spark):
    assert found(spark, [(1, "seven plain words make this short text"), (2, "others")], [(5, "seven plain words make this short text")]) == [(1, [5]), (2, [])]


def test_answers():
    assert dc.answer_of("What? Answer: forty two") == "forty two"
    assert dc.answer_of("One thing. Last words here.") == "Last words here"
    assert dc.answer_of("one sentence") == ""
    space = np.zeros((dc.TERMS, 4), np.float32)
    queries = dc.queries_of([], space, np.ones(dc.TERMS, np.float32))
    assert dc.judge(np.zeros(0, np.uint64), np.zeros(3, np.int64), space, queries, {})[0] == [[], []]
