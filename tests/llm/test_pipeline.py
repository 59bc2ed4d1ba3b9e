import json

import corpus_pipeline as cp
from maillake.llm import language, mixing, near_dup
from maillake.llm.queries import QUERIES
from maillake.llm.store import scratch

from .helpers import component_names, jaccard, shingle_set, words

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((json.dumps(r.asDict(), sort_keys=True) for r in df.collect()))


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(-1, None, None, "q", 0), (-2, "12 %%", "en", None, 5)], docs.schema)
    docs = docs.unionByName(junk)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}

    kept = cp.language(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, t in rows.items() if t and any(c.isalpha() for c in t)}

    single = cp.near_duplicates(spark, kept, SF)
    known = {r["doc_id"]: shingle_set(r["text"]) for r in kept.collect()}
    links = [(a, b) for a in known for b in known if a < b and jaccard(known[a], known[b]) >= near_dup.SIMILARITY]
    names = component_names(known, links)
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == set(names.values())

    clean = cp.decontaminate(spark, single, SF)
    flat = lambda t: " " + " ".join(words(t)) + " "
    items = [flat(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    free = {r["doc_id"] for r in single.collect() if not any(i in flat(r["text"]) for i in items)}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == free

    mixed = cp.mix(spark, clean, SF)
    times = {r["doc_id"]: r["copies"] for r in mixing.plan(mixing.measure(clean), scratch(spark, "test")).collect()}
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert mixed.columns == docs.columns and got == {k: n for k, n in times.items() if n}

    placed = cp.shard(spark, mixed, SF)
    assert rows_of(placed.select(*docs.columns)) == rows_of(mixed)
    assert {r["shard"] for r in placed.collect()} <= set(range(cp.SHARDS))


def test_chosen_languages_are_kept_by_their_prediction(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(cp, "LANGUAGES", ("en", "xx"))
    told = language.identify(docs, language.train(docs))
    want = {r["doc_id"] for r in told.where("lang_pred = 'en'").collect()}
    got = {r["doc_id"] for r in cp.language(spark, docs, SF).collect()}
    assert got == want and 0 < len(want) < docs.count()


def test_the_query_applies_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert rows_of(QUERIES["pipeline"](spark, SF)) == rows_of(docs)


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(1, "some words are here", "en", "s", "z", 1)],
        "doc_id long, text string, lang string, source string, size string, item_ids int",
    ).selectExpr("*", "'a' as shard", "'b' as score", "'c' as copies", "'d' as lang_pred", "1 as _text", "2 as _digest")
    for rows in (docs.limit(0), docs):
        for name, stage in cp.STAGES:
            out = stage(spark, rows, SF)
            if name == "shard":
                assert set(rows.columns) <= set(out.columns)
            else:
                assert out.columns == rows.columns and rows_of(out) == rows_of(rows)


def test_documents_of_a_few_words_that_hold_an_item_go(spark, tmp_path):
    item = "seven plain words make this short text"
    spark.createDataFrame([(5, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, item, "a"), (2, "others", "a"), (3, None, "b")], "doc_id long, text string, source string")
    kept = cp.decontaminate(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
