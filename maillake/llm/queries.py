"""One registered query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_repair,
    decontaminate,
    fingerprints,
    language,
    licenses,
    mixing,
    near_dup,
    neighbours,
    periodic_runs,
    secrets,
    sharding,
    sqltext,
    token_files,
    url_rules,
    vector_dup,
)
from .registry import QUERIES, query  # noqa: F401
from .store import bound_batches, scratch, table


@query("op1_mixing", sqltext.MIXING)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.measure(table(spark, sf_dir, "documents")).select("doc_id", "source", "size")
    # Written once, so that the texts are counted once for both the sums and the rows.
    tables = scratch(spark, "mixing")
    planned = mixing.plan(tables.write(docs, "sizes"), tables)
    taken = F.col("size") * F.col("copies")
    return planned.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "rate")


@query("op4_url_rules", sqltext.URL_RULES)
def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def sharded(spark: SparkSession, docs: DataFrame, shards: int) -> DataFrame:
    """Shard and place of every document, by a map balanced over the documents' bytes."""
    tables = scratch(spark, "sharding")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    sized = docs.select(
        "doc_id",
        sharding.byte_size().alias("size"),
        crc.alias("text_crc32"),
        sharding.slot_of().alias("virtual_slot"),
    )
    sized = tables.write(sized, "sizes")
    loads, counts = sharding.slot_loads(sized)
    first = sharding.dealt(shards)
    owner = sharding.rebalance(first, loads, shards)
    for version, of in enumerate((first, owner)):
        sharding.save_map(spark, tables.path("slot_map"), of, version)
    assigned = sharding.assign(sized, sharding.load_map(spark, tables.path("slot_map"), 1))
    return sharding.place(assigned, sharding.starts_frame(spark, owner, counts), ["doc_id", "text_crc32", "size"])


def with_shards(spark: SparkSession, docs: DataFrame, shards: int) -> DataFrame:
    """The documents with ``virtual_slot`` and ``shard``; only slot and size are read for the map."""
    slotted = docs.withColumn("virtual_slot", sharding.slot_of())
    loads, _ = sharding.slot_loads(slotted.select("virtual_slot", sharding.byte_size().alias("size")))
    owner = sharding.rebalance(sharding.dealt(shards), loads, shards)
    tables = scratch(spark, "shards")
    for version, of in enumerate((sharding.dealt(shards), owner)):
        sharding.save_map(spark, tables.path("slot_map"), of, version)
    return sharding.assign(slotted, sharding.load_map(spark, tables.path("slot_map"), 1))


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharded(spark, table(spark, sf_dir, "documents"), 24)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    apart = docs.withColumn("held_out", language.held_out())
    model = language.train(apart.where(~F.col("held_out")))
    told = language.identify(apart.select("doc_id", "held_out", "text"), model)
    return told.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    folder = scratch(spark, "token-files").root
    manifest = token_files.write_shards(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return token_files.read_digests(manifest, folder)


@query("op9_secrets")
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    every = F.expr(secrets.in_order("concat(base_spans, layer_spans)"))
    counts = {
        f"n_{kind}": F.expr(f"cast(size(filter(base_spans, s -> startswith(s, '{kind}:'))) as long)")
        for kind in secrets.KINDS
    }
    return found.select(
        "doc_id",
        *[n.alias(name) for name, n in counts.items()],
        F.sha2(F.array_join("base_spans", ","), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
        "layers",
        "unscanned",
    )


@query("op5_licenses")
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    found = licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct("licenses.license")), ",").alias("license_ids"),
        F.to_json("licenses").alias("findings"),
    )


@query("op3_near_duplicates")
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_dup.classes(docs, scratch(spark, "near-dup"))
    return found.select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))


@query("op7_vector_duplicates")
def op7_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_dup.near_duplicates(table(spark, sf_dir, "embeddings"), scratch(spark, "vector-dup"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


@query("op2_decontaminate")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), scratch(spark, "decontaminate"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "overlap")


def planted_runs() -> Column:
    """The text in which every tenth document, by the CRC of its key, repeats a stretch of its words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    place = "if(i < g % size(w), i, g % size(w) + (i - g % size(w)) % (1 + floor((size(w) - g % size(w)) / (3 + g % 8))))"
    repeated = f"""element_at(transform(array(regexp_extract_all(text, r'[^\\x20\\x09-\\x0D]+', 0)), w ->
        case when size(w) = 0 then text
        else array_join(transform(sequence(0, size(w) - 1), i -> w[cast({place} as int)]), ' ') end), 1)"""
    g = "floor(crc32(cast(cast(doc_id as string) as binary)) / 10)"
    return F.when(h % 10 == 0, F.expr(repeated.replace("g %", f"{g} %"))).otherwise(F.col("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", planted_runs().alias("text"))
    found = periodic_runs.find_runs(docs)
    best = F.expr("aggregate(runs, get(runs, 0), (b, r) -> if(r.length * b.period > b.length * r.period, r, b))")
    lines = F.expr(r"transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


@query("op13_fingerprints")
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents")
    paired = neighbours.with_next(docs, "doc_id", "text", scratch(spark, "fingerprints"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, cast(length(text) - floor(length(text) / 2) as int))"), F.left("next_text", half))
    rows = paired.select("doc_id", "text", "next_text", edited.alias("edited"), F.length("text").cast("long").alias("n_chars"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = fingerprints.fingerprint(rows, ["text", "edited", "next_text"], ["own", "changed", "following"])
    own, changed, following = F.col("own"), F.col("changed"), F.col("following")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.text_of(own).alias("fingerprint"),
        fingerprints.text_of(changed).alias("edited_fingerprint"),
        fingerprints.likeness(own, changed).alias("near_edited"),
        fingerprints.likeness(own, following).alias("near_next"),
        fingerprints.containment(own, changed).alias("kept_share"),
        fingerprints.resemblance(own, changed).alias("edited_jaccard"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations with one kind of damage each, by the CRC of conversation and turn."""
    name, space = (lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))), F.lit(" ")
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.coalesce("text", space)
    changed = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1))
    role = F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", space))
    rows = conversations.select("conv_id", "turn", role.alias("role"), changed.alias("text"), times.alias("_times"))
    copies = F.explode(F.when(F.col("_times") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), "_times")))
    return rows.select("conv_id", "turn", "role", "text", copies.alias("_copy")).drop("_copy")


@query("op11_conversation_repair", sqltext.CONVERSATION_REPAIR)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.repair(damaged(rows), scratch(spark, "conversation-repair"))
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    counted = conversation_repair.COUNTED
    whole = found.whole.select("conv", *counted, "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    digests = conversation_repair.joined_digests(found.pieces).withColumnRenamed("conv", "of")
    split = found.split.join(digests, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    every = rows.select("conv_id").distinct()
    joined = every.join(whole.unionByName(split), F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    return joined.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counted],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
