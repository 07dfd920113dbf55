"""One query per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.columns import computed
from . import (chat, decontamination, embeddings, lexical, lmscore, packing, secretscan, simhash, sql, tokencounts, tokenfiles, toxicity,
               urlfilter, wordruns)
from .storage import new_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """What every document shares with the benchmark, by windows of 13 words."""
    found = decontamination.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
                        decontamination.is_contaminated().alias("contaminated"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document by a lexicon learned from the labels that are not held out."""
    docs = _table(spark, folder, "documents")
    found = toxicity.scored(docs, toxicity.fitted(docs, _table(spark, folder, "labels")))
    return found.select("doc_id", (toxicity.remainder() == 2).alias("held_out"), "score",
                        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate vectors of equal label."""
    return embeddings.near_duplicates(_table(spark, folder, "embeddings"))


# Names of sites to block, and of sites to keep, from which the small labelled table is made.
BLOCKED_SITES = """
casino-royal lucky-casino free-casino online-casino casino-win casino-bonus online-bets best-bets sports-bets win-big poker-win
slots-win cheap-meds pills-online buy-pills discount-pills cheap-watches cheap-loans cheap-flights-now adult-cams adult-video
adult-x xxx-adult hot-x x-girls adult-dating ads-server click-track track-ads popup-ads ad-track banner-ads spam-links spam-farm
link-farm seo-spam content-farm spam-blog free-money free-prizes free-downloads warez-free payday-loans miracle-pills
""".split()
KEPT_SITES = """
library thenews theherald weather theater nation station education history thereader mathematics thornton gardening thinking
northern thunder anthology within reading information thread thistle wherever shore others thought tradition together southern
stable whether entertainment ending ether thetis erosion handbook landscape thatched shanty standing thousand southland ashore
thenature thespian motion fashion mission cushion than lathe bathe tether thandie hands ofthewest wonderland thundershower
fatherland heathland newspaper thehistory sheather tithe tinder ration donations ottoman healthy
""".split()


def _labelled(spark: SparkSession) -> DataFrame:
    """The labelled urls: every name below subdomains, endings and paths that say nothing."""
    values = ", ".join(f"('{'https' if k % 2 else 'http'}://{('', 'www.', 'm.', 'blog.')[k % 4]}{name}.example."
                       f"{('com', 'net', 'org')[k % 3]}/{('en', 'de', 'en', 'fr', 'es')[k % 5]}/{k * 617 % 5000}', {label})"
                       for names, label in ((BLOCKED_SITES, "true"), (KEPT_SITES, "false")) for k, name in enumerate(names))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, block)")


def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's url, by rules and else by a model of character n-grams."""
    model = urlfilter.trained(_labelled(spark))
    return urlfilter.judged(_table(spark, folder, "pages"), model, allow=["org/", "com/fr/"],
                            block=["example.org/es/", "example.org/en/1", "com/de/"])


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of every document; the cache starts empty, so that every distinct text is encoded."""
    return tokencounts.counted(_table(spark, folder, "documents"), new_folder(spark, "token-cache"),
                               public_tokenizers.path("piece_bpe_32k.model"))


def op7_stupid_backoff(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's score by the words and word pairs of all other documents."""
    return lmscore.scored(_table(spark, folder, "documents"))


def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations formatted, and read back from what was formatted."""
    table = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit("</s>[INST] ok [/INST]").alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    messages = table.unionByName(own).select("conv_id", place.alias("msg_id"), "role", "text")  # each turn answers the one before
    messages = messages.withColumn("parent_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1))
    found = chat.formatted(messages).select("conv_id", "formatted", chat.turns_of(F.col("formatted")).alias("turns"), F.array_join(
        chat.loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                        F.length("formatted").cast("long").alias("formatted_chars"))


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, written to bit-packed files and read back."""
    out = new_folder(spark, "token-files")
    tokenfiles.write(_table(spark, folder, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return tokenfiles.read(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids along a Hilbert curve."""
    pieces = packing.packed(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the text: in one document of ten the words from some place on repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, planted = F.floor(h / 10), h % 10 == 0
    rows = computed(docs.select("doc_id", "text"), words=F.when(
        planted, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n = F.size("words").cast("long")
    rows = rows.withColumn("n", n).withColumn("a", (g % F.nullif("n", F.lit(0))).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    repeats = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), repeats), " ")
    return rows.select("doc_id", F.when(planted & (F.col("n") > 0), changed).otherwise(F.col("text")).alias("text"))


def op11_word_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of repeated words in every document, and digests of what stays without the repeats."""
    found = wordruns.repeated(with_planted_runs(_table(spark, folder, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    found = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.p")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]),
                                                   F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"),
                        length.alias("length"), period.alias("period"),
                        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return lexical.ranked(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op13_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The secrets of every document, counted by base kind, and all spans."""
    base = [r.kind for r in secretscan.BASE]

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = secretscan.spans(_table(spark, folder, "documents"))
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, base), F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_embedding_dedup, op3_url_filters, op4_simhash, op5_toxicity, op6_token_counts,
    op7_stupid_backoff, op8_chat_formatting, op9_token_files, op10_packing, op11_word_runs,
    op12_lexical_search, op13_secret_scan)}
SQL = {"op1_decontamination": sql.DECONTAMINATION, "op2_embedding_dedup": sql.EMBEDDINGS, "op8_chat_formatting": sql.CHAT,
       "op12_lexical_search": sql.LEXICAL, "op13_secret_scan": sql.secrets(secretscan.BASE, secretscan.MORE)}
