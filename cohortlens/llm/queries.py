"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.alignment import align_tokens
from cohortlens.llm.common import new_path
from cohortlens.llm.crf import identify_languages
from cohortlens.llm.license_families import MARKS, license_families
from cohortlens.llm.licenses import scan_licenses
from cohortlens.llm.lines import dedup_lines
from cohortlens.llm.mixing import mix
from cohortlens.llm.packing import pack
from cohortlens.llm.quality import judge_quality
from cohortlens.llm.simhash import simhash_components
from cohortlens.llm.token_files import read_tokens, write_tokens
from cohortlens.llm.topk import top_k
from cohortlens.llm.url_filter import UrlRule, host_path_rule, judge_urls
from cohortlens.llm.warc import read_warc, write_warc
from cohortlens.llm.whitening import whiten

HOST_RULES = (
    host_path_rule("com/", "allow"),
    host_path_rule("example.com/en/", "block"),
    host_path_rule("www.example.com/en/", "allow"),
    host_path_rule("net/es/", "block"),
    host_path_rule("net/fr/", "block"),
)
# What no host rule decides: spam hosts, feeds and print views, calendar traps.
URL_PATTERNS = (
    UrlRule("spam host", "block", r"^[^/]*\bspam\b", ("spam",), 0),
    UrlRule("casino host", "block", r"^[^/]*\bcasino\b", ("casino",), 0),
    UrlRule("feed", "block", r"/feed/?$", ("feed",), 0),
    UrlRule("calendar", "block", r"/calendar/\d{4}/\d{1,2}\b", ("calendar",), 0),
    UrlRule("binary file", "block", r"\.(?:exe|zip|gz|jpe?g|png|mp4)$", (), 0),
)

# Hashes of word runs that a line meets others on; by bits alone most similar lines never meet.
LINE_RUN_KEYS = 12


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge_quality(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.round("class_distance", 6).alias("class_distance"),
        F.round("word_distance", 6).alias("word_distance"),
    )


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"), license_families(), marks=MARKS)


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, HOST_RULES, URL_PATTERNS).drop("url")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, run_keys=LINE_RUN_KEYS).select("doc_id", "n_lines", "n_dropped", "text")


def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    return identify_languages(docs, learn=remainder != 2, carry=["doc_id"], spans=False).select(
        "doc_id",
        F.coalesce(remainder == 2, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )


def mix_levels() -> dict[str, Column]:
    """Domain, language and source; a domain is a family of sources, by the number in their name."""
    number = F.regexp_extract("source", "[0-9]{1,9}", 0)
    family = F.when(number != "", F.concat(F.lit("d"), (number.cast("long") % 3).cast("string")))
    return {"domain": F.coalesce(family, F.lit("other")), "lang": F.col("lang"), "source": F.col("source")}


MIX_WEIGHTS = {"domain": {"d0": 2}, "lang": {"en": 2}}


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), mix_levels(), weights=MIX_WEIGHTS)


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid"
    )


def token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_tokens(_table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": quality,
    "op2_license_scan": license_scan,
    "op3_url_filter": url_filter,
    "op4_line_dedup": line_dedup,
    "op5_exact_topk": exact_topk,
    "op6_language_id": language_id,
    "op7_packing": packing,
    "op8_mixing": mixing,
    "op9_simhash_neardup": simhash,
    "op10_warc": warc,
    "op11_token_files": token_output,
    "op12_whitening": whitening,
    "op13_token_alignment": alignment,
}
