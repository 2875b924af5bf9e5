"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_scan, line_dedup, prefix_trie

if TYPE_CHECKING:
    from .quality import NeighbourVote


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: A document counts as good from this score on.
QUALITY_CUT = 0.3

#: A line on so many sources is boilerplate.
MIN_SITES = 10


def _remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5


def _quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> NeighbourVote:
    from .quality import fit

    return fit(docs, _table(spark, sf_dir, "labels").where(_remainder() != 0))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose quality score is at the cut or above, with all their columns.

    Null and empty texts score the share of good labels, so they stay unless most labelled documents are bad.
    """
    from .quality import keep_from

    return keep_from(docs, _quality_model(spark, docs, sf_dir), QUALITY_CUT)


def without_spread_lines(docs: DataFrame) -> DataFrame:
    """The documents without lines that many sources share, each with the number of characters it then has, if there is a column n_chars.

    Null texts become empty ones; a document that loses all lines stays.
    """
    left = line_dedup.drop_spread_lines(docs, min_sites=MIN_SITES)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token across two lines goes to the one with most of its characters."""
    from .token_counts import attribute_tokens

    return attribute_tokens(_table(spark, sf_dir, "documents"), vocabulary(), sections="lines", rule="largest")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence signatures of every document."""
    from .license_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written as one file in document order, and read back."""
    from .shared import shared_path
    from .token_file import read_token_file, write_token_file

    path = shared_path(spark, "token-file")
    write_token_file(_table(spark, sf_dir, "documents"), path, vocabulary())
    return read_token_file(spark, path)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, at a weighted Jaccard similarity of 0.8 of five-word shingles."""
    from .near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more sources share, but for each line's first place."""
    from .line_dedup import drop_spread_lines

    return drop_spread_lines(_table(spark, sf_dir, "documents"), min_sites=MIN_SITES, counts=True).select("doc_id", "n_lines", "n_removed", "text")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labelled documents that aren't held out."""
    from .quality import score_documents

    docs = _table(spark, sf_dir, "documents")
    scored = score_documents(docs, _quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", (_remainder() == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    from .decontaminate import find_items

    return find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    from .sharding import shard

    return shard(_table(spark, sf_dir, "documents"), shards=40)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, compared with each other and with the next document's."""
    from .fingerprint import compare_with_next

    return compare_with_next(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte-pair merges, and the text decoded from them, as digests."""
    from .bpe import digest_texts

    return digest_texts(_table(spark, sf_dir, "documents"), vocabulary())


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by a byte-level and a sentencepiece vocabulary, aligned by bytes."""
    import public_tokenizers

    from .alignment import align_tokens

    return align_tokens(_table(spark, sf_dir, "documents"), vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every opening that conversations share, after each begins as another one of its five does."""
    turns, ids = prefix_trie.borrow_openings(prefix_trie.ordered_turns(_table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(turns, ids)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by form and by characters to a token."""
    import public_tokenizers

    from .secret_scan import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scan": op2_license_scan,
    "op3_token_file": op3_token_file,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_line_dedup": op5_line_dedup,
    "op6_fingerprints": op6_fingerprints,
    "op7_bpe": op7_bpe,
    "op8_quality": op8_quality,
    "op9_sharding": op9_sharding,
    "op10_decontamination": op10_decontamination,
    "op11_alignment": op11_alignment,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_secret_scan": op13_secret_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": license_scan.oracle_sql(),
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op12_prefix_trie": prefix_trie.ORACLE_SQL,
}
