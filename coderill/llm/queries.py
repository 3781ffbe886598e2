"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coderill.llm import corpus, docpairs, handwritten, mixing, packing, pieces, pii, secrets, syntax
from coderill.sources.tables import table


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus.files_with_language(table(spark, sf, "km_files"), table(spark, sf, "file_metadata"), syntax.LANGUAGES)
    return syntax.check_files(files)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Files that are not valid in their language."""
    return _checked(spark, sf).filter("edit_cost > 0").select("file_id")


def p1_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of invalid files per repository and language."""
    return syntax.invalid_rates(_checked(spark, sf))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of files that hold a credential, in the file or in the configuration value read from it."""
    return secrets.find_lines(table(spark, sf, "km_files"), table(spark, sf, "km_configs"))


def p2_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """All files with their credentials replaced."""
    return secrets.redact_files(table(spark, sf, "km_files"), table(spark, sf, "km_configs"))


def p2_redacted_configs(spark: SparkSession, sf: str) -> DataFrame:
    """All configuration values with their credentials replaced."""
    return secrets.redact_configs(table(spark, sf, "km_files"), table(spark, sf, "km_configs"))


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every oversized chunk."""
    return pieces.split_chunks(table(spark, sf, "chunks"), table(spark, sf, "chunk_limits"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that had to be cut."""
    return p3_pieces(spark, sf).filter("piece_no = 1").select("chunk_id")


def p4_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Code and description of every documented function and method."""
    return docpairs.pair_functions(table(spark, sf, "km_symbols"), table(spark, sf, "km_files"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols that gave a pair."""
    return p4_pairs(spark, sf).select("symbol_id")


def _code(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All code files, and those of them to train with."""
    files, metadata = table(spark, sf, "km_files"), table(spark, sf, "file_metadata")
    read = lambda rows: corpus.files_with_language(rows, metadata, handwritten.LANGUAGES)
    return read(files), read(handwritten.sample_of(files, metadata))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Source files that were not written by hand in their repository."""
    return handwritten.not_handwritten(*_code(spark, sf), table(spark, sf, "library_files")).select("file_id")


def p5_validation(spark: SparkSession, sf: str) -> DataFrame:
    """How the machine does on held-out repositories, by headers that it does not see."""
    files, chosen = _code(spark, sf)
    library = table(spark, sf, "library_files")
    return handwritten.validate(handwritten.score(files, library, handwritten.train(chosen, library)))


def p6_pack(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in containers of every capacity."""
    return packing.pack_documents(table(spark, sf, "documents"), table(spark, sf, "pack_capacities"))


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers of every capacity are."""
    return packing.fill_report(p6_pack(spark, sf))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Every mix as segments of documents."""
    return mixing.mix_documents(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of every source in every mix."""
    return mixing.share_report(p7_mix(spark, sf), table(spark, sf, "mix_targets"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every occurrence of personal information in the documents."""
    found = pii.find_pii(table(spark, sf, "documents"), table(spark, sf, "name_lexicon"))
    return found.select("doc_id", "pii_kind", "start_char")


def p8_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with placeholders in place of personal information."""
    return pii.redact_pii(table(spark, sf, "documents"), table(spark, sf, "name_lexicon"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_rates, p2_found, p2_redacted, p2_redacted_configs, p3_found, p3_pieces, p4_found, p4_pairs, p5_found, p5_validation, p6_pack, p6_fill, p7_mix, p7_shares, p8_found, p8_redacted)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": """
            SELECT DISTINCT c.chunk_id FROM chunks c
            JOIN chunk_limits l ON lower(c.file_language) = lower(l.file_language)
            WHERE length(c.source_text) > l.max_chars""",
    }
