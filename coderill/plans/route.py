"""Questions in natural language: intent, entity, and the operator that answers them.

The batch form works on a table of questions with ordered CASE expressions; :func:`plan_question` is the driver-side form that
names the operator for a single question."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coderill.functions.text import clean_symbol

# Ordered rules: the first that matches decides.
INTENTS = [
    ("count", r"how many|number of|count of"),
    ("call_chain", r"call chain|reach(es)? .*from|how does .* reach"),
    ("imports", r"which files import|what imports|imported by|what does .* import"),
    ("callers", r"who calls|which files call|callers of|where is .* called|what calls"),
    ("callees", r"what does .* call|callees of"),
    ("usage", r"where is .* used|usages? of|references? to|referenced"),
    ("definition", r"where is .* defined|definition of|defined"),
    ("configuration", r"config|setting|environment variable"),
    ("documentation", r"readme|documentation|how do i (set|install)|setup"),
    ("error_handling", r"error|exception|raise|throw"),
]
_ENTITY = r"(?:where is|call|calls|callers of|callees of|import|imports|definition of|usages? of|how many) ([A-Za-z_][A-Za-z0-9_.]*)"


def intent(question: str | Column) -> Column:
    q = F.lower(F.col(question) if isinstance(question, str) else question)
    out = F.lit("general")
    for name, pattern in reversed(INTENTS):
        out = F.when(q.rlike(pattern), name).otherwise(out)
    return out


def entity(question: str | Column) -> Column:
    """The asked symbol, cleaned; empty where none is named."""
    q = F.col(question) if isinstance(question, str) else question
    return clean_symbol(F.regexp_extract(q, f"(?i){_ENTITY}", 1))


def questions_of(documents: DataFrame) -> DataFrame:
    """Questions in documents: lines that begin with 'Q: '."""
    lines = documents.select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    q = lines.filter(F.col("l").startswith("Q: ")).select("doc_id", F.regexp_replace("l", r"^Q: |\s+$", "").alias("question"))
    return q.select("doc_id", "question", intent("question").alias("intent"), entity("question").alias("entity"))


OPERATORS = {"count": "count_symbols", "call_chain": "shortest_hops", "imports": "imports_of", "callers": "callers", "callees": "callees", "usage": "references", "definition": "primary_definition", "configuration": "config_entries", "documentation": "doc_sections", "error_handling": "error_sites"}


def plan_question(question: str) -> dict[str, str | None]:
    """Intent, entity and operator name of one question."""
    low = question.lower()
    kind = next((name for name, pattern in INTENTS if re.search(pattern, low)), "general")
    hit = re.search(_ENTITY, question, re.I)
    return {"intent": kind, "entity": hit.group(1) if hit else None, "operator": OPERATORS.get(kind, "hybrid_search")}


def answer_counts(questions: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every question with how many definitions and files its entity has, and an honest miss where there are none."""
    named = symbols.groupBy(F.lower("symbol_name").alias("_n")).agg(F.count("*").alias("definitions"), F.countDistinct("file_id").alias("files"))
    got = questions.withColumn("_n", F.lower("entity")).join(named, "_n", "left")
    answer = F.when(F.col("definitions").isNull(), F.concat(F.lit("No definition of '"), F.col("entity"), F.lit("' was found"))).otherwise(F.concat(F.col("definitions").cast("string"), F.lit(" definitions in "), F.col("files").cast("string"), F.lit(" files")))
    return got.select("doc_id", "question", "intent", "entity", F.coalesce("definitions", F.lit(0)).cast("long").alias("definitions"), answer.alias("answer"))
