"""Language by function words, and documents' types by weighted keywords."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

# Function words by language, and the letters that words are made of.
FUNCTION_WORDS = {
    "en": ("the", "and", "of", "to", "in", "for", "is", "are", "be", "with", "this", "that", "shall", "from", "by", "on", "as", "at", "or", "an"),
    "es": ("de", "la", "el", "los", "las", "y", "en", "que", "por", "con", "del", "para", "se", "un", "una", "al", "es", "son", "su", "lo"),
}
LETTER = "[a-záéíóúüñçàèòïA-ZÁÉÍÓÚÜÑÇÀÈÒÏ]"
MARGIN = 2.0


def function_word_hits(text: Column, language: str) -> Column:
    """Runs of letters that are a function word; one pattern, no array of words."""
    return F.regexp_count(text, F.lit(f"(?<!{LETTER})(?i:{'|'.join(FUNCTION_WORDS[language])})(?!{LETTER})")).cast("long")


def with_language(docs: DataFrame, text: str = "text", language: str = "detected", share: str = "share") -> DataFrame:
    """``docs`` with the language and its share of hits on two digits; 'unknown' and 0 without hits, English on a tie."""
    x = docs.withColumns({f"__{k}": function_word_hits(F.col(text), k) for k in FUNCTION_WORDS})
    en, es = F.col("__en"), F.col("__es")
    part = F.round((F.greatest(en, es) / F.nullif(en + es, F.lit(0))).cast("decimal(12,8)"), 2).cast("decimal(4,2)")
    none = F.coalesce(en + es, F.lit(0)) == 0
    best = F.when(none, "unknown").when(en >= es, "en").otherwise("es")
    return x.withColumns({language: best, share: F.when(none, F.lit(0).cast("decimal(4,2)")).otherwise(part)}).drop("__en", "__es")


class Keyword(NamedTuple):
    schema: str
    pattern: str
    weight: float


#: Own tables of words that tell document types apart; weights by how far a word decides alone.
KEYWORDS: Sequence[Keyword] = (
    Keyword("invoice", r"\binvoice\b", 3), Keyword("invoice", r"\b(?:factura|facture|rechnung)\b", 3), Keyword("invoice", r"\bdue date\b", 1), Keyword("invoice", r"\bbill to\b", 2),
    Keyword("credit_note", r"\bcredit note\b", 6), Keyword("credit_note", r"\b(?:gutschrift|nota de crédito|avoir)\b", 6),
    Keyword("receipt", r"\breceipt\b", 3), Keyword("receipt", r"\b(?:change due|cash tendered)\b", 2), Keyword("receipt", r"\b(?:ticket|quittung|recibo)\b", 1),
    Keyword("contract", r"\bagreement\b", 3), Keyword("contract", r"\b(?:governing law|hereinafter|whereas)\b", 2), Keyword("contract", r"\b(?:contrato|vertrag|contrat)\b", 3),
    Keyword("purchase_order", r"\bpurchase order\b", 6), Keyword("purchase_order", r"\b(?:orden de compra|bestellung|bon de commande)\b", 6),
    Keyword("bank_statement", r"\b(?:opening|closing) balance\b", 3), Keyword("bank_statement", r"\b(?:bank statement|kontoauszug|extracto bancario)\b", 6),
    Keyword("waybill", r"\b(?:waybill|delivery note|lieferschein|albarán)\b", 6), Keyword("waybill", r"\b(?:consignee|gross weight)\b", 2),
)
#: An invoice shows at least one of these parts.
INVOICE_PARTS = r"\b(?:iban|due date|payment terms|bill to|invoice (?:no|number)|vencimiento|fällig|échéance)\b"


def keyword_scores(docs: DataFrame, keywords: Sequence[Keyword] = KEYWORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, schema, score for each schema that any keyword hits; each pattern counts once.

    The patterns become one projection of conditional weights, so the texts are neither
    copied for each rule nor shuffled.
    """
    schemas = sorted({k.schema for k in keywords})
    score = lambda s: sum((F.when(F.col(text).rlike(f"(?iU){k.pattern}"), F.lit(float(k.weight))).otherwise(F.lit(0.0)) for k in keywords if k.schema == s), F.lit(0.0))
    wide = docs.select(doc_id, *[score(s).alias(s) for s in schemas])
    pairs = ", ".join(f"'{s}', `{s}`" for s in schemas)
    return wide.select(doc_id, F.expr(f"stack({len(schemas)}, {pairs}) as (schema, score)")).where("score > 0")


def gated(scores: DataFrame, docs: DataFrame, schema: str = "invoice", parts: str = INVOICE_PARTS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Scores without those of ``schema`` for texts that show none of its parts."""
    shows = docs.select(doc_id, F.coalesce(F.col(text).rlike(f"(?iU){parts}"), F.lit(False)).alias("__shows"))
    return scores.join(shows, doc_id, "left").where((F.col("schema") != schema) | F.coalesce("__shows", F.lit(False))).drop("__shows")


def decide(scores: DataFrame, margin: float = MARGIN, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, doc_type, confidence: the top schema if it leads the runner-up by ``margin``."""
    g = scores.groupBy(doc_id).agg(
        F.max("score").alias("top"), F.sum("score").alias("total"),
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("schema").alias("schema")))).alias("ranked"),
    )
    second = F.coalesce(-F.get("ranked", F.lit(1))["s"], F.lit(0.0))
    g = g.where(F.col("top") - second >= margin)
    return g.select(doc_id, F.get("ranked", F.lit(0))["schema"].alias("doc_type"), F.round((F.col("top") / F.col("total")).cast("decimal(12,8)"), 2).cast("decimal(4,2)").alias("confidence"))
