"""The deterministic high-risk classifier of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow.functions.text import MARKERS, fold, has_marker

ALLOW, HUMAN_REVIEW = "allow", "human_review"

# The reasons given with either decision.
REASON_ALLOW = "Nenhum marcador determinístico de alto risco foi encontrado."
REASON_REVIEW = "Pedido potencialmente sensível requer validação humana."


def assess(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds decision and reason. A null text isn't assessed: both are null, never allow.

    The folded text is projected first, so it is computed once for all markers.
    """
    folded = df.withColumn("_folded", fold(F.col(text)))
    risky = has_marker(F.col("_folded"))
    decision = F.when(F.col("_folded").isNull(), None).when(risky, HUMAN_REVIEW).otherwise(ALLOW)
    reason = F.when(F.col("_folded").isNull(), None).when(risky, REASON_REVIEW).otherwise(REASON_ALLOW)
    return folded.withColumns({"decision": decision, "reason": reason}).drop("_folded")


def markers_hit(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, marker) for every marker that a text contains."""
    folded = df.select(key, fold(F.col(text)).alias("_folded"))
    hits = F.array_compact(F.array(*(F.when(F.contains("_folded", F.lit(m)), F.lit(m)) for m in MARKERS)))
    return folded.select(key, F.explode(hits).alias("marker"))
