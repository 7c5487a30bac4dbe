"""Search over several namespaces as one plan: routed hits, fused, judged, and widened where the evidence is weak."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.operators.retrieval import namespace_fusion
from sparkquarry.operators.rows import decide_evidence, observe_evidence


def routed_search(routes: DataFrame, hits: DataFrame, threshold: float | None, mode: str = "active", per_namespace: int = 8, top: int = 5) -> DataFrame:
    """(query_id, namespace, key, local_rank, cross_rank, score, rank, widened) of each query's routes.

    routes(query_id, namespace, route_rank, fanout), hits(query_id, namespace, key, local_score, cross_score).
    A query is first asked of its first ``fanout`` namespaces; where that gives no hit or, in active mode,
    weak evidence, all its routes are asked.
    """
    met = hits.join(routes.select("query_id", "namespace", "route_rank", "fanout"), ["query_id", "namespace"])
    narrow = namespace_fusion(met.where("route_rank <= fanout"), per_namespace, top)
    seen = routes.select("query_id").distinct().join(observe_evidence(narrow), "query_id", "left")
    judged = decide_evidence(seen, threshold, mode)
    weak = judged.where((F.col("weak") & F.col("enforced")) | F.col("candidates").isNull()).select("query_id")
    wide = namespace_fusion(met.join(weak, "query_id", "left_semi"), per_namespace, top)
    columns = ["query_id", "namespace", "key", "local_rank", "cross_rank", "score", "rank"]
    return narrow.join(weak, "query_id", "left_anti").select(*columns, F.lit(False).alias("widened")).unionByName(wide.select(*columns, F.lit(True).alias("widened")))
