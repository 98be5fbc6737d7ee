"""All registered queries; importing the modules fills the registry."""

from wayfarer.operators.registry import QUERIES, SQL
from wayfarer.plans import careers, enriched, files, mapping, merges, rankings, rules, search, streams, texts, vectors

FLAGSHIP = "rank_score_desc"

__all__ = ["FLAGSHIP", "QUERIES", "SQL", "careers", "enriched", "files", "mapping", "merges", "rankings", "rules", "search", "streams", "texts", "vectors"]
