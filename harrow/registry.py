"""Every query of the library proper by name, with its SQL where SQL can say it."""

from __future__ import annotations

from harrow.plans import catalog_queries, entities, finish, item_queries, join_queries, list_queries, model_queries, order_queries, text_queries
from harrow.streaming import jobs

FLAGSHIP = "entity_first"
QUERIES: dict = {}
ORACLE: dict = {}

for _module in (entities, text_queries, join_queries, order_queries, catalog_queries, model_queries, item_queries, list_queries, finish, jobs):
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
