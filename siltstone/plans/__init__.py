"""Named queries over the fixture tables, and the SQL that checks them."""

from . import ledgers, memories, operations, queues, rules, search, upkeep

_PARTS = (search, rules, ledgers, queues, upkeep, operations, memories)
QUERIES = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
ORACLE_SQL = {k: s for p in _PARTS for k, s in p.ORACLE_SQL.items()}
