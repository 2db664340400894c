"""Every query of the engine's own operators by name, over whole tables, with the SQL that gives the same rows."""

from tallyforge.catalogue import core, documents, evaluation, facts, plans, printed, stores  # noqa: F401  (they register their queries)
from tallyforge.register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
