"""All registered queries and their SQL equivalents."""

from .plans import core, extra, structure

QUERIES = {**core.QUERIES, **structure.QUERIES, **extra.QUERIES}
ORACLES = {**core.ORACLES, **structure.ORACLES, **extra.ORACLES}
