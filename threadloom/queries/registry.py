"""The modules whose QUERIES and SQL are registered."""

from __future__ import annotations

from threadloom.queries import core, hierarchies, passthrough

MODULES = [core, passthrough, hierarchies]
FLAGSHIP = "hybrid_search"
