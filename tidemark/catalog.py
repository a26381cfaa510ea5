"""All queries outside the training-data subpackage, and their SQL. Importing a module registers its queries."""

from __future__ import annotations

import tidemark.functions.predicates  # noqa: F401
import tidemark.operators.backtest  # noqa: F401
import tidemark.operators.forecast  # noqa: F401
import tidemark.operators.indicators  # noqa: F401
import tidemark.operators.journal  # noqa: F401
import tidemark.operators.ledger  # noqa: F401
import tidemark.operators.market  # noqa: F401
import tidemark.operators.outlook  # noqa: F401
import tidemark.operators.pools  # noqa: F401
import tidemark.operators.relational  # noqa: F401
import tidemark.operators.resolver  # noqa: F401
import tidemark.operators.search  # noqa: F401
import tidemark.operators.sectors  # noqa: F401
import tidemark.operators.text_events  # noqa: F401
import tidemark.operators.walkforward  # noqa: F401
import tidemark.plans.alerts  # noqa: F401
import tidemark.plans.rules  # noqa: F401
import tidemark.sources.bars  # noqa: F401
import tidemark.sources.parsers  # noqa: F401
import tidemark.sources.statements  # noqa: F401
import tidemark.sources.versions  # noqa: F401
import tidemark.streaming.state  # noqa: F401
import tidemark.streaming.stream  # noqa: F401
from tidemark.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
