"""All queries of the core library by name, and their SQL oracles."""

from __future__ import annotations

from ledgerloom.plans import amounts, general, reading, records, reference, views

QUERIES: dict = {}
ORACLE: dict = {}
for module in (general, reference, amounts, views, reading, records):
    QUERIES |= module.QUERIES
    ORACLE |= module.ORACLE
