"""The queries of this package and their comparison SQL."""

from __future__ import annotations

from folioforge.llm import oracle as _oracle
from folioforge.llm import queries as _queries

QUERIES = {name: query for name, query in vars(_queries).items() if name.startswith("op")}
ORACLE: dict[str, str] = {"op1_prefix_targets": _oracle.OP1, "op11_counted_middle": _oracle.OP11}
