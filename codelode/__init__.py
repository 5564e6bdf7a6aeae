"""Code-evidence analytics and corpus preparation on Spark.

What a program needs is here by name: ``Index`` (a snapshot of a tree), ``TOOLS`` and the tools themselves, ``report`` and its
renderings, the module and clone scores, and ``handle`` and ``serve`` of the protocol.
"""

from __future__ import annotations

import importlib

__version__ = "0.2.0"

_NAMES = {
    "codelode.plans.tools": ["Index", "TOOLS", "callers_of", "callees_of", "impact_of", "path_between", "query_repository"],
    "codelode.plans.reports": ["report", "to_json", "graph_json", "markdown", "terminal", "page", "alerts_text", "alerts_markdown"],
    "codelode.operators.duplicates": ["contamination_score", "cascade", "near_pairs"],
    "codelode.operators.metrics": ["ownership"],
    "codelode.sources.git": ["commits", "log_lines"],
    "codelode.server": ["handle", "serve"],
}
__all__ = sorted(x for names in _NAMES.values() for x in names)  # noqa: PLE0605


def __getattr__(name: str):
    """Names are imported when they are asked for."""
    for module, names in _NAMES.items():
        if name in names:
            return getattr(importlib.import_module(module), name)
    raise AttributeError(name)
