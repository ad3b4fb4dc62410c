"""Operators for language-model training data; nothing else in skein imports this subpackage."""

from __future__ import annotations

import importlib

#: Modules with QUERIES and ORACLE.
NAMES = ["topn", "cooccurrence", "confusables", "encoding", "leakage", "overlap", "subjects"]


def modules() -> list:
    return [importlib.import_module(f"{__name__}.{n}") for n in NAMES]
