"""Rule-based answers to standard questions, and a registry of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Question patterns in order, and their answers around the entity.
RULES = [
    (r"(?i)flash\s*point\s+of\s+([a-zA-Z0-9\s]+)",
     ("The flash point of ", " is dynamically retrieved from Section 9 (Physical Properties) of its versioned SDS.")),
    (r"(?i)is\s+([a-zA-Z0-9\s]+)\s+flammable",
     ("Flammability status for ", " is classified under GHS Category H225/H226 per Section 2 of its SDS.")),
    (r"(?i)max\s+storage\s+temp(?:erature)?\s+for\s+([a-zA-Z0-9\s]+)",
     ("Maximum storage temperature limit for ", " is governed by Section 7 (Handling and Storage).")),
]


def fast_answer(question: Column) -> Column:
    """Answer of the first rule that matches; null if none does."""
    out = None
    for pattern, (head, tail) in RULES:
        value = F.concat(F.lit(head), F.trim(F.regexp_extract(question, pattern, 1)), F.lit(tail))
        out = F.when(question.rlike(pattern), value) if out is None else out.when(question.rlike(pattern), value)
    return out


class Registry:
    """Named functions that return DataFrames, with a description each."""

    def __init__(self):
        self._tools: dict[str, tuple[str, Callable[..., DataFrame]]] = {}

    def register(self, name: str, description: str, function: Callable[..., DataFrame]) -> None:
        self._tools[name] = (description, function)

    def describe(self) -> dict[str, str]:
        return {name: text for name, (text, _) in self._tools.items()}

    def call(self, name: str, **arguments) -> DataFrame | str | None:
        """The function's result, its error as text, or None for an unknown name."""
        if name not in self._tools:
            return None
        try:
            return self._tools[name][1](**arguments)
        except Exception as e:  # errors of registered functions are answers, not failures
            return f"{name} failed: {e}"
