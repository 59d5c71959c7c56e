"""Operations that a language model would do, behind one interface, with rules as the default.

A text function takes and returns a pandas Series; ``column`` wraps it for Arrow batches, so a model can be
put in its place without another change.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TextFunction = Callable[[pd.Series], pd.Series]

TOPICS = {
    "legal": ("license", "rights", "copyright", "contract"),
    "commerce": ("price", "order", "payment", "customer"),
    "science": ("theory", "experiment", "measure", "proof"),
}
_ENTITY = {
    "EMAIL": re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+"),
    "URL": re.compile(r"https?://\S+"),
    "NUMBER": re.compile(r"\b\d+(?:\.\d+)?\b"),
    "NAME": re.compile(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b"),
}


def classify(texts: pd.Series) -> pd.Series:
    """The topic with most of its words in the text, first of equals; ``other`` for none."""

    def one(text: str | None) -> str:
        low = (text or "").lower()
        score = {t: sum(low.count(w) for w in words) for t, words in TOPICS.items()}
        best = max(score, key=lambda t: score[t])
        return best if score[best] else "other"

    return texts.map(one, na_action=None)


def entities(texts: pd.Series) -> pd.Series:
    """``KIND:match`` in order of place; overlapping matches go to the first kind."""

    def one(text: str | None) -> list[str]:
        found, taken = [], []
        for kind, pattern in _ENTITY.items():
            for m in pattern.finditer(text or ""):
                if all(m.end() <= a or m.start() >= b for a, b in taken):
                    taken.append(m.span())
                    found.append((m.start(), f"{kind}:{m[0]}"))
        return [x for _, x in sorted(found)]

    return texts.map(one, na_action=None)


def summarize(texts: pd.Series, sentences: int = 2) -> pd.Series:
    """The first sentences."""
    return texts.map(lambda t: " ".join(re.split(r"(?<=[.!?])\s+", (t or "").strip())[:sentences]), na_action=None)


def translate(texts: pd.Series, lang: str = "en") -> pd.Series:
    return texts.map(lambda t: f"[{lang}] {t or ''}", na_action=None)


def generate(texts: pd.Series, role: str = "answer") -> pd.Series:
    return texts.map(lambda t: f"{role}: {(t or '')[:200]}", na_action=None)


DEFAULTS: dict[str, tuple[TextFunction, str]] = {
    "CLASSIFY": (classify, "string"),
    "EXTRACT_ENTITIES": (entities, "array<string>"),
    "SUMMARIZE": (summarize, "string"),
    "TRANSLATE": (translate, "string"),
    "GENERATE": (generate, "string"),
    "CODEGEN": (lambda t: generate(t, "code"), "string"),
    "PLAN": (lambda t: generate(t, "plan"), "string"),
}


def column(op: str, text: Column, function: TextFunction | None = None) -> Column:
    default, kind = DEFAULTS[op]
    use = function or default

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return use(texts)

    return run(text)
