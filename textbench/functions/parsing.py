"""Model answer -> class label, and label cleaning for metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES — answer keywords, checked as substrings of the lower-cased
# answer; every fake keyword is tried before any true keyword.
# ---------------------------------------------------------------------------
FAKE_KEYWORDS = ["falsa", "fake", "falso", "mentira", "desinformação", "1"]
TRUE_KEYWORDS = ["verdadeira", "verdadeiro", "real", "verídica", "0"]
# answers of the yes/no template ("is this fake news?")
YES_WORDS = ["sim"]
NO_WORDS = ["não", "nao"]
# ---------------------------------------------------------------------------

LABELS = (0, 1)
INVALID = -1


def _any_contains(s: Column, words: list[str]) -> Column:
    cond = None
    for w in words:
        c = s.contains(w)
        cond = c if cond is None else (cond | c)
    return cond


def _any_word(s: Column, words: list[str]) -> Column:
    """Whole-word match (Unicode word boundaries) of any of ``words``."""
    alt = "|".join(w.replace(".", r"\.") for w in words)
    return s.rlike(f"(?U)(^|[^\\w])({alt})([^\\w]|$)")


def extract_prediction(response, mode: str = "legacy") -> Column:
    """1 when the answer contains a fake keyword, else 0 when it contains a
    true keyword, else -1.  NULL answers give -1.

    ``legacy`` (default, parity): plain substring tests — ``"1"`` matches any
    answer containing that digit and ``"real"`` matches ``"realmente"``.
    ``word``: the same keywords, whole words only.  ``binary``: answers of the
    yes/no template — yes (fake) -> 1, no -> 0."""
    r = F.col(response) if isinstance(response, str) else response
    low = F.lower(r)
    if mode == "legacy":
        fake, true = _any_contains(low, FAKE_KEYWORDS), _any_contains(low, TRUE_KEYWORDS)
    elif mode == "word":
        fake, true = _any_word(low, FAKE_KEYWORDS), _any_word(low, TRUE_KEYWORDS)
    elif mode == "binary":
        fake, true = _any_word(low, YES_WORDS), _any_word(low, NO_WORDS)
    else:
        raise ValueError("mode must be 'legacy', 'word' or 'binary'")
    return (F.when(fake, F.lit(1)).when(true, F.lit(0)).otherwise(F.lit(INVALID))).cast("int")


def is_valid_prediction(prediction) -> Column:
    """TRUE for 0/1, FALSE for anything else including NULL."""
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    return F.coalesce(p.isin(*LABELS), F.lit(False))


def clean_prediction(prediction, label) -> Column:
    """Invalid predictions are scored as wrong: replaced by ``1 - label``."""
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    y = F.col(label) if isinstance(label, str) else label
    return F.when(is_valid_prediction(p), p).otherwise(F.lit(1) - y).cast("int")
