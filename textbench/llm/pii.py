"""Operator 9: personal data, found with DataFrame functions only.

Regular expressions propose spans, checksum validators confirm them (Luhn for
cards, mod-97 for IBANs, range checks for the rest), and context words nearby
adjust the score.  The four base kinds need no context; further kinds are kept
from ``THRESHOLD`` on and only where they overlap no span found before them.

Matches are leftmost and do not overlap within a kind.  Places come from the
pieces that ``split`` leaves between the matches, in code points, end exclusive.
Quantifiers are possessive and start at the beginning of a run, which finds the
same matches as the plain patterns in time linear in a run's length.

Null text reads as empty: no spans.  Null and repeated ``doc_id``: each row is
read by itself.  An empty table gives no rows.  Other columns are ignored by
``find_personal_data`` and kept by ``mask_personal_data``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, free_prefix

_LOCAL = "[A-Za-z0-9._%+-]"
#: Patterns by kind, base kinds first, in the order of the result.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "short_card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,14}(?![0-9])",
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
BASE = ("email", "ip", "card", "phone")
#: Score of a span that its validator confirms, before context.
SCORES = {"email": 1.0, "ip": 1.0, "card": 1.0, "phone": 1.0,
          "iban": 0.9, "ssn": 0.5, "short_card": 0.5, "local_phone": 0.4}
#: Words that raise a further kind's score when they stand within ``NEARBY``.
CONTEXT = {
    "iban": r"iban|account|konto|compte|cuenta|bank",
    "ssn": r"ssn|social|security|tax",
    "short_card": r"card|amex|visa|credit|karte|carte|tarjeta",
    "local_phone": r"phone|tel|call|mobile|fax|telefon|m[oó]vil",
}
CONTEXT_GAIN = 0.4
NEARBY = 40
THRESHOLD = 0.6
#: What a text must hold before a pattern is tried at all.
_NEEDED = {"email": "@", "phone": "+"}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(digits)

    def step(total, place):
        digit = F.substr(turned, place, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(place % 2 == 0, doubled).otherwise(digit)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN passes the mod-97 check."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(rest, place):
        code = F.ascii(F.substr(turned, place, F.lit(1)))
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _count_between(digits: Column, low: int, high: int) -> Column:
    return F.length(digits).between(low, high)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind in ("card", "short_card"):
        low, high = (16, 19) if kind == "card" else (13, 15)
        digits = _digits(match)
        return F.when(_count_between(digits, low, high), luhn(digits)).otherwise(False)
    if kind == "phone":
        return _count_between(_digits(match), 8, 15)
    return mod97(match) if kind == "iban" else F.lit(True)


def _score(kind: str, text: Column, start: Column, end: Column) -> Column:
    base = F.lit(SCORES[kind])
    if kind not in CONTEXT:
        return base
    begin = F.greatest(start - NEARBY, F.lit(0))
    around = F.substr(text, begin + 1, end + NEARBY - begin)
    return base + F.when(F.lower(around).rlike(rf"\b(?:{CONTEXT[kind]})"), CONTEXT_GAIN).otherwise(0.0)


def _placed(matches: Column, between: Column) -> Column:
    """(match, start, end) of each match."""
    def step(state, match):
        at = F.size(state["found"])
        start = state["at"] + F.char_length(F.get(between, at))
        end = start + F.char_length(match)
        found = F.concat(state["found"], F.array(F.struct(match.alias("match"), start.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), found.alias("found"))
    none = F.expr("cast(array() as array<struct<match:string,start:int,end:int>>)")
    return F.aggregate(matches, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda s: s["found"])


def _confirmed(kind: str, rank: int, text: Column, p: str) -> Column:
    """Spans of one kind that its validator confirms."""
    placed = _placed(F.col(f"{p}m_{kind}"), F.col(f"{p}b_{kind}"))
    return F.transform(F.filter(placed, lambda s: _valid(kind, s["match"])), lambda s: F.struct(
        F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"),
        _score(kind, text, s["start"], s["end"]).alias("score")))


def _with_spans(docs: DataFrame, p: str) -> DataFrame:
    """``docs`` with a column ``spans`` behind the free prefix ``p``: (rank, start, end, kind, score), sorted by kind and start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn(f"{p}digit", text.rlike("[0-9]"))
    found, between = {}, {}
    for kind, pattern in PATTERNS.items():
        tried = F.col(f"{p}digit") if kind != "email" else F.lit(True)
        if kind in _NEEDED:
            tried = tried & F.contains(text, F.lit(_NEEDED[kind]))
        found[f"{p}m_{kind}"] = F.when(tried, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    out = out.withColumns(found)
    for kind, pattern in PATTERNS.items():
        between[f"{p}b_{kind}"] = F.when(F.size(f"{p}m_{kind}") > 0, F.split(text, pattern, -1))
    out = out.withColumns(between)
    spans = {}
    for rank, kind in enumerate(PATTERNS):
        spans[f"{p}s_{kind}"] = F.when(F.col(f"{p}b_{kind}").isNotNull(), _confirmed(kind, rank, text, p))
    out = out.withColumns(spans)
    none = F.expr("cast(array() as array<struct<rank:int,start:int,end:int,kind:string,score:double>>)")
    every = F.flatten(F.array(*[F.coalesce(F.col(f"{p}s_{kind}"), none) for kind in PATTERNS]))

    def step(taken, span):
        clash = F.exists(taken, lambda t: (t["start"] < span["end"]) & (span["start"] < t["end"]))
        keep = (span["rank"] < len(BASE)) | ((span["score"] >= THRESHOLD) & ~clash)
        return F.when(keep, F.concat(taken, F.array(span))).otherwise(taken)
    out = out.withColumn(f"{p}every", every)
    extra = F.exists(f"{p}every", lambda s: s["rank"] >= len(BASE))
    out = out.withColumn(f"{p}spans", F.when(extra, F.aggregate(f"{p}every", none, step)).otherwise(F.col(f"{p}every")))
    return out.select(*docs.columns, f"{p}spans")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): an array of (kind, start, end, score) for each row."""
    p = free_prefix(["doc_id", "text"])
    return _with_spans(docs.select("doc_id", "text"), p).select("doc_id", F.transform(
        f"{p}spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                                      s["score"].alias("score"))).alias("spans"))


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets (spans that
    overlap become one); ``n_chars``, if there, follows the text."""
    p = free_prefix(docs.columns)
    out = _with_spans(docs, p)
    sort = F.array_sort(F.transform(f"{p}spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def step(state, span):
        piece = F.concat(F.substr(F.col("text"), state["at"] + 1, span["start"] - state["at"]),
                         F.lit("<"), F.upper(span["kind"]), F.lit(">"))
        text = F.when(span["start"] >= state["at"], F.concat(state["text"], F.array(piece))).otherwise(state["text"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), text.alias("text"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("text"))
    masked = F.aggregate(sort, start, step, lambda s: F.concat(F.array_join(s["text"], ""),
                                                               F.substr(F.col("text"), s["at"] + 1)))
    hit = F.size(f"{p}spans") > 0
    out = out.withColumn(f"{p}masked", F.when(hit, masked).otherwise(F.col("text")))
    new = {"text": F.col(f"{p}masked")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.char_length(f"{p}masked").cast(docs.schema["n_chars"].dataType)).otherwise(
            F.col("n_chars"))
    return out.withColumns(new).select(docs.columns)


def op9_pii(spark, sf_dir):
    found = find_personal_data(documents(spark, sf_dir))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(kind).alias(f"n_{kind}") for kind in BASE],
                        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", name), ",").alias("spans"))
