"""Secret scans: fixed patterns, and formats learned from the credentials they find.

1. The three base patterns label credentials in every document.
2. A sample of at most ``SAMPLE`` distinct credentials per kind, chosen by hash, trains one
   probabilistic automaton per kind by state merging (see ``automata``).
3. Every further string of 8 or more credential characters is a candidate, and where it is none,
   its parts without dots and without any symbols are; the format likelihood alone decides.

Spans count code points; ends are exclusive. Defined results: a null or empty text has no
spans; text of any length is scanned whole; spans of one kind do not overlap, and a learned
span never overlaps a base span; spans are ordered by start, then by kind; repeated rows are
scanned each; without credentials there are no learned spans. Other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm import automata
from boxloom.session import durable

#: The base patterns, in their listed order, with the least length of the value.
BASE = (
    ("assign", re.compile(
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
     2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),  # a run of 32 or more is the same match
)
KINDS = ("assign", "access", "hex", "format")
#: Candidates: the alphabet and least length of an assigned value; a dot at either end is a full stop.
LEAST_LENGTH = 8
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-](?:[A-Za-z0-9+/_.=-]*[A-Za-z0-9+/_=-])?")
PARTS = (re.compile(r"[A-Za-z0-9+/_=-]{8,}"), re.compile(r"[A-Za-z0-9]{8,}"))
#: Scores kept in a worker.
SCORES = 150_000
#: Distinct credentials per kind that train its automaton.
SAMPLE = 500
#: Log-likelihood ratio per character from which a candidate counts as a credential.
LEAST_SCORE = 0.5

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
CANDIDATES = "array<struct<start:int,end:int,value:string>>"


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    found = []
    for kind, pattern, group, least in BASE:
        if kind == "assign" and ":" not in text and "=" not in text or kind == "access" and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                found.append((kind, m.start(), m.end(), m[group]))
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def candidates(text: str, taken: list[tuple]) -> list[tuple[int, int, str]]:
    """Strings in question outside the base spans."""
    return [(m.start(), m.end(), m[0]) for m in CANDIDATE.finditer(text) if m.end() - m.start() >= LEAST_LENGTH
            and not any(s[1] < m.end() and m.start() < s[2] for s in taken)]


class Formats:
    """Decides whether strings have a learned format; remembers what it has decided."""

    def __init__(self, formats: list, least_score: float):
        self.formats, self.least_score = [f for f in formats if f], least_score
        self.known: dict[str, bool] = {}

    def fits(self, value: str) -> bool:
        if value not in self.known:
            if len(self.known) >= SCORES:
                self.known.clear()
            self.known[value] = automata.format_score(self.formats, value) >= self.least_score
        return self.known[value]

    def spans(self, text: str, taken: list[tuple]) -> list[tuple[str, int, int, str]]:
        """The learned spans of a text: a whole candidate, or else those of its parts that fit."""
        found = []
        if not self.formats:
            return found
        for start, end, value in candidates(text, taken):
            if self.fits(value):
                found.append(("format", start, end, value))
                continue
            for pattern in PARTS:
                parts = [m for m in pattern.finditer(value) if len(m[0]) < len(value) and self.fits(m[0])]
                if parts:
                    found += [("format", start + m.start(), start + m.end(), m[0]) for m in parts]
                    break
        return found


def labelled(texts: pd.Series) -> pd.Series:
    return pd.Series([base_spans(t or "") for t in texts], dtype=object)


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict[str, list]:
    """One automaton per base kind."""
    spans = F.pandas_udf(labelled, SPAN)("text")
    values = durable(docs.select(F.explode(spans).alias("s")).select("s.kind", "s.value").distinct(), "credentials")
    learned = {}
    for kind, *_ in BASE:
        rows = (values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample)
                .select("value").collect())  # at most ``sample`` strings
        learned[kind] = automata.infer([r["value"] for r in rows])
    return learned


def spans_of(text: Column, learned: dict[str, list], least_score: float = LEAST_SCORE) -> Column:
    """All spans of a text, base and learned, ordered."""
    formats = list(learned.values())

    @F.pandas_udf(SPAN)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = Formats(formats, least_score)
        for texts in batches:
            out = []
            for text in texts:
                spans = base_spans(text or "")
                more = judge.spans(text or "", spans)
                out.append(sorted(spans + more, key=lambda s: (s[1], KINDS.index(s[0]))) if more else spans)
            yield pd.Series(out, dtype=object)

    return found(text)


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``secrets``: array of (kind, start, end, value)."""
    return docs.withColumn("secrets", spans_of(F.col("text"), learn(docs)))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced by its kind in brackets; overlapping spans are one."""
    learned = learn(docs)

    @F.pandas_udf("string")
    def clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans):
            if text is None or found is None or not len(found):
                out.append(text)
                continue
            parts, at = [], 0
            for s in found:
                if s["end"] <= at:
                    continue
                if s["start"] >= at:
                    parts += [text[at:s["start"]], f"[{s['kind']}]"]
                at = s["end"]
            out.append("".join(parts) + text[at:])
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", clean("text", spans_of(F.col("text"), learned)))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
