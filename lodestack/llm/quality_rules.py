"""Quality rules as a short-circuit cascade.

A rule rejects a document. A document that any rule rejects goes, so the order
of the rules can't change a verdict, only its price. Each task measures, on the
first ``SAMPLE`` documents it reads, which features of a text each rule asks
for, what every feature costs, and which documents each rule rejects. Then it
orders the rules step by step: next comes the rule that rejects the most of the
sample's documents that are still there, for the cost of the features that no
earlier rule has computed. From then on a document meets the rules in that
order, features are computed when a rule asks for them, and the first rule that
rejects ends the matter.

The report decides by the same cascade; only afterwards, and from the same
text, does it compute the features that its columns show and that the cascade
had no need of.

Defined cases: a null text is empty and has no words; documents without words
fail the base rule; repeated rows are judged alike; an empty table gives an
empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import SPACE_BYTES, text_of

#: Documents on which a task measures its rules.
SAMPLE = 64
#: The symbols that are counted.
SYMBOLS = b"#*$%&|<>"


class Text:
    """What rules ask of one text, each computed once, on the whole text, as UTF-8."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        # of UTF-8, every byte but continuation bytes starts a code point
        kept = np.frombuffer(self.raw.translate(None, SPACE_BYTES), np.int8)
        return int(np.count_nonzero(kept >= -64))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(SPACE_BYTES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        ids: dict[bytes, int] = {}
        at = np.array([ids.setdefault(w, len(ids)) for w in self.words], np.int64)
        # ranks of pairs, then of triples: no product can overflow, however many words there are
        _, pair = np.unique(at[:-1] * len(ids) + at[1:], return_inverse=True)
        _, triple, count = np.unique(pair[:-1].astype(np.int64) * len(ids) + at[2:], return_inverse=True, return_counts=True)
        again = count[triple] > 1
        if not again.any():
            return 0
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : k + n - 2] |= again
        return int(covered.sum())

    @cached_property
    def n_shouted(self) -> int:
        """Words that end in two exclamation marks."""
        return sum(w.endswith(b"!!") for w in self.words) if b"!!" in self.raw else 0


#: The rules by name; each is true for a document that must go. The first two are the base rules.
RULES: dict[str, Callable[[Text], bool]] = {
    "few_words": lambda t: t.n_words < 50,
    "repeated_words": lambda t: 100 * t.n_repeat_words > 50 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > 3 * t.n_words,
    "shouting": lambda t: 10 * t.n_shouted > 3 * t.n_words,
    "repeated_lines": lambda t: 100 * t.n_dup_lines > 50 * len(t.lines),
    "word_length": lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 15 * t.n_words,
}
BASE = ("few_words", "repeated_words")


#: The features in an order in which each needs earlier ones alone.
FEATURES = tuple(k for k, v in vars(Text).items() if isinstance(v, cached_property))


class Cascade:
    """The rules in the order that this task's sample gives."""

    def __init__(self, rules: dict[str, Callable[[Text], bool]]) -> None:
        self.rules, self.order = rules, list(rules)
        self.needs: dict[str, set[str]] = {k: set() for k in rules}
        self.cost = dict.fromkeys(FEATURES, 0.0)
        self.own = dict.fromkeys(rules, 1e-9)
        self.hits: dict[str, list[bool]] = {k: [] for k in rules}
        self.left = SAMPLE

    def rejects(self, text: Text) -> bool:
        if not self.left:
            return any(self.rules[k](text) for k in self.order)
        self.left -= 1
        for k, rule in self.rules.items():
            fresh = Text(text.raw)
            self.hits[k].append(bool(rule(fresh)))
            self.needs[k].update(vars(fresh).keys() - {"raw"})
        for k in FEATURES:
            began = time.perf_counter()
            getattr(text, k)
            self.cost[k] += time.perf_counter() - began
        for k, rule in self.rules.items():  # all features are there: what is left is the rule's own
            began = time.perf_counter()
            rule(text)
            self.own[k] += time.perf_counter() - began
        if not self.left:
            self.order = self.ordered()
        return any(h[-1] for h in self.hits.values())

    def ordered(self) -> list[str]:
        """By falling rejection per cost, of what the rules before leave and beyond what they have computed."""
        out, known, there = [], set(), np.ones(SAMPLE, bool)
        hits = {k: np.array(v) for k, v in self.hits.items()}

        def worth(k: str) -> tuple[float, float]:
            cost = self.own[k] + sum(self.cost[f] for f in self.needs[k] - known)
            return (hits[k] & there).sum() / cost, -cost

        while len(out) < len(self.rules):
            k = max((k for k in self.rules if k not in out), key=worth)
            out.append(k)
            known |= self.needs[k]
            there &= ~hits[k]
        return out


def _raw(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict | None = None) -> DataFrame:
    """For each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    rules = {k: RULES[k] for k in BASE} | (rules or RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(rules)
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for raw in _raw(batch.column(1)):
                t = Text(raw)
                kept = not cascade.rejects(t)
                failed = any(rules[k](t) for k in BASE)
                row = (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, kept)
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    )


def quality_filter(docs: DataFrame, text_col: str = "text", rules: dict | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects. One pass; nothing is shuffled, and no rule runs after one has rejected."""
    rules = rules or RULES
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(rules)
        for batch in batches:
            yield batch.filter(pa.array([not cascade.rejects(Text(raw)) for raw in _raw(batch.column(where))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
