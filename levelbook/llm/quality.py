"""Quality rules as a ledger of bits: every rule is evaluated once, policies only read bits.

:func:`ledger` measures each document and stores one failure bit per rule beside the
measurements. A :class:`Policy` is a named set of rules; applying another version, or asking
what one rule alone costs, is bitwise work on the ledger and never reads a text again.

Defined cases: a NULL text is an empty one; an empty text has no words and fails only
``few_words``; rows repeated under one id are measured each for itself; a NULL id is kept as
it is; an empty table gives an empty ledger; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from levelbook.llm.frames import documents, map_arrow, sub_batches, texts_of
from levelbook.llm.scan import RangeHash, mix, split_words

# The words that count as abuse.
ABUSIVE = (
    "clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless",
)

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals",
    "n_exclamations", "n_abusive",
)
SCHEMA = "doc_id {id}, " + ", ".join(f"{m} long" for m in MEASURES)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_LETTER = _CAPITAL.copy()
_LETTER[97:123] = True


@dataclass(frozen=True)
class Rule:
    """A named condition on the measurements (reached by name) under which a document fails."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


#: The position of a rule is its bit, so new rules go to the end.
RULES = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("repeated_lines", lambda m: (m("n_dup_lines") >= 3) & (10 * m("n_dup_lines") > 3 * m("n_lines"))),
    Rule("capitals", lambda m: (m("n_letters") >= 20) & (2 * m("n_capitals") > m("n_letters"))),
    Rule("exclamations", lambda m: 10 * m("n_exclamations") > 3 * m("n_words")),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words"))),
    Rule("abuse", lambda m: m("n_abusive") >= 2),
)
BASE_RULES = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A version of the rules that reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return mask_of(self.rules)


def mask_of(rules: Collection[str]) -> int:
    bits = {rule.name: 1 << i for i, rule in enumerate(RULES)}
    return sum(bits[name] for name in set(rules))


POLICIES = {
    "v1": Policy("v1", tuple(r.name for r in RULES if r.name != "abuse")),
    "v2": Policy("v2", tuple(r.name for r in RULES)),
}
#: The version that decides.
CURRENT = POLICIES["v2"]


def measure(texts: list[bytes], abusive: Collection[str] = ABUSIVE) -> dict[str, np.ndarray]:
    """The measurements of some texts, by name."""
    words = split_words(texts)
    buffer, n_words = words.buffer, words.counts
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[ends] - sums[ends - sizes - 1]

    # Characters of words: bytes that start a character, within words.
    starts_char = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])
    chars = np.concatenate([[0], np.cumsum(starts_char[words.ends] - starts_char[words.starts])])

    # Words in 3-word windows that the same text holds twice or more.
    repeated = np.zeros(len(words.hashes), dtype=bool)
    inside = np.flatnonzero(words.windows_in_text(3))
    if len(inside):
        keys = RangeHash(words.hashes).windows(3)[inside] ^ mix(words.text_of[inside].astype(np.uint64))
        _, which, found = np.unique(keys, return_inverse=True, return_counts=True)
        again = inside[found[which] > 1]
        for shift in range(3):
            repeated[again + shift] = True
    covered = np.concatenate([[0], np.cumsum(repeated)])

    listed = {form.encode() for word in abusive for form in (word, f"{word}.", f"{word},", f"{word}!", f"{word}?")}
    n_lines, n_dup, n_abusive = [], [], []
    for text in texts:
        lines = [line for line in text.split(b"\n") if line.strip()]
        n_lines.append(len(lines))
        n_dup.append(len(lines) - len(set(lines)))
        n_abusive.append(len(listed.intersection(text.lower().split())))
    return {
        "n_words": n_words,
        "word_chars": chars[words.first[1:]] - chars[words.first[:-1]],
        "n_symbols": per_text(_SYMBOL[buffer]),
        "n_lines": np.array(n_lines, dtype=np.int64),
        "n_dup_lines": np.array(n_dup, dtype=np.int64),
        "n_repeat_words": covered[words.first[1:]] - covered[words.first[:-1]],
        "n_letters": per_text(_LETTER[buffer]),
        "n_capitals": per_text(_CAPITAL[buffer]),
        "n_exclamations": per_text(buffer == 33),
        "n_abusive": np.array(n_abusive, dtype=np.int64),
    }


def failure_bits(measures: Column | None = None) -> Column:
    """All failure bits of a row with the measurements, or of a struct of them."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits + F.when(rule.fails(lambda m: F.col(m) if measures is None else measures[m]), 1 << i).otherwise(0)
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, the measurements and ``failures`` (one bit per rule).

    One pass over the texts without a shuffle.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in sub_batches(batch):
                yield {"doc_id": part.column("doc_id"), **measure(texts_of(part.column("text")))}

    chosen = documents(docs, id_col, text_col).select("doc_id", "text")
    measured = map_arrow(chosen, work, SCHEMA.format(id=chosen.schema["doc_id"].dataType.simpleString()))
    return measured.withColumn("failures", failure_bits())


def passes(policy: Policy) -> Column:
    """Whether a row of the ledger fails none of the policy's rules."""
    return F.col("failures").bitwiseAND(F.lit(policy.mask)) == 0


def keep_documents(docs: DataFrame, policy: Policy = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass ``policy``, with all their columns."""
    name = "_measured"
    while name in docs.columns:
        name += "_"
    fields = [pa.field(m, pa.int64()) for m in MEASURES]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, text_col):
                found = measure(texts_of(part.column(text_col)))
                yield part.append_column(name, pa.StructArray.from_arrays([pa.array(found[m]) for m in MEASURES], fields=fields))

    kind = "struct<" + ", ".join(f"{m}: bigint" for m in MEASURES) + ">"
    measured = docs.mapInArrow(work, StructType([*docs.schema.fields, StructField(name, DataType.fromDDL(kind))]))
    bits = F.transform(F.array(F.col(name)), lambda m: failure_bits(m))[0]
    return measured.filter(bits.bitwiseAND(F.lit(policy.mask)) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def ablation(ledger_rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of ``policy``: documents that fail it, and those that only it rejects.

    Leaving the rule out would keep the latter. One aggregate with one pair of sums per rule,
    combined on the map side.
    """
    bits = F.col("failures").bitwiseAND(F.lit(policy.mask))
    sums = []
    for name in policy.rules:
        bit = mask_of([name])
        sums += [
            F.count_if(bits.bitwiseAND(F.lit(bit)) != 0).alias(f"{name}_fails"),
            F.count_if(bits == bit).alias(f"{name}_only"),
        ]
    totals = ledger_rows.agg(*sums)
    rows = F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(f"{n}_fails").alias("n_failed"), F.col(f"{n}_only").alias("n_only"))
        for n in policy.rules
    ])
    return totals.select(F.inline(rows))
