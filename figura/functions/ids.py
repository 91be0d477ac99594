"""Composite example ids: split, type, parse the segment, validate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Id layouts, in order.
# Train form: segment_sentence_sentenceOffset_wordOffset_subwordOffset_verb
TRAIN_ID_FIELDS = [
    ("text_segment_id", "string"),
    ("sentence_number", "string"),   # a string on purpose: '675a' exists
    ("sentence_offset", "int"),
    ("word_offset", "int"),
    ("subword_offset", "int"),
    ("verb", "string"),
]
# Test form lists five names; real test ids have three parts.
TEST_ID_FIELDS = TRAIN_ID_FIELDS[:5]
FRAGMENT_PREFIX = "fragment"
PART_LENGTH = 3


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_id(c, fields=TRAIN_ID_FIELDS) -> list[Column]:
    """Split an id on ``_`` into typed columns; missing parts, and parts that
    are no number where one belongs, are null."""
    parts = F.split(_c(c), "_")
    return [F.get(parts, i).try_cast(t).alias(name) for i, (name, t) in enumerate(fields)]


def segment_part(c) -> Column:
    """``b17-fragment02`` -> ``B17``."""
    return F.upper(F.split_part(_c(c), F.lit("-"), F.lit(1)))


def segment_fragment(c) -> Column:
    """``b17-fragment02`` -> 2 (characters after the ``fragment`` prefix),
    null where there is no number."""
    frag = F.split_part(_c(c), F.lit("-"), F.lit(2))
    return F.substring(frag, F.lit(len(FRAGMENT_PREFIX) + 1), F.length(frag)).try_cast("int")


def segment_valid(c, part_length: int | None = PART_LENGTH) -> Column:
    """Exactly two ``-`` parts, a 3-character corpus part (of any length with
    ``part_length=None``) and a fragment part that starts with ``fragment``."""
    parts = F.split(_c(c), "-")
    size = F.length(F.get(parts, 0))
    return ((F.size(parts) == 2)
            & (size > 0 if part_length is None else size == part_length)
            & F.coalesce(F.get(parts, 1).startswith(FRAGMENT_PREFIX), F.lit(False)))


def assert_segment_valid(c) -> Column:
    """Fail the job on the first malformed segment id."""
    return F.assert_true(segment_valid(c), F.concat(F.lit("bad text segment id: "), _c(c)))


def two_digits(c) -> Column:
    """A number as text of two digits at least (7 -> ``07``, 103 -> ``103``)."""
    text = _c(c).cast("string")
    return F.lpad(text, F.greatest(F.lit(2), F.length(text)), "0")
