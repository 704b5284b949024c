"""Token counts of fields or sections from one encoding of the whole document.

Whole texts are encoded once with character offsets. Sections are character intervals; tokens and sections, both in
order, are joined by a search of section bounds. A token that crosses a bound is given by rule: to the section with
the most of its characters (the earlier on ties), to the one where it starts, or to the one where it ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import default_vocabulary, offset_encoder

RULES = ("most", "start", "end")


def line_sections(text: str) -> list[int]:
    """Starts of sections: each line with the line breaks behind it."""
    starts = [0]
    at = text.find("\n")
    while at >= 0:
        end = at + 1
        while end < len(text) and text[end] == "\n":
            end += 1
        if end < len(text):
            starts.append(end)
        at = text.find("\n", end)
    return starts


def attribute(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, rule: str = "most") -> np.ndarray:
    """The section of each token span; starts are the ascending section starts."""
    first = np.searchsorted(starts, begin, "right") - 1
    if rule == "start":
        return first
    last = np.searchsorted(starts, np.maximum(end - 1, begin), "right") - 1
    if rule == "end":
        return last
    out = first.copy()
    for i in np.flatnonzero(first != last).tolist():
        bounds = np.clip(np.append(starts[first[i] : last[i] + 1], end[i]), begin[i], end[i])
        out[i] = first[i] + int(np.argmax(np.diff(bounds)))
    return out


def section_token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections: Callable[[str], list[int]] = line_sections, rule: str = "most", vocabulary: str | None = None) -> DataFrame:
    """(id, section, start, end, n_tokens, n_crossing) per section, counts adding up to the whole text's tokens.

    start and end are character offsets. A null or empty text has one empty section without tokens. n_crossing counts
    the section's tokens that also cover characters of another. Repeated rows each give their sections; extra columns
    are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = vocabulary or default_vocabulary()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = offset_encoder(path)
        for batch in it:
            for part in slices(batch, "text", 1 << 21):
                cols: list[list] = [[], [], [], [], [], []]
                texts = [t or "" for t in part.column("text").to_pylist()]
                for id_, text, (begin, end) in zip(part.column("id").to_pylist(), texts, enc.spans(texts), strict=True):
                    starts = np.array(sections(text), np.int64)
                    own = attribute(begin, end, starts, rule)
                    crossing = np.searchsorted(starts, np.maximum(end - 1, begin), "right") != np.searchsorted(starts, begin, "right")
                    n = np.bincount(own, minlength=len(starts))
                    x = np.bincount(own[crossing], minlength=len(starts))
                    for c, v in zip(cols, ([id_] * len(starts), range(len(starts)), starts.tolist(), [*starts[1:].tolist(), len(text)], n.tolist(), x.tolist()), strict=True):
                        c.extend(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["id", "section", "start", "end", "n_tokens", "n_crossing"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, section int, start long, end long, n_tokens long, n_crossing long")
