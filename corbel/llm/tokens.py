"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text longer than `chunk` characters is encoded in chunks that overlap. Two
neighbours are spliced at a position inside their overlap where both have a
token boundary and which is a proven boundary of every encoding: a white space
after something else, away from the ends of both chunks. The pre-tokenizer's
pattern never continues across such a position, so the tokens before it are
those of the left chunk and the tokens after it those of the right one. If the
overlap has no such position, it is widened to twice its size on both sides and
both chunks are encoded again, until they align or become one.

The counts are those of the tokenizers library for the vocabulary file. Where a
.tiktoken file with the same vocabulary is given, texts whose characters are all
below U+0250 (where both libraries' character classes are tested to be equal) go
through that faster encoder; all other texts go through tokenizers.

Defined results: a null text is an empty one with 0 tokens; repeated rows give
repeated rows; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

CHUNK, OVERLAP = 32_768, 512
#: More than any special token or look-ahead spans, in characters.
MARGIN = 32
#: White space in every library's terms, after what is none in any.
_STABLE = re.compile(r"(?<=\S)[ \t\n\r]")
_PLAIN = re.compile("[\u0000-ɏ]*")

#: ends(text): where tokens end, as code points from its start; a token that ends within a character has no entry of its own.
Ends = Callable[[str], np.ndarray]


def resynchronised(text: str, ends: Ends, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """(number of tokens of `text`, number of times an overlap was widened)."""
    n, widened = len(text), 0
    if n <= chunk:
        return len(ends(text)), 0
    overlap = min(overlap, chunk // 2)
    step = chunk - overlap
    total, start = 0, 0  # tokens before `start`, a proven boundary, are counted
    left_from, left_to = 0, chunk
    left = ends(text[:chunk])
    while left_to < n:
        right_from, right_to = left_to - overlap, min(n, left_to + step)
        width = overlap
        right = ends(text[right_from:right_to])
        while True:
            spot = _boundary(text, left, left_from, left_to, right, right_from, right_to == n)
            if spot is not None:
                break
            widened += 1
            width *= 2
            right_from, right_to, left_to = max(start, right_from - width), min(n, right_to + width), min(n, left_to + width)
            left = ends(text[left_from:left_to])
            if right_from <= left_from or left_to == n:
                # They are one now.
                left_to = max(left_to, right_to)
                left = ends(text[left_from:left_to])
                break
            right = ends(text[right_from:right_to])
        if spot is not None:
            total += int(((left + left_from > start) & (left + left_from <= spot)).sum())
            start = spot
            left_from, left_to, left = right_from, right_to, right
    return total + int((left + left_from > start).sum()), widened


def _boundary(text: str, left: np.ndarray, left_from: int, left_to: int, right: np.ndarray, right_from: int, last: bool) -> int | None:
    """The common stable boundary that is nearest to the middle of the overlap."""
    lo, hi = right_from + MARGIN, left_to - MARGIN
    middle = (lo + hi) // 2
    both = np.intersect1d(left + left_from, right + right_from)
    spots = [m.start() for m in _STABLE.finditer(text, max(1, lo), max(1, lo, hi))]
    good = np.intersect1d(both, np.array(spots, dtype=np.int64))
    return int(good[np.abs(good - middle).argmin()]) if len(good) else None


class Encoder:
    """Loads the vocabulary once for each worker process."""

    def __init__(self, path: str, twin: str | None = None, pattern: str | None = None):
        self.path, self.twin, self.pattern = path, twin, pattern

    def __getstate__(self):
        return {"path": self.path, "twin": self.twin, "pattern": self.pattern}

    def __setstate__(self, state):
        self.__dict__.update(state)

    @property
    def slow(self):
        if "_slow" not in self.__dict__:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    @property
    def fast(self):
        if "_fast" not in self.__dict__:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(self.twin, "rb"))}
            special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items() if t.special}
            self._fast = tiktoken.Encoding("twin", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=special)
            words = {**{i: len(b) for b, i in ranks.items()}, **{i: len(s.encode()) for s, i in special.items()}}
            self._bytes = np.zeros(max(words) + 1, np.int64)
            self._bytes[list(words)] = list(words.values())
        return self._fast

    def quick(self, text: str) -> bool:
        return self.twin is not None and _PLAIN.fullmatch(text) is not None

    def count(self, text: str) -> int:
        if self.quick(text):
            return len(self.fast.encode(text, allowed_special="all"))
        return len(self.slow.encode(text, add_special_tokens=False).ids)

    def ends(self, text: str) -> np.ndarray:
        """Ends of tokens in code points; of tokens that end within a character, one and the same end for all, repeated."""
        if self.quick(text):
            ids = self.fast.encode(text, allowed_special="all")
            at = np.cumsum(self._bytes[ids]) if ids else np.zeros(0, np.int64)
            raw = np.frombuffer(text.encode(), np.uint8)
            chars = np.cumsum((raw & 0xC0) != 0x80)  # characters that have begun
            return chars[at - 1] if len(at) else at
        found = self.slow.encode(text, add_special_tokens=False)
        return np.array([b for _, b in found.offsets], dtype=np.int64)


def counter(encoder: Encoder, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, widened = [], []
            for text in batch.column("_t").to_pylist():
                if len(text) <= chunk:
                    n, w = encoder.count(text), 0
                else:
                    n, w = resynchronised(text, encoder.ends, chunk, overlap)
                counts.append(n)
                widened.append(w)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("n_bytes"), pa.array(counts, pa.int64()), pa.array(widened, pa.int32())], ["_id", "n_bytes", "n_tokens", "widened"])

    return run


def token_counts(docs: DataFrame, path: str, twin: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, n_bytes, n_tokens, widened): a row for each document. `path` is a .json file of the tokenizers library; `twin` and `pattern` name the same vocabulary as ranks."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("_id"), t.alias("_t"), F.octet_length(t).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(counter(Encoder(path, twin, pattern), chunk, overlap), f"_id {dict(docs.dtypes)[doc_id]}, n_bytes bigint, n_tokens bigint, widened int")
    return staged(counted, "tokens", (512, 16))


def op4_rows(docs: DataFrame, path: str, twin: str | None = None, pattern: str | None = None) -> DataFrame:
    """The contract's columns."""
    got = token_counts(docs, path, twin, pattern)
    return got.select(F.col("_id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
