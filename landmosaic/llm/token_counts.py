"""Token counts of whole texts, with overlap resynchronisation for huge ones.

White space is dropped by the tokenizer's splitter and composes with nothing,
so no token, and no added token, reaches across an ASCII white-space byte.
That gives the two exact shortcuts used here:

* ordinary texts are the sum of their white-space separated words, each
  distinct word being encoded once per worker (a bounded cache);
* huge texts are encoded in overlapping chunks with offsets.  Two chunks are
  spliced at a boundary inside their overlap at which both start a token right
  after white space.  Where an overlap has none, it is widened until it has;
  where the whole chunk has none, the chunk grows to twice its length, so that
  the work stays in proportion to the text.

Null and empty texts have no tokens; texts of any length are counted whole.
Repeated rows are counted row by row; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of more bytes than this are encoded in overlapping chunks.
HUGE_BYTES = 32_768
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
#: Distinct words that a worker remembers.
CACHE_WORDS = 1_000_000
SPACE = " \t\n\r\x0b\x0c"
GAP = frozenset(SPACE)


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def splice_point(text: str, low: int, left: list[int], right: list[int]) -> int | None:
    """The last place from ``low`` at which both chunks start a token after white space."""
    both = set(left).intersection(right)
    return max((p for p in both if p > low and text[p - 1] in SPACE), default=None)


def count_huge(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of ``text`` from overlapping chunks spliced at stable common boundaries."""

    def starts(low: int, high: int) -> list[int]:
        return [low + a for a, _ in tokenizer.encode(text[low:high], add_special_tokens=False).offsets]

    low, high, since, total, reach = 0, min(chunk, len(text)), 0, 0, chunk
    left = starts(low, high)
    while high < len(text):
        width, end = overlap, min(len(text), high + reach)
        while True:
            begin = max(since, high - width)
            if begin == since or not GAP.isdisjoint(text[begin:high]):
                right = starts(begin, end)
                at = splice_point(text, begin, left, right)
                if at is not None:
                    total += sum(since <= p < at for p in left)
                    since, reach = at, chunk
                    break
                if begin == since:  # nothing to splice at so far: one longer chunk instead
                    reach = end - since
                    break
            width *= 2
        left, high = right, end
    return total + sum(p >= since for p in left)


class WordCounter:
    """Tokens of a text as the sum over its words; remembers a bounded number of words."""

    def __init__(self, tokenizer, limit: int = CACHE_WORDS):
        self.tokenizer, self.limit, self.known = tokenizer, limit, {}

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) + len(words) > self.limit:
            self.known.clear()
        fresh = [w for w in words if w not in self.known]
        for i in range(0, len(fresh), 2_000):  # one encoding of many words, told apart by their offsets
            part = [w.decode("utf-8") for w in fresh[i : i + 2_000]]
            first = np.concatenate([[0], np.cumsum([len(w) + 1 for w in part])])
            starts = [a for a, _ in self.tokenizer.encode(" ".join(part), add_special_tokens=False).offsets]
            counts = np.bincount(np.searchsorted(first, starts, "right") - 1, minlength=len(part))
            self.known.update(zip(fresh[i : i + 2_000], counts.tolist(), strict=True))

    def count(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]
        self.learn(set().union(*split))
        get = self.known.__getitem__
        return [sum(map(get, words)) for words in split]


@cache
def word_counter(path: str) -> WordCounter:
    """This worker process's counter; what it has learnt outlives a task."""
    return WordCounter(load_tokenizer(path))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = word_counter(tokenizer_path)
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            tokens = np.zeros(len(texts), np.int64)
            ends = np.cumsum(sizes)
            for part in np.split(np.arange(len(texts)), np.searchsorted(ends, np.arange(4 << 20, int(ends[-1]) if len(ends) else 0, 4 << 20))):
                small = part[sizes[part] <= HUGE_BYTES]
                tokens[small] = words.count([texts[i] for i in small])
                for i in part[sizes[part] > HUGE_BYTES]:
                    tokens[i] = count_huge(words.tokenizer, texts[i].decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
