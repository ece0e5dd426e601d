"""Token counts of whole texts by a two-tier look-up on the map side; no text and no pre-token is shuffled.

A BPE model of pieces merges neighbours wherever it knows the result, so a text falls into
pre-tokens that no piece crosses: a run of word marks with the letters after it, a run of letters, or a
single character that no piece joins to another (letters: the characters of pieces of two or more).
The length of a text is the sum of its pre-tokens' lengths.

Tier one is a compact table of the corpus's frequent pre-tokens, broadcast as one packed string with
their lengths.  Every task counts the pre-tokens of all its texts in bounded memory and reports its most
frequent ones; only these reports are added up.  Tier two is a cache in each worker: what the table lacks is
encoded by the library once and remembered.  The table decides the speed, never a result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import nlargest

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.arrow import pieces, trimmed
from tracewright.llm.common import Scratch, hold

MARK = "▁"  # stands for a space
#: Entries of the broadcast table; pre-tokens that a task reports; pre-tokens that it counts at once.
FREQUENT, REPORTED, COUNTED = 50_000, 8_192, 200_000
#: Longest pre-token, in characters, that the table or a cache holds; entries of a worker's cache.
LONGEST, CACHED = 48, 200_000
#: Characters of a text that are split at once.
WINDOW = 1 << 20


class Splitter:
    """The pre-tokens of texts and, by the library, their lengths."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        own = [self.model.id_to_piece(i) for i in ids if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        joined = set("".join(p for p in own if len(p) > 1)) - {MARK}
        letters = "".join(map(re.escape, sorted(joined)))
        self.find = re.compile(f"{MARK}+[{letters}]*|[{letters}]+|[^{letters}{MARK}]").findall
        self.boundary = re.compile(f"(?<!{MARK}){MARK}|[^{letters}{MARK}]").search
        crossing = any(a != MARK and b == MARK for p in own for a, b in zip(p, p[1:], strict=False))
        alone = next(c for c in "\n\t\r\x0b" if c not in joined)
        self.head = len(self.model.encode(alone))
        if crossing or self.model.encode("a b")[:1] != self.model.encode("a"):
            raise ValueError("pieces of this model cross the start of a word")
        self.alone = alone  # set before a pre-token, it takes the place of the text's start

    def tokens(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, a window of it at a time; windows end where pre-tokens do."""
        if not text:
            return
        text, at = MARK + text.replace(" ", MARK), 0
        while at < len(text):
            cut = self.boundary(text, at + WINDOW) if at + WINDOW < len(text) else None
            end = cut.start() if cut else len(text)
            yield self.find(text[at:end])
            at = end

    def lengths(self, tokens: list[str]) -> list[int]:
        return [len(x) - self.head for x in self.model.encode([self.alone + t for t in tokens], num_threads=1)]


@lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    """One for each process: workers live on for later tasks."""
    hold("token-count", _forget)
    return Splitter(path)


_CACHES: dict[str, dict[str, int]] = {}


def _forget() -> None:
    splitter.cache_clear()
    _CACHES.clear()


def _report(path: str):
    """A task's most frequent pre-tokens. Beyond ``COUNTED`` different ones the rarer half is forgotten, so
    counts are lower bounds; they serve to choose the table alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = splitter(path), Counter()
        for batch in batches:
            for piece in pieces(batch):
                for text in piece.column("text").to_pylist():
                    for tokens in split.tokens(text or ""):
                        seen.update(tokens)
                        if len(seen) > COUNTED:
                            kept = nlargest(COUNTED // 2, seen.items(), key=lambda x: x[1])
                            seen = Counter(dict(kept))
        best = nlargest(REPORTED, ((t, n) for t, n in seen.items() if n > 1 and len(t) <= LONGEST), key=lambda x: x[1])
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["token", "n"])

    return run


def frequent_tokens(texts: DataFrame, path: str, most: int = FREQUENT) -> list[str]:
    """At most ``most`` frequent pre-tokens of all texts of a column ``text``: those from the least count
    on, in steps of a quarter of a power of two, of which there are not too many."""
    with Scratch(texts.sparkSession, "token-count") as scratch:
        reports = texts.select("text").mapInArrow(trimmed(_report(path)), "token string, n long")
        sums = scratch.write(reports.groupBy("token").agg(F.sum("n").alias("n")), "sums")
        step = F.floor(F.log2("n") * 4).cast("int")
        total, least = 0, None
        for r in sums.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # some 200 rows
            total += r["count"]
            if total > most:
                break
            least = r["step"]
        return [] if least is None else [r.token for r in sums.where(step >= least).collect()]


def _pack(tokens: list[str], split: Splitter) -> tuple[bytes, bytes]:
    """Tokens as one string, which no space can be part of, and their lengths."""
    return " ".join(tokens).encode(), np.array(split.lengths(tokens), np.uint16).tobytes()


def _count(path: str, table, limit: int):
    """Rows of doc_id, n_bytes, n_tokens and over_limit of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, cache = splitter(path), _CACHES.setdefault(path, {})
        joined, lengths = table.value
        known = dict(zip(joined.decode().split(" "), np.frombuffer(lengths, np.uint16).tolist(), strict=True)) if lengths else {}
        for batch in batches:
            for piece in pieces(batch):
                totals, sizes, missed = [], [], []
                for i, text in enumerate(piece.column("text").to_pylist()):
                    total = 0
                    for tokens in split.tokens(text or ""):
                        found = list(map(known.get, tokens))
                        if None in found:
                            rest = [t for t, n in zip(tokens, found, strict=True) if n is None]
                            found = [n for n in found if n is not None]
                            second = list(map(cache.get, rest))
                            found += [n for n in second if n is not None]
                            missed += [(i, t) for t, n in zip(rest, second, strict=True) if n is None]
                        total += sum(found)
                    totals.append(total)
                    sizes.append(len((text or "").encode()))
                if missed:
                    new = list({t for _, t in missed})
                    made = dict(zip(new, split.lengths(new), strict=True))
                    for i, t in missed:
                        totals[i] += made[t]
                    if len(cache) + len(made) > CACHED:
                        cache.clear()
                    cache.update((t, n) for t, n in made.items() if len(t) <= LONGEST)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Every row's doc_id, n_bytes (UTF-8), n_tokens by the model at ``path`` (a file on every worker,
    without begin and end tokens) and over_limit (more than ``limit`` tokens).

    Null and empty texts have no bytes and no tokens; null ids pass through; repeated rows are counted
    each; an empty table gives an empty result; other columns are ignored. A very long text is split window by
    window (what it takes beside the text itself is bounded, save for one pre-token of that length, which the
    library encodes at once). Ties among frequent pre-tokens change no count.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(_pack(frequent_tokens(rows, path, frequent), splitter(path)))
    return rows.mapInArrow(trimmed(_count(path, table, limit)), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
