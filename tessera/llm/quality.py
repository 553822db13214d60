"""Quality rules on repetition inside a text, from suffix arrays over its words.

The suffix array of all texts of a slice is built at once by prefix doubling: a word's first rank is that of its text
and its hash, so suffixes of different texts never tie, and a round only looks at suffixes that still do. The ranks
of every round are kept; descending through them gives the longest common prefix (LCP) of neighbours. The rules ask for
no repeat longer than MAX_REPEAT + 1 words, so they compare suffixes over the next power of two only: eight rounds,
whatever the text repeats, and LCPs beyond count as that. Words are covered by all their repeats of MIN_REPEAT words,
which is the same for longer ones. `repeats`, which reports repeats, compares whole suffixes.

An LCP interval is a run of neighbours that share a prefix of some length, no longer run sharing it: its prefix is a
repeat that can't be extended to the right without losing an occurrence. Deeper intervals lie inside; a suffix's
deepest one has the greater of the LCPs on its two sides. So the words covered by repeats of at least MIN_REPEAT words
are those covered, from each suffix on, by that greater LCP, where it is long enough, and the longest repeat is the
greatest LCP of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tessera.llm.arrow import Words, slices, small_batches, sums_by

MIN_REPEAT = 10  # words of a repeat that counts
MAX_COVERED = 0.4  # share of the words that repeats may cover
MAX_REPEAT = 100  # words of the longest repeat that is let pass
MIN_WORDS = 50
WINDOW = 3
MAX_WINDOW_PERCENT = 50

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_BLANK = " \t\n\x0b\x0c\r"


class SuffixArray:
    """order: suffixes (word numbers) text by text, ascending by rank; lcp[r]: words that order[r-1] and order[r] share.

    depth: how many words of the suffixes are compared at least (None: all); those that still tie are in any order.
    """

    def __init__(self, hashes: np.ndarray, doc: np.ndarray, first: np.ndarray, depth: int | None = None):
        n = len(hashes)
        end = first[1:][doc] if n else np.zeros(0, np.int64)
        kind = np.int32 if n < 1 << 31 else np.int64
        rank = self._dense(np.lexsort((hashes, doc)), doc, hashes).astype(kind)
        levels, step = [rank], 1
        while depth is None or step < depth:
            tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1) if n else np.zeros(0, np.int64)
            if not len(tied):
                break
            after = tied + step
            inside = after < end[tied]
            second = np.where(inside, rank[np.minimum(after, n - 1)], -1)
            order = tied[np.lexsort((second, rank[tied]))]
            full = np.full(n, -1, kind)
            full[tied] = second
            a, b = rank[order], full[order]
            new_group = np.ones(len(order), bool)
            new_group[1:] = a[1:] != a[:-1]
            new_value = new_group.copy()
            new_value[1:] |= b[1:] != b[:-1]
            at = np.arange(len(order))
            group_at = np.maximum.accumulate(np.where(new_group, at, 0))
            value_at = np.maximum.accumulate(np.where(new_value, at, 0))
            rank = rank.copy()
            rank[order] = a + value_at - group_at
            levels.append(rank)
            step *= 2
        self.order = np.argsort(rank, kind="stable")
        self.lcp = np.zeros(n, np.int64)
        if n > 1:
            i, j = self.order[:-1], self.order[1:]
            same = np.flatnonzero(levels[0][i] == levels[0][j])
            i, j, shared = i[same], j[same], np.zeros(len(same), np.int64)
            for k in range(len(levels) - 1, -1, -1):
                a, b = i + shared, j + shared
                can = (a < end[i]) & (b < end[j])
                equal = can & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
                shared += np.where(equal, 1 << k, 0)
            self.lcp[same + 1] = shared

    @staticmethod
    def _dense(order: np.ndarray, doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Rank of each entry: how many are less."""
        new = np.ones(len(order), bool)
        new[1:] = (doc[order[1:]] != doc[order[:-1]]) | (hashes[order[1:]] != hashes[order[:-1]])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        return rank

    def deepest(self) -> np.ndarray:
        """For each word, the length of the longest repeat that begins with it."""
        out = np.zeros(len(self.order), np.int64)
        after = np.append(self.lcp[1:], 0)
        out[self.order] = np.maximum(self.lcp, after)
        return out

    def intervals(self, least: int) -> Iterator[tuple[int, int, int]]:
        """(length, from, to): the LCP intervals of `least` words or more; order[from:to] are a repeat's occurrences."""
        stack: list[list[int]] = []
        for r in range(1, len(self.order) + 1):
            here = int(self.lcp[r]) if r < len(self.order) else 0
            begin = r - 1
            while stack and stack[-1][0] > here:
                length, begin = stack.pop()
                yield length, begin, r
            if here >= least and (not stack or stack[-1][0] < here):
                stack.append([here, begin])


def covered(deepest: np.ndarray, least: int, end: np.ndarray) -> np.ndarray:
    """Whether each word lies in a repeat of `least` words or more."""
    at = np.flatnonzero(deepest >= least)
    edge = np.zeros(len(deepest) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + deepest[at], end[at]), -1)
    return np.cumsum(edge[:-1]) > 0


def repeats(text: str, least: int = MIN_REPEAT) -> list[tuple[int, list[tuple[int, int]]]]:
    """(words, byte spans of the occurrences) of every maximal repeat of a text: one that no word on either side
    could extend at all its places."""
    words = Words([text])
    hashes = words.hashes()
    array = SuffixArray(hashes, words.doc, words.first)
    out = []
    for length, s, e in array.intervals(least):
        at = np.sort(array.order[s:e])
        before = {int(hashes[i - 1]) if i else None for i in at}
        if len(before) > 1 or None in before:
            out.append((length, [(int(words.start[i]), int(words.end[i + length - 1])) for i in at]))
    return sorted(out, key=lambda r: (-r[0], r[1]))


def _duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The columns of `quality_rules` for some texts."""
    words = Words(texts)
    n = words.counts()
    deepest = SuffixArray(words.hashes(), words.doc, words.first, MAX_REPEAT + 1).deepest()
    end = words.first[1:][words.doc] if len(deepest) else np.zeros(0, np.int64)
    edge = np.zeros(len(deepest) + 1, np.int64)
    at = np.flatnonzero(deepest >= WINDOW)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    per_text = lambda flags: sums_by(words.text_at, flags.astype(np.int64))
    solid = ~np.isin(words.data, np.frombuffer(_BLANK.encode(), np.uint8))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, words.doc, deepest)
    out = {
        "n_words": n,
        "word_chars": per_text(solid & ((words.data & 0xC0) != 0x80)),
        "n_symbols": per_text(_SYMBOLS[words.data]),
        "n_dup_lines": np.array([_duplicate_lines(t) for t in texts], np.int64),
        "n_repeat_words": sums_by(words.first, (np.cumsum(edge[:-1]) > 0).astype(np.int64)),
        "n_covered_words": sums_by(words.first, covered(deepest, MIN_REPEAT, end).astype(np.int64)),
    }
    out["base_failed"] = (n < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_WINDOW_PERCENT * n)
    out["long_repeat"] = longest > MAX_REPEAT
    out["kept"] = ~out["base_failed"] & (out["n_covered_words"] <= MAX_COVERED * n) & ~out["long_repeat"]
    return out


FIELDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "n_covered_words": "long", "long_repeat": "boolean"}


def quality_rules(spark: SparkSession, df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns FIELDS, which replace columns of these names; all others stay.

    A null or empty text has no words and fails. Repeated rows each get their verdict, which depends on the row alone.
    """
    small_batches(spark)
    rest = df.drop(*FIELDS)
    schema = StructType(list(rest.schema.fields))
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text):
            found = measure(texts)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[f]) for f in FIELDS)], [*names, *FIELDS])

    for name, kind in FIELDS.items():
        schema = schema.add(name, kind)
    return rest.mapInArrow(run, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(spark, docs).drop("text")


def _covered_sql(size: int, name: str) -> str:
    """Words of a text in windows of `size` words that it has twice or more."""
    return f"""
{name}_windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + {size - 1}], ' ')) AS c
  FROM words, unnest(generate_series(1, len(w) - {size - 1})) AS s(i) WHERE len(w) >= {size}
), {name} AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM {name}_windows, unnest(generate_series(0, {size - 1})) AS s(k) WHERE c > 1 GROUP BY doc_id
)"""


#: The rules over a table or CTE `docs` (doc_id, text), as CTEs that end in `rules`.
RULES_SQL = f"""
words AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM docs
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), {_covered_sql(WINDOW, "threes")}, {_covered_sql(MIN_REPEAT, "tens")}, longest AS (
  SELECT DISTINCT doc_id FROM (
    SELECT doc_id, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + {MAX_REPEAT}], ' ')) AS c
    FROM words, unnest(generate_series(1, len(w) - {MAX_REPEAT})) AS s(i) WHERE len(w) > {MAX_REPEAT}
  ) WHERE c > 1
), measured AS (
  SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(threes.n, 0) AS n_repeat_words, coalesce(tens.n, 0) AS n_covered_words,
    longest.doc_id IS NOT NULL AS long_repeat
  FROM words w LEFT JOIN lines USING (doc_id) LEFT JOIN threes USING (doc_id) LEFT JOIN tens USING (doc_id) LEFT JOIN longest USING (doc_id)
), rules AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_WINDOW_PERCENT} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_WINDOW_PERCENT} * n_words)
      AND n_covered_words <= {MAX_COVERED} * n_words AND NOT long_repeat AS kept
  FROM measured
)"""

OP3_SQL = f"WITH docs AS (SELECT doc_id, text FROM documents), {RULES_SQL} SELECT * FROM rules"
