"""Quality rules with suffix-array repetition.

Base rules count words, symbols, repeated lines and repeated 3-word windows.  The method builds a suffix array over the
words of each text by prefix doubling; longest-common-prefix values give the maximal repeated substrings, whose spans
are united.  A text is rejected if these cover too much of it or one of them is too long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, sliced, small_batches, table

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_WORDS_PCT = 50, 50
#: Words that a repeated substring has at least; the largest covered share of the words; the longest repeat allowed.
MIN_REPEAT, MAX_COVERED_PCT, MAX_LONGEST = 8, 40, 100
_BATCH_WORDS = 100_000


def _dense(keys: np.ndarray) -> np.ndarray:
    """Order-preserving ranks from 0."""
    order = np.argsort(keys, kind="stable")
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.concatenate([[0], np.cumsum(np.diff(keys[order]) != 0)]) if len(keys) else []
    return ranks


def _suffix_repeats(symbols: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """For each word, the length of the longest substring from there that occurs elsewhere in its text (0: under least).

    symbols: dense ranks of (text, word), so that suffixes of different texts never match; ends: the end of each word's
    text.  Prefix doubling keeps only suffixes that still share their rank; the ranks of every level give the common
    prefix of neighbours in the suffix array by binary lifting.
    """
    n = len(symbols)
    levels, rank, h = [symbols], symbols, 1
    active = np.flatnonzero(np.bincount(rank, minlength=1)[rank] > 1) if n else np.empty(0, np.int64)
    place = np.arange(n)
    while len(active):
        after = active + h
        second = np.where(after < ends[active], rank[np.minimum(after, n - 1)] + 1, 0)
        # ranks leave room: those of a group of size m are followed by m - 1 unused numbers
        pair = _dense(rank[active] * (n + 1) + second)
        order = np.argsort(pair, kind="stable")
        sorted_rank, sorted_pair = rank[active][order], pair[order]
        first_of_rank = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
        first_of_pair = np.concatenate([[True], sorted_pair[1:] != sorted_pair[:-1]])
        at = np.arange(len(active))
        offset = np.maximum.accumulate(np.where(first_of_pair, at, 0)) - np.maximum.accumulate(np.where(first_of_rank, at, 0))
        new = rank.copy()
        new[active[order]] = sorted_rank + offset
        levels.append(new)
        rank, h = new, h * 2
        sizes = np.bincount(rank[active], minlength=1)
        active = active[sizes[rank[active]] > 1]
    suffixes = place[np.argsort(rank, kind="stable")]
    # longest common prefixes of neighbours
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    common = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        fits = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[fits] = levels[k][a[fits]] == levels[k][b[fits]]
        # a rank shared at level k means 2**k equal words only where both suffixes have that many
        same &= (a + (1 << k) <= ends[np.minimum(suffixes[:-1], n - 1)]) & (b + (1 << k) <= ends[np.minimum(suffixes[1:], n - 1)])
        common[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    longest = np.zeros(n, np.int64)
    if n > 1:
        longest[suffixes[1:]] = common
        longest[suffixes[:-1]] = np.maximum(longest[suffixes[:-1]], common)
    longest[longest < least] = 0
    return longest


def _covered(starts_len: np.ndarray) -> np.ndarray:
    """Which words lie in a span [i, i + starts_len[i])."""
    n = len(starts_len)
    reach = np.maximum.accumulate(np.where(starts_len > 0, np.arange(n) + starts_len, 0)) if n else starts_len
    return reach > np.arange(n)


def _measure(texts: list[str], least: int) -> list[np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words covered by repeats, longest repeat."""
    n = len(texts)
    codes: dict[bytes, int] = {}
    n_words, chars, symbols, dup_lines, repeats = np.zeros((5, n), np.int64)
    ids = []
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        n_words[i] = len(words)
        chars[i] = len(text) - (len(raw) - sum(map(len, words)))
        symbols[i] = sum(raw.count(c) for c in SYMBOLS)
        if b"\n" in raw:
            lines = [x for x in raw.split(b"\n") if x.strip()]
            dup_lines[i] = len(lines) - len(set(lines))
        ids.append(np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words)))
    word = np.concatenate(ids) if ids else np.empty(0, np.int64)
    doc = np.repeat(np.arange(n), n_words)
    ends = np.repeat(np.cumsum(n_words), n_words)
    total = len(word)
    rank = _group_start(doc * max(len(codes), 1) + word)
    # 3-word windows
    at = np.flatnonzero(np.arange(total) + 3 <= ends)
    if len(at):
        two = _dense(rank[at] * total + rank[at + 1])
        three = _dense(two * total + rank[at + 2])
        twice = np.bincount(three)[three] > 1
        spans = np.zeros(total, np.int64)
        spans[at[twice]] = 3
        repeats += np.bincount(doc, _covered(spans), minlength=n).astype(np.int64)
    longest = _suffix_repeats(rank, ends, least)
    covered = np.bincount(doc, _covered(longest), minlength=n).astype(np.int64) if total else np.zeros(n, np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc, longest)
    return [n_words, chars, symbols, dup_lines, repeats, covered, most]


def _group_start(keys: np.ndarray) -> np.ndarray:
    """Rank of each key: how many keys are smaller."""
    order = np.argsort(keys, kind="stable")
    ranks = np.empty(len(keys), np.int64)
    if len(keys):
        first = np.concatenate([[True], np.diff(keys[order]) != 0])
        ranks[order] = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
    return ranks


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about _BATCH_WORDS words; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > 6 * _BATCH_WORDS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def _verdicts(texts: list[str], least: int, max_covered_pct: float, max_longest: int):
    parts = [_measure(texts[a:b], least) for a, b in _slices(texts)]
    m = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 7
    n_words, repeats, covered, longest = m[0], m[4], m[5], m[6]
    failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_WORDS_PCT * n_words)
    return m, failed, ~failed & (100 * covered <= max_covered_pct * n_words) & (longest <= max_longest)


_SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_covered bigint, longest_repeat bigint, base_failed boolean, kept boolean"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT, max_covered_pct: float = MAX_COVERED_PCT, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row for each row of docs: the base counts, n_covered and longest_repeat (words), base_failed and kept.

    kept: the base rules hold, repeated substrings of min_repeat or more words cover at most max_covered_pct percent of
    the words, and none is longer than max_longest words.  Null texts count as empty, have no words and fail.
    """
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            m, failed, kept = _verdicts(b["text"].to_pylist(), min_repeat, max_covered_pct, max_longest)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(x, pa.int64()) for x in m), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], names)

    return id_text(docs, id_col, text_col).mapInArrow(measure, _SCHEMA)


def keep_good(docs: DataFrame, text_col: str = "text", min_repeat: int = MIN_REPEAT, max_covered_pct: float = MAX_COVERED_PCT, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of docs, all columns, that quality_rules keeps; no shuffle."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text_col):
            yield b.filter(pa.array(_verdicts([t or "" for t in b[text_col].to_pylist()], min_repeat, max_covered_pct, max_longest)[2], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT r, g AS i, ws[g:g+2] AS w3, CASE WHEN g + {MIN_REPEAT - 1} <= len(ws) THEN ws[g:g+{MIN_REPEAT - 1}] END AS wk,
    CASE WHEN g + {MAX_LONGEST} <= len(ws) THEN md5(array_to_string(ws[g:g+{MAX_LONGEST}], ' ')) END AS wl
  FROM w, unnest(range(1, len(ws) + 1)) AS u(g)),
hit AS (SELECT r, i, w3, wk, CASE WHEN len(w3) = 3 AND count(*) OVER (PARTITION BY r, w3) > 1 THEN 1 ELSE 0 END AS h3,
    CASE WHEN wk IS NOT NULL AND count(*) OVER (PARTITION BY r, wk) > 1 THEN 1 ELSE 0 END AS hk,
    CASE WHEN wl IS NOT NULL AND count(*) OVER (PARTITION BY r, wl) > 1 THEN 1 ELSE 0 END AS hl FROM win),
cov AS (SELECT r, max(h3) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
    max(hk) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {MIN_REPEAT - 1} PRECEDING AND CURRENT ROW) AS ck, hl FROM hit),
per AS (SELECT r, sum(c3)::BIGINT AS n_repeat_words, sum(ck)::BIGINT AS n_covered, max(hl) AS too_long FROM cov GROUP BY r),
lines AS (SELECT r, (count(*) - count(DISTINCT l))::BIGINT AS n_dup_lines FROM d, unnest(string_split(text, chr(10))) AS u(l)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_covered, 0)::BIGINT AS n_covered, coalesce(too_long, 0) AS too_long
  FROM w LEFT JOIN per USING (r) LEFT JOIN lines USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_WORDS_PCT} * n_words) AS base_failed,
  (NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_WORDS_PCT} * n_words)
    AND 100 * n_covered <= {MAX_COVERED_PCT} * n_words AND too_long = 0) AS kept
FROM base
"""
