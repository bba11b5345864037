"""Secret scan: rules for known forms, then zstandard novelty for the rest.

A candidate is a run of 16 or more key-like characters with a sensitive word near it, or one that only separators (line
ends, dots, quotes) part from such a candidate: the lines of a key, the parts of a token.  Its novelty is the number of
compressed bytes it adds, per character, to the text around it and the parts joined to it, with an identifier dictionary
primed.  Names, words and
placeholders are predicted by text and dictionary; random keys are not, and are reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, sha_of, sliced, small_batches, table

#: Fixed forms of the contract; (kind, pattern, group, least length of that group).
_FLAGS = re.ASCII | re.IGNORECASE
FORMS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),  # a maximal run, as [0-9a-f]+ would find it
]
KINDS = ["assign", "access", "hex", "novel"]
SENSITIVE = re.compile(r"pass(?:word|wd|phrase)?\b|secret|token|api[_-]?key|auth|credential|private|bearer|access[_-]?key|signature|licen[sc]e[_-]?key", _FLAGS)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: What may stand between two parts of one secret (a backslash: of an escaped line end), and a key's last line, if short.
SEPARATORS = re.compile(r"""[\s."'\\]+""", re.ASCII)
LAST_LINE = re.compile(r"""[\s"'\\]+([A-Za-z0-9+/=]{1,15})(?=[\s"'\\n]*-----END)""", re.ASCII)
#: Names that code and settings are full of; primes the compressor.
IDENTIFIERS = (
    "import from return self class function const let var public private static final string value default none true false null "
    "password passwd secret token api_key apikey access_key secret_key client_id client_secret authorization bearer credentials "
    "username user_name email address config settings environment variable production staging development test example sample "
    "placeholder changeme your_api_key_here your-secret-token insert_token_here localhost http:// https:// www.example.com "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef"
)


def _compressor(identifiers: str):
    import zstandard as z

    return z.ZstdCompressor(level=9, dict_data=z.ZstdCompressionDict(identifiers.encode(), dict_type=z.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False)


def marginal_bytes(compressor, around: str, candidate: str) -> int:
    """Compressed bytes that candidate adds to the text around it."""
    a = around.encode("utf-8", "replace")
    return len(compressor.compress(a + candidate.encode())) - len(compressor.compress(a))


def spans_of(text: str, compressor, novelty: float, context: int, near: int) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end), sorted; code points, end exclusive."""
    base = sorted((m.start(), i, m.end()) for i, (_, form, group, least) in enumerate(FORMS) for m in form.finditer(text) if m.end(group) - m.start(group) >= least)
    # chains of candidates in sensitive context: [start, place of the kind or -1 for one that a form has, end] of each
    chains, last, at, near_base = [], None, 0, []
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while at < len(base) and base[at][0] < e:
            near_base.append(base[at])
            at += 1
        near_base = [x for x in near_base if x[2] > s]  # candidates ascend: what ends before this one is done with
        over = [(i, y) for _, i, y in near_base]
        carried = last is not None and (s <= last or SEPARATORS.fullmatch(text, last, s))
        if not (carried or any(i < 2 for i, _ in over) or SENSITIVE.search(text, max(0, s - near), s) or SENSITIVE.search(text, e, e + near // 2)):
            last = None
            continue
        if not carried:
            chains.append([])
        chains[-1].append((s, -1 if over else 3, e))
        last = max([e, *(y for _, y in over)])
    found = []
    for chain in chains:
        around = text[max(0, chain[0][0] - context) : chain[0][0]] + text[chain[-1][2] : chain[-1][2] + context]
        new = [(s, k, e) for s, k, e in chain if k == 3 and marginal_bytes(compressor, around, text[s:e]) >= novelty * (e - s)]
        found += new
        s, _, e = chain[-1]
        if (new and new[-1][2] == e or chain[-1][1] < 0) and (m := LAST_LINE.match(text, e)):
            found.append((m.start(1), 3, m.end(1)))  # too short to be measured
    return sorted(base + found)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers: str = IDENTIFIERS, novelty: float = 0.75, context: int = 256, near: int = 48) -> DataFrame:
    """doc_id and spans (array of kind, start, end by start, then kind) of every row.

    Spans are code points of the whole text, end exclusive.  novelty: least compressed bytes a character; context:
    characters taken on either side as surrounding code; near: how far before a candidate the sensitive word may stand.
    Null and empty texts have no spans; rows are kept as often as they occur.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = _compressor(identifiers)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in sliced(batches):
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(t, compressor, novelty, context, near)] for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found, kind)], ["doc_id", "spans"])

    return id_text(docs, id_col, text_col).mapInArrow(scan, "doc_id bigint, spans array<struct<kind:string,start:int,end:int>>")


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]", identifiers: str = IDENTIFIERS, novelty: float = 0.75, context: int = 256, near: int = 48) -> DataFrame:
    """docs, all columns, with each found span in text replaced by mark (overlapping spans by one) and the length set anew."""
    columns = docs.columns

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = _compressor(identifiers)
        for b in sliced(batches, text_col):
            texts = b[text_col].to_pylist()
            for i, t in enumerate(texts):
                out, at = [], 0
                for s, _, e in spans_of(t, compressor, novelty, context, near) if t else []:
                    if s >= at:
                        out += [t[at:s], mark]
                    at = max(at, e)
                if out:
                    texts[i] = "".join([*out, t[at:]])
            b = b.set_column(columns.index(text_col), text_col, pa.array(texts, pa.string()))
            if length_col in columns:
                at, old = columns.index(length_col), b[length_col].to_pylist()
                b = b.set_column(at, b.schema.field(at), pa.array([n if t is None else len(t) for t, n in zip(texts, old, strict=True)], b.schema.field(at).type))
            yield b

    small_batches(docs.sparkSession)
    return docs.mapInArrow(redact, docs.schema)


def joined_spans(spans: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end, comma-joined."""
    if kinds:
        spans = F.filter(spans, lambda x: x["kind"].isin(kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def span_digest(found: DataFrame, kinds: list[str]) -> DataFrame:
    """The contract's columns: a count for each base kind, the digest of the base spans, and all spans."""
    kind_list = F.transform("spans", lambda x: x["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kind_list, k))).cast("bigint").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, sha_of(joined_spans(F.col("spans"), kinds)).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(scan_secrets(table(spark, sf_dir, "documents")), ["assign", "access", "hex"])
