"""Secret scan: fixed patterns, and zstandard novelty against code and identifiers.

Base spans follow three patterns (assign, access, hex).  Further spans (novel)
are strings in a sensitive context that compression cannot explain: a candidate,
any run of 12 or more, stands behind a sensitive word, and the bytes it adds to its
surrounding code, compressed with a dictionary of the corpus's own identifiers and
words, are compared with its length.  Names, paths and prose are in the dictionary
or repeat what stands around them and cost little; keys cost nearly all of their
length, whatever characters they are made of.  Literals are not entropy coded, as
the code of short surroundings would decide on a short key.

The dictionary holds the identifiers that most often stand before an assignment
in all documents, and the words that most often stand outside sensitive contexts
(so no key explains itself), counted over the whole corpus; ``DICTIONARY_WORDS``
bounds either.  A word that the corpus has only behind sensitive words is reported.

Defined cases: a null or empty text has no spans; spans are code points, end
exclusive; texts of any length are scanned whole; rows are independent apart
from the dictionary; an empty table gives an empty table; input columns pass
through, ``spans`` (an array) replaces an input column of that name.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.common import packed, stage, text_of, unpacked

# Executors need no copy of this package: what Python workers run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ["assign", "access", "hex", "novel"]
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# A run that fails the length contains no shorter match, so the length may stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

SENSITIVE = re.compile(
    r"password|passwd|pwd|secret|token|api[_-]?key|credential|private[_-]?key|access[_-]?key|auth|bearer|signature|session", re.IGNORECASE
)
SENSITIVE_STARTS = ("pass", "pwd", "secret", "token", "api", "credential", "key", "auth", "bearer", "signature", "session")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
WORD = re.compile(r"[A-Za-z]{4,40}")
CANDIDATE_END = re.compile(r"[A-Za-z0-9+/_=-]*")
BEFORE = 48  # code points in which a sensitive word must stand
AROUND = 256  # code points of surrounding code on either side
TAIL = bytes(range(16))  # no match is looked for in the last bytes, so these are the same for either form
NOVELTY = 0.7  # compressed bytes added per byte of the candidate
DICTIONARY_WORDS = 2000
COMMON_CODE = (
    "const var let return import from function class public private static final string int self this null None True False "
    "http https www com org json xml html config settings environ export default require module object value name key id "
    "user password secret token api_key apikey access_key private_key credential authorization bearer signature session "
)
NAME_BEFORE = re.compile(r"""([A-Za-z_][A-Za-z0-9_]{2,40})["']?\x20*$""")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Novelty:
    """Bytes that a candidate adds to the compressed form of what surrounds it."""

    def __init__(self, dictionary: bytes):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        # The fast strategy with a target length leaves literals as they are.
        way = zstandard.ZstdCompressionParameters.from_level(
            9, strategy=zstandard.STRATEGY_FAST, min_match=4, target_length=1, write_content_size=False, write_checksum=False
        )
        self.compressor = zstandard.ZstdCompressor(dict_data=primed, compression_params=way)

    def of(self, before: str, candidate: str, after: str) -> float:
        # The words ahead are in the dictionary, so both forms are compressed blocks; a stored one would cost otherwise.
        around = (COMMON_CODE + after + "\n" + before).encode()
        with_it = len(self.compressor.compress(around + candidate.encode() + TAIL))
        return (with_it - len(self.compressor.compress(around + TAIL))) / len(candidate)

    def spans(self, text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        found = []
        low = text.lower()
        if not any(w in low for w in SENSITIVE_STARTS):
            return found
        for m in CANDIDATE.finditer(text):
            start, end = m.span()
            word = m.group()
            if not SENSITIVE.search(text, max(0, start - BEFORE), start) or any(a < end and start < b for a, _, b in known):
                continue
            if self.of(text[max(0, start - AROUND) : start], word, text[end : end + AROUND]) >= NOVELTY:
                found.append((start, 3, end))
        return found


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often identifiers stand before an assignment, and words outside sensitive contexts, a batch at a time."""
    for batch in batches:
        names: Counter[str] = Counter()
        words: Counter[str] = Counter()
        for text in batch.column(0):
            text = text.as_py()
            at = re.finditer("[:=]", text)
            for m in at:
                if named := NAME_BEFORE.search(text, max(0, m.start() - 44), m.start()):
                    names[named.group(1)] += 1
            start = 0
            low = text.lower()
            if any(w in low for w in SENSITIVE_STARTS):
                for m in SENSITIVE.finditer(text):
                    # The sensitive word's own run stands behind none; a run that the context cuts is left out whole.
                    if m.start() >= start:
                        words.update(WORD.findall(text, start, CANDIDATE_END.match(text, m.start()).end()))
                    rest = CANDIDATE_END.match(text, min(len(text), m.end() + BEFORE))
                    start = max(start, rest.end())
            words.update(WORD.findall(text, start))
        for kind, seen in enumerate((names, words)):
            if seen:
                arrays = [pa.array(list(seen)), pa.array([kind] * len(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["name", "kind", "times"])


def identifier_dictionary(docs: DataFrame, *, text_col: str = "text", words: int = DICTIONARY_WORDS) -> bytes:
    """The ``words`` most frequent words and identifiers before assignments, the commonest identifiers last, as dictionary content."""
    counted = (
        docs.select(text_of(text_col)).mapInArrow(_names, "name string, kind int, times long")
        .groupBy("kind", "name").agg(F.sum("times").alias("times"))
    )
    top = stage(counted)
    best = [top.filter(F.col("kind") == k).orderBy(F.desc("times"), "name").limit(words).collect() for k in (1, 0)]
    return (COMMON_CODE * 2 + " ".join(r.name for rows in best for r in reversed(rows))).encode()


def _scanner(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in batches:
            spans = []
            for text in batch.column(1):
                text = text.as_py()
                base = base_spans(text)
                found = sorted(base + novelty.spans(text, base))
                spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS)], names=["row", "spans"])

    return run


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_SPANS_SQL = "array<struct<kind:string,start:int,end:int>>"


def scan_secrets(docs: DataFrame, *, text_col: str = "text", dictionary: bytes | None = None) -> DataFrame:
    """The documents with ``spans``: ``(kind, start, end)`` by start, then kind as listed in ``KINDS``."""
    if dictionary is None:
        dictionary = identifier_dictionary(docs, text_col=text_col)
    rows = docs.select(packed(docs).alias("row"), text_of(text_col).alias("text"))
    schema = T.StructType(
        [T.StructField("row", rows.schema["row"].dataType), T.StructField("spans", T._parse_datatype_string(_SPANS_SQL))]
    )
    return unpacked(rows.mapInArrow(_scanner(dictionary), schema), "row", docs.columns, spans=F.col("spans"))
