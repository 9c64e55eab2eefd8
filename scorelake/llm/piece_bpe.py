"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is escaped as the library does it (a space before it, spaces as U+2581)
and cut before every run of U+2581; no piece of the vocabulary crosses such a
cut, so the parts merge independently.  Within a part an agenda of adjacent
symbol pairs is worked off by score, then from the left; what is no piece falls
back to bytes.  Parts that recur are looked up in a bounded memory.

Every part met for the first time is encoded and decoded by the sentencepiece
library as well, an Arrow batch at a time, and a difference fails the job.

Defined cases: a null or empty text has no ids and decodes to the empty text; a
part of any length is merged whole; rows are independent, so repeated ids or
texts change nothing; an empty table gives an empty table; input columns pass
through, ``ids``, ``n_tokens`` and ``decoded`` replace input columns of those
names.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.common import packed, text_of, unpacked

# Executors need no copy of this package: what Python workers run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = "▁"
# Runs of letters and digits and runs of anything else; a run of U+2581 stands before what follows it.
WORD, OTHER = "[^\\W_²]", f"(?:[^\\w{SPACE}]|[_²])"
PART = re.compile(f"{SPACE}*{WORD}+|{SPACE}*{OTHER}+|{SPACE}+")
ACROSS = re.compile(f"[^{SPACE}]{SPACE}|{WORD}{OTHER}|{OTHER}{WORD}")
REMEMBERED_PARTS = 800_000  # parts kept by a worker before it forgets all
REMEMBERED_CHARS = 48  # longer parts are merged anew each time
OUT_CHARS = 1 << 20  # text per Arrow batch on the way out
PLACE = (1 << 32) - 1


class PieceCodec:
    """Pieces, scores and byte ids of a model, with own merging and joining."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=model)
        lib, n = self.library, self.library.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if lib.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        best_first = {s: r for r, s in enumerate(sorted({lib.get_score(i) for i in plain}, reverse=True))}
        # A piece's turn; the lower 32 bits are left for the place of the pair, so equal scores go left first.
        self.turn = {self.pieces[i]: best_first[lib.get_score(i)] << 32 for i in plain}
        probe = "  ﬁ \t  é  "
        if any(ACROSS.search(p) for p in self.ids) or len(self.byte_id) != 256 or SPACE not in self.ids:
            raise ValueError("only vocabularies with byte fallback and without pieces across a cut are supported")
        if lib.decode(lib.encode(probe)) != probe:
            raise ValueError("only models that leave the text as it is are supported")

    def merge(self, part: str) -> list[str]:
        """Join adjacent symbols, best score first and leftmost among equals, until no pair is a piece."""
        turn = self.turn.get
        symbol, n = list(part), len(part)
        agenda = [t | i for i in range(n - 1) if (t := turn(part[i : i + 2])) is not None]
        if not agenda:
            return symbol
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            left = entry & PLACE
            right = after[left]
            if right >= n or not (head := symbol[left]) or turn(joined := head + symbol[right]) != entry - left:
                continue  # one of the two has been joined otherwise meanwhile
            symbol[left], symbol[right] = joined, ""
            follower = after[left] = after[right]
            if follower < n:
                before[follower] = left
                if (t := turn(joined + symbol[follower])) is not None:
                    heappush(agenda, t | left)
            if (leader := before[left]) >= 0 and (t := turn(symbol[leader] + joined)) is not None:
                heappush(agenda, t | leader)
        return [s for s in symbol if s]

    def encode_part(self, part: str) -> list[int]:
        pieces, ids = self.merge(part), self.ids
        try:
            return [ids[p] for p in pieces]
        except KeyError:  # a character that is no piece
            return [i for p in pieces for i in ([ids[p]] if p in ids else [self.byte_id[b] for b in p.encode()])]

    def join(self, ids: list[int]) -> str:
        """The escaped text of ids, U+2581 as spaces; the space put before a text is still there."""
        if not any(i in self.byte_of for i in ids):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        raw = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].encode() for i in ids)
        return raw.decode("utf-8", "replace").replace(SPACE, " ")

    def check(self, parts: list[str], ids: list[list[int]], joined: list[str]) -> None:
        """Compare with the library, all parts in one text; what no space begins gets a cut from the part before it."""
        lead = {kind: self.encode_part(SPACE + kind) for kind in "a."}
        source, expected, whole, blank = [], [], [], []
        for part, own, plain in zip(parts, ids, joined, strict=True):
            if not part.strip(SPACE):  # would run together with the next part
                blank.append((part, own, plain))
                continue
            if part[0] != SPACE:
                kind = "." if re.match(WORD, part[0]) else "a"
                source.append(SPACE + kind)
                whole.append(" " + kind)
                expected += lead[kind]
            source.append(part)
            whole.append(plain)
            expected += own
        same = self.library.encode("".join(source)[1:]) == expected and self.library.decode(expected) == "".join(whole)[1:]
        for part, own, plain in blank:
            if part != SPACE:  # a lone one has no text of its own to give the library
                same = same and self.library.encode(part[1:]) == own and self.library.decode(own) == plain[1:]
        if not same:
            raise RuntimeError("ids or texts differ from the library's")


def _escaped(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def _worker_memory() -> dict:
    """What the tasks of one worker process share; a sent function's own globals last for one task."""
    return sys.modules.setdefault("_piece_bpe_memory", ModuleType("_piece_bpe_memory")).__dict__


def _coder(model: bytes, check: bool):
    digest = hashlib.sha256(model).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _worker_memory()
        if (digest, check) not in memory:
            memory[digest, check] = (PieceCodec(model), {}, {})
        # Ids of parts; and texts of those that do not decode to themselves, which only a lossy model has.
        codec, known, changed = memory[digest, check]

        def learn(parts: set[str]) -> None:
            listed = list(parts)
            ids = [codec.encode_part(p) for p in listed]
            joined = [codec.join(i) for i in ids]
            if check:
                codec.check(listed, ids, joined)
            for part, own, text in zip(listed, ids, joined, strict=True):
                known[part] = array("i", own).tobytes()
                if text != part.replace(SPACE, " "):
                    changed[part] = text

        for batch in batches:
            texts, start = batch.column(1), 0
            while start < batch.num_rows:
                stop, chars, split = start, 0, []
                while stop < batch.num_rows and chars < OUT_CHARS:
                    text = texts[stop].as_py()
                    split.append(PART.findall(_escaped(text)))
                    chars += len(text)
                    stop += 1
                if len(known) > REMEMBERED_PARTS:
                    known.clear()
                    changed.clear()
                fresh = set().union(*split).difference(known)
                learn(fresh)
                coded = [b"".join([known[p] for p in parts]) for parts in split]
                if changed:
                    split = [[changed.get(p, p) for p in parts] for parts in split]
                decoded = ["".join(parts).replace(SPACE, " ")[1:] for parts in split]
                for part in fresh:
                    if len(part) > REMEMBERED_CHARS:
                        del known[part]
                        changed.pop(part, None)
                ends = np.cumsum([0] + [len(c) // 4 for c in coded]).astype(np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(coded))])
                ids = pa.ListArray.from_arrays(pa.array(ends), values)
                row = batch.column(0).slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([row, ids, pa.array(decoded, pa.string())], names=["row", "ids", "decoded"])
                start = stop

    return run


def encode_documents(docs: DataFrame, model: bytes, *, text_col: str = "text", check: bool = True) -> DataFrame:
    """The documents with ``ids``, ``n_tokens`` and ``decoded``; ``model`` is the content of a model file."""
    rows = docs.select(packed(docs).alias("row"), text_of(text_col).alias("text"))
    schema = T.StructType(
        [
            T.StructField("row", rows.schema["row"].dataType),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded", T.StringType()),
        ]
    )
    coded = rows.mapInArrow(_coder(model, check), schema)
    size = F.size("ids").cast("long")
    return unpacked(coded, "row", docs.columns, ids=F.col("ids"), n_tokens=size, decoded=F.col("decoded"))
