"""Byte-level BPE by a local rank file: encoding with tiktoken, and decoding of ids to bytes."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.words import slices

#: Longer texts are encoded in pieces of about this many code points.
PIECE = 50_000
#: Bytes of text that are encoded before their ids are handed on.
BATCH_BYTES = 4_000_000
#: A longer run of white space never goes through the pattern, which could not take it back step by step.
RUN = 10_000
#: No match of the split pattern goes on over white space that follows something else. U+001C to U+001F
#: are white space to Python alone.
_SAFE = re.compile(r"(?<=\S)(?=[^\S\x1c-\x1f])")
_LONG_RUN = re.compile(r"[^\S\x1c-\x1f]{%d,}" % RUN)
_coders: dict[str, Encoder | Decoder] = {}


def _table(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}


class Encoder:
    """A vocabulary of ranks with the pattern that splits text before merging."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        self.own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_table(ranks), special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        parts = [self._one(p) if whole else self.own.encode_to_numpy(p, disallowed_special=()) for p, whole in pieces(text)]
        return np.concatenate([np.zeros(0, np.uint32), *parts]).astype("<i4")

    def _one(self, match: str) -> np.ndarray:
        """The ids of one match of the pattern."""
        return np.array(self.own._encode_single_piece(match), np.uint32)


class Decoder:
    """The bytes of each rank."""

    def __init__(self, ranks: bytes):
        table = _table(ranks)
        self.piece = np.empty(max(table.values(), default=-1) + 2, object)
        self.piece[:] = b""
        for token, rank in table.items():
            self.piece[rank] = token

    def decode(self, ids: pa.Array) -> bytes:
        ids = ids.drop_null().to_numpy()
        return b"".join(self.piece[np.where((ids < 0) | (ids >= len(self.piece)), len(self.piece) - 1, ids)])


def pieces(text: str) -> Iterator[tuple[str, bool]]:
    """Parts of a text, cut only where the split pattern always ends a match; and whether a part is one whole match.

    Of a run of white space the pattern takes all but the last character as one match, which may begin
    the next; of a run at the end it takes all. No other match goes on over it.
    """
    done = 0
    for m in _LONG_RUN.finditer(text) if len(text) >= RUN else ():
        yield from _between(text, done, m.start())
        done = m.end() - (m.end() < len(text))
        yield text[m.start() : done], True
    yield from _between(text, done, len(text))


def _between(text: str, done: int, end: int) -> Iterator[tuple[str, bool]]:
    while end - done > PIECE and (m := _SAFE.search(text, done + PIECE, end)):
        yield text[done : m.start()], False
        done = m.start()
    if done < end:
        yield text[done:end], False


def _kept(key: str, make):
    """A worker's coder, built once."""
    if key not in _coders:
        _coders[key] = make()
    return _coders[key]


def encoder(ranks: bytes, pattern: str) -> Encoder:
    return _kept("e" + hashlib.sha256(ranks + pattern.encode()).hexdigest(), lambda: Encoder(ranks, pattern))


def decoder(ranks: bytes) -> Decoder:
    return _kept("d" + hashlib.sha256(ranks).hexdigest(), lambda: Decoder(ranks))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs(text, ...)`` with ``ids array<int>`` by the ranks in ``path`` (a local file of the driver).

    Each match of ``pattern`` is encoded separately and no string counts as a special token. The last
    alternatives of ``pattern`` must be ``\\s+(?!\\S)|\\s+``, and no other may take white space but one
    leading space. A null or
    empty text has no ids. Other columns pass through; one named ids is replaced. Rows are independent,
    so repeated rows, null ids and empty tables need no rule of their own.
    """
    with open(path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in docs.columns if c.lower() != "ids"]

    def run(batches):
        bpe = encoder(ranks.value, pattern)
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                ids = [bpe.encode(x.as_py() or "") for x in part.column("text")]
                ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32()))], [*rest, "ids"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema), "ids array<int>"])
    return docs.select(*rest).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows(ids, ...)`` with ``decoded binary``: the bytes that the ids stand for; null ids give empty bytes.

    The bytes of a single token need not be valid UTF-8. Ids that are null, negative or not in the file
    add nothing. Other
    columns pass through; one named decoded is replaced.
    """
    with open(path, "rb") as f:
        ranks = rows.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in rows.columns if c.lower() != "decoded"]

    def run(batches):
        bpe = decoder(ranks.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = [bpe.decode(x.values) if x.is_valid else b"" for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*rest, "decoded"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*rest).schema), "decoded binary"])
    return rows.select(*rest).mapInArrow(run, schema)


def digests(rows: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of encoded and decoded rows."""

    def run(batches):
        for batch in batches:
            ids = [np.zeros(0, "<u4") if not x.is_valid else x.values.to_numpy(zero_copy_only=False).astype("<u4") for x in batch.column("ids")]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                "decoded_sha256": batch.column("decoded_sha256"),
            })

    hashed = rows.select("doc_id", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
    return hashed.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
