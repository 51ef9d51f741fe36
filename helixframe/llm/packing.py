"""Sum-of-squares packing of tokenised documents into sequences.

Documents are tokenised word by word (the tokenizer's rules never look across ASCII
white space), cut into pieces of at most ``capacity`` tokens, and dealt by hash to
shards.  A shard keeps the number N(g) of open sequences for every residual gap g, and
places each piece where the sum of N(g)^2 becomes smallest: in a sequence of some gap
that holds it, or in a new one.

Defined cases: a null or empty text is the end token alone; repeated rows are packed one
by one; ties go to the smaller gap, and within a gap to the sequence opened last.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.runtime import materialize

CAPACITY = 2048
END_ID = 0
#: Pieces for a shard: its state is one array of gaps and the open sequences.
SHARD_PIECES = 8192
#: Words whose ids a worker remembers.
CACHE_WORDS = 400_000

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


class PieceIds(dict):
    """The ids of a piece: a run of letters, a digit, or a run of other characters, lower-cased."""

    def __init__(self, model):
        self.model = model
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.letters = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def __missing__(self, piece: str) -> bytes:
        text = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(text)])
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[piece] = ids
        return ids


class WordIds(dict):
    """The ids of a word, as little-endian unsigned 32-bit bytes.

    Words of plain Latin letters and signs are cut into pieces here, by the tokenizer's own
    pattern, and only pieces go to its model; any other word goes through the tokenizer.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        forms = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        # the short way holds for this make of tokenizer alone
        self.cut = regex.compile(steps[0]["pattern"]["Regex"]) if [x["type"] for x in steps] == ["Split", "ByteLevel"] and forms == ["NFC", "Replace", "Lowercase"] else None
        self.plain = regex.compile("[!-~\u00a1-\u012f\u0131-\u017f]+")
        self.pieces = PieceIds(self.tok.model)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.cut is None or "<|" in text or not self.plain.fullmatch(text):
            ids = np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        elif text.isascii() and text.isalpha():
            ids = self.pieces[text.lower()]
        else:
            ids = b"".join([self.pieces[x] for x in self.cut.findall(text.lower())])
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


def token_bytes(text: str | bytes | None, cache: WordIds) -> bytes:
    """All ids of a text and the end token."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return b"".join(map(cache.__getitem__, raw.split())) + END_ID.to_bytes(4, "little")


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece: its place in the document's ids, its length and its checksum.

    ``with_ids`` adds the ids themselves (binary), for writing the sequences out.
    """
    schema = PIECES + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordIds(vocabulary)
        out_schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.binary())] if with_ids else []))
        for batch in batches:
            rows: list[tuple] = []
            for ident, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = token_bytes(text.as_py(), cache)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    rows.append((ident, row, k, at // 4, len(cut) // 4, zlib.crc32(cut)) + ((cut,) if with_ids else ()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out_schema.types, strict=True)] if rows else [pa.array([], t) for t in out_schema.types], schema=out_schema)

    ident = F.col(f"`{id_col}`").cast("long")
    texts = docs.select(ident.alias("doc_id"), F.xxhash64(ident, F.col(f"`{text_col}`")).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return texts.mapInArrow(run, schema)


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, in the order given, by the sum-of-squares rule."""
    n_open = np.zeros(capacity + 1, dtype=np.int64)  # N(g); closed and untouched sequences do not count
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    seq, off, count = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        rest = capacity - size
        # growth of the sum if gap g becomes g - size: 2 (N(g-size) - N(g)) + 2; into none: no first term
        into = n_open[: rest + 1].copy()
        into[0] = 0
        change = 2 * (into - n_open[size:]) + 2
        change[0] -= 1
        change[n_open[size:] == 0] = np.iinfo(np.int64).max
        new = 2 * n_open[rest] + 1 if rest else 0
        best = int(np.argmin(change))
        if change[best] <= new:
            gap, left = best + size, best
            s = waiting[gap].pop()
            n_open[gap] -= 1
        else:
            gap, left, s = capacity, rest, count
            count += 1
        seq[i], off[i] = s, capacity - gap
        if left:
            waiting[left].append(s)
            n_open[left] += 1
    return seq, off


def pack(rows: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to ``rows`` (doc_id, row, piece, length and more)."""
    count = rows.count()
    shards = max(1, -(-count // shard_pieces))

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        table = table.sort_by([("length", "descending"), ("row", "ascending"), ("piece", "ascending")])
        seq, off = place(table.column("length").to_numpy(), capacity)
        table = table.append_column("sequence_id", pa.array(seq + (shard << 32))).append_column("offset", pa.array(off))
        return table.drop_columns(["shard"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row", "piece", F.monotonically_increasing_id()), F.lit(shards)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("shard").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenises and packs whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = materialize(pieces(docs, vocabulary, id_col, text_col, capacity), "pieces")
    return pack(rows, capacity).drop("row")


def sequences(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (binary, little-endian 32-bit)."""
    rows = pack(materialize(pieces(docs, vocabulary, id_col, text_col, capacity, with_ids=True), "pieces"), capacity)
    joined = rows.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    empty = F.lit(b"").cast("binary")
    return joined.select("sequence_id", "n_tokens", F.aggregate("parts", empty, lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))
