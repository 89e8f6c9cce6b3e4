"""Operator 4: bounded-space online packing of token sequences.

Each partition keeps at most `windows` open windows of `size` tokens. What a
document holds beyond full windows goes to the open window with the least
sufficient room (best fit); where none has room, the fullest is topped up with
the head of the piece and emitted, and the remainder is placed anew. At the end
of a partition its open windows are merged end to end into full sequences, and
the last remainder is cut into sequences whose lengths are powers of two, so
nothing is padded. State is bounded by windows x size ids a partition, nothing
is shuffled, and a partition that is run again gives the same sequences.

Strings of the tokenizer's special tokens in a text get these tokens' ids, as in
the library's plain call. Null and empty texts give one piece: the closing id
alone. Rows with a null doc_id and repeated rows are packed each on its own. An empty table gives an empty result. Other columns of
the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_text, slices, table
from .pretoken import ChunkEncoder

SIZE, WINDOWS, CLOSING_ID = 1024, 64, 0
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ENCODERS: dict[str, ChunkEncoder] = {}
# Fixed value: how byte-level tokenizers of this kind split a text.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that are letters, numbers or neither in every version of Unicode.
_OLD = re.compile(r"[!-~\xa1-\u024f]+")


def ranks(tokenizer) -> dict[bytes, int] | None:
    """The tokenizer's vocabulary as ranks of byte strings, if it is plain byte-level BPE whose merges come in the order of their results' ids."""
    data = json.loads(tokenizer.to_str())
    model, split = data["model"], data["pre_tokenizer"] or {}
    if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or data["normalizer"]:
        return None
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    vocab = model["vocab"]
    merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    known = {bytes([byte[c] for c in token]): k for token, k in vocab.items() if all(c in byte for c in token)}
    results = set(merged)
    known = {token: k for token, k in known.items() if len(token) == 1 or k in results}
    return known if merged == sorted(results) else None


def json_encoder(path: str) -> ChunkEncoder:
    """The encoder of a tokenizer file, kept by a worker from task to task.

    The library encodes what it must; words of old characters go through a faster encoder of the same vocabulary, where there is one.
    """
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = tokenizer.get_added_tokens_decoder()
        if any(x.lstrip or x.rstrip or x.single_word for x in added.values()):
            raise ValueError("tokens that take in what is beside them are not supported")

        def many(chunks: list[str]) -> list[bytes]:
            return [np.array(e.ids, "<u4").tobytes() for k in range(0, len(chunks), 4096) for e in tokenizer.encode_batch_fast(chunks[k : k + 4096], add_special_tokens=False)]

        known = ranks(tokenizer)
        fast = known and tiktoken.Encoding(path, pat_str=PIECES, mergeable_ranks=known, special_tokens={})

        def words(lead: str, some: list[str]) -> list[bytes]:
            old = [bool(_OLD.fullmatch(x)) for x in some] if fast else [False] * len(some)
            others = iter(many([lead + x for x, flag in zip(some, old, strict=True) if not flag]))
            plain = iter(_lines(fast, [lead + x for x, flag in zip(some, old, strict=True) if flag]) if fast else ())
            return [next(plain if flag else others) for flag in old]

        _ENCODERS[path] = ChunkEncoder(many, encode_words=words, special={x.content: int(k).to_bytes(4, "little") for k, x in added.items()})
    return _ENCODERS[path]


def _lines(fast, words: list[str]) -> list[bytes]:
    """Words as lines of one text, which is faster than one by one: a newline between words is always a piece of its own, and these hold none."""
    newline, out = fast.encode_ordinary("\n")[0], []
    for k in range(0, len(words), 1024):
        ids = np.array(fast.encode_ordinary("\n".join(words[k : k + 1024])), "<u4")
        ends = np.r_[np.flatnonzero(ids == newline), len(ids)]
        data, starts = ids.tobytes(), np.r_[0, ends[:-1] + 1]
        out += [data[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    return out


class Packer:
    """Emits (key, start, ids, tokens of the document, sequence, offset) in `out`; ids are bytes, four a token."""

    def __init__(self, size: int = SIZE, windows: int = WINDOWS):
        self.size, self.windows = size, windows
        self.fill: list[int] = []
        self.held: list[list[tuple]] = []  # pieces of each open window: (key, start, ids, tokens)
        self.out: list[tuple] = []
        self.sequences = 0

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            self.out.append((key, start, ids, total, self.sequences, offset))
            offset += len(ids) // 4
        self.sequences += 1

    def add(self, key, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.size:
            self._emit([(key, at, ids[4 * at : 4 * (at + self.size)], total)])
            at += self.size
        while at < total:
            need = total - at
            fitting = [f for f in self.fill if f + need <= self.size]
            if fitting:
                k = self.fill.index(max(fitting))
            elif len(self.fill) < self.windows:
                k = len(self.fill)
                self.fill.append(0)
                self.held.append([])
            else:
                k = self.fill.index(max(self.fill))
            take = min(need, self.size - self.fill[k])
            self.held[k].append((key, at, ids[4 * at : 4 * (at + take)], total))
            self.fill[k] += take
            at += take
            if self.fill[k] == self.size:
                self._emit(self.held.pop(k))
                self.fill.pop(k)

    def finish(self) -> None:
        """Merge the open windows, the fullest first."""
        order = sorted(range(len(self.fill)), key=lambda k: -self.fill[k])
        pieces = [p for k in order for p in self.held[k]]
        rest, room, now = sum(self.fill), 0, []
        self.fill, self.held = [], []
        for key, start, ids, total in pieces:
            at, n = 0, len(ids) // 4
            while at < n:
                if not room:
                    room = self.size if rest >= self.size else 1 << (rest.bit_length() - 1)
                take = min(room, n - at)
                now.append((key, start + at, ids[4 * at : 4 * (at + take)], total))
                at, room, rest = at + take, room - take, rest - take
                if not room:
                    self._emit(now)
                    now = []


def pack(docs: DataFrame, tokenizer_json: str, size: int = SIZE, windows: int = WINDOWS, closing_id: int = CLOSING_ID) -> DataFrame:
    """docs(doc_id, text) -> a row for each piece: its ids (little-endian unsigned 32-bit), and where it lies in which sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, closing = json_encoder(tokenizer_json), Packer(size, windows), int(closing_id).to_bytes(4, "little")
        first = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            key, start, ids, total, seq, offset = zip(*rows, strict=True)
            length = [len(x) // 4 for x in ids]
            return pa.record_batch([pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array([first + s for s in seq], pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in slices(batches, "text"):
            for key, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                packer.add(key, ids + closing)
            if packer.out:
                yield flush()
        packer.finish()
        if packer.out:
            yield flush()

    return doc_text(docs).mapInArrow(run, SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
