"""Operator 6: byte-level BPE encoding and decoding by finite-state machines.

Encoding. A token string is the BPE encoding of its bytes exactly if each
token encodes to itself and each two neighbours encode to just these two. That
is a local condition, so a nondeterministic transducer checks it byte by byte:
a hypothesis is (last token, position in the vocabulary's trie, tokens not yet
emitted). Exactly one hypothesis survives any input. Transducer determinises it
lazily: a state is a set of hypotheses, transitions are built when first taken,
and what all hypotheses of a state have in common is emitted at once, which
bounds the lookahead by the longest token. With `limit` states the table is
full: where a short piece leaves it, the hypotheses are followed one by one to
the piece's end, as they are, and a longer piece rebuilds the table from
nothing. Results never depend on that.

Decoding. Utf8Machine takes bytes of tokens as they come and keeps an
incomplete character until its rest arrives; bytes that are not UTF-8 are
passed on as bytes and shown as U+FFFD in text. What is decoded is what the
machine emits; its moves over whole tokens are remembered.

Null and empty texts have no ids. Repeated rows are encoded each on its own. An empty table gives an empty result; other
columns of the input are ignored; very long texts go in slices of rows.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_text, slices, table
from .pretoken import ChunkEncoder


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_by_rank(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The definition: merge the leftmost pair of least rank until none is left."""
    parts = [data[k : k + 1] for k in range(len(data))]
    while len(parts) > 1:
        best, at = min(((ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1)))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    #: Bytes of a piece that may be followed without the table.
    SHORT = 256

    def __init__(self, ranks: dict[bytes, int], limit: int = 50_000):
        self.ranks, self.limit = ranks, limit
        self.token = {v: k for k, v in ranks.items()}
        self.child: dict[int, int] = {}  # (node << 8 | byte) -> node
        self.ends: dict[int, int] = {}  # node -> token
        nodes = 1
        for data, rank in ranks.items():
            node = 0
            for b in data:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = nodes
                    nodes += 1
                node = self.child[key]
            self.ends[node] = rank
        self.inner = {key >> 8 for key in self.child}
        #: (node << 8 | byte) -> node, or -1 where no token goes on; token that ends there, or -1
        self.arcs = {key: (node if node in self.inner else -1, self.ends.get(node, -1)) for key, node in self.child.items()}
        self.spines: dict[int, tuple[bool, list, list]] = {}
        self.together: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.names: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, tuple]]] = []
        self.last: list[tuple | None] = []
        self.together.clear()
        self.steps: dict[tuple, tuple] = {}
        self._state(((-1, 0, ()),))

    def _state(self, hypotheses: tuple) -> int:
        if hypotheses not in self.names:
            self.names[hypotheses] = len(self.states)
            self.states.append(hypotheses)
            self.moves.append({})
            self.last.append(next((rest for _, node, rest in hypotheses if node == 0), None))
        return self.names[hypotheses]

    def _spines(self, token: int) -> tuple[bool, list, list]:
        """Whether the token encodes to itself, and its first and its last parts while it is merged, each with the rank of the merge that ends it."""
        parts = [self.token[token][k : k + 1] for k in range(len(self.token[token]))]
        left, right, never = [], [], 1 << 60
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[k] + parts[k + 1], never), k) for k in range(len(parts) - 1))
            if rank == never:
                break
            if at == 0:
                left.append((parts[0], rank))
            if at == len(parts) - 2:
                right.append((parts[-1], rank))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return len(parts) == 1, [*left, (parts[0], never)], [*right, (parts[-1], never)]

    def _fits(self, before: int, token: int) -> bool:
        """Whether the two tokens' bytes encode to the two tokens: no merge across their border comes before the merges beside it."""
        for t in (before, token):
            if t >= 0 and t not in self.spines:
                self.spines[t] = self._spines(t)
        own, left, _ = self.spines[token]
        if not own or before < 0:
            return own
        both = self.together.get(before << 32 | token)
        if both is None:
            rank = self.ranks.get
            both = self.together[before << 32 | token] = not any((r := rank(a + b)) is not None and r < ra and r <= rb for a, ra in self.spines[before][2] for b, rb in left)
        return both

    def _step(self, before: int, node: int, b: int) -> tuple:
        """Where one hypothesis leads: (last token, node, token completed or -1), at most twice. Shared by all states that hold it."""
        child, out = self.child.get(node << 8 | b), ()
        if child is not None:
            if child in self.inner:
                out = ((before, child, -1),)
            token = self.ends.get(child)
            if token is not None and self._fits(before, token):
                out += ((token, 0, token),)
        self.steps[before, node, b] = out
        return out

    def _move(self, state: int, b: int) -> tuple[int, tuple]:
        after, steps = [], self.steps
        for before, node, rest in self.states[state]:
            step = steps.get((before, node, b))
            if step is None:
                step = self._step(before, node, b)
            for t, n, done in step:
                after.append((t, n, rest if done < 0 else (*rest, done)))
        first = after[0][2]
        common = len(first)
        for h in after:
            if common and h[2][:common] != first[:common]:
                common = next(k for k in range(common) if h[2][k : k + 1] != first[k : k + 1])
        move = self._state(tuple([(t, n, r[common:]) for t, n, r in after]) if common else tuple(after)), first[:common]
        self.moves[state][b] = move
        return move

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        full = len(self.states) > self.limit
        if full and len(piece) > self.SHORT:
            self._reset()
            full = False
        out: list[int] = []
        state, moves = 0, self.moves
        for k, b in enumerate(piece):
            move = moves[state].get(b)
            if move is None:
                if full:
                    return out + self._follow(state, piece[k:])
                move = self._move(state, b)
            state = move[0]
            if move[1]:
                out.extend(move[1])
        out.extend(self.last[state])
        return out

    def _follow(self, state: int, data: bytes) -> list[int]:
        """What the hypotheses of a state emit on the bytes, without new states."""
        begun = self.states[state]
        last, back = [h[0] for h in begun], [-1] * len(begun)  # of each place where a token may start: the token before, and that one's place
        live = [(h[1], place) for place, h in enumerate(begun)]
        arcs, together, fits = self.arcs.get, self.together.get, self._fits
        for b in data:
            after, ended = [], -1
            for node, place in live:
                arc = arcs(node << 8 | b)
                if arc is not None:
                    if arc[0] >= 0:
                        after.append((arc[0], place))
                    token = arc[1]
                    if ended < 0 <= token:
                        before = last[place]
                        both = together(before << 32 | token) if before >= 0 else None
                        if fits(before, token) if both is None else both:
                            ended = place
                            last.append(token)
                            back.append(place)
            after.append((0, len(last) - 1))
            live = after
        place, out = len(last) - 1, []
        while back[place] >= 0:
            out.append(last[place])
            place = back[place]
        return [*begun[place][2], *reversed(out)]


#: Classes of a byte for the UTF-8 machine, and the state after a lead byte: bytes to come, with the bounds of the next one.
def _lead(b: int) -> tuple[int, int, int] | None:
    if b < 0x80:
        return 0, 0x80, 0xBF
    if 0xC2 <= b <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= b <= 0xEF:
        return 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
    if 0xF0 <= b <= 0xF4:
        return 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
    return None


class Utf8Machine:
    """feed() gives the text that is complete so far, finish() what is left; malformed parts show as U+FFFD each."""

    START = (0, 0x80, 0xBF)

    def __init__(self):
        self.state, self.kept = self.START, b""

    @classmethod
    def run(cls, state: tuple[int, int, int], kept: bytes, data: bytes) -> tuple[tuple[int, int, int], bytes, bytes, bool]:
        """State and incomplete character after the bytes, the bytes passed on meanwhile, and whether all fitted."""
        out, good = [], True
        for b in data:
            if state[0] and not state[1] <= b <= state[2]:
                out.append(kept)
                state, kept, good = cls.START, b"", False
            if state[0]:
                state, kept = (state[0] - 1, 0x80, 0xBF), kept + bytes([b])
            elif (lead := _lead(b)) is None:
                out.append(bytes([b]))
                good = False
                continue
            else:
                state, kept = lead, bytes([b])
            if not state[0]:
                out.append(kept)
                kept = b""
        return state, kept, b"".join(out), good

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.state[0] and not self.state[1] <= b <= self.state[2]:
                out.append("�")
                self.state, self.kept = self.START, b""
            if self.state[0]:
                self.state, self.kept = (self.state[0] - 1, 0x80, 0xBF), self.kept + bytes([b])
            elif (lead := _lead(b)) is None:
                out.append("�")
                continue
            else:
                self.state, self.kept = lead, bytes([b])
            if not self.state[0]:
                out.append(self.kept.decode())
                self.kept = b""
        return "".join(out)

    def finish(self) -> str:
        rest = "�" * bool(self.state[0])
        self.state, self.kept = self.START, b""
        return rest


class StreamDecoder:
    """Bytes and text of ids. The UTF-8 machine's moves over whole tokens are remembered; tokens that take it from start to start need no look at the state."""

    #: Moves from within a character that are remembered.
    MOST = 1_000_000

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.whole: list[bytes | None] = [None] * (max(tokens) + 1)
        for t, data in tokens.items():
            state, kept, out, good = Utf8Machine.run(Utf8Machine.START, b"", data)
            if good and not kept:
                self.whole[t] = out
        self.moves: dict[tuple, tuple] = {}

    def __call__(self, ids: np.ndarray) -> tuple[bytes, bool]:
        """What the machine emits, and whether it is UTF-8."""
        listed, whole = ids.tolist(), self.whole
        try:
            return b"".join(map(whole.__getitem__, listed)), True
        except TypeError:  # some token begins or ends within a character
            pass
        if len(self.moves) > self.MOST:
            self.moves.clear()
        out, good, state, kept, moves = [], True, Utf8Machine.START, b"", self.moves
        for t in listed:
            if not kept and (emitted := whole[t]) is not None:
                out.append(emitted)
                continue
            move = moves.get((kept, t))
            if move is None:
                move = moves[kept, t] = Utf8Machine.run(state, kept, self.tokens[t])
            state, kept, emitted, fitted = move
            out.append(emitted)
            good = good and fitted
        out.append(kept)
        return b"".join(out), good and not kept

    def text(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as the ids come."""
        machine = Utf8Machine()
        for t in ids:
            yield machine.feed(self.tokens[t])
        yield machine.finish()


_ENCODERS: dict[str, ChunkEncoder] = {}
_DECODERS: dict[str, StreamDecoder] = {}
#: Pieces whose ids a worker remembers, beside chunks of up to as many.
REMEMBERED = 300_000


def encoder(path: str, pattern: str) -> ChunkEncoder:
    """The encoder of a rank file, kept by a worker from task to task."""
    if path not in _ENCODERS:
        import regex

        pieces, machine = regex.compile(pattern).findall, Transducer(read_ranks(path))
        memo: dict[str, bytes] = {}

        def of(piece: str) -> bytes:
            got = memo.get(piece)
            if got is None:
                got = array("I", machine.encode(piece.encode("utf-8", "surrogatepass"))).tobytes()
                if len(piece) <= 48:
                    memo[piece] = got
            return got

        def many(chunks: list[str]) -> list[bytes]:
            if len(memo) > REMEMBERED:
                memo.clear()
            return [b"".join(map(of, pieces(x))) for x in chunks]

        _ENCODERS[path] = ChunkEncoder(many, REMEMBERED)
    return _ENCODERS[path]


def decoder(path: str) -> StreamDecoder:
    if path not in _DECODERS:
        _DECODERS[path] = StreamDecoder({v: k for k, v in read_ranks(path).items()})
    return _DECODERS[path]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids: binary, little-endian unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = encoder(path, pattern)
        for batch in slices(batches, "text"):
            yield pa.record_batch([batch.column("doc_id"), pa.array(chunks(batch.column("text").to_pylist()), pa.binary())], names=["doc_id", "ids"])

    return doc_text(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> the same, with n_tokens, decoded (bytes) and well_formed (whether these are UTF-8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = decoder(path)
        for batch in slices(batches, "ids"):
            ids = [np.frombuffer(x, "<u4") for x in batch.column("ids").to_pylist()]
            data, good = zip(*map(decoded, ids), strict=True)
            yield pa.record_batch([batch.column("doc_id"), batch.column("ids"), pa.array([len(x) for x in ids], pa.int64()), pa.array(data, pa.binary()), pa.array(good, pa.bool_())], names=["doc_id", "ids", "n_tokens", "decoded", "well_formed"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded binary, well_formed boolean")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """encode() and decode() in one worker: (doc_id, text) -> n_tokens and the SHA-256 of the ids and of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, decoded = encoder(path, pattern), decoder(path)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for batch in slices(batches, "text"):
            rows = []
            for ids in chunks(batch.column("text").to_pylist()):
                numbers = np.frombuffer(ids, "<u4")
                rows.append((len(numbers), digest(ids), digest(decoded(numbers)[0])))
            n, a, b = zip(*rows, strict=True)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return doc_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return round_trip(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
