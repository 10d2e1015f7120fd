"""SentencePiece vocabularies: Viterbi encoding along an Aho-Corasick automaton of the pieces, and decoding."""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.shingles import small_batches
from barloom.llm.text import whole

#: Fixed values of the format: the mark that stands for a space, and the penalty of a character without a piece.
SPACE, UNKNOWN_PENALTY = "▁", 10.0
#: Encoded chunks that a task remembers.
REMEMBERED = 200_000
_CHUNKS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def load_pieces(model_file: str) -> list[tuple[str, float, str]]:
    """piece, score, kind ('piece', 'byte' or 'control') by id, from a model file on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kind = lambda i: "byte" if model.is_byte(i) else "control" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "piece"
    return [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.vocab_size())]


class Codec:
    """Best segmentation by summed scores. A character that is no piece by itself may fall back to its bytes.

    Pieces hold the space mark only in front, so a chunk (marks, then other characters) is encoded alone; that is
    checked when the vocabulary is read. Equal sums: the longer last piece wins.
    """

    def __init__(self, pieces: list[tuple[str, float, str]]):
        if any(SPACE in p.lstrip(SPACE) for p, _, kind in pieces if kind == "piece"):
            raise ValueError("a piece holds the space mark after another character")
        self.bytes = [bytes([int(p[3:-1], 16)]) if kind == "byte" else b"" if kind == "control" else p.encode() for p, _, kind in pieces]
        self.byte_id = {self.bytes[i][0]: i for i, (_, _, kind) in enumerate(pieces) if kind == "byte"}
        self.unknown_id = next((i for i, (p, _, kind) in enumerate(pieces) if kind == "control"), 0)
        usable = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind == "piece"]
        self.unknown = min((s for _, s, _ in usable), default=0.0) - UNKNOWN_PENALTY
        self._automaton(usable)

    def _automaton(self, usable: list[tuple[str, float, int]]) -> None:
        go, ends = [{}], [None]
        for piece, score, i in usable:
            at = 0
            for c in piece:
                if c not in go[at]:
                    go[at][c] = len(go)
                    go.append({})
                    ends.append(None)
                at = go[at][c]
            ends[at] = (len(piece), score, i)
        fail, outs = [0] * len(go), [()] * len(go)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            # own piece, then along the output links to every shorter piece that ends here
            outs[at] = ((ends[at],) if ends[at] else ()) + (outs[fail[at]] if at else ())
            for c, to in go[at].items():
                f = fail[at]
                while f and c not in go[f]:
                    f = fail[f]
                fail[to] = go[f][c] if at and c in go[f] else 0
                queue.append(to)
        self.go, self.fail, self.outs = go, fail, outs

    def best(self, chunk: str) -> list[int]:
        """Ids of the best segmentation, in one pass over the characters."""
        go, fail, outs, unknown = self.go, self.fail, self.outs, self.unknown
        scores, lengths, ids, at = [0.0], [0], [0], 0
        for j, c in enumerate(chunk, 1):
            while at and c not in go[at]:
                at = fail[at]
            at = go[at].get(c, 0)
            top, length, best, single = -math.inf, 1, -1, False
            for n, score, i in outs[at]:
                single = single or n == 1
                now = scores[j - n] + score
                if now > top:
                    top, length, best = now, n, i
            if not single and scores[j - 1] + unknown > top:
                top, length, best = scores[j - 1] + unknown, 1, -1
            scores.append(top)
            lengths.append(length)
            ids.append(best)
        out, j = [], len(chunk)
        while j:
            n = lengths[j]
            if ids[j] < 0:
                raw = chunk[j - 1].encode("utf-8", "replace")
                out.extend([self.byte_id.get(b, self.unknown_id) for b in reversed(raw)] if self.byte_id else [self.unknown_id])
            else:
                out.append(ids[j])
            j -= n
        return out[::-1]

    def chunks(self, text: str) -> list[str]:
        return _CHUNKS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def decode(self, ids) -> str:
        """The text of the ids; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text.removeprefix(" ")


class _Remembered(dict):
    """Packed ids by chunk. When it is full it starts anew: only speed depends on it."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, chunk: str) -> bytes:
        packed = np.array(self.codec.best(chunk), np.int32).tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(chunk) < 100:
            self[chunk] = packed
        return packed


def broadcast_pieces(spark: SparkSession, model_file: str):
    """The vocabulary (tens of thousands of pieces, whatever the corpus) for every executor."""
    return spark.sparkContext.broadcast(load_pieces(model_file))


def encoded(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """Columns of ``docs`` other than the text in ``row``, with n_tokens, ids (array<int>) and exact.

    exact tells whether decoding gives the text again; it is false only where the text holds the space mark itself or
    what UTF-8 cannot say. Null and empty texts have no ids. Every row stays, repeated ones too; no row meets another.
    """
    small_batches(docs.sparkSession)
    pieces = broadcast_pieces(docs.sparkSession, model_file)
    others = [c for c in docs.columns if c != text]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), whole(F.col(f"`{text}`")).alias("t"))
    schema = packed.select("row", F.lit(0).cast("long").alias("n_tokens"), F.array(F.lit(0)).alias("ids"), F.lit(True).alias("exact")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(pieces.value)
        known = _Remembered(codec)
        for batch in batches:
            found, exact = [], []
            for value in batch.column(1).to_pylist():
                ids = b"".join(map(known.__getitem__, codec.chunks(value)))
                found.append(ids)
                exact.append(codec.decode(np.frombuffer(ids, np.int32).tolist()) == value)
            ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(found), np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(exact, pa.bool_())],
                names=["row", "n_tokens", "ids", "exact"],
            )

    return packed.mapInArrow(run, schema)
