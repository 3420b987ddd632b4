"""SentencePiece encoding and decoding.

Where no piece of a model has a white-space marker behind another character, no piece can cross the start
of a marker run. A normalised text then falls into chunks, a run of markers and the word behind it, that are
segmented independently. Each task keeps a table of the distinct chunks that it has met: the library segments each
of them once, and the ids of a text are gathered from the table by its chunks' positions. Words follow a
power law, so most positions fall on few chunks. The table belongs to the task and not to the job: a table of the
whole corpus would have to be shuffled, joined and carried back to the texts, which moves more bytes than the texts have,
to spare about two microseconds a chunk; a lost executor's tasks just run again.

A table beyond TABLE_CHARS code points is given up and begun anew, so the memory of a task has a bound and results
do not depend on it. Where a piece does cross markers, each text is a chunk of its own.

Defined cases: a null text is empty, and an empty one has no ids; null ids decode to an empty text; a very long text
is cut into chunks slice by slice; rows that repeat get equal results; further columns pass through whatever
their names, and those named like a result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from gridlode.llm.columns import Held

MARKER = "▁"
CHUNK = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")
CHUNK_END = re.compile(f"(?<=[^{MARKER}])(?={MARKER})")
#: Code points of a text that are cut into chunks at once, up to the next end of a chunk.
SLICE_CHARS = 1 << 20
#: Code points of all chunks in a task's table, above which it is begun anew, and of texts that are encoded together.
TABLE_CHARS, GROUP_CHARS = 8 << 20, 4 << 20
#: Stands before a chunk while it is segmented, in the place that the library gives a marker of its own.
LEAD = "."


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def crosses_markers(model: SentencePieceProcessor) -> bool:
    """Whether some piece has a marker behind another character."""
    return any(CHUNK_END.search(model.id_to_piece(i)) for i in range(model.vocab_size()))


class ChunkTable(dict):
    """The distinct chunks met so far, numbered, and their ids."""

    def __init__(self, model: SentencePieceProcessor) -> None:
        self.model, self.apart = model, not crosses_markers(model)
        self.lead = len(model.encode(LEAD))
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.new, self.chars = [], 0
        self.ids, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        self.chars += len(chunk)
        return n

    def segment_new(self) -> None:
        """Segment the chunks met since the last call."""
        if not self.new:
            return
        ids = [x[self.lead :] for x in self.model.encode([LEAD + c for c in self.new], num_threads=1)]
        self.new = []
        ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
        self.start = np.concatenate([self.start, self.start[-1] + ends])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.int32, ends[-1])])

    def numbers(self, text: str, limit: int = SLICE_CHARS) -> np.ndarray:
        """The numbers of a text's chunks."""
        text, at, out = self.model.normalize(text), 0, [np.zeros(0, np.int32)]
        while at < len(text):
            end = CHUNK_END.search(text, at + limit) if len(text) - at > limit else None
            stop = end.start() if end else len(text)
            found = CHUNK.findall(text, at, stop)
            out.append(np.fromiter(map(self.__getitem__, found), np.int32, len(found)))
            at = stop
        return np.concatenate(out)

    def gather(self, chunks: np.ndarray) -> np.ndarray:
        """The ids of the chunks of these numbers, one after the other."""
        first, n = self.start[chunks], self.start[chunks + 1] - self.start[chunks]
        ahead = np.cumsum(n) - n
        return self.ids[np.arange(n.sum()) + np.repeat(first - ahead, n)]

    def encode(self, texts: list[str], limit: int = SLICE_CHARS) -> list[np.ndarray]:
        """All ids of each text; what is new in any of them is segmented at once."""
        if not self.apart:
            return [np.array(self.model.encode(t, num_threads=1), np.int32) for t in texts]
        if self.chars > TABLE_CHARS:
            self.clear()
        chunks = [self.numbers(t, limit) for t in texts]
        self.segment_new()
        return [self.gather(c) for c in chunks]


def groups(texts: pa.Array) -> Iterator[list[str]]:
    """The texts, null as empty, in lists of about GROUP_CHARS code points."""
    held, chars = [], 0
    for x in texts:
        held.append(x.as_py() or "")
        chars += len(held[-1])
        if chars > GROUP_CHARS:
            yield held
            held, chars = [], 0
    yield held


def encode(docs: DataFrame, model_path: str | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs with ids, as the library encodes each whole text without begin and end."""
    held, model = Held(docs, text=text_col), broadcast_model(docs.sparkSession, model_path)

    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = ChunkTable(SentencePieceProcessor(model_proto=model.value))
        for texts in batches:
            found = [ids for group in groups(texts) for ids in table.encode(group)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            yield pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int32), *found]))).cast(pa.list_(pa.int32()))

    return held.given(held.rows.select(*held.columns, F.arrow_udf(ids, "array<int>")(held["text"]).alias("ids")), "ids")


def decode(encoded: DataFrame, model_path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """The rows with decoded, the text that the library makes of the ids."""
    held, model = Held(encoded, ids=ids_col), broadcast_model(encoded.sparkSession, model_path)

    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = SentencePieceProcessor(model_proto=model.value)
        for ids in batches:
            yield pa.array([pieces.decode(x.as_py() or []) if x.is_valid else "" for x in ids], pa.string())

    return held.given(held.rows.select(*held.columns, F.arrow_udf(text, "string")(held["ids"]).alias("decoded")), "decoded")


def broadcast_model(spark: SparkSession, path: str | None):
    """The model's file, which is of one size whatever the documents are."""
    return spark.sparkContext.broadcast(Path(path or public_model()).read_bytes())


def op12_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    said = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decode(encode(docs)).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(said).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))
