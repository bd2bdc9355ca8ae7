"""Byte-level BPE by the tiktoken library: ids of whole texts from a local rank file, and raw bytes of ids."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts above this many characters are cut at safe borders into parts of about so many.
PART = 1 << 16
#: Runs of white space from this length on are coded as one piece; the library's pattern runs out of stack within some 100,000.
LONG_SPACE = 1 << 12
#: Bytes of text (or ids) that leave a task at once.
BATCH_BYTES = 4 << 20

#: Characters with the Unicode property White_Space, which the pattern means by \s (fixed values).
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SIGN = r"[!-/:-@\[-`{-~]"
#: Where a match of the pattern always ends, whatever follows: before white space after another character, and after an ASCII letter
#: or digit where another kind of ASCII character follows. White space looks ahead only, and no match spans these borders.
_BORDER = re.compile(rf"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=[A-Za-z])(?=[0-9]|{_SIGN})|(?<=[0-9])(?=[A-Za-z]|{_SIGN})")
#: A long run of white space up to its last character where other text follows (which starts a match of its own), or up to the end.
_SPACES = re.compile(rf"[{WHITE}]{{{LONG_SPACE},}}(?=[{WHITE}][^{WHITE}])|[{WHITE}]{{{LONG_SPACE},}}\Z")


def safe_parts(text: str, size: int = PART) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut only where each match of the pattern ends."""
    at = 0
    while len(text) - at > size:
        border = _BORDER.search(text, at + size)
        if border is None:
            break
        yield text[at : border.start()]
        at = border.start()
    yield text[at:]


class Codec:
    """Ids of texts and bytes of ids by a rank file; one for each file in a worker process."""

    _loaded: dict[tuple[str, str], Codec] = {}

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.known = known
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})

    @classmethod
    def at(cls, ranks: str, pattern: str) -> Codec:
        if (ranks, pattern) not in cls._loaded:
            cls._loaded[ranks, pattern] = cls(ranks, pattern)
        return cls._loaded[ranks, pattern]

    @cached_property
    def piece(self):
        """Takes each text for one match."""
        import tiktoken

        return tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=self.known, special_tokens={})

    def _plain(self, text: str) -> list[bytes]:
        return [self.library.encode_to_numpy(part, disallowed_special=()).tobytes() for part in safe_parts(text) if part]

    def encode(self, text: str | None) -> bytes:
        """Ids as unsigned 32-bit integers: those of ``encode_ordinary`` over the whole text; none for null."""
        if not text:
            return b""
        if len(text) < LONG_SPACE:
            return self.library.encode_to_numpy(text, disallowed_special=()).tobytes()
        out, at = [], 0
        for run in _SPACES.finditer(text):
            out += self._plain(text[at : run.start()])
            out.append(self.piece.encode_to_numpy(run[0], disallowed_special=()).tobytes())
            at = run.end()
        return b"".join(out + self._plain(text[at:]))

    def decode(self, ids: list[int]) -> bytes:
        """The raw bytes of ids, which need not be UTF-8."""
        return self.library.decode_bytes(ids)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, int(batch.num_rows * BATCH_BYTES / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def encode_texts(docs: DataFrame, ranks: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, ids array<int>)`` for every row of ``docs``, null texts being empty.

    ``ranks`` is a file of base64 tokens with their ranks. Each match of ``pattern`` is coded separately, special tokens don't exist, and
    long texts are cut at borders where matches always end, so ids equal those of the whole text. Borders are proven for
    ``public_tokenizers.PATTERN``. Rows stand alone: no shuffle, repeated rows and null ids each get their result, other columns aren't
    carried, an empty table gives no rows. A task holds a batch of texts; a lost executor's tasks run again.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(ranks, pattern)
        for batch in batches:
            for some in _slices(batch):
                coded = [codec.encode(t.as_py()) for t in some.column(1)]
                ids = pa.Array.from_buffers(pa.int32(), sum(map(len, coded)) // 4, [None, pa.py_buffer(b"".join(coded))])
                ends = [0]
                for c in coded:
                    ends.append(ends[-1] + len(c) // 4)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_ids(coded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, raw binary)``: the bytes that ``ids`` stand for. Null ids are none; an id that the file doesn't know is an error."""
    kind = coded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(ranks, pattern)
        for batch in batches:
            for some in _slices(batch):
                raw = [codec.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []) for x in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(raw, pa.binary())], ["doc_id", "ids", "raw"])

    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, raw binary")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, pattern)
    told = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return decode_ids(coded, ranks, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), told.alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256")
    )
