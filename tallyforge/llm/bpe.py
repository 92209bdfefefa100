"""Operator 3: byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut where no match of the splitting pattern can span: between a letter or digit of any script and a following blank, tab or
line break, or between a letter of a common script and a punctuation mark. Matches are runs of one kind that hold white space at their start only,
and what a match takes before such a place doesn't depend on what follows it, so the parts give the ids of the whole.
A long run of white space is one match, but for its last character if anything follows; it is encoded as one piece, past the pattern,
as the library's matcher would exceed its stack.

Null texts are empty texts, and an empty text has no ids. Repeated rows and ties give a row each. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import slices, texts

#: Characters of a part of a long text, and of a run of white space that is encoded past the pattern.
PART, LONG_RUN = 1 << 16, 1 << 12
SAFE = regex.compile(r"[\p{L}\p{N}](?=[ \t\r\n])|[A-Za-zА-яぁ-ゖァ-ヺ一-龥가-힣](?=[.,;:!?()、。，！？])")
SPACE = r"[\t-\r \x85\xA0  -     　]"
#: From where a run begins only: tried at each of its characters, shorter runs would cost the square of their length.
_runs = regex.compile("(?<!" + SPACE + ")" + SPACE + "{%d,}" % LONG_RUN)


@functools.cache
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of about `size` characters, cut at safe places; a stretch without any stays whole."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size - 1)
        if not cut:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= LONG_RUN:
        return enc.encode_ordinary(text)
    ids, at = [], 0
    for run in _runs.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        for part in parts(text[at : run.start()]):
            ids += enc.encode_ordinary(part)
        ids += enc._encode_single_piece(text[run.start() : end])
        at = end
    for part in parts(text[at:]):
        ids += enc.encode_ordinary(part)
    return ids


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids array<int>: the encoded texts. path: a rank file that every executor has at that place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for whole in batches:
            for batch in slices(whole, 64):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([encode(enc, t) for t in texts(batch)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes of each text; the ids and decoded bytes stay in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        decimal = [str(i) for i in range(enc.max_token_value + 1)]
        for whole in batches:
            for batch in slices(whole, 64):
                n, shas, decoded, lengths = [], [], [], []
                for text in texts(batch):
                    ids = encode(enc, text)
                    back = enc.decode_bytes(ids)
                    n.append(len(ids))
                    shas.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(back).hexdigest())
                    lengths.append(len(back))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string()), pa.array(lengths, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint")
