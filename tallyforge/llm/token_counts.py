"""Operator 9: token counts by a map-side two-tier lookup.

Tier one is a compact table of the lengths of the corpus's frequent pre-tokens, broadcast: the FREQUENT
most frequent ones of about SAMPLE documents, chosen by a hash of id and length. It decides only what is looked up where, not what is
counted. Tier two encodes what misses with the library and keeps it in a cache of bounded size in each worker. No pre-token of the
corpus is shuffled, but the counts of the sample's.

Null texts are empty texts, and an empty text has 0 tokens. Repeated rows give a row each. Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import slices, texts
from tallyforge.llm.pretokens import CACHED_LENGTH, PreTokenEncoder, encoder

LIMIT = 512
#: Entries of the table, at most of CACHED_LENGTH characters each; documents that it is made from.
FREQUENT, SAMPLE = 1 << 16, 4096
_workers: dict[str, PreTokenEncoder] = {}


@functools.cache
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def frequent_lengths(docs: DataFrame, path: str, most: int = FREQUENT, sample: int = SAMPLE) -> dict[str, int]:
    """The numbers of ids of the most frequent pre-tokens in about `sample` documents."""
    made = PreTokenEncoder(path, len)
    if not made.splits:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                total: Counter[str] = Counter()
                for text in texts(batch):
                    total.update(t for t in encoder(path, "length").pre_tokens(text) if len(t) <= CACHED_LENGTH)
                yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["piece", "n"])

    one_of = max(1, docs.count() // sample)
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.lit(9)), F.lit(one_of)) == 0).select("text")
    top = some.mapInArrow(count, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(most)
    found = [r.piece for r in top.select("piece").collect() if r.piece not in made.special]
    return {t: made.value(t) for t in found}


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs. path: a .json (tokenizers) or .model (sentencepiece) file that every executor has."""
    frequent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, frequent_lengths(docs, path) if path.endswith(".json") else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path.endswith(".json"):
            name, known = frequent.value
            if name not in _workers:
                _workers.clear()
                _workers[name] = PreTokenEncoder(path, len, known)
            values = _workers[name].values
            count = lambda text: sum(values(text))
        else:
            count = lambda text: len(_pieces(path).encode(text, num_threads=1)) if text else 0
        for whole in batches:
            for batch in slices(whole):
                given = texts(batch)
                n = [count(t) for t in given]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    return given.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
