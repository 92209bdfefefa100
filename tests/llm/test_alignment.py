import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm import alignment
from tallyforge.llm.pretokens import BYTES
from tallyforge.llm.queries import op13_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
OF = {chr(c): b for b, c in BYTES.items()}


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(rows, libraries):
    """rows: doc_id, text; by the libraries on whole texts and dictionaries."""
    a, b = libraries
    found, links = [], Counter()
    for doc, text in rows:
        whole = (" " + (text or "")).encode()
        ta = [(i, bytes(OF[c] for c in a.id_to_token(i))) for i in a.encode(" " + (text or ""), add_special_tokens=False).ids]
        tb = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text or "") for p in [b.id_to_piece(i)]]
        if not text or b"".join(x for _, x in ta) != whole or b"".join(x for _, x in tb) != whole:
            found.append((doc, [], [], []))
            continue
        groups, held, ends = [], [], []
        for side in (ta, tb):
            ends.append(dict(zip(np.cumsum([len(x) for _, x in side]).tolist(), range(len(side)), strict=True)))
        i = j = 0
        for at in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0][at], ends[1][at]
            groups.append(",".join(str(k) for k, _ in ta[i : x + 1]) + "|" + ",".join(str(k) for k, _ in tb[j : y + 1]))
            held.append((ta[x][0], tb[y][0]))
            i, j = x + 1, y + 1
        links.update(held)
        found.append((doc, ta, tb, (groups, held)))
    best = {}
    for (_, y), n in links.items():
        best[y] = max(n, best.get(y, 0))
    out = []
    for doc, ta, tb, made in found:
        if not made:
            out.append((doc, 0, 0, 0, 0, "", 0, 0))
        else:
            groups, held = made
            out.append((doc, len(ta), len(tb), len(groups), len(held), hashlib.sha256(";".join(groups).encode()).hexdigest(), sum(links[p] == best[p[1]] for p in held), sum(links[p] for p in held)))
    return sorted(out, key=str)


def ordered(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()), key=str)


@pytest.fixture(scope="module")
def texts(spark, edge_documents):
    odd = ["a  b   c ", " ", "   ", " lead", "x\n\ty \r\n", "▁ taken", "<s> </s> <unk> <0x41> <|endoftext|>", "naïve 東京 😀 é   ", "a" * 3000, " " * 5000, "don't we'll 12345", "\x00\x01"]
    return edge_documents.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string"), allowMissingColumns=True)


@pytest.mark.parametrize("way", ["mapped", "joined"])
def test_alignment_equals_the_plain_model(spark, texts, libraries, way, monkeypatch):
    if way == "joined":
        monkeypatch.setattr(alignment, "mounted", lambda folder: None)
    assert ordered(alignment.align(texts.repartition(4), A, B)) == plain([(r.doc_id, r.text) for r in texts.collect()], libraries)


def test_query_equals_the_plain_model(spark, sf, libraries):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert ordered(op13_alignment(spark, sf)) == plain([(r.doc_id, r.text) for r in docs.collect()], libraries)


def test_no_documents(no_documents):
    assert alignment.align(no_documents, A, B).collect() == []


def test_documents_without_tokens(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "▁")], "doc_id bigint, text string")
    assert ordered(alignment.align(docs, A, B)) == [(1, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0), (None, 0, 0, 0, 0, "", 0, 0)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\tabé.1▁<>s/'"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_words_encode_as_inside_a_text(text):
    library = alignment.aligner(A, B).b
    assert library.splits and library.encode(text).tolist() == library.library.encode(text)


def test_counts_are_given_away_when_many(spark):
    marked = spark.createDataFrame([(1, alignment.packed(np.array([5, 1, 1]), "<i8"), alignment.packed(np.array([1, 2, 3]), "<i4"))] * 600, "n_links long, pairs binary, counts binary").coalesce(1)
    got = alignment.partial_counts(marked, held=2)
    total = Counter()
    for r in got.collect():
        total[r.pair] += r.n
    assert got.count() > 3 and total == {5: 600, 6: 1200, 7: 1800}


def test_run_lengths_go_over_batches():
    batches = [pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array([1] * len(p), pa.int64())], names=["pair", "n"]) for p in ([1, 1, 2], [2], [], [2, 3, 3], [4])]
    out = [(int(p), int(n)) for pairs, counts in alignment.run_lengths(iter(batches)) for p, n in zip(pairs, counts, strict=True)]
    assert out == [(1, 2), (2, 3), (3, 2), (4, 1)]
