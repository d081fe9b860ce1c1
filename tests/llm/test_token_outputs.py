"""Operators 1 and 3 against the tokenizer itself."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from churnlens.llm import common, packing, token_files
from churnlens.llm.tokens import Encoder, default_tokenizer

PATH = default_tokenizer()


@pytest.fixture(scope="module")
def direct():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_cut_texts_have_the_ids_of_whole_texts(direct):
    encoder, rng = Encoder(PATH, cache_entries=50), random.Random(5)
    parts = [" ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "a", "don't", "'s", " 's", "12", "été",
             "\U0001f600", "!?", "<|endoftext|>", "你好", ".", "word"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == direct(text), repr(text)


def test_texts_of_an_array_have_the_ids_of_whole_texts(direct):
    # many runs, and texts too long to be cut
    encoder, rng = Encoder(PATH, cache_entries=50, run_bytes=300), random.Random(6)
    parts = [" ", " ", "\n", "\n", "  ", "\t", "\r\n", "\x00", "\u00a0", "\u2003", "\x1c", "\x85", "a", "don't", "'s", " 's", "12", "\u00e9t\u00e9",
             "\U0001f600", "!?", "<|endoftext|>", "\u4f60\u597d", ".", "word", "word,", " end.\nWord"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    texts += [None, "", "long " * 100, "\n", " ", "\n\n", "x\n\n\ny", "x \n y"]
    want = [direct(t) for t in texts]
    for array in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["x", *texts]).slice(1)):
        ids, n = (np.concatenate(x) for x in zip(*encoder.encode_all(array), strict=True))
        assert n.tolist() == encoder.counts(array).tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]
    encoder.cuts = False  # as for other tokenizers
    assert np.concatenate([ids for ids, _ in encoder.encode_all(pa.array(texts))]).tolist() == [i for w in want for i in w]
    assert not list(encoder.encode_all(pa.array([], pa.string()))) and len(encoder.counts(pa.array([], pa.string()))) == 0


def test_each_different_chunk_of_an_array_is_looked_up_once(direct):
    encoder, looked = Encoder(PATH), []

    class Counted(dict):
        lead = ""

        def __getitem__(self, chunk):
            looked.append(self.lead + chunk)
            return np.array(direct(looked[-1]), "<u4").tobytes()

    encoder.first, encoder.rest = Counted(), Counted()
    encoder.rest.lead = " "
    texts = [f"one two one\ntwo {i % 3}" for i in range(300)]
    (ids, n), = encoder.encode_all(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in direct(t)] and len(n) == 300
    assert sorted(looked) == sorted({"one", " two", " one", "\n", "two", " 0", " 1", " 2"})


def test_files_hold_every_id_in_order(spark, docs, rows, direct):
    folder = common.shared_folder(spark, "t")
    manifest = token_files.write_sequences(docs, folder, length=64, rows_per_batch=4)
    got = token_files.read_documents(manifest, folder).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for r in order:
        ids = direct(r[1]) + [2]
        want.append((r[0], start, len(ids), crc(ids)))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted(map(tuple, got), key=key) == want


def test_sequences_are_read_without_a_copy(spark, docs, rows, direct):
    folder = common.shared_folder(spark, "t")
    parts = token_files.write_sequences(docs, folder, length=64, rows_per_batch=4).orderBy("part").collect()
    stream = [i for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for i in direct(r[1]) + [2]]
    at = 0
    for part in parts:
        file = token_files.SequenceFile(part.sequences)
        ids, left = [], part.n_tokens
        for i in range(part.n_sequences):
            one, mask = file[i]
            assert len(one) == len(mask) == 64 and not one.flags.owndata
            assert mask.to_pylist() == [k < left for k in range(64)]
            left -= 64
        for i in (0, part.n_sequences // 2):
            ids = file[i][0][:part.n_tokens - 64 * i].tolist()
            assert ids == stream[at + 64 * i:at + 64 * i + len(ids)]
        at += part.n_tokens
    assert at == len(stream)


def packed_ok(got, rows, direct, capacity):
    texts = {}
    for r in rows:
        texts.setdefault(r[0], direct(r[1]) + [0])
    copies = {r[0]: sum(x[0] == r[0] for x in rows) for r in rows}
    by_bin, by_doc = {}, {}
    for r in got:
        ids = texts[r.doc_id][r.start:r.start + r.length]
        assert len(ids) == r.length <= capacity and r.ids_crc32 == crc(ids)
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, ids in texts.items():
        want = [(i, s, n) for i, (s, n) in enumerate(packing.cut(len(ids), capacity))]
        assert sorted(by_doc[doc]) == sorted(want * copies[doc])
        assert all(n == capacity for _, _, n in want[1:])
    return len(by_bin), -(-sum(len(texts[d]) * c for d, c in copies.items()) // capacity)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pieces_fill_sequences(docs, rows, direct, capacity):
    got = packing.digest(packing.pack_documents(docs, capacity=capacity)).collect()
    packed_ok(got, rows, direct, capacity)


def test_packing_is_close_to_the_bound(spark):
    from collections import namedtuple
    row = namedtuple("row", "doc_id start length ids_crc32 sequence_id offset piece")
    assert row
    texts = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    got = packing.digest(packing.pack_documents(df)).collect()
    bound = -(-sum(r.length for r in got) // 2048)
    assert len({r.sequence_id for r in got}) <= 1.01 * bound + 1


def test_fullest_bin_closes_first():
    bins = packing.BestFit(10, open_bins=2)
    assert [bins.place(n) for n in (6, 7, 3, 8)] == [(0, 0), (1, 0), (1, 7), (2, 0)]
    assert bins.place(9) == (3, 0)  # two are open (free 4 and 2): the one with 2 closes
    assert bins.place(2) == (0, 6) and bins.place(1) == (3, 9)
    assert bins.place(2) == (0, 8)


def test_empty_and_clashing(spark, no_docs, clashing, docs):
    folder = common.shared_folder(spark, "t")
    assert token_files.read_documents(token_files.write_sequences(no_docs, folder), folder).count() == 0
    assert packing.pack_documents(no_docs).count() == 0
    assert packing.pack_documents(clashing).count() == packing.pack_documents(docs).count()
    folder = common.shared_folder(spark, "t")
    assert token_files.read_documents(token_files.write_sequences(clashing, folder), folder).count() == docs.count()


def test_a_second_attempt_replaces_the_files_of_the_first(spark, docs, tmp_path):
    folder = str(tmp_path / "twice")
    rows = [sorted(map(tuple, token_files.read_documents(token_files.write_sequences(docs, folder), folder).collect()), key=repr)
            for _ in range(2)]
    assert rows[0] == rows[1] and not list((tmp_path / "twice").glob("*.arrows.*"))
