"""Token counts by the digest cache: counts, and what is encoded."""

from __future__ import annotations

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from churnlens.llm import common, token_cache
from churnlens.llm.token_cache import DigestCache, count_tokens

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def plain(rows, count) -> list[tuple]:
    return sorted(((i, len((t or "").encode()), count(t or ""), count(t or "") > 1024) for i, t in rows), key=repr)


def library(path: str):
    if path.endswith(".model"):
        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(pieces.encode(t))
    tokenizer = Tokenizer.from_file(path)
    return lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=repr)


@pytest.fixture
def cache(spark, tmp_path):
    return DigestCache(spark, str(tmp_path / "cache"), BPE)


def n_entries(cache) -> int:
    """Entries as written, repeats included."""
    return cache.spark.read.option("recursiveFileLookup", "true").parquet(cache.path).count()


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]
    assert found(token_cache.op13_token_counts(spark, SF)) == plain(rows, library(BPE))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_awkward_documents(spark, docs, rows, clashing, no_docs, tmp_path, name):
    path = public_tokenizers.path(name)
    cache = DigestCache(spark, str(tmp_path / "cache"), path)
    want = plain([(r[0], r[1]) for r in rows], library(path))
    assert found(count_tokens(no_docs, cache)) == [] and not common.path_exists(spark, cache.path)
    assert found(count_tokens(docs, cache)) == want
    own = clashing.withColumns({c: F.lit("own") for c in ("digest", "row", "n_tokens", "n_bytes", "file", "over_limit")})
    assert found(count_tokens(own, cache)) == want


def test_only_distinct_misses_are_encoded(spark, docs, rows, cache):
    distinct = {r[1] or "" for r in rows}
    first = found(count_tokens(docs, cache))
    assert n_entries(cache) == len(distinct)
    assert found(count_tokens(docs, cache)) == first and n_entries(cache) == len(distinct)  # no miss, nothing appended
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(90, "new text"), (91, "new text"), (92, "one")], "doc_id bigint, text string"))
    assert len(found(count_tokens(more, cache))) == len(rows) + 3
    assert n_entries(cache) == len(distinct) + 1


def test_stored_counts_are_used_and_versions_kept_apart(spark, cache, tmp_path):
    docs = spark.createDataFrame([(1, "known"), (2, "not known")], "doc_id bigint, text string")
    marked = spark.createDataFrame([("known", 4711)], "text string, n_tokens bigint").select(
        F.unhex(F.sha2("text", 256)).alias("digest"), "n_tokens")
    for run in ("a", "b"):  # two runs appended the same digest
        marked.write.parquet(f"{cache.path}/run={run}")
    assert [(r[0], r[2]) for r in found(count_tokens(docs, cache))] == [(1, 4711), (2, library(BPE)("not known"))]
    other = public_tokenizers.path("piece_bpe_32k.model")
    apart = DigestCache(spark, str(tmp_path / "cache"), other)
    assert [r[2] for r in found(count_tokens(docs, apart))] == [library(other)(t) for t in ("known", "not known")]


def test_normalised_content_shares_an_entry(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")  # lower-cases what it reads
    cache = DigestCache(spark, str(tmp_path / "cache"), path)
    docs = spark.createDataFrame([(1, "Some Words"), (2, "some words")], "doc_id bigint, text string")
    got = found(count_tokens(docs, cache, normalise=F.lower))
    assert [r[2] for r in got] == [library(path)(t) for t in ("Some Words", "some words")] and n_entries(cache) == 1


def test_special_strings_count_as_the_library_has_them(spark, cache):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "<|endoftext|>")], "doc_id bigint, text string")
    assert [r[2] for r in found(count_tokens(docs, cache))] == [library(BPE)("a <|endoftext|> b"), 1]
