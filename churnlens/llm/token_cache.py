"""Token counts by a digest cache (operator 13).

The cache holds token counts under (digest of the content, digest of the tokenizer). A run reduces
all documents to narrow rows of digests, takes the distinct digests that the cache lacks, encodes one
document of each, appends those counts, and reads every document's count from the cache. Texts cross
one exchange at most, and only when there are many misses: a document that was counted before, by any run with the
same tokenizer, is not encoded, and of copies one is.

The cache is a folder: ``version=<tokenizer digest>/run=<id>`` holds what one run added, so runs at the same
time do not disturb each other. A run that is killed leaves whole files or none that are read; a digest
that two runs appended is read once. Another tokenizer file, library or library version is another version.

Rows: null text counts as empty (no tokens, and it is a digest like any other); repeated rows are returned each and encoded
once; a null doc_id is kept; texts of any length are encoded whole; an empty table gives no rows and appends
nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib.metadata import version as installed

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import common
from churnlens.llm.tokens import default_tokenizer, encoder

ENTRY = "digest binary, n_tokens bigint"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file and of the library that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {installed(library)}\n".encode() + f.read()).hexdigest()


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[pa.Array], np.ndarray]:
    """Tokens of whole texts, without added special tokens, truncation or padding; one per Python worker."""
    if path.endswith(".model"):
        import sentencepiece
        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: np.array([len(pieces.encode(t.as_py(), num_threads=1)) for t in texts], np.int64)
    own = encoder(path)
    own.tokenizer.no_truncation()
    own.tokenizer.no_padding()
    return own.counts


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            n = count(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])
    return run


class DigestCache:
    """Stored token counts of one tokenizer version in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, tokenizer: str):
        self.spark, self.tokenizer = spark, tokenizer
        self.path = f"{folder.rstrip('/')}/version={tokenizer_version(tokenizer)}"

    def read(self) -> DataFrame:
        """digest, n_tokens: one row per digest."""
        if not common.path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], ENTRY)
        held = self.spark.read.schema(ENTRY).option("recursiveFileLookup", "true").parquet(self.path)
        return held.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, missing: DataFrame) -> None:
        """Encode the texts of ``missing`` (digest, text; distinct digests) and keep their counts."""
        missing.select("digest", "text").mapInArrow(_encode(self.tokenizer), ENTRY).write.parquet(
            common.shared_name(f"{self.path}/run="))


def count_tokens(docs: DataFrame, cache: DigestCache, limit: int = 1024,
                 normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document, by way of the cache.

    ``normalise`` maps a text to what the digest is taken of, for tokenizers that ignore some
    differences (case, say); it must not change a count. Without it texts are digested as they are.
    """
    text = common.whole_text()
    content = normalise(text) if normalise else text
    keyed = common.row_keyed(docs.select("doc_id", "text"), "token-rows", "row")
    digests = common.stored(keyed.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.unhex(F.sha2(content, 256)).alias("digest"), "row"), "token-digests")
    wanted = digests.groupBy("digest").agg(F.min("row").alias("row")).join(cache.read(), "digest", "left_anti")
    wanted = common.stored(wanted, "token-misses")
    if not wanted.isEmpty():
        # row keys are unique on both sides: no key of this join is hot, and each text is one row
        cache.append(wanted.join(keyed.select("row", text.alias("text")), "row"))
    # written before the join, so that the join can split the rows of a text with very many copies
    counts = common.stored(digests.select("digest").distinct().join(cache.read(), "digest"), "token-counted")
    counted = digests.join(counts, "digest", "left")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts of all documents, into a cache of this query's own: what earlier queries counted is not used."""
    cache = DigestCache(spark, common.shared_folder(spark, "token-counts"), default_tokenizer())
    return count_tokens(common.table(spark, sf_dir, "documents"), cache)
