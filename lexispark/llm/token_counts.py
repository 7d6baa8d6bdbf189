"""Token counts with a digest cache: a text is encoded once for each version of a tokenizer, ever.

The cache is a Parquet table with a folder for each tokenizer-version digest and a row for each text
digest. A run looks its documents' digests up, encodes one copy of each text that is not there yet,
appends these counts and joins all counts to the documents.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexispark.functions.lineage import materialize
from lexispark.llm.text import slices

SCHEMA = "digest binary, n_tokens long, tokenizer string"
#: Bytes of text that are encoded at once; longer texts alone.
SLICE_BYTES = 1 << 20
#: Up to so many missing digests of 32 bytes each are sent to the tasks, so that only the missing texts are shuffled.
SENT = 1 << 16
#: A space between a character that is no space and a letter begins a new word of byte-level patterns, so no token crosses it.
_CUT = re.compile(r"(?<=\S) (?=[A-Za-zÀ-ÖØ-öø-ſ])")
#: Words that a task remembers the counts of, and their length at most.
KNOWN, KNOWN_LENGTH = 1 << 19, 64


def tokenizer_version(model: bytes, kind: str) -> str:
    """SHA-256 of the vocabulary file, the library and its version: whatever can change a count."""
    library = {"json": "tokenizers", "model": "sentencepiece"}[kind]
    return hashlib.sha256(b"%s\0%s\0%s" % (library.encode(), importlib.metadata.version(library).encode(), model)).hexdigest()


def counter(model: bytes, kind: str) -> Callable[[list[str]], list[int]]:
    """The function from texts to their numbers of tokens, without added special tokens, truncation or padding."""
    if kind == "model":
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_proto=model)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(model.decode())
    whole.no_truncation()
    whole.no_padding()
    many = lambda texts: [len(e) for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    pattern = whole.pre_tokenizer
    local = whole.normalizer is None and type(pattern).__name__ == "ByteLevel" and pattern.use_regex and not pattern.add_prefix_space
    local = local and not any(" " in t.content or t.lstrip or t.rstrip for t in whole.get_added_tokens_decoder().values())
    return by_words(many) if local else many


def by_words(many: Callable[[list[str]], list[int]]) -> Callable[[list[str]], list[int]]:
    """``many`` for texts whose tokens never cross the places of ``_CUT``: each distinct piece is encoded once, and the pieces' counts are added up.

    So a text of any length is encoded in pieces, unless it has no such place.
    """
    leading: dict[str, int] = {}  # first pieces of texts
    inner: dict[str, int] = {}  # pieces without the space before them

    def count(texts: list[str]) -> list[int]:
        pieces = [_CUT.split(t) for t in texts]
        starts, rest = {p[0] for p in pieces} - leading.keys(), set().union(*(p[1:] for p in pieces)) - inner.keys()
        fresh = [*starts, *(" " + p for p in rest)]
        counts = many(fresh) if fresh else []
        first, after = dict(zip(starts, counts, strict=False)), dict(zip(rest, counts[len(starts) :], strict=True))
        for known, new in ((leading, first), (inner, after)):
            if len(known) > KNOWN:
                new |= {k: known[k] for p in pieces for k in (p[:1] if known is leading else p[1:]) if k in known}
                known.clear()
            known |= new
        out = [leading[p[0]] + sum(map(inner.__getitem__, p[1:])) for p in pieces]
        for known, new in ((leading, first), (inner, after)):
            for k in [k for k in new if len(k) > KNOWN_LENGTH]:
                del known[k]
        return out

    return count


def digest(text: Column) -> Column:
    """SHA-256 of the text as the tokenizer gets it: null as empty, else every byte as it is, since any change may change a count."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """``digest, n_tokens`` of one tokenizer version; rows that two runs have both appended count once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/tokenizer={version}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    rows = spark.read.schema(SCHEMA).parquet(cache).filter(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(digest(F.col(text_col)).alias("digest"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def encode_missing(docs: DataFrame, digests: DataFrame, model: bytes, kind: str, cache: str, text_col: str = "text") -> int:
    """Encode each text of ``docs`` whose digest, one of ``digests``, is not in the cache, append the counts, and say how many there were."""
    spark, version = docs.sparkSession, tokenizer_version(model, kind)
    missing = materialize(digests.join(cached(spark, cache, version), "digest", "left_anti"), "missing-digests")
    n = missing.count()
    if not n:
        return 0
    # copies meet in their own task first, so a text that a third of the rows share is sent once from each task
    one = lambda df: df.groupBy("digest").agg(F.first("text").alias("text"))
    rows = keyed(docs, text_col)
    texts = one(rows.join(F.broadcast(missing), "digest", "left_semi")) if n <= SENT else one(rows).join(missing, "digest", "left_semi")
    shared = spark.sparkContext.broadcast(model)  # a vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(shared.value, kind)
        for b in (part for whole in batches for part in slices(whole, SLICE_BYTES)):
            found = count(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(found, type=pa.int64())], names=["digest", "n_tokens"])

    counts = texts.mapInArrow(run, "digest binary, n_tokens long").withColumn("tokenizer", F.lit(version))
    counts.write.mode("append").partitionBy("tokenizer").parquet(cache)
    shared.destroy()
    return n


def count_tokens(docs: DataFrame, vocabulary: str, cache: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens`` by the tokenizer in the file ``vocabulary``.

    ``.json`` is read by ``tokenizers``, ``.model`` by ``sentencepiece``. ``cache`` is a folder that all
    executors share; it may be new. Null and empty texts have 0 bytes and the tokens of an empty text;
    whole texts are encoded, however long. Equal texts are encoded once, and rows that repeat stay. Columns
    of ``docs`` with the names of the new ones are replaced. An empty table adds nothing to the cache.
    """
    model, kind = Path(vocabulary).read_bytes(), Path(vocabulary).suffix[1:]
    if kind not in ("json", "model"):
        raise ValueError(f"no tokenizer library for {vocabulary}")
    digests = materialize(docs.select(digest(F.col(text_col)).alias("digest")).distinct(), "digests")
    encode_missing(docs, digests, model, kind, cache, text_col)
    # as a table, so that the join with the documents can be split where a third of them have one digest
    counts = materialize(digests.join(cached(docs.sparkSession, cache, tokenizer_version(model, kind)), "digest"), "counts").withColumnRenamed("digest", "_digest")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    keyed = docs.select(*kept, F.octet_length(text).cast("long").alias("n_bytes"), digest(F.col(text_col)).alias("_digest"))
    return keyed.join(counts, "_digest").drop("_digest")
