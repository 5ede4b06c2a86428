"""Token counts from pre-token frequencies: each distinct pre-token is counted once, ids are never kept.

1. Every partition reduces its texts to distinct pre-tokens with frequencies; Spark sums them.
2. Each distinct pre-token is encoded once, which gives its number of tokens.
3. Per text, the pre-token frequencies meet these numbers: frequent pre-tokens (at most HEAD of them)
   from a broadcast of bounded size, the others by a shuffled join; Spark sums per text.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import pattern

#: Pre-tokens in the broadcast at most, and their bytes.
HEAD, HEAD_BYTES = 1 << 17, 8 << 20


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def specials(path: str):
    """A pattern of the added tokens, which the library takes out of a text before all else."""
    import regex

    added = sorted((t.content for t in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return regex.compile("|".join(map(regex.escape, added))) if added else None


def pre_tokens(text: str, path: str) -> list[str]:
    """The pre-tokens and added tokens of a text."""
    added, split = specials(path), pattern()
    if added is None or not added.search(text):
        return split.findall(text)
    out, at = [], 0
    for m in added.finditer(text):
        out += [*split.findall(text[at : m.start()]), m[0]]
        at = m.end()
    return out + split.findall(text[at:])


def pre_token_counts(rows: DataFrame, path: str) -> DataFrame:
    """piece, freq (over all rows) and n_tokens of every distinct pre-token."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in common.slices(batches):
            for text in part.column("text").to_pylist():
                seen.update(pre_tokens(text, path))
            if len(seen) > 500_000:
                yield frequencies(seen)
                seen = Counter()
        if seen:
            yield frequencies(seen)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = tokenizer(path).encode_batch_fast(part.column("piece").to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(x) for x in found], pa.int32())], names=["piece", "freq", "n_tokens"])

    summed = rows.mapInArrow(partial, "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq"))
    return summed.mapInArrow(counted, "piece string, freq long, n_tokens int")


def frequencies(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "freq"])


def frequent(counts: DataFrame, most: int, most_bytes: int = HEAD_BYTES) -> dict[str, int]:
    """n_tokens of the frequent pre-tokens, long ones too: those of at least such a power of two of occurrences that there are at most `most`, with `most_bytes` bytes."""
    own = counts.groupBy(F.floor(F.log2("freq")).cast("int").alias("power")).agg(F.count("*").alias("n"), F.sum(F.octet_length("piece")).alias("bytes"))
    sizes = {r.power: (r.n, r.bytes) for r in own.collect()}
    power, total, size = max(sizes, default=0) + 1, 0, 0
    while power > 0:
        n, bytes_ = sizes.get(power - 1, (0, 0))
        if total + n > most or size + bytes_ > most_bytes:
            break
        power, total, size = power - 1, total + n, size + bytes_
    return {r[0]: r[1] for r in counts.filter(F.col("freq") >= (1 << power)).select("piece", "n_tokens").collect()}


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row; a null or empty text has 0 of each; repeated rows stay; a null id stays null."""
    path = path or vocabulary()
    rows = common.id_text(docs, id_col, text_col).withColumn("key", common.text_key())
    spark = docs.sparkSession
    counts = common.written(pre_token_counts(rows.select("text"), path))
    known = spark.sparkContext.broadcast(frequent(counts, head))

    def per_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, with its bytes and the tokens of frequent pre-tokens; a row for each other pre-token of it.

        The text's own row has a piece that is no pre-token (NUL, then letters), other for every text, so that these rows spread.
        """
        names = ["doc_id", "key", "piece", "freq", "n_bytes", "n_tokens"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        n_of = known.value
        for part in common.slices(batches):
            rows = []
            for doc_id, key, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "key", "text")), strict=True):
                own = Counter(pre_tokens(text, path))
                rest = [(doc_id, key, p, f, None, None) for p, f in own.items() if p not in n_of]
                rows.append((doc_id, key, f"\0{key:x}", None, len(text.encode()), sum([n_of[p] * f for p, f in own.items() if p in n_of])))
                rows += rest
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    parts = rows.mapInArrow(per_text, "doc_id long, key long, piece string, freq long, n_bytes long, n_tokens long")
    joined = parts.join(counts.select("piece", F.col("n_tokens").alias("each")), "piece", "left")
    sums = joined.groupBy("doc_id", "key").agg(
        F.sum("n_bytes").alias("n_bytes"), F.sum(F.coalesce(F.col("n_tokens"), F.col("freq") * F.col("each"))).alias("n_tokens"), F.count("n_bytes").alias("repeats")
    )
    # Repeats of a row have added up evenly.
    per = lambda c: F.expr(f"{c} div repeats").alias(c)
    return sums.select("doc_id", per("n_bytes"), per("n_tokens"), F.explode(F.array_repeat(F.lit(0), F.col("repeats").cast("int"))).alias("_")).drop("_")
