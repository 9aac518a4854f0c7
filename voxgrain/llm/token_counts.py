"""Token counts of documents in flat token files, which have no index: only an end-of-document id after each document.

Blocks of a file are scanned on their own: a vectorised search finds the separators. A document may begin in one
block and end in any later one, so block totals (tokens, separators, last separator) are joined by a prefix scan over the
blocks of each file, which gives every block its offset in the file, the number of the first document that ends in it,
and the separator before it; each length is then the distance between two separators. The scan sees one short row
a block, never the separators.

``write_tokens`` makes such files from documents: every task encodes its rows in order, and its stream is cut
into blocks of equal size wherever they fall. Beside the stream it notes the ids in the order in which they were
written, since the stream names no document; the scan doesn't read these notes.

Defined results: null or empty text has 0 tokens; documents without tokens stand as two separators side by side. Tokens after
the last separator of a file are an unfinished document and count as one. An empty file has no documents. Rows that
repeat a doc_id give a row each. Whole texts are encoded, runs of one character of any length among them; strings that look like special
tokens are ordinary text. Other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stage, table

#: A vocabulary of byte strings and ranks; its ids end at 50255, and 50256 is free for the separator.
VOCABULARY, SEPARATOR, DTYPE = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256, "<u2"
#: Fixed value: how this vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 1 << 19
STREAM = "file int, block int, tokens binary, first long, ids array<long>"


#: Texts with a run of so many characters, white space or not, are split and, where a piece is that long, merged here; the library can't.
LONG = 2000
#: Fixed value: the white space of the vocabulary's pattern, which differs from Python's.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = regex.compile(PATTERN.replace(r"[^\s", f"[^{_WHITE}").replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]"))
_RUN = re.compile(rf"[{_WHITE}]{{{LONG}}}|[^{_WHITE}]{{{LONG}}}")


class Encoder:
    """Ids of a text by a byte-pair vocabulary; texts of any shape and length."""

    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) < LONG or not _RUN.search(text):
            return self.encoding.encode_ordinary(text)
        out = []
        for piece in _SPLIT.finditer(text):
            raw = piece.group().encode("utf-8", "replace")
            out += self.merge(raw) if len(raw) > LONG else self.encoding._encode_single_piece(raw)
        return out

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece by the merges of least rank first, of equal ones the leftmost: a heap of pairs over a linked list of parts."""
        n, ranks = len(raw), self.ranks
        # Of the part that starts here: the start of the one before it, and its end, 0 once it is merged into another.
        before, ends = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = ends[i]
            if not j or j >= n or ends[j] != end:  # either part has changed since
                continue
            ends[i], ends[j] = end, 0
            if end < n:
                before[end] = i
                if (r := ranks.get(raw[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            h = before[i]
            if h >= 0 and (r := ranks.get(raw[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : ends[i]]])
            i = ends[i]
        return out


def write_tokens(docs: DataFrame, stage: Stage, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Writes ``docs`` (doc_id, text) as flat token files, one for each task, in blocks.

    Rows with ``tokens`` are blocks of a stream; rows with ``ids`` list the documents in order, from number ``first`` on.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, file = Encoder(vocabulary), TaskContext.get().partitionId()
        buffer, size, block, first = [], 0, 0, 0
        end = np.array([SEPARATOR], DTYPE)
        for b in batches:
            out = []
            for text in b["text"]:
                part = np.array(enc.encode(text), DTYPE) if text else end[:0]
                buffer += (part, end)
                size += len(part) + 1
                while size >= block_tokens:
                    stream = np.concatenate(buffer)
                    out.append((file, block, stream[:block_tokens].tobytes(), None, None))
                    buffer, size, block = [stream[block_tokens:]], size - block_tokens, block + 1
            out.append((file, None, None, first, b["doc_id"].array))
            first += len(b)
            yield _frame(out)
        if size:
            yield _frame([(file, block, np.concatenate(buffer).tobytes(), None, None)])

    return stage.put(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(encode, STREAM), "tokens")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["file", "block", "tokens", "first", "ids"])
    out["block"], out["first"] = out["block"].astype("Int32"), out["first"].astype("Int64")
    out["ids"] = [None if v is None else [None if pd.isna(i) else int(i) for i in v] for v in out["ids"]]
    return out


def read_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, dtype: str = DTYPE) -> DataFrame:
    """Blocks (file, block, tokens) of raw token files of any size.

    Only names and lengths of the files are listed; tasks read their own byte ranges, through the file systems of pyarrow.
    """
    step = block_tokens * np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length"))
    blocks = files.filter(F.col("length") > 0).select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step))).alias("block"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            for file, length, block in zip(b["file"], b["length"], b["block"]):
                system, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", file))
                with system.open_input_file(at) as source:
                    source.seek(block * step)
                    yield pd.DataFrame({"file": [file], "block": [block], "tokens": [source.read(min(step, length - block * step))]})

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return blocks.repartition(tasks).mapInPandas(read, "file string, block int, tokens binary")


def scan(blocks: DataFrame, stage: Stage, separator: int = SEPARATOR, dtype: str = DTYPE) -> DataFrame:
    """file, number, n_tokens: the length of each document of the token files cut into ``blocks`` (file, block, tokens)."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [np.frombuffer(t, dtype) for t in b["tokens"]]
            yield pd.DataFrame({"file": b["file"], "block": b["block"], "n": [len(x) for x in found], "seps": [np.flatnonzero(x == separator) for x in found]})

    kind = blocks.schema["file"].dataType.simpleString()
    seps = stage.put(blocks.select("file", "block", "tokens").mapInPandas(search, f"file {kind}, block int, n long, seps array<long>"), "separators")
    in_order = Window.partitionBy("file").orderBy("block")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    sums = seps.select("file", "block", "n", F.size("seps").alias("k"), F.element_at(F.when(F.size("seps") > 0, F.col("seps")), -1).alias("last"))
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("number", F.coalesce(F.sum("k").over(before), F.lit(0)))
    sums = sums.withColumn("last", F.col("base") + F.col("last"))
    sums = sums.withColumn("previous", F.coalesce(F.max("last").over(before), F.lit(-1))).withColumn("ends", F.lead("block").over(in_order).isNull())
    at = seps.select("file", "block", "n", "seps").join(sums.select("file", "block", "base", "number", "previous", "ends"), ["file", "block"])
    here = F.transform("seps", lambda s: s + F.col("base"))
    # A file that does not end with a separator ends with an unfinished document.
    past = F.col("base") + F.col("n")
    last = F.coalesce(F.element_at(F.when(F.size("seps") > 0, here), -1), F.col("previous"))
    here = F.when(F.col("ends") & (last < past - 1), F.concat(here, F.array(past))).otherwise(here)
    at = at.select("file", "number", "previous", here.alias("ends_at"))
    lengths = F.transform("ends_at", lambda e, i: e - F.when(i > 0, F.get("ends_at", i - 1)).otherwise(F.col("previous")) - 1)
    return at.select("file", "number", F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("number") + F.col("i")).alias("number"), "n_tokens")


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens for each row of ``docs``, by way of flat token files."""
    stage = Stage(docs.sparkSession, "tokens")
    stream = write_tokens(docs, stage, vocabulary, block_tokens)
    lengths = scan(stream.filter(F.col("block").isNotNull()), stage)
    names = stream.filter(F.col("first").isNotNull()).select("file", "first", F.posexplode("ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("number"), "doc_id")
    return names.join(lengths, ["file", "number"]).select("doc_id", "n_tokens")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
