"""Token ids of all documents in Re-Pair shards.

Documents are range-partitioned by id and sorted; each task turns its range into shards of about
``shard_tokens`` tokens, so memory follows the shard and not the range. Shards go to shared storage
under temporary names and are renamed; the table of shards is written last and is what a reader
trusts. Start offsets come from the shards' token counts.

A tokenizer call costs far more than a lookup, so texts are cut where the tokenizer's own splitting
cuts as well, around single blanks and line feeds, and each distinct piece goes through the
tokenizer once per worker (up to ``_PIECES`` pieces are remembered).

Cases: a null text is empty and an empty text is one end id. Rows with one id are all kept, ordered
by their texts; null ids come first. An empty table writes no shard and gives an empty result. Ids
are integers. Only id and text are read. A special token's name inside a text is encoded as the
tokenizer does by itself.
"""

from __future__ import annotations

import json
import os
import sys
import types
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.files import commit_file, read_file
from plumbline.llm.repair import Shard, encode_shard, gather
from plumbline.llm.text import whole
from plumbline.session import materialize, scratch_path

_PIECES = 900_000
_CACHE = "_plumbline_worker"
#: Two blanks together, and all white space but the blank and the line feed.
_HARD_BLANKS = ["  ", " \n", "\n ", "\n\n"] + [
    chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
_HARD_ASCII = [b for b in _HARD_BLANKS if b.isascii()]
_FILES = "partition int, shard int, name string, documents long, tokens long, bytes long"


def byte_characters() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves and the others, in order, for the characters from 256 on.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class _Numbering(dict):
    """Numbers from 1 on, given on first use; ``new`` holds the pieces that just got one."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        number = self[piece] = len(self) + 1
        return number


def worker_cache() -> dict:
    """What a worker process keeps between tasks.

    This package reaches a task by value, with new globals, so the cache is in a module of its own.
    """
    module = sys.modules.setdefault(_CACHE, types.ModuleType(_CACHE))
    return vars(module).setdefault("kept", {})


class PieceEncoder:
    """Encodes texts with a tokenizer, each distinct piece once."""

    def __init__(self, tokenizer_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.terminals = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # byte-level splitting keeps runs of letters, with the blank before them, and runs of signs
        # apart; other tokenizers get whole pieces
        parts = json.loads(self.tokenizer.to_str())
        splitter = parts["pre_tokenizer"] or {}
        self.by_word = splitter.get("type") == "ByteLevel" and splitter.get(
            "use_regex", True) and not splitter.get("add_prefix_space") and not parts["normalizer"]
        self.table = byte_characters()
        # number 0 is the end mark
        self.number = _Numbering()
        self.flat = np.array([self.terminals], np.int32)
        self.lengths = np.array([1], np.int64)
        self.uses = np.zeros(1, np.int64)

    @classmethod
    def of_worker(cls, tokenizer_file: str) -> PieceEncoder:
        """The encoder of this worker process, which outlives a task with all it remembers."""
        kept = worker_cache()
        if tokenizer_file not in kept:
            kept[tokenizer_file] = cls(tokenizer_file)
        return kept[tokenizer_file]

    def _forget_rare(self) -> None:
        """Keep the half of the pieces that was used most."""
        by_use = np.argsort(-self.uses[1:], kind="stable")[:_PIECES // 2]
        kept = np.zeros(len(self.uses), bool)
        kept[by_use + 1] = True
        names = [p for p, n in self.number.items() if kept[n]]
        kept[0] = True
        self.flat = self.flat[np.repeat(kept, self.lengths)]
        self.lengths, self.uses = self.lengths[kept], self.uses[kept] // 2
        self.number = _Numbering()
        for piece in names:  # in the order of their numbers
            self.number[piece] = len(self.number) + 1

    def pieces(self, text: str) -> list[str]:
        """A text in pieces that can be encoded one by one."""
        if "\x00" in text or any(s in text for s in self.special):
            return [text]
        if any(b in text for b in (_HARD_ASCII if text.isascii() else _HARD_BLANKS)):
            out: list[str] = []
            for i, part in enumerate(text.split(" ")):
                piece = " " + part if i else part
                if out and out[-1][-1].isspace():
                    out[-1] += piece
                elif piece:
                    out.append(piece)
            return out
        cut = text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
        return cut[not cut[0]:len(cut) - (not cut[-1])]

    def _encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces; words and words with a stop go straight to the tokenizer's model."""
        if not self.by_word:
            return [e.ids for e in self.tokenizer.encode_batch_fast(
                pieces, add_special_tokens=False)]
        model, table = self.tokenizer.model.tokenize, self.table
        blank = chr(table[ord(" ")])
        out: list[list[int] | None] = []
        for piece in pieces:
            word = piece[1:] if piece[0] == " " else piece
            stop = piece[-1] if piece[-1] in ".,;:!?" else ""
            if (word[:-1] if stop else word).isalpha():
                body = word[:-1] if stop else word
                if not body.isascii():
                    body = body.encode().decode("latin-1").translate(table)
                ids = [t.id for t in model(blank + body if word is not piece else body)]
                if stop:
                    ids += [t.id for t in model(stop)]
                out.append(ids)
            else:
                out.append(None)
        rest = [p for p, ids in zip(pieces, out) if ids is None]
        more = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))
        return [next(more).ids if ids is None else ids for ids in out]

    def encode(self, texts: list[str]) -> np.ndarray:
        """The ids of all texts, each followed by the end mark."""
        if len(self.number) > _PIECES:
            self._forget_rare()
        numbers = array("q")
        for text in texts:
            numbers.extend(map(self.number.__getitem__, self.pieces(text)))
            numbers.append(0)
        new = self.number.new
        if new:
            got = self._encode_pieces(new)
            self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(got), np.int32))
            self.lengths = np.append(self.lengths, np.fromiter(map(len, got), np.int64, len(got)))
            new.clear()
        wanted = np.frombuffer(numbers, np.int64)
        uses = np.bincount(wanted, minlength=len(self.lengths))
        uses[:len(self.uses)] += self.uses
        self.uses = uses
        return gather(wanted, np.cumsum(self.lengths) - self.lengths, self.lengths, self.flat)


def _groups(batch: pa.RecordBatch, chars: int) -> Iterator[tuple[list, list[str]]]:
    """Consecutive documents of about ``chars`` characters together."""
    ids, texts, size = [], [], 0
    for i, text in zip(batch["_id"], batch["_text"]):  # one text at a time leaves Arrow
        ids.append(i.as_py())
        texts.append(text.as_py())
        size += len(texts[-1])
        if size >= chars:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _write_shards(tokenizer_file: str, end_id: int, folder: str, shard_tokens: int):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, shard = TaskContext.get().partitionId(), 0
        encoder, ids, parts = None, [], []

        def close() -> pa.RecordBatch:
            nonlocal shard
            seq = np.concatenate(parts)
            content = encode_shard(ids, seq, encoder.terminals, end_id)
            name = f"tokens-{partition:06d}-{shard:06d}.repair"
            commit_file(folder, name, content)
            row = [partition, shard, name, len(ids), len(seq), len(content)]
            shard += 1
            ids.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(),
                                                        pa.int64(), pa.int64(), pa.int64()))],
                ["partition", "shard", "name", "documents", "tokens", "bytes"])

        for batch in batches:
            encoder = encoder or PieceEncoder.of_worker(tokenizer_file)
            for some, texts in _groups(batch, 4 * shard_tokens):
                ids += some
                parts.append(encoder.encode(texts))
                if sum(map(len, parts)) >= shard_tokens:
                    yield close()
        if ids:
            yield close()

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int,
                      id_col: str = "doc_id", text_col: str = "text", *,
                      shard_tokens: int = 1 << 20) -> DataFrame:
    """Write shards to ``folder``; the table of shards, with the ``start`` of each."""
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).cast("long").alias("_id"), whole(text_col).alias("_text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = read.repartitionByRange(parts, "_id").sortWithinPartitions("_id", "_text")
    files = materialize(spark, ordered.mapInArrow(
        _write_shards(tokenizer_file, end_id, folder, shard_tokens), _FILES), "token-files")
    by_part = files.groupBy("partition").agg(F.sum("tokens").alias("own")).select(
        "partition", (F.sum("own").over(Window.orderBy("partition")) - F.col("own")).alias("base"))
    within = F.sum("tokens").over(Window.partitionBy("partition").orderBy("shard"))
    return files.withColumn("_upto", within).join(by_part, "partition").select(
        *files.columns, (F.col("base") + F.col("_upto") - F.col("tokens")).alias("start"))


def read_token_files(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Per document in the shards: ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32``."""
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch["name"].to_pylist(), batch["start"].to_pylist()):
                shard = Shard(read_file(folder, name))
                tokens = shard.all_tokens().astype("<u4")
                cuts = shard.token_starts
                crc = [zlib.crc32(tokens[a:b]) for a, b in zip(cuts, cuts[1:])]
                yield pa.record_batch({
                    "doc_id": pa.array(shard.ids, pa.int64()),
                    "start": pa.array(cuts[:-1] + start, pa.int64()),
                    "n_tokens": pa.array(np.diff(cuts), pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64())})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.select("name", "start").repartition(parts, "name").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Write all documents to a new folder of the shared storage and read the index back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    files = write_token_files(docs, folder, tokenizer_file, end_id, id_col, text_col)
    return read_token_files(docs.sparkSession, files, folder)
