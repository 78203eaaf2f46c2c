"""Operator 2, token-id output: texts to ids to files of context-mixing range-coded blocks, and back.

Documents are range-partitioned by doc_id and sorted, encoded with the tokenizer, closed with an end id, and packed
into records of about `BLOCK_IDS` ids (a record holds whole documents). A record is an index of its documents
(doc_id, number of ids) and blocks of rangecoder (one, but for a document longer than a block); each has its own
checksum and depends on no other.
Records are rows (part, seq, n_tokens, record) of a Parquet folder: Spark's committer makes the write safe against
lost executors, and (part, seq) is the order of the corpus.

Tokens never cross the blanks that part words, so each distinct word is encoded once per worker and cached (about
`CACHE` words, 120 MB a worker; then it starts anew) rather than every text. Nor do they cross the border of a letter and a symbol behind it, so a word with
symbols at its end is put together from its letters and these.

Defined cases: a null or empty text is the end id alone; a null doc_id sorts first; rows of equal doc_id stay
separate, ordered by their text's hash; an empty table gives no records; doc_id must be a whole number.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rangecoder
from .simhash import LOWER
from .store import table_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BLOCK_IDS = 1_000_000
CACHE = 500_000
JOINED = 2000
#: Letters of ASCII and Latin-1, then ASCII symbols but for the apostrophe: the tokenizer parts the two.
STEM = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
MAGIC = b"DLT2"
SCHEMA = "part int, seq long, n_tokens long, record binary"


class Words:
    """A tokenizer with a bounded cache of words: their ids in one array, and where each word's ids begin."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.size = np.zeros(1 << 16, np.uint16), np.zeros(1 << 14, np.uint16)
        self.first = np.zeros(1 << 14, np.int64)
        self.used = 0

    def learn(self, words: list[bytes]) -> None:
        """Adds new words: those of letters alone in one go, those of letters and symbols from these, others one by one."""
        cut = [(w, *m.groups()) for w in words if (m := STEM.fullmatch(w))]
        odd = [w for w in words if not STEM.fullmatch(w)] if len(cut) < len(words) else []
        stems = sorted({x for _, x, _ in cut}.difference(self.number))
        marks = sorted({y for _, _, y in cut if y}.difference(self.number))
        for at in range(0, len(stems), JOINED):
            self._put_joined(stems[at : at + JOINED])
        self._put_each(odd + [y for y in marks if y not in odd])
        cut = [x for x in cut if x[2]]
        if cut:
            n = np.fromiter((self.number[x] for _, *two in cut for x in two), np.int64, 2 * len(cut))
            ids, size = self._gather(n)
            self._put([w for w, _, _ in cut], ids, size.reshape(-1, 2).sum(1))

    def _put_joined(self, stems: list[bytes]) -> None:
        ids = np.array(self.tokenizer.encode(b" ".join(stems).decode(), add_special_tokens=False).ids, np.int64)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) == len(stems) and ends[-1] == len(ids):
            self._put(stems, ids, np.diff(np.r_[0, ends]))
        else:  # a tokenizer whose words do not end in tokens of their own
            self._put_each(stems)

    def _put_each(self, words: list[bytes]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self._put(words, np.fromiter((i for x in ids for i in x), np.int64, int(size.sum())), size)

    def _gather(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by their numbers, one after the other, and how many each has."""
        size = self.size[n].astype(np.int64)
        total = np.cumsum(size)
        return self.ids[np.repeat(self.first[n] - total + size, size) + np.arange(total[-1] if len(total) else 0)], size

    def _put(self, words: list[bytes], flat: np.ndarray, size: np.ndarray) -> None:
        if not words:
            return
        n = len(self.number)
        wide = np.uint32 if max(flat.max(initial=0), size.max(initial=0)) > 0xFFFF or self.ids.dtype == np.uint32 else np.uint16
        if wide != self.ids.dtype:
            self.ids, self.size = self.ids.astype(wide), self.size.astype(wide)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) > len(self.size):
            self.size, self.first = np.concatenate([self.size, np.zeros_like(self.size)]), np.concatenate([self.first, np.zeros_like(self.first)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.size[n : n + len(words)] = size
        self.first[n : n + len(words)] = self.used + np.cumsum(size) - size
        self.used += len(flat)
        self.number.update(zip(words, range(n, n + len(words))))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        raw = [(t or "").encode() for t in texts]
        # a special token's name only counts as written, so a text that may hold one keeps its case
        split = [(t if b"<|" in t else t.translate(LOWER)).split() for t in raw]
        n = list(map(len, split))
        flat = [w for s in split for w in s]
        if len(self.number) > CACHE:
            self.clear()
        number = list(map(self.number.get, flat))
        if None in number:
            new = [k for k, i in enumerate(number) if i is None]
            self.learn(list({flat[k] for k in new}))
            for k in new:
                number[k] = self.number[flat[k]]
        ids, size = self._gather(np.array(number, np.int64))
        ends = np.r_[0, np.cumsum(size)][np.cumsum(n)] if n else []
        return np.split(ids, ends[:-1]) if len(ends) else []


_words: dict[str, Words] = {}


def words_of(path: str | None) -> Words:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def record(doc_ids: list, ids: list[np.ndarray]) -> bytes:
    known = np.array([d is not None and d == d for d in doc_ids], bool)
    index = zlib.compress(np.packbits(known).tobytes() + np.array([int(d) if k else 0 for d, k in zip(doc_ids, known)], "<i8").tobytes() + np.array([len(i) for i in ids], "<u4").tobytes())
    flat = np.concatenate(ids)
    blocks = [rangecoder.encode(flat[at : at + rangecoder.MAX_IDS]) for at in range(0, len(flat), rangecoder.MAX_IDS)]
    return MAGIC + struct.pack("<IIII", zlib.crc32(index), len(doc_ids), len(index), len(blocks)) + index + b"".join(struct.pack("<I", len(b)) + b for b in blocks)


def unpack(r: bytes) -> tuple[list, list[np.ndarray]]:
    """The documents of a record: doc_ids and ids."""
    crc, n, size, n_blocks = struct.unpack("<IIII", r[4:20])
    if r[:4] != MAGIC or zlib.crc32(r[20 : 20 + size]) != crc:
        raise ValueError("the record is damaged")
    index = zlib.decompress(r[20 : 20 + size])
    bits = -(-n // 8)
    known = np.unpackbits(np.frombuffer(index[:bits], np.uint8), count=n).astype(bool)
    doc_ids = [d if k else None for d, k in zip(np.frombuffer(index[bits : bits + 8 * n], "<i8").tolist(), known)]
    lengths = np.frombuffer(index[bits + 8 * n :], "<u4").astype(np.int64)
    at, blocks = 20 + size, []
    for _ in range(n_blocks):
        (m,) = struct.unpack("<I", r[at : at + 4])
        blocks.append(rangecoder.decode(r[at + 4 : at + 4 + m]))
        at += 4 + m
    ids = np.concatenate(blocks) if blocks else np.zeros(0, np.int64)
    if lengths.sum() != len(ids):
        raise ValueError("the record is damaged")
    return doc_ids, np.split(ids, np.cumsum(lengths)[:-1])


def encoded(docs: DataFrame, tokenizer: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Records in the order of doc_id: part, seq, n_tokens, record."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, part, seq = words_of(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids, ids, total = [], [], 0

        def row() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "seq": [seq], "n_tokens": [total], "record": [record(doc_ids, ids)]})

        for p in parts:
            texts = p["text"].tolist()
            for at in range(0, len(texts), 64):
                for d, x in zip(p["doc_id"].iloc[at : at + 64].tolist(), words.encode(texts[at : at + 64])):
                    doc_ids.append(None if pd.isna(d) else d)
                    ids.append(np.append(x, x.dtype.type(END_ID)))
                    total += len(x) + 1
                    if total >= block_ids:
                        yield row()
                        seq, doc_ids, ids, total = seq + 1, [], [], 0
        if doc_ids:
            yield row()

    d = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return d.mapInPandas(run, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    encoded(docs, tokenizer).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files at path: doc_id, start, n_tokens, ids_crc32 and ids (array)."""
    return _read(spark, path, True)


def _read(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for part, seq, r in zip(p["part"], p["seq"], p["record"]):
                doc_ids, ids = unpack(r)
                n = np.array([len(x) for x in ids], np.int64)
                out = pd.DataFrame({"part": part, "seq": seq, "doc_id": pd.array(doc_ids, "Int64"), "inside": np.cumsum(n) - n, "n_tokens": n, "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]})
                if with_ids:
                    out["ids"] = ids
                yield out

    records = spark.read.schema(SCHEMA).parquet(path)
    docs = records.select("part", "seq", "record").mapInPandas(run, "part int, seq long, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    # where a record starts: its part's start and what precedes it in the part
    parts = records.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    begin = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"))
    seqs = records.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("before"))
    at = seqs.join(begin, "part").select("part", "seq", (F.col("begin") + F.col("before")).alias("at"))
    return docs.join(at, ["part", "seq"]).select("doc_id", (F.col("at") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs to new files in the shared folder; what the files hold of each document."""
    spark = docs.sparkSession
    path = table_path(spark, "tokens")
    write(docs, path, tokenizer)
    return _read(spark, path, False)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
