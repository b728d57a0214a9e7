"""Token-ID files: flat unsigned integers plus 64-bit document offsets.

Layout of a token folder, one triple per partition, little-endian throughout:

* ``part-000007.ids``: the ids of the partition's documents, one after
  another, as unsigned 16-bit integers when every id fits, else 32-bit;
* ``part-000007.off``: signed 64-bit offsets into the ids, one more than
  there are documents (document k has the ids ``off[k]`` to ``off[k+1]``);
* ``part-000007.doc``: signed 64-bit document ids (``NULL_ID`` for null);
* ``manifest/``: a Parquet table with a row per partition: its number, file
  stem, documents, tokens and *base*, the tokens of all earlier partitions.

Partitions hold ascending, disjoint ranges of doc_id, so the base (a prefix
sum over the manifest) plus the offset is a token's position in the corpus.
All files can be memory-mapped (``TokenFile``).

Documents are range-partitioned and sorted by Spark; each task streams its
partition through the tokenizer into its files and renames them when they
are complete, so that a lost or repeated attempt leaves no half file.

Defined cases: null text is the empty text (only the end id); repeated rows
are separate documents, in order of text; rows with a null doc_id come first;
extra columns are ignored; an empty table gives files without documents.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow.llm.common import arrow_batches, kept_by_worker, release_memory

NULL_ID = np.iinfo(np.int64).min
MANIFEST = "part int, stem string, n_docs long, n_tokens long"

#: Words and pieces in the younger of two generations that a Python worker keeps (speed only).
CACHE_ENTRIES = 250_000
#: Documents in an Arrow batch: a task holds one batch of whole texts several times over (Arrow, pandas, ids).
BATCH_DOCS = 500

# The one normaliser and pre-tokenizer for which texts may be encoded word by word.
# They must equal the tokenizer file's.
WORD_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
                   {"type": "Lowercase"}]
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Words of characters that NFC keeps and whose lower case is one character everywhere.
_LATIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_PIECES = regex.compile(WORD_SPLIT)
_ASCII_PIECES = re.compile(WORD_SPLIT.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"))
#: Characters that Python's ``split`` takes for white space and the tokenizer doesn't.
_SEPARATORS = regex.compile("[\x1c-\x1f]")

#: Byte-level files write bytes as characters: printable Latin-1 as itself, the others from U+0100 on, in order.
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256)
                                                if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class _Kept(dict):
    """key -> id bytes, computed at first sight; keys not met for two generations are forgotten."""

    def __init__(self, compute: Callable[[str], bytes]):
        super().__init__()
        self.compute, self.old = compute, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        data = self.old.get(key)
        self[key] = data = self.compute(key) if data is None else data
        return data


class Encoder:
    """Encodes texts to little-endian id bytes with a tokenizer file.

    If the file normalises and splits as ``word_bpe`` files do (white space
    dropped, pieces of words encoded one by one), each distinct word and
    piece is encoded once and looked up afterwards, a piece of plain
    characters by the tokenizer's model directly; any other word, any text
    with separator controls, and every text under another kind of file is
    encoded whole.  Letters are kept once, as the word they are in lower case.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials)) or r"(?!)")
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = ((spec.get("normalizer") or {}).get("normalizers") == WORD_NORMALIZER
                        and splits[0] == {"type": "Split", "pattern": {"Regex": WORD_SPLIT}, "behavior": "Removed",
                                          "invert": True}
                        and [s["type"] for s in splits[1:]] == ["ByteLevel"]
                        and not any(c.isspace() for s in specials for c in s))
        self.words, self.pieces = _Kept(self._word), _Kept(self._piece)

    def _whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_LEVEL)
        return self.pack([t.id for t in self.model.tokenize(mapped)])

    def _word(self, word: str) -> bytes:
        plain = word.isascii() or _LATIN.fullmatch(word)
        low = word.lower()
        if plain and low.isalpha():
            return self._piece(word) if word == low else self.words[low]
        if plain and low[-1] in ",-." and low[:-1].isalpha():
            return self.words[low[:-1]] + self.pieces[low[-1]]
        if not plain or not word.isprintable() or self.special.search(word):
            return self._whole(word)
        split = _ASCII_PIECES if word.isascii() else _PIECES
        return b"".join([self.words[p] if p.isalpha() else self.pieces[p] for p in split.findall(low)])

    def encode(self, text: str) -> bytes:
        if not self.by_word or _SEPARATORS.search(text):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, text.split()))


def _encoder(path: str) -> Encoder:
    return kept_by_worker(("encoder", path), lambda: Encoder(path))


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _writer(out_dir: str, tokenizer_path: str, end_id: int) -> Callable:
    """A mapInPandas function: streams one partition's documents into its files, returns its manifest row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, fs_root = TaskContext.get(), _filesystem(out_dir)
        (fs, root), part, enc = fs_root, task.partitionId(), _encoder(tokenizer_path)
        stem, mark = f"part-{part:06d}", f".try{task.taskAttemptId()}"
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        at = n_docs = 0
        temp = {x: f"{root}/{stem}.{x}{mark}" for x in ("ids", "off", "doc")}
        with fs.open_output_stream(temp["ids"]) as ids, fs.open_output_stream(temp["off"]) as off, \
                fs.open_output_stream(temp["doc"]) as doc:
            off.write(np.zeros(1, "<i8").tobytes())
            for pdf in batches:
                lengths = []
                for text in pdf["text"]:
                    data = enc.encode(text)
                    ids.write(data)
                    ids.write(end)
                    lengths.append(len(data) // width + 1)
                ends = at + np.cumsum(np.array(lengths, "<i8"))
                off.write(ends.astype("<i8").tobytes())
                doc.write(pdf["doc_id"].to_numpy("<i8").tobytes())
                at, n_docs = int(ends[-1]) if len(ends) else at, n_docs + len(pdf)
        for x, path in temp.items():
            fs.move(path, f"{root}/{stem}.{x}")
        release_memory()
        yield pd.DataFrame({"part": [part], "stem": [stem], "n_docs": [n_docs], "n_tokens": [at]})

    return run


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str, *, end_id: int = 1,
                      id_col: str = "doc_id", text_col: str = "text", n_files: int | None = None) -> DataFrame:
    """Encode ``docs`` into a token folder at ``out_dir`` (shared, not there yet); return its manifest.

    ``n_files`` partitions (default: the session's shuffle partitions); a
    task holds one batch of texts and 8 bytes a document of it at a time.
    """
    spark = docs.sparkSession
    n_files = n_files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, root = _filesystem(out_dir)
    fs.create_dir(root, recursive=True)
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
            .repartitionByRange(n_files, F.col("doc_id"), F.xxhash64("text"))
            .sortWithinPartitions("doc_id", "text")
            .withColumn("doc_id", F.coalesce("doc_id", F.lit(int(NULL_ID)))))
    with arrow_batches(spark, BATCH_DOCS):
        rows.mapInPandas(_writer(out_dir, tokenizer_path, end_id), MANIFEST).write.parquet(f"{out_dir}/manifest")
    return read_manifest(spark, out_dir)


def read_manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    """The manifest with each partition's base: a prefix sum over one row per file."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return (spark.read.schema(MANIFEST).parquet(f"{out_dir}/manifest")
            .withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0).cast("long"))))


def id_dtype(tokenizer_path: str) -> np.dtype:
    return _encoder(tokenizer_path).dtype


class TokenFile:
    """One partition's files: memory-mapped on a local or mounted folder, else read by range."""

    def __init__(self, out_dir: str, stem: str, dtype: np.dtype):
        fs, root = _filesystem(out_dir)
        self.dtype = np.dtype(dtype)
        if isinstance(fs, pafs.LocalFileSystem):
            self._map = lambda x, kind: (np.memmap(p, kind, "r") if fs.get_file_info(p := f"{root}/{stem}.{x}").size
                                         else np.zeros(0, kind))
            self.offsets, self.doc_ids = self._map("off", "<i8"), self._map("doc", "<i8")
            flat = self._map("ids", self.dtype)
            self._ids = lambda a, b: flat[a:b]
        else:
            whole = lambda x, kind: np.frombuffer(fs.open_input_file(f"{root}/{stem}.{x}").read(), kind)
            self.offsets, self.doc_ids = whole("off", "<i8"), whole("doc", "<i8")
            data, w = fs.open_input_file(f"{root}/{stem}.ids"), self.dtype.itemsize
            self._ids = lambda a, b: np.frombuffer(data.read_at((b - a) * w, a * w), self.dtype)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, k: int) -> np.ndarray:
        return self._ids(int(self.offsets[k]), int(self.offsets[k + 1]))


def _summary(out_dir: str, dtype: str, batch_docs: int = 5000) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for manifest in batches:
            for stem, base in zip(manifest["stem"], manifest["base"], strict=True):
                f = TokenFile(out_dir, stem, dtype)
                for lo in range(0, len(f), batch_docs):
                    hi = min(lo + batch_docs, len(f))
                    edges, docs = np.asarray(f.offsets[lo:hi + 1]), np.asarray(f.doc_ids[lo:hi])
                    yield pd.DataFrame({
                        "doc_id": pd.array(docs, "Int64").copy() if (docs != NULL_ID).all()
                        else pd.Series(docs).astype("Int64").mask(docs == NULL_ID),
                        "start": base + edges[:-1], "n_tokens": np.diff(edges),
                        "ids_crc32": [zlib.crc32(f[k].astype("<u4").tobytes()) for k in range(lo, hi)]})

    return run


def token_file_summary(spark: SparkSession, out_dir: str, tokenizer_path: str) -> DataFrame:
    """Read a token folder back: doc_id, start, n_tokens and the crc32 of each document's ids (as 32-bit)."""
    manifest = read_manifest(spark, out_dir)
    n = max(1, manifest.count())
    return (manifest.repartition(n, "part")
            .mapInPandas(_summary(out_dir, id_dtype(tokenizer_path).str),
                         "doc_id long, start long, n_tokens long, ids_crc32 long"))
