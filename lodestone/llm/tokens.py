"""Token-ID files: texts are encoded by a public tokenizer and packed with Simple-8b.

Documents are dealt to ranges of their id, or of another order, and sorted; each task writes its range as one file in the
shared folder, straight from the stream of its rows. A file has a name of its own for each attempt,
and the manifest lists those of the tasks that ended, so retries and lost executors leave no wrong
or doubled output. What the driver holds is a row for each file.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, simple8b

#: The id that ends each document.
END = 1
#: Words whose ids a Python worker remembers before it starts anew.
CACHE = 500_000
#: Bytes of text encoded in one go: a text more at most.
STEP = 2 << 20

#: A chunk of one word and ASCII marks without an apostrophe, which begins contractions.
_PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"


class ChunkEncoder:
    """Ids of texts by a tokenizer that gives white space no ids and nothing across it.

    Texts are cut at spaces and line feeds. A plain chunk, a word and marks after it, is two
    pre-tokens; each word and each run of marks is encoded once and remembered. What is unknown is
    encoded in one string with spaces between, and its ids are cut where a token ends a word. All
    other chunks are encoded each on its own. The result equals that of encoding whole texts. Cutting,
    finding equal chunks and putting ids together are array operations.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.at = {"": 0}
        self.parts, self.stops = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)]
        self.n = 0

    def _remember(self, pieces: list[str], ids: np.ndarray, stops: np.ndarray) -> None:
        self.at.update(zip(pieces, range(len(self.at), len(self.at) + len(pieces))))
        self.parts.append(ids)
        self.stops.append(self.n + stops)
        self.n += len(ids)

    def _alone(self, pieces: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        self._remember(pieces, np.array([i for own in ids for i in own], np.uint32), np.cumsum([len(own) for own in ids]))

    def _together(self, words: list[str]) -> None:
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(words):
            self._remember(words, ids, stops)
        else:
            self._alone(words)

    def _numbers(self, pieces: list[str], learn) -> np.ndarray:
        """The number of each piece, all different; unknown ones are learnt."""
        get = self.at.get
        numbers = np.array([get(p, -1) for p in pieces], np.int64)
        if len(missing := np.flatnonzero(numbers < 0)):
            new = [pieces[i] for i in missing.tolist()]
            first = len(self.at)
            learn(new)
            numbers[missing] = np.arange(first, first + len(new))
        return numbers

    @staticmethod
    def _gathered(store: np.ndarray, begins: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the stretches of a store that are asked for, one after another, the size of each)"""
        sizes = sizes[which].astype(np.int32)
        stops = np.cumsum(sizes, dtype=np.int32)
        places = np.repeat(begins[which].astype(np.int32) - stops + sizes, sizes)
        places += np.arange(len(places), dtype=np.int32)
        return store[places], sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each). No text is null."""
        if len(self.at) > CACHE:
            self._forget()
        lists = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        chunks = pc.dictionary_encode(lists.flatten())
        kinds = chunks.dictionary
        cut = pc.extract_regex(kinds, _PLAIN)
        plain = np.asarray(cut.is_valid())
        kinds_plain = cut.filter(pa.array(plain))
        number = np.zeros((len(kinds), 2), np.int64)
        words = pc.dictionary_encode(pc.utf8_lower(kinds_plain.field("word")))
        marks = pc.dictionary_encode(kinds_plain.field("marks"))
        for column, pieces in enumerate((words, marks)):
            numbers = self._numbers(pieces.dictionary.to_pylist(), self._together)
            number[plain, column] = numbers[np.asarray(pieces.indices)]
        number[~plain, 0] = self._numbers(kinds.filter(pa.array(~plain)).to_pylist(), self._alone)
        stops = np.concatenate(self.stops)
        if len(self.parts) > 1:
            self.parts, self.stops = [np.concatenate(self.parts)], [stops]
        begins = np.append(0, stops[:-1])
        # first the ids of each different chunk, then those of all
        own, sizes = self._gathered(self.parts[0], begins, stops - begins, number.ravel())
        sizes = sizes.reshape(-1, 2).sum(axis=1, dtype=np.int32)
        ids, sizes = self._gathered(own, np.cumsum(sizes, dtype=np.int32) - sizes, sizes, np.asarray(chunks.indices))
        bounds = np.append(0, np.cumsum(sizes))[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        return ids, np.diff(bounds)


#: Encoders of this Python worker, which outlive its tasks, by path.
_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder_for(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; file:/x is file:///x."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def write_token_files(docs: DataFrame, out: str, tokenizer: str, text: str = "text", key: str = "doc_id", end: int = END, remember: bool = True, order: tuple[Column, ...] = ()) -> list[dict]:
    """Writes all texts' ids, each with the end id, to `out` in ascending order of the key.

    Returns the manifest, also written as manifest.json: for each file in order its name, docs, ids
    and start (ids of all files before it). Null texts are empty and just give the end id. Null keys
    come first; rows with one key stand in the order of their texts. Empty input gives no file.
    order: what rows are put in the order of before the key.
    remember: Python workers keep the words they know for later tasks, which takes less time and more
    memory.
    """
    spark = docs.sparkSession
    common.ship(docs.sparkSession)
    places = [f"_place{i}" for i in range(len(order))]
    rows = docs.select(F.col(key).cast("long").alias("key"), common.text_or_empty(text).alias("text"), *(c.alias(p) for c, p in zip(order, places)))
    ordered = rows.repartitionByRange(*map(F.col, places or ["key"])).sortWithinPartitions(*places, "key", "text").select("key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, folder = _open(out)
        system.create_dir(folder, recursive=True)
        encoder, writer = encoder_for(tokenizer), None
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.s8b"
        for batch in batches:
            if writer is None:
                file = system.open_output_stream(f"{folder}/{name}")
                writer = simple8b.Writer(file)
            keys, texts = batch.column(0), batch.column(1)
            steps = np.cumsum(pc.binary_length(texts).to_numpy()) // STEP
            for at, n in zip(*(x.tolist() for x in np.unique(steps, return_index=True, return_counts=True)[1:])):
                ids, sizes = encoder.encode(texts.slice(at, n))
                writer.add(keys.slice(at, n).to_pylist(), np.insert(ids, np.cumsum(sizes), np.uint32(end)), sizes + 1)
        if writer is not None:
            writer.close()
            file.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "name": [name], "docs": [len(writer.docs)], "ids": [writer.n_ids]})
            del writer
        if not remember:
            _ENCODERS.clear()
            del encoder
        common.release_memory()

    found = sorted(ordered.mapInArrow(write, "part long, name string, docs long, ids long").collect())
    manifest, start = [], 0
    for r in found:
        manifest.append({"name": r["name"], "docs": r["docs"], "ids": r["ids"], "start": start})
        start += r["ids"]
    system, folder = _open(out)
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps({"block": simple8b.BLOCK, "files": manifest}).encode())
    return manifest


def read_token_files(spark: SparkSession, out: str, key: str = "doc_id") -> DataFrame:
    """A row for each document in the files: key, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it; the checksum is of the ids, the end id
    included, as little-endian unsigned 32-bit numbers. A task reads a file, some blocks at a time.
    """
    common.ship(spark)
    system, folder = _open(out)
    with system.open_input_stream(f"{folder}/manifest.json") as f:
        files = [(x["name"], x["start"]) for x in json.loads(f.read())["files"]]
    kind = f"`{key}` long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], kind)
    listed = spark.createDataFrame(files, "name string, start long").repartition(len(files), "name")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = _open(out)
        for batch in batches:
            for name, start in zip(batch["name"], batch["start"]):
                rows, n, crc = [], 0, 0
                with system.open_input_file(f"{folder}/{name}") as f:
                    for doc, ended, ids in simple8b.read(f):
                        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        n += len(ids)
                        if ended:
                            rows.append((doc, start, n, crc))
                            start, n, crc = start + n, 0, 0
                found = pd.DataFrame(rows, columns=[key, "start", "n_tokens", "ids_crc32"])
                yield found.astype({key: "Int64"})

    return listed.mapInPandas(decode, kind)


def tokenize(spark: SparkSession, docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", remember: bool = True, order: tuple[Column, ...] = ()) -> DataFrame:
    """Writes token files under the shared folder and reads them back."""
    out = common.fresh_dir(spark, "tokens")
    write_token_files(docs, out, tokenizer, text, key, remember=remember, order=order)
    return read_token_files(spark, out, key)


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents through token files and back."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenize(spark, docs, public_tokenizers.path("word_bpe_49k.json"))
