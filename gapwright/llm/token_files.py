"""Token ids as flat unsigned integer files with 64-bit document offsets, read by memory mapping.

Layout of a folder: ``ids-NNNNN.bin`` (unsigned little-endian integers, 16 bits wide where the vocabulary fits, else
32), ``offsets-NNNNN.bin`` (unsigned 64-bit: the global start of each document of the shard, and the global end),
``docs-NNNNN.bin`` (signed 64-bit document ids) and ``index.json`` (width, shards, their documents and bases).
Documents are ordered by id through a range partitioning; a partition writes one shard with offsets from 0. Bases
come from prefix sums over the shards' totals, one number for each partition, and a second pass over the offset files
alone adds them.

Shards are written under a name of the attempt and renamed when whole, so a lost or speculative task leaves no
half-written shard; offsets of a shard are derived from its own file, so that pass can run again too.

Defined results: a null or empty text is the end id alone; equal ids (repeated rows) stand next to each other in the
order of their texts, null first; rows without an id come first, as the id's smallest value would; an empty table
gives an index without shards; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir, ship
from .tokens import encoder

END, NO_ID = 2, -(1 << 63)


class Store:
    """Files of a folder: a local or shared path is opened itself, any other URL goes through pyarrow's file systems."""

    def __init__(self, url: str):
        scheme = url.split(":", 1)[0] if ":" in url else ""
        self.local = scheme in ("", "file")
        if self.local:
            self.fs, self.root = None, "/" + url.split(":", 1)[-1].lstrip("/")
            os.makedirs(self.root, exist_ok=True)
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(url)

    def put(self, name: str, fill) -> None:
        """``fill(file)`` writes; the file gets its name when it is whole."""
        part = f"{self.root}/_{name}.{uuid.uuid4().hex}"
        if self.local:
            with open(part, "wb") as f:
                fill(f)
            os.replace(part, f"{self.root}/{name}")
        else:
            with self.fs.open_output_stream(part) as f:
                fill(f)
            self.fs.move(part, f"{self.root}/{name}")

    def names(self) -> list[str]:
        if self.local:
            return sorted(os.listdir(self.root))
        from pyarrow import fs

        return sorted(i.base_name for i in self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True)))

    def rename(self, old: str, new: str) -> None:
        if self.local:
            os.replace(f"{self.root}/{old}", f"{self.root}/{new}")
        else:
            self.fs.move(f"{self.root}/{old}", f"{self.root}/{new}")

    def open(self, name: str):
        return open(f"{self.root}/{name}", "rb") if self.local else self.fs.open_input_file(f"{self.root}/{name}")

    def read(self, name: str) -> bytes:
        if self.local:
            with open(f"{self.root}/{name}", "rb") as f:
                return f.read()
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            return f.read()

    def mapped(self, name: str, kind: str) -> np.ndarray:
        """A memory map; a file of a remote store is fetched into a temporary file that goes as soon as it is mapped."""
        if self.local:
            path = f"{self.root}/{name}"
            return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
        with tempfile.NamedTemporaryFile() as held, self.fs.open_input_file(f"{self.root}/{name}") as f:
            shutil.copyfileobj(f, held, 1 << 20)
            held.flush()
            return np.memmap(held.name, kind, "r") if held.tell() else np.empty(0, kind)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END, vocabulary: int | None = None, shards: int | None = None) -> dict:
    """Write ids of every document into ``folder``; returns the index."""
    spark = docs.sparkSession
    ship(spark)
    if vocabulary is None:
        vocabulary = encoder(tokenizer).tokenizer.get_vocab_size()
    kind = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    end = end_id.to_bytes(4, "little")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"ids are whole numbers here, since files hold them as such; {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    ordered = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    # Rows of one id, or without any, are parted by how their texts begin, which is in the order of the texts.
    ordered = ordered.repartitionByRange(shards, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")

    def write(batches):
        enc, store, part = encoder(tokenizer), Store(folder), TaskContext.get().partitionId()
        which, lengths = [], []

        def fill(out):
            for whole in batches:
                which.append(whole.column(0).to_numpy())
                for text in whole.column(1):
                    ids = np.frombuffer(enc.encode(text.as_py() or "") + end, "<u4")
                    out.write(ids.astype(kind).tobytes())
                    lengths.append(len(ids))

        store.put(f"ids-{part:05d}.bin", fill)
        if lengths:
            store.put(f"docs-{part:05d}.bin", lambda f: f.write(np.concatenate(which).astype("<i8").tobytes()))
            store.put(f"offsets-{part:05d}.bin", lambda f: f.write(np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes()))
            yield pa.RecordBatch.from_pydict({"shard": [part], "docs": [len(lengths)], "ids": [int(sum(lengths))]})

    totals = sorted(ordered.mapInArrow(write, "shard long, docs long, ids long").collect())  # one row for each shard
    base, index = 0, {"width": int(kind[2]), "shards": []}
    for t in totals:
        index["shards"].append({"shard": t.shard, "docs": t.docs, "ids": t.ids, "base": base})
        base += t.ids
    if totals:
        bases = spark.createDataFrame([(s["shard"], s["base"]) for s in index["shards"]], "shard long, base long").repartition(min(len(totals), shards))

        def shift(batches):
            store = Store(folder)
            for b in batches:
                for shard, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    own = np.frombuffer(store.read(f"offsets-{shard:05d}.bin"), "<u8")
                    store.put(f"offsets-{shard:05d}.bin", lambda f: f.write((own - own[0] + np.uint64(base)).astype("<u8").tobytes()))
                yield b

        bases.mapInArrow(shift, "shard long, base long").count()
    Store(folder).put("index.json", lambda f: f.write(json.dumps(index).encode()))
    return index


def read_tokens(spark: SparkSession, folder: str, documents_per_task: int = 50_000) -> DataFrame:
    """(doc_id, start, ids): documents of a folder, from memory-mapped shards; ids as little-endian unsigned 32-bit."""
    ship(spark)
    index = json.loads(Store(folder).read("index.json"))
    kind = f"<u{index['width']}"
    ranges = [(s["shard"], at, min(at + documents_per_task, s["docs"])) for s in index["shards"] for at in range(0, s["docs"], documents_per_task)]
    plan = spark.createDataFrame(ranges, "shard long, first long, last long")
    if ranges:
        plan = plan.repartition(len(ranges))

    def read(batches):
        store = Store(folder)
        for b in batches:
            for shard, first, last in zip(*(c.to_pylist() for c in b.columns)):
                ids, docs = store.mapped(f"ids-{shard:05d}.bin", kind), store.mapped(f"docs-{shard:05d}.bin", "<i8")
                offsets = store.mapped(f"offsets-{shard:05d}.bin", "<u8").astype(np.int64)
                for at in range(first, last, 256):
                    to = min(at + 256, last)
                    cuts = offsets[at : to + 1] - offsets[0]
                    own = [ids[i:j].astype("<u4").tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
                    which = pa.array(docs[at:to], pa.int64(), mask=np.asarray(docs[at:to]) == NO_ID)
                    yield pa.RecordBatch.from_arrays([which, pa.array(offsets[at:to], pa.int64()), pa.array(own, pa.binary())], names=["doc_id", "start", "ids"])

    return plan.mapInArrow(read, "doc_id long, start long, ids binary")


def token_files_query(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write documents to a scratch folder and return a row for each from the files read back."""
    folder = shared_dir(docs.sparkSession)
    write_tokens(docs, tokenizer, folder)
    back = read_tokens(docs.sparkSession, folder)
    return back.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
