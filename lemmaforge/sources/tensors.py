"""Embedding shards as `.pt` files: zip archives with a pickled dict of ids and a tensor, and the tensor's numbers beside it.

Spark reads the files, from any store that it can open, and a task decodes each by itself. The pickle is read with a closed list of
names: tensors and storages stand for what they describe, anything else is refused, so no code of a file runs. No tensor
library is needed. Files come one to a row; Arrow batches are bounded in bytes by the session.

Defined cases: a folder without such files, a file that is no dict with ids and embeddings, ids that are no list or tuple of strings
or bytes, numbers that are not floating point, and a tensor of another shape than one row an id raise an error that names the
file; an empty shard gives no rows; vectors of all files must be of one length.
"""

from __future__ import annotations

import io
import pickle
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaforge.session import workers_see_package

ROWS = 4096
# The names of storages in such files, and their numbers' kinds. bfloat16 is the upper half of float32.
STORAGES = {"FloatStorage": "f4", "DoubleStorage": "f8", "HalfStorage": "f2", "BFloat16Storage": "bf", "LongStorage": "i8", "IntStorage": "i4", "ShortStorage": "i2", "ByteStorage": "u1", "CharStorage": "i1", "BoolStorage": "?"}
FLOATING = ("f4", "f8", "f2", "bf")


@dataclass(frozen=True)
class Kind:
    name: str


@dataclass(frozen=True)
class Tensor:
    """Numbers of a kind, with the shape that they have in the file."""

    kind: str
    numbers: np.ndarray


class _Reader(pickle.Unpickler):
    def __init__(self, archive: zipfile.ZipFile, root: str, order: str) -> None:
        super().__init__(io.BytesIO(archive.read(f"{root}data.pkl")))
        self.archive, self.root, self.order = archive, root, order

    def find_class(self, module: str, name: str) -> object:
        if module == "torch" and name in STORAGES:
            return Kind(STORAGES[name])
        if (module, name) == ("torch._utils", "_rebuild_tensor_v2"):
            return _tensor
        if (module, name) == ("collections", "OrderedDict"):
            return dict
        raise ValueError(f"{module}.{name} is not allowed")

    def persistent_load(self, pid: tuple) -> tuple[str, np.ndarray]:
        what, kind, key, _, count = pid
        if what != "storage" or not isinstance(kind, Kind):
            raise ValueError(f"a reference to {what} is not allowed")
        raw = self.archive.read(f"{self.root}data/{key}")
        width = "u2" if kind.name == "bf" else kind.name
        numbers = np.frombuffer(raw, np.dtype(width).newbyteorder(self.order))
        if len(numbers) < count:
            raise ValueError(f"storage {key} has {len(numbers)} numbers of {count}")
        return kind.name, numbers


def _tensor(storage: tuple[str, np.ndarray], offset: int, size: tuple[int, ...], stride: tuple[int, ...], *_: object) -> Tensor:
    kind, numbers = storage
    last = offset + sum((n - 1) * s for n, s in zip(size, stride, strict=True)) if all(size) else offset - 1
    if min(offset, *stride, 0) < 0 or last >= len(numbers):
        raise ValueError("a tensor reaches beyond its storage")
    seen = np.lib.stride_tricks.as_strided(numbers[offset:], size, [s * numbers.itemsize for s in stride], writeable=False)
    return Tensor(kind, (seen.astype(np.uint32) << 16).view(np.float32) if kind == "bf" else seen)


def decoded(content: bytes) -> object:
    """What a file holds, with tensors as Tensor."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = archive.namelist()
        top = [n for n in names if n.endswith("data.pkl")]
        if len(top) != 1:
            raise ValueError("no archive of one pickled object")
        root = top[0].removesuffix("data.pkl")
        order = archive.read(f"{root}byteorder").decode() if f"{root}byteorder" in names else "little"
        return _Reader(archive, root, {"little": "<", "big": ">"}[order]).load()


def shard(content: bytes) -> tuple[list[str], np.ndarray]:
    """Ids and vectors of a shard."""
    found = decoded(content)
    if not isinstance(found, dict) or not {"ids", "embeddings"} <= found.keys():
        raise ValueError("no dict with ids and embeddings")
    ids, tensor = found["ids"], found["embeddings"]
    if not isinstance(ids, (list, tuple)) or not all(isinstance(x, (str, bytes, bytearray)) for x in ids):
        raise ValueError("ids are no list of strings")
    if not isinstance(tensor, Tensor) or tensor.kind not in FLOATING:
        raise ValueError("embeddings are no floating-point tensor")
    if tensor.numbers.ndim != 2 or len(ids) != len(tensor.numbers):
        raise ValueError(f"{len(ids)} ids, but embeddings of shape {'x'.join(map(str, tensor.numbers.shape))}")
    return [x if isinstance(x, str) else bytes(x).decode() for x in ids], tensor.numbers.astype(np.float32)


def read_tensor_shards(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, id, embedding) of all `.pt` files of a folder; place is the row in its file."""
    workers_see_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pt").load(path)
    if not files.select("path").limit(1).count():
        raise FileNotFoundError(f"no .pt files in {path}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                try:
                    ids, vectors = shard(content.as_py())
                except (ValueError, KeyError, zipfile.BadZipFile, pickle.UnpicklingError) as e:
                    raise ValueError(f"{name}: {e}") from e
                for at in range(0, len(ids), ROWS):
                    part = vectors[at : at + ROWS]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(np.arange(at, at + len(part))), pa.array(ids[at : at + ROWS], pa.string()), lists], names=["file", "place", "id", "embedding"])

    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return named.mapInArrow(read, "file string, place long, id string, embedding array<float>")
