"""Hand-made `.pt` shards: kinds of numbers, views of storages, and files that are refused by name."""

import io
import struct
import sys
import zipfile

import numpy as np
import pytest

from lemmaforge.sources import shards, tensors


def text(x):
    raw = x.encode()
    return b"X" + struct.pack("<I", len(raw)) + raw


def number(x):
    return b"J" + struct.pack("<i", x)


def pair(*xs):
    return b"(" + b"".join(map(number, xs)) + b"t"


def tensor(storage, count, size, stride, offset=0):
    stored = b"(" + text("storage") + b"ctorch\n" + storage.encode() + b"\n" + text("0") + text("cpu") + number(count) + b"tQ"
    return b"ctorch._utils\n_rebuild_tensor_v2\n(" + stored + number(offset) + pair(*size) + pair(*stride) + b"\x89" + b"ccollections\nOrderedDict\n)R" + b"tR"


def listed(xs):
    return b"](" + b"".join(text(x) for x in xs) + b"e"


def file(ids, embeddings, raw, order="little"):
    body = b"\x80\x02}(" + text("ids") + ids + text("embeddings") + embeddings + b"u."
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("shard/data.pkl", body)
        z.writestr("shard/byteorder", order)
        z.writestr("shard/data/0", raw)
    return out.getvalue()


def put(folder, **files):
    folder.mkdir()
    for name, content in files.items():
        (folder / f"{name}.pt").write_bytes(content)
    return str(folder)


def test_shards_of_several_kinds(spark, tmp_path):
    x = np.array([[1.5, -2.0, 0.25], [3.0, 4.0, 1024.0]])
    half = lambda a: (np.asarray(a, np.float32).view(np.uint32) >> 16).astype(np.uint16).tobytes()
    path = put(
        tmp_path / "s",
        a=file(listed(["1-lemma-0", "1-lemma-1"]), tensor("FloatStorage", 6, (2, 3), (3, 1)), x.astype("<f4").tobytes()),
        b=file(b"(" + text("2-lemma-0") + text("é") + b"t", tensor("HalfStorage", 6, (2, 3), (3, 1)), x.astype(">f2").tobytes(), "big"),
        c=file(b"](U\x033-aU\x033-be", tensor("BFloat16Storage", 6, (2, 3), (3, 1)), half(x)),
        d=file(listed(["t0", "t1"]), tensor("DoubleStorage", 7, (2, 3), (1, 2), 1), np.concatenate(([9.0], x.T.ravel())).astype("<f8").tobytes()),
        e=file(listed([]), tensor("FloatStorage", 0, (0, 3), (3, 1)), b""),
    )
    got = tensors.read_tensor_shards(spark, path).orderBy("file", "place").collect()
    assert [r["id"] for r in got] == ["1-lemma-0", "1-lemma-1", "2-lemma-0", "é", "3-a", "3-b", "t0", "t1"]
    assert all(list(r["embedding"]) == x[r["place"]].tolist() for r in got)
    assert shards.checked(tensors.read_tensor_shards(spark, path)).count() == 8 and "torch" not in sys.modules


@pytest.mark.parametrize(
    ("ids", "embeddings", "said"),
    [
        (listed(["a"]), tensor("FloatStorage", 6, (2, 3), (3, 1)), "bad.pt: 1 ids, but embeddings of shape 2x3"),
        (listed(["a", "b"]), tensor("LongStorage", 3, (2, 1), (1, 1)), "bad.pt: embeddings are no floating-point tensor"),
        (listed(["a", "b"]), tensor("FloatStorage", 6, (2, 3), (9, 1)), "bad.pt: a tensor reaches beyond its storage"),
        (text("ab"), tensor("FloatStorage", 6, (2, 3), (3, 1)), "bad.pt: ids are no list of strings"),
        (b"cos\nsystem\n(" + text("true") + b"tR", text("x"), "bad.pt: os.system is not allowed"),
    ],
)
def test_bad_shards_are_refused_by_name(spark, tmp_path, ids, embeddings, said):
    path = put(tmp_path / "s", bad=file(ids, embeddings, np.zeros(6, "<f4").tobytes()))
    with pytest.raises(Exception, match=said.replace(".", "[.]")):
        tensors.read_tensor_shards(spark, path).collect()


def test_no_shards(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError, match="no .pt files"):
        tensors.read_tensor_shards(spark, str(tmp_path / "none"))
    path = put(tmp_path / "s", bad=b"junk")
    with pytest.raises(Exception, match="bad[.]pt"):
        tensors.read_tensor_shards(spark, path).collect()
