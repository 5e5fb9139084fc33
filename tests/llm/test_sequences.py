import random
import zlib

import numpy as np
import pytest

from quillgraph.llm.sequences import Encoder, ShardReader, manifest, read_documents, write_sequences

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("byte_bpe_50k.json")


def library(path=PATH):
    t = tokenizers.Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def ids_of(encoder, text):
    return np.frombuffer(encoder(text), encoder.dtype).tolist()


def test_ids_are_the_library_s():
    rng = random.Random(5)
    encode, own = library(), Encoder(PATH)
    alphabet = "aabc '\n\t  stredlm09é<|>endoftxÿÐ×²漢☃ \x85\x1c\xa0ǃɏɐ😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 3000, "<|endoftext|>" * 3 + " x<|endoftext|>", "", " " * 777 + "x", "\n\n  \n x", "don't we'll I'd 'S", "Hello world! " * 100]
    texts += ["a" + chr(i) + " b" + chr(i) * 2 + "1" for i in range(0x300)]
    for t in texts:
        assert ids_of(own, t) == encode(t), t


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_files_go_to_the_library(name):
    own, encode = Encoder(P.path(name)), library(P.path(name))
    assert own.known is None
    for t in ("Hello  World", "", "été <|endoftext|>"):
        assert ids_of(own, t) == encode(t)


def order(row):
    return (row[0] is not None, row[0] or 0)


def test_round_trip_and_random_access(spark, documents, tmp_path, many_ranges):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["walk", "Überzug", "green\n", "漢字", "x1"]) for _ in range(rng.randint(0, 90)))) for i in rng.sample(range(-500, 500), 300)]
    folder = str(tmp_path / "out")
    shards = write_sequences(documents(rows), folder, PATH, length=32, rows=4).orderBy("shard").collect()
    assert len(shards) > 1
    encode, at, stream = library(), 0, []
    want = []
    for i, text in sorted(rows, key=order):
        ids = [*encode(text), 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        stream += ids
    assert sorted(map(tuple, read_documents(spark, folder).collect())) == sorted(want)
    at = 0
    for s in shards:
        reader = ShardReader(folder, s["name"])
        assert (len(reader), s.before) == (s.n_sequences, at) and s.n_sequences == -(-s.n_ids // 32)
        real = []
        for k in range(len(reader)):
            ids, mask = reader.sequence(k)
            assert len(ids) == len(mask) == 32 and ids.dtype == np.uint16
            assert mask.to_pylist() == [32 * k + j < s.n_ids for j in range(32)]
            real += [i for i, m in zip(ids.tolist(), mask.to_pylist(), strict=True) if m]
        assert real == stream[at : at + s.n_ids]
        at += s.n_ids
        with pytest.raises(IndexError):
            reader.sequence(len(reader))
    assert at == len(stream)


def test_sequences_are_views_of_the_file(documents, tmp_path):
    folder = str(tmp_path / "out")
    shard = write_sequences(documents([(1, "walk green " * 500)]), folder, PATH, length=16, rows=8).first()
    reader = ShardReader(folder, shard["name"])
    ids, mask = reader.sequence(9)
    again, _ = ShardReader(folder, shard["name"]).sequence(9)
    assert not ids.flags.owndata and not ids.flags.writeable and (ids == again).all()
    maps = [line.split()[0].split("-") for line in open("/proc/self/maps") if shard["name"] in line]
    inside = lambda address: any(int(a, 16) <= address < int(b, 16) for a, b in maps)
    assert inside(ids.ctypes.data) and inside(mask.buffers()[1].address)


def test_what_an_attempt_left_behind_is_not_read(spark, documents, tmp_path):
    folder = tmp_path / "out"
    write_sequences(documents([(1, "a b"), (2, "c")]), str(folder), PATH)
    (folder / "000000-lost.sequences.arrow").write_bytes(b"half a file")
    assert {r.doc_id for r in read_documents(spark, str(folder)).collect()} == {1, 2}
    with pytest.raises(Exception, match="(?i)exists"):
        write_sequences(documents([(3, "d")]), str(folder), PATH)


def test_odd_rows(spark, documents, odd, tmp_path, many_ranges):
    folder = str(tmp_path / "out")
    write_sequences(documents(odd, extra="_hash"), folder, PATH, end=None, length=8)
    encode = library()
    got = sorted((str(r.doc_id), r.n_tokens) for r in read_documents(spark, folder).collect())
    assert got == sorted((str(i), len(encode(t))) for i, t in odd)
    starts = sorted((r.start, r.n_tokens) for r in read_documents(spark, folder).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    first = sorted(read_documents(spark, folder).collect(), key=lambda r: (r.start, r.n_tokens))
    assert [r.doc_id for r in first] == sorted([i for i, _ in odd], key=lambda i: (i is not None, i or 0))
    empty = str(tmp_path / "empty")
    write_sequences(documents([]), empty, PATH)
    assert manifest(spark, empty).count() == 0 and read_documents(spark, empty).count() == 0


def test_a_text_longer_than_a_batch(spark, documents, tmp_path):
    text = "".join(f"walk{i % 977} green{i % 31} " for i in range(150_000))
    folder = str(tmp_path / "out")
    write_sequences(documents([(1, "short"), (2, text), (3, "end")]), folder, PATH)
    rows = {r.doc_id: r for r in read_documents(spark, folder).collect()}
    ids = [*library()(text), 2]
    assert rows[2].n_tokens == len(ids) and rows[2].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and rows[3].start == rows[2].start + len(ids)
