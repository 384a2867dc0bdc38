import json
import unicodedata
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewright.llm import bpe, chunks, id_files, packing
from tracewright.llm.shared import work_dir

PATH = chunks.default_vocabulary()
TOKENIZER = Tokenizer.from_file(PATH)
TEXTS = st.lists(
    st.one_of(
        st.text(max_size=8),
        st.sampled_from(["Hello", ", ", ". ", "\n", "'s", "it's", "<|endoftext|>", "<|ENDOFTEXT|>", "ΣΑΣ", "é", "é", "J̌", "a_, b", "!, ", "\x1c", "\x85", "　", "ß", "İ", "12.5, "]),
    ),
    max_size=12,
).map("".join)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_chunk_table_is_the_library(text):
    assert chunks.library_table(PATH).texts([text])[0].tolist() == ids_of(text)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_codec_is_the_library(text):
    own = bpe.codec(PATH)
    ids = own.encode(text)
    assert ids == ids_of(text)
    assert own.decode(ids) == TOKENIZER.decode(ids, skip_special_tokens=False)


def test_codec_is_the_library_for_every_mark():
    """Combining marks, whose classes the library's older tables may lack, alone and beside others."""
    own = bpe.codec(PATH)
    marks = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "M"]
    texts = [t for m in marks for t in ("a" + m, "\u0821" + m, m + "\u0821", "e" + m + "\u0327\u0301", "\u09c7" + m, m)] + ["\u0821\u1ac4", "\u0915\u0c3c\u094d"]
    assert len(marks) > 2000
    wrong = [ascii(t) for t, e in zip(texts, TOKENIZER.encode_batch(texts, add_special_tokens=False)) if own.encode(t) != e.ids]
    assert wrong == []


def test_long_pre_tokens_take_the_queue_and_agree():
    own = bpe.codec(PATH)
    for text in ("a" * 3000, "thequickbrown" * 200, "ab" * 64 + "c"):
        assert own.encode(text) == ids_of(text)


def test_table_survives_its_limit():
    table = chunks.ChunkTable(chunks.library_table(PATH).encode, limit=50)
    rng = np.random.default_rng(1)
    for _ in range(20):
        text = " ".join(f"w{i}" for i in rng.integers(0, 200, 60))
        assert table.texts([text, None, ""])[0].tolist() == ids_of(text)


@given(st.lists(st.integers(0, 1 << 40), max_size=700), st.data())
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(values, data):
    values = sorted(values)
    coded = id_files.EliasFano.unpack(id_files.EliasFano.of(np.array(values, np.uint64)).pack())
    assert coded.values().tolist() == values
    if values:
        i = data.draw(st.integers(0, len(values) - 1))
        j = data.draw(st.integers(i, len(values)))
        assert coded.select(i) == values[i] and coded.values(i, j).tolist() == values[i:j]


@pytest.mark.parametrize("n", [0, 1, id_files.SLICE, id_files.SLICE + 1, 3 * id_files.SLICE - 5])
def test_elias_fano_over_several_slices(n):
    values = np.sort(np.random.default_rng(n).integers(0, 1 << 40, n)).astype(np.uint64)
    assert (id_files.EliasFano.unpack(id_files.EliasFano.of(values).pack()).values() == values.astype(np.int64)).all()


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(2).integers(0, 2000, 20_000)).astype(np.uint64)
    assert 8 * len(id_files.EliasFano.of(values).pack()) / len(values) < 2 + np.log2(1000) + 1.5


def test_files_hold_every_document(spark, docs):
    manifest = id_files.write_ids(docs, work_dir(spark), PATH, end_id=2)
    found = id_files.read_ids(manifest, with_ids=True).orderBy("start").collect()
    rows = docs.select("doc_id", "text").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, tuple(r.ids)) for r in found) == sorted((d is not None, d or 0, (*ids_of(t), 2)) for d, t in rows)
    assert [(r.doc_id is not None, r.doc_id) for r in found] == sorted(((r.doc_id is not None, r.doc_id) for r in found), key=lambda x: (x[0], x[1] or 0))
    start = 0
    for r in found:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4"))
        start += r.n_tokens
    part = manifest.orderBy("part").first()
    shard = id_files.IdFile(part.path)
    assert shard.document(0).tolist() == list(found[0].ids) and shard.name(0) == found[0].doc_id
    streamed = [np.concatenate(list(pieces)).tolist() for _, _, pieces in shard.documents(group=3, window=7)]
    assert streamed == [shard.document(i).tolist() for i in range(shard.footer["documents"])]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert id_files.read_ids(id_files.write_ids(none, work_dir(spark), PATH, end_id=2)).collect() == []
    assert packing.pack(none, work_dir(spark), PATH, end_id=1).collect() == []
    assert bpe.encode_decode(none, PATH).collect() == []


def test_encode_decode_rows(spark, docs):
    found = bpe.encode_decode(docs, PATH, with_ids=True).collect()
    rows = docs.select("doc_id", "text").collect()
    key = lambda d, ids: (d is not None, d or 0, tuple(ids))
    assert sorted(key(r.doc_id, r.ids) for r in found) == sorted(key(d, ids_of(t)) for d, t in rows)
    for r in found:
        assert r.n_tokens == len(r.ids) and r.decoded == TOKENIZER.decode(r.ids, skip_special_tokens=False)


@pytest.mark.parametrize("n", [1, 2, 7, 2047, 2048, 2049, 5000])
def test_piece_lengths(n):
    lengths = packing.piece_lengths(n, 2048)
    assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 2048 for x in lengths)
    assert lengths == sorted(lengths, reverse=True) and len(lengths) == n // 2048 + bin(n % 2048).count("1")


def test_packing_covers_each_id_once(spark, docs):
    found = packing.pack(docs, work_dir(spark), PATH, end_id=1, longest=64, with_ids=True).collect()
    assert sorted(r.sequence_id for r in found) == list(range(len(found))) and {r.offset for r in found} == {0}
    by_length = sorted(found, key=lambda r: r.sequence_id)
    assert [r.length for r in by_length] == sorted((r.length for r in found), reverse=True)
    for doc_id, text in docs.where("doc_id IS NOT NULL AND doc_id <> 400").select("doc_id", "text").collect():
        own = sorted((r for r in found if r.doc_id == doc_id), key=lambda r: r.start)
        ids = [*ids_of(text), 1]
        assert [i for r in own for i in r.ids] == ids
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4")) and r.doc_tokens == len(ids) for r in own)
    repeated = [r for r in found if r.doc_id == 400]
    assert sum(r.length for r in repeated) == 2 * repeated[0].doc_tokens


def test_codec_refuses_other_vocabularies(tmp_path):
    with open(PATH) as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"].pop()
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Codec(str(tmp_path / "v.json"))
    with pytest.raises(ValueError):
        chunks.library_table(str(tmp_path / "v.json"))
