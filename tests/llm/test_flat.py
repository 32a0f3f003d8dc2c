"""Token files: every id against the tokenizer on whole texts, files as the format says, positions over files."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from catastra.llm import flat
from catastra.llm.queries import QUERIES, TOKENIZER
from tests.llm.helpers import edges, empty

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer here")


def plain(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def test_pieces_encode_as_the_whole():
    r = random.Random(1)
    parts = ["a", "S", "s", "t", "'", "' ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "1", "23", ".", "!", "-", "é", "×", "\x1c", "\x85", "ll", "'s", "<|", "endoftext", "|>", " ", "　", "日本", "ñ", "😎", "é", "ƿ", "ǀ", "don't"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(6_000)] + [" 日 a b" * 9_000, "日" * 40_000]
    e = flat.Encoder(TOKENIZER)
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == [x[:-1] for x in plain(texts)]
    assert max(map(len, e.kept)) <= flat.KEPT_BYTES


def test_long_texts_and_hashes_that_meet(monkeypatch):
    r = random.Random(2)
    texts = ["".join(r.choice(["word", " ", "\n", ", ", "é×ù", "'s", "  ", "x1"]) for _ in range(n)) for n in (0, 1, 3_000, 40, 900, 2)]
    want = [x[:-1] for x in plain(texts)]
    monkeypatch.setattr(flat, "GROUP_CHARS", 500)
    e = flat.Encoder(TOKENIZER)
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == want
    assert len(e.parts(texts[2])) > 5 and "".join(e.parts(texts[2])) == texts[2]
    monkeypatch.setattr(flat, "ODD", 1)  # hashes are sums of bytes now: many meet
    e = flat.Encoder(TOKENIZER)
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(["ab ba", " ba ab", *texts])] == [x[:-1] for x in plain(["ab ba", " ba ab"])] + want


def test_pieces_are_forgotten_in_time(monkeypatch):
    monkeypatch.setattr(flat, "KEPT_PIECES", 20)
    e, texts = flat.Encoder(TOKENIZER), ["".join(chr(97 + (i * k) % 26) for k in range(5)) + " x" for i in range(90)]
    for lo in range(0, 90, 7):
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts[lo : lo + 7])] == [x[:-1] for x in plain(texts[lo : lo + 7])]
        assert len(e.kept) <= 20


def test_query(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want, start = {}, 0
    for (d, _), ids in zip(rows, plain(t for _, t in rows), strict=True):
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op13_token_files"](spark, SF).collect()}
    assert got == want


def test_files(spark, tmp_path):
    """The bytes on disk by the format's own words; documents and windows by number."""
    path = str(tmp_path / "tokens")
    docs = edges(spark).repartition(3)
    manifest = sorted((r.asDict() for r in flat.write_tokens(docs, path, TOKENIZER, 7).collect()), key=lambda r: r["file"])
    assert sorted(os.listdir(path)) == sorted([*(f"tokens-{r['file']:06d}.{k}" for r in manifest for k in ("bin", "doc", "off")), "manifest"])
    ids, tokens, starts = [], [], []
    for r in manifest:
        name = f"{path}/tokens-{r['file']:06d}"
        off = np.fromfile(f"{name}.off", "<u8").astype(int)
        assert (len(off) - 1, off[-1], len(ids), len(tokens), r["dtype"]) == (r["documents"], r["tokens"], r["first_document"], r["first_token"], "<u2")
        starts += [len(tokens) + o for o in off[:-1]]
        tokens += np.fromfile(f"{name}.bin", "<u2").tolist()
        ids += pa.ipc.open_file(f"{name}.doc").read_all().column(0).to_pylist()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append([*plain([r.text])[0][:-1], 7])
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    for i, lo, hi in zip(ids, starts, [*starts[1:], len(tokens)], strict=True):
        texts[i].remove(tokens[lo:hi])
    assert not any(texts.values())
    files = flat.TokenFiles(path)
    assert (files.documents, files.tokens) == (len(ids), len(tokens))
    for n, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(tokens)], strict=True)):
        assert files.document(n).tolist() == tokens[lo:hi]
    for lo in range(0, len(tokens), 5_000):
        assert files.window(lo, 7_777).tolist() == tokens[lo : lo + 7_777]
    with pytest.raises(IndexError):
        files.document(len(ids))


def test_string_ids_and_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([("b", "two"), (None, None), ("a", "one"), ("a", "one")], "doc_id string, text string")
    flat.write_tokens(docs, str(tmp_path / "s"), TOKENIZER, 0)
    got = sorted(((r.id, r.start, r.n_tokens) for r in flat.read_tokens(spark, str(tmp_path / "s"), "string").collect()), key=lambda r: r[1])
    assert got == [(None, 0, 1), ("a", 1, 2), ("a", 3, 2), ("b", 5, 2)]
    assert flat.write_tokens(empty(spark), str(tmp_path / "e"), TOKENIZER, 0).collect() == [] == flat.read_tokens(spark, str(tmp_path / "e")).collect()
    assert flat.TokenFiles(str(tmp_path / "e")).window(0, 5).tolist() == []
