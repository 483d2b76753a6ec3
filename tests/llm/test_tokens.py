"""Token files and SentencePiece spans: exact round trips and comparison with the libraries."""

import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from jurispark.llm import common, token_store
from jurispark.llm import sentencepieces as S
from jurispark.llm.perfect_hash import PerfectHash, fingerprints

SCHEMA = "doc_id long, text string, ids string, start int"
BYTE_BPE = common.tokenizer_path("byte_bpe_50k.json")
PIECES = common.tokenizer_path("piece_bpe_32k.model")
TEXTS = [
    "", None, " ", "  ", "plain words, and more.", " lead", "trail ", "two  blanks", "a \n b\n\n  c",
    "tab\there   nbsp", "don't we'll I'm", "é ñ ß 漢字 \U0001f600", "x <|endoftext|> y </s> <pad>",
    "a▁b ▁ c", "z" * 500, "word " * 3000, "\x1c a \x1cb", "nul\x00 byte",
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("n", [0, 1, 2, 100, 5000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.int64)).view(np.uint64)
    table = PerfectHash.build(keys)
    assert sorted(table.numbers(keys)) == list(range(len(keys)))
    other = np.arange(10_000, dtype=np.uint64)
    found = table.numbers(other)
    stored = np.zeros(len(keys), np.uint32)
    stored[table.numbers(keys)] = fingerprints(keys)
    false = (found >= 0) & ~np.isin(other, keys)
    if len(keys):
        assert (stored[found[false]] == fingerprints(other[false])).mean() < 0.01


def test_files_hold_the_ids_of_the_library(spark, tmp_path):
    rows = [(3 * i - 7, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (5, "again"), (5, "again")]
    folder = f"file://{tmp_path}/store"
    token_store.write_tokens(frame(spark, rows).repartition(3), folder, BYTE_BPE)
    library = Tokenizer.from_file(BYTE_BPE)
    got = token_store.read_tokens(spark, folder).orderBy("start").collect()
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [2])
    at = 0
    for r in got:
        assert r["ids"] in want[r["row_id"]] and r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += len(r["ids"])
    keys = [r["row_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and len(keys) == len(rows)
    asked = spark.createDataFrame([(5,), (-7,), (4242,), (None,)], "doc_id long")
    found = token_store.lookup(spark, folder, asked).collect()
    assert sorted((r["key"], tuple(r["ids"])) for r in found) == sorted(
        (k, tuple(x)) for k in (5, -7) for x in want[k]
    )


def test_no_documents(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    token_store.write_tokens(frame(spark, []), folder, BYTE_BPE)
    assert token_store.read_tokens(spark, folder).collect() == []


def test_word_cache_overflow_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_store, "MAX_CACHED", 3)
    encoder = token_store.ByteEncoder(BYTE_BPE)
    texts = [t or "" for t in TEXTS] * 2
    assert encoder.encode(texts) == encoder.whole(texts)


def test_pieces_equal_the_library_and_tile_the_source(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    df = frame(spark, enumerate(TEXTS))
    for r in S.encode(df, PIECES).collect():
        text = TEXTS[r["doc_id"]] or ""
        ids = library.encode(text, add_eos=True)
        assert r["ids"] == ids and r["decoded"] == library.decode(ids)
        bounds = [r["start"], *r["ends"]]
        assert bounds == sorted(bounds) and len(r["ends"]) == len(ids)
        assert bounds[0] == 0 and bounds[-1] == len(text.encode())
        raw = text.encode()
        for i, a, b in zip(ids, bounds, bounds[1:], strict=False):
            piece = library.id_to_piece(i).replace("▁", " ")
            if not piece.startswith("<") and "▁" not in text:
                assert piece.encode() in (raw[a:b], b" " + raw[a:b])
    assert S.encode(frame(spark, []), PIECES).collect() == []


def test_decode_column(spark):
    df = spark.createDataFrame([([1, 2],), ([],), (None,)], "ids array<int>")
    assert [r["decoded"] for r in S.decode(df, PIECES).collect()] == ["", "", None]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_character_map_equals_the_library(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = library.serialized_normalizer_spec() if hasattr(library, "serialized_normalizer_spec") else None
    if spec is None:
        pytest.skip("this library hides the map")
    normal = S.Normalizer(spec)
    for text in ["ﬁne ①②", "ｶﾞ Ａ", "é Å", "１２３ ㌔", "plain", "", "　x", "ÀÉ ß"]:
        out, align = normal(text.encode())
        want = library.normalize(text)
        assert out.decode() == want
        assert len(align) == len(out) + 1 and (np.diff(align) >= 0).all()


def test_blanks_are_squeezed_with_their_places():
    n = S.Normalizer(b"")
    out, align = n(b"  a   b ")
    assert out.decode() == "▁a▁b"
    assert align.tolist() == [2, 2, 2, 2, 3, 3, 3, 6, 7]
