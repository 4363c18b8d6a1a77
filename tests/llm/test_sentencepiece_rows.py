"""The operator's rows against the library: odd texts, whole and repeated, in a DataFrame."""

import struct
from hashlib import sha256

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from logweave.llm.sentencepiece_bpe import digests  # noqa: E402

TEXTS = [None, "", " ", "\n\n \t", "Hello, world! Hello, world!", "  two  spaces ", "ßéñ 漢字 🙂‍🙂", "a" * 20_000, "ab " * 30_000, "▁▁ a▁b", "\x00\x01", "<s> </s> <unk>"]


def test_rows_equal_the_library(spark):
    """Nulls count as empty texts; ties, repeated rows and columns with clashing names stay as they are."""
    file = str(public_tokenizers.path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=file)
    rows = [(n, t, 0, "x") for n, t in enumerate([*TEXTS, *TEXTS[3:6]])] + [(0, "again", 0, "x"), (None, "no id", 0, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, ids_sha256 string")
    want = []
    for n, t, _, _ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((n, len(ids), sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), sha256(library.decode(ids).encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests(df, file).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert digests(df.limit(0), file).count() == 0
