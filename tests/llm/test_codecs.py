import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from logweave.llm import webp
from logweave.llm.sentencepiece_bpe import Codec
from logweave.llm.webp import decode_vp8l, images, padded, read_back, store

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_sentencepiece_equals_the_library():
    file = str(public_tokenizers.path("piece_bpe_32k.model"))
    with open(file, "rb") as f:
        codec = Codec(f.read())
    library, rng = sentencepiece.SentencePieceProcessor(model_file=file), random.Random(1)
    bits = ["a", "b", " ", "  ", "▁", "\n", "\t", "é", "日", "😀", "the", " the", "<s>", "<0x0A>", "\0", "x" * 30, "!!", "\r\n"]
    texts = ["", *("".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(3000)), "abcdefghij" * 5000]
    for t in texts:
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert codec.encode(t) == ids
        assert codec.decode(ids) == library.decode(ids)
    assert codec.encode(None) == codec.encode("")


@pytest.mark.parametrize("text", [None, "", "a", "é" * 31, "x" * 64, "y" * 1_100_000])
def test_media_round_trip(text):
    payload, n = padded(text)
    media = store(payload)
    assert n == len((text or "").encode())
    assert read_back(media)[0] == payload
    width, height, pixels = decode_vp8l(images(media)[0])
    assert len(pixels) == width * height and pixels.dtype == np.uint32
    with pytest.raises(ValueError):
        read_back(media[: len(media) // 2 + 13])


def counted(monkeypatch, *names):
    seen = Counter()
    for name in names:
        monkeypatch.setattr(webp, name, lambda *a, f=getattr(webp, name), name=name: (seen.update([name]), f(*a))[1])
    return seen


def test_media_go_through_the_whole_decoder(monkeypatch):
    """Texts that the writer stores in every way that the decoder knows; all come back, and prose gets smaller."""
    seen = counted(monkeypatch, "undo_predictor", "undo_cross_colour", "undo_subtract_green", "undo_palette", "_vector")
    kinds = Counter()
    bits_of = webp.write_image

    def noted(w, channels, refs, main=False, cache_bits=0):
        kinds.update({"references": len(refs), "cache": int(cache_bits > 0)})
        bits_of(w, channels, refs, main, cache_bits)

    monkeypatch.setattr(webp, "write_image", noted)
    rng = random.Random(2)
    words = ["".join(rng.choices("etaoinshr", k=rng.randrange(2, 9))) for _ in range(300)]
    prose = " ".join(rng.choices(words, k=4000))
    texts = [prose, "".join(rng.choice("abcdefghijkl") * 4 for _ in range(900)), "".join("".join(chr(33 + (i + k) % 90) for k in range(4)) for i in range(700)), "!?" * 1000]
    texts += ["".join(chr(36 + (g >> 1)) + "".join((chr(40 + (g >> 1)), chr(g), chr(50 + (g >> 1)))) for g in (rng.randrange(40, 120) for _ in range(1500)))]
    texts += ["".join(rng.choices(alphabet, k=5000)) for alphabet in ("01", "0123", "0123456789abcdef", "".join(map(chr, range(32, 120))))]
    texts += ["".join(map(chr, range(32, 2000))), "", "é" * 400_000]
    for t in texts:
        payload = padded(t)[0]
        media = store(payload)
        assert read_back(media)[0] == payload
        assert store(payload) == media
    assert len(store(padded(prose)[0])) < 0.7 * len(prose)
    assert set(seen) == {"undo_predictor", "undo_cross_colour", "undo_subtract_green", "undo_palette", "_vector"}
    assert kinds["references"] and kinds["cache"]


def test_media_query_uses_transforms(monkeypatch):
    """The query's own passes over its table: prefix codes, references and palettes."""
    seen = counted(monkeypatch, "undo_palette", "_vector", "_coded")
    for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist():
        payload = padded(t)[0]
        assert read_back(store(payload))[0] == payload
    assert seen["undo_palette"] > 150 and seen["_vector"] > 150 and seen["_coded"] > 100


def test_huge_claims_are_errors():
    w = webp.Writer()
    for value, n in ((webp.SIGNATURE, 8), (16383, 14), (16383, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        w.put(value, n)
    for _ in range(5):
        webp.write_prefix(w, [0] * 256)
    with pytest.raises(ValueError, match="too large"):
        decode_vp8l(w.done())


def test_media_query_against_plain_values(spark):
    """Null, empty, very long, repeated rows, clashing columns, an empty table."""
    rows = [(1, "a" * 63, 0), (1, "a" * 63, 0), (None, None, 1), (2, "", 2), (3, "héllo " * 30_000, 3), (4, "z" * 64, 4), (5, "z" * 65, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, media_bytes int").withColumn("feature", F.lit("x"))
    got = webp.digests(df).collect()
    assert len(got) == len(rows)
    for r in got:
        data = (dict((i, t) for i, t, _ in rows)[r.doc_id] or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        media = store(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), sha256(media).hexdigest())
        n = Counter(payload)
        assert f";mean={sum(k * v for k, v in n.items()) * 1000 // len(payload)};distinct={len(n)};" in r.feature
    assert webp.digests(df.limit(0)).count() == 0
    back = webp.pixels(webp.media_column(df)).collect()
    assert all(r.error is None for r in back)
    assert webp.pixels(spark.createDataFrame([(1, None), (2, b"no")], "doc_id bigint, media binary")).where("error is not null").count() == 2
