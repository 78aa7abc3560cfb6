import numpy as np
import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from strandline.llm import queries
from strandline.llm.encode import ChunkEncoder, bounds, count_tokens, default_tokenizer, encode_corpus

WHOLE = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
WHOLE.encode_special_tokens = True
OWN = ChunkEncoder(*default_tokenizer())


def whole(texts):
    return [x.ids for x in WHOLE.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def chunked(texts, encoder=OWN):
    ids, offsets = encoder(pa.array(texts, pa.string()))
    return [ids[a:z].tolist() for a, z in zip(offsets, offsets[1:])]


def test_every_document_agrees_with_whole_text_encoding(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "text").toPandas()
    got = {r.doc_id: list(r.ids) for r in queries.p7_ids(spark, sf01).collect()}
    assert got == dict(zip(docs.doc_id, whole(docs.text)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="ab Z.,'s't0 \t\n\r é█  ­😀<|endoftext|>") | st.text(), max_size=6))
def test_any_text(texts):
    assert chunked(texts) == whole(texts)


def test_cases(spark):
    texts = [None, "", " ", "  ", "a b", "<|endoftext|>", "we'll go  there 's", "x" * 20_000, " a" * 20_000, "é è " * 5000, "a", "a b", None]
    assert chunked(texts) == whole(texts)
    small = ChunkEncoder(*default_tokenizer(), keep=100)  # starts again and again
    for _ in range(3):
        assert chunked(texts, small) == whole(texts)
    df = spark.createDataFrame([(i % 5, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in encode_corpus(df).collect())
    assert got == sorted((i % 5, ids) for i, ids in enumerate(whole(texts)))
    counts = sorted((r.doc_id, r.n_tokens) for r in count_tokens(df).collect())
    assert counts == sorted((i % 5, len(ids)) for i, ids in enumerate(whole(texts)))
    assert encode_corpus(df.limit(0)).count() == 0


def test_shared_passages_are_cut_alike_and_encoded_once():
    passage = b" the tribunal below misread the clause on late delivery without giving any further reasons and the appeal"
    data = b"Alpha" + passage * 1 + b" Beta gamma" + passage
    a = np.array([0, 5 + len(passage)])
    cut = bounds(np.frombuffer(data, dtype=np.uint8), a, np.array([a[1], len(data)]))
    first = {int(c) - 5 for c in cut if 30 < c - 5 < len(passage)}
    second = {int(c) - (len(data) - len(passage)) for c in cut if 30 < c - (len(data) - len(passage)) < len(passage)}
    assert first == second and len(first) > 5
    e = ChunkEncoder(*default_tokenizer())
    chunked([passage.decode()] * 50, e)
    assert e.encoded_bytes <= len(passage) < e.seen_bytes / 40
