import hashlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

from cloudgrain.llm import bpe


@pytest.fixture(scope="module")
def direct():
    return Tokenizer.from_file(bpe.vocabulary_path())


def brute(rows, direct):
    out = Counter()
    for i, t in rows:
        ids = direct.encode(t or "", add_special_tokens=False).ids
        out[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(direct.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("sizes", [(256, 1024, 8192), (16, 20, 40)])
def test_same_as_whole_texts(docs, texts, direct, sizes):
    assert Counter(tuple(r) for r in bpe.encode(docs, bpe.DIGESTS, sizes=sizes).collect()) == brute(texts.items(), direct)


@pytest.mark.parametrize("sizes", [(256, 1024, 8192), (16, 20, 40)])
def test_edge_rows(edge, empty, direct, sizes):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert Counter(tuple(r) for r in bpe.encode(edge, bpe.DIGESTS, sizes=sizes).collect()) == brute(rows, direct)
    assert bpe.encode(empty, bpe.DIGESTS).count() == 0 and bpe.encode(empty).count() == 0


def test_ids_and_text(edge, direct):
    for r in bpe.encode(edge).join(edge.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = direct.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == direct.decode(ids, skip_special_tokens=False)


def test_stores_stay_bounded(texts, direct, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_STORE_BYTES", 2000)
    monkeypatch.setattr(bpe, "WORD_STORE_BYTES", 2000)
    own = bpe.ChunkCoder(bpe.vocabulary_path())
    for t in list(texts.values())[:40]:
        cuts = bpe.cut_points([t.encode()], 64, 128, 256, whole_characters=True)[0]
        assert own.text(t.encode(), cuts)[1].decode() == " ".join(map(str, direct.encode(t, add_special_tokens=False).ids))
    assert len(own.chunks) < 50
