import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from screenflow.llm.pieces import Machine, Memo, Vocabulary, escaped
from screenflow.llm.sentencepiece_codec import Codec, codec_digest, decode_pieces, encode_pieces
from screenflow.llm.token_counts import Counter, count_tokens

TEXT = st.lists(st.sampled_from([*"abehntiolr <>/s01é日🙂\n\t.ﬁ▁", "the", "  ", "   ", "</s>", "tion", "aaa", "0000", "----", "\x00", "é"]), max_size=60).map("".join)


@pytest.fixture(scope="module")
def library(model_path):
    return sentencepiece.SentencePieceProcessor(model_file=model_path)


@pytest.fixture(scope="module")
def codec(model_path):
    return Codec(model_path)


@pytest.fixture(scope="module")
def small_chunks(model_path):
    return Counter(model_path, chunk=7)


@settings(max_examples=500, deadline=None)
@given(text=TEXT)
def test_same_as_the_library(library, codec, small_chunks, text):
    ids = library.encode(text, add_eos=True)
    assert codec.encode(text) == ids
    assert small_chunks.count(text) == len(ids) - 1


def test_forgetting_states_changes_nothing(library, model_path):
    machine = Machine(Vocabulary(model_path), True, limit=5)
    for text in ["The quick brown fox jumps", "over   the lazy dog", "tokenization of ﬁne words"] * 2:
        assert machine.ids(escaped(text)) == library.encode(text)
        assert machine.count(escaped(text)) == len(library.encode(text))


def test_pairs_stay_apart_as_merging_says(library, model_path):
    import random

    vocabulary, draw = Vocabulary(model_path), random.Random(3)
    tokens = [i for i in vocabulary.parts if not vocabulary.text[i].startswith("▁")]
    start = vocabulary.ids["▁"]
    for _ in range(3000):
        a, b = draw.choice(tokens), draw.choice(tokens)
        merged = library.encode(vocabulary.text[a] + vocabulary.text[b])
        if vocabulary.compatible(start, a) and vocabulary.compatible(a, b):
            assert merged == [start, a, b]
        else:
            assert merged != [start, a, b]


def test_whole_tables(documents, no_documents, library, model_path):
    got = sorted(map(tuple, codec_digest(documents, model_path).collect()), key=repr)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    wanted = []
    for r in documents.collect():
        ids = library.encode(r["text"] or "", add_eos=True)
        wanted.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(wanted, key=repr)
    counts = sorted(map(tuple, count_tokens(documents, model_path).collect()), key=repr)
    assert counts == sorted(((w[0], len((r["text"] or "").encode()), w[1] - 1, w[1] - 1 > 4096) for w, r in zip(wanted, documents.collect())), key=repr)
    assert codec_digest(no_documents, model_path).count() == count_tokens(no_documents, model_path).count() == 0
    back = decode_pieces(encode_pieces(documents, model_path), model_path, name="back")
    assert back.where("back <> coalesce(text, '')").count() == 0


def test_segments_that_come_again_are_not_worked_out_again():
    worked = []
    memo = Memo(lambda segment: worked.append(segment) or len(segment))
    segments = [f"▁{i}" for i in range(140_000)]
    for _ in range(2):
        assert sum(map(memo.__getitem__, segments)) == sum(map(len, segments))
    assert len(worked) == len(segments)
