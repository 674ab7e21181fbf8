import os
import random

import pyarrow as pa
import pytest

from tallymast.llm import sentencepiece as s

from .conftest import FOLDER

pytestmark = pytest.mark.skipif(not os.path.exists(s.MODEL), reason="no public tokenizer here")
STRANGE = ["", " ", "  a  b ", "\n\n", "é　x☃🎉z", "a" * 300, "aaaa bbbb", "1234567890 " * 5, "\x00\x01", "\U0010ffffab", "The  the   the", "x" * 5_000 + " ü" * 500]


@pytest.fixture(scope="module")
def pieces():
    return s.Pieces.load()


def test_same_ids_as_the_library(spark, pieces):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=s.MODEL)
    texts = STRANGE + [r[0] for r in spark.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/documents.parquet").select("text").collect()]
    got = [x.tolist() for x in pieces.encode(texts)]
    assert got == library.encode(texts)
    assert [pieces.decode(x) for x in got] == texts


def test_columns_of_ids_and_texts(pieces, monkeypatch):
    texts = [*STRANGE, None, "é" * 9, "a � b"]
    byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces.pieces, pieces.kinds)) if k == s.BYTE}
    for most in (10, 4_000_000):
        monkeypatch.setattr(s, "CHARS", most)
        ids = pieces.encode_column(pa.array(texts))
        assert ids.to_pylist() == [x.tolist() for x in pieces.encode(texts)]
        assert pieces.decode_column(ids).to_pylist() == [t or "" for t in texts]
        # ids that are no text of anything: torn characters among others, nulls, slices
        rnd = random.Random(8)
        lists = [[rnd.choice([*byte.values(), rnd.randrange(len(pieces.pieces))]) for _ in range(rnd.randrange(12))] for _ in range(300)] + [None]
        column = pa.array(lists, pa.list_(pa.int32()))
        want = [None if x is None else pieces.decode(x) for x in lists]
        assert pieces.decode_column(column).to_pylist() == want
        assert pieces.decode_column(column.slice(7, 100)).to_pylist() == want[7:107]
    assert pieces.encode_column(pa.array([], pa.string())).to_pylist() == []


def test_a_small_memory_changes_nothing(pieces, monkeypatch):
    rnd = random.Random(9)
    texts = [" ".join("".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 6))) for _ in range(30)) for _ in range(60)]
    want = [x.tolist() for x in pieces.encode(texts)]
    monkeypatch.setattr(s, "REMEMBERED", 20)
    assert [pieces.encode([t])[0].tolist() for t in texts] == want


def test_compatible_neighbours_are_those_that_merging_leaves(pieces):
    rnd = random.Random(4)
    names = list(pieces.prepared().ids)
    for _ in range(20_000):
        a, b = rnd.choice(names), rnd.choice(names)
        assert pieces.compatible(a, b) == (pieces.merges(a + b) == [a, b])


def test_scores_are_summed_for_a_unigram_vocabulary():
    """Against trying every way to cut a text."""
    rnd = random.Random(6)
    names = ["<unk>", "a", "b", "c", "ab", "bc", "abc", "ca", "cab", s.SPACE, s.SPACE + "a", s.SPACE + "b"]
    toy = s.Pieces(names, [0.0] + [-rnd.random() * 3 - 1 for _ in names[1:]], [s.UNKNOWN] + [s.NORMAL] * (len(names) - 1), s.UNIGRAM)
    score = dict(zip(names, toy.scores, strict=True))

    def best(text):
        table = [(0.0, [])]
        for i in range(1, len(text) + 1):
            table.append(max(((table[i - len(p)][0] + score[p], [*table[i - len(p)][1], p]) for p in names[1:] if text[:i].endswith(p)), key=lambda x: x[0]))
        return table[-1][1]

    for _ in range(50):
        text = "".join(rnd.choice("abc ") for _ in range(rnd.randrange(1, 15)))
        assert [names[i] for i in toy.encode([text])[0]] == best(s.SPACE + text.replace(" ", s.SPACE))


def test_odd_rows_and_no_rows(odd, no_docs):
    rows = s.tokenize(odd).collect()
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in rows)
    assert {r["doc_id"]: r["n_tokens"] for r in rows}[1] == {r["doc_id"]: r["n_tokens"] for r in rows}[2] == 0
    assert s.tokenize(no_docs).count() == 0
