"""The BPE automaton and the piece counter against the libraries."""

import hashlib
import random
import struct

import pytest
import sentencepiece
from tokenizers import Tokenizer

from fanchart.llm import bpe, token_count
from tests.llm import edge

BYTE, PIECE = bpe.vocabulary(), bpe.vocabulary("piece_bpe_32k.model")
ODD = [chr(c) for c in (*range(0x21), 0x85, 0xA0, 0x1680, 0x180E, 0x2028, 0x200B, 0x3000, 0xFEFF, 0x2581)]
PARTS = [*"aeiounstrhl ABC'sdm.,019  \n\t", *"éüñ中文한ΩжßﬁΪ①²Ⅷ😀", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", " the", "ing", "▁▁", "  ", *ODD]


def texts():
    rnd = random.Random(3)
    yield from ("", " ", "\n", "aaaaaaaaaaa", "a" * 3000, "<|endoftext|>" * 3, "  Hello  <s> wörld\n\t 中 \x00 ﬁ")
    for _ in range(4000):
        pool = rnd.choice([PARTS, "aeh t", [chr(rnd.randrange(1, 0xD7FF)) for _ in range(9)]])
        yield "".join(rnd.choice(pool) for _ in range(rnd.randrange(40)))


def test_automaton_equals_the_library():
    codec, library = bpe.codec(open(BYTE).read()), Tokenizer.from_file(BYTE)
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == struct.pack(f"<{len(ids)}I", *ids), text
        assert codec.decode(codec.encode(text)) == library.decode(ids, skip_special_tokens=False), text


def test_counter_equals_the_library():
    counter, library = token_count.counter(open(PIECE, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for text in texts():
        assert counter.count(text) == len(library.encode(text)), text


def test_a_bounded_table_forgets_and_recomputes():
    kept = bpe.Kept(lambda k: k * 2, keep=3)
    assert [kept[i % 7] for i in range(50)] == [i % 7 * 2 for i in range(50)]
    assert len(kept) <= 3 and len(kept.old) <= 3


def test_encode_and_decode_whole_rows(spark):
    docs = edge.docs(spark)
    encoded = bpe.encode(docs, BYTE)
    assert encoded.count() == len(edge.ROWS)
    back = edge.by_id(bpe.decode(encoded, BYTE))
    assert all(back[r[0]]["text"] == (r[1] or "") for r in edge.ROWS)
    library = Tokenizer.from_file(BYTE)
    for r in bpe.digests(docs, BYTE).collect():
        text = next(x[1] for x in edge.ROWS if x[0] == r.doc_id) or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_counts_of_whole_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = token_count.count_tokens(edge.docs(spark), PIECE, limit=100).collect()
    assert len(rows) == len(edge.ROWS)
    for r in rows:
        text = next(x[1] for x in edge.ROWS if x[0] == r.doc_id) or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n := len(library.encode(text)), n > 100)


@pytest.mark.parametrize("run", [lambda d: bpe.digests(d, BYTE), lambda d: token_count.count_tokens(d, PIECE)])
def test_empty_table(spark, run):
    assert run(edge.docs(spark, [])).collect() == []
