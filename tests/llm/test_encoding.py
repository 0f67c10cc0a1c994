import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexiloom.llm.encoding import Encoder

TEXTS = [
    "", " ", "\n\n a", "It's  we'll 12 3½ x²\tdon't", "Ênaïveté İstanbul ŒUVRE ß", "<|endoftext|> a<|startoftext|>b",
    "日本語 text", "égalité   nbsp", "a b", "#$%&*** !! “quoted” — dash… €5", "x" * 3000, "🙂 emoji\x00\x1f",
    "word \n\n  next\r\n", "<|ENDOFTEXT|> <|EndOfText|> <| endoftext |>", "a<|endoftext|>", "x <|startoftext|> ünï 日本", "<|endoftext|>" * 9, "ΣΊΣΥΦΟΣ", "ǅ ǆ ƻ ɏ ×÷",
]


@pytest.mark.parametrize("file,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_pieces_give_the_librarys_ids(file, kind):
    whole = Tokenizer.from_file(public_tokenizers.path(file))
    enc = Encoder(public_tokenizers.path(file), kind, most=20)
    want = [np.asarray(e.ids, "<u4").tobytes() for e in whole.encode_batch(TEXTS, add_special_tokens=False)]
    assert enc.ids(TEXTS) == want
    assert enc.ids(TEXTS[::-1]) == want[::-1]


def test_a_sample_of_the_documents(tables):
    texts = [r["text"] for r in tables("documents").select("text").collect()]
    for file, kind in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")):
        whole = Tokenizer.from_file(public_tokenizers.path(file))
        got = Encoder(public_tokenizers.path(file), kind).ids(texts)
        assert got == [np.asarray(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_strings_of_added_tokens_are_their_ids():
    end = {kind: np.frombuffer(Encoder(public_tokenizers.path(file), kind).ids(["<|endoftext|> a"])[0], "<u4").tolist() for file, kind in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte"))}
    assert end == {"word": [49407, 320], "byte": [50256, 257]}
