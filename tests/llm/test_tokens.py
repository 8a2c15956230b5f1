import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from terracell.llm.tokens import encoder, vocabulary

ODD = ["", " ", "  ", "a  b", "a   b ", " a", "a\n b", "a\n\n b", "a\n \nb", "x  y", "q　 r", "don't I'M we'LL o'clock ''s a's'tx _a_b_ ab_1 <|  Ünï½ ª µm A×B", "<|endoftext|> a<|endoftext|>b", "\x1c a\x1db \x85", "ΑΣ ΣΑΣ", "é É", "İstanbul ǅ", "a\tb\r\nc", "1234 56  7", "日本 語", "   ", "x" * 5000, "\u0000 a"]


@pytest.mark.parametrize("name,spaces", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_same_ids_as_the_library(name, spaces):
    tok = Tokenizer.from_file(vocabulary(name))
    texts = ODD + pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()[:300]
    for t in texts:
        assert encoder(vocabulary(name), spaces).encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t[:80])


def test_a_full_memory_changes_nothing(monkeypatch):
    from terracell.llm import tokens

    monkeypatch.setattr(tokens, "KEPT", 3)
    for name, spaces in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        enc, tok = tokens.Encoder(vocabulary(name), spaces), Tokenizer.from_file(vocabulary(name))
        for t in ["one two three four five", "six one seven", "", "two eight two nine"] * 2:
            assert enc.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids
        assert len(enc.number) <= 3


def test_texts_at_once_have_the_same_ids():
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = [*ODD, "a ", "b ", "<|endoftext|> a <|endoftext|> b"] + pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()[:300]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the second time from memory
        assert [ids.tolist() for ids in encoder(vocabulary("byte_bpe_50k.json"), True).encode_spaced(texts)] == want
    enc = encoder(vocabulary("byte_bpe_50k.json"), True)
    assert enc.encode_spaced([]) == [] and [len(x) for x in enc.encode_spaced([""])] == [0] and [x.tolist() for x in enc.encode_spaced(["a  b"])] == [want[ODD.index("a  b")]]


def test_a_word_of_many_texts_is_encoded_once(monkeypatch):
    """Also beyond the memory: the library sees each different word of texts that are encoded at once a single time."""
    from terracell.llm import tokens

    monkeypatch.setattr(tokens, "KEPT", 3)
    monkeypatch.setattr(tokens, "JOINED", 2)
    enc, tok = tokens.Encoder(vocabulary("byte_bpe_50k.json"), True), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    seen, plain = [], enc._spaced
    enc._spaced = lambda words: seen.extend(words) or plain(words)
    texts = ["x one two three four five", "y five four three two one", "", "z six "] * 3
    for _ in range(2):
        seen.clear()
        assert [ids.tolist() for ids in enc.encode_spaced(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(seen) == len(set(seen)) and len(enc.number) <= 3
    assert sorted(seen) == ["five", "four", "six"]


def test_tokens_that_cross_words_are_not_joined():
    """Where the parts of joined words cannot be told, each word is encoded for itself."""
    enc = encoder(vocabulary("byte_bpe_50k.json"), True)
    ids, length = enc._spaced(["one", "\n", "two"])
    assert length.tolist() == [len(enc.whole(" " + w)) for w in ("one", "\n", "two")] and ids.tolist() == [i for w in ("one", "\n", "two") for i in enc.whole(" " + w)]
    opens, enc.opens = enc.opens, enc.opens & False
    assert [x.tolist() for x in enc._spaced(["one", "two"])] == [enc.whole(" one") + enc.whole(" two"), [len(enc.whole(" one")), len(enc.whole(" two"))]]
    enc.opens = opens


def test_rows_encoded_at_once(monkeypatch):
    import pyarrow as pa

    from terracell.llm import tokens

    monkeypatch.setattr(tokens, "AT_ONCE", 10)
    texts = pa.array(["abc", "", "x" * 35, "de", "fghijkl", ""])
    cuts = tokens.at_once(texts)
    assert [k for lo, hi in cuts for k in range(lo, hi)] == list(range(6)) and len(cuts) > 2
    assert tokens.at_once(texts.slice(0, 1)) == [(0, 1)]


def test_unspaced_texts_at_once_have_the_same_ids(monkeypatch):
    import pyarrow as pa

    from terracell.llm import tokens

    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = [*ODD, "\x85", "日本 語 \x7f\x1f a\x0bb\x0cc", "</w> a</w>b <|endoftext|>", "ÀÉß×÷ÿ's 12ab'LL--"] + pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()[:300]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for kept in (tokens.KEPT, 3):
        monkeypatch.setattr(tokens, "KEPT", kept)
        enc = tokens.Encoder(path, False)
        for _ in range(2):  # the second time from memory
            assert [ids.tolist() for ids in enc.encode_unspaced(pa.array(["cut off", *texts]).slice(1))] == want
        assert len(enc.number) <= kept
    assert enc.encode_unspaced(pa.array([], pa.string())) == []
    for t in ("", " ", "\x85", "日本 語", "a"):  # alone, with nothing remembered
        assert [x.tolist() for x in tokens.Encoder(path, False).encode_unspaced(pa.array([t]))] == [want[texts.index(t)] if t in texts else tok.encode(t).ids]


def test_a_piece_of_many_texts_is_merged_once(monkeypatch):
    """Also beyond the memory: the merge model sees each different piece of texts that are encoded at once a single time."""
    import pyarrow as pa

    from terracell.llm import tokens

    monkeypatch.setattr(tokens, "KEPT", 3)
    enc, tok = tokens.Encoder(vocabulary("word_bpe_49k.json"), False), Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    seen, plain = [], enc._merged
    enc._merged = lambda pieces: seen.extend(pieces) or plain(pieces)
    texts = ["one Two three, four. five", "five! FOUR three two one", "", " six "] * 3
    for _ in range(2):
        seen.clear()
        assert [ids.tolist() for ids in enc.encode_unspaced(pa.array(texts))] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(seen) == len(set(seen)) and len(enc.number) <= 3
    assert {"four", "five", "six"} <= set(seen)
