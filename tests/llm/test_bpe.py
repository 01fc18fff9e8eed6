"""Exactness against the tokenizers library; minimality and look-up of the transducer."""

import random

import pytest

from quillgraph.llm import bpe, packing

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def alphabet():
    return [chr(c) for r in ((9, 14), (28, 36), (39, 48), (65, 70), (97, 123), (0x85, 0x86), (0xA0, 0x180), (0x300, 0x345), (0x391, 0x3CA), (0x1E90, 0x1EA0), (0x2000, 0x2010), (0x3040, 0x3060), (0x1F600, 0x1F610)) for c in range(*r)] + list("ssttrellvvmd")


@pytest.mark.parametrize("known", [(), ("the", "her", "there", "s", "été")])
def test_encode_and_decode_match_the_library(known):
    raw = open(PATH, "rb").read()
    lib = tokenizers.Tokenizer.from_file(PATH)
    model = bpe.WordBpe(raw)
    lexicon = bpe.Transducer.compiled((w.encode(), model.merge(w)) for w in known).to_bytes()
    codec, wrapped = bpe.Codec(raw, lexicon), packing.LibraryEncoder(raw)
    rng = random.Random(5)
    letters = alphabet()
    texts = [None, "", " ", "Don't we'll <|endoftext|>x<|startoftext|>", "ΟΔΟΣ ΟΔΟΣ", "İstanbul H̱", "the there THERE été 123 a1b2", "x" * 500, "'", "a'", "'s's''s!'s 'the 'lla 're've'rx 'v", "'l l'd'", "1's 'M'T9'd", "$$'re"]
    texts += ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(1500)]
    for t, got, same in zip(texts, codec.encode(texts), wrapped.encode(texts), strict=True):
        assert got.tolist() == same.tolist()
        want = lib.encode(t or "", add_special_tokens=False).ids
        ids = got
        assert ids.tolist() == want, t
        assert model.decode(ids).decode() == lib.decode(want, skip_special_tokens=False)


def test_transducer_shares_suffixes_and_numbers_words():
    words = sorted(f"{a}{b}ing".encode() for a in "abc" for b in "xyz")
    t = bpe.Transducer.mapped(bpe.Transducer.compiled((w, [i]) for i, w in enumerate(words)).to_bytes())
    assert len(t.final) == 6
    found = t.numbers([*words, b"axin", b"", b"axings", b"q" * 200])
    assert found.tolist() == [*range(9), -1, -1, -1, -1]
    assert [int(t.ids[t.offsets[n]]) for n in found[:9]] == list(range(9))
    assert bpe.Transducer.mapped(bpe.Transducer.compiled([]).to_bytes()).numbers([b"a"]).tolist() == [-1]


def test_a_full_cache_changes_nothing():
    raw = open(PATH, "rb").read()
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefg'é1$", k=rng.randrange(1, 7))) for _ in range(600)]
    texts = [" ".join(rng.choices(words, k=20)) for _ in range(200)]
    whole, small = packing.LibraryEncoder(raw), packing.LibraryEncoder(raw)
    small.cached = 40
    assert [i.tolist() for i in whole.encode(texts)] == [i.tolist() for t in texts for i in small.encode([t])]
