"""Which words the encoder takes for new, and that its ids are the library's."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from reviewmill.llm import encoding

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_marks_behind_a_word_do_not_make_it_new():
    known = encoding.Encoder(PATH)
    text = "tone Tone, tone. tone!! tone,### tone; größe größe. don't, x<|endoftext|>, tone|> 4.0. ##."
    assert known.encode(text.encode()).tolist() == ids_of(text)
    text = "tone tone, tone. tone!! tone,###\ttone;\n"
    known = encoding.Encoder(PATH)
    assert known.encode(text.encode()).tolist() == ids_of(text)
    assert set(known.words) == {b"tone", b",", b".", b"!!", b",###", b";"}


def test_words_that_come_again_are_kept(monkeypatch):
    monkeypatch.setattr(encoding, "TABLE_BYTES", 20_000)
    known, met = encoding.Encoder(PATH), []
    word = known._word
    monkeypatch.setattr(known, "_word", lambda text: met.append(text) or word(text))
    for i in range(400):
        text = f"always-here once-{i} also-here"
        assert known.encode(text.encode()).tolist() == ids_of(text) if i % 100 == 0 else len(known.encode(text.encode()))
    assert met.count("always-here") == met.count("also-here") == 1
    assert known.cost < 21_000 and len(known.words) < 200


def test_recurring_words_beyond_the_bound_are_forgotten(monkeypatch):
    monkeypatch.setattr(encoding, "TABLE_BYTES", 20_000)
    known = encoding.Encoder(PATH)
    for i in range(40):
        text = " ".join(f"w{j}" for j in range(i, i + 30)).encode()
        assert known.encode(text).tolist() == known.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        assert known.cost < 30_000


def test_odd_texts_are_encoded_as_the_library_does():
    rng, known = random.Random(3), encoding.Encoder(PATH)
    letters = [*"abZé'ÀµßÿŁİı.,!?|<>-_~`{}̸̧́ \x1c\x85  \n\t0½«“…", "<|endoftext|>", "'s", "'ll"]
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(1, 14)))
        assert known.encode(text.encode()).tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids
