import random

import numpy as np
import pytest

from tessera.llm import tokens

public = pytest.importorskip("public_tokenizers")


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return [t.encode(x, add_special_tokens=False).ids + [0] for x in texts]


def test_keys_give_the_ids_of_the_whole_text():
    rng = random.Random(5)
    alphabet = ["a", "B", "é", "ß", "1", "2", ".", ",", "'s", "'", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", "中", "🙂", "<|endoftext|>", "\x00", "\x1c", "\x85"]
    texts = ["", " ", "\n", "a", " a", "a ", "a\nb", "a \n b", "\n a", "a\n", " \n \n"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = tokens.Encoder(f.read(), 0)
    for text, got, want in zip(texts, encoder.encode(texts), reference(texts)):
        assert "".join(map(tokens.text_of, tokens.keys_of(text))) == text
        assert np.frombuffer(got, "<u2").tolist() == want, text
