import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sigmill.llm.tokens import Encoder


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_equals_the_library_on_whole_texts(name, spaces):
    path = public_tokenizers.path(name)
    r = random.Random(4)
    atoms = ["a", "B", "the", "Ünter", "ñ", " ", "  ", "   ", "\n", "\t", "\x0b", "\x1c", " ", " ", "\u0085", ".", ",", "...", "'s", "'", "’", "12", "3", "é", "é", "İ", "Σ", "ΑΣ", "İ", "ß", "漢字", "🙂", "<|endoftext|>", "<|startoftext|>", "<|", "|", "%%%", "!!", "\x00", "­", "K", "Å", "ǅ", "²"]
    texts = ["".join(r.choice(atoms) for _ in range(r.randint(0, 40))) for _ in range(3000)] + [None, ""]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    encoder = Encoder(path, spaces, most=500)
    got = [x.tolist() for lo in range(0, len(texts), 64) for x in encoder.encode(texts[lo : lo + 64])]
    assert len(got) == len(want)
    for t, a, b in zip(texts, got, want):
        assert a == b, t
