import random
from array import array

import tiktoken

from claimgraph.llm import bpe


def test_states_and_words_made_anew_change_no_ids(monkeypatch):
    """Limits so small that states and kept words go again and again."""
    monkeypatch.setattr(bpe, "_STATES", 20)
    monkeypatch.setattr(bpe, "_CACHE", 9)
    path, pattern = bpe.public_vocabulary()
    ranks = bpe.read_ranks(path)
    plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    tokenizer = bpe.Tokenizer(ranks, pattern)
    r = random.Random(5)
    texts = ["", " ", "\n\n a", "don't  stop", "x" * 3000]
    texts += ["".join(r.choice("abeinrst é一\U0001f600 0.9\n\t") for _ in range(r.randrange(300))) for _ in range(150)]
    for text in texts:
        assert array("i", tokenizer.packed(text)).tolist() == plain.encode_ordinary(text)
