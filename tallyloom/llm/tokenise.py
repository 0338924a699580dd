"""Token ids of texts by a public byte-level tokenizer."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: A document's last id in packed sequences, and the separator of flat token files.
END_ID, EOD_ID = 1, 50256
#: Every run of 1,000 white-space characters shows as ten in a row among every hundredth character.
STRIDE, BLANKS = 100, re.compile(r"\s{10}")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str, special: bool = True) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids (uint32), equal to those of ``Tokenizer.encode(text, add_special_tokens=False)``.

    Where the vocabulary also lies there as ranks (``.tiktoken``), texts are encoded from these, which gives the same
    ids in a third of the time. Texts that hold a special token's string, or that may hold a run of 1,000 white-space
    characters or more, too deep for that encoder's pattern, go to the tokenizer itself. The encoder stays with its
    worker process. Without ``special`` the string of a special token is text like any other, and its id never comes up.
    """
    import base64
    import os

    import tiktoken
    import tokenizers

    stay = tokenizers.__dict__.setdefault("_tallyloom_encoders", {})  # functions sent by value have no module of their own to keep it
    if (name, special) in stay:
        return stay[name, special]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    model = tokenizers.Tokenizer.from_file(tokenizer_path(name))
    model.encode_special_tokens = not special
    apart = [t.content for t in model.get_added_tokens_decoder().values() if special]
    ranks_path = tokenizer_path(os.path.splitext(name)[0] + ".tiktoken")

    def whole(text: str) -> np.ndarray:
        return np.array(model.encode(text, add_special_tokens=False).ids, np.uint32)

    if not os.path.exists(ranks_path):
        stay[name, special] = whole
        return whole
    import public_tokenizers

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    by_rank = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in apart) or BLANKS.search(text[::STRIDE]):
            return whole(text)
        return by_rank.encode_to_numpy(text, disallowed_special=())

    stay[name, special] = encode
    return encode
