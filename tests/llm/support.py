"""Helpers of these tests."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "the re on an ti er st ing ou ed en al ic or is it at ar".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def words(text):
    return WORD.findall(text or "")


#: Extra columns whose names the operators use inside.
CLASHING = (
    "_q _key _node _places row node key hub shard slot label n size at epoch words rank digest first u host path rule verdict mask t b "
    "cell bucket _h k word c g media formatted probability is_secret kept text_hash stands"
).split()
