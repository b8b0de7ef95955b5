"""Made-up sentences."""

WORDS = "river stone cloud winter summer morning letter bread window garden house forest candle silver copper".split()
SMALL = "the of and to in is that it was for with on".split()


def sentence(rng, n):
    return " ".join(rng.choice(SMALL) if k % 3 else rng.choice(WORDS) + rng.choice(WORDS) for k in range(n))
