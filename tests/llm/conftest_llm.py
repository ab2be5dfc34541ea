"""Texts for the tests."""

WORDS = "the of and to in that it was for on are with as his they at be this from have or by one had not but what all were when".split()


def prose(seed: int, n: int) -> str:
    """n words that look random but depend on the seed alone."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x // 65536 % len(WORDS)] + chr(97 + x // 7 % 26) * (x // 3 % 3))
    return " ".join(out)
