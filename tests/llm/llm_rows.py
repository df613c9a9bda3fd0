"""A small table with everything that the operators have to bear."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng: random.Random, n: int, words: int = 300) -> list[str]:
    return [f"w{min(int(rng.expovariate(0.02)), words)}" for _ in range(n)]


def rows(seed: int = 1) -> list[tuple]:
    """Texts with copies, near copies, shared passages, repeated ids, nulls, blanks and long ones."""
    rng = random.Random(seed)
    out, passage = [], " ".join(prose(rng, 40))
    for i in range(60):
        words = prose(rng, rng.choice([0, 1, 3, 7, 60, 120, 200]))
        text = " ".join(words) + rng.choice(["", ".", "\n", " \t"])
        if i % 7 == 0:
            text += "\n" + passage + "\n" + " ".join(prose(rng, 10))
        out.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "b", "c", None]), len(text)))
    base = prose(rng, 150)
    for i in range(60, 80):  # near copies of one text, a word or more changed
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = "x" + str(rng.randrange(1000))
        out.append((i, " ".join(copy), "en", "b", 0))
    out += [(80, out[5][1], "en", "a", 1), (81, out[5][1], "en", "a", 1), (81, out[5][1], "en", "a", 1)]
    out += [(82, None, None, None, None), (83, "", "en", "a", 0), (84, " \n\t ", "en", "a", 4), (None, "some text without id", "en", "a", 1),
            (None, None, None, None, None), (85, "É " * 5 + "ÄÖ née", "de", "c", 3), (86, " ".join(prose(rng, 20000)), "en", "c", 9)]
    return out
