"""Invented texts for tests."""

import random


def words(r, n, vocab=60):
    return " ".join(f"w{int(r.paretovariate(1.1)) % vocab}" for _ in range(n))


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, empty, null and odd texts."""
    r = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(30))
    out = []
    for i in range(n):
        kind = r.randrange(8)
        if kind == 0 and out:
            text = r.choice(out)
        elif kind == 1 and out:
            base = (r.choice(out) or "").split()
            for _ in range(r.randint(1, 2)):
                if base:
                    base[r.randrange(len(base))] = f"e{r.randrange(99)}"
            text = r.choice([" ", "\n", "\t "]).join(base)
        elif kind == 2:
            text = f"{words(r, r.randint(0, 30))} {passage} {words(r, r.randint(0, 30))}"
        elif kind == 3:
            text = r.choice(["", None, " \n", "One", "one two", "Éa b", "a\x1cb c d"])
        else:
            text = words(r, r.randint(1, 120), 10_000)
        out.append(text)
    return out


#: Texts that tokenizers treat in unlike ways.
ODD = [
    "Plain words, don't  stop\n\nhere 123",
    None,
    "",
    "   ",
    " a",
    "'l",
    "a" * 3000,
    "\x00\x1f\x1c x\x85　y",
    "<|endoftext|>a'll  x\n\n y'lo  <|startoftext|>Å İı ſ ﬁ 中文 é don'T",
    "word " * 900,
    "Été ½ ² naïve — “quoted”",
    "tab\tand\r\nlines \n  end  ",
    "Plain words, don't  stop\n\nhere 123",
]
