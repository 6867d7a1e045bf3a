"""Small inputs and plain versions of the text operators' definitions."""

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [a + b for a in "ba ko li mu re só tä vi".split() for b in "n r st lo mé ka du pi".split()]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_list(text, k=5):
    w = words(text)
    return [tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text, changes, seed):
    rng, w = random.Random(seed), text.split(" ")
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


EDGE_TEXTS = [None, "", "   \n\t ", "a", "one two three four", "Grüße   x\x0by", "zero\x00byte here now and then"]
