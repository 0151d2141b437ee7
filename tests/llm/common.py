"""Small corpora for the operators' tests."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, start int, n string, score double"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng: random.Random, n: int, letters: str = "abcde") -> list[str]:
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n)]


def corpus(seed: int = 1, n: int = 60, letters: str = "abcdefgh") -> list[tuple]:
    """Rows of SCHEMA (its last columns clash with names that operators use): copies, near copies, shared passages, odd texts."""
    rng = random.Random(seed)
    passage = " ".join(prose(rng, 80, letters))
    texts: list = []
    for i in range(n):
        kind = i % 8
        words = prose(rng, rng.randint(20, 160), letters)
        text = " ".join(words)
        if kind == 1 and texts:
            text = rng.choice([t for t in texts if t])
        elif kind == 2 and texts:
            words = rng.choice([t for t in texts if t]).split(" ")
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = rng.choice(prose(rng, 1, letters))
            text = " ".join(words)
        elif kind == 3:
            text = " ".join(words[:10]) + "\n" + passage + "\n" + " ".join(words[10:])
        elif kind == 4:
            text = "common line one\n" + text.replace(" ", "\n", 2) + "\n  common line one \t\n\ncommon line two"
        texts.append(text)
    texts += [None, "", " \n\t ", "one", "one two", "Ünï çödé x", passage, passage, "x" * 900, "y" * 900 + " z", " ".join(["again"] * 300), "\n".join(["common line one"] * 5)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", "s4", "s5", "s6", None]), 1, rng.randint(0, 9), 7, "n", 0.5) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, parts: int = 3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)
