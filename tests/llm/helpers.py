"""Small tables with every awkward case, and brute-force versions."""

import random

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, shard int, fingerprint double"


def awkward(spark, texts=None):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text, and columns named like results."""
    rng = random.Random(5)
    long = " ".join(rng.choice(WORDS) for _ in range(30_000))
    base = " ".join(rng.choice(WORDS) for _ in range(120)) + "."
    near = base.replace(base.split()[50], "changed", 1)
    texts = texts or [None, "", " \t\n", "one", "one", base, base, near, long, "a b   c", "\n\n", "x " * 500]
    rows = [(i, t, "en", "s", len(t) if t is not None else None, "clash", i, 0.5) for i, t in enumerate(texts)]
    rows.append(rows[min(5, len(rows) - 1)])
    rows.append((None, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def corpus(n=160, seed=3):
    """(doc_id, text) with exact copies, near copies, shared passages and unrelated texts."""
    rng = random.Random(seed)
    passage = [rng.choice(WORDS) for _ in range(60)]
    out = []
    for i in range(n):
        w = [rng.choice(WORDS) for _ in range(rng.choice([3, 40, 120, 300]))]
        kind = i % 8
        if kind == 1 and out:
            w = out[rng.randrange(len(out))][1].split(" ")
        elif kind == 2 and out:
            w = out[rng.randrange(len(out))][1].split(" ")
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = "edit"
        elif kind == 3:
            w = w[: len(w) // 2] + passage + w[len(w) // 2 :]
        out.append((i, " ".join(w)))
    return out


def documents(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0) for i, t in pairs], "doc_id long, text string, lang string, source string, n_chars long")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
