"""Small documents with everything that operators must bear: nulls, empty and long texts, repeats, ties, clashing columns."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, words="ka lo mi tren sul der pon ve rit as on que bel thing er du fa zo".split()):
    r = random.Random(seed)
    return " ".join("".join(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(n))


def documents(spark, texts, extra=""):
    """texts: list of texts, or of (doc_id, text)."""
    rows = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)
    return df


HARD = [None, "", " \n\t", "a", "Ünï cödé 日本語 ½ ﬁ", "<|endoftext|> </s>[INST]", "word " * 30000, "x" * 70000, "same text here", "same text here", "tabs\tand\r\nlines\x0b\x0c"]
