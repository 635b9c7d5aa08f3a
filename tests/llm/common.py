"""Small documents with everything that may be odd about them."""

import random
import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Further columns with names that operators use inside.
CLASHING = ["size", "key", "range", "node", "labels", "comp", "bin", "shard", "slot", "n_words", "quality", "kept", "row_hash", "sk", "target", "copies", "root", "part", "end", "item_id"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, vocabulary=400):
    out = [f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    return " ".join(w + ("." if rng.random() < 0.1 else "") for w in out)


def odd_rows(seed=5, n=60):
    """Documents with copies, near copies, null and empty texts, ids and sources, repeated rows and a long text."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(25, 120)) for _ in range(n)]
    texts += [texts[0]] * 9 + [" ".join([*texts[1].split()[:-1], "other"]), texts[2] + " more words here"]
    texts += ["", None, "one", "one two three", "one two three", " \t\n ", "a\n\nb\na\n", prose(rng, 6000, 3000), "😀 emoji 漢字 text " * 12]
    rows = [(i, t, "en", f"src{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4], None, "src1", None), (None, None, None, None, None), (5, texts[6], "en", "src0", 3)]
    return rows


def frame(spark, rows=None, clashing=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows() if rows is None else rows, DOCS)
    for c in CLASHING if clashing else ():
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3)
