"""Small inputs with every awkward case, and plain Python versions of the operators."""
import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for columns of their own.
CLASHES = ("row", "cls", "doc", "tie", "kept", "score", "lang_pred", "lang_score", "n_words", "start", "ids", "a", "items",
           "label", "root", "spans", "starts", "packed")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def random_text(rng, vocab, n):
    out = []
    for _ in range(n):
        out.append(rng.choice(vocab))
        out.append(rng.choice([" "] * 9 + ["\n", "\t", "  "]))
    return "".join(out)


def edge_rows():
    rng = random.Random(4)
    vocab = ["the", "thing", "wörd", "été", "straße", "niño", "a", "in", "of", "re."] + [f"w{i}" for i in range(60)]
    shared = random_text(rng, vocab, 45)
    base = random_text(rng, vocab, 90)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, base), (6, base), (6, base), (7, base.replace("w1 ", "zz ", 1)),
            (8, "x " + shared + " " + random_text(rng, vocab, 30)), (9, random_text(rng, vocab, 30) + shared), (None, shared + " end"),
            (None, None), (10, "12345 !!! ???"), (11, "日本語 テキスト 😀"), (12, "a" * 5000), (13, "tok " * 400),
            (14, random_text(rng, vocab, 6000)), (15, shared), (15, "another text for the same id " + base), (4, "one two")]
    return [(i, t, ["en", "fr", None][k % 3], ["s1", None][k % 2], len(t or "")) for k, (i, t) in enumerate(rows)]


def frame(spark, rows, schema=DOCS, clashes=True):
    df = spark.createDataFrame(rows, schema)
    have = set(df.columns)
    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHES if clashes and c not in have])


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else schema)


def order(rows):
    return sorted(map(tuple, rows), key=repr)
