"""A small awkward documents table and its rows as plain tuples."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("size", T.LongType()), T.StructField("row", T.StringType()), T.StructField("hash", T.StringType()),
    T.StructField("n", T.StringType()), T.StructField("f", T.IntegerType()), T.StructField("part", T.StringType()),
    T.StructField("digest", T.StringType()), T.StructField("vslot", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("__row", T.StringType()), T.StructField("__hash", T.StringType()), T.StructField("__copies", T.StringType()),
    T.StructField("__plan_source", T.StringType()), T.StructField("doc", T.StringType()), T.StructField("k", T.StringType())])


def rows(seed: int = 1, repeat_ids: bool = True) -> list[tuple]:
    rng = random.Random(seed)
    vocab = {"en": "the of and to in is that for it was on are with as his".split(),
             "fr": "le de un être et à il avoir ne je son que se qui ce".split()}
    out: list[tuple] = []

    def add(i, text, lang="en", source="a"):
        out.append((i, text, lang, source, len(text or ""), 1, "r", None, "n", 3, "p", "d", "v", f"x{i}", f"row{i}", "h", None, "ps", "d", "k"))

    def prose(lang, n):
        return " ".join(rng.choice(vocab[lang]) + rng.choice(["", "", "s", ","]) for _ in range(n))

    for i in range(40):
        lang = "fr" if i % 3 == 0 else "en"
        add(i, prose(lang, rng.randint(1, 120)), lang, ["a", "b", "é", "\U0001F600", None][i % 5])
    shared = prose("en", 60)
    for i in range(40, 60):  # one family of copies, a third of all rows
        add(i, shared + (" " * (i % 4)) + ("\n" if i % 2 else ""), "en", "a")
    add(60, None), add(61, ""), add(62, " \t\n\x0b\x0c\r "), add(63, "one"), add(64, "two words"), add(65, "!!! 123 ???", None)
    add(66, "Zwölf Boxkämpfer   x\u0085y \x1c z \U0001F600 don't <|endoftext|> Été", "en", None)
    add(67, prose("en", 6000), "en", "b")  # a very long text
    add(68, prose("en", 20) + " " + shared + " " + prose("en", 30), None, "b")
    add(69, "\n".join([shared] * 3 + ["", "  ", "tail"]), "fr", "")
    add(None, prose("en", 50), "en", "a"), add(None, shared, None, None)
    if repeat_ids:
        out.append(out[3]), out.append(out[3]), add(5, "another text under an id that is there already", "en", "b")
    rng.shuffle(out)
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
