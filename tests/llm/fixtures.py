"""Small corpora with the awkward cases: nulls, empty and very long texts, ties, repeated rows,
columns whose names an operator might use itself."""

import random

CLASHES = "keep_id kept group_size digest norm blob found fingerprint fp component_id row key keys spans items words token rule verdict score label y model page html_ n".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"

WORDS = {
    "en": "the of and to in that was for with this from have not are which their there would about when".split(),
    "fr": "le la les des une dans pour avec que qui est sont mais plus comme cette leur elle nous aussi".split(),
    "de": "der die das und nicht eine ist auch sich mit dem werden haben wird einer aber nach durch wenn".split(),
}


def sentence(rng, lang="en", n=12):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "er", "ing", "en", "ed"]) for _ in range(n)).capitalize() + "."


def prose(rng, lang="en", sentences=6):
    return "\n".join(sentence(rng, lang) for _ in range(sentences))


def corpus(seed=3, n=60):
    """(doc_id, text, lang): plain prose with copies, near copies and the awkward cases."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "fr", "de"])
        rows.append((i, prose(rng, lang, rng.randint(1, 9)), lang))
    rows += [(n + i, rows[i][1], rows[i][2]) for i in range(5)]  # exact copies
    rows += [(n + 5 + i, rows[i][1].replace(" ", "  ", 2), rows[i][2]) for i in range(3)]  # differ by white space
    rows += [(n + 8 + i, rows[20 + i][1] + " Finally.", rows[20 + i][2]) for i in range(4)]  # near copies
    long = prose(rng, "en", 2500)
    k = n + 20
    rows += [(k, long, "en"), (k + 1, long[100:], "en"), (k + 2, None, "en"), (k + 3, "", None), (k + 4, " \t\n", "fr"), (k + 5, "Ä", "de"), (k + 6, "12 34 !!", "en")]
    rows += [(k + 7, "a" * 1000, None), (k + 8, "ab" * 700, None), (None, "no id at all here", "en"), (None, "no id at all here", "en")]
    rows += [rows[7], rows[7]]  # repeated rows
    return rows


def frame(spark, rows, extra=True):
    """The documents table; ``extra`` adds columns whose names operators use themselves."""
    df = spark.createDataFrame([(i, t, lang, "src", None if t is None else len(t)) for i, t, lang in rows], DOCS)
    return df.selectExpr("*", *(f"'x' AS {c}" for c in CLASHES)) if extra else df


def tables(spark, folder, **frames):
    """Written as the driver's tables are; returns the folder."""
    for name, df in frames.items():
        df.coalesce(2).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
