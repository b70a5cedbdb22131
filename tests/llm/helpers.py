"""Rows that every operator must handle, and small readers."""

import re

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))

#: id, text; nulls, empty texts, blanks, one long text, ties, repeated rows.
EDGE = [
    (1, None), (2, ""), (3, " \t\n "), (4, LONG), (5, "same text here"), (6, "same text here"),
    (6, "same text here"), (None, "same text here"), (None, None), (7, "éà ü 漢字 x"), (8, "one"),
]
#: Columns whose names operators use themselves.
CLASHING = ("row", "id", "size", "shard", "slot", "kept", "block", "old", "draw", "mix_times", "h", "cls")


def edge_docs(spark, extra=True):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string")
    if extra:
        for name in CLASHING:
            docs = docs.selectExpr("*", f"concat('own ', doc_id) as {name}")
    return docs


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
