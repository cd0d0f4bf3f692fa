"""What the tests of the text operators share."""

import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [] if text is None else WORD.findall(text.encode())


def documents(spark, rows):
    """A table of documents from (id, text) or (id, text, source), with columns of clashing names."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, 1, "x", 2) for r in rows]
    return spark.createDataFrame(full, DOCUMENTS + ", id long, size string, batch long").repartition(3)
