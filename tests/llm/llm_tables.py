"""Small tables that hold every odd case."""

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, mark string, h string, sig string, rid string, t string, part string, chunk string"


def table(spark, rows, parts=3):
    """(doc_id, text[, source]) rows as documents, with extra columns whose names operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *["x"] * 7) for r in rows]
    return spark.createDataFrame(full, COLUMNS).repartition(parts) if full else spark.createDataFrame([], COLUMNS)


LONG = " ".join(f"word{i * i % 977} Token{i}" for i in range(30_000))  # 450,000 characters
TRICKY = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, "ONE"), (None, "null id text of some words here"), (None, None), (7, "éÉ ﷽ 🙂🙂 \x00\x1f   日本語テキスト"),
    (8, LONG), (9, LONG), (10, LONG + " tail"), (11, "a" * 5000), (12, "!!! ??? ..."), (13, "The quick brown fox jumps over the lazy dog"), (14, "the quick brown fox jumps over the lazy dog"),
    (2**62, "far id"), (-5, "negative id"), (15, "<|endoftext|> <|im_end|>\n \\ <\\|"), (15, "repeated id, other text"),
]
